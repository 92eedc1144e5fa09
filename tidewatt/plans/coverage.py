"""Which stored buckets answer a query, which shards need building, what late points undo.

Functions on one series and range work on the driver with the few descriptors of that range;
functions over all series are DataFrame plans.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.errors import InvalidArgument
from tidewatt.functions import bucket_end, bucket_start, bucket_starts, floor_to, saturating_add
from tidewatt.schemas import DAY, Resolution

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _micros(moment: datetime) -> int:
    return (moment.astimezone(timezone.utc) - _EPOCH) // timedelta(microseconds=1)


def bucket_of(t: int, resolution: Resolution) -> tuple[int, int]:
    """Start and end of the bucket that holds ``t``, on the driver."""
    if resolution.micros:
        start = t - t % resolution.micros
        return start, start + resolution.micros
    zone = ZoneInfo(resolution.tz)
    local = (_EPOCH + timedelta(microseconds=t)).astimezone(zone)
    year, month, day = local.year, local.month, local.day
    if resolution.unit != "Day":
        day = 1
    if resolution.unit == "Year":
        month = 1
    first = datetime(year, month, day)
    if resolution.unit == "Day":
        after = first + timedelta(days=1)
    else:
        after = datetime(year + (resolution.unit == "Year" or month == 12), 1 if resolution.unit == "Year" or month == 12 else month + 1, 1)
    return _midnight(first, zone), _midnight(after, zone)


def _midnight(naive: datetime, zone: ZoneInfo) -> int:
    """The first moment of a local day; where midnight is skipped, the moment of the jump."""
    moment = _micros(naive.replace(tzinfo=zone))
    shown = (_EPOCH + timedelta(microseconds=moment)).astimezone(zone).replace(tzinfo=None)
    return moment if shown == naive else _micros(naive.replace(tzinfo=zone, fold=0))


def envelope(start: int, end: int, resolution: Resolution) -> tuple[int, int]:
    """The range widened to whole buckets."""
    if end <= start:
        raise InvalidArgument("the range is empty or reversed")
    return bucket_of(start, resolution)[0], bucket_of(end - 1, resolution)[1]


def cover(descriptors: list[tuple[int, int]], start: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Greedy cover of ``[start, end)``: numbers of the descriptors used, and the gaps left."""
    order = sorted((s, e, k) for k, (s, e) in enumerate(descriptors) if s < end and e > start)
    used, gaps, cursor, at = [], [], start, 0
    while cursor < end:
        best = None
        while at < len(order) and order[at][0] <= cursor:
            if order[at][1] > cursor and (best is None or order[at][1] > best[1]):
                best = order[at]
            at += 1
        if best is None:
            stop = min(end, order[at][0]) if at < len(order) else end
            gaps.append((cursor, stop))
            cursor = stop
        else:
            used.append(best[2])
            cursor = best[1]
    return used, gaps


def shards(bounds: DataFrame, resolution: Resolution, now: int) -> DataFrame:
    """``bounds(series_id, low, high[, retain])`` to the completed shards (series_id, start, end)
    from the first to the last raw point, without those that the tier no longer keeps."""
    width = resolution.shard_micros
    of = Resolution(micros=width) if width else resolution
    found = bounds.select("*", F.explode(bucket_starts(F.col("low"), F.col("high"), of)).alias("start"))
    found = found.withColumn("end", bucket_end(F.col("start"), of)).where(F.col("end") <= now)
    if "retain" in bounds.columns:
        found = found.where(F.col("retain").isNull() | (F.col("end") >= F.lit(now) - F.col("retain")))
    return found.select("series_id", "start", "end")


def shard_start(bucket: Column, resolution: Resolution) -> Column:
    """Start of the shard that holds a bucket."""
    width = resolution.shard_micros
    return bucket_start(bucket, Resolution(micros=width) if width else resolution)


def needed(bounds: DataFrame, descriptors: DataFrame, resolution: Resolution, now: int) -> DataFrame:
    """Completed shards that no descriptor of the resolution covers."""
    have = descriptors.where(F.col("resolution_key") == resolution.key).select("series_id", "start", "end")
    return shards(bounds, resolution, now).join(have, ["series_id", "start", "end"], "left_anti")


#: Days that a descriptor and its gap may reach over to be dealt by day.
_MAX_DAYS = 4000


def dirty(points: DataFrame, descriptors: DataFrame, gaps: DataFrame) -> DataFrame:
    """Descriptors that new points make wrong: of the same series, with a valid time from
    ``start - gap`` to ``end`` (closed: a point on the edge ends the last hold).

    ``gaps(series_id, gap)``. Points are first reduced to a row a (series, valid time). Both sides are dealt by
    (series, UTC day), so that a hot series is spread over its days; descriptors that reach over more than
    ``_MAX_DAYS`` (there are few to a series) meet the least and greatest time of each day instead.
    """
    day = lambda x: floor_to(x, DAY)
    times = points.select("series_id", "valid_time").distinct().withColumn("day", day(F.col("valid_time")))
    wide = descriptors.join(gaps, "series_id", "left").withColumn("low", saturating_add(F.col("start"), -F.coalesce("gap", F.lit(0))))
    short = F.try_subtract("end", "low") <= _MAX_DAYS * DAY
    dealt = wide.where(short).withColumn("day", F.explode(F.sequence(day(F.col("low")), day(F.col("end")), F.lit(DAY))))
    hit = (dealt["series_id"] == times["series_id"]) & (dealt["day"] == times["day"]) & (times["valid_time"] >= dealt["low"]) & (times["valid_time"] <= dealt["end"])
    near = dealt.join(times, hit, "left_semi").select(*descriptors.columns)
    long = wide.where(~F.coalesce(short, F.lit(False)))
    ends = times.groupBy("series_id", "day").agg(F.array(F.min("valid_time"), F.max("valid_time")).alias("t")).select("series_id", F.explode("t").alias("valid_time"))
    over = (long["series_id"] == ends["series_id"]) & (ends["valid_time"] >= long["low"]) & (ends["valid_time"] <= long["end"])
    far = long.join(ends, over, "left_semi").select(*descriptors.columns)
    return near.unionByName(far).distinct()


def retention_gates(series: DataFrame, bounds: DataFrame, descriptors: DataFrame, now: int) -> DataFrame:
    """Per series with raw retention: series_id, raw_before, eligible, reason.

    ``series`` as in the catalogue, ``bounds(series_id, low)`` the oldest raw point. A tier
    covers ``[low, cutoff)`` if its descriptors, joined end to end, reach over it.
    """
    kept = series.where("rollup_policy.raw_retain_for_micros is not null").select(
        F.col("id").alias("series_id"), (F.lit(now) - F.col("rollup_policy.raw_retain_for_micros")).alias("raw_before"), "rollup_policy.tiers")
    base = kept.join(bounds.select("series_id", "low"), "series_id", "left")
    key = F.transform("tiers", lambda t: F.when(t["resolution"]["kind"] == "Fixed", F.concat(F.lit("fixed/"), t["resolution"]["micros"].cast("string"))).otherwise(
        F.concat_ws("/", F.lit("calendar"), t["resolution"]["unit"], t["resolution"]["tz"])))
    wanted = base.where(F.col("low") < F.col("raw_before")).select("series_id", "low", "raw_before", F.explode(key).alias("resolution_key"))
    own = descriptors.join(wanted, ["series_id", "resolution_key"]).where((F.col("end") > F.col("low")) & (F.col("start") < F.col("raw_before")))
    over = Window.partitionBy("series_id", "resolution_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = own.withColumn("before", F.coalesce(F.max("end").over(over), F.col("low")))
    tiers = reach.groupBy("series_id", "resolution_key").agg(F.max(F.col("start") > F.col("before")).alias("gap"), F.max("end").alias("reached"), F.first("raw_before").alias("raw_before"))
    whole = tiers.where(~F.col("gap") & (F.col("reached") >= F.col("raw_before"))).groupBy("series_id").agg(F.collect_set("resolution_key").alias("covered"))
    joined = base.join(whole, "series_id", "left").withColumn("keys", F.coalesce(key, F.array().cast("array<string>"))).withColumn("covered", F.coalesce("covered", F.array().cast("array<string>")))
    open_tiers = F.filter("keys", lambda k: ~F.array_contains("covered", k))
    # fixed values: the reasons that callers match on
    reason = (F.when(F.col("low").isNull(), "no raw points exist").when(F.col("low") >= F.col("raw_before"), "no raw points are older than the cutoff")
              .when(F.size(open_tiers) > 0, F.concat(F.lit("durable current "), F.get(open_tiers, F.lit(0)), F.lit(" rollup does not cover raw data through the cutoff")))
              .when(F.size("keys") == 0, "raw retention requires at least one durable rollup tier").otherwise("all configured durable rollup tiers cover the deletion range"))
    waits = F.col("low").isNotNull() & (F.col("low") < F.col("raw_before")) & ((F.size(open_tiers) > 0) | (F.size("keys") == 0))
    return joined.select("series_id", "raw_before", (~waits).alias("eligible"), reason.alias("reason"))
