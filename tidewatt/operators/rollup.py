"""Clipped rollup buckets, fixed and calendar, and their exact merge.

A value is held until the next point of its series if that comes within the gap; the hold is
cut at the edges of buckets. A bucket's min and max include values held into it, so a bucket
may have no sample and still a min and max. Empty buckets do not exist. Each winner gives its
sample and its pieces in one expression, so the points are read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.errors import InvalidArgument
from tidewatt.functions import bucket_end, bucket_start, bucket_starts, floor_to, value_bits
from tidewatt.operators.aggregates import check_gap, counter, gauge_winners, with_next
from tidewatt.operators.revisions import in_range
from tidewatt.schemas import BUCKET_FIELDS, Resolution

#: Buckets that one hold may touch.
MAX_PIECES = 1_000_000


def build(points: DataFrame, resolution: Resolution, maximum_gap: int | None | Column) -> DataFrame:
    """Winners (any number of series) to buckets.

    ``maximum_gap`` is a number for all series, or a column of ``points``.
    """
    if isinstance(maximum_gap, Column):
        points = points.withColumn("gap", F.coalesce(maximum_gap.cast("long"), F.lit(0)))
    else:
        gap = check_gap(maximum_gap)
        if resolution.micros and gap // resolution.micros > MAX_PIECES:
            raise InvalidArgument(f"a hold of {gap} microseconds touches more than {MAX_PIECES} buckets")
        points = points.withColumn("gap", F.lit(gap).cast("long"))
    held = with_next(points)
    t0, t1 = F.col("valid_time"), F.col("next_time")
    holds = t1.isNotNull() & (t1 > t0) & (t1 - t0 <= F.col("gap"))
    none = F.lit(None)
    sample = F.struct(bucket_start(t0, resolution).alias("b"), t0.alias("ts"), none.cast("long").alias("until"))
    pieces = F.when(holds, F.transform(bucket_starts(t0, t1 - 1, resolution), lambda b: F.struct(b.alias("b"), none.cast("long").alias("ts"), t1.alias("until"))))
    rows = held.select("series_id", "value", "valid_time", F.explode(F.concat(F.array(sample), F.coalesce(pieces, F.array().cast("array<struct<b:bigint,ts:bigint,until:bigint>>")))).alias("x"))
    rows = rows.select("series_id", "value", "valid_time", F.col("x.b").alias("bucket_start"), "x.ts", "x.until")
    end = bucket_end(F.col("bucket_start"), resolution)
    clipped = F.when(F.col("until").isNotNull(), F.least("until", end) - F.greatest("valid_time", "bucket_start")).otherwise(0)
    rows = rows.withColumn("dur", clipped)
    sampled = F.col("ts").isNotNull()
    out = rows.groupBy("series_id", "bucket_start").agg(
        F.count("ts").alias("count"), F.sum(F.when(sampled, F.col("value")).otherwise(0.0)).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min("ts").alias("first_ts"), F.min_by("value", "ts").alias("first_value"), F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value"),
        F.sum(F.col("value") * F.col("dur")).alias("integral"), F.sum("dur").cast("long").alias("covered"))
    return out.withColumn("bucket_end", bucket_end(F.col("bucket_start"), resolution)).select(*BUCKET_FIELDS)


def latest_rollup(points: DataFrame, resolution: Resolution, maximum_gap: int | None) -> DataFrame:
    """Buckets of the latest revisions: one exchange and one sort of the points, then one
    aggregate with partial sums."""
    return build(gauge_winners(points, maximum_gap), resolution, maximum_gap)


def fixed_range(buckets: DataFrame, start: int, end: int) -> DataFrame:
    """Fixed buckets of a range are those that start in it."""
    return buckets.where((F.col("bucket_start") >= start) & (F.col("bucket_start") < end))


def overlapping(buckets: DataFrame, start: int, end: int) -> DataFrame:
    """Calendar and stored buckets of a range are those that overlap it."""
    return buckets.where((F.col("bucket_end") > start) & (F.col("bucket_start") < end))


def rollup_gauge(points: DataFrame, start: int, end: int, resolution: Resolution, maximum_gap: int | None, series=None) -> DataFrame:
    """Buckets of the latest revisions of a range, without a look outside it."""
    return build(gauge_winners(in_range(points, start, end, series), maximum_gap), resolution, maximum_gap)


def merge_exact(buckets: DataFrame, key: Column, adjacent: bool = True) -> DataFrame:
    """Merge each series' buckets that share ``key``: sums, first and last sample, no bridging.

    With ``adjacent``, buckets that do not follow on each other are an error.
    """
    if adjacent:
        over = Window.partitionBy("series_id", "key").orderBy("bucket_start")
        gap = F.lead("bucket_start").over(over) != F.col("bucket_end")
        buckets = buckets.withColumn("key", key).withColumn("bucket_start", F.when(gap, F.raise_error(F.lit("buckets are not adjacent")).cast("long")).otherwise(F.col("bucket_start")))
    else:
        buckets = buckets.withColumn("key", key)
    return buckets.groupBy("series_id", "key").agg(
        F.min("bucket_start").alias("bucket_start"), F.max("bucket_end").alias("bucket_end"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("first_ts").alias("first_ts"), F.min_by("first_value", "first_ts").alias("first_value"), F.max("last_ts").alias("last_ts"), F.max_by("last_value", "last_ts").alias("last_value"),
        F.sum("integral").alias("integral"), F.sum("covered").alias("covered")).select(*BUCKET_FIELDS)


def coarsen(buckets: DataFrame, resolution: Resolution) -> DataFrame:
    """Buckets of a coarser resolution from finer ones that it holds whole; gaps are allowed."""
    merged = merge_exact(buckets, bucket_start(F.col("bucket_start"), resolution), adjacent=False)
    return merged.withColumn("bucket_end", bucket_end(F.col("bucket_start"), resolution)).withColumn("bucket_start", bucket_start(F.col("bucket_start"), resolution)).select(*BUCKET_FIELDS)


def counter_rollup(points: DataFrame, resolution: Resolution) -> DataFrame:
    """Counter states per bucket; a step counts for the bucket that it starts in."""
    out = counter(points.withColumn("bucket_start", bucket_start(F.col("valid_time"), resolution)), "bucket_start")
    return out.withColumn("bucket_end", bucket_end(F.col("bucket_start"), resolution))


def anchored(points: DataFrame, width: int, anchor: int | Column, *aggregates: Column) -> DataFrame:
    """Tumbling buckets counted from ``anchor``: count, sum, min, max of samples per series."""
    found = aggregates or (F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    return points.groupBy("series_id", floor_to(F.col("valid_time"), width, anchor).alias("bucket_start")).agg(*found)


def anchored_at_first(points: DataFrame, width: int) -> DataFrame:
    """Buckets of each series counted from its own first observation."""
    firsts = points.groupBy("series_id").agg(F.min("valid_time").alias("anchor"))  # a row a series; Spark broadcasts it if small
    joined = points.join(firsts, "series_id")
    return anchored(joined, width, F.col("anchor"))


def bucket_checksum(buckets: DataFrame) -> DataFrame:
    """One order-free checksum per series of eight bucket fields: a sum of hashes, in which equal rows do not cancel."""
    fields = ["bucket_start", "bucket_end", "count", "sum", "min", "max", "integral", "covered"]
    return buckets.groupBy("series_id").agg(F.sum(F.xxhash64(*fields).cast("decimal(20,0)")).cast("string").alias("checksum"), F.count("*").alias("buckets"))


def point_checksum(points: DataFrame) -> DataFrame:
    """One order-free checksum per series of (series, valid time, value bits)."""
    return points.groupBy("series_id").agg(F.sum(F.xxhash64("series_id", "valid_time", value_bits(F.col("value"))).cast("decimal(20,0)")).cast("string").alias("checksum"), F.count("*").alias("points"))
