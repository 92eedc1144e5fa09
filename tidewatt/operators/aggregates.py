"""Mergeable aggregates over ordered points: gauges, counters, totals, states, events.

Holds (from a point to the next one of its series) are found within (series, day). Where they
are bounded by a gap of at most ``MAX_CARRY``, winners carry what ends a day's last hold into
that day; otherwise the last point of a day takes the first one of the next day that has any,
from a table of one row a (series, day). So no window spans a whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatt.errors import InvalidArgument
from tidewatt.functions import floor_to
from tidewatt.operators.revisions import winners
from tidewatt.schemas import DAY


#: The longest gap for which points are carried: each day's worth is another copy of the table.
MAX_CARRY = 2 * DAY


def gauge_winners(points: DataFrame, maximum_gap: int | None) -> DataFrame:
    """Latest revisions, ready for ``gauge`` and for rollups with that gap."""
    gap = check_gap(maximum_gap)
    return winners(points, carry=gap) if gap <= MAX_CARRY else winners(points)


def _with_day(points: DataFrame) -> DataFrame:
    return points if "day" in points.columns else points.withColumn("day", floor_to(F.col("valid_time"), DAY)).repartition("series_id", "day")


def with_next(points: DataFrame) -> DataFrame:
    """Adds next_time and next_value of the following point of the series (null for the last).

    Winners with carried points need one window; what follows later than the carry is then null
    or later than the carry, which is the same to a gap that is no longer than that.
    """
    if "own" in points.columns:
        within = Window.partitionBy("series_id", "day").orderBy("valid_time")
        return points.withColumn("next_time", F.lead("valid_time").over(within)).withColumn("next_value", F.lead("value").over(within)).where("own").drop("own")
    points = _with_day(points)
    firsts = points.groupBy("series_id", "day").agg(F.min("valid_time").alias("t"), F.min_by("value", "valid_time").alias("v"))
    over = Window.partitionBy("series_id").orderBy("day")
    following = firsts.select("series_id", "day", F.lead("t").over(over).alias("day_next_time"), F.lead("v").over(over).alias("day_next_value"))
    within = Window.partitionBy("series_id", "day").orderBy("valid_time")
    held = points.withColumn("own_next_time", F.lead("valid_time").over(within)).withColumn("own_next_value", F.lead("value").over(within))
    joined = held.join(following, ["series_id", "day"], "left")
    return joined.withColumn("next_time", F.coalesce("own_next_time", "day_next_time")).withColumn(
        "next_value", F.when(F.col("own_next_time").isNotNull(), F.col("own_next_value")).otherwise(F.col("day_next_value"))
    ).drop("own_next_time", "own_next_value", "day_next_time", "day_next_value")


def check_gap(maximum_gap: int | None) -> int:
    """None acts as zero: no hold counts."""
    if maximum_gap is not None and maximum_gap < 0:
        raise InvalidArgument("the maximum gap is negative")
    return maximum_gap or 0


def gauge(points: DataFrame, maximum_gap: int | None, *keys: str) -> DataFrame:
    """Gauge state of winners per series (and ``keys``): samples, and the integral of values
    held until the next point where that comes within ``maximum_gap``."""
    gap = check_gap(maximum_gap)
    held = with_next(points)
    dur = F.col("next_time") - F.col("valid_time")
    counted = F.when((dur > 0) & (dur <= gap), dur).otherwise(0)
    return held.withColumn("dur", counted).groupBy("series_id", *keys).agg(
        F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min("valid_time").alias("first_ts"), F.min_by("value", "valid_time").alias("first_value"),
        F.max("valid_time").alias("last_ts"), F.max_by("value", "valid_time").alias("last_value"),
        F.sum(F.col("value") * F.col("dur")).alias("integral"), F.sum("dur").cast("long").alias("covered"))


def gauge_states(points: DataFrame, maximum_gap: int | None) -> DataFrame:
    """One state per (series, day), of that day's points alone: what ``merge_gauges`` takes."""
    gap = check_gap(maximum_gap)
    points = _with_day(points)
    within = Window.partitionBy("series_id", "day").orderBy("valid_time")
    dur = F.lead("valid_time").over(within) - F.col("valid_time")
    held = points.withColumn("dur", F.when((dur > 0) & (dur <= gap), dur).otherwise(0))
    return held.groupBy("series_id", "day").agg(
        F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min("valid_time").alias("first_ts"), F.min_by("value", "valid_time").alias("first_value"),
        F.max("valid_time").alias("last_ts"), F.max_by("value", "valid_time").alias("last_value"),
        F.sum(F.col("value") * F.col("dur")).alias("integral"), F.sum("dur").cast("long").alias("covered"))


def merge_gauges(states: DataFrame, maximum_gap: int | None) -> DataFrame:
    """Merge each series' states in time order: sums, and the bridge from one state's last
    point to the next state's first where it is within the gap. Overlapping states are an error."""
    gap = check_gap(maximum_gap)
    over = Window.partitionBy("series_id").orderBy("first_ts")
    bridge = F.lead("first_ts").over(over) - F.col("last_ts")
    checked = states.withColumn("bridge", bridge).withColumn(
        "bridge", F.when(F.col("bridge") < 0, F.raise_error(F.lit("gauge states out of time order")).cast("long")).otherwise(F.col("bridge")))
    held = checked.withColumn("dur", F.when(F.col("bridge") <= gap, F.col("bridge")).otherwise(0))
    return held.groupBy("series_id").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("first_ts").alias("first_ts"), F.min_by("first_value", "first_ts").alias("first_value"),
        F.max("last_ts").alias("last_ts"), F.max_by("last_value", "last_ts").alias("last_value"),
        (F.sum("integral") + F.sum(F.col("last_value") * F.col("dur"))).alias("integral"), F.sum(F.col("covered") + F.col("dur")).alias("covered"))


def _step(now, then):
    """Positive delta of a counter: after a reset, what it has counted since."""
    return F.when(then >= now, then - now).otherwise(F.greatest(then, F.lit(0.0)))


def counter(points: DataFrame, *keys: str) -> DataFrame:
    """Counter state of winners per series (and ``keys``): the increase is credited to the
    point that starts the step."""
    held = with_next(points)
    delta = F.when(F.col("next_time").isNotNull(), _step(F.col("value"), F.col("next_value")))
    reset = F.col("next_value") < F.col("value")
    return held.withColumn("delta", delta).withColumn("reset", reset).groupBy("series_id", *keys).agg(
        F.count("*").alias("count"), F.min("valid_time").alias("first_ts"), F.min_by("value", "valid_time").alias("first_value"),
        F.max("valid_time").alias("last_ts"), F.max_by("value", "valid_time").alias("last_value"),
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("positive_delta"), F.count_if("reset").alias("resets"))


def merge_counters(states: DataFrame) -> DataFrame:
    """Merge counter states that hold only their own steps, with a bridge step between them."""
    over = Window.partitionBy("series_id").orderBy("first_ts")
    then = F.lead("first_value").over(over)
    held = states.withColumn("then", then)
    return held.groupBy("series_id").agg(
        F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.min_by("first_value", "first_ts").alias("first_value"),
        F.max("last_ts").alias("last_ts"), F.max_by("last_value", "last_ts").alias("last_value"),
        F.sum(F.col("positive_delta") + F.coalesce(_step(F.col("last_value"), F.col("then")), F.lit(0.0))).alias("positive_delta"),
        F.sum(F.col("resets") + F.when(F.col("then") < F.col("last_value"), 1).otherwise(0)).alias("resets"))


def counter_states(points: DataFrame) -> DataFrame:
    """One state per (series, day) of that day's points alone: what ``merge_counters`` takes."""
    points = _with_day(points)
    within = Window.partitionBy("series_id", "day").orderBy("valid_time")
    then = F.lead("value").over(within)
    held = points.withColumn("then", then)
    return held.groupBy("series_id", "day").agg(
        F.count("*").alias("count"), F.min("valid_time").alias("first_ts"), F.min_by("value", "valid_time").alias("first_value"),
        F.max("valid_time").alias("last_ts"), F.max_by("value", "valid_time").alias("last_value"),
        F.coalesce(F.sum(_step(F.col("value"), F.col("then"))), F.lit(0.0)).alias("positive_delta"), F.count_if(F.col("then") < F.col("value")).alias("resets"))


def running_counter(points: DataFrame) -> DataFrame:
    """series_id, valid_time, and the increase since the series' first point: running sums
    within a day on top of the sums of the days before."""
    held = with_next(points).withColumn("delta", F.when(F.col("next_time").isNotNull(), _step(F.col("value"), F.col("next_value"))).otherwise(0.0))
    days = held.groupBy("series_id", "day").agg(F.sum("delta").alias("d"))
    earlier = Window.partitionBy("series_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("series_id", "day", F.coalesce(F.sum("d").over(earlier), F.lit(0.0)).alias("before"))
    own = Window.partitionBy("series_id", "day").orderBy("valid_time").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("own", F.coalesce(F.sum("delta").over(own), F.lit(0.0))).join(before, ["series_id", "day"]).select(
        "series_id", "valid_time", (F.col("before") + F.col("own")).alias("increase"))


def interval_totals(points: DataFrame, *keys: str) -> DataFrame:
    """Sum of totals per series, and the time that their intervals span."""
    return points.groupBy("series_id", *keys).agg(F.sum("value").alias("total"), F.count("*").alias("count"), F.sum(F.col("valid_time_end") - F.col("valid_time")).alias("spanned"))


def state_durations(points: DataFrame) -> DataFrame:
    """Per series and state: how often it was entered or reported, and how long it held until the next report."""
    held = with_next(points)
    return held.groupBy("series_id", F.col("value").alias("state")).agg(
        F.count("*").alias("reports"), F.coalesce(F.sum(F.col("next_time") - F.col("valid_time")), F.lit(0)).alias("duration"), F.max("valid_time").alias("last_seen"))


def event_counts(points: DataFrame, *keys: str) -> DataFrame:
    """Per series: events, first and last time."""
    return points.groupBy("series_id", *keys).agg(F.count("*").alias("events"), F.min("valid_time").alias("first_ts"), F.max("valid_time").alias("last_ts"))
