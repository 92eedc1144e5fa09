"""Point queries: history, and the revision that counts for each valid time.

Every query takes points of any number of series. Ranges are half-open on ``valid_time``;
``valid_time_end`` never filters. A range also becomes a predicate on the partition column
``valid_day`` where the table has one, since Spark does not derive it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.errors import InvalidArgument, LimitError
from tidewatt.functions import floor_to
from tidewatt.schemas import DAY, POINT_FIELDS, ZERO_ID

#: Order of preference, best last: across runs, and within one run.
BY_KNOWLEDGE = ("knowledge_time", "change_time", "append_seq")
BY_CHANGE = ("change_time", "knowledge_time", "append_seq")


def in_range(points: DataFrame, start: int | None = None, end: int | None = None, series: list[int] | int | None = None) -> DataFrame:
    """Points with ``start <= valid_time < end`` of the given series (default: all)."""
    if start is not None and end is not None and end <= start:
        raise InvalidArgument("the range is empty or reversed")
    if series is not None:
        points = points.where(F.col("series_id").isin(series) if isinstance(series, (list, tuple, set)) else F.col("series_id") == series)
    day = "valid_day" in points.columns
    if start is not None:
        points = points.where(F.col("valid_time") >= start)
        points = points.where(F.col("valid_day") >= start - start % DAY) if day else points
    if end is not None:
        points = points.where(F.col("valid_time") < end)
        points = points.where(F.col("valid_day") <= (end - 1) - (end - 1) % DAY) if day else points
    return points


def history(points: DataFrame, start: int | None = None, end: int | None = None, series=None) -> DataFrame:
    """All revisions, by (series, valid, knowledge, change) and append order."""
    return in_range(points, start, end, series).select(*POINT_FIELDS).orderBy("series_id", "valid_time", "knowledge_time", "change_time", "append_seq")


def clustered(points: DataFrame) -> DataFrame:
    """Dealt by (series, UTC day): one exchange that serves the winners and the next-point
    window alike, and spreads a hot series over its days."""
    return points.withColumn("day", floor_to(F.col("valid_time"), DAY)).repartition("series_id", "day")


def winners(points: DataFrame, order: tuple[str, ...] = BY_KNOWLEDGE, keep: Column | None = None, carry: int | Column | None = None) -> DataFrame:
    """One point per (series, valid time): the last by ``order`` among those that ``keep`` lets
    through. What is filtered out does not hide an older revision. Keeps the column ``day``.

    With ``carry``, a number of microseconds, a point also goes to each earlier day that ends
    less than that before it (there it is not ``own``): a day's points then meet the point that
    ends their last hold without another pass over the table.
    """
    if keep is not None:
        points = points.where(keep)
    best = Window.partitionBy("series_id", "day", "valid_time").orderBy(*[F.desc(c) for c in order])
    if carry is None:
        dealt = clustered(points)
    else:
        last = floor_to(F.col("valid_time"), DAY)
        days = F.sequence(floor_to(F.col("valid_time") - (F.lit(carry) if isinstance(carry, int) else carry), DAY), last, F.lit(DAY))
        dealt = points.withColumn("day", F.explode(days)).withColumn("own", F.col("day") == last).repartition("series_id", "day")
    return dealt.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def latest(points: DataFrame, start: int | None = None, end: int | None = None, series=None) -> DataFrame:
    """The latest revision, whatever its run."""
    return with_cutoffs(points, start, end, series)


def as_of(points: DataFrame, moment: int, start: int | None = None, end: int | None = None, series=None) -> DataFrame:
    """What was known and recorded at ``moment`` (inclusive)."""
    return with_cutoffs(points, start, end, series, moment, moment)


def with_cutoffs(points: DataFrame, start: int | None = None, end: int | None = None, series=None, max_knowledge: int | None = None, max_change: int | None = None) -> DataFrame:
    """The latest revision with knowledge and change no later than the cutoffs."""
    points = in_range(points, start, end, series)
    if max_knowledge is not None:
        points = points.where(F.col("knowledge_time") <= max_knowledge)
    if max_change is not None:
        points = points.where(F.col("change_time") <= max_change)
    return winners(points).select(*POINT_FIELDS)


def of_run(points: DataFrame, run_id: str, start: int | None = None, end: int | None = None, series=None) -> DataFrame:
    """The latest revision within one run, by change time first."""
    return winners(in_range(points, start, end, series).where(F.col("run_id") == run_id), BY_CHANGE).select(*POINT_FIELDS)


def plan_vs_actual(points: DataFrame, planned: int, actual: int, run_id: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Full outer alignment on the exact valid time of a run's series and an actual series.

    valid_time, planned, actual (points or null), difference (actual - planned, if both).
    """
    def side(series: int, run: str, name: str) -> DataFrame:
        own = of_run(points, run, start, end, series)
        return own.select("valid_time", F.struct(*POINT_FIELDS).alias(name))

    joined = side(planned, run_id, "planned").join(side(actual, ZERO_ID, "actual"), "valid_time", "full_outer")
    return joined.withColumn("difference", F.col("actual.value") - F.col("planned.value"))


def budgeted(points: DataFrame, most: int, start: int | None = None, end: int | None = None, series=None) -> DataFrame:
    """History, or LimitError if it has more than ``most`` rows: counted without reading values."""
    found = in_range(points, start, end, series)
    n = found.select("series_id").limit(most + 1).count()
    if n > most:
        raise LimitError(f"more than {most} points in the range")
    return history(points, start, end, series)


def series_stats(points: DataFrame) -> DataFrame:
    """Per series: revisions, bounds of the valid time (start of the last point), overall end."""
    return points.groupBy("series_id").agg(
        F.count("*").alias("revisions"), F.min("valid_time").alias("min_valid"), F.max("valid_time").alias("max_valid"), F.max("valid_time_end").alias("max_valid_end"))


def latest_per_series(points: DataFrame) -> DataFrame:
    """The winning point of the last valid time of each series: an aggregate with partial
    sums, so no series is gathered."""
    order = F.struct("valid_time", *BY_KNOWLEDGE)
    return points.groupBy("series_id").agg(F.max_by(F.struct(*POINT_FIELDS[1:]), order).alias("p")).select("series_id", "p.*")
