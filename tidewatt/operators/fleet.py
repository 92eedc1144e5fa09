"""Fleet questions over readings of many vehicles: last seen, low levels, sessions, activity.

Readings are rows (vehicle, fleet, ts, value): ``ts`` in microseconds. Everything per vehicle
is a windowed aggregate with partial sums; falls use a window per vehicle and UTC day, and a table of
one row a (vehicle, day) from each day to the next that has any reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.functions import floor_to
from tidewatt.schemas import DAY


def last_reading(readings: DataFrame) -> DataFrame:
    """Last value of each vehicle."""
    return readings.groupBy("vehicle", "fleet").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "seq")).alias("value"))


def below(readings: DataFrame, limit: float) -> DataFrame:
    """Vehicles whose last value is below ``limit``."""
    return last_reading(readings).where(F.col("value") < limit)


def exact_mean(name: str) -> Column:
    """Mean of a column whose sum does not depend on the order of additions.

    A sum of doubles is off by a bit or two, which way goes by the order, and decides whether a mean that is the limit is
    below it. Readings of at most 18 decimals are added as decimals; where one of a group is none, or the sum does not fit, as doubles.
    """
    short = F.col(name).try_cast("decimal(38,18)")
    whole = F.bool_and(short.cast("double").eqNullSafe(F.col(name)))
    return F.coalesce(F.when(whole, F.try_sum(short)).cast("double"), F.sum(name)) / F.count(name)


def stationary(readings: DataFrame, start: int, end: int, most: float) -> DataFrame:
    """Vehicles whose mean in ``[start, end)`` is below ``most``."""
    own = readings.where((F.col("ts") >= start) & (F.col("ts") < end))
    return own.groupBy("vehicle", "fleet").agg(exact_mean("value").alias("mean")).where(F.col("mean") < most)


def active_slots(readings: DataFrame, width: int, least: float) -> DataFrame:
    """Slots of ``width`` in which a vehicle's mean is above ``least``."""
    slots = readings.groupBy("vehicle", "fleet", floor_to(F.col("ts"), width).alias("slot")).agg(exact_mean("value").alias("mean"))
    return slots.where(F.col("mean") > least)


def long_sessions(readings: DataFrame, start: int, end: int, width: int, least: float, most_slots: int) -> DataFrame:
    """Vehicles with more than ``most_slots`` active slots in ``[start, end)``."""
    own = active_slots(readings.where((F.col("ts") >= start) & (F.col("ts") < end)), width, least)
    return own.groupBy("vehicle", "fleet").agg(F.count("*").alias("slots")).where(F.col("slots") > most_slots)


def daily_activity(readings: DataFrame, width: int, least: float) -> DataFrame:
    """Active slots per fleet and UTC day."""
    return active_slots(readings, width, least).groupBy("fleet", floor_to(F.col("slot"), DAY).alias("day")).agg(F.count("*").alias("slots"))


def mean_daily_duration(readings: DataFrame, width: int, least: float) -> DataFrame:
    """Per vehicle: the mean number of active slots on days that have any."""
    days = active_slots(readings, width, least).groupBy("vehicle", "fleet", floor_to(F.col("slot"), DAY).alias("day")).agg(F.count("*").alias("slots"))
    return days.groupBy("vehicle", "fleet").agg((F.sum("slots") / F.count("*")).alias("mean_slots"))


def breakdowns(readings: DataFrame, least: float) -> DataFrame:
    """Per fleet: falls of a vehicle from at least ``least`` to below it, from each reading to the next.

    Windows are per vehicle and day; a day's last reading is carried to the vehicle's next day that has any.
    """
    over = Window.partitionBy("vehicle", "day").orderBy("ts", "seq")
    own = readings.withColumn("day", floor_to(F.col("ts"), DAY)).withColumn("before", F.lag("value").over(over)).withColumn("first", F.row_number().over(over) == 1)
    lasts = own.groupBy("vehicle", "day").agg(F.max_by("value", F.struct("ts", "seq")).alias("last"))
    earlier = lasts.select("vehicle", "day", F.lag("last").over(Window.partitionBy("vehicle").orderBy("day")).alias("carried"))
    before = F.when(F.col("first"), F.col("carried")).otherwise(F.col("before"))
    both = own.join(earlier, ["vehicle", "day"]).withColumn("before", before)
    return both.groupBy("fleet").agg(F.count_if((F.col("before") >= least) & (F.col("value") < least)).alias("breakdowns"))


def mean_by_fleet(readings: DataFrame) -> DataFrame:
    """Mean value per fleet and UTC day."""
    return readings.groupBy("fleet", floor_to(F.col("ts"), DAY).alias("day")).agg((F.sum("value") / F.count("value")).alias("mean"))
