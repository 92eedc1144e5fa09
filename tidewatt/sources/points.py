"""Points from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatt.errors import InvalidArgument
from tidewatt.schemas import HOUR, POINT_FIELDS, ZERO_ID

#: Series of the events table, by event type.
EVENT_SERIES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def actual_points(df: DataFrame, series: Column | str, time: Column | str, value: Column | str, order: Column | str) -> DataFrame:
    """Instants known and recorded when they were valid, of no run."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    t = col(time).cast("long")
    return df.select(col(series).cast("long").alias("series_id"), t.alias("valid_time"), t.alias("valid_time_end"), t.alias("knowledge_time"), t.alias("change_time"),
                     F.lit(ZERO_ID).alias("run_id"), col(value).cast("double").alias("value"), F.lit(0).cast("long").alias("quality"), F.lit(0).cast("long").alias("flags"), col(order).cast("long").alias("append_seq"))


def events_as_points(spark: SparkSession, sf_dir: str, valid_step: int = HOUR) -> DataFrame:
    """The events table as points: several revisions of each (type, step), three runs."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    series = F.coalesce(*[F.when(F.col("event_type") == name, number) for name, number in EVENT_SERIES.items()])
    valid = us - F.pmod(us, F.lit(valid_step))
    run = F.lpad(F.lower(F.hex(F.col("event_id") % 3)), 32, "0")
    return events.select(series.cast("long").alias("series_id"), valid.alias("valid_time"), valid.alias("valid_time_end"), us.alias("knowledge_time"),
                         (us + F.col("event_id") % 7 * 60_000_000).alias("change_time"), run.alias("run_id"), F.col("value").cast("double").alias("value"),
                         F.lit(0).cast("long").alias("quality"), F.lit(0).cast("long").alias("flags"), F.col("event_id").cast("long").alias("append_seq")).select(*POINT_FIELDS)


def parquet_probe(spark: SparkSession, path: str, value: str, key: str | None = None, wanted=None) -> DataFrame:
    """Count and sum of one column, of all rows or of one key: two columns are read at most."""
    if (key is None) != (wanted is None):
        raise InvalidArgument("a key and its value go together")
    df = spark.read.parquet(path)
    df = df.where(F.col(key) == wanted) if key else df
    return df.agg(F.count(value).alias("count"), F.sum(value).alias("sum"))
