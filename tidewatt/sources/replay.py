"""The sanitized replay format: ``driver_id,series_id,offset_ms,value`` CSV, plain or gzip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt import schemas as S
from tidewatt.errors import ModelError
from tidewatt.functions import finite
from tidewatt.sources.points import actual_points

#: Fixed value: 2026-01-01T00:00:00Z, the origin of offsets.
ORIGIN_MICROS = 1_767_225_600_000_000
HEADER = ("driver_id", "series_id", "offset_ms", "value")


def read_replay(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """points, entities, series; ModelError on a wrong header, a bad row or a series with two drivers."""
    first = spark.read.text(path).limit(1).collect()
    if not first or tuple(first[0][0].strip().split(",")) != HEADER:
        raise ModelError("unknown header")
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").schema(", ".join(f"{h} string" for h in HEADER)).csv(path)
    c = F.col
    rows = raw.select(c("driver_id").try_cast("decimal(20,0)").alias("driver_id"), c("series_id").try_cast("decimal(20,0)").alias("series_id"), c("offset_ms").try_cast("long").alias("offset_ms"), c("value").try_cast("double").alias("value"))
    ok = (c("driver_id") > 0) & (c("series_id") > 0) & (c("offset_ms") >= 0) & (c("offset_ms") <= ((1 << 63) - 1 - ORIGIN_MICROS) // 1000) & finite(c("value"))
    bad = rows.where(~F.coalesce(ok, F.lit(False))).limit(1).collect()
    if bad:
        raise ModelError(f"invalid row {tuple(bad[0])}")
    owners = rows.groupBy("series_id").agg(F.min("driver_id").alias("a"), F.max("driver_id").alias("b"))
    moved = owners.where("a != b").limit(1).collect()
    if moved:
        raise ModelError(f"series {moved[0][0]} changed owner")
    top = F.lit(str(1 << 63)).cast("decimal(20,0)")
    signed = F.when(c("series_id") >= top, c("series_id") - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(c("series_id")).cast("long")
    points = actual_points(rows.withColumn("micros", F.lit(ORIGIN_MICROS) + c("offset_ms") * 1000).withColumn("s", signed), "s", "micros", "value", "offset_ms")
    entity = F.lpad(F.lower(F.conv(c("driver_id").cast("string"), 10, 16)), 32, "0")
    prop = F.create_map(F.lit("source"), F.struct(F.lit("Text").alias("kind"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("d"), F.lit("sanitized-real-installation").alias("s")))
    entities = rows.select("driver_id").distinct().select(entity.alias("id"), F.lit("fixture_driver").alias("kind"), F.concat(F.lit("driver-"), F.lpad(c("driver_id").cast("string"), 4, "0")).alias("name"),
                                                          F.lit(None).cast("string").alias("parent"), F.lit(ORIGIN_MICROS).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), prop.alias("properties"))
    series = owners.select(signed.alias("id"), F.lpad(F.lower(F.conv(c("a").cast("string"), 10, 16)), 32, "0").alias("owner_entity"), F.lit(None).cast("string").alias("owner_relation"), F.concat(F.lit("metric-"), F.lpad(c("series_id").cast("string"), 4, "0")).alias("name"),
                           F.lit("sanitized_measurement").alias("physical_quantity"), F.lit("1").alias("canonical_unit"), F.lit("Gauge").alias("semantics"), F.lit(None).cast("long").alias("maximum_gap_micros"), F.lit(None).cast(S.ROLLUP_POLICY).alias("rollup_policy"))
    return {"points": points, "entities": entities, "series": series}


def samples(points: DataFrame, series: DataFrame) -> DataFrame:
    """The flat table of samples: driver, metric, ts_ms, value."""
    owner = series.select(F.col("id").alias("series_id"), F.conv(F.substring("owner_entity", 17, 16), 16, 10).alias("d"))
    return points.join(owner, "series_id").select(F.concat(F.lit("d"), "d").alias("driver"), F.concat(F.lit("s"), F.col("series_id").cast("string")).alias("metric"), F.floor(F.col("valid_time") / 1000).cast("long").alias("ts_ms"), "value")
