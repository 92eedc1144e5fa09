"""TSBS IoT line protocol: ``measurement,tag=v field=v[i] nanoseconds`` to points and catalogue.

Lines are split with SQL functions; only the key of a tag set, a 64-bit hash that has no
counterpart there, is a Python function. It runs once a distinct tag set of an Arrow batch, where
the line is: points are not shuffled to meet their keys.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatt import schemas as S
from tidewatt.errors import ModelError
from tidewatt.functions import finite
from tidewatt.sources.points import actual_points

# The format's tags, and the ids that its fields have.
TAGS = ("name", "fleet", "driver", "model", "device_version")
FIELDS = [
    ("readings", "load_capacity", "load_capacity", "1"), ("readings", "fuel_capacity", "fuel_capacity", "1"), ("readings", "nominal_fuel_consumption", "nominal_fuel_consumption", "1"),
    ("readings", "latitude", "latitude", "degree"), ("readings", "longitude", "longitude", "degree"), ("readings", "elevation", "elevation", "m"),
    ("readings", "velocity", "velocity", "km/h"), ("readings", "heading", "heading", "degree"), ("readings", "grade", "grade", "%"), ("readings", "fuel_consumption", "fuel_consumption", "1"),
    ("diagnostics", "load_capacity", "load_capacity", "1"), ("diagnostics", "fuel_capacity", "fuel_capacity", "1"), ("diagnostics", "nominal_fuel_consumption", "nominal_fuel_consumption", "1"),
    ("diagnostics", "fuel_state", "fuel_state", "1"), ("diagnostics", "current_load", "load", "1"), ("diagnostics", "status", "status", "1"),
]
STRIDE = 16
MODULUS = (1 << 60) - 1
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def tag_key(tags: dict[str, str]) -> int:
    """FNV-1a of the sorted tags: key, a zero byte, value, an 0xff byte."""
    raw = b"".join(k.encode() + b"\0" + tags[k].encode() + b"\xff" for k in sorted(tags))
    state = FNV_OFFSET
    for byte in raw:
        state = (state ^ byte) * FNV_PRIME % (1 << 64)
    return state % MODULUS


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line")).where("line != ''")
    parts = lines.withColumn("p", F.split("line", " "))
    head = parts.withColumn("h", F.split(F.get("p", F.lit(0)), ",")).withColumn("f", F.split(F.get("p", F.lit(1)), ","))
    def pair(x) -> dict:
        at = F.instr(x, "=")
        return {"k": F.substring_index(x, "=", 1), "ok": F.when(at > 0, 1), "v": F.when(at > 0, x.substr(at + 1, F.length(x))).otherwise("")}

    def struct(parts: dict):
        return F.struct(*[column.alias(name) for name, column in parts.items()])

    tags = F.transform(F.slice("h", 2, 1000), lambda x: struct(pair(x)))
    fields = F.transform("f", lambda x: struct((own := pair(x)) | {"x": F.regexp_replace(own["v"], "i$", "").try_cast("double")}))  # a value is read once
    out = head.withColumn("measurement", F.get("h", F.lit(0))).withColumn("tags", tags).withColumn("fields", fields).withColumn("ns", F.expr("try_cast(p[2] AS BIGINT)"))
    known = [f"{m}.{f}" for m, f, *_ in FIELDS]
    reason = (
        F.when(F.size("p") != 3, "not three parts").when(~F.col("measurement").isin("readings", "diagnostics"), "unknown measurement")
        .when(F.exists("tags", lambda t: t["ok"].isNull() | (t["k"] == "") | (t["v"] == "") | ~t["k"].isin(*TAGS)) | (F.size(F.array_distinct(F.transform("tags", lambda t: t["k"]))) != F.size("tags")), "bad tag")
        .when(F.col("ns").isNull(), "bad timestamp").when(F.col("ns") % 1000 != 0, "timestamp is not whole microseconds")
        .when(F.exists("fields", lambda t: t["ok"].isNull() | (t["k"] == "") | ~finite(t["x"])) | (F.size(F.array_distinct(F.transform("fields", lambda t: t["k"]))) != F.size("fields")), "bad field")
        .when(F.exists("fields", lambda t: ~F.concat_ws(".", "measurement", t["k"]).isin(*known)), "unknown field"))
    return out.select("line", "measurement", F.expr("ns div 1000").alias("micros"), F.array_sort(F.transform("tags", lambda t: F.concat(t["k"], F.lit("="), t["v"]))).alias("tags"),
                      F.transform("fields", lambda t: F.struct(t["k"].alias("name"), t["x"].alias("value"))).alias("fields"), reason.alias("reason"))


def read_tsbs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """points (without append order of their own: ``append_seq`` is the time), entities, series.

    Raises ModelError that names lines which do not follow the format.
    """
    rows = _parsed(spark, path)
    # a count reads each line once, all partitions at a time; a filter would be pushed below the columns it is made of, which then are made again for each use
    if rows.agg(F.count("reason")).first()[0]:
        wrong = rows.where("reason is not null").select("line", "reason").limit(3).collect()
        raise ModelError("; ".join(f"{r['reason']}: {r['line'][:120]}" for r in wrong))

    @F.arrow_udf("long")
    def key_of(tags: pa.Array) -> pa.Array:
        found = tags.dictionary_encode()
        keys = [tag_key(dict(t.split("=", 1) for t in text.split(",") if t)) for text in found.dictionary.to_pylist()]
        return pa.array(keys, pa.int64()).take(found.indices)

    def keyed(df: DataFrame) -> DataFrame:
        """A key is below 2^60; the series of it and of a field is the next after sixteen times it and the field's ordinal, as an unsigned number."""
        return df.withColumn("key", key_of(F.array_join("tags", ",")))

    def fields(df: DataFrame, value: Column) -> DataFrame:
        wide = df.withColumn("x", F.explode(value)).withColumn("field", F.col("x.name"))
        wide = wide.withColumn("ordinal", F.coalesce(*[F.when((F.col("measurement") == m) & (F.col("field") == f), k) for k, (m, f, *_) in enumerate(FIELDS)]))
        place = F.col("ordinal") + 1
        return wide.withColumn("series_id", F.shiftleft(F.col("key") + F.floor(place / STRIDE), 4).bitwiseOR((place % STRIDE).cast("long")))

    # what trucks and series there are, of one exchange
    shapes = rows.select("tags", "measurement", F.transform("fields", lambda x: F.struct(x["name"].alias("name"))).alias("named")).distinct()
    sets = keyed(shapes).dropDuplicates(["key", "tags"])
    wide = fields(keyed(shapes), F.col("named"))
    points = actual_points(fields(keyed(rows), F.col("fields")), "series_id", "micros", "x.value", "micros")
    entity = F.lpad(F.lower(F.conv((F.col("key") + 1).cast("string"), 10, 16)), 32, "0")
    named = sets.withColumn("map", F.str_to_map(F.array_join("tags", ","), F.lit(","), F.lit("=")))
    prop = F.transform_values(F.map_filter("map", lambda k, v: k != "name"), lambda k, v: F.struct(F.lit("Text").alias("kind"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("d"), v.alias("s")))
    entities = named.select(entity.alias("id"), F.lit("tsbs_truck_tagset").alias("kind"), F.coalesce(F.try_element_at("map", F.lit("name")), F.concat(F.lit("missing-name-"), F.lpad(F.lower(F.conv(F.col("key").cast("string"), 10, 16)), 15, "0"))).alias("name"),
                            F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), prop.alias("properties"))
    pick = lambda i: F.coalesce(*[F.when(F.col("ordinal") == k, F.lit(f[i])) for k, f in enumerate(FIELDS)])
    series = wide.select("series_id", "key", "measurement", "field", "ordinal").distinct().select(
        F.col("series_id").alias("id"), entity.alias("owner_entity"), F.lit(None).cast("string").alias("owner_relation"), F.concat_ws(".", "measurement", "field").alias("name"), pick(2).alias("physical_quantity"), pick(3).alias("canonical_unit"),
        F.when(F.col("ordinal") == 15, "State").otherwise("Gauge").alias("semantics"), F.lit(None).cast("long").alias("maximum_gap_micros"), F.lit(None).cast(S.ROLLUP_POLICY).alias("rollup_policy"))
    return {"points": points, "entities": entities, "series": series}
