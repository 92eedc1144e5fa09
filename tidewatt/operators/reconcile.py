"""Reconciliation: what a source sent against what the store holds.

Points are compared as a multiset of all nine fields, values bit by bit; the catalogue one way
(the last object sent per id); receipts by (source, sequence).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewatt.errors import LimitError
from tidewatt.functions import value_bits
from tidewatt.schemas import POINT_IDENTITY

MAX_DETAILS = 256


def _bits(points: DataFrame) -> DataFrame:
    return points.select(*[c for c in POINT_IDENTITY if c != "value"], value_bits(F.col("value")).alias("value"))


def spans(expected: DataFrame) -> DataFrame:
    """Per series the range of valid times that the expected batches cover."""
    return expected.groupBy("series_id").agg(F.min("valid_time").alias("low"), F.max("valid_time").alias("high"))


def compare_points(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Points with different counts on the two sides, within the spans of the expected ones:
    the nine fields (value as text), expected and stored counts. One aggregate with partial
    sums over the union of both sides; no join of copies."""
    window = stored.join(spans(expected), "series_id").where("valid_time between low and high")
    sides = _bits(expected).withColumn("e", F.lit(1)).withColumn("s", F.lit(0)).unionByName(_bits(window).withColumn("e", F.lit(0)).withColumn("s", F.lit(1)))
    return sides.groupBy(*POINT_IDENTITY).agg(F.sum("e").alias("expected"), F.sum("s").alias("stored"))


def point_counts(compared: DataFrame) -> DataFrame:
    """One row: expected, stored, matched, missing and unexpected points."""
    return compared.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (
        ("expected", F.col("expected")), ("stored", F.col("stored")), ("matched", F.least("expected", "stored")),
        ("missing", F.greatest(F.col("expected") - F.col("stored"), F.lit(0))), ("unexpected", F.greatest(F.col("stored") - F.col("expected"), F.lit(0))))])


def compare_catalog(supplied: DataFrame, stored: DataFrame, order: str = "commit_seq") -> DataFrame:
    """Per supplied id: match, different or missing; the last supplied object counts."""
    fields = [c for c in supplied.columns if c not in ("id", order)]
    want = supplied.groupBy("id").agg(F.max_by(F.to_json(F.struct(*fields)), order).alias("want"))
    have = stored.select("id", F.to_json(F.struct(*fields)).alias("have"))
    return want.join(have, "id", "left").select("id", F.when(F.col("have").isNull(), "missing").when(F.col("want") == F.col("have"), "match").otherwise("different").alias("outcome"))


def compare_receipts(expected: DataFrame, stored: DataFrame, durable: DataFrame) -> DataFrame:
    """Per expected (source, sequence): match, or what is wrong. The payload is looked at only
    when the commit id is the same. ``durable(source_id, durable)`` has the durable sequence."""
    have = stored.select("source_id", "sequence", *[F.col(c).alias(f"have_{c}") for c in ("commit_id", "records", "points", "payload_sha")])
    joined = expected.join(have, ["source_id", "sequence"], "left").join(durable.select("source_id", "durable"), "source_id", "left")
    return joined.select("source_id", "sequence", F.when(F.col("have_commit_id").isNull(), "missing").when(F.col("commit_id") != F.col("have_commit_id"), "commit conflict")
                         .when((F.col("records") != F.col("have_records")) | (F.col("points") != F.col("have_points")), "shape mismatch").when(F.col("payload_sha") != F.col("have_payload_sha"), "payload mismatch")
                         .when(F.coalesce(F.col("durable") < F.col("sequence"), F.lit(True)), "not durable").otherwise("match").alias("outcome"))


def details(frames: dict[str, DataFrame], most: int = MAX_DETAILS) -> list[dict]:
    """The first mismatches of each kind, as text rows for a report."""
    parts = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("detail")) for kind, df in frames.items()]
    return [r.asDict() for r in reduce(DataFrame.unionByName, parts).orderBy("kind", "detail").limit(most).collect()]


def report(expected_points: DataFrame, stored_points: DataFrame, catalogs: dict[str, tuple[DataFrame, DataFrame]], expected_receipts: DataFrame, stored_receipts: DataFrame, durable: DataFrame, max_points: int | None = None) -> dict:
    """Counts, bounded details, and whether the source's copy may be released."""
    if max_points is not None and expected_points.limit(max_points + 1).count() > max_points:
        raise LimitError(f"more than {max_points} expected points")
    points = compare_points(expected_points, stored_points)
    out: dict = {"points": point_counts(points).first().asDict()}
    wrong = {"point": points.where("expected != stored")}
    receipts = compare_receipts(expected_receipts, stored_receipts, durable)
    out["receipts"] = {r["outcome"]: r["count"] for r in receipts.groupBy("outcome").count().collect()}
    wrong["receipt"] = receipts.where("outcome != 'match'")
    out["catalog"] = {}
    for name, (supplied, stored) in catalogs.items():
        compared = compare_catalog(supplied, stored)
        out["catalog"][name] = {r["outcome"]: r["count"] for r in compared.groupBy("outcome").count().collect()}
        wrong[name] = compared.where("outcome != 'match'")
    out["details"] = details(wrong)
    out["content_matches"] = not out["points"]["missing"] and not out["points"]["unexpected"] and all(set(x) <= {"match"} for x in out["catalog"].values())
    out["ready_to_release_source_copy"] = out["content_matches"] and set(out["receipts"]) <= {"match"}
    return out
