"""Ingest frames: one JSON text a message, with a checksum and hard bounds.

``{"magic", "version", "kind", "crc", "body"}``; the checksum covers the body's canonical
text. Kinds: CommitBatch, Hello, Flush, Health, Ack, Error. Batches also come as rows of a
table (``BATCH``), which is what streams read.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewatt import schemas as S
from tidewatt.errors import InvalidArgument, LimitError, ModelError
from tidewatt.functions import finite
from tidewatt.store import Transaction

# Bounds of a frame.
MAX_FRAME_BYTES = 4 << 20
MAX_POINTS = MAX_METADATA = 16_384
MAGIC, VERSION = "TWIN", 1
KINDS = ("CommitBatch", "Hello", "Flush", "Health", "Ack", "Error")
#: Upserts of a batch come in this order, points last.
ORDER = ("entities", "relations", "series", "runs", "plans")

_POINT = T.StructType([f for f in S.POINTS.fields if f.name != "append_seq"])
BATCH = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("commit_id", T.StringType()),
                      *[T.StructField(k, T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in S.CATALOG[k].fields]))) for k in ORDER], T.StructField("points", T.ArrayType(_POINT))])


def encode(kind: str, body: dict) -> bytes:
    if kind not in KINDS:
        raise InvalidArgument(f"unknown kind {kind}")
    if kind == "CommitBatch":
        check_batch(body)
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), allow_nan=False)
    raw = json.dumps({"magic": MAGIC, "version": VERSION, "kind": kind, "crc": zlib.crc32(text.encode()), "body": text}).encode()
    if len(raw) > MAX_FRAME_BYTES:
        raise LimitError(f"a frame of more than {MAX_FRAME_BYTES} bytes")
    return raw


def decode(raw: bytes) -> tuple[str, dict]:
    if len(raw) > MAX_FRAME_BYTES:
        raise LimitError(f"a frame of more than {MAX_FRAME_BYTES} bytes")
    try:
        frame = json.loads(raw)
        kind, text = frame["kind"], frame["body"]
        if frame["magic"] != MAGIC or frame["version"] != VERSION or kind not in KINDS or zlib.crc32(text.encode()) != frame["crc"]:
            raise ValueError("header or checksum")
        body = json.loads(text, object_pairs_hook=_sorted_unique)
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise InvalidArgument(f"not a frame: {error}") from None
    if kind == "CommitBatch":
        check_batch(body)
    return kind, body


def _sorted_unique(pairs):
    keys = [k for k, _ in pairs]
    if any(a >= b for a, b in zip(keys, keys[1:], strict=False)):
        raise ValueError("keys are not strictly sorted")
    return dict(pairs)


def check_batch(body: dict) -> None:
    """Rules of a batch that need nothing but itself."""
    if not body.get("source_id") or body["source_id"] == S.ZERO_ID:
        raise InvalidArgument("source zero is reserved")
    points = body.get("points") or []
    metadata = sum(len(body.get(k) or []) for k in ORDER)
    if len(points) > MAX_POINTS or metadata > MAX_METADATA:
        raise LimitError("too many points or objects in a batch")
    if not points and not metadata:
        raise InvalidArgument("an empty batch")
    for p in points:
        if not p["series_id"] or p["valid_time_end"] < p["valid_time"] or not math.isfinite(p["value"]):
            raise ModelError(f"invalid point of series {p['series_id']}")


def transaction(spark: SparkSession, body: dict) -> Transaction:
    """A batch as a transaction, its points numbered in the order given."""
    check_batch(body)
    tx = Transaction().with_ingress_identity(body["source_id"], body["sequence"], body["commit_id"])
    for kind in ORDER:
        if body.get(kind):
            tx.upsert(kind, *body[kind])
    if body.get("points"):
        rows = [tuple(p[c] for c in S.POINT_IDENTITY) + (k,) for k, p in enumerate(body["points"])]
        tx.append_points(spark.createDataFrame(rows, S.POINTS))
    return tx


def read_batches(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Batches from a folder of JSON lines, as a table or as a stream."""
    if not stream:
        return spark.read.schema(BATCH).json(path)
    reader = spark.readStream.schema(BATCH)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def heads(frames: DataFrame) -> DataFrame:
    """A row a batch, computed where the batch lies: its identity, points, bytes and digest of the points (as
    ``EngineStore`` takes them of a transaction), the error of ``check_batch`` if only points matter for it, and
    ``alone``: that it has objects or lacks a value, so that it has to be looked at by itself."""
    points = F.col("points")
    n = F.when(points.isNull(), 0).otherwise(F.size(points))
    metadata = reduce(lambda a, b: a + b, [F.when(F.col(k).isNull(), 0).otherwise(F.size(k)) for k in ORDER])
    lacks = F.exists(points, lambda x: reduce(lambda a, b: a | b, [x[c].isNull() for c in S.POINT_IDENTITY]))
    bad = F.get(F.filter(points, lambda x: (x["series_id"] == 0) | (x["valid_time_end"] < x["valid_time"]) | ~finite(x["value"])), F.lit(0))
    texts = F.transform(points, lambda x, k: F.to_json(F.struct(*[(k if c == "append_seq" else x[c]).cast("string") for c in sorted(S.POINT_FIELDS)])))  # without names, as the store's own
    source = F.col("source_id")

    def error(kind, detail):
        return F.struct(F.lit(kind.__name__).alias("kind"), detail.alias("detail"))

    refusal = (
        F.when(source.isNull() | (source == "") | (source == S.ZERO_ID), error(InvalidArgument, F.lit("source zero is reserved")))
        .when(n > MAX_POINTS, error(LimitError, F.lit("too many points or objects in a batch"))).when(n == 0, error(InvalidArgument, F.lit("an empty batch")))
        .when(bad.isNotNull(), error(ModelError, F.concat(F.lit("invalid point of series "), bad["series_id"].cast("string")))))
    own = frames.select(*[c for c in frames.columns if c not in (*ORDER, "points")], n.cast("long").alias("n"), refusal.alias("refusal"), texts.alias("texts"),
                        (F.coalesce(lacks, F.lit(False)) | (metadata > 0) | F.col("sequence").isNull() | F.col("commit_id").isNull()).alias("alone"))
    digest = F.sha2(F.array_join(F.sort_array(F.transform("texts", lambda j: F.sha2(j, 256))), ""), 256)
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda a, j: a + F.length(j))
    return own.select("*", F.coalesce(size, F.lit(0)).alias("size"), digest.alias("digest")).drop("texts")


def ordered(batches: DataFrame) -> DataFrame:
    return batches.orderBy("source_id", "sequence", F.col("commit_id"))
