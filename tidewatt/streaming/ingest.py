"""Ordered, idempotent ingest with Structured Streaming.

Batches of a micro-batch are applied in (source, sequence) order by the store's single writer.
Batches of points that follow each other are one manifest generation, with the commits and
receipts that they would have one by one; a batch with objects is one by itself. Spark may run a micro-batch again: its batches
are then exact replays and change nothing. A rejected batch leaves no trace but its outcome,
and later ones go on; a storage fault stops the query. No event-time watermark is used: late
points are always accepted and undo the rollups that they reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatt.errors import TidewattError
from tidewatt.sources import files, wire
from tidewatt.store import Commit, EngineStore

Outcome = dict


#: Batches of points that follow each other are committed together; fewer than this, one by one.
TOGETHER = 4


def apply_batches(store: EngineStore, batches: DataFrame) -> list[Outcome]:
    """Commit each row; one outcome a row: accepted, replayed, or the error that refused it.

    Rows are kept as a table while they are applied. The driver gets a head of each, in the order of the batches;
    runs of batches that are only points are committed together, from the table. Others, which may change the
    catalogue, come to the single writer one at a time, a partition of them in memory at most. So do all where
    space is guarded, which goes by what each commit has added.
    """
    if store.config.max_store_bytes is not None or store.config.min_free_bytes is not None:
        return [_applied(store, _plain(row)) for row in wire.ordered(batches).toLocalIterator()]
    stage = f"{store.root}/stage/{uuid.uuid4().hex}"
    try:
        batches.withColumn("frame", F.monotonically_increasing_id()).write.parquet(f"{stage}/frames")
        frames = store.spark.read.schema(T.StructType([*wire.BATCH.fields, T.StructField("frame", T.LongType())])).parquet(f"{stage}/frames")
        wire.heads(frames).write.parquet(f"{stage}/heads")
        order = ["source_id", "sequence", "commit_id", "frame"]
        heads = store.spark.read.parquet(f"{stage}/heads").orderBy(*order).collect()  # one small row an outcome
        runs = [list(run) for _, run in groupby(heads, key=lambda h: h["alone"])]
        alone = {h["frame"] for run in runs if run[0]["alone"] or len(run) < TOGETHER for h in run}
        if alone:
            named = F.broadcast(store.spark.createDataFrame([(k,) for k in alone], "frame long"))
            bodies = frames.join(named, "frame").orderBy(*order).drop("frame").toLocalIterator()
        outcomes = []
        for run in runs:
            if run[0]["frame"] in alone:
                outcomes += [_applied(store, _plain(next(bodies))) for _ in run]
            else:
                outcomes += [_outcome(h, result) for h, result in zip(run, store.commit_together(run, frames), strict=True)]
        return outcomes
    finally:
        files.delete(store.spark, stage)


def _applied(store: EngineStore, body: dict) -> Outcome:
    try:
        return _outcome(body, store.commit(wire.transaction(store.spark, body)))
    except TidewattError as error:
        if error.poisons:
            raise
        return _outcome(body, error)


def _outcome(head, result: Commit | TidewattError) -> Outcome:
    known = {"source_id": head["source_id"], "sequence": head["sequence"], "commit_id": head["commit_id"]}
    if isinstance(result, Commit):
        return {**known, "outcome": "replayed" if result.deduplicated else "accepted"}
    return {**known, "outcome": type(result).__name__, "detail": str(result)}


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def start_ingest(store: EngineStore, batches: DataFrame, checkpoint: str, on_outcomes: Callable[[int, list[Outcome]], None] | None = None, maintain_every: int | None = None, maintain_after: int | None = None,
                 clock: Callable[[], int] | None = None, seal_segments: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Run the stream of batches into the store.

    Rollups are maintained at ``clock()``: every ``maintain_every`` micro-batches, and after the first
    micro-batch that ends ``maintain_after`` microseconds or more after the last time. With
    ``seal_segments``, live files are sealed once there are that many.
    """
    last = clock() if clock else 0

    def each(frame: DataFrame, number: int) -> None:
        outcomes = apply_batches(store, frame)
        store.flush()
        if on_outcomes:
            on_outcomes(number, outcomes)
        nonlocal last
        if clock:
            now = clock()
            if maintain_every and number % maintain_every == maintain_every - 1 or maintain_after and now - last >= maintain_after:
                store.maintain(now)
                last = now
        if seal_segments and sum(not p["sealed"] for p in store.manifest["points"]) >= seal_segments:
            store.seal()

    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
