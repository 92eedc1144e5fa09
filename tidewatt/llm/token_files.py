"""Token-id files: fixed-width bit packing with block offsets and a document table.

One shard file holds a contiguous range of doc_id, ascending:

    magic "TWTOKEN1" | u32 bits per id | u32 ids per block | u32 vocabulary | u32 zero
    blocks: ids packed low bit first, ``bits`` bits each, padded to a whole byte
    u64 offset of each block, and of the end of the last one
    i64 doc_id of each document | u64 first id of each document, and the end of the last one
    u64 blocks | u64 documents | u64 ids | magic

A block's place in the file is one lookup, so any id range is read without the rest.

Cases: null text is an empty text; an empty text still gets the end id; repeated rows are
documents of their own, one after the other; an empty table gives no shard and an empty
result; rows of null doc_id come first (all nulls lead) and are stored with the smallest
64-bit integer as their id, read back as null; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt.llm import runtime
from tidewatt.llm.encoders import word_encoder

MAGIC = b"TWTOKEN1"
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 25
NULL_ID = -(1 << 63)
_HEADER = struct.Struct("<8s4I")
_TRAILER = struct.Struct("<3Q8s")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, low bit first, ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from index ``first`` of a packed block, by unaligned 64-bit loads."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
    windows = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at = (np.arange(first, first + count, dtype=np.int64)) * bits
    return ((windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class ShardWriter:
    """Streams documents into one shard; holds a block and the document table in memory."""

    def __init__(self, sink, vocabulary: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits_for(vocabulary), block_ids
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self.offsets, self.at = [_HEADER.size], _HEADER.size
        self.docs: list[int] = []
        self.starts: list[int] = []
        sink.write(_HEADER.pack(MAGIC, self.bits, block_ids, vocabulary, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block_ids:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        end = len(ids) - len(ids) % self.block_ids if whole else len(ids)
        for a in range(0, end, self.block_ids):
            raw = pack(ids[a : a + self.block_ids], self.bits)
            self.sink.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.pending, self.n_pending = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(whole=False)
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(np.array(self.docs, "<i8").tobytes())
        self.sink.write(np.array([*self.starts, self.n_ids], "<u8").tobytes())
        self.sink.write(_TRAILER.pack(len(self.offsets) - 1, len(self.docs), self.n_ids, MAGIC))
        self.sink.close()


class ShardReader:
    """Random access to one shard: reads the tables once, then only the blocks asked for."""

    def __init__(self, file):
        self.file, size = file, file.size()
        magic, self.bits, self.block_ids, self.vocabulary, _ = _HEADER.unpack(self._read(0, _HEADER.size))
        blocks, docs, self.n_ids, tail = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a token shard")
        at = size - _TRAILER.size - 8 * (blocks + 1 + docs + docs + 1)
        raw = self._read(at, size - _TRAILER.size - at)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 8 * (blocks + 1))
        self.starts = np.frombuffer(raw, "<u8", docs + 1, 8 * (blocks + 1 + docs)).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` (exclusive) of the shard."""
        parts = []
        while first < end:
            block = first // self.block_ids
            low = block * self.block_ids
            stop = min(end, low + self.block_ids)
            raw = self._read(int(self.offsets[block]), int(self.offsets[block + 1] - self.offsets[block]))
            parts.append(unpack(raw, self.bits, stop - first, first - low))
            first = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of all documents; a block is read and unpacked once."""
        held, low = np.zeros(0, np.uint32), 0
        for k, doc in enumerate(self.doc_ids.tolist()):
            a, b = int(self.starts[k]), int(self.starts[k + 1])
            if b > low + len(held):
                keep = held[a - low :] if a < low + len(held) else np.zeros(0, np.uint32)
                have = low + len(held)
                top = min(self.n_ids, (b - 1) // self.block_ids * self.block_ids + self.block_ids)
                held, low = np.concatenate([keep, self.ids(max(a, have), top)]), a
            yield (None if doc == NULL_ID else doc), a, held[a - low : b - low]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(system, temp: str, target: str) -> None:
    """Rename a finished file, on systems too whose rename does not replace."""
    found = system.get_file_info(target)
    if found.is_file and found.size == system.get_file_info(temp).size:
        system.delete_file(temp)
        return
    if found.is_file:
        system.delete_file(target)
    system.move(temp, target)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> list[dict]:
    """Encode and store ``docs`` in ascending doc_id order; returns the manifest, a row a shard.

    One range shuffle. A shard is written under a name of the attempt and then renamed. If an earlier
    or speculative attempt of the task has left a shard of that size, the file stays as it is: attempts write
    the same bytes. What an attempt that fails has written goes with it.
    """

    def run(batches):
        from pyspark import TaskContext

        encoder = word_encoder(tokenizer)
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        writer = temp = None
        shard = 0

        def done():
            writer.close()
            name = f"shard-{part:07d}-{shard:04d}.twt"
            publish(system, temp, f"{base}/{name}")
            ids = writer.docs
            return {"name": name, "part": part, "shard": shard, "first_doc": ids[0], "n_docs": len(ids), "n_ids": writer.n_ids}

        rows = []
        try:
            for batch in batches:
                for piece in runtime.slices(batch, 1):
                    for doc, raw in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                        if writer is None:
                            temp = f"{base}/_{part}-{shard}-{uuid.uuid4().hex}"
                            writer = ShardWriter(system.open_output_stream(temp), encoder.vocabulary)
                        writer.add(doc, np.concatenate([np.frombuffer(raw, "<u4"), end]))
                        if writer.n_ids >= shard_ids:
                            rows.append(done())
                            writer, shard = None, shard + 1
            if writer is not None:
                rows.append(done())
                writer = None
        except BaseException:
            if writer is not None:
                writer.sink.close()
                if system.get_file_info(temp).is_file:
                    system.delete_file(temp)
            raise
        runtime.give_back()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("name", pa.string()), ("part", pa.int64()), ("shard", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    picked = docs.select("doc_id", "text")
    ordered = picked.repartitionByRange(runtime.tasks_for(picked), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(run, "name string, part long, shard long, first_doc long, n_docs long, n_ids long").collect()
    rows = sorted((r.asDict() for r in manifest), key=lambda r: (r["part"], r["shard"]))
    start = 0
    for row in rows:  # a row a shard of up to 32 million ids: a megabyte of rows is a trillion ids
        row["start"], start = start, start + row["n_ids"]
    return rows


def read_documents(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """Per document from the files alone: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches):
        system, base = _filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{base}/{name}") as file:
                    out = [(doc, first + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, a, ids in ShardReader(file).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame([(r["name"], r["start"]) for r in manifest], "name string, start long")
    spread = shards.repartition(min(len(manifest), 4 * runtime.shuffle_partitions(spark)), F.col("name"))
    return spread.mapInArrow(run, schema)
