"""Plumbing shared by the text operators: the shared folder, written tables, Arrow maps.

Executors can be lost at any time, so nothing here keeps state on a machine's own disk:
intermediate tables go to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Text given to a kernel at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of a generation of a worker's cache, and what an entry takes beside its word and value.
CACHE_BYTES, ENTRY_BYTES = 40 << 20, 160

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidewatt-")
    return _own[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, each: int = 128 << 20) -> int:
    """Tasks for a shuffle of whole rows of ``df``: the session's number, more if Spark's estimate of the size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_partitions(df.sparkSession), min(-(-size // each), 1 << 20))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(base: str, taken: Iterable[str]) -> str:
    """``base``, or ``base_``, ``base__``...: a column name that no column has."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base += "_"
    return base


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of the column, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], Sequence]], fields: Sequence[T.StructField], *, keep: Sequence[str] = ("doc_id",), text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Add computed columns to ``keep``, slice by slice of whole texts.

    ``make()`` runs once a task and returns the kernel: it gets the list of texts (None
    for null) and returns one Arrow array or list per field. All other columns of ``df``
    are dropped before Python sees them, so clashing names can do no harm.
    """
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    names = [f.name for f in schema.fields]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(schema)]
        kernel = make()
        for batch in batches:
            for part in slices(batch, width, slice_bytes):
                out = kernel(part.column(width).to_pylist())
                columns = [part.column(i) for i in range(width)]
                columns += [x if isinstance(x, pa.Array) and x.type == t else pa.array(x, type=t) for x, t in zip(out, types[width:], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    picked = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).alias(free_name("text_in", keep)))
    return picked.mapInArrow(run, schema)


class WordCache:
    """What a worker has learnt about words: the last ``limit`` to twice as many bytes of them.

    Two generations: a word that is met again moves to the young one; when that is full, it
    becomes the old one, and what was old goes. So common words stay, and memory is bounded,
    by two generations and what one slice of text adds, however long words are.
    """

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.bytes = limit, 0
        self.young: dict = {}
        self.old: dict = {}

    def table(self, words: set, learn: Callable[[list], list]) -> dict:
        """Values of all ``words``; ``learn`` gives those of a list that are not known."""
        if self.bytes > self.limit:
            self.old, self.young, self.bytes = self.young, {}, 0
        young, old = self.young, self.old
        missing = words.difference(young)
        again = list(old.keys() & missing)
        unseen = list(missing.difference(again)) if again else list(missing)
        for some, values in ((again, [old[w] for w in again]), (unseen, learn(unseen) if unseen else [])):
            young.update(zip(some, values, strict=True))
            self.bytes += ENTRY_BYTES * len(some) + sum(map(len, some)) + sum(map(len, values))
        return young


_held: list = []


def hold(key: tuple, make: Callable[[], object]):
    """The object that ``make`` gives for ``key``: made once a worker, until it asks for another.

    A worker serves one kernel at a time, so what an earlier stage's kernel held goes first.
    """
    if not _held or _held[0] != key:
        _held.clear()
        give_back()
        _held[:] = [key, make()]
    return _held[1]


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
