"""Embedding near-duplicates: int8 tile products with rigorous error bounds, exact links.

* vectors are sorted once, by grid cells of their leading principal axes (fitted on a bounded
  sample for the ``FITTED`` most frequent lengths, fixed orthogonal ones for others; the axes
  decide the order only, never a link); equal vectors, which stand side by side then, become one
  with a count, so copies are never multiplied;
* the order is cut into blocks, written once to the shared folder; a task gets the names of two
  blocks and reads them there, so no vector is shuffled again, and disk grows with the vectors;
* vectors with a cosine of at least t differ by at most sqrt(2 - 2t) along orthogonal axes, so
  pairs of blocks, and of tiles of two blocks, whose boxes lie further apart are dropped;
* a tile is quantised to int8 with one scale; a vector x = sq + r has |r| = e known exactly,
  and <x, y> differs from the int8 product by at most e_x|s q_y| + |s q_x|e_y + e_x e_y.
  Only pairs that this bound leaves at or above the threshold are computed in double precision;
* a pair of blocks hands on, for each vector, the number of linked vectors, and the stars of its
  local components: rows, not pairs, whatever the size of a group of near copies.

The products grow with the square of the tiles that the boxes leave close (see the README).
A row finds its class by a digest of 160 bits of its vector. Cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different length do not link; rows of null vec_id
have no links, a null component and kept false; repeated rows are vectors of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatt.llm import runtime
from tidewatt.llm.components import connected_components, local_stars
from tidewatt.llm.token_files import _filesystem

THRESHOLD = 0.95
TILE = 2048
#: Vectors from which the axes of the order are fitted.
SAMPLE = 4096
AXES = 16
FITTED = 8
#: Blocks whose boxes a task of the join of boxes holds against all others.
_BOXES = 512
#: Bytes of a block's vectors at most, and of a task of the sort; blocks that a smaller table is cut into at least.
_BLOCK_BYTES, _TASK_BYTES = 32 << 20, 64 << 20
_BLOCKS = 16
#: Pairs of blocks of a task, and the columns that say where a block lies.
_PAIRS = 8
_PLACE = ("name", "at", "n", "wide")


def _valid(vector):
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """int8 values, their scale, and per vector the length of the rest and of the quantised vector."""
    scale = max(float(np.abs(unit).max()) / 127, 1e-300)
    q = np.rint(unit / scale).astype(np.int8)
    back = q * scale
    return q, scale, np.linalg.norm(unit - back, axis=1) * (1 + 1e-12), np.linalg.norm(back, axis=1)


def linked(left: tuple, right: tuple, threshold: float, rows: int = 1024):
    """Yields (i, j) of all pairs of unit vectors with a product of at least ``threshold``; a side is the vectors and what ``quantise`` gives for them."""
    x, qa, sa, ea, na = left
    y, qb, sb, eb, nb = right
    exact = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64  # whole numbers, without rounding
    fb = qb.T.astype(exact)
    slack = ea * nb.max() + na * eb.max() + ea * eb.max() + 1e-9
    bar = (np.floor((threshold - slack) / (sa * sb)) - 2).astype(exact)  # below what a cast could round up
    for at in range(0, len(x), rows):
        product = qa[at : at + rows].astype(exact) @ fb
        i, j = np.nonzero(product >= bar[at : at + rows, None])
        if not len(i):
            continue
        if 4 * len(i) > product.size:  # nearly all: as one product in double precision
            full = x[at : at + rows] @ y.T
            keep = full[i, j] >= threshold
        else:
            keep = np.concatenate([np.einsum("ij,ij->i", x[at + i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) >= threshold
        yield at + i[keep], j[keep]


def _axes(usable: DataFrame, dim: int) -> np.ndarray:
    rows = usable.where(F.size("vector") == dim).select("vector").limit(SAMPLE).collect()
    x = _unit(np.array([r[0] for r in rows], np.float64))
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1][:, :AXES]


def _axes_of(axes: dict[int, np.ndarray], dim: int) -> np.ndarray:
    found = axes.get(dim)
    return _fixed_axes(dim) if found is None else found


def _fixed_axes(dim: int) -> np.ndarray:
    """Orthogonal unit axes that depend on the length alone."""
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, min(dim, AXES))))[0]


def _matrices(batch: pa.RecordBatch):
    """(rows of the batch, their vectors as a matrix), a length at a time; no zero has a sign."""
    sizes = np.array([len(x) for x in batch.column("vector")], np.int64)
    for dim in np.unique(sizes).tolist():
        part = batch.filter(pa.array(sizes == dim))
        yield part, np.array(part.column("vector").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) + 0.0


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=20).digest()


def _keys(batches):
    """(vec_id, key) of each row."""
    for batch in batches:
        for part, x in _matrices(batch):
            yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), pa.array([_key(row.tobytes()) for row in x], pa.binary())], names=["vec_id", "key"])


def _cell(x: np.ndarray, axes: np.ndarray, width: float) -> np.ndarray:
    """The cell of each vector along the leading axes, in whole numbers that no order of a sum rounds: equal vectors have equal cells."""
    one = 2.0 ** min(18, (52 - x.shape[1].bit_length()) // 2)
    q = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * one)
    along = np.floor(q @ np.rint(axes[:, :8] * one) / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] / (one * width)).astype(np.int64)
    cell = np.zeros(len(x), np.int64)
    for k in range(along.shape[1]):
        cell = cell * 64 + np.clip(along[:, k] + 32, 0, 63)
    return cell


def _cells(axes: dict[int, np.ndarray], width: float):
    """(size, cell, key, first, n, vector bytes), a row for the copies in a batch: the order key is the cell of the leading axes."""

    def run(batches):
        for batch in batches:
            for part, x in _matrices(batch):
                dim = x.shape[1]
                place: dict[bytes, int] = {}
                at = np.array([place.setdefault(row.tobytes(), len(place)) for row in x], np.int64)
                first = np.full(len(place), np.iinfo(np.int64).max)
                np.minimum.at(first, at, part.column("vec_id").cast(pa.int64()).to_numpy())
                cell = _cell(np.frombuffer(b"".join(place), np.float64).reshape(-1, dim), _axes_of(axes, dim), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), dim, np.int64)), pa.array(cell), pa.array([_key(raw) for raw in place], pa.binary()), pa.array(first), pa.array(np.bincount(at).astype(np.int64)), pa.array(list(place), pa.binary())], names=["dim", "cell", "key", "first", "n", "raw"])

    return run


def _merged(table: pa.Table) -> pa.Table:
    """Sorted rows with one row for equal vectors."""
    raw = table.column("raw").to_pylist()
    heads = np.flatnonzero(np.array([True, *(a != b for a, b in zip(raw, raw[1:], strict=False))]))
    if len(heads) == len(raw):
        return table
    first = np.minimum.reduceat(table.column("first").to_numpy(), heads)
    n = np.add.reduceat(table.column("n").to_numpy(), heads)
    out = table.take(pa.array(heads))
    return out.set_column(out.schema.get_field_index("first"), "first", pa.array(first)).set_column(out.schema.get_field_index("n"), "n", pa.array(n))


def _blocks(axes: dict[int, np.ndarray], rows: int, folder: str):
    """Sorted rows of a task to blocks of ``rows`` vectors in one file of the attempt: (tile, dim, low, high, name, at, n, wide)."""

    def run(batches):
        from pyspark import TaskContext

        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        part, made, held = TaskContext.get().partitionId(), 0, []
        name, sink, end = f"{part}-{uuid.uuid4().hex}", None, 0
        box = pa.list_(pa.float64())
        types = [pa.int64(), pa.int64(), box, box, pa.string(), pa.int64(), pa.int64(), pa.int64()]

        def emit(table: pa.Table):
            nonlocal made, sink, end
            dim = table.column("dim")[0].as_py()
            x = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64).reshape(-1, dim)
            along = _unit(x) @ _axes_of(axes, dim)
            with np.errstate(over="ignore", under="ignore"):
                half = x.astype("<f4")
            wide = 4 if np.array_equal(half, x) else 8  # four bytes where they say the same
            if sink is None:
                sink = system.open_output_stream(f"{base}/{name}")
            row = [part << 24 | made, dim, along.min(axis=0).tolist(), along.max(axis=0).tolist(), name, end, len(x), wide]
            for piece in (table.column("first").to_numpy().astype("<i8"), table.column("n").to_numpy().astype("<i8"), half if wide == 4 else x.astype("<f8")):
                end += sink.write(piece.tobytes())
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["tile", "dim", "low", "high", "name", "at", "n", "wide"])

        def cut(table: pa.Table, last: bool):
            """Blocks of one length, whole ones only unless ``last``; the rest, and the last row, which may go on."""
            while table.num_rows:
                dims = table.column("dim").to_numpy()
                take = min(rows, int(np.searchsorted(dims, dims[0], side="right")))
                if take == table.num_rows and not last:
                    break
                yield emit(table.slice(0, take))
                table = table.slice(take)
            held[:] = [table] if table.num_rows else []

        try:
            out = []
            for batch in batches:
                if batch.num_rows:
                    held.append(pa.Table.from_batches([batch]))
                    if sum(t.num_rows for t in held) > rows or sum(t.nbytes for t in held) > _BLOCK_BYTES:
                        out += cut(_merged(pa.concat_tables(held)), last=False)
            if held:
                out += cut(_merged(pa.concat_tables(held)), last=True)
            if sink is not None:
                sink.close()
        except BaseException:
            if sink is not None:
                sink.close()
                system.delete_file(f"{base}/{name}")
            raise
        yield from out

    return run


def tile_pairs(tiles: DataFrame, threshold: float, count: int) -> DataFrame:
    """(a, b): pairs of ``tiles(tile, dim, low, high)`` that can hold a link by their boxes, each tile with itself
    included. Boxes are dealt to parts of ``_BOXES``, so that no task holds all pairs of a length."""
    salts = max(1, -(-count // _BOXES))
    left = tiles.select("dim", F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.pmod(F.xxhash64("tile"), F.lit(salts)).cast("int").alias("salt"))
    right = tiles.select("dim", F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    # Along each axis: the space between the two intervals, if any.
    after = F.zip_with("low_b", "high_a", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    before = F.zip_with("low_a", "high_b", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    gap = F.aggregate(F.zip_with(after, before, lambda x, y: (x + y) * (x + y)), F.lit(0.0), lambda s, x: s + x)
    return left.join(right, ["dim", "salt"]).where((F.col("a") <= F.col("b")) & (gap <= 2 - 2 * threshold + 1e-9)).select("a", "b")


def _compare(threshold: float, axes: dict[int, np.ndarray], tile: int, folder: str):
    """Rows (a, b, dim, and name, at, n, wide of both) sorted by pair to rows (id, links, least)."""
    far = 2 - 2 * threshold + 1e-9

    def load(system, base, dim, name, at, n, wide):
        with system.open_input_file(f"{base}/{name}") as file:
            file.seek(at)
            raw = file.read(n * (16 + dim * wide))
        ids, weights = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
        x = _unit(np.frombuffer(raw, f"<f{wide}", n * dim, 16 * n).reshape(n, dim).astype(np.float64))
        along = x @ _axes_of(axes, dim)
        tiles = []
        for k in range(0, n, tile):
            box = along[k : k + tile]
            tiles.append((k, box.min(axis=0), box.max(axis=0), (x[k : k + tile], *quantise(x[k : k + tile]))))
        return ids, weights, tiles

    def work(left, right):
        same = right is None
        ids, weights, tiles = left
        other, more, against = left if same else right
        n, shift = len(ids) + (0 if same else len(other)), 0 if same else len(ids)
        links, label = np.zeros(n, np.int64), np.arange(n)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def join():
            nonlocal label
            u, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            label = local_stars(np.concatenate([label[u], np.arange(n)]), np.concatenate([label[v], label]), n)

        for s, low, high, x in tiles:
            for t, lower, higher, y in against:
                if same and t < s:
                    continue
                gap = np.maximum(lower - high, 0) + np.maximum(low - higher, 0)
                if gap @ gap > far:
                    continue
                for i, j in linked(x, y, threshold):
                    i, j = i + s, j + t
                    if same and s == t:
                        i, j = i[i < j], j[i < j]
                    np.add.at(links, i, more[j])
                    np.add.at(links, j + shift, weights[i])
                    live = label[i] != label[j + shift]
                    if live.any():
                        waiting.append((i[live], j[live] + shift))
                        if sum(len(u) for u, _ in waiting) > n:
                            join()
        if waiting:
            join()
        nodes = ids if same else np.concatenate([ids, other])
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, label, nodes)
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links[hit]), pa.array(low[label][hit])], names=["id", "links", "least"])

    def run(batches):
        system, base = _filesystem(folder)
        of, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or of != row["a"]:
                    held = None
                    of, held = row["a"], load(system, base, row["dim"], *(row[f"{c}_a"] for c in _PLACE))
                yield work(held, None if row["a"] == row["b"] else load(system, base, row["dim"], *(row[f"{c}_b"] for c in _PLACE)))
        held = None
        runtime.give_back()

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0, and at most at 1")
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    good = F.col("vec_id").isNotNull() & _valid(F.col("vector"))
    usable = base.where(good)
    lengths, _ = runtime.materialize(usable.groupBy(F.size("vector").cast("long").alias("d")).count(), "vector-lengths")
    rows, size, longest = lengths.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("count"), F.sum(F.col("count") * F.col("d") * 8), F.max("d")))).first()
    axes = {r[0]: _axes(usable, r[0]) for r in lengths.orderBy(F.desc("count"), "d").limit(FITTED).collect()}
    width = float(np.sqrt(max(2 - 2 * threshold, 1e-6)))
    parts = runtime.shuffle_partitions(spark)
    # as many tiles in a block as its bytes allow, but enough blocks for all tasks of a small table
    block = tile * max(1, min(_BLOCK_BYTES // (tile * max(1, longest) * 8), -(-rows // tile) // _BLOCKS))
    folder = runtime.fresh_path(spark, "vector-blocks")
    cells = usable.mapInArrow(_cells(axes, width), "dim long, cell long, key binary, first long, n long, raw binary")
    # few enough parts for whole blocks, and as many as keep a part to a task's bytes
    wide = max(parts, -(-size // _TASK_BYTES))
    ordered = cells.repartitionByRange(max(1, min(wide, -(-rows // (2 * block)))), "dim", "cell", "key").sortWithinPartitions("dim", "cell", "key")
    blocks, listed = runtime.materialize(ordered.mapInArrow(_blocks(axes, block, folder), "tile long, dim long, low array<double>, high array<double>, name string, at long, n long, wide long"), "blocks")
    near, paired = runtime.materialize(tile_pairs(blocks.select("tile", "dim", "low", "high"), threshold, blocks.count()), "block-pairs")
    sides = [blocks.select(F.col("tile").alias(k), *(["dim"] if k == "a" else []), *(F.col(c).alias(f"{c}_{k}") for c in _PLACE)) for k in "ab"]
    work = near.join(sides[0], "a").join(sides[1], "b")
    n_pairs = near.count()
    dealt = work.repartitionByRange(max(1, min(n_pairs, max(4 * parts, -(-n_pairs // _PAIRS)))), "a", "b").sortWithinPartitions("a", "b")
    found, _ = runtime.materialize(dealt.mapInArrow(_compare(threshold, axes, tile, folder), "id long, links long, least long"), "vector-links")
    for path in (folder, listed, paired):
        runtime.remove(spark, path)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts_of = connected_components(found.select(F.col("id").alias("u"), F.col("least").alias("v")))
    members = usable.mapInArrow(_keys, "vec_id long, key binary")
    classes = members.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    named = (classes.join(counts, F.col("first") == F.col("id"), "left").drop("id")
             .join(parts_of, F.col("first") == F.col("node"), "left")
             .select("key", F.coalesce("component", "first").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")))
    rest = base.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("links"))
    out = members.join(named, "key", "left").select("vec_id", "component", "links").unionByName(rest)
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
