"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, components.

Fingerprints. A-Z in lower case, words between ASCII white space, shingles of four words
(fewer words: all of them; none: fingerprint zero); a bit is 1 if over half of the shingles'
XXH64 (seed 42), repeats included, have it.

``near_duplicates`` links fingerprints at ``max_diff`` or fewer differing bits, exactly: two that
differ in at most d bits agree on one of d + 1 blocks, and the rest of the bits on one of d + 1
sub-blocks: (d + 1)^2 keys each, whatever the table's size.

``near_copies`` links copies with more edits, down to shingle similarity ``SIMILARITY``, where a
single 64-bit fingerprint differs in a sixth of its bits and no block of it is sure to agree. A
signature holds ``CHECK_WORDS + KEY_WORDS`` independent fingerprints of the same shingles: two
texts link if at most ``REACH`` of the check words' bits differ and one of ``key_count`` keys,
each a draw of the key words' bits, agrees. A key has as many bits as the number of different
signatures, so a row meets about one stranger a key at every size, and there are as many keys
as find ``RECALL`` of the pairs at ``SIMILARITY`` (more of closer ones).

The search is the same for both:

* equal fingerprints (signatures) are one class before anything is compared;
* rows are range-partitioned and sorted by (key, Gray rank), so that a hot key is spread over
  as many tasks as its rows need. In the order of the Gray code neighbours differ in few bits,
  so runs of rows share most bits: a node keeps the bits its rows have in common, its children
  only the further ones, a search adds up differences from the top and drops a whole node as
  soon as they pass the radius, or if all its rows are in the query's component already;
* a task reads its rows in pieces of about ``CHUNK``; a key that goes on in another piece hands
  its runs on as blocks (a fingerprint list with its common bits). Pairs of blocks are pruned by
  their common bits before any list is moved, then compared.

Tasks hand on stars (member, smallest of its local component), not pairs, so a group of
copies costs a row a member. ``components.connected_components`` joins the stars.

Cases: null or blank text has fingerprint zero, linked like any other; repeated rows are in
the class of their fingerprint (a doc_id with two texts has a row for each); rows of null doc_id are returned with their
fingerprint and a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatt.llm import runtime
from tidewatt.llm.components import connected_components, local_stars

MAX_DIFF = 4
SHINGLE = 4
FANOUT = 16
BLOCK = 2048
#: Rows that a task searches at once.
CHUNK = 1 << 17
#: Bytes of shuffled rows a task is given.
_TASK_BYTES = 16 << 20
_PAIRS = 1 << 20

#: ``near_copies``: fingerprints that decide, fingerprints that keys are drawn from, differing bits of the
#: former (of 256) up to which texts link, the similarity that keys are made for, and the share of its pairs they find.
CHECK_WORDS, KEY_WORDS, REACH, SIMILARITY, RECALL = 4, 8, 48, 0.8, 0.97


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def signature(text: str | None, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """``words`` independent fingerprints of one text; the first is that of the plain XXH64 values."""
    hashes = _hashes(text, shingle)
    if not len(hashes):
        return np.zeros(words, np.uint64)
    ones = np.zeros(64 * words, np.int64)
    odd = (2 * np.arange(words, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for at in range(0, len(hashes), 255):  # as many rows as a byte can count
        part = hashes[at : at + 255, None]
        if words > 1:
            mixed = part * odd
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            mixed[:, :1] = part
            part = mixed
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    return int(signature(text, shingle).view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit)."""
    return runtime.map_texts(docs, lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], [T.StructField("fp", T.LongType())])


def signatures(docs: DataFrame, shingle: int, words: int, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and signature (the fingerprints, eight bytes each)."""
    return runtime.map_texts(docs, lambda: lambda texts: [[signature(t, shingle, words).tobytes() for t in texts]], [T.StructField("signature", T.BinaryType())], keep=keep)


def _field(x: Column, high: int, width: int) -> Column:
    """``width`` bits of ``x`` below bit ``high``."""
    return F.shiftrightunsigned(x, high - width).bitwiseAND((1 << width) - 1)


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(high, width) of ``parts`` nearly equal fields of ``bits`` bits, from the top."""
    out, high = [], bits
    for k in range(parts):
        width = -(-high // (parts - k))
        out.append((high, width))
        high -= width
    return out


def index_keys(fp: Column, max_diff: int = MAX_DIFF) -> Column:
    """The (max_diff + 1)^2 keys: block, its value, sub-block of the other bits, its value."""
    parts = max_diff + 1
    keys = []
    for k, (high, width) in enumerate(_cuts(64, parts)):
        turn = 64 - high  # the block comes to the top, the other bits follow in a circle
        turned = fp if not turn else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn))
        block = _field(turned, 64, width)
        for j, (top, sub) in enumerate(_cuts(64 - width, parts)):
            keys.append(F.lit((k * parts + j) << 40).bitwiseOR(F.shiftleft(block, 20)).bitwiseOR(_field(turned, top, sub)))
    return F.array(*keys)


def gray_rank(fp: Column) -> Column:
    """The place of ``fp`` in the reflected Gray code's order (as a signed integer)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _gray_ranks(fps: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        fps = fps ^ (fps >> np.uint64(shift))
    return fps


def _of_gray(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def agreement(similarity: float) -> float:
    """How likely a bit is to agree for two texts of that Jaccard similarity of shingles."""
    return 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def key_bits(classes: int) -> int:
    """Bits of a key: as many as number the classes."""
    return min(40, max(8, (max(classes, 1) - 1).bit_length()))


def key_count(bits: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    return max(1, math.ceil(-math.log(1 - recall) / agreement(similarity) ** bits))


def key_places(bits: int, count: int) -> np.ndarray:
    """For each key its places among the key words' bits: cuts of fixed shuffles, so that keys share few of them."""
    rng = np.random.default_rng(42)
    total, rows = 64 * KEY_WORDS, []
    while len(rows) < count:
        places = rng.permutation(total)
        rows += [places[k * bits : (k + 1) * bits] for k in range(total // bits)]
    return np.array(rows[:count])


def wide_keys(signs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(rows, keys): the number of the key above bit 40, its value below."""
    bits = np.unpackbits(np.ascontiguousarray(signs[:, CHECK_WORDS:]).view(np.uint8), axis=1, bitorder="little")
    out = np.empty((len(signs), len(places)), np.int64)
    for k, at in enumerate(places):
        value = np.zeros(len(signs), np.int64)
        for j in at:
            value = value << 1 | bits[:, j]
        out[:, k] = value | k << 40
    return out


def _near(sign: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of rows differ in at most ``radius`` bits."""
    return np.bitwise_count(sign[a] ^ sign[b]).sum(axis=1, dtype=np.int64) <= radius


def _common(sign: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run: mask of the bits its rows share, and their values."""
    ones = np.bitwise_and.reduceat(sign, starts, axis=0)
    some = np.bitwise_or.reduceat(sign, starts, axis=0)
    return ~(ones ^ some), ones


class GrayIndex:
    """The hierarchical index of one Gray-ordered list of different fingerprints (rows of one or more words).

    ``label``: components that are known; a node whose rows are all in one has that, else -1.
    """

    def __init__(self, sign: np.ndarray, label: np.ndarray | None = None, fanout: int = FANOUT):
        self.sign, self.fanout = sign, fanout
        self.label = np.arange(len(sign)) if label is None else label
        self.levels: list[tuple[np.ndarray, ...]] = []  # from the leaves up: masks, values, labels
        step = fanout
        while True:
            starts = np.arange(0, len(sign), step)
            low, high = np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts)
            self.levels.append((*_common(sign, starts), np.where(low == high, low, -1)))
            if len(starts) == 1:
                break
            step *= fanout

    def search(self, rows: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (row of ``rows``, row) of pairs at ``radius`` or fewer bits that are of different components."""
        width = max(1, _PAIRS // (64 * self.fanout))
        for at in range(0, len(rows), width):
            q = rows[at : at + width]
            node = np.zeros(len(q), np.int64)
            so_far = np.zeros(len(q), np.int64)
            known = np.zeros((len(q), self.sign.shape[1]), np.uint64)
            for depth in range(len(self.levels) - 1, -1, -1):
                masks, values, labels = self.levels[depth]
                so_far = so_far + np.bitwise_count((self.sign[q] ^ values[node]) & masks[node] & ~known).sum(axis=1, dtype=np.int64)
                live = (so_far <= radius) & (labels[node] != self.label[q])
                q, node, so_far = q[live], node[live], so_far[live]
                if not len(q):
                    break
                known = masks[node]
                count = len(self.levels[depth - 1][0]) if depth else len(self.sign)
                first = node * self.fanout
                n = np.minimum(self.fanout, count - first)
                each = np.repeat(np.arange(len(q)), n)
                child = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                q, node, so_far, known = q[each], child, so_far[each], known[each]
            if not len(q):
                continue
            rest = np.bitwise_count((self.sign[q] ^ self.sign[node]) & ~known).sum(axis=1, dtype=np.int64)
            hit = (so_far + rest <= radius) & (self.label[q] != self.label[node])
            yield q[hit], node[hit]


#: Rows of a key whose neighbourhoods are found before the index is searched.
_LEADERS = 8


def _components(sign: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row of each row's component, among Gray-ordered rows of one key.

    The neighbourhoods of a few rows come first: they join a dense group in one step each. A link
    between two components has an end outside the largest, so only rows outside it are searched.
    """
    n = len(sign)
    label, rest = np.arange(n), np.arange(n)
    us, vs = [], []
    for _ in range(_LEADERS):
        if len(rest) < 2:
            break
        near = np.bitwise_count(sign ^ sign[rest[0]]).sum(axis=1, dtype=np.int64) <= radius
        us.append(np.flatnonzero(near))
        vs.append(np.full(len(us[-1]), rest[0]))
        near[rest[0]] = True
        rest = rest[~near[rest]]
    if us:
        label = local_stars(np.concatenate(us), np.concatenate(vs), n)
    outside = np.flatnonzero(label != np.bincount(label).argmax())
    found = label
    for q, node in GrayIndex(sign, found).search(outside, radius):
        a, b = label[q], label[node]
        live = a != b
        if live.any():
            label = local_stars(np.concatenate([a[live], np.arange(n)]), np.concatenate([b[live], label]), n)
    return label


def _edges(label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest of its component)."""
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    low = low[label]
    moved = low != ids
    return ids[moved], low[moved]


def _chunks(batches, size: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Pieces of rows sorted by key: (piece, it begins in the middle of a key, it ends there).

    A piece ends with a key, unless one key fills it. At a task's ends the key may go on in another task.
    """
    held: list[pa.Table] = []
    n, open_start = 0, True

    def cut(last: bool):
        nonlocal n, open_start
        table = pa.concat_tables(held).combine_chunks()
        key = table.column("key").to_numpy()
        end = len(key) if last else int(np.searchsorted(key, key[-1]))
        whole = end > 0
        end = end or len(key)
        piece = table.slice(0, end), open_start, last or not whole
        held[:] = [table.slice(end)] if end < len(key) else []
        n, open_start = len(key) - end, not whole
        return piece

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= size:
                yield cut(False)
    if n:
        yield cut(True)


_LINKS = "u long, v long, key long, part long, block long, common array<long>, shared array<long>, nodes binary, signs binary"
_LINK_TYPES = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2


def _search_partition(words: int, radius: int, chunk: int, block: int):
    """Over rows (key, gray, further words..., node) sorted by key and Gray rank: edges, and blocks of
    keys that go on in another piece."""
    names = [x.split()[0] for x in _LINKS.split(", ")]

    def edges(u, v):
        for at in range(0, len(u), 1 << 16):
            m = min(1 << 16, len(u) - at)
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + m]), pa.array(v[at : at + m]), *[pa.nulls(m, t) for t in _LINK_TYPES[2:]]], names=names)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, (table, open_start, open_end) in enumerate(_chunks(batches, chunk)):
            part = task << 24 | number
            key = table.column("key").to_numpy()
            sign = np.empty((len(key), words), np.uint64)
            sign[:, 0] = _of_gray(table.column("gray").to_numpy().view(np.uint64))
            for w in range(1, words):
                sign[:, w] = table.column(f"c{w}").to_numpy().view(np.uint64)
            node = table.column("node").to_numpy() if "node" in table.column_names else sign[:, 0].view(np.int64)
            del table
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            sizes = ends - starts
            small = np.repeat(sizes <= FANOUT, sizes)  # one leaf each: rows are compared at every distance at once
            a, b = [], []
            for shift in range(1, FANOUT):
                same = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
                if not len(same):
                    break
                near = np.concatenate([same[k : k + _PAIRS][_near(sign, same[k : k + _PAIRS], same[k : k + _PAIRS] + shift, radius)] for k in range(0, len(same), _PAIRS)])
                a.append(near)
                b.append(near + shift)
            if a:
                yield from edges(*_edges(local_stars(np.concatenate(a), np.concatenate(b), len(key)), node))
            for s, e in zip(starts[sizes > FANOUT].tolist(), ends[sizes > FANOUT].tolist(), strict=True):
                yield from edges(*_edges(_components(sign[s:e], radius), node[s:e]))
            for k in sorted({0 if open_start else len(starts) - 1, len(starts) - 1 if open_end else 0}) if open_start or open_end else ():
                s, e = int(starts[k]), int(ends[k])
                for n, at in enumerate(range(s, e, block)):
                    own = sign[at : min(e, at + block)]
                    shared, common = _common(own, np.zeros(1, np.int64))
                    row = [None, None, int(key[s]), part, n, common[0].view(np.int64).tolist(), shared[0].view(np.int64).tolist(), node[at : min(e, at + block)].tobytes(), own.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _LINK_TYPES, strict=True)], names=names)

    return run


def _search_blocks(words: int, radius: int):
    """Over pairs of blocks of one key: the stars of their union."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                sign = np.concatenate([np.frombuffer(row[x], np.uint64).reshape(-1, words) for x in ("signs", "other_signs")])
                node = np.concatenate([np.frombuffer(row[x], np.int64) for x in ("nodes", "other_nodes")])
                order = np.argsort(_gray_ranks(sign[:, 0]), kind="stable")
                u, v = _edges(_components(sign[order], radius), node[order])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _apart(a: str, b: str, shared_a: str, shared_b: str) -> Column:
    """Bits that two blocks surely differ in."""
    both = F.zip_with(shared_a, shared_b, lambda x, y: x.bitwiseAND(y))
    differ = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    return F.aggregate(F.zip_with(both, differ, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def _links(keyed: DataFrame, rows: int, words: int, radius: int) -> DataFrame:
    """``keyed(key, gray, c1.., [node])`` of about ``rows`` rows to edges (u, v) that connect all rows of a key
    at ``radius`` or fewer bits."""
    parts = max(1, -(-rows * 8 * (len(keyed.columns)) // _TASK_BYTES))
    ordered = keyed.repartitionByRange(parts, "key", "gray").sortWithinPartitions("key", "gray")
    found, _ = runtime.materialize(ordered.mapInArrow(_search_partition(words, radius, CHUNK, BLOCK), _LINKS), "links")
    inside = found.where("u is not null").select("u", "v")
    blocks = found.where("u is null").drop("u", "v")
    many = blocks.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    heads = blocks.select("key", "part", "block", "common", "shared").join(many, "key")
    others = heads.select("key", *[F.col(c).alias(f"other_{c}") for c in ("part", "block", "common", "shared")])
    close = heads.join(others, "key").where(F.col("part") < F.col("other_part")).where(_apart("common", "other_common", "shared", "other_shared") <= radius)
    lists = blocks.select("key", "part", "block", "nodes", "signs")
    pairs = close.select("key", "part", "block", "other_part", "other_block").join(lists, ["key", "part", "block"])
    pairs = pairs.join(lists.select("key", *[F.col(c).alias(f"other_{c}") for c in ("part", "block", "nodes", "signs")]), ["key", "other_part", "other_block"])
    return inside.unionByName(pairs.select("nodes", "signs", "other_nodes", "other_signs").mapInArrow(_search_blocks(words, radius), "u long, v long"))


def near_links(classes: DataFrame, max_diff: int = MAX_DIFF, rows: int | None = None) -> DataFrame:
    """``classes(fp)``, each fingerprint once, to edges (u, v) of fingerprints that connect all those at
    ``max_diff`` or fewer differing bits."""
    if max_diff < 0:
        raise ValueError("max_diff is negative")
    n = classes.count() if rows is None else rows
    keyed = classes.select(F.explode(index_keys(F.col("fp"), max_diff)).alias("key"), gray_rank(F.col("fp")).alias("gray"))
    return _links(keyed, n * (max_diff + 1) ** 2, 1, max_diff)


def copy_links(classes: DataFrame, rows: int | None = None, reach: int = REACH) -> DataFrame:
    """``classes(node, signature)``, each signature once, to edges (u, v) of nodes that connect all those that
    share a key and differ in at most ``reach`` bits of the check words."""
    n = classes.count() if rows is None else rows
    places = key_places(key_bits(n), key_count(key_bits(n)))
    names = ["key", "gray", *[f"c{w}" for w in range(1, CHECK_WORDS)], "node"]

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sign = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint64).reshape(-1, CHECK_WORDS + KEY_WORDS)
                key = wide_keys(sign, places)
                columns = [key.ravel(), np.repeat(_gray_ranks(sign[:, 0]).view(np.int64), len(places))]
                columns += [np.repeat(sign[:, w].view(np.int64), len(places)) for w in range(1, CHECK_WORDS)]
                columns.append(np.repeat(part.column("node").to_numpy(), len(places)))
                for a in range(0, len(columns[0]), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 14)]) for c in columns], names=names)

    keyed = classes.select("node", "signature").mapInArrow(spread, ", ".join(f"{x} long" for x in names))
    return _links(keyed, n * len(places), CHECK_WORDS, reach)


#: Parts that the members of a component are dealt to when they look up its smallest document.
SALTS = 16


def _rooted(classes: DataFrame, edges: DataFrame, node: str, own: list[str]) -> DataFrame:
    """``own`` columns of the classes and component_id, the smallest ``first`` of the component."""
    found = classes.join(connected_components(edges).withColumnRenamed("node", node), node, "left")
    alone = found.where("component is null").select(*own, F.col("first").alias("component_id"))
    linked = found.where("component is not null")
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    dealt = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int")).join(dealt, ["component", "salt"])
    return named.select(*own, "component_id").unionByName(alone)


def near_duplicates(docs: DataFrame, max_diff: int = MAX_DIFF, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints, _ = runtime.materialize(fingerprints(docs, shingle), "fingerprints")
    classes, _ = runtime.materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    named = _rooted(classes, near_links(classes.select("fp"), max_diff), "fp", ["fp"])
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_copies(docs: DataFrame, shingle: int = 5, reach: int = REACH, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (doc_id among them) and component_id under the wider
    rule (see the module's head). No column of ``keep`` may be named signature or component_id."""
    prints, _ = runtime.materialize(signatures(docs, shingle, CHECK_WORDS + KEY_WORDS, keep), "signatures")
    grouped = prints.where("doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("first"))
    classes, _ = runtime.materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    named = _rooted(classes, copy_links(classes, reach=reach), "node", ["signature"])
    out = prints.join(named, "signature", "left")
    return out.select(*[F.col(runtime.quoted(c)) for c in keep], F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
