"""Best-fit packing by the linear grouping scheme, planned on the histogram of lengths.

The plan needs only how many pieces have each length: at most ``capacity`` numbers, however
many documents there are. It is made on the driver in four steps:

1. long pieces, in descending order, are cut into groups of equal cardinality, and each
   length is rounded up to the largest of its group: few sizes remain;
2. the fewest sequences for these sizes: the linear program over configurations (how many
   pieces of each size share a sequence) by column generation, counts rounded down;
3. actual pieces take the slots: the longest left that is no longer than the slot's size, and
   in a sequence's last slot the longest that fits, which uses up what rounding up had added
   (what is left over is never longer than planned);
4. everything else, longest first, goes where it leaves the least room (best fit), into a
   new sequence only if no room is left.

Sequences with the same content are one entry with a count, so each step's work depends on
the number of different lengths. Executors then look up (length, rank within that length).

Cases: null text is empty; an empty text still holds its end id; repeated rows are pieces of
their own; an empty table gives no rows; null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatt.llm import runtime
from tidewatt.llm.encoders import word_encoder

CAPACITY = 2048
#: (groups, share of the capacity above which a piece is long); the plan of fewest sequences is taken.
SETTINGS = ((128, 0.45), (96, 0.25), (96, 0.125))


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of each size that are worth most in one sequence."""
    worth = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for g, size in enumerate(sizes):
        if values[g] <= 1e-12 or size > capacity:
            continue
        for low in range(size, capacity + 1, size):  # a step of ``size`` reads only what the step before wrote
            high = min(low + size, capacity + 1)
            better = worth[low - size : high - size] + values[g]
            won = better > worth[low:high] + 1e-12
            worth[low:high][won] = better[won]
            last[low:high][won] = g
    counts = np.zeros(len(sizes))
    at = int(np.argmax(worth))
    best = float(worth[at])
    while at > 0 and last[at] >= 0 and worth[at] > 1e-12:
        counts[last[at]] += 1
        at -= sizes[last[at]]
    return best, counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """The linear program of step 2: configurations and how often each is used."""
    k = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    need = np.array(demand, float)
    for turn in range(rounds):
        duals = inverse.sum(axis=0)  # every configuration costs one sequence
        value, new = best_configuration(sizes, duals, capacity)
        if value <= 1 + 1e-7:
            break
        direction, level = inverse @ new, inverse @ need
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = new
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        if turn % 100 == 99:
            inverse = np.linalg.inv(columns)
    return [(columns[:, j].copy(), float(x)) for j, x in enumerate(inverse @ need) if x > 1e-9] if k else []


def plan(histogram: dict[int, int], capacity: int = CAPACITY, settings: tuple = SETTINGS) -> tuple[np.ndarray, int]:
    """The scheme under each setting, until one needs no more sequences than the tokens fill; the result with the fewest."""
    least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    best = None
    for setting in settings:
        found = grouping(histogram, capacity, *setting)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] == least:
            break
    return best


def grouping(histogram: dict[int, int], capacity: int, groups: int, long_share: float) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, end rank, first sequence, offset) sorted by length and rank; number of sequences.

    The piece of that length and of rank r stands in sequence ``first sequence + r - first rank``.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    rank: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs (first sequence, count)

    def put(length: int, first: int, count: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + count, first, offset))
        rank[length] += count
        left[length] -= count

    longs = sorted((s for s in left if s > capacity * long_share and s < capacity), reverse=True)
    total = sum(left[s] for s in longs)
    demand: dict[int, int] = defaultdict(int)  # rounded size -> pieces; groups of one size are one
    if total:
        each = -(-total // groups)
        size = space = 0
        for s in longs:
            n = left[s]
            while n:
                if not space:
                    size, space = s, each
                m = min(n, space)
                demand[size] += m
                n, space = n - m, space - m
    sizes = list(demand)
    free = sorted(s for s in left if s < capacity)  # lengths of which pieces are left

    def take(limit: int, run: tuple[int, int, int]) -> tuple[int, int, int] | None:
        """Put the longest piece up to ``limit`` into as many sequences of the run as there are such pieces."""
        at = bisect.bisect_right(free, limit) - 1
        if at < 0:
            return None
        first, count, used = run
        length = free[at]
        n = min(count, left[length])
        put(length, first, n, used)
        if not left[length]:
            del free[at]
        return first, n, used + length

    chosen = [([sizes[g] for g, c in enumerate(counts) for _ in range(round(c))], int(times + 1e-6)) for counts, times in configurations(sizes, list(demand.values()), capacity)]
    for slots, copies in sorted(chosen, reverse=True):  # the longest first, as their last slots are the hardest to fill
        runs = [(sequences, copies, 0)]  # (first sequence, sequences alike, tokens used)
        for k, slot in enumerate(slots):
            then: list[tuple[int, int, int]] = []
            for first, count, used in runs:
                while count:
                    done = take(capacity - used if k == len(slots) - 1 else slot, (first, count, used))
                    if done is None:
                        break
                    then.append(done)
                    first, count = first + done[1], count - done[1]
                if count and used:
                    then.append((first, count, used))
            runs = then
        for first, count, used in runs:
            sequences = max(sequences, first + count)
            room[capacity - used].append((first, count))
    # step 4: best fit of the rest, longest first
    known = sorted(r for r in room if r > 0)

    def give(space: int, first: int, count: int) -> None:
        if space and count:
            if not room[space]:
                bisect.insort(known, space)
            room[space].append((first, count))

    for length in sorted((s for s in left if left[s]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(known, length)
            if at < len(known):
                space = known[at]
                first, count = room[space].pop()
                if not room[space]:
                    del known[at]
            else:
                space, first = capacity, sequences
                count = -(-left[length] // (capacity // length))
                sequences += count
            used = min(count, left[length])
            give(space, first + used, count - used)
            put(length, first, used, capacity - space)
            give(space - length, first, used)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table, sequences


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's task and rank within (task, length)."""

    def run(batches):
        from pyspark import TaskContext

        encoder = word_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in runtime.slices(batch, 1):
                out: list[tuple] = []
                for doc, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[at : at + 4 * capacity]
                        n = len(cut) // 4
                        out.append((doc, k, at // 4, n, zlib.crc32(cut), task, seen[n]))
                        seen[n] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])
        runtime.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    One pass encodes; the pieces (a few numbers each) are written to the shared folder, so
    the ranks that the plan refers to are those that the result uses, whatever is run again.
    """
    table, _ = runtime.materialize(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(histogram, capacity)

    def run(batches):
        keys = rows[:, 0] * (1 << 44) + rows[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = table.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("place"))
    return ranked.drop("task", "place", "base").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
