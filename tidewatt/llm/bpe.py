"""Byte-level BPE with a hierarchical-bitmap rank queue, and its inverse.

Pre-tokens (matches of the split pattern) are merged all at once in one linked list whose
pre-tokens are kept apart. The queue has a bucket per merge rank with list positions; a
three-level bitmap of 64-bit words tells the lowest rank that has any by three find-first-set
steps. A bucket is taken as a whole: positions whose pair has changed since are stale and
skipped, overlapping pairs are merged from the left, and the pairs that arise are put in the
buckets of their ranks. So a pre-token of millions of bytes costs a few array operations
for each rank in it, and many short ones share the same operations.

Within a pre-token merges must come in order of rank, leftmost first. Taking a whole bucket
at once differs from that only if a merge at rank r can make a pair of a rank below r; such
ranks are known from the vocabulary, and their buckets are taken one position a pre-token.

Cases: null text is empty (no ids, digest of no bytes); repeated rows are encoded alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, types as T

from tidewatt.llm import runtime


#: Text whose unseen pre-tokens share one queue: array operations are the cheaper, the more of them there are.
SLICE_BYTES = 4 << 20


class RankQueue:
    """Buckets of positions per rank under a bitmap of three levels (64 x 64 x 64 ranks)."""

    def __init__(self):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.top = 0
        self.middle = [0] * 64
        self.low = [0] * 4096

    def push(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, a, b in zip(ranks[starts].tolist(), starts, [*cuts.tolist(), len(ranks)], strict=True):
            held = self.buckets.get(rank)
            if held is None:
                self.buckets[rank] = [positions[a:b]]
                self.low[rank >> 6] |= 1 << (rank & 63)
                self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
                self.top |= 1 << (rank >> 12)
            else:
                held.append(positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions, stale ones included."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.middle[a] & -self.middle[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.middle[a] &= self.middle[a] - 1
            if not self.middle[a]:
                self.top &= self.top - 1
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.concatenate(held)


class ByteBpe:
    """A vocabulary of ranks (a file of base64 token and rank a line), as bytes to ids and back."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        if max(ranks.values()) >= 1 << 18:
            raise ValueError("more ranks than the bitmap holds")
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]] << 18 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.made = np.array([r for _, r in pairs], np.int64)
        one_by_one = np.zeros(1 << 18, bool)  # ranks whose merge can make a pair of a lower rank
        for part in (self.keys >> 18, self.keys & (1 << 18) - 1):
            one_by_one[part[self.made < part]] = True
        self.one_by_one = one_by_one
        self.cache = runtime.WordCache()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the pairs of tokens; -1 where they don't merge."""
        key = left << 18 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each of the pre-tokens."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        if not n:
            return [token] * len(pieces)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        after = np.arange(1, n + 1)
        after[np.flatnonzero(owner[1:] != owner[:-1])] = n  # n: nothing follows in this pre-token
        before = np.full(n + 1, -1)
        before[1:n] = np.where(owner[1:] == owner[:-1], np.arange(n - 1), -1)
        rank = np.full(n + 1, -1)
        has = np.flatnonzero(after[:n] < n)
        rank[has] = self._rank(token[has], token[has + 1])
        live = has[rank[has] >= 0]
        queue = RankQueue()
        if len(live):
            queue.push(live, rank[live])
        alive = np.ones(n, bool)
        while (popped := queue.pop()) is not None:
            r, at = popped
            at = at[rank[at] == r]  # the rest is stale
            if len(at) > 1:
                at = np.unique(at)
                if self.one_by_one[r]:
                    first = np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
                    later, at = at[~first], at[first]
                    if len(later):
                        queue.push(later, np.full(len(later), r))
                else:
                    chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                    if chained.any():  # overlapping pairs: every second of a chain, from its left end
                        place = np.arange(len(at))
                        head = np.maximum.accumulate(np.where(chained, 0, place))
                        at = at[(place - head) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            token[at] = r
            alive[gone] = False
            rank[gone] = -1
            nxt = after[gone]
            after[at] = nxt
            linked = nxt < n
            before[nxt[linked]] = at[linked]
            left = before[at]
            changed = np.concatenate([at, left[left >= 0]])
            if len(changed) > 1:
                changed = np.unique(changed)
            follow = after[changed]
            new = np.full(len(changed), -1)
            inner = follow < n
            new[inner] = self._rank(token[changed[inner]], token[follow[inner]])
            rank[changed] = new
            changed, new = changed[new >= 0], new[new >= 0]
            if len(changed):
                queue.push(changed, new)
        counts = np.bincount(owner[alive], minlength=len(pieces))
        return np.split(token[alive], np.cumsum(counts)[:-1])

    def _learn(self, pieces: list[str]) -> list[bytes]:
        return [ids.astype("<u4").tobytes() for ids in self.merge([p.encode() for p in pieces])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) if t else [] for t in texts]
        get = self.cache.table(set().union(*split), self._learn).__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One vocabulary, and one cache, for all tasks that a Python worker runs in turn."""
    return runtime.hold(("byte BPE", path, pattern), lambda: ByteBpe(path, pattern))


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode whole texts, decode the ids; doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        bpe = byte_bpe(ranks, pattern)

        def kernel(texts):
            encoded = bpe.encode(texts)
            decoded = [bpe.decode(np.frombuffer(raw, "<u4").tolist()) for raw in encoded]
            return [len(x) // 4 for x in encoded], [hashlib.sha256(x).hexdigest() for x in encoded], [hashlib.sha256(x).hexdigest() for x in decoded]

        return kernel

    return runtime.map_texts(docs, make, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], slice_bytes=SLICE_BYTES)
