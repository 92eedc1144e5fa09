"""Whole-text encoding with the tokenizers library, one library call per unseen word."""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from tidewatt.llm.runtime import WordCache, hold

_SEPARATOR = "<|startoftext|>"
#: The normaliser and the split that let chunks be encoded one by one.
_NORMALISER = ["NFC", "\\s+", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_JOINED = 400
#: Of each line: letters and the punctuation after them, or two empty strings.
_SIMPLE = re.compile(r"(?:([^\W\d_]+)([^\w\s]*)|[^\n]*)\n").findall


#: The bytes that ``bytes.split`` cuts at; masks of the first k bytes of a little-endian word.
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SHORT = 16
#: Bytes of a table of chunks, beyond which it starts anew, and of a generation of the caches of longer chunks and of words.
_TABLE_BYTES, _LONG_BYTES, _WORD_BYTES = 48 << 20, 8 << 20, 20 << 20


class ChunkTable:
    """Ids of chunks of at most ``_SHORT`` bytes, looked up many at once.

    A chunk is two words of eight bytes (the rest zero) and its length, which say all of it: equal
    keys are equal chunks. Open addressing with linear probing, at most half full.
    """

    def __init__(self, dtype: str, limit: int = _TABLE_BYTES):
        self.limit, self.dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.head, self.tail, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)  # of entry k: ends[k + 1]
        self.ids = np.zeros(0, self.dtype)
        self._grow(1 << 15, 1 << 17)

    def _grow(self, entries: int, ids: int) -> None:
        """Room for so many entries and ids, or twice the present room if that is more."""
        if entries > len(self.size):
            more = max(entries - len(self.size), len(self.size))
            for name in ("head", "tail", "size", "ends"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(more, getattr(self, name).dtype)]))
        if ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(ids - len(self.ids), len(self.ids)), self.dtype)])

    def full(self) -> bool:
        return 32 * self.count + self.ids.itemsize * int(self.ends[self.count]) + self.slots.nbytes > self.limit

    def _home(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        mixed = (head * np.uint64(0x9E3779B97F4A7C15)) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (size.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each chunk, -1 if there is none."""
        out = np.full(len(head), -1, np.int64)
        at, todo = self._home(head, tail, size), np.arange(len(head))
        while len(todo):
            entry = self.slots[at].astype(np.int64)
            same = (self.head[entry] == head[todo]) & (self.tail[entry] == tail[todo]) & (self.size[entry] == size[todo]) & (entry >= 0)
            out[todo[same]] = entry[same]
            on = ~same & (entry >= 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def _place(self, first: int) -> None:
        """Slots of the entries from ``first``."""
        todo = np.arange(first, self.count)
        at = self._home(self.head[todo], self.tail[todo], self.size[todo])
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # one of those that meet here stays
            on = self.slots[at] != todo
            todo, at = todo[on], (at[on] + 1) & (len(self.slots) - 1)

    def add(self, values: list[bytes]) -> int:
        """Entries with these ids after all others, not to be found yet; the number of the first."""
        first = self.count
        if not values:
            return first
        new, end = np.frombuffer(b"".join(values), self.dtype), int(self.ends[first])
        self._grow(first + len(values), end + len(new))
        self.ids[end : end + len(new)] = new
        self.ends[first + 1 : first + 1 + len(values)] = end + np.cumsum([len(v) for v in values]) // new.itemsize
        self.count += len(values)
        return first

    def name(self, first: int, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> None:
        """The chunks of the entries from ``first``, none of which the table has."""
        self.head[first : self.count], self.tail[first : self.count], self.size[first : self.count] = head, tail, size
        if 2 * self.count > len(self.slots):
            self.slots = np.full(1 << (4 * self.count - 1).bit_length(), -1, np.int32)
            first = 0
        self._place(first)

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``entries`` in turn, and where each one's end."""
        low = self.ends[entries]
        n = self.ends[entries + 1] - low
        ends = np.cumsum(n)
        return self.ids[np.repeat(low - (ends - n), n) + np.arange(int(n.sum()))], ends


def _by_chunks(path: str) -> bool:
    """Whether the tokenizer's file is of the kind whose chunks can be encoded one by one."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    steps = (given.get("normalizer") or {}).get("normalizers") or []
    normaliser = [x["pattern"].get("Regex") if x["type"] == "Replace" else x["type"] for x in steps]
    cuts = (given.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = given["model"]
    return (normaliser == _NORMALISER and [x.get("content") for x in steps][1] == " " and cuts[0].get("pattern") == {"Regex": _SPLIT} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
            and [x.get("type") for x in cuts[1:]] == ["ByteLevel"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not given.get("truncation") and not given.get("padding")
            and all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in given["added_tokens"]))


class WordEncoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    A vocabulary whose normaliser and split are those of ``_NORMALISER`` and ``_SPLIT`` drops white
    space and treats every run between white space by itself, so a text's ids are the ids of
    its ASCII-white-space separated chunks in turn, and each chunk is encoded once: short ones are
    looked up as numbers, all of a slice at a time. Any other tokenizer encodes whole texts.

    ASCII capitals are made small first, unless the text holds marks that compose with some capitals
    only (U+0300 to U+036F) or an added token in any case; so chunks that differ in them are one.
    Nearly all chunks are letters, with or without punctuation after them. For those the
    library's split is known (the letters, then the punctuation, each ending in a word-end
    token), so their distinct lower-case words and punctuation runs are encoded instead, many
    in one call, and told apart by the word-end tokens. Any other chunk goes to the library as
    it is, held apart by a special token, which the library cuts out before anything else;
    chunks that may hold that token go alone.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = dtype
        self.by_chunks = _by_chunks(path)
        # enough for what the normaliser leaves alone and the split cuts at spaces only
        self.plain = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table, self.long, self.words = ChunkTable(dtype), WordCache(_LONG_BYTES), WordCache(_WORD_BYTES)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _call_plain(self, texts: list[str]) -> list[np.ndarray]:
        given = self.tokenizer
        kept = given.normalizer, given.pre_tokenizer
        given.normalizer, given.pre_tokenizer = self.plain
        try:
            return self._call(texts)
        finally:
            given.normalizer, given.pre_tokenizer = kept

    def _cut(self, ids: np.ndarray, after: np.ndarray, skip: int) -> list[bytes]:
        """Pieces of ``ids`` that end at the places ``after``, without ``skip`` ids there."""
        raw, size = ids.tobytes(), ids.itemsize
        ends = ((after + 1) * size).tolist()
        return [raw[a : b - skip * size] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn_words(self, words: list[str]) -> list[bytes]:
        """Lower-case words and punctuation runs, each one split of the library's."""
        out: list[bytes] = []
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for group, ids in zip(groups, self._call_plain([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(group):  # not as supposed: one by one
                out += [x.tobytes() for x in self._call(group)]
            else:
                out += self._cut(ids, ends, 0)
        return out

    def _learn_odd(self, chunks: list[str]) -> list[bytes]:
        plain = [c for c in chunks if "<|" not in c] if self.separator is not None else []
        found: dict[str, bytes] = {}
        groups = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        for group, ids in zip(groups, self._call([_SEPARATOR.join(g) + _SEPARATOR for g in groups]), strict=True):
            found.update(zip(group, self._cut(ids, np.flatnonzero(ids == self.separator), 1), strict=True))
        alone = [c for c in chunks if c not in found]
        found.update(zip(alone, (x.tobytes() for x in self._call(alone)), strict=True))
        return [found[c] for c in chunks]

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        text = b"\n".join(chunks).decode() + "\n"
        small = text.lower()
        if len(small) != len(text):  # a letter whose small form is two characters
            small = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        parts = _SIMPLE(small)
        # not as supposed: no letters of the library's, or a small form that is longer or depends on what is around it
        unsure = "\u0130σς" if "Σ" in text else "\u0130"
        apart = {w for w in {w for w, _ in parts} if not w.isalpha() or not w.isascii() and any(c in w for c in unsure)}
        marks = {m for m in {m for _, m in parts} if not m.isascii() and any(unicodedata.category(c) == "Cn" for c in m)}
        odd = [k for k, (w, m) in enumerate(parts) if w in apart or m in marks]
        if not unicodedata.is_normalized("NFC", text):
            odd = sorted({*odd, *(k for k, c in enumerate(chunks) if not c.isascii() and not unicodedata.is_normalized("NFC", c.decode()))})
        for k in odd:
            parts[k] = ("", "")
        words = {x for part in parts for x in part}
        words.discard("")
        table = self.words.table(words, self._learn_words)
        table[""] = b""
        out = [table[w] + table[m] for w, m in parts]
        if odd:
            for k, ids in zip(odd, self._learn_odd([chunks[k].decode() for k in odd]), strict=True):
                out[k] = ids
        return out

    def _small(self, text: str) -> bytes:
        raw = text.encode()
        small = raw.lower()
        return raw if b"\xcc" in raw or b"\xcd" in raw or any(x in small for x in self.added) else small

    def _entries(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
        """The table's entry of each chunk, and how many entries it is to keep: those of long chunks stand last."""
        table = self.table
        if table.full():
            table.clear()
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        size = ends - starts
        head = words[starts] & _MASK[np.minimum(size, 8)]
        tail = words[starts + 8] & _MASK[np.clip(size - 8, 0, 8)]
        entries = table.find(head, tail, size)
        unseen = np.flatnonzero(entries < 0)
        if not len(unseen):
            return entries, table.count
        short = size[unseen] <= _SHORT
        for some, learn in ((unseen[short], self._learn), (unseen[~short], None)):
            place: dict[bytes, int] = {}
            at = np.array([place.setdefault(raw[a:b], len(place)) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], np.int64)
            if learn:
                first = table.add(learn(list(place)) if place else [])
                one = np.empty(len(place), np.int64)
                one[at] = some
                table.name(first, head[one], tail[one], size[one])
                kept = table.count
            else:
                known = self.long.table(set(place), self._learn)
                first = table.add([known[c] for c in place])
            entries[some] = first + at
        return entries, kept

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes; null counts as empty."""
        if not self.by_chunks:
            return [x.tobytes() for x in self._call([t or "" for t in texts])]
        small = [self._small(t) if t else b"" for t in texts]
        raw = b"".join([b"\n", *(x for t in small for x in (t, b"\n")), b"\n" * _SHORT])
        space = _SPACE[np.frombuffer(raw, np.uint8)]
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = turns[::2], turns[1::2]
        entries, kept = self._entries(raw, starts, ends)
        ids, upto = self.table.take(entries)
        self.table.count = kept
        firsts = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in small)]))  # of each text, its first chunk
        cuts = (np.concatenate([[0], upto])[firsts] * ids.itemsize).tolist()
        out = ids.tobytes()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def word_encoder(path: str) -> WordEncoder:
    """One encoder, and one cache, for all tasks that a Python worker runs in turn."""
    return hold(("word encoder", path), lambda: WordEncoder(path))
