"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

The test: a run of letters, digits and ``+/_=-`` that a public vocabulary can only cut into
short tokens is random. Runs that hold no letter, known digests (hexadecimal of a digest's
length), UUIDs, and names whose parts are words or numbers are left out before it; letters
count as words only if the vocabulary encodes them well. What a fixed pattern has found is cut
out of a run, and what is left on either side is tested as a run of its own.

Cases: null text is empty (no spans); repeated rows are scanned alike; an empty table gives
no rows; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, types as T

from tidewatt.llm import runtime

KINDS = ("assign", "access", "hex", "random")
#: The shortest run that is tested.
MIN_RUN = 20
#: Characters per token under which a run counts as random.
MAX_EFFICIENCY = 2.2
#: Lengths of hexadecimal digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# The contract's patterns and least lengths.
_ASSIGN = re.compile("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_HEX_LONG = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_ANY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NO_LETTER = re.compile(r"[^A-Za-z]+").fullmatch
_PARTS = re.compile(r"[^-_/=+]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
#: Letters from which a piece of a name can be told to be a word.
MIN_WORD = 4


def vocabulary(path: str, pattern: str):
    def make():
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return runtime.hold(("vocabulary", path, pattern), make)


def known(run: str, encode, most: float = MAX_EFFICIENCY) -> bool:
    """A digest, a UUID, or a name: parts that are numbers, or words that ``encode`` cuts into long tokens.

    Every word (camel case starts a new one) of ``MIN_WORD`` letters or more has to be one by itself, and
    shorter ones may only be a third of the letters, beside digits of a number or a version.
    """
    if len(run) in DIGESTS and _HEX_ANY.fullmatch(run) or _UUID.fullmatch(run):
        return True
    letters = short = 0
    for part in _PARTS.findall(run):
        if part.isdigit():
            continue
        words = _WORD.findall(part)
        own = sum(map(len, words))
        if own < len(part) and len(words) > 1 + part[-1].isdigit() and min(map(len, words)) < MIN_WORD:
            return False  # digits between short scraps of letters
        for word in words:
            letters += len(word)
            if len(word) < MIN_WORD:
                short += 0 if len(words) == 1 else len(word)
            elif len(word) < most * len(encode(word)):
                return False
    return 3 * short <= letters


def badly_encoded(run: str, encode, most: float = MAX_EFFICIENCY) -> bool:
    """Whether the run, or what is left of it without its numbers, has fewer characters a token than ``most``."""
    if len(run) < most * len(encode(run)):
        return True
    parts = [p for p in _PARTS.findall(run) if not p.isdigit()]
    return MIN_RUN <= sum(map(len, parts)) < most * sum(len(encode(p)) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns, leftmost and not overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]  # a match is a maximal run: short ones need no look
    out.sort()
    return out


def random_spans(text: str, encode, taken: list[tuple[int, int, int]], most: float = MAX_EFFICIENCY) -> list[tuple[int, int, int]]:
    """Runs outside ``taken`` (sorted by start) that the vocabulary encodes badly. One pass over both lists."""
    out = []
    merged: list[list[int]] = []  # taken spans as intervals that do not overlap
    for start, _, end in taken:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    place = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while place < len(merged) and merged[place][1] <= start:
            place += 1
        if known(m.group(), encode, most):
            continue
        k, at = place, start
        while at < end:
            a, b = merged[k] if k < len(merged) and merged[k][0] < end else (end, end)
            run = text[at:a]
            if len(run) >= MIN_RUN and not _NO_LETTER(run) and (run == m.group() or not known(run, encode, most)) and badly_encoded(run, encode, most):
                out.append((at, 3, a))
            at, k = max(at, b), k + 1
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanner(path: str, pattern: str):
    encode = vocabulary(path, pattern).encode_ordinary

    def find(text: str | None):
        base = base_spans(text) if text else []
        return base, sorted(base + random_spans(text, encode, base)) if text else []

    return find


def scan(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def make():
        find = _scanner(ranks, pattern)

        def kernel(texts):
            found = [find(t) for t in texts]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
            return [*counts, [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], [joined(spans) for _, spans in found]]

        return kernel

    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    return runtime.map_texts(docs, make, fields)


def redact(docs: DataFrame, ranks: str, pattern: str, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span (overlapping ones as one) replaced by ``mark``; all columns kept."""

    def make():
        find = _scanner(ranks, pattern)

        def clean(text):
            if not text:
                return text
            out, at = [], 0
            for start, _, end in find(text)[1]:
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join([*out, text[at:]]) if out else text

        return lambda texts: [[clean(t) for t in texts]]

    name = runtime.free_name("clean_text", docs.columns)
    done = runtime.map_texts(docs, make, [T.StructField(name, T.StringType())], keep=docs.columns)
    return done.withColumn("text", done[name]).drop(name)
