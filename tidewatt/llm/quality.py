"""Quality rules: the fertility of a public tokeniser, beside fixed text statistics.

Per text, words of the vocabulary measure characters per token, the share of tokens that are
raw bytes (byte fallback), and the entropy of the tokens in bits. A text is rejected if a
measure lies outside the band of its language (the given one if it has a band, else the band
of its main script). Words are looked up once per worker: white space never joins tokens.

Cases: null and blank texts have no words, so base rules reject them (measures 0); an unknown
or null language uses the script's band; repeated rows are judged alike; an empty table gives
no rows; ``judge`` ignores other columns, ``keep_good`` keeps all columns and their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatt.llm import runtime

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED = 30


class Band(NamedTuple):
    """Limits: characters per token, share of byte tokens, entropy as a share of its usual ceiling."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Bands per language. Measured on the 9,066 documents of sf0.1 that pass the base rules, least and most:
#:   characters per token  en 1.72 2.64, de 1.77 2.60, es 1.65 2.39, fr 1.56 2.34 (letters at random: 1.58)
#:   share of byte tokens  0 throughout
#:   entropy of its ceiling  en 0.57, de 0.54, es 0.64, fr 0.59 at the least (three words in turn: 0.20)
#: Natural prose encodes better than the table's invented words (4.1, 2.9, 2.8, 2.8 on the first article of the
#: Universal Declaration of Human Rights), so the most is far above. Short prose with a key or numbers in it goes
#: down to 1.46 (two of 46,293 documents of the 0.1 GB table, one of sf0.01 at 1.51), random letters and digits
#: reach 1.21: the least lies between.
LANGUAGE_BANDS = {
    "en": Band(1.4, 7.0, 0.02, 0.45),
    "de": Band(1.5, 7.0, 0.02, 0.45),
    "fr": Band(1.4, 7.0, 0.02, 0.45),
    "es": Band(1.4, 7.0, 0.02, 0.45),
}
#: Bands per script, for texts of other or unknown languages. Measured on the same article (characters per token,
#: share of byte tokens, entropy of its ceiling): Russian 2.21 0 0.94, Greek 0.86 0 0.57, Hebrew 0.83 0 0.58,
#: Arabic 0.90 0 0.65, Hindi 0.78 0.08 0.60, Thai 0.96 0.02 0.72, Korean 0.76 0.03 0.78, Japanese 0.92 0.10 0.86,
#: Chinese 0.98 0 0.97; and on random strings: letters and digits 1.18, base64 1.21, hexadecimal 1.07, digits
#: 0.84, punctuation 1.23, emoji 0.24 0.91. Scripts whose letters the vocabulary lacks are bytes for the most part.
SCRIPT_BANDS = {
    "latin": Band(1.4, 7.0, 0.1, 0.4),
    "greek": Band(0.6, 3.0, 0.2, 0.35),
    "cyrillic": Band(1.3, 5.0, 0.2, 0.4),
    "hebrew": Band(0.55, 3.0, 0.3, 0.35),
    "arabic": Band(0.55, 3.0, 0.3, 0.35),
    "indic": Band(0.35, 3.0, 0.8, 0.35),
    "thai": Band(0.6, 3.0, 0.3, 0.35),
    "cjk": Band(0.4, 3.0, 0.6, 0.35),
    "symbols": Band(0.6, 3.0, 0.3, 0.4),
    "other": Band(0.3, 5.0, 0.95, 0.3),
}
#: Longer texts have no more bits a token than a text of this many tokens is likely to have.
CEILING_BITS = 8.0
#: First and last code point of the scripts' blocks.
_SCRIPTS = ((0x41, 0x24F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x370, 0x3FF, "greek"), (0x1F00, 0x1FFF, "greek"), (0x400, 0x52F, "cyrillic"), (0x590, 0x5FF, "hebrew"),
            (0x600, 0x77F, "arabic"), (0x900, 0xDFF, "indic"), (0xE00, 0xE7F, "thai"), (0x3040, 0x30FF, "cjk"), (0x3400, 0x9FFF, "cjk"), (0xAC00, 0xD7AF, "cjk"),
            (0x2000, 0x2BFF, "symbols"), (0x1F000, 0x1FAFF, "symbols"))


class Fertility:
    """Token ids of words, by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(k) for k in range(size)), bool, size)
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.cache = runtime.WordCache()
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> list[bytes]:
        return [np.array(x, self.dtype).tobytes() for x in self.model.encode([w.decode() for w in words], num_threads=1)]

    def learn(self, split: list[list[bytes]]) -> None:
        """Look up all words of some texts; ``measures`` then knows them."""
        self.known = self.cache.table(set().union(*split), self._learn)

    def measures(self, words: list[bytes], chars: int) -> tuple[float, float, float, int]:
        """Characters per token, share of byte tokens, entropy in bits, tokens."""
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.dtype)
        if not len(ids):
            return 0.0, 0.0, 0.0, 0
        _, counts = np.unique(ids, return_counts=True)
        share = counts / len(ids)
        return chars / len(ids), float(self.is_byte[ids].mean()), max(0.0, float(-(share * np.log2(share)).sum())), len(ids)


def fertility(path: str) -> Fertility:
    return runtime.hold(("fertility", path), lambda: Fertility(path))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which stands twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():  # different mixtures come from different windows
        return 0
    suspects = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    seen: dict[tuple, list[int]] = {}
    for at in suspects:
        seen.setdefault(tuple(words[at : at + window]), []).append(at)
    edge = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            where = np.array(places)
            np.add.at(edge, where, 1)
            np.add.at(edge, where + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def script(text: str) -> str:
    """The script of most characters from "A" on: one of ``SCRIPT_BANDS``."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    points = points[points > 0x40]
    counts: dict[str, int] = {}
    for low, high, name in _SCRIPTS:
        counts[name] = counts.get(name, 0) + int(((points >= low) & (points <= high)).sum())
    counts["other"] = len(points) - sum(counts.values())
    return max(counts, key=lambda k: (counts[k], k))


def within(band: Band, chars: float, byte_share: float, entropy: float, tokens: int) -> bool:
    ceiling = min(CEILING_BITS, float(np.log2(max(tokens, 2))))
    return band.least_chars <= chars <= band.most_chars and byte_share <= band.most_bytes and entropy >= band.least_entropy * ceiling


_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
_FIELDS += [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
_FIELDS += [T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "token_entropy")]


def _judge(docs: DataFrame, model: str, keep: list[str], text: str = "text", lang: str = "lang", rename: dict | None = None) -> DataFrame:
    fields = [T.StructField((rename or {}).get(f.name, f.name), f.dataType) for f in _FIELDS]
    both = runtime.free_name("text_and_lang", keep)

    def make():
        meter = fertility(model)

        def one(text, lang, words):
            raw = text.encode()
            n = len(words)
            chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c")))
            lines = [x for x in raw.split(b"\n") if x.strip()]
            repeats = repeated_words(words)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
            measured = meter.measures(words, chars)
            band = LANGUAGE_BANDS.get(lang) or SCRIPT_BANDS[script(text)]
            return n, chars, len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeats, failed, not failed and within(band, *measured), *measured[:3]

        def kernel(texts, langs):
            texts = [t or "" for t in texts]
            split = [t.encode().split() for t in texts]
            meter.learn(split)
            return list(zip(*map(one, texts, langs, split), strict=True))

        return kernel

    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    names = [f.name for f in schema.fields]
    width = len(keep)
    lang_column = F.col(runtime.quoted(lang)).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    picked = docs.select(*[F.col(runtime.quoted(c)) for c in keep], F.col(runtime.quoted(text)).alias(both), lang_column.alias(runtime.free_name("lang_in", keep)))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(schema)]
        kernel = make()
        for batch in batches:
            for part in runtime.slices(batch, width):
                out = kernel(part.column(width).to_pylist(), part.column(width + 1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(width)] + [pa.array(x, type=t) for x, t in zip(out, types[width:], strict=True)], names=names)
        runtime.give_back()

    return picked.mapInArrow(run, schema)


def judge(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and the three measures."""
    return _judge(docs, model, ["doc_id"])


def keep_good(docs: DataFrame, model: str) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were."""
    rename = {f.name: runtime.free_name(f"{f.name}_judged", docs.columns) for f in _FIELDS}
    return _judge(docs, model, docs.columns, rename=rename).where(F.col(rename["kept"])).select(*[F.col(runtime.quoted(c)) for c in docs.columns])
