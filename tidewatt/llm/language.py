"""Language ID by hierarchical discrimination: the family first, then the language within it.

Both levels vote among one-versus-one linear support vector machines over hashed byte n-grams
of the lower-case letters. They are trained on the driver on every language of the table, from
at most ``PER_LANGUAGE`` labelled documents of each and about ``TOTAL`` in all (shared equally, one
document a language at least), drawn by a hash of doc_id from the whole training part
(feature counts are made on the executors); prediction reads every whole text.

Cases: null text, and text without a letter, is ``und`` with score 0; a language without a
training document is never predicted; with no training document at all everything is ``und``;
rows of null doc_id are predicted, never trained on and not held out; repeated rows are
predicted alike; an empty table gives no rows; other columns are ignored by ``identify``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatt.llm import runtime

PER_LANGUAGE = 300
TOTAL = 19_200
DIMENSIONS = 4096
_SHIFT = np.uint32(32 - (DIMENSIONS - 1).bit_length())
UNDETERMINED = "und"
#: The score under which ``keep_known`` takes a text to be of no learned language. Measured with the table's four
#: languages: of 46,291 documents of the 0.1 GB table that pass the quality rules one scores less (0.41; half of it is
#: in another language), the lowest otherwise 0.43. Texts of 11 other scripts and of random letters score 0.28 to 0.41,
#: of other languages of the same families 0.31 to 0.64: those near a learned one stay.
#: A table of one language has nothing to tell it from: every score is 1 there.
LEAST_SCORE = 0.42
_BLOCK = 1 << 20

#: Families by language code (public knowledge); a language not listed is of the family "other".
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh", "yue"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def family(lang: str) -> str:
    return _FAMILY.get(lang, "other")


def features(text: str) -> np.ndarray:
    """Square roots of hashed counts of 1 to 3 byte n-grams, at unit length."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    counts = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(raw), _BLOCK):
        b = np.frombuffer(raw, np.uint8, min(len(raw) - at, _BLOCK + 2), at).astype(np.uint32)
        one = b * np.uint32(0x9E3779B1)
        counts += np.bincount(one[:_BLOCK] >> _SHIFT, minlength=DIMENSIONS)
        if len(b) > 1:
            two = one[:-1] ^ (b[1:] * np.uint32(0x85EBCA77) + np.uint32(1))
            two = two * np.uint32(0xC2B2AE3D)
            counts += np.bincount(two[:_BLOCK] >> _SHIFT, minlength=DIMENSIONS)
            if len(b) > 2:
                three = (two[:-1] ^ (b[2:] * np.uint32(0x27D4EB2F) + np.uint32(7))) * np.uint32(0x165667B1)
                counts += np.bincount(three[:_BLOCK] >> _SHIFT, minlength=DIMENSIONS)
    root = np.sqrt(counts)
    return root / max(np.linalg.norm(root), 1e-12)


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Squared-hinge support vector machine (weights, then bias) by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))], dtype=np.float64)
    weight = weight / weight.sum()
    step = 1 / (2 * float((weight * (x * x).sum(axis=1)).sum()) + reg)
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        then = ahead - step * (reg * ahead - 2 * x.T @ (weight * y * gap))
        ahead = then + k / (k + 3) * (then - w)
        w = then
    return w


class Level:
    """One-versus-one machines among ``names``."""

    def __init__(self, x: np.ndarray, of: list[str]):
        self.names = sorted(set(of))
        self.pairs = list(combinations(range(len(self.names)), 2))
        label = np.array(of)
        machines = []
        for a, b in self.pairs:
            rows = np.flatnonzero((label == self.names[a]) | (label == self.names[b]))
            y = np.where(label[rows] == self.names[a], 1.0, -1.0)
            weight = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum())
            machines.append(linear_svm(x[rows], y, weight))
        self.machines = np.array(machines).T if machines else np.zeros((DIMENSIONS + 1, 0))

    def vote(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the winner's index and its least margin as a probability (1 with one name only)."""
        margins = x @ self.machines[:-1] + self.machines[-1]
        k = len(self.names)
        wins = np.zeros((len(x), k))
        least = np.full((len(x), k), np.inf)
        for p, (a, b) in enumerate(self.pairs):
            m = margins[:, p]
            soft = np.tanh(m) * 1e-3  # ties go to the larger margins
            wins[:, a] += (m > 0) + soft
            wins[:, b] += (m <= 0) - soft
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = wins.argmax(axis=1)
        margin = least[np.arange(len(x)), best]
        return best, 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        families = [family(c) for c in langs]
        self.families = Level(x, families)
        self.within = {name: Level(x[[f == name for f in families]], [c for c, f in zip(langs, families, strict=True) if f == name]) for name in self.families.names}

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        chosen, sure = self.families.vote(x)
        langs, scores = [""] * len(x), sure.copy()
        for k, name in enumerate(self.families.names):
            rows = np.flatnonzero(chosen == k)
            if len(rows):
                level = self.within[name]
                best, probability = level.vote(x[rows])
                scores[rows] *= probability
                for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                    langs[r] = level.names[b]
        return langs, scores.tolist()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> Model | None:
    """Fit on a bounded sample of labelled, not held-out documents; None if there are none."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row a language
    if not counts:
        return None
    per_language = max(1, min(per_language, total // len(counts)))
    buckets = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    drawn = max(1.3 * per_language, per_language + 30)  # so that no language is left without a row
    shares = [F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, drawn / r["n"]) * buckets))]
    rule = F.element_at(F.create_map(*shares), F.col("lang"))

    def run(batches):
        for batch in batches:
            for part in runtime.slices(batch, 2):
                rows = [features(t).astype("<f4").tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["lang", "draw", "features"])

    sample = usable.withColumn("draw", draw).where(F.col("draw") < rule).select("lang", "draw", "text").mapInArrow(run, "lang string, draw long, features binary").collect()
    by_lang: dict[str, list] = {}
    for s in sample:
        by_lang.setdefault(s["lang"], []).append(s)
    taken: list = []
    for r in counts:
        taken += sorted(by_lang.get(r["lang"], []), key=lambda s: (s["draw"], s["features"]))[:per_language]
    if not taken:
        return None
    del sample, by_lang
    x = np.empty((len(taken), DIMENSIONS), "<f4")  # each machine makes its own rows double
    for k, s in enumerate(taken):
        x[k] = np.frombuffer(s["features"], "<f4")
    return Model(x, [s["lang"] for s in taken])


def _predict(docs: DataFrame, model: Model | None, keep: list[str], names: tuple[str, str]) -> DataFrame:
    def make():
        import regex

        letter = regex.compile(r"\p{L}").search

        def kernel(texts):
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            rows = [k for k, t in enumerate(texts) if t and letter(t)] if model else []
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                found, sure = model.predict(np.array([features(texts[k]) for k in part]))
                for k, lang, score in zip(part, found, sure, strict=True):
                    langs[k], scores[k] = lang, score
            return langs, scores

        return kernel

    return runtime.map_texts(docs, make, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], keep=keep)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = _predict(docs, train(docs), ["doc_id"], ("lang_pred", "score"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``least_score``; all columns kept."""
    names = (runtime.free_name("lang_pred", docs.columns), runtime.free_name("lang_score", docs.columns))
    found = _predict(docs, train(docs), docs.columns, names)
    return found.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least_score)).select(*[F.col(runtime.quoted(c)) for c in docs.columns])
