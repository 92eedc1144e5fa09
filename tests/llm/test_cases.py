"""The cases that the operators and stages state: null ids, repeated rows, empty tables, clashing columns, ties."""

import collections

import numpy as np
import public_tokenizers as P
import pytest
from test_text_operators import AWKWARD, SCHEMA, docs, empty, texts  # noqa: F401

import corpus_pipeline
from tidewatt.llm import bpe, language, licenses, packing, quality, secret_scan, simhash

OPERATORS = {
    "licenses": licenses.scan,
    "quality": lambda d: quality.judge(d, P.path("piece_bpe_32k.model")),
    "byte bpe": lambda d: bpe.round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "language": language.identify,
    "secrets": lambda d: secret_scan.scan(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_null_ids_and_repeated_rows(docs, texts, name):  # noqa: F811
    """A row for each row: the one of null doc_id, and both of the repeated one, which are alike."""
    rows = OPERATORS[name](docs).collect()
    ids = collections.Counter(r["doc_id"] for r in rows)
    assert ids == collections.Counter([*range(len(texts)), None, 9])
    assert len({tuple(r) for r in rows if r["doc_id"] == 9}) == 1
    if name == "simhash":
        (null,) = (r for r in rows if r["doc_id"] is None)
        assert null["component_id"] is None and null["fingerprint"] == f"{simhash.fingerprint('null id') & (1 << 64) - 1:016x}"
    if name == "language":
        assert not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_packing_of_null_ids_and_repeated_rows(docs, empty):  # noqa: F811
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    own = collections.defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert len(own[None]) == 1 and len(own[9]) == 2 and len(set(own[9])) == 1
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).collect() == []


def test_votes_that_tie():
    """Three languages that beat each other in a circle: the largest margins decide, the same way every time."""
    level = language.Level.__new__(language.Level)
    level.names, level.pairs = ["a", "b", "c"], [(0, 1), (0, 2), (1, 2)]
    level.machines = np.zeros((language.DIMENSIONS + 1, 3))
    level.machines[-1] = [1.0, -2.0, 0.5]  # a beats b, c beats a by more, b beats c
    best, score = level.vote(np.zeros((2, language.DIMENSIONS)))
    assert best.tolist() == [2, 2] and score[0] == score[1]
    level.machines[-1] = 0
    assert len(set(level.vote(np.zeros((3, language.DIMENSIONS)))[0].tolist())) == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_table(spark, docs, empty, name):  # noqa: F811
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = stage(spark, docs, "").collect()
    none = stage(spark, empty, "")
    assert none.collect() == []
    if name == "best-fit packing":
        assert {r["doc_id"] for r in rows} == {None, *range(len(AWKWARD)), *(r["doc_id"] for r in docs.select("doc_id").collect())}
        return
    assert none.columns == docs.columns and stage(spark, docs, "").columns == docs.columns
    before = collections.Counter((r["doc_id"], r["lang"], r["source"], r["key"]) for r in docs.collect())
    after = collections.Counter((r["doc_id"], r["lang"], r["source"], r["key"]) for r in rows)
    assert not after - before
    given = {r["doc_id"]: r["text"] for r in rows}
    if name == "quality rules":
        assert not {0, 1, 2, 3, None} & set(given) and set(given)
    if name == "language ID":
        assert not {0, 1, 2, 4} & set(given) and set(given)
    if name == "SimHash near-dedup":
        assert after[(None, "en", "s", "k")] == 1 and sum(n for (k, *_), n in after.items() if k == 9) == 1
        assert 12 in given and 13 not in given  # equal long texts
        assert 0 in given and 1 not in given and 2 not in given  # texts without a word are one group
    if name == "secret scans":
        assert given[11].startswith("[SECRET] and 123e4567") and given[0] is None and given[3] == "a" and after == before


def test_secrets_change_the_length(spark):
    frame = spark.createDataFrame([(1, "key Xq7vZk2LpW9sTb4NfR8yHc3M end", 32, "n_chars"), (2, None, None, "x")], "doc_id long, text string, n_chars int, clean_text string")
    rows = {r["doc_id"]: r for r in corpus_pipeline.secret_scans(spark, frame, "").collect()}
    assert (rows[1]["text"], rows[1]["n_chars"], rows[1]["clean_text"]) == ("key [SECRET] end", 16, "n_chars") and rows[2]["text"] is None


def test_texts_of_one_doc_id(spark):
    """Of a doc_id with several texts, those stay that lead a group; equal rows once."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    frame = spark.createDataFrame([(5, a), (5, b), (5, b), (3, a), (7, c), (8, c)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, frame, "").collect())) == sorted([(3, a), (5, b), (7, c)])


def test_junk_is_rejected_and_prose_of_many_scripts_is_not(spark):
    """The method's verdict on texts that pass the base rules."""
    import random
    import string

    rng = random.Random(1)
    word = lambda letters, n: "".join(rng.choices(letters, k=rng.randint(2, n)))
    junk = [" ".join(word(letters, n) for _ in range(200)) for letters, n in ((string.ascii_letters + string.digits, 12), (string.ascii_letters + string.digits + "+/", 60), (string.digits, 9), (string.punctuation, 9), ("0123456789abcdef", 32))]
    junk.append(" ".join("".join(chr(rng.randint(0x1F300, 0x1F5FF)) for _ in range(3)) for _ in range(100)))
    prose = ["All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
             "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
             "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
             "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
             "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
             "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
             "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다."]
    langs = ["en", "de", "fr", "es", "ru", None, "xx"]
    frame = spark.createDataFrame([(k, t, langs[k]) for k, t in enumerate(prose)] + [(100 + k, t, lang) for k, t in enumerate(junk) for lang in ("en", None)], "doc_id long, text string, lang string")
    rows = quality.judge(frame, P.path("piece_bpe_32k.model")).collect()
    assert all(not r["base_failed"] and r["kept"] == (r["doc_id"] < 100) for r in rows), [r for r in rows if r["kept"] != (r["doc_id"] < 100)]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(table, P.path("piece_bpe_32k.model")).collect()
    assert sum(r["kept"] for r in judged) >= 0.999 * sum(not r["base_failed"] for r in judged)


def test_quality_against_sentencepiece(spark, texts):  # noqa: F811
    """The three measures, by the library on words that stand apart."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    some = [t for t in texts if t and len(t) < 20000][:60]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for r in quality.judge(frame, P.path("piece_bpe_32k.model")).collect():
        words = some[r["doc_id"]].encode().split()
        ids = [k for w in words for k in model.encode(w.decode())]
        counts = np.array(list(collections.Counter(ids).values())) / max(1, len(ids))
        assert r["chars_per_token"] == pytest.approx(sum(len(w.decode()) for w in words) / len(ids) if ids else 0)
        assert r["byte_share"] == pytest.approx(sum(map(model.is_byte, ids)) / len(ids) if ids else 0)
        assert r["token_entropy"] == pytest.approx(max(0, -(counts * np.log2(counts)).sum()) if ids else 0, abs=1e-9)


def test_schema_is_that_of_the_tests(docs):  # noqa: F811
    assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
