"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import base64
import hashlib

import public_tokenizers
import pytest

from webloom.llm import ann, bpe, langid, lm, mixing, neardup, quality_clf, quality_rules, toxicity, warc
from webloom.llm.queries import RANK_FILE

LONG = "lorem ipsum " * 30_000
TEXTS = [None, "", " \n\t", "12 34 !!", "one two three four five six", "one two three four five six", LONG, "le chat est sur la table", "das ist ein Haus", "word", "é" * 5000, "a\x0bb\x1cc d"]
#: Extra columns with names that the operators use inside or return.
EXTRA = "score double, size long, n long, row long, set_key string, kept boolean, __fp string, word string, features string"
CLASH = (0.5, 7, 1, 2, "x", True, "y", "z", "f")
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def documents(spark, rows=None):
    if rows is None:
        langs = [None, "en", "en", "en", "en", "en", "la", "fr", "de", None, "fr", "en"]
        rows = [(i, t, lang, None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, (t, lang) in enumerate(zip(TEXTS, langs))]
        rows += [rows[4], (None, "no id here at all my friend", None, None, 5), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def labels(spark, rows=None):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(3, None, None), (None, 1, 1), (4, 0, 0)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


TINY_LM = lm.Settings(head=5, words=3, sample_docs=5, epochs=1, streams=2, window=2, classes=2, hidden=4)
OPERATORS = {
    "toxicity": lambda d, lab: toxicity.score(d, toxicity.fit(d, lab)),
    "bpe": lambda d, lab: bpe.round_trip_digests(d, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN),
    "mixing": lambda d, lab: mixing.mix_counts(d),
    "neardup": lambda d, lab: neardup.near_duplicates(d),
    "langid": lambda d, lab: langid.predict(d, langid.fit(d)),
    "quality_rules": lambda d, lab: quality_rules.judge(d),
    "lm": lambda d, lab: lm.score(d, *lm.fit(d, TINY_LM)),
    "quality_clf": lambda d, lab: quality_clf.score(d, quality_clf.fit(d, lab)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = documents(spark)
    rows = OPERATORS[name](docs, labels(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None) == sorted((False, r.doc_id) for r in docs.collect() if r.doc_id is not None)
    assert len(rows) == docs.count()
    twins = [tuple(v for k, v in r.asDict().items() if k != "taken") for r in rows if r.doc_id == 4]
    assert len(twins) == 2 and twins[0] == twins[1]
    for r in rows:
        if "score" in r.asDict() and name != "lm":
            assert 0 <= r.score <= 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    out = OPERATORS[name](documents(spark, []), labels(spark, []))
    assert out.count() == 0 and "doc_id" in out.columns


@pytest.mark.parametrize("name", ["toxicity", "quality_clf"])
def test_no_labels(spark, name):
    docs = documents(spark)
    assert len({r.score for r in OPERATORS[name](docs, labels(spark, [])).collect()}) == 1


def test_meaning_of_odd_rows(spark):
    docs = documents(spark)
    by_id = lambda rows: {r.doc_id: r for r in rows.collect()}
    lang = by_id(OPERATORS["langid"](docs, None))
    assert all(lang[i].lang_pred == "und" and lang[i].score == 0 for i in (0, 1, 2, 3)) and lang[9].lang_pred != "und"
    near = by_id(OPERATORS["neardup"](docs, None))
    assert (near[5].component_id, near[5].kept, near[4].n_shingles) == (4, False, 3)
    assert all(near[i].n_shingles == 0 and near[i].kept for i in (0, 1, 2)) and near[9].n_shingles == 1
    rules = by_id(OPERATORS["quality_rules"](docs, None))
    assert (rules[11].n_words, rules[11].word_chars, rules[0].n_words) == (2, 6, 0)
    assert rules[6].n_repeat_words == 60_000 and rules[6].base_failed
    tokens = by_id(OPERATORS["bpe"](docs, None))
    empty = hashlib.sha256(b"").hexdigest()
    assert tokens[0].n_tokens == 0 and tokens[0].ids_sha256 == tokens[1].decoded_sha256 == empty
    assert tokens[6].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    mixed = by_id(OPERATORS["mixing"](docs, None))
    assert mixed[0].size == mixed[0].taken == 0 and mixed[6].size == 60_000


def test_pieces_keep_columns(spark):
    docs = documents(spark)
    out = mixing.mix_pieces(docs)
    assert out.dtypes == docs.dtypes
    assert {r['__fp'] for r in out.collect()} == {"y"}
    assert mixing.mix_pieces(documents(spark, [])).count() == 0


PAGES = "page_id long, url string, html string, digest string, shard long"


def test_warc_odd_rows(spark):
    rows = [(1, "http://h/1", "same"), (5, "http://h/5 x\n", "same"), (3, None, "same"), (2, "http://h/2", None), (4, "http://h/4", ""), (7, "u", "é"), (7, "u", "é"), (None, "n", "same"), (None, "n", "lone"), (9, "u", "a\r\n\r\nb")]
    out = warc.archive_and_read(spark.createDataFrame([(*r, "d", 9) for r in rows], PAGES)).collect()
    assert len(out) == len(rows)
    got = sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out)
    assert got == sorted([(1, 4, "revisit", 5), (5, 4, "response", None), (3, 4, "revisit", 5), (2, 0, "revisit", 4), (4, 0, "response", None), (7, 2, "response", None), (7, 2, "revisit", 7), (-1, 4, "revisit", 5), (-1, 4, "response", None), (9, 6, "response", None)], key=lambda r: (r[0], r[1], r[2]))
    digests = {r.page_id: r.payload_digest for r in out}
    assert digests[9] == base64.b32encode(hashlib.sha1(b"a\r\n\r\nb").digest()).decode()
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_ann_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [0.5, 0.5]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0]), (40, []), (0, [0.5, 0.5])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [
        (0, 1, 1, 0.5), (0, 2, 7, 0.5), (0, 3, 20, 0.5), (0, 4, 8, -0.5),
        (20, 1, 1, 1.0), (20, 2, 0, 0.5), (20, 3, 7, 0.5), (20, 4, 8, -1.0),
    ]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
