"""The stages of the pipeline on the smallest tables and on odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from plumetrics.llm import mixing, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(frame):
    rows = [(1, "one two three four", "en", "a", 18), (1, "one two three four", "en", "a", 18), (2, "one two three four", "en", "a", 18),
            (3, None, None, None, 0), (4, "", "en", None, 0), (4, "another text entirely here", None, "b", 26), (None, "third text of this kind", "en", "b", 23),
            (5, "token: abcdefgh12 and words", "en", "a", 27)]
    return frame(rows, SCHEMA).repartition(3)


def test_language_keeps_what_has_letters(spark, odd, sf_dir):
    got = cp.language(spark, odd, sf_dir)
    assert got.columns == list(cp.COLUMNS)
    assert Counter(r["doc_id"] for r in got.collect()) == {1: 2, 2: 1, 4: 1, None: 1, 5: 1}


def test_language_without_profiles(spark, odd, tmp_path):
    # Documents of the training part alone are learned from: those that no profile can come of keep their own lang.
    unlabelled = odd.withColumn("lang", F.when(cp.fold("doc_id", 4) == 2, F.col("lang")))
    own = {(r["doc_id"], r["text"]): r["lang"] for r in unlabelled.collect()}
    got = cp.language(spark, unlabelled, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 2, 2: 1, 4: 1, None: 1, 5: 1}
    assert all(r["lang"] == own[r["doc_id"], r["text"]] for r in got)


def test_language_learns_from_the_documents_it_is_given(spark, frame, tmp_path):
    words = {"aa": "kala mela tola rina", "bb": "gurf strop krind blanz"}
    docs = frame([(i, f"{words[k]} {i}", k, "s", 20) for i in range(40) for k in words], SCHEMA)
    got = cp.language(spark, docs.withColumn("lang", F.when(F.col("doc_id") > 1, F.col("lang"))), str(tmp_path)).collect()
    assert {(r["text"][:4], r["lang"]) for r in got} == {("kala", "aa"), ("gurf", "bb")} and len(got) == 80


def test_near_duplicates_keep_one_of_each(spark, odd, sf_dir):
    got = cp.near_duplicates(spark, odd, sf_dir).collect()
    # The two texts without words are one group; its smallest id is 3.
    assert Counter((r["doc_id"], r["text"]) for r in got) == {
        (1, "one two three four"): 1, (3, None): 1, (4, "another text entirely here"): 1,
        (None, "third text of this kind"): 1, (5, "token: abcdefgh12 and words"): 1}


def test_secrets_are_replaced(spark, odd, sf_dir):
    got = cp.secrets(spark, odd, sf_dir).collect()
    assert len(got) == 8 and {r["doc_id"]: (r["text"], r["n_chars"]) for r in got}[5] == ("[SECRET] and words", 18)
    assert sum(r["text"] == "one two three four" for r in got) == 3 and sum(r["text"] is None for r in got) == 1


def test_mixture_repeats_rows(spark, odd, sf_dir):
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in cp.mixture(spark, odd, sf_dir).collect())
    # As often as the operator takes a document; both copies of an equal row count.
    want = Counter()
    for r in mixing.mix(odd, carry=["text", "source"]).collect():
        want[r["doc_id"], r["text"], r["source"]] += r["copies"]
    # The two equal rows may change places, but not in what they sum up to.
    assert got == +want
    # By hand: sources a, b, null have 16, 9 and 0 words, weights 5, 2, 1, so targets 18, 7 and 0 or their stops.
    words = Counter()
    for (_, text, source), n in got.items():
        words[source] += n * len((text or "").split())
    total = 4 * 4 + 4 + 9
    assert words[None] == 0 and abs(words["a"] + words["b"] - total) <= 8


CLASHING = ("_row", "_id", "_key", "_at", "_copy", "_lang", "_score", "_clean", "found", "blob", "size", "group", "copies", "target")


def test_columns_that_clash_are_left_out(spark, odd, sf_dir):
    wide = odd
    for name in CLASHING:
        wide = wide.withColumn(name, F.lit("other"))
    for name, stage in cp.STAGES:
        plain, got = (Counter(map(tuple, stage(spark, df, sf_dir).drop("sequence_id", "offset").collect())) for df in (odd, wide))
        assert got == plain, name


def test_empty(spark, odd, sf_dir):
    for name, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).collect() == [], name


def test_run(spark, sf_dir):
    docs = cp.table(spark, sf_dir, "documents")
    for name, stage in cp.STAGES[:-1]:
        docs = cp.cut_lineage(stage(spark, docs, sf_dir), name)
        assert docs.columns == list(cp.COLUMNS) and docs.count() > 0
        if name == "secrets":
            assert secret_scan.scan(docs).filter("size(found) > 0").count() == 0
    pieces = cp.packed(spark, docs, sf_dir)
    assert pieces.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
    assert pieces.filter("piece = 0").count() == docs.count()
    assert cp.run(spark, sf_dir).count() == pieces.count()
