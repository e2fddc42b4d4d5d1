"""Null columns, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from rtlake.llm import counts, fingerprints, language, lines, mixing, near, neighbours, pieces, quality, toxicity

LONG = " ".join(f"word{i % 7001}" for i in range(60_000))
ROWS = [
    (1, "the cat sat on the mat and slept", "en", "a"),
    (2, "the cat sat on the mat and slept", "en", "a"),
    (2, "the cat sat on the mat and slept", "en", "a"),
    (3, "", "en", None),
    (4, None, None, "b"),
    (5, LONG, "de", "b"),
    (None, "un chat dort sur le tapis", "fr", None),
    (6, "  \n\t ", "fr", ""),
    (7, "x", None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = ("size", "score", "words", "kept", "key", "value", "n", "node", "label", "hash", "place", "a", "b", "version", "target", "codes")


@pytest.fixture(params=["plain", "clashing"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(7) for c in EXTRA}) if request.param == "clashing" else df


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 8)] + [(None, 1, 1), (2, None, None), (3, 9, 9)], "doc_id long, quality int, toxic int")


def pairs(df, *columns):
    return sorted(((r["doc_id"],) + tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 6)} == {0}
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_takes_three_copies_at_most(spark):
    """A source at its cap has its rows without words three times as well."""
    rows = [(i, "w " * 400, "a") for i in range(8)] + [(100, "w", "b"), (101, None, "b"), (102, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = (1, 1000)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, weights).collect()}
    assert copies[100] == 3 and copies[101] <= 3 and copies[102] <= 3
    counts_ = {r["doc_id"]: r["count"] for r in mixing.mixed(docs, weights).groupBy("doc_id").count().collect()}
    assert counts_ == {i: n for i, n in copies.items() if n}


def test_fingerprints(docs, empty):
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by[1] == by[2] and by[3] == by[4] == by[6]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.fingerprints(empty).collect() == []
    assert len(fingerprints.fingerprints(docs.filter("doc_id = 5")).collect()) == 1


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(docs, empty, labels, module, label):
    model = module.train(docs, labels, label)
    rows = module.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    empties = {r["score"] for r in rows if r["doc_id"] in (3, 4)}
    assert len(empties) == 1
    assert module.score(empty, model).collect() == []
    module.score(docs, module.train(empty, labels, label)).collect()  # nothing to learn from: still a score for each


def test_pieces(docs, empty):
    rows = pieces.encode(docs).collect()
    assert len(rows) == len(ROWS) and all(r["parity"] and r["exact"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert pieces.encode(empty).collect() == []


def test_counts(docs, empty):
    edits = F.array(F.struct(F.lit(0).alias("at"), F.lit(3).alias("cut"), F.lit("new ").alias("put")), F.lit(None))
    rows = counts.update(counts.build(docs), edits).collect()
    counter = counts.Counter(*counts.default_vocabulary())
    assert len(rows) == len(ROWS)
    assert all(r["n_tokens"] == counts.Tree.of(r["text"], counter).tokens for r in rows)
    assert counts.update(counts.build(empty), edits).collect() == []


def test_language(docs, empty):
    model = language.train(docs)
    rows = language.identify(language.of_documents(docs), model).collect()
    assert len(rows) == len(ROWS)
    assert not any(r["accepted"] for r in rows if r["doc_id"] in (3, 4, 6))
    assert language.identify(language.of_documents(empty), model).collect() == []
    assert all(r["language"] is None for r in language.identify(language.of_documents(docs), language.train(empty)).collect())


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://h.example.fr/fr/1", ""), (None, "not an address", "<html lang=fr><p>le chat")], "page_id long, url string, html string")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert len(language.identify(language.of_pages(pages), language.train(docs)).collect()) == 3


def test_lines(docs, empty):
    rows = lines.dedup(docs)
    assert rows.count() == len(ROWS)
    assert set(docs.columns) <= set(rows.columns)
    by = pairs(rows, "text")
    assert (1, "the cat sat on the mat and slept") in by and (2, "") in by and (4, None) in by and (3, "") in by
    assert lines.dedup(empty).collect() == []


def test_near(docs, empty):
    rows = near.linked(docs)
    assert pairs(rows, "component_id", "kept") == sorted(
        [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (None, None, True)], key=repr
    )
    assert near.linked(empty).collect() == []


def test_neighbours(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, i / 10]) for i in range(30)] + [(30, None), (31, [0.0, 0.0]), (32, [1.0, None]), (33, [nan, 1.0]), (34, [inf, 1.0]), (35, [1.0]), (None, [1.0, 2.0]), (40, [1.0, 2.9]), (60, [])]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(7) for c in EXTRA}))
    found = neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"), k=5).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40}
    top = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 20)
    assert top == [(1, 29), (2, 40), (3, 28), (4, 27), (5, 26)]  # equal vectors: the smaller id first
    none = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.search(none, none).collect() == []
    twice = neighbours.usable(spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 1.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>"))
    found = neighbours.search(twice, twice.filter("vec_id = 20")).collect()  # each row is a query and a candidate of its own
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 2, 2.0), (1, 2, 3.0), (2, 2, 2.0), (2, 2, 3.0), (3, 20, 1.0), (3, 20, 1.0)]
    few = vectors.filter("vec_id < 4")
    assert neighbours.search(few, few.filter("vec_id = 0")).count() == 3


def test_pipeline_run(spark):
    """All stages over a whole table: what stays is there, no two rows with one text but those the mix repeats, and only the last folder is left."""
    import os

    import corpus_pipeline
    from rtlake.llm.common import checkpoint_folder

    folder = checkpoint_folder(spark).removeprefix("file:")
    had = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    (made,) = [x for x in set(os.listdir(folder)) - had if x.startswith("pipeline-")]
    assert os.listdir(f"{folder}/{made}") == [str(len(corpus_pipeline.STAGES) - 1)]
    ids = {r["doc_id"] for r in rows}
    assert 20 < len(ids) <= 200 and all(r["exact"] and r["parity"] for r in rows)
    tokens = {}
    for r in rows:
        tokens.setdefault(tuple(r["token_ids"]), set()).add(r["doc_id"])
    assert all(len(x) == 1 for t, x in tokens.items() if len(t) > 40)


def test_stages(docs, empty, spark):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, ""), stage(spark, empty, "")
        out.collect()
        assert none.collect() == []
        if stage is not corpus_pipeline.encode_pieces:
            assert out.columns == docs.columns
