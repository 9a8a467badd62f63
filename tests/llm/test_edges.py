"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import fingerprints, language, licenses, lines, mixing, neardup, pieces, quality, substrings, vectors
from sessionloom.llm.common import Scratch

WORDS = "the cat sat on a mat and the dog ran to the old red barn by a river with many small grey birds in it".split()
LONG = " ".join(WORDS[(k * k + 3 * k) % len(WORDS)] + str(k % 97) for k in range(60_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the dog for a while", "en", "a"),
    (1, "the cat sat on the mat and looked at the dog for a while", "en", "a"),
    (2, "", "en", "a"),
    (3, None, "en", "b"),
    (4, LONG, "en", "b"),
    (5, "der Hund lief schnell und weit über das grüne Feld", "de", None),
    (None, "a text without an id", None, "b"),
    (6, " \n\t\n ", None, None),
    (7, "Ünïcödé 漢字 😀   line", "de", "a"),
    (8, "ok", None, "a"),
    (8, "another text of the same id", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = ("row", "site", "s", "t", "key", "ka", "kb", "k1", "label", "score", "block", "tokens", "line", "n", "id", "__kept")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return frame.select("*", *[F.lit(f"x{k}").alias(name) for k, name in enumerate(EXTRA)]).cache()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, None), (7, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


@pytest.fixture(scope="module")
def empty(spark, docs, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    docs.limit(0).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


QUERIES = {
    "op2": language.op2_language, "op3": neardup.op3_near_duplicates, "op5": fingerprints.op5_fingerprints, "op6": pieces.op6_pieces,
    "op7": substrings.op7_substrings, "op8": licenses.op8_licenses, "op10": quality.op10_quality,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_document(spark, folder, empty, name):
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    twice = [tuple(r) for r in rows if r.doc_id == 1]
    assert twice[0] == twice[1]
    assert QUERIES[name](spark, empty).count() == 0


def test_language_of_odd_texts(spark, folder):
    found = {}
    for r in language.op2_language(spark, folder).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert {found[k][0].lang_pred for k in (2, 3, 6)} == {"und"}
    assert all(r.lang_pred in ("en", "de") and 0 <= r.score <= 1 for k in (1, 4, 5, 7, 8) for r in found[k])


def test_near_duplicates_of_odd_texts(spark, folder):
    rows = neardup.op3_near_duplicates(spark, folder).collect()
    assert {r.n_shingles for r in rows if r.doc_id in (2, 3, 6)} == {0}
    assert [r.component_id for r in rows if r.doc_id == 1] == [1, 1]
    assert all(r.kept for r in rows)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_scores_of_odd_texts(spark, folder):
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in quality.op10_quality(spark, folder).collect())


def test_lines(spark):
    rows = [(k, "same line\nonly %d" % k, "a") for k in range(30)] + [(90, None, "a"), (91, "same line", "b"), (92, "\n\n", None), (93, " same line \nx", "a")]
    frame = spark.createDataFrame(rows, "id int, text string, row string")
    done = {r["row"]["id"]: r for r in lines.drop_boilerplate(frame, F.col("row"), F.col("text"), 0.5).collect()}
    assert done[3]["text"] == "only 3" and done[3]["n_lines"] == 2 and done[3]["n_dropped"] == 1
    assert done[90]["text"] is None and done[91]["text"] == "same line" and done[92]["text"] == "\n\n" and done[93]["text"] == "x"
    assert lines.drop_boilerplate(frame.limit(0), F.col("row"), F.col("text")).count() == 0


def test_mixing_keeps_every_row_and_its_columns(spark, docs):
    mixed = mixing.mix(docs, F.col("source"), F.col("text"), Scratch(spark, "t")).select("row.*")
    assert mixed.columns == docs.columns
    assert {(r.doc_id, r.text) for r in mixed.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    assert mixing.mix(docs.limit(0), F.col("source"), F.col("text"), Scratch(spark, "t")).count() == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, []), (8, [1.0]),
            (None, [1.0, 0.0]), (9, [0.0, 1e-30]), (10, [0.0, 1e30]), (11, [1.0, None])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("id", F.lit(7))
    found = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame, fragment_rows=2).collect()))
    assert found == [(0, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *[(k, 0, k, True) for k in range(3, 9)], (9, 1, 9, True), (10, 1, 9, False), (11, 0, 11, True)]
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_stages_keep_columns(spark, docs, folder, empty):
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.columns == docs.columns
        result.collect()
        assert stage(spark, docs.limit(0), empty).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0
