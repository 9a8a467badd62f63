"""The pipeline's line stage on small sources and on sources with copies."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm.common import documents
from sessionloom.llm.lines import drop_boilerplate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, len(t)) for k, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("pages", [20, 35, 49])
def test_small_sources_keep_their_lines(spark, pages):
    texts = [f"menu of the site\nown line {k} of this page\nshared by two {k // 2}" for k in range(pages)]
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame(spark, texts), "").collect()}
    assert left == {k: f"own line {k} of this page\nshared by two {k // 2}" for k in range(pages)}


@pytest.mark.parametrize("pages", [2, 5, 20, 30, 49])
def test_defaults_keep_what_stands_on_one_page_or_two(spark, pages):
    texts = [f"menu of the site\nown line {k} of this page\nshared by two {k // 2}" for k in range(pages)]
    done = drop_boilerplate(frame(spark, texts), F.col("source"), F.col("text")).collect()
    menu = "" if pages >= 3 else "menu of the site\n"
    assert {r.row.doc_id: r.text for r in done} == {k: f"{menu}own line {k} of this page\nshared by two {k // 2}" for k in range(pages)}


def test_texts_of_one_id_all_stay(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(40)) for w in ("lake", "hill", "road"))
    rows = [(1, one), (1, two), (2, three), (2, three), (3, three), (None, "a text without an id that is only here"), (None, two), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, one), (1, two), (2, three), (None, "a text without an id that is only here"), (4, "")], key=str)


def test_no_text_is_lost_at_a_hundredth(spark):
    folder = "/root/testdata/sf0.01"
    docs = documents(spark, folder)
    before = {r.doc_id: r for r in docs.collect()}
    pages, held = Counter(r.source for r in before.values()), Counter()
    for r in before.values():
        held.update({(r.source, x.strip(" ")) for x in r.text.split("\n")})
    dropped = 0
    after = corpus_pipeline.lines(spark, docs, folder).collect()
    assert len(after) == len(before)
    for r in after:
        lines, left = before[r.doc_id].text.split("\n"), Counter(r.text.split("\n"))
        gone = [x for x in lines if not left.subtract([x]) and left[x] < 0]
        assert all(held[r.source, x.strip(" ")] >= max(3, corpus_pipeline.BOILERPLATE_RATIO * pages[r.source]) for x in gone)
        assert r.text.strip() or not before[r.doc_id].text.strip()
        dropped += len(gone)
    assert 0 < dropped < 0.1 * sum(len(r.text.split("\n")) for r in before.values())


def words(draw, n):
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("near", [False, True])
@pytest.mark.parametrize("lines", [2, 12])
def test_one_of_a_large_group_of_copies_stays(spark, near, lines):
    """A third of a source are copies, near ones with one word of one line changed; every document has the menu."""
    draw = random.Random(7)
    copied = [words(draw, 120 // lines) for _ in range(lines)]
    texts = []
    for k in range(90):
        own = [words(draw, 12) for _ in range(5)]
        if k % 3 == 1:
            own = list(copied)
            if near:
                at = draw.randrange(lines)
                parts = own[at].split(" ")
                parts[draw.randrange(len(parts))] = f"edit{k}"
                own[at] = " ".join(parts)
        texts.append("\n".join(["home about contact", *own]))
    docs = frame(spark, texts)
    left = corpus_pipeline.lines(spark, docs, "").cache()
    bare = {k: t.split("\n", 1)[1] for k, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in left.collect()} == bare
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_copies(spark, left, "").collect()}
    assert kept == {k: bare[k] for k in range(90) if k % 3 != 1 or k == 1}
