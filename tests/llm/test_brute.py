"""Operators that SQL cannot express, against plain versions of them."""

import hashlib
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import fingerprints, language, lines, mixing, pieces, quality, substrings, vectors
from sessionloom.llm.common import Scratch

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def repeats(held, length=200):
    seen = Counter(t[i : i + length] for t in held for i in range(len(t) - length + 1))
    for t in held:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest()


@pytest.mark.parametrize("bucket_rows", [4096, 1])
def test_substrings(spark, bucket_rows):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abé ") for _ in range(draw.randint(1, 8)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    held = ["".join(draw.choice([word(), draw.choice(passage)[draw.randint(0, 40) :]]) for _ in range(draw.randint(1, 9))) for _ in range(80)]
    held += ["x" * 199, "x" * 200, "ab" * 300, "z" * 900, "", held[0], held[0]]
    frame = spark.createDataFrame(list(enumerate(held)), "doc_id int, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n, r.kept_sha256) for r in substrings.repeated_bytes(frame, bucket_rows).withColumn("n", F.size("spans")).collect()}
    assert found == dict(enumerate(repeats([t.encode() for t in held])))


def test_substrings_of_a_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    raw = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = substrings.Parts(raw, np.array([0, len(raw)]))
    cut = [(int(a) + k, int(f) + k, int(x) + k) for part, own, _, k in substrings.segments(raw, np.array([0, len(raw)])) for p in [substrings.Parts(part, own)] for a, f, x in zip(p.anchor, p.first, p.last, strict=True)]
    covered = sorted(s for a, f, x in cut for s in range(f, x + 1))
    assert covered == list(range(len(raw) - 199))
    assert {a for a, _, _ in cut} == set(whole.anchor.tolist())


def test_pieces_equal_the_library():
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.Pieces(pieces.model_path())
    draw = random.Random(2)
    pool = [*own.scores, *" \n\t▁é漢　\x00😀ab", "   ", "<s>", "<0x0A>", "</s>"]
    for k in range(3000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 12))) if k % 2 else "".join(draw.choice("aetin oshr  ▁é\n") for _ in range(draw.randint(0, 60)))
        ids = model.encode(text)
        n, joined, decoded = own.encode_decode(text)
        assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), model.decode(ids)), text
        assert own.decode(ids) == model.decode(ids)


def test_pieces_query(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in pieces.op6_pieces(spark, FOLDER).collect():
        ids = model.encode(texts[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids)))
    frame = spark.createDataFrame([(1, "Über café\n\tx"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pieces.tokens(frame, pieces.model_path(), ids=True).collect()}
    assert rows[1].ids == model.encode("Über café\n\tx") and rows[1].decoded == "Über café\n\tx" and rows[2].ids == []


def test_language_on_held_out_texts(spark, texts):
    rows = [r for r in language.op2_language(spark, FOLDER).collect() if r.held_out]
    assert len(rows) > 40
    assert statistics.mean(r.lang_pred == texts[r.doc_id].lang for r in rows) > 0.95


def test_more_languages_than_one_mask():
    rows = [(f"l{k:02d}", " ".join(f"{chr(0x4E00 + 40 * k + j)}{chr(0x4E00 + 40 * k + j + 1)}" for j in range(30))) for k in range(70)]
    masks = np.zeros((1 << 14, 2), np.uint64)
    for k, (_, text) in enumerate(rows):
        keys, _ = language.grams([text])
        for p in range(language.PROBES):
            at = (language.mix64(keys * language._PLACE[max(language.SIZES) + p]) % np.uint64(1 << 14)).astype(np.int64)
            masks[at, k // 64] |= np.uint64(1 << (k % 64))
    model = language.LanguageFilter([a for a, _ in rows], masks, np.zeros(70), np.full(70, 1 / 70))
    assert model.decide([t for _, t in rows])[0] == [a for a, _ in rows]


def test_quality_on_held_out_texts(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.op10_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 60
    assert statistics.mean(r.predicted == labels[r.doc_id] for r in rows) > 0.93


def test_discriminant_equals_densities(spark):
    draw = np.random.Generator(np.random.PCG64(8))
    width = len(quality.STATISTICS)
    values = {k: draw.normal(k, 1 + k, (400, width)) for k in (0, 1)}
    rows = [(v.tolist(), k) for k, m in values.items() for v in m]
    model = quality.fit(spark.createDataFrame(rows, "features array<double>, quality int"), shrink_pooled=0.0, shrink_identity=0.0)
    point = draw.normal(0.5, 1, (5, width))
    density = {}
    for k, m in values.items():
        cov = np.cov(m.T, bias=True)
        d = point - m.mean(axis=0)
        density[k] = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])
    assert np.allclose(model.log_odds(point), density[1] - density[0], atol=1e-5)


def test_weights_and_limits():
    shares = [0.7, 0.2, 0.1]
    exponent = mixing.exponent_for(shares, 1.0, None, True)
    assert abs(mixing.entropy(mixing._weights(shares, exponent)) - 1.0) < 1e-9
    exponent = mixing.exponent_for(shares, None, 3.0, True)
    assert exponent < 1e-9 or abs(mixing.repetition(shares, mixing._weights(shares, exponent), True) - 3.0) < 1e-6
    tight = mixing.exponent_for(shares, 1.09, 2.0, True)
    assert mixing.repetition(shares, mixing._weights(shares, tight), True) <= 2.0 + 1e-9


@pytest.mark.parametrize("budget", [None, 30_000.0, 300_000.0])
def test_mixing_meets_its_goals(spark, budget):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    mixed = mixing.mix(docs, F.col("source"), F.col("text"), Scratch(spark, "t"), limit=4.0, budget=budget, block_rows=8).collect()
    tokens = {r.doc_id: max(1, len((r.text or "").split())) for r in docs.collect()}
    own, got, passes = defaultdict(int), defaultdict(int), defaultdict(Counter)
    for r in docs.collect():
        own[r.source] += tokens[r.doc_id]
    for r in mixed:
        got[r.source] += r.tokens
        passes[r.source][r.row.doc_id] += 1
        assert r.tokens == tokens[r.row.doc_id]
    totals = spark.createDataFrame(list(own.items()), "source string, tokens long")
    for t in mixing.targets(totals, 0.5, 4.0, budget).collect():
        assert t.goal <= got[t.source] < t.goal + max(tokens.values())
        counts = Counter(passes[t.source].values())
        assert max(counts) - min(counts) <= 1  # whole passes and one part of a pass


def test_tree_finds_edits(spark):
    old = "First line here.\nSecond line there.\nThird one, too.\n" + "\n".join(f"line {k} stays as it was." for k in range(40))
    new = old.replace("line 20 stays", "line 20 moved")
    frame = spark.createDataFrame([(old, new), (old, old), ("", "")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = frame.select(
        fingerprints.changed_paragraphs(a, b).alias("changed"), fingerprints.fingerprint_likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)).alias("near"),
        F.size(F.array_except(fingerprints.sections(b), fingerprints.sections(a))).alias("sections"),
    ).collect()
    assert rows[0].changed == [23] and 0.9 < rows[0].near < 1 and rows[0].sections in (1, 2)
    assert rows[1].changed == [] and rows[1].near == 1.0 and rows[2].near == 1.0


def test_tree_of_many_equal_lines(spark):
    frame = spark.createDataFrame([("the same line again.\n" * 30_000,)], "a string")
    assert len(frame.select(fingerprints.fingerprint(F.col("a")).alias("f")).first().f) > 30_000


def test_unequal_texts_have_unequal_fingerprints(spark):
    """One-line texts, among them two whose digests agree in 32 bits; roots alone must differ."""
    lines_ = spark.range(400_000).select(F.concat(F.lit("Paragraph "), F.col("id").cast("string")).alias("t"))
    roots = lines_.select(F.substring(fingerprints.fingerprint(F.col("t")), 1, 32).alias("root"))
    assert roots.distinct().count() == 400_000
    pair = spark.createDataFrame([("Paragraph 11046", "Paragraph 187355")], "a string, b string")
    one, two = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    assert pair.select(one != two).first()[0]


def test_scripts_without_spaces_fall_into_pieces(spark):
    draw = random.Random(3)
    word = lambda: "".join(chr(draw.randint(0x4E00, 0x9FA0)) for _ in range(900))
    old, other = word(), word()
    frame = spark.createDataFrame([(old, old[:600] + other[:300], other)], "a string, b string, c string")
    near = lambda x, y: fingerprints.fingerprint_likeness(fingerprints.fingerprint(F.col(x)), fingerprints.fingerprint(F.col(y)))
    found = frame.select(near("a", "b").alias("edited"), near("a", "c").alias("other")).first()
    assert 0.5 < found.edited < 0.8 and found.other < 0.1


def test_vectors_in_small_fragments(spark):
    draw = np.random.Generator(np.random.PCG64(9))
    centre = draw.normal(size=(6, 16))
    points = np.concatenate([centre[draw.integers(0, 6, 150)] + draw.normal(size=(150, 16)) * 0.32, draw.normal(size=(50, 16))])
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(points))
    for _ in range(len(points)):
        label = np.minimum(label, np.where(linked, label, len(points)).min(axis=1))
    frame = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame, fragment_rows=64).collect()}
    assert found == {k: (int(linked[k].sum()), int(label[k])) for k in range(len(points))}


def test_line_stage_of_the_pipeline(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("source", F.lit("one"))
    held = Counter(line.strip(" ") for r in texts.values() for line in {x.strip(" ") for x in (r.text or "").split("\n")} if line)
    common = {line for line, n in held.items() if n > corpus_pipeline.BOILERPLATE_RATIO * len(texts)}
    assert common
    for r in corpus_pipeline.lines(spark, docs, FOLDER).collect():
        left = "\n".join(x for x in texts[r.doc_id].text.split("\n") if x.strip(" ") not in common)
        assert r.text == left and r.n_chars == len(left)
    assert corpus_pipeline.BOILERPLATE_RATIO * len(texts) >= lines.LEAST  # the ratio alone decides here


def test_pipeline_runs_its_stages(spark, texts):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    kept = {r.doc_id for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rejected = [d for d in labels if labels[d] == 0]
    assert sum(d in kept for d in rejected) <= 0.2 * len(rejected)
    assert len(kept) > 0.6 * len(texts) and len(rows) >= len(kept)


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_duplicates_by_any_number_of_stars(spark, monkeypatch, rounds):
    from oracle import difference
    from sessionloom.llm import neardup

    monkeypatch.setattr(neardup, "STAR_ROUNDS", rounds)
    assert difference(neardup.op3_near_duplicates(spark, FOLDER), FOLDER, neardup.OP3_SQL) is None


def test_components_in_one_task_and_in_many(spark, monkeypatch):
    from sessionloom.llm import components

    draw = random.Random(3)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(500, 560)] + [(900, 900 + k) for k in range(1, 200)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    for rows in (10**6, 10):
        monkeypatch.setattr(components, "ROWS_PER_TASK", rows)
        found = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()
        assert {r.id: r.label for r in found} == label and len(found) == len(label)
