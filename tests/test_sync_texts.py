"""Texts in an incremental run: which sessions publish theirs, and that none is shuffled to leave others out."""

from pyspark.sql import functions as F
from test_sync import world  # noqa: F401

from sessionloom.operators import package
from sessionloom.plans import incremental
from sessionloom.sources.store import current_bundles


def exchanged(rows):
    """Columns that the plan shuffles, one list per exchange."""
    plan, found = [rows._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(node.initialPlan())
            continue
        output, children = node.output(), node.children()
        if name == "Exchange":
            found.append([output.apply(i).name() for i in range(output.size())])
        plan.extend(children.apply(i) for i in range(children.size()))
    return found


def test_a_session_that_moved_is_left_out(spark, world):  # noqa: F811
    write, tick, plan, folder, tmp = world
    seen = plan.signatures

    def later():
        return seen().withColumn("size", F.col("size") + F.when(F.col("path").endswith("s2.jsonl"), 1).otherwise(0))

    object.__setattr__(plan, "signatures", later)
    tables = tick()
    assert {r.session: r.error for r in tables.errors.read().collect()} == {"s2": package.MOVED}
    held = current_bundles(tables.members.read())
    assert {(r.key.split("--")[-1], r.member_name) for r in held.collect()} == {
        ("s1.zip", "transcript.jsonl"), ("s1.zip", "tool-results/out.txt"), ("s1.zip", package.MANIFEST_MEMBER),
        ("agent-k.zip", "transcript.jsonl"), ("agent-k.zip", package.MANIFEST_MEMBER),
    }
    sizes = {r.key: r.n for r in held.groupBy("key").agg(F.sum(F.octet_length("content")).alias("n")).collect()}
    assert {r.object_key: r.bundle_bytes for r in tables.results.read().collect()} == sizes


def test_published_texts_are_copied_where_they_lie(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("session"), F.concat(F.lit("k"), "id").alias("key"), F.lit("t").alias("member_name"), F.repeat(F.lit("text "), 200).alias("text"))
    rows.write.parquet(f"{tmp_path}/members")
    rows.where("session = '7'").select("session").write.parquet(f"{tmp_path}/dropped")
    members, dropped = spark.read.parquet(f"{tmp_path}/members"), spark.read.parquet(f"{tmp_path}/dropped")
    described = members.select(F.col("session").alias("path"), "key", F.lit("{}").alias("manifest")).where("path <> '7'")
    made = package.bundle_members(described, members, dropped, 3)
    assert not any({"text", "content"} & set(columns) for columns in exchanged(made))
    assert made.groupBy("member_name").count().orderBy("member_name").collect() == [(package.MANIFEST_MEMBER, 199), ("t", 199)]
    assert made.where("key = 'k7'").count() == 0


def test_a_session_row_takes_no_text_through_a_join(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("app").alias("source"), F.repeat(F.lit("x"), 90).alias("text"))
    rows = incremental._described(incremental._path(docs))
    assert set(rows.columns) == {"path", "doc_id", "source", "first_message"}
    assert {len(r.first_message) for r in rows.collect()} == {20}
