"""The corpus pipeline: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import Scratch, documents
from sessionloom.llm.lines import drop_boilerplate
from sessionloom.llm.mixing import mix
from sessionloom.llm.neardup import near_duplicates
from sessionloom.llm.pieces import model_path, tokens
from sessionloom.llm.quality import learn, score_column

REJECT_BELOW = 0.5
BOILERPLATE_RATIO = 0.02
BOILERPLATE_LEAST = 3  # documents that hold a line; 2 % of a small source is less than one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from all labelled documents of the corpus."""
    model = learn(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score_column(model, F.col("text")) >= REJECT_BELOW)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source. Copies, which are still there, do not make a line boilerplate."""
    scratch = Scratch(spark, "lines")
    done = drop_boilerplate(docs, F.col("source"), F.col("text"), BOILERPLATE_RATIO, least=BOILERPLATE_LEAST, scratch=scratch)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id. Of rows equal in id and text one stays.

    A further text of an id is a document of its own, and so is a text without an id: their keys are hashes above all usual
    ids, those without an id last."""
    scratch = Scratch(spark, "copies")
    rows = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64(F.lit(5), F.coalesce("text", F.lit(""))).alias("mark"), F.struct("*").alias("row"))
    several = rows.groupBy("own_id").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first <> last AND own_id IS NOT NULL")
    several = scratch.keep(several.select(F.col("own_id").alias("several"), "first"), "several")
    other = F.xxhash64("own_id", "mark").bitwiseAND(F.lit((1 << 61) - 1)) + F.when(F.col("own_id").isNull(), F.lit(1 << 62)).otherwise(F.lit(1 << 61))
    further = F.col("own_id").isNull() | (F.col("mark") != F.coalesce("first", "mark"))
    keyed = rows.join(several, F.col("own_id") == F.col("several"), "left").select(F.when(further, other).otherwise(F.col("own_id").cast("long")).alias("key"), "row")
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return keyed.join(kept, F.col("key") == F.col("kept_id")).dropDuplicates(["key"]).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources up to twice, so that sources come closer to equal weights."""
    return mix(docs, F.col("source"), F.col("text"), Scratch(spark, "mixing")).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, as digest and count, with the digest of the text they decode to."""
    return tokens(docs, model_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]
ORACLE_SQL = None  # the classifier and the encoder have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; every stage's rows are written once."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
