"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs.

Paragraphs are lines, the leaves of the tree. A section ends with a paragraph whose digest begins with 0 or 1, one in eight.
A section's digest is taken over its paragraphs', the root over the sections'; all digests of the tree are whole, 128 bits, so
equal roots mean equal texts. Where roots differ, only sections with different digests need a look, and in them only
paragraphs with different digests.

A fingerprint is the root followed by a sketch for likeness: short digests of pieces, paragraph by paragraph. A piece ends where
a word ends in one of a few letters or marks, or after some characters of scripts without spaces, so a change moves no other
border. Likeness of two fingerprints is the share of piece digests they have in common: twice the common ones over the
sum of both, where a digest counts as often as it stands in both. Pieces' digests are short, so two texts in 2^32 of one
piece seem alike; their roots still differ.

Everything here is column expressions. Defined results: null is the empty text, which has one empty paragraph and no
piece. Two texts without pieces are alike exactly when they are equal. In the order for "next document" a null id
comes last and rows with one id are ordered by a hash of their text; equal rows count once there and get equal
results. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import Scratch

# Marks of East Asian scripts, a few frequent kana, one ideograph in eight, the vowels that begin a Thai syllable.
_ENDERS = r"\x{3001}\x{3002}\x{ff01}\x{ff0c}\x{ff1a}\x{ff1b}\x{ff1f}\x{304c}\x{306b}\x{306e}\x{306f}\x{3092}\x{4e00}-\x{58ff}\x{0e40}-\x{0e44}"
PIECE = rf"(?s).*?(?:[nsNS.,!?;:][ \t]+|[{_ENDERS}])|.+\z"
SECTION = r"(?:[2-9a-f][0-9a-f]{31} )*[01][0-9a-f]{31} |(?:[2-9a-f][0-9a-f]{31} )+"


def _short(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def pieces(text: Column) -> Column:
    """Short piece digests of each paragraph, joined to one string per paragraph."""
    return F.transform(_lines(text), lambda line: F.array_join(F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), _short), ""))


def paragraphs(text: Column) -> Column:
    """Digests of the paragraphs."""
    return F.transform(_lines(text), lambda line: F.md5(line.cast("binary")))


def sections(text: Column) -> Column:
    """Section digests: runs of paragraph digests, cut by their content."""
    joined = F.concat(F.array_join(paragraphs(text), " "), F.lit(" "))
    return F.transform(F.regexp_extract_all(joined, F.lit(SECTION), F.lit(0)), lambda s: F.md5(s.cast("binary")))


def root(text: Column) -> Column:
    return F.md5(F.array_join(sections(text), " ").cast("binary"))


def fingerprint(text: Column, leaves: Column | None = None) -> Column:
    """Root, then the pieces (`leaves`, where they are known)."""
    return F.concat(root(text), F.lit(":"), F.array_join(pieces(text) if leaves is None else leaves, "/"))


def _counted(joined: Column) -> Column:
    """Digests of a joined string, each with the number of times it has come before, so that sets count copies.

    Sorted, equal digests are one run, which a back reference takes at once."""
    ordered = F.sort_array(F.regexp_extract_all(joined, F.lit("[0-9a-f]{8}"), F.lit(0)))
    runs = F.regexp_extract_all(F.concat(F.array_join(ordered, " "), F.lit(" ")), F.lit(r"([0-9a-f]{8} )\1*"), F.lit(0))
    tagged = lambda r: F.transform(F.sequence(F.lit(1), F.floor(F.length(r) / 9)), lambda k: F.concat(F.substring(r, 1, 9), k.cast("string")))
    return F.flatten(F.transform(runs, tagged))


def likeness(one: Column, two: Column) -> Column:
    """Share of pieces in common, of two arrays of counted digests."""
    whole = F.size(one) + F.size(two)
    return F.when(whole == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(one, two)) / whole)


def fingerprint_likeness(one: Column, two: Column) -> Column:
    """Likeness of two fingerprint strings, 0 to 1; equal roots are alike whatever their pieces."""
    parts = [_counted(F.substr(f, F.lit(34))) for f in (one, two)]
    same = F.substring(one, 1, 32) == F.substring(two, 1, 32)
    return F.when(same, F.lit(1.0)).when(F.size(parts[0]) + F.size(parts[1]) == 0, F.lit(0.0)).otherwise(likeness(*parts))


def changed_paragraphs(one: Column, two: Column) -> Column:
    """Numbers (from 0) of paragraphs of the second text whose digest the first one lacks.

    Equal roots need no look below."""
    old, new = paragraphs(one), paragraphs(two)
    fresh = F.array_except(new, old)
    numbered = F.filter(F.transform(new, lambda p, k: F.when(F.array_contains(fresh, p), k)), lambda k: k.isNotNull())
    return F.when(root(one) == root(two), F.array().cast("array<int>")).otherwise(numbered)


def next_documents(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, t1, t2, need): each distinct row, the row it follows (whose next it is) and a third of that row's length.

    Rows are dealt by ranges of the order; only the first row of each range crosses a border, one per partition."""
    place = [F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("turned"), "k1", "k2"]
    rows = keyed.groupBy("doc_id", "k1", "k2").agg(F.max("n_chars").alias("n"))
    dealt = rows.select(*place, "n").repartitionByRange(*[c if isinstance(c, str) else c for c in ("no_id", "turned", "k1", "k2")])
    dealt = scratch.keep(dealt.withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy("no_id", "turned", "k1", "k2")
    here = F.struct("k1", "k2")
    firsts = dealt.groupBy("part").agg(F.min(F.struct("no_id", "turned", "k1", "k2")).alias("f")).select("part", F.struct("f.k1", "f.k2").alias("f"))
    border = firsts.select(
        "part", F.coalesce(F.lead("f").over(Window.orderBy("part")), F.first("f").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))).alias("across")
    )
    linked = dealt.withColumn("next", F.lead(here).over(inside)).join(border, "part").withColumn("next", F.coalesce("next", "across"))
    return linked.select(F.col("next.k1").alias("k1"), F.col("next.k2").alias("k2"), F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.floor(F.col("n") / 3).cast("int").alias("need"))


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced by the next document's beginning."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scratch = Scratch(spark, "fingerprints")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = [F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), text]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(7), *whole).alias("k2"), text.alias("text"))
    chain = scratch.keep(next_documents(keyed.select("doc_id", "k1", "k2", F.length("text").alias("n_chars")), scratch), "chain")
    # Each row sends the beginning that is asked for and its piece digests, as bytes, to the row before it. Both joins
    # read the same columns of the documents, so that texts are shuffled once.
    sent = keyed.join(chain, ["k1", "k2"]).select(
        F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.col("doc_id").alias("next_id"), F.substring("text", F.lit(1), F.col("need")).alias("head"),
        F.unhex(F.array_join(pieces(F.col("text")), "")).alias("next_pieces"),
    ).dropDuplicates(["k1", "k2"])
    length = F.length("text")
    met = keyed.join(sent, ["k1", "k2"]).withColumn("n_chars", length.cast("long"))
    third = F.floor(length / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - third), F.col("head"))
    # Trees are taken once each, behind a generator, so that they are not substituted into every use.
    trees = met.select(
        "doc_id", "n_chars", "next_id", "next_pieces", F.explode(F.array(F.struct(root(F.col("text")).alias("root"), pieces(F.col("text")).alias("own"), edited.alias("edited")))).alias("x")
    ).select("doc_id", "n_chars", "next_id", "next_pieces", "x.root", "x.own", "x.edited")
    trees = trees.select("*", F.explode(F.array(pieces(F.col("edited")))).alias("new"))
    sets = [_counted(F.array_join("own", "")).alias("a"), _counted(F.array_join("new", "")).alias("b"), _counted(F.lower(F.hex("next_pieces"))).alias("c")]
    trees = trees.select("doc_id", "n_chars", "next_id", "root", "own", "new", "edited", F.explode(F.array(F.struct(*sets))).alias("s"))
    own, new, following = (F.col(f"s.{x}") for x in "abc")
    marks = trees.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.concat("root", F.lit(":"), F.array_join("own", "/")).alias("fingerprint"),
                         fingerprint(F.col("edited"), F.col("new")).alias("edited_fingerprint"), likeness(own, new).alias("near_edited"), likeness(own, following).alias("near_next"), F.col("next_id").alias("next_doc_id"))
    same = F.col("fingerprint") == F.col("edited_fingerprint")
    empty = F.length("fingerprint") + F.length("edited_fingerprint") == 66
    return marks.withColumn("near_edited", F.when(same, F.lit(1.0)).when(empty, F.lit(0.0)).otherwise(F.col("near_edited")))


def _sql_pieces(text: str) -> str:
    piece = PIECE.replace("'", "''")
    return (f"list_transform(string_split({text}, chr(10)), lambda line: array_to_string(list_transform("
            f"regexp_extract_all(line, '{piece}'), lambda p: md5(p)[1:8]), ''))")


def _sql_fingerprint(text: str, leaves: str) -> str:
    digests = f"array_to_string(list_transform(string_split({text}, chr(10)), lambda p: md5(p)), ' ') || ' '"
    parts = f"list_transform(regexp_extract_all({digests}, '{SECTION}'), lambda s: md5(s))"
    return f"md5(array_to_string({parts}, ' ')) || ':' || array_to_string({leaves}, '/')"


def _sql_all(leaves: str) -> str:
    return f"regexp_extract_all(array_to_string({leaves}, ''), '[0-9a-f]{{8}}')"


def _sql_likeness(one: str, two: str) -> str:
    common = (f"coalesce(list_sum(list_transform(list_distinct({one}), lambda k: "
              f"least(len(list_filter({one}, lambda y: y = k)), len(list_filter({two}, lambda z: z = k))))), 0)")
    return f"CASE WHEN len({one}) + len({two}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {common} / (len({one}) + len({two})) END"


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_doc_id,
             coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS x FROM d),
e AS (SELECT doc_id, next_doc_id, n, t, x, left(t, n - n // 3) || left(x, n // 3) AS edited FROM n),
p AS (SELECT doc_id, next_doc_id, n, t, edited, {_sql_pieces('t')} AS a, {_sql_pieces('edited')} AS b, {_sql_pieces('x')} AS c FROM e),
f AS (SELECT *, {_sql_fingerprint('t', 'a')} AS fa, {_sql_fingerprint('edited', 'b')} AS fb, {_sql_all('a')} AS sa, {_sql_all('b')} AS sb, {_sql_all('c')} AS sc FROM p)
SELECT doc_id, next_doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       CASE WHEN fa = fb THEN 1.0 WHEN length(fa) + length(fb) = 66 THEN 0.0 ELSE {_sql_likeness('sa', 'sb')} END AS near_edited,
       {_sql_likeness('sa', 'sc')} AS near_next FROM f
"""
