"""Queries over secrets and personal identity in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import secrets as S
from sessionloom.functions.identity import redact_emails as emails
from sessionloom.functions.identity import redact_identity, redact_path_token, redact_text
from sessionloom.operators.spans import merge_span_rows
from sessionloom.plans.tables import table

# Checks need a known salt; real runs draw one with mocks.new_salt().
CHECK_SALT = bytes(range(16))
CHECK_USERS = ("widget", "bolt", "Bo")


def secret_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Spans by kind over all documents and pages."""
    docs = table(spark, folder, "documents").select(F.lit("documents").alias("origin"), "text")
    pages = table(spark, folder, "pages").select(F.lit("pages").alias("origin"), F.col("html").alias("text"))
    spans = docs.unionByName(pages).select(
        "origin", F.explode(S.span_records(F.col("text"), S.secret_spans(F.col("text")))).alias("s")
    )
    return spans.groupBy("origin", F.col("s.kind").alias("kind")).agg(
        F.count("*").alias("spans"), F.sum("s.original_length").alias("characters"), F.sum("s.start").alias("starts")
    )


def secret_markers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", S.mark_secrets(F.col("text")).alias("text"))


def redact_secrets(spark: SparkSession, folder: str) -> DataFrame:
    redacted = S.redact_secrets(F.col("text"), CHECK_SALT)
    return table(spark, folder, "documents").select("doc_id", redacted.alias("r")).select(
        "doc_id", F.col("r.text").alias("text"), F.size("r.spans").alias("secrets")
    )


def redact_emails(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, folder, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("origin", "id", emails(F.col("text")).alias("r")).select(
        "origin", "id", F.col("r.text").alias("text"), F.col("r.n").alias("emails")
    )


def redact_identity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a home path put before them; all three identity passes in order."""
    login = F.get(F.array(*[F.lit(x) for x in ("ubuntu", "alice", "ROOT", "bob.c", "ubuntu2")]), (F.col("doc_id") % 5).cast("int"))
    text = F.concat(F.lit("cd /home/"), login, F.lit("/x and widget_ or widget, not rebolt; "), F.col("text"))
    done = redact_identity(text, CHECK_USERS)
    return table(spark, folder, "documents").select("doc_id", done.alias("r")).select(
        "doc_id", F.col("r.text").alias("text"), F.col("r.n").alias("replacements")
    )


def redaction_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets and identity over whole documents: counts per source, as a bundle would record them."""
    done = redact_text(F.col("text"), CHECK_SALT, CHECK_USERS)
    return (
        table(spark, folder, "documents").select("source", done.alias("r"))
        .groupBy("source")
        .agg(F.sum("r.secrets").alias("secrets"), F.sum("r.identity").alias("identity"),
             F.sum(F.length("r.text")).alias("characters"))
    )


def path_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Dash-encoded project folders derived from parts."""
    part = table(spark, folder, "part")
    word = F.replace("p_name", F.lit(" "), F.lit("-"))
    shapes = F.array(F.concat(F.lit("-home-"), word), F.concat(F.lit("home-ubuntu-"), word), F.concat(F.lit("_project-home-"), word))
    token = F.get(shapes, (F.col("p_partkey") % 3).cast("int"))
    return part.select("p_partkey", redact_path_token(token).alias("r")).select(
        "p_partkey", F.col("r.text").alias("token"), F.col("r.n").alias("n")
    )


def span_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap merge over intervals derived from line items, one group per supplier."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("doc"),
        (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_orderkey")).cast("bigint").alias("start"),
        F.col("l_quantity").cast("bigint").alias("width"),
        F.col("l_linenumber").alias("ord"),
        F.concat_ws("-", F.col("l_returnflag"), F.col("l_linestatus")).alias("kind"),
        F.when(F.col("l_returnflag") == "A", 20).otherwise(10).alias("rank"),
    ).distinct()
    spans = rows.select("doc", "start", (F.col("start") + F.col("width")).alias("stop"), "ord", "kind", "rank")
    return merge_span_rows(spans, ["doc"])


QUERIES = {
    "secret_counts": secret_counts,
    "secret_markers": secret_markers,
    "redact_secrets": redact_secrets,
    "redact_emails": redact_emails,
    "redact_identity_counts": redact_identity_counts,
    "redaction_totals": redaction_totals,
    "path_tokens": path_tokens,
    "span_merge": span_merge,
}

_ASSIGNMENT = r"""(?i)((?:password|passwd|secret|token|api_key|apikey|access_key)\s*[=:]\s*["''])([^"'']{8,})(["''])"""
_EMAIL = r"(^|[^A-Za-z0-9._%+\-\\@])([A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24})"
_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _pads() -> tuple[str, str]:
    key = CHECK_SALT.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def _pieces(column: str, replacement: str) -> str:
    """Rebuild of a text from what lies between the matches, in DuckDB."""
    return f"""array_to_string(list_transform(range(1, len(gaps) + 1), lambda i:
        gaps[i] || CASE WHEN i <= len(secrets) THEN leads[i] || {replacement} || tails[i] ELSE '' END), '') AS {column}"""


_SPLIT = f"""
  s AS (SELECT *, regexp_split_to_array(text, '{_ASSIGNMENT}') AS gaps,
          regexp_extract_all(text, '{_ASSIGNMENT}', 1) AS leads,
          regexp_extract_all(text, '{_ASSIGNMENT}', 2) AS secrets,
          regexp_extract_all(text, '{_ASSIGNMENT}', 3) AS tails FROM src)"""

_INNER, _OUTER = _pads()
_MOCK = f"""('4d4f434b' || array_to_string(list_transform(range(0, 8), lambda j: substr('{_ALNUM}',
    (('0x' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('generic') || unhex('00') || encode(secrets[i])))),
      2 * j + 1, 2))::INTEGER % 62) + 1, 1)), ''))"""


def _emails(text: str) -> str:
    # Each pass consumes the boundary before an address, so neighbours need a second pass.
    return f"regexp_replace({text}, '{_EMAIL}', '\\1[EMAIL]', 'g')"


_LOGIN = "['ubuntu', 'alice', 'ROOT', 'bob.c', 'ubuntu2'][(doc_id % 5)::INTEGER + 1]"
_HOME = f"CASE WHEN doc_id % 5 IN (1, 3, 4) THEN '[USER]' ELSE {_LOGIN} END"
_WORD = r"(^|[^A-Za-z0-9_]){0}($|[^A-Za-z0-9_])"


def _bare(text: str, name: str) -> str:
    pattern = _WORD.format(name)
    once = f"regexp_replace({text}, '{pattern}', '\\1[USER]\\2', 'g')"
    return f"regexp_replace({once}, '{pattern}', '\\1[USER]\\2', 'g')"


_IDENTITY = f"""
  p AS (SELECT doc_id, source, 'cd /home/' || {_HOME} || '/x and widget_ or widget, not rebolt; ' || text AS t0,
               (doc_id % 5 IN (1, 3, 4))::INTEGER AS n0 FROM documents),
  e AS (SELECT *, {_emails('t0')} AS t1 FROM p),
  u AS (SELECT *, {_bare(_bare('t1', 'widget'), 'bolt')} AS t2 FROM e)"""

ORACLES = {
    "secret_counts": f"""
  WITH src AS (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'pages', html FROM pages), {_SPLIT},
  o AS (SELECT origin, unnest(range(1, len(secrets) + 1)) AS i, gaps, leads, secrets, tails FROM s)
  SELECT origin, 'generic' AS kind, count(*) AS spans, sum(length(secrets[i]))::BIGINT AS characters,
    sum(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(range(1, i), lambda k: length(leads[k]) + length(secrets[k]) + length(tails[k]))), 0)
        + length(leads[i]))::BIGINT AS starts
  FROM o GROUP BY 1""",
    "secret_markers": f"WITH src AS (SELECT * FROM documents), {_SPLIT} SELECT doc_id, {_pieces('text', chr(39) + '[SECRET:generic]' + chr(39))} FROM s",
    "redact_secrets": f"""WITH src AS (SELECT * FROM documents), {_SPLIT}
  SELECT doc_id, {_pieces('text', _MOCK)}, len(secrets)::INTEGER AS secrets FROM s""",
    "redact_emails": f"""
  WITH src AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages),
  r AS (SELECT *, {_emails('text')} AS done FROM src)
  SELECT origin, id, done AS text, len(regexp_extract_all(text, '{_EMAIL}'))::INTEGER AS emails FROM r""",
    "redact_identity_counts": f"""
  WITH {_IDENTITY}
  SELECT doc_id, t2 AS text, (n0 + len(regexp_extract_all(t0, '{_EMAIL}'))
    + (length(t2) - length(replace(t2, '[USER]', ''))) / 6 - n0)::INTEGER AS replacements FROM u""",
    "redaction_totals": f"""
  WITH src AS (SELECT * FROM documents), {_SPLIT},
  d AS (SELECT source, len(secrets) AS n, {_pieces('t0', _MOCK)} FROM s),
  e AS (SELECT *, {_emails('t0')} AS t1 FROM d),
  u AS (SELECT *, {_bare(_bare('t1', 'widget'), 'bolt')} AS t2 FROM e)
  SELECT source, sum(n)::BIGINT AS secrets,
    sum(len(regexp_extract_all(t0, '{_EMAIL}')) + (length(t2) - length(replace(t2, '[USER]', ''))) // 6)::BIGINT AS identity,
    sum(length(t2))::BIGINT AS characters FROM u GROUP BY source""",
    "path_tokens": r"""
  WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
  SELECT p_partkey,
    CASE p_partkey % 3 WHEN 0 THEN '-home-[USER]' || array_to_string(list_transform(w[2:], lambda x: '-' || x), '')
      WHEN 1 THEN 'home-ubuntu-' || array_to_string(w, '-') ELSE '_project-home-' || array_to_string(w, '-') END AS token,
    (p_partkey % 3 = 0)::INTEGER AS n FROM t""",
    "span_merge": """
  WITH r AS (SELECT DISTINCT l_suppkey AS doc, (l_partkey * 37 + l_linenumber * 11 + l_orderkey)::BIGINT AS start,
               l_quantity::BIGINT AS width, l_linenumber AS ord, l_returnflag || '-' || l_linestatus AS kind,
               CASE WHEN l_returnflag = 'A' THEN 20 ELSE 10 END AS rank FROM lineitem),
  s AS (SELECT *, start + width AS stop,
          row_number() OVER (PARTITION BY doc ORDER BY start, start + width DESC, ord, kind, rank) AS rn,
          max(start + width) OVER (PARTITION BY doc ORDER BY start, start + width DESC, ord, kind, rank
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY rn) AS island FROM s)
  SELECT doc, min(start) AS start, max(stop) AS stop, arg_max(kind, rank * 1000000000::BIGINT - rn) AS kind,
    max(stop) - min(start) AS original_length
  FROM i GROUP BY doc, island""",
}
