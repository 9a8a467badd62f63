"""Steps of a converted transcript: prompt origins and references to child transcripts.

Works on steps(session, step, source, message), tool_calls(session, step, call_id,
function_name) and tool_results(session, step, call_id, content, extra), where
content and extra are JSON or plain text. A session is a transcript path or id.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import variants as V
from sessionloom.functions.naming import bundle_name, transcript_id
from sessionloom.functions.text import collapse_whitespace, strip
from sessionloom.operators.joins import lookup

SUPPORTED_SOURCES = ("claude_code", "codex")
# Words of 64 bits in the filter of one session, at most: 128 KiB.
FILTER_WORDS = 1 << 14
# Result fields that name a child, compared without case and punctuation.
CHILD_FIELDS = (
    "agentid", "agentids", "childthreadid", "receiverthreadids", "sessionid", "sessionids", "threadid", "threadids",
)


def conversion_status(source: Column, error: Column | None = None) -> Column:
    """complete, failed or unsupported; a failure never removes the transcript itself."""
    failed = F.lit(None).cast("string") if error is None else error
    return (
        F.when(~source.isin(*SUPPORTED_SOURCES), "unsupported").when(failed.isNotNull(), "failed").otherwise("complete")
    )


def conversion_report(transcripts: DataFrame) -> DataFrame:
    """(session, status, error) per transcript with its source and conversion error, if any."""
    status = conversion_status(F.col("source"), F.col("error"))
    return transcripts.select("session", status.alias("status"), F.when(status == "failed", F.col("error")).alias("error"))


def header(source: Column, session_id: Column, parent: Column, launch_kind: Column) -> Column:
    """What is recorded once per trajectory."""
    return F.struct(
        transcript_id(source, session_id).alias("transcript_id"),
        transcript_id(source, F.nullif(parent, F.lit(""))).alias("parent_transcript_id"),
        launch_kind.alias("launch_kind"),
    )


# --- prompt origins -------------------------------------------------------

def prompt_origins(decoded: DataFrame) -> DataFrame:
    """(session, prompt, origin): how each prompt text was first submitted.

    The text is compared with whitespace collapsed; events without any marker
    say nothing. First in file order wins, found by a combining aggregate.
    """
    v = F.col("v")

    def scalar(path: str) -> Column:
        value = V.shown(V.field(v, path))
        return F.when(~value.isin("", "None", "False", "0"), value)

    marks = F.map_filter(
        F.create_map(
            F.lit("origin_kind"), scalar("$.origin.kind"), F.lit("prompt_source"), scalar("$.promptSource"),
            F.lit("entrypoint"), scalar("$.entrypoint"),
        ),
        lambda _k, x: x.isNotNull(),
    )

    texts = F.transform(
        F.filter(V.items(v, "$.message.content"), lambda b: V.string(b, "$.type") == "text"),
        lambda b: F.coalesce(V.shown(V.field(b, "$.text")), F.lit("")),
    )
    content = V.field(v, "$.message.content")
    spoken = F.when(V.items(v, "$.message.content").isNotNull(), F.array_join(texts, " ")).otherwise(
        F.when(V.is_null(content), F.lit("")).otherwise(V.shown(content))
    )
    events = decoded.where(V.string(v, "$.type") == "user").select(
        "session", "seq", collapse_whitespace(F.coalesce(spoken, F.lit(""))).alias("prompt"), marks.alias("origin")
    )
    known = events.where((F.col("prompt") != "") & (F.size("origin") > 0))
    return known.groupBy("session", "prompt").agg(F.min_by("origin", "seq").alias("origin"))


def annotate_origins(steps: DataFrame, origins: DataFrame) -> DataFrame:
    """Adds `origin` to user steps whose message equals a known prompt."""
    keyed = steps.withColumn("prompt", F.when(F.col("source") == "user", collapse_whitespace(F.col("message"))))
    joined = lookup(keyed, origins, ["session", "prompt"], spread_by=["step"])
    return joined.drop("prompt")


# --- references to children -----------------------------------------------

def is_spawn_tool(source: Column, function_name: Column) -> Column:
    name = F.btrim(F.regexp_replace(F.lower(function_name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(source == "claude_code", name.isin("agent", "task")).when(
        source == "codex", name.endswith("spawn_agent")
    ).otherwise(F.lit(False))


def child_aliases(children: DataFrame) -> DataFrame:
    """(session, alias, child_id) for children(session, source, child_id).

    An alias that stands for two different children stands for none.
    """
    short = F.when(
        (F.col("source") == "claude_code") & F.col("child_id").rlike("^agent[-_]"), F.substring("child_id", 7, 1 << 30)
    )
    named = children.select(
        "session", "source", "child_id", F.explode(F.array_compact(F.array("child_id", short))).alias("alias")
    )
    grouped = named.groupBy("session", "alias").agg(
        F.min("child_id").alias("child_id"), F.max("child_id").alias("_last"), F.min("source").alias("source")
    )
    return grouped.where(F.col("child_id") == F.col("_last")).drop("_last")


def json_facts(text: str, whole: bool) -> dict | None:
    """Child ids in the named fields of a JSON text at any depth, and its string leaves; None if it is no JSON.

    JSON written inside a string is looked into for named fields, but stays one leaf. Unless `whole`, leaves are
    given for a list only: an object as content is plain text to a reader of mentions."""
    try:
        parsed = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(parsed, (dict, list)):
        return None
    ids: dict[str, None] = {}
    leaves: list[str] = []
    waiting = [(parsed, True)]
    while waiting:
        node, outside = waiting.pop()
        if isinstance(node, str):
            if outside:
                leaves.append(node)
            if node.strip()[:1] in ("{", "["):
                try:
                    waiting.append((json.loads(node), False))
                except (ValueError, RecursionError):
                    pass
        elif isinstance(node, list):
            waiting.extend((x, outside) for x in node)
        elif isinstance(node, dict):
            for key, value in node.items():
                if "".join(c for c in key.lower() if c.isascii() and c.isalnum()) in CHILD_FIELDS:
                    named = [value]
                    while named:
                        x = named.pop()
                        if isinstance(x, str) and x:
                            ids[x] = None
                        elif isinstance(x, list):
                            named.extend(x)
                waiting.append((value, outside))
    return {"ids": list(ids), "leaves": leaves if whole or isinstance(parsed, list) else [text]}


_FACTS = T.StructType([T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("leaves", T.ArrayType(T.StringType()))])


def _facts(text: Column, whole: bool) -> Column:
    @F.arrow_udf(_FACTS)
    def read(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("ids", pa.list_(pa.string())), ("leaves", pa.list_(pa.string()))])
        return pa.array([None if x is None else json_facts(x, whole) for x in texts.to_pylist()], kind)

    return read(F.when(strip(text).rlike(r"^[{\[]"), text))


def read_results(results: DataFrame) -> DataFrame:
    """(session, step, call_id, ids, texts) of results: ids in named fields, and the texts that may mention a child.

    Only results of spawning calls come here, which are few; a JSON one is walked once, whatever its depth."""
    read = results.select(
        "session", "step", "call_id", "content", "extra", _facts(F.col("content"), False).alias("_c"), _facts(F.col("extra"), True).alias("_e")
    )
    none = F.array().cast("array<string>")

    def texts(column: str, facts: str) -> Column:
        return F.coalesce(F.col(f"{facts}.leaves"), F.array_compact(F.array(F.col(column))))

    return read.select(
        "session", "step", "call_id", F.array_union(F.coalesce("_c.ids", none), F.coalesce("_e.ids", none)).alias("ids"),
        F.concat(texts("content", "_c"), texts("extra", "_e")).alias("texts"),
    )


def anchored(aliases: DataFrame) -> DataFrame:
    """Adds `anchor` to aliases holding other characters than a token can; it is NULL for all others.

    Wherever such an alias stands whole, each of its own tokens stands whole as
    well. Its longest one is its anchor; an alias without any token has its
    first character.
    """
    runs = F.transform(
        F.filter(F.split("alias", "[^A-Za-z0-9_-]+"), lambda t: t != ""),
        lambda t: F.struct(F.length(t).alias("n"), t.alias("t")),
    )
    anchor = F.coalesce(F.array_max(runs)["t"], F.left("alias", F.lit(1)))
    return aliases.withColumn("anchor", F.when(F.col("alias").rlike("[^A-Za-z0-9_-]"), anchor))


def _places(hashed: Column, words: Column) -> list[Column]:
    """The three (word, bit) places of a hash in a filter whose number of words is a power of two."""
    return [
        F.struct(
            F.shiftrightunsigned(hashed, 20 * i + 6).bitwiseAND((words - 1).cast("bigint")).cast("int").alias("word"),
            F.shiftrightunsigned(hashed, 20 * i).bitwiseAND(F.lit(63)).cast("int").alias("bit"),
        )
        for i in range(3)
    ]


def alias_filters(aliases: DataFrame, most_words: int = FILTER_WORDS) -> DataFrame:
    """(session, bits): a Bloom filter per session of what its aliases are found by, as an array of 64-bit words.

    Sixteen bits an alias let one of 200 other tokens pass. A session with more aliases than `most_words` words can
    hold so sparsely gets a fuller filter: more tokens pass, and none that matters is lost. No session's aliases are
    gathered; only the words of its filter are.
    """
    needles = anchored(aliases).select("session", F.coalesce("anchor", "alias").alias("needle"))
    doublings = F.ceil(F.log2(F.greatest(F.count("*") / 4, F.lit(1.0))))
    sizes = needles.groupBy("session").agg(F.least(F.pow(F.lit(2.0), doublings), F.lit(float(most_words))).cast("int").alias("words"))
    sized = lookup(needles, sizes, ["session"], ["needle"], "inner")
    places = F.array(*_places(F.xxhash64("needle"), F.col("words")))
    one = F.lit(1).cast("bigint")
    marks = sized.select("session", F.inline(places)).select(
        "session", "word", F.call_function("shiftleft", one, F.col("bit")).alias("bits")
    )
    blank = sizes.select("session", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("word"), F.lit(0).cast("bigint").alias("bits"))
    filled = marks.unionByName(blank).groupBy("session", "word").agg(F.bit_or("bits").alias("bits"))
    packed = filled.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("_words"))
    return packed.select("session", F.transform("_words", lambda w: w["bits"]).alias("bits"))


def screen_results(read: DataFrame, aliases: DataFrame, most_words: int = FILTER_WORDS) -> DataFrame:
    """Results of sessions with aliases, with the `tokens` and other `signs` of their texts that may find an alias.

    Every text is split and filtered in its own row, before any token is sent anywhere."""
    joined = lookup(read, alias_filters(aliases, most_words), ["session"], ["step", "call_id"], "inner")
    bits = F.col("bits")

    def may_find(found: Column) -> Column:
        def held(place: Column) -> Column:
            return F.call_function("shiftrightunsigned", F.get(bits, place["word"]), place["bit"]).bitwiseAND(F.lit(1)) == 1

        first, second, third = _places(found["hashed"], F.size(bits))
        return held(first) & held(second) & held(third)

    def passing(pieces: Column) -> Column:
        hashed = F.transform(F.array_distinct(pieces), lambda t: F.struct(t.alias("t"), F.xxhash64(t).alias("hashed")))
        return F.transform(F.filter(hashed, lambda h: (h["t"] != "") & may_find(h)), lambda h: h["t"])

    tokens = F.flatten(F.transform("texts", lambda t: F.split(t, "[^A-Za-z0-9_-]+")))
    signs = F.flatten(F.transform("texts", lambda t: F.array_distinct(F.split(t, "[A-Za-z0-9_-]*"))))
    return joined.select("session", "step", "call_id", "ids", "texts", passing(tokens).alias("tokens"), passing(signs).alias("signs"))


def named_children(screened: DataFrame) -> DataFrame:
    """(session, step, call_id, identifier): ids in structured fields, and whole tokens that passed the filter."""
    return screened.select("session", "step", "call_id", F.explode(F.array_union("ids", "tokens")).alias("identifier"))


def odd_mentions(screened: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions of aliases holding other characters than a token can, first met by their anchors."""
    keys = ["session", "step", "call_id"]
    found = F.array_union("tokens", "signs")
    anchors = screened.select(*keys, F.explode(found).alias("anchor"))
    odd = anchored(aliases).where(F.col("anchor").isNotNull()).select("session", "anchor", F.col("alias").alias("identifier"))
    near = anchors.join(odd, ["session", "anchor"]).select(*keys, "identifier").distinct()
    both = near.join(screened.where(F.size(found) > 0).select(*keys, "texts"), keys)
    edge = "(?<![A-Za-z0-9_-])\\Q{}\\E(?![A-Za-z0-9_-])".split("{}")
    regex = F.concat(F.lit(edge[0]), F.replace("identifier", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(edge[1]))
    hit = F.exists("texts", lambda t: t.contains(F.col("identifier")) & F.regexp_like(t, regex))
    return both.where(hit).select(*keys, "identifier")


def child_references(
    tool_calls: DataFrame, tool_results: DataFrame, children: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """references(session, step, call_id, trajectory_id, session_id, trajectory_path) on spawning results.

    children(session, source, child_id). References already present are not repeated.
    """
    aliases = child_aliases(children)
    calls = tool_calls.where(is_spawn_tool(F.col("source"), F.col("function_name"))).select("session", "step", "call_id").distinct()
    read = read_results(tool_results.join(calls, ["session", "step", "call_id"]))
    screened = screen_results(read, aliases)
    identifiers = named_children(screened).unionByName(odd_mentions(screened, aliases)).distinct()
    matched = identifiers.join(aliases.withColumnRenamed("alias", "identifier"), ["session", "identifier"])
    references = matched.select(
        "session", "step", "call_id",
        transcript_id(F.col("source"), F.col("child_id")).alias("trajectory_id"),
        F.col("child_id").alias("session_id"),
        bundle_name(F.col("source"), F.col("child_id")).alias("trajectory_path"),
    ).distinct()
    if existing is None:
        return references
    return references.join(existing, ["session", "step", "call_id", "trajectory_id"], "left_anti")


def canonical_step(columns: list[str]) -> Column:
    """A step as JSON with sorted fields and without nulls."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
