"""Line dedup by site-relative frequency.

Rows are grouped by site. A line's ratio is the number of the site's pages that hold it, divided by the site's pages.
Lines whose ratio exceeds a limit are boilerplate of that site and are dropped from its pages. A line needs `least` pages
besides, as on a small site ratio * pages is below 1 and a line of a single page would exceed the limit. No site is
too small to be cleaned: a menu on all three pages of a site goes.

Only digests of lines are shuffled. The boilerplate lines of a site are gathered in one list: with L distinct lines
on an average page and limit r there are at most L / r of them, however many pages the site has. A site that holds a
third of all rows costs no more, since counts are combined before the shuffle and the planner may split the join.

On request copies are not counted (`without_copies`): else a group of copies above the limit has each of its lines
dropped, and with them the last copy of its text. A page that mostly repeats other pages stays whole but for lines that
pages of their own show to be boilerplate; which copy stays is for a later stage to decide. So a site on which every page is
three quarters menu keeps its menus.

Defined results: a line is compared as it stands without spaces at its ends; empty lines are no lines and stay. A
null text stays null and its row still counts as a page. Rows without a site form one site. Repeated rows count as
pages of their own. Extra columns pass through untouched. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Scratch

RATIO, LEAST = 0.02, 3  # of a site's pages, and pages at least, that hold a boilerplate line
COPY_PERCENT = 75  # the similarity at which near_duplicates links two texts


def line_digest(line: Column) -> Column:
    return F.md5(F.trim(line).cast("binary"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(rows: DataFrame, site: str, text: str, ratio: float, least: int = LEAST) -> DataFrame:
    """(site, list of digests) of the lines above the ratio and on `least` pages."""
    pages = rows.groupBy(F.col(site).alias("site")).agg(F.count("*").alias("pages"))
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), line_digest))
    held = rows.select(F.col(site).alias("s"), F.explode(digests).alias("line")).groupBy("s", "line").agg(F.count("*").alias("held"))
    often = held.where(F.col("held") >= least)  # without the lines of one page, most of all lines
    joined = often.join(pages, F.col("s").eqNullSafe(F.col("site")))
    return joined.where(F.col("held") > ratio * F.col("pages")).groupBy("site").agg(F.collect_list("line").alias("lines"))


def _runs(text: Column) -> Column:
    """Distinct hashes of the runs of five words; a shorter text is one run. The words are bound once, as an array of one."""
    words = F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 5)))
    return F.array_distinct(F.transform(F.array(words), of)[0])


def without_copies(rows: DataFrame, listed: DataFrame, ratio: float, least: int, scratch: Scratch) -> DataFrame:
    """(site, lines) of `listed` that stay boilerplate when copies are no pages of their own.

    `rows` is (s, t), `listed` the boilerplate by pages as they are. Equal texts of a site are one page. A page is a near
    copy if runs of five words that stand on more than half the limit of pages make up COPY_PERCENT of it; such pages
    neither count nor speak for a line. Only pages with a listed line are looked at in full."""
    # The site is part of the keys, so that no aggregate is done where a join by site has put its rows.
    keyed = rows.select("s", "t", F.xxhash64("s", "t").alias("ka"), F.xxhash64(F.lit(7), "s", "t").alias("kb"))
    distinct = keyed.select("s", "ka", "kb").distinct().groupBy("s").agg(F.count("*").alias("texts"))
    sizes = rows.groupBy("s").agg(F.count("*").alias("pages"))
    found = F.array_intersect(F.transform(_lines(F.col("t")), line_digest), F.col("lines"))
    held = keyed.join(listed, F.col("s").eqNullSafe(F.col("site"))).select("s", "ka", "kb", "t", F.explode(F.array(found)).alias("found"))
    once = held.where(F.size("found") > 0).groupBy("ka", "kb").agg(F.first(F.struct("s", "t", "found")).alias("p"))
    pages = scratch.keep(once.select("p.s", "p.found", _runs(F.col("p.t")).alias("runs")), "held")

    counts = pages.select("s", F.explode("runs").alias("run")).groupBy("s", "run").agg(F.count("*").alias("n")).where("n > 1")
    often = counts.join(sizes.withColumnRenamed("s", "site"), F.col("s").eqNullSafe(F.col("site"))).where(2 * F.col("n") > ratio * F.col("pages"))
    common = often.groupBy("site").agg(F.collect_list("run").alias("common"))
    met = F.coalesce(F.size(F.array_intersect("runs", "common")), F.lit(0))
    judged = scratch.keep(
        pages.join(common, F.col("s").eqNullSafe(F.col("site")), "left").select("s", "found", (100 * met >= COPY_PERCENT * F.size("runs")).alias("copy")), "judged"
    )
    copies = judged.where("copy").groupBy(F.col("s").alias("c")).agg(F.count("*").alias("copies"))
    own = distinct.join(copies, F.col("s").eqNullSafe(F.col("c")), "left").select(F.col("s").alias("site"), (F.col("texts") - F.coalesce("copies", F.lit(0))).alias("own"))
    lines = judged.where("NOT copy").select("s", F.explode("found").alias("line")).groupBy("s", "line").agg(F.count("*").alias("held"))
    stays = lines.where(F.col("held") >= least).join(own, F.col("s").eqNullSafe(F.col("site"))).where(F.col("held") > ratio * F.col("own"))
    return stays.groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(rows: DataFrame, site: Column, text: Column, ratio: float = RATIO, least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """(row: all columns as they came, text: what is left, n_lines, n_dropped). With `scratch`, copies are not counted."""
    keyed = rows.select(F.struct("*").alias("row"), site.alias("s"), text.alias("t"))
    listed = boilerplate(keyed.select("s", "t"), "s", "t", ratio, least)
    if scratch is not None:
        listed = without_copies(keyed.select("s", "t"), scratch.keep(listed, "listed"), ratio, least, scratch)
    joined = keyed.join(listed, F.col("s").eqNullSafe(F.col("site")), "left")
    cut = F.transform(_lines(F.col("t")), lambda x: F.struct(x.alias("line"), line_digest(x).alias("digest")))
    # Digests of the page that are boilerplate: a hash set lookup per line, then a short list.
    found = F.array_intersect(F.transform(F.col("cut"), lambda x: x["digest"]), F.col("lines"))
    stays = lambda x: (F.trim(x["line"]) == "") | ~F.array_contains(F.col("found"), x["digest"])
    left = F.transform(F.filter(F.col("cut"), stays), lambda x: x["line"])
    known = joined.withColumn("cut", cut).withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    touched = F.size("found") > 0
    return known.withColumn("left", F.when(touched, left)).select(
        "row",
        F.when(touched, F.array_join("left", "\n")).otherwise(F.col("t")).alias("text"),
        F.coalesce(F.size(F.filter("cut", lambda x: F.trim(x["line"]) != "")), F.lit(0)).alias("n_lines"),
        F.when(touched, F.size("cut") - F.size("left")).otherwise(0).alias("n_dropped"),
    )


# Patterns for text lines of a page; each is read alike by Java and by RE2.
_DROPPED = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
_BREAKS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|header|footer|nav|title|head|body|html)[^a-z>]*[^>]*>"
_TAGS = r"<[^>]*>"
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def page_lines(html: Column) -> Column:
    """Visible text of a page, a line per block element."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _DROPPED, " "), _BREAKS, "\n"), _TAGS, "")
    for name, mark in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def host(url: Column) -> Column:
    """Host of an address in lower case; null where there is none."""
    found = F.regexp_extract(url, _HOST, 1)
    return F.when(found != "", F.lower(found))


def op1_line_dedup(spark, folder: str) -> DataFrame:
    """Pages without the lines that stand on more than one in twenty of their host's pages, and on three at least."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    done = drop_boilerplate(pages.select("page_id", "url", "html"), host(F.col("url")), page_lines(F.col("html")), ratio=0.05)
    return done.select(
        "row.page_id", host(F.col("row.url")).alias("host"), "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def _sql_text(html: str) -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace({html}, '{_DROPPED}', ' ', 'g'), '{_BREAKS}', chr(10), 'g'), '{_TAGS}', '', 'g')"
    for name, mark in _ENTITIES:
        mark = mark.replace("'", "''")
        text = f"replace({text}, '{name}', '{mark}')"
    return text


OP1_SQL = f"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '{_HOST}', 1)), '') AS host, {_sql_text('html')} AS t,
                  row_number() OVER () AS r FROM pages),
l AS (SELECT r, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM p),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
f AS (SELECT l.host, trim(line, ' ') AS key FROM l JOIN n ON l.host IS NOT DISTINCT FROM n.host WHERE trim(line, ' ') <> ''
      GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST} AND count(DISTINCT r) > 0.05 * any_value(pages)),
k AS (SELECT l.*, f.key IS NOT NULL AS dropped FROM l LEFT JOIN f ON l.host IS NOT DISTINCT FROM f.host AND trim(line, ' ') = f.key),
g AS (SELECT r, count(*) FILTER (WHERE trim(line, ' ') <> '') AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
             string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped) AS text FROM k GROUP BY r)
SELECT page_id, host, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped,
       sha256(coalesce(text, '')) AS kept_sha256 FROM p LEFT JOIN g USING (r)
"""
