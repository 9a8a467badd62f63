"""License scans by canonical digests.

A text is brought into a canonical form: copyright lines go, case and punctuation go, equivalent spellings become one.
The digest of the form is looked up in a table of known licenses and notices by a hash join. Looked up are the text as
a whole, its blocks between blank lines, its lines and its sentences, so a license is found alone in a file, as a
header and inside other prose. A unit matches as a whole or not at all.

The known table is small by its nature and broadcast only below a stated number of rows. Units whose canonical length is that of
no known text cannot match and are not joined, which leaves few rows to explode.

Defined results: null and empty texts match nothing. Repeated rows give equal results. Extra columns are not read. An
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000

# Spellings that count as one, in the order they are applied, after lower case and without punctuation.
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licensable", "sublicensable"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("fulfil", "fulfill"), ("favour", "favor"), ("organisation", "organization"), ("redistribution s", "redistributions"),
    ("per cent", "percent"), ("and or", "and or"), ("v 2 0", "version 2 0"), ("v2 0", "version 2 0"), ("v3", "version 3"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

# Public license texts and common notices, by SPDX identifier.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)

# A line that begins with the word is a copyright line unless the word belongs to a sentence of a license, which depends
# on where lines are broken: "copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE".
_SENTENCE_WORDS = "notices?|holders?|owners?|laws?|statements?|interests?"
_COPYRIGHT = rf"(?im)^[^\p{{L}}\p{{N}}\n]*(?:copyright(?![ \t]+(?:{_SENTENCE_WORDS})\b(?![ \t]*:))|\(c\)|©)[^\n]*$"
# Patterns that Java and RE2 read alike. Sentences end a unit as lines do. The SQL takes every line that begins with the
# word for a copyright line; it differs on texts with a license broken that way.
_SQL_COPYRIGHT = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*$"
_SENTENCE = r"([.!?])[ \t]+"
_MARKS = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """Canonical form with its line structure: units are separated by a line break, blocks by several."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), _COPYRIGHT, "")
    out = F.lower(F.regexp_replace(out, _SENTENCE, "$1\n"))
    out = F.regexp_replace(F.regexp_replace(out, _MARKS, " "), "(?m)^ +| +$", "")
    for other, usual in EQUIVALENT:
        out = F.regexp_replace(out, rf"\b{other}\b", usual)
    return out


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def digests(text: Column, lengths: list[int]) -> Column:
    """Digests of all units of a canonical text whose length is one of `lengths`."""
    blocks = F.transform(F.split(text, r"\n\n+"), _flat)
    units = F.array_distinct(F.concat(F.array(_flat(text)), blocks, F.split(text, r"\n+")))
    return F.transform(F.filter(units, lambda u: F.length(u).isin(lengths)), lambda u: F.md5(u.cast("binary")))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license, digest, length, whole): the table that texts are joined with."""
    rows = spark.createDataFrame(list(known), "license string, text string").select("license", _flat(canonical(F.col("text"))).alias("form"))
    return rows.select("license", F.md5(F.col("form").cast("binary")).alias("digest"), F.length("form").alias("length")).where("length > 0").distinct()


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, whole_license, licenses, n_licenses) for every row of (doc_id, text).

    `whole_license`: the license that is the entire text. `licenses`: all found in it, in order of their names."""
    known = known_digests(docs.sparkSession) if known is None else known
    rows = known.limit(BROADCAST_ROWS + 1).collect()
    small = len(rows) <= BROADCAST_ROWS
    if small:
        known = docs.sparkSession.createDataFrame(rows, known.schema) if rows else known
    lengths = sorted({r["length"] for r in (rows if small else known.select("length").distinct().collect())}) or [0]
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("ka"), F.xxhash64(F.lit(7), text).alias("kb"), text.alias("text"))
    # The canonical form is taken once: behind a generator it is not substituted into what uses it.
    formed = keyed.select("ka", "kb", F.explode(F.array(canonical(F.col("text")))).alias("form"))
    units = formed.select("ka", "kb", F.md5(_flat(F.col("form")).cast("binary")).alias("whole"), F.explode(digests(F.col("form"), lengths)).alias("digest"))
    met = units.join(F.broadcast(known) if small else known, "digest")
    found = met.groupBy("ka", "kb").agg(
        F.min(F.when(F.col("whole") == F.col("digest"), F.col("license"))).alias("whole_license"), F.array_sort(F.collect_set("license")).alias("licenses")
    )
    none = F.array().cast("array<string>")
    joined = keyed.select("doc_id", "ka", "kb").join(found, ["ka", "kb"], "left")
    return joined.select("doc_id", "whole_license", F.coalesce("licenses", none).alias("licenses"), F.size(F.coalesce("licenses", none)).alias("n_licenses"))


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "whole_license", F.array_join("licenses", ",").alias("licenses"), "n_licenses")


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), '{_SQL_COPYRIGHT}', '', 'g')"
    out = f"lower(regexp_replace({out}, '{_SENTENCE}', '\\1' || chr(10), 'g'))"
    out = f"regexp_replace(regexp_replace({out}, '{_MARKS}', ' ', 'g'), '(?m)^ +| +$', '', 'g')"
    for other, usual in EQUIVALENT:
        out = f"regexp_replace({out}, '\\b{other}\\b', '{usual}', 'g')"
    return out


def _sql_flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"


def _sql_rows() -> str:
    quoted = [(a, b.replace("'", "''")) for a, b in KNOWN]
    return ", ".join(f"('{a}', '{b}')" for a, b in quoted)


OP8_SQL = f"""
WITH k AS (SELECT DISTINCT license, {_sql_flat(_sql_canonical('text'))} AS form FROM (VALUES {_sql_rows()}) v(license, text)),
d AS (SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS form FROM documents),
u AS (SELECT doc_id, {_sql_flat('form')} AS whole, unnest(list_distinct(list_concat(list_concat([{_sql_flat('form')}],
        list_transform(regexp_split_to_array(form, '\\n\\n+'), lambda b: {_sql_flat('b')})), regexp_split_to_array(form, '\\n+')))) AS unit FROM d),
f AS (SELECT doc_id, min(CASE WHEN whole = unit THEN license END) AS whole_license, list_sort(list_distinct(list(license))) AS l
      FROM u JOIN k ON unit = k.form GROUP BY doc_id)
SELECT documents.doc_id, whole_license, coalesce(array_to_string(l, ','), '') AS licenses, coalesce(len(l), 0)::INT AS n_licenses
FROM documents LEFT JOIN f ON documents.doc_id = f.doc_id
"""
