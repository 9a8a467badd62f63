"""Storage names: safe segments, keys, contributor names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.text import let, path_suffix, strip

# The layout of stored bundles.
STORAGE_PREFIX = "mts-trans"
BUNDLE_SUFFIX = ".zip"
_UNSAFE = "[^A-Za-z0-9._-]"


def safe_segment(value: Column) -> Column:
    """A key segment; when characters had to change, a digest keeps different values apart."""

    def clean(plain: Column) -> Column:
        cleaned = F.btrim(F.regexp_replace(plain, _UNSAFE, "-"), F.lit("-"))
        digest = F.left(F.sha2(plain.cast("binary"), 256), F.lit(8))

        def told_apart(named: Column) -> Column:
            return F.when(named == plain, named).otherwise(F.concat(named, F.lit("--"), digest))

        return let(let(cleaned, lambda c: F.when(c == "", "unknown").otherwise(c)), told_apart)

    return let(strip(value), clean)


def project_segment(label: Column) -> Column:
    encoded = label
    for raw, code in (("%", "%25"), ("/", "%2F"), ("\\", "%5C")):
        encoded = F.replace(encoded, F.lit(raw), F.lit(code))
    return F.when(F.coalesce(label, F.lit("")) == "", "%00").otherwise(encoded)


def transcript_id(source: Column, session: Column) -> Column:
    return F.concat(source, F.lit("--"), session)


def bundle_name(source: Column, session: Column) -> Column:
    return F.concat(safe_segment(transcript_id(source, session)), F.lit(BUNDLE_SUFFIX))


def bundle_prefix(contributor: Column, label: Column, prefix: str = STORAGE_PREFIX) -> Column:
    return F.concat(F.lit(prefix + "/"), safe_segment(contributor), F.lit("/"), project_segment(label), F.lit("/"))


def bundle_key(contributor: Column, label: Column, source: Column, session: Column, prefix: str = STORAGE_PREFIX) -> Column:
    return F.concat(bundle_prefix(contributor, label, prefix), bundle_name(source, session))


def contributor_name(name: Column) -> Column:
    cleaned = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), _UNSAFE, "-")
    return F.when(cleaned == "", "anonymous").otherwise(cleaned)


def native_member(path: Column) -> Column:
    """Name of the transcript inside its bundle."""
    suffix = F.lower(path_suffix(path))
    return F.concat(F.lit("transcript"), F.when(suffix.isin(".jsonl", ".txt"), suffix).otherwise(".txt"))
