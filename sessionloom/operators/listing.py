"""Immediate children of a prefix in an inventory of object keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import iso_utc


def list_prefix(objects: DataFrame, prefix: str, suffix: str = ".zip") -> DataFrame:
    """listing(name, key, is_folder, last_modified, label): folders by name, then objects newest first.

    Keys are reduced to their next path part before the shuffle, so a folder with
    very many objects costs one row per task. `prefix` is empty or ends in a slash.
    """
    rest = F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key"))
    below = objects.where(F.startswith("key", F.lit(prefix))).withColumn("_rest", rest)
    part = F.split_part(F.col("_rest"), F.lit("/"), F.lit(1))
    deep = F.col("_rest").contains("/")
    kept = below.where(F.when(deep, part != "").otherwise((F.col("_rest") != "") & F.endswith("key", F.lit(suffix))))
    children = kept.groupBy(part.alias("name"), deep.alias("is_folder")).agg(
        F.max("last_modified").alias("_modified"), F.max("key").alias("_key")
    )
    listed = children.select(
        "name",
        F.when(F.col("is_folder"), F.concat(F.lit(prefix), "name", F.lit("/"))).otherwise(F.col("_key")).alias("key"),
        "is_folder",
        F.when(~F.col("is_folder"), F.col("_modified")).alias("last_modified"),
    )
    label = F.concat("name", F.coalesce(F.concat(F.lit("  "), iso_utc(F.col("last_modified"))), F.lit("")))
    return listed.withColumn("label", label).orderBy(
        F.col("is_folder").desc(), F.col("last_modified").desc_nulls_last(), F.lower("name")
    )
