"""Watched names: aliases, accounts, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import constants as C


def builtin_registry(spark: SparkSession) -> DataFrame:
    """(slug, name, aliases, sources) of the names known out of the box."""
    rows = [(number, *entry) for number, entry in enumerate(C.REGISTRY)]
    return spark.createDataFrame(rows, "entry_no INT, slug STRING, name STRING, aliases ARRAY<STRING>, sources "
                                 "ARRAY<STRUCT<kind STRING, account_name STRING, account_id STRING, url STRING>>")


def spellings(registry: DataFrame) -> DataFrame:
    """One row per accepted spelling in lower case. The last entry that claims a spelling owns it."""
    names = F.array_distinct(F.transform(F.concat(F.array("name", "slug"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    place = F.col("entry_no") if "entry_no" in registry.columns else F.lit(0)
    rows = registry.select("slug", place.alias("n"), F.explode(names).alias("spelling"))
    return rows.groupBy("spelling").agg(F.max(F.struct("n", "slug")).getField("slug").alias("slug"))


def resolve(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Supported entries in request order, each once. ``requests`` is (position, requested)."""
    hits = requests.join(spellings(registry), F.lower("requested") == F.col("spelling"))
    first = hits.groupBy("slug").agg(F.min("position").alias("position"))
    return first.join(registry, "slug")


def unsupported(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct requests no entry answers to."""
    return requests.join(spellings(registry), F.lower("requested") == F.col("spelling"), "left_anti").select("requested").distinct()


def with_extra_accounts(sources: DataFrame, extras: DataFrame, kind: str = "weibo") -> DataFrame:
    """Watched accounts and the user's own, without repeats.

    ``sources`` is (slug, name, kind, account_name, account_id, url); ``extras`` is (slug, account_id).
    """
    wanted = extras.select("slug", "account_id").distinct()
    names = sources.groupBy("slug").agg(F.min("name").alias("name"))
    known = sources.where(F.col("kind") == kind).select("slug", "account_id")
    added = wanted.join(known, ["slug", "account_id"], "left_anti").join(names, "slug")
    return sources.unionByName(added.select(
        "slug", "name", F.lit(kind).alias("kind"), F.concat("name", F.lit(C.SUPPLEMENT_ACCOUNT_SUFFIX)).alias("account_name"),
        "account_id", F.concat(F.lit("https://weibo.com/u/"), "account_id").alias("url")))
