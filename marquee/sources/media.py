"""Media catalogue: content-addressed rows for the pictures of visible campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.constants import MAX_MEDIA_BYTES, MEDIA_EXTENSIONS


def _extension(content_type: Column) -> Column:
    base = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    table = F.create_map(*[F.lit(x) for pair in MEDIA_EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, base)


def assets_of(fetched: DataFrame) -> DataFrame:
    """Landed downloads (source_url, content_type, content) to catalogue rows; unusable ones are left out."""
    size, kind = F.length("content"), _extension(F.col("content_type"))
    digest = F.sha2(F.col("content"), 256)
    return fetched.where(kind.isNotNull() & (size > 0) & (size <= MAX_MEDIA_BYTES)).select(
        "source_url", F.concat(F.lit("assets/media/"), digest, kind).alias("asset_path"), digest.alias("sha256"),
        F.lower(F.trim(F.substring_index("content_type", ";", 1))).alias("content_type"), size.cast("bigint").alias("size_bytes"))


def reusable(index: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogue rows whose stored bytes still have the recorded size and hash. ``files`` is a binaryFile scan."""
    stored = files.select(F.regexp_extract("path", r"(assets/media/[^/]+)$", 1).alias("asset_path"),
                          F.sha2("content", 256).alias("sha256"), F.col("length").cast("bigint").alias("size_bytes"))
    return index.join(stored, ["asset_path", "sha256", "size_bytes"], "left_semi")


def catalogue(wanted: DataFrame, kept: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows of wanted addresses: stored ones first, then new downloads; of several the least path. Unwanted rows drop out."""
    urls = wanted.select("source_url").distinct()
    old = kept.join(urls, "source_url", "left_semi")
    new = assets_of(fetched.join(urls, "source_url", "left_semi").join(old.select("source_url"), "source_url", "left_anti"))
    rest = [c for c in old.columns if c not in ("source_url", "asset_path")]
    least = old.unionByName(new).groupBy("source_url").agg(F.min(F.struct("asset_path", *rest)).alias("_m"))
    return least.select("source_url", "_m.*").select(old.columns)


def unreferenced(files: DataFrame, assets: DataFrame) -> DataFrame:
    """Stored paths no catalogue row refers to."""
    stored = files.select(F.regexp_extract("path", r"(assets/media/[^/]+)$", 1).alias("asset_path")).where("asset_path <> ''")
    return stored.join(assets.select("asset_path"), "asset_path", "left_anti").distinct()
