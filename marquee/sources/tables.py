"""State tables: flat, bucketed by day, replaced by id."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATION = """
    obs_id STRING, source_id STRING, kind STRING, url STRING, account_name STRING, account_id STRING,
    canonical_content_id STRING, is_official BOOLEAN, published_at TIMESTAMP, first_seen_at TIMESTAMP,
    updated_at TIMESTAMP, content_hash STRING, excerpt STRING, summary STRING, text STRING,
    media_urls ARRAY<STRING>, media_hashes ARRAY<STRING>, media_text ARRAY<STRING>, outbound_urls ARRAY<STRING>,
    ip_slug STRING"""
JOB = """
    job_id STRING, campaign_id STRING, candidate_id STRING, activity_id STRING, action_id STRING, change_id STRING,
    kind STRING, due_date DATE, expected_at TIMESTAMP, expected_date DATE, semantic_key STRING, summary STRING,
    campaign_notice BOOLEAN"""
RECEIPT = """
    job_id STRING, candidate_id STRING, semantic_key STRING, sent_at TIMESTAMP, delivery_day DATE, channel STRING,
    public_text STRING, campaign_id STRING"""


def scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a table; with a schema nothing is inferred and filters and columns reach the files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)


def bucket(df: DataFrame, column: str, day: date | str) -> DataFrame:
    """One day's rows; on a table partitioned by ``column`` only that folder is opened."""
    return df.where(F.col(column) == F.lit(str(day)).cast("date"))


def due_until(df: DataFrame, column: str, day: date | str) -> DataFrame:
    return df.where(F.col(column) <= F.lit(str(day)).cast("date"))


def latest_version(df: DataFrame, key: str = "obs_id", order: str = "first_seen_at", tie: str = "content_hash") -> DataFrame:
    """Newest stored version of each row. The order keys alone are aggregated, the wide row is fetched once."""
    place = F.struct(order, tie)
    newest = df.groupBy(key).agg(F.max(place).alias("_v"))
    return df.join(newest.select(key, F.col(f"_v.{order}").alias(order), F.col(f"_v.{tie}").alias(tie)), [key, order, tie],
                   "left_semi").dropDuplicates([key])


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Stored rows replaced by incoming rows with the same id, last one by ``order`` when repeated.

    A row whose bucket column changed simply appears in its new bucket, as its old row is gone.
    """
    last = incoming
    if order is not None:
        row = F.struct(*incoming.columns)
        last = incoming.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, order).alias("_m")).select("_m.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def write_buckets(df: DataFrame, path: str, column: str) -> None:
    """Replace only the buckets present in ``df``. Rows are dealt by ranges of bucket and content, so a hot day is written by many tasks."""
    mark = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
    (df.repartitionByRange(F.col(column), mark).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(column).parquet(path))


def touched_buckets(stored: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """Buckets to rewrite: where incoming rows land and where rows of the same id lie now."""
    moved = stored.join(incoming.select(key), key, "left_semi").select(column)
    return moved.unionByName(incoming.select(column)).distinct()
