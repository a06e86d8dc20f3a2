"""Continuous intake with Structured Streaming; checkpoints take the place of cursors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from marquee.constants import DEFAULT_ZONE
from marquee.functions.times import local_time
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATENESS = "2 days"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landing(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """Posts as they land in a folder."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def once_per_version(posts: DataFrame, keys: tuple[str, ...] = ("obs_id", "content_hash")) -> DataFrame:
    """Repeats of a version are dropped whatever their age, an edited version passes. Works on batch frames as well.

    In a stream the versions seen are kept as keyed state on disk, one small row each, without expiry: a version that comes back
    after years is still a repeat, as in the stored table. The result does not depend on how rows fall into batches.
    """
    return posts.dropDuplicates(list(keys))


def daily_tally(posts: DataFrame, time: str, by: list[str], zone: str = DEFAULT_ZONE) -> DataFrame:
    """Posts per source and local day; a post counts unless it is more than two days older than the newest of earlier batches."""
    rows = posts.withColumn("_local", local_time(time, zone))
    rows = rows.withWatermark("_local", LATENESS) if posts.isStreaming else rows
    return rows.groupBy(F.window("_local", "1 day").alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), *by, "n")


def bursts(posts: DataFrame, time: str, by: list[str], gap: str) -> DataFrame:
    """Sessions of an account: runs of posts no further apart than ``gap``: (by, start, last, n). Works on streams and batch frames."""
    rows = posts.withWatermark(time, LATENESS) if posts.isStreaming else posts
    return rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.max(time).alias("last"), F.count(F.lit(1)).alias("n")).select(
        *by, F.col("w.start").alias("start"), "last", "n")


VERSION = "obs_id STRING, content_hash STRING, first_seen_at TIMESTAMP, updated_at TIMESTAMP, change STRING"


class _Versions(StatefulProcessor):
    """Keeps the newest hash of a post and tells whether a sighting is new, an edit or a repeat."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "content_hash STRING, first_seen_at TIMESTAMP, updated_at TIMESTAMP")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old, known = self.seen.get(), False
        last = lambda value: (value is None, value)
        for row in sorted(rows, key=lambda r: (last(r["seen_at"]), last(r["content_hash"]))):
            digest, at = row["content_hash"], row["seen_at"]
            if old is None:
                old, change = (digest, at, None), "new"
            elif old[0] != digest:
                old, change = (digest, old[1], at), "edited"
            else:
                continue
            known = True
            yield Row(obs_id=key[0], content_hash=digest, first_seen_at=old[1], updated_at=old[2], change=change)
        if known:
            self.seen.update(tuple(old))

    def close(self) -> None:
        pass


def version_changes(posts: DataFrame) -> DataFrame:
    """New and edited versions of posts (obs_id, content_hash, seen_at); unchanged sightings stay silent."""
    if posts.isStreaming and "RocksDB" not in (posts.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        posts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # the only store that can hold several states
    return posts.select("obs_id", "content_hash", "seen_at").groupBy("obs_id").transformWithState(
        statefulProcessor=_Versions(), outputStructType=VERSION, outputMode="Append", timeMode="None")


def drain(df: DataFrame, folder: str, output_mode: str = "append") -> None:
    """Process everything available. Each batch owns one folder, so a repeated batch replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = (df.writeStream.outputMode(output_mode).trigger(availableNow=True)
             .option("checkpointLocation", f"{folder}/progress").foreachBatch(save).start())
    query.awaitTermination()


def split_late(posts: DataFrame, folder: str, time: str, natural_days: int = 2) -> None:
    """Keep rows apart that come after their time: those older than ``natural_days`` before the newest row of all earlier batches.

    ``rows`` in ``folder`` gets what is in time, ``late`` the rest, ``marks`` each batch's newest time; all three are folders by batch. A
    batch looks at the marks of the batches before it only, so one that is repeated after a failure splits its rows as before.
    """
    marks = f"{folder}/marks"

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema("newest TIMESTAMP, batch BIGINT").parquet(marks).where(F.col("batch") < number) if number else None
        newest = seen.agg(F.max("newest")).first()[0] if seen is not None else None
        limit = F.lit(newest).cast("timestamp") - F.make_interval(days=F.lit(natural_days)) if newest is not None else F.lit(None).cast("timestamp")
        in_time = F.coalesce(F.col(time) >= limit, F.lit(True))
        batch.where(in_time).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batch.where(~in_time).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    each_batch(posts, folder, save)


def late_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What :func:`split_late` kept apart; :func:`drained` reads what came in time."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/late")


def drained(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """Rows written by :func:`drain`, with the number of their batch."""
    full = f"{schema}, batch BIGINT" if isinstance(schema, str) else T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(f"{folder}/rows")


def latest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def each_batch(df: DataFrame, folder: str, work: Callable[[DataFrame, int], None]) -> None:
    """Run a batch job per micro-batch; progress is recorded only after it returns."""
    (df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress")
     .foreachBatch(work).start().awaitTermination())
