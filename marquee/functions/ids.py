"""Stable identities. Hashes of business keys, never of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import col, fold, squeeze

UNIT = "\x1f"
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,180}$"


def digest(value: Column, size: int = 64) -> Column:
    return F.substring(F.sha2(value, 256), 1, size)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Prefix and 16 hex digits over the folded parts."""
    return F.concat(F.lit(prefix + "-"), digest(F.concat_ws(UNIT, *[fold(p) for p in parts]), 16))


def raw_id(prefix: str, size: int, *parts: Column | str) -> Column:
    """Prefix and ``size`` hex digits over the parts as they are."""
    return F.concat(F.lit(prefix + "-"), digest(F.concat_ws(UNIT, *[F.coalesce(col(p), F.lit("")) for p in parts]), size))


def campaign_key(ip: Column | str, partner: Column | str, obs_id: Column | str) -> Column:
    known = F.coalesce(col(partner), F.lit("")) != ""
    return stable_id("campaign", ip, F.when(known, col(partner)).otherwise(F.lit("unknown-partner")),
                     F.when(known, F.lit("")).otherwise(col(obs_id)))


def activity_key(ip: Column | str, obs_id: Column | str, kind: Column | str, title: Column | str,
                 location: Column | str) -> Column:
    return stable_id("activity", ip, obs_id, kind, title, location)


def location_hint(venues: Column) -> Column:
    """Venue parts of an activity joined by a vertical bar."""
    blank = lambda v: F.coalesce(v, F.lit(""))
    parts = F.transform(F.coalesce(venues, F.array()), lambda v: F.concat_ws(
        "|", blank(v["city"]), blank(v["name"]), blank(v["online_platform"]),
        F.when(F.coalesce(v["nationwide"], F.lit(False)), "nationwide").otherwise("")))
    return F.array_join(parts, "|")


def action_key(activity_id: Column | str, kind: Column | str, title: Column | str) -> Column:
    return stable_id("action", activity_id, kind, title)


def venue_key(activity_id: Column | str, city: Column | str, name: Column | str, platform: Column | str) -> Column:
    return stable_id("venue", activity_id, city, name, platform)


def job_key(semantic_key: Column) -> Column:
    return F.concat(F.lit("job-"), digest(semantic_key, 20))


def candidate_key(*parts: Column | str) -> Column:
    return raw_id("candidate", 24, *parts)


def change_key(semantic_key: Column) -> Column:
    return F.concat(F.lit("chg-"), digest(semantic_key, 16))


def value_hash(value: Column) -> Column:
    return digest(value, 12)


def is_safe_id(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike(SAFE_ID), F.lit(False))


def signature(*fields: Column) -> Column:
    """Canonical JSON of public fields without white space; null fields are left out."""
    return F.to_json(F.struct(*fields))


def squeezed_fields(names: list[str]) -> list[Column]:
    """String fields without white space, in name order, for :func:`signature`."""
    return [squeeze(F.col(n).cast("string")).alias(n) for n in sorted(names)]


def set_digest(df: DataFrame, keys: list[str], item: Column, *, size: int, tail_column: str | None = None, name: str = "set_id", within: list[str] | None = None) -> DataFrame:
    """One digest per key over the distinct items of its rows, by one rule for sets of any size.

    The SHA-256 of every item is cut into four numbers of 60 bits; their sums and the number of items are hashed, with the tail if
    there is one. Sums combine map-side and need no order, so a set never becomes one row, and repeats do not count.
    An item that names columns of its row has its repeats among rows that agree in them: rows dealt by keys and ``within`` stay where they are.
    """
    rows = df.select(*keys, *(within or []), item.cast("string").alias("_item")).where("_item is not null").distinct().withColumn("_h", F.sha2("_item", 256))
    part = lambda i: F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(part(i)).alias(f"_s{i}") for i in range(4)])
    text = F.concat_ws(":", "_n", *[F.col(f"_s{i}").cast("string") for i in range(4)])
    if tail_column is not None:
        text = F.concat(text, F.col(tail_column))
    return totals.select(*keys, digest(text, size).alias(name))
