"""Registered queries and their check statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.plans.stand_ins import Tables
from marquee.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable:
    """Register ``work(tables)`` under a name, with the statement that checks it."""

    def register(work: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return work(Tables(prepare(spark), folder))

        run.__name__, run.__doc__ = name, work.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if check is not None:
            ORACLES[name] = check
        return work

    return register


def set_sql(item: str, size: int, tail: str = "''") -> str:
    """DuckDB aggregate that states :func:`marquee.functions.ids.set_digest` over the distinct items of a group."""
    sums = ", ".join(f"sum(DISTINCT CAST('0x' || substr(sha256({item}), {1 + 15 * i}, 15) AS BIGINT))" for i in range(4))
    return f"substr(sha256(concat_ws(':', count(DISTINCT {item}), {sums}) || {tail}), 1, {size})"
