"""Published views as JSON lines, with a last check for secrets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.ids import is_safe_id
from marquee.session import materialize


class SecretFound(ValueError):
    """A value that must stay private occurs in the output."""


def secret_hit(df: DataFrame, secrets: list[str]) -> Column:
    """True for a row in which a secret of at least eight characters occurs in any column."""
    listed = [s for s in secrets if len(s) >= 8]
    names = [f"`{n}`" for n in df.columns]
    row = F.concat_ws("\x1f", *[F.to_json(F.struct(n)) if t.startswith(("array", "map", "struct")) else F.col(n).cast("string")
                                for n, (_, t) in zip(names, df.dtypes)])
    return reduce(lambda a, b: a | b, [F.contains(row, F.lit(s)) for s in listed], F.lit(False))


def secret_rows(df: DataFrame, secrets: list[str]) -> DataFrame:
    return df.where(secret_hit(df, secrets))


def as_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns and one JSON line per row; a document is the set of its lines."""
    return df.select(*keys, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def write_view(df: DataFrame, path: str, keys: list[str], secrets: list[str] = ()) -> None:
    """One folder per document key. Rows are dealt by ranges of key and content, so a large document is written by many tasks.

    The view is made once: what was scanned for secrets is what is published.
    """
    df = materialize(df)
    if not secret_rows(df, list(secrets)).isEmpty():
        raise SecretFound("sensitive value detected in a published view")
    out = as_documents(df, keys).repartitionByRange(*[F.col(k) for k in keys], F.xxhash64("json"))
    out.write.mode("overwrite").partitionBy(*keys).text(path)


def unsafe_rows(df: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id may not become a path."""
    return df.where(~is_safe_id(id_column))
