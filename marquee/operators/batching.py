"""Greedy ordered batches that stay exact when one owner holds a third of all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee import constants as C
from marquee.operators.ranking import positions
from marquee.session import materialize

CHUNK = 20_000
#: Chunks whose tables are composed into one: a task chains one table for every 20 million rows of an owner.
RUN = 1_000


def _next_starts(sizes: np.ndarray, max_size: int, max_entries: int) -> np.ndarray:
    """For a batch that starts at row i: the row where the next batch starts."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    by_size = np.searchsorted(ends, ends[:-1] + max_size, side="right") - 1
    first = np.arange(len(sizes))
    return np.clip(by_size, first + 1, first + max_entries)


def greedy_batches(df: DataFrame, owner: list[str], order: list[str], size: str, max_size: int, max_entries: int,
                   chunk: int = CHUNK) -> DataFrame:
    """Add ``batch_no`` (from 0): a batch closes when the next row would exceed either limit.

    Rows are numbered per owner and cut into chunks. A batch that begins before a chunk can reach
    into it by fewer than ``max_entries`` rows, so a chunk is described by a small table: for each
    entry row, the exit row in the following chunk and the batches begun. Tables of RUN chunks are
    composed into one of the same kind; chaining those, and then the chunks of every run, fixes every
    chunk's entry row and first batch number; then all chunks number their rows at once.
    """
    if max_entries > chunk:
        raise ValueError("a chunk must hold at least one full batch")
    ranked = positions(df, owner, order, "_pos").withColumn("_chunk", F.floor(F.col("_pos") / chunk).cast("bigint"))
    key_fields = [f for f in ranked.schema.fields if f.name in owner]
    tail = F.when((F.col("_pos") % chunk < max_entries) & (F.col("_chunk") > 0), F.col("_chunk") - 1)
    sized = ranked.select(*owner, "_chunk", "_pos", F.col(size).cast("bigint").alias("_size"))
    # the first rows of a chunk are also shown to the chunk before it
    seen = sized.unionByName(sized.withColumn("_chunk", tail).where("_chunk is not null"))

    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        number = int(pdf["_chunk"].iloc[0])
        start = number * chunk
        own = int((pdf["_pos"] < start + chunk).sum())
        nxt = _next_starts(pdf["_size"].to_numpy(), max_size, max_entries)
        exits, begun = [], []
        for entry in range(max_entries):
            row, count = entry, 0
            while row < own:
                row, count = int(nxt[row]), count + 1
            exits.append(max(0, row - chunk))
            begun.append(count)
        return pdf[owner + ["_chunk"]].head(1).assign(exits=[exits], begun=[begun])

    table = T.StructType([*key_fields, T.StructField("_chunk", T.LongType()),
                          T.StructField("exits", T.ArrayType(T.LongType())),
                          T.StructField("begun", T.ArrayType(T.LongType()))])
    described = seen.groupBy(*owner, "_chunk").applyInPandas(describe, table)

    described = materialize(described.withColumn("_run", F.floor(F.col("_chunk") / RUN).cast("bigint")))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        at, total = np.arange(max_entries), np.zeros(max_entries, dtype=np.int64)
        pdf = pdf.sort_values("_chunk")
        for exits, begun in zip(pdf["exits"], pdf["begun"]):
            total, at = total + np.asarray(begun)[at], np.asarray(exits)[at]
        return pdf[owner + ["_run"]].head(1).assign(exits=[at.tolist()], begun=[total.tolist()])

    def chain(unit: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(unit)
            entry, base = (int(pdf[c].iloc[0]) if c in pdf else 0 for c in ("_entry", "_base"))
            entries, bases = [], []
            for exits, begun in zip(pdf["exits"], pdf["begun"]):
                entries.append(entry)
                bases.append(base)
                entry, base = int(exits[entry]), base + int(begun[entry])
            return pdf[owner + [unit]].assign(_entry=entries, _base=bases)

        return walk

    place = lambda unit: T.StructType([*key_fields, T.StructField(unit, T.LongType()), T.StructField("_entry", T.LongType()), T.StructField("_base", T.LongType())])
    runs = described.groupBy(*owner, "_run").applyInPandas(compose, T.StructType([*key_fields, T.StructField("_run", T.LongType()), *table.fields[-2:]]))
    begun_runs = runs.groupBy(*owner).applyInPandas(chain("_run"), place("_run"))
    placed = described.join(begun_runs, [*owner, "_run"]).groupBy(*owner, "_run").applyInPandas(chain("_chunk"), place("_chunk"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos").reset_index(drop=True)
        nxt = _next_starts(pdf["_size"].to_numpy(), max_size, max_entries)
        starts = np.zeros(len(pdf), dtype=np.int64)
        row = int(pdf["_entry"].iloc[0])
        while row < len(pdf):
            starts[row] = 1
            row = int(nxt[row])
        # rows before the entry row belong to the batch begun in the chunk before
        return pdf[owner + ["_pos"]].assign(batch_no=np.cumsum(starts) + int(pdf["_base"].iloc[0]) - 1)

    numbered = sized.join(placed, [*owner, "_chunk"]).groupBy(*owner, "_chunk").applyInPandas(
        number, T.StructType([*key_fields, T.StructField("_pos", T.LongType()), T.StructField("batch_no", T.LongType())]))
    return ranked.join(numbered, [*owner, "_pos"]).drop("_chunk").withColumnRenamed("_pos", "batch_position")


def history_batches(entries: DataFrame, text_size: str = "n_chars") -> DataFrame:
    """Per platform and account: 24 000 characters of the primary post and two entries.

    A batch that holds one over-long post cannot be processed and is flagged.
    """
    out = greedy_batches(entries, ["kind", "account_id"], ["published_at", "obs_id"], text_size,
                         C.HISTORY_BATCH_CHARS, C.HISTORY_BATCH_ENTRIES)
    return out.withColumn("too_long", F.col(text_size) > C.HISTORY_BATCH_CHARS)


def context_batches(entries: DataFrame, text_size: str = "n_chars") -> DataFrame:
    """Per watched name, across accounts: 60 000 characters over all members and 24 groups."""
    return greedy_batches(entries, ["ip_slug"], ["published_at", "obs_id"], text_size,
                          C.CONTEXT_BATCH_CHARS, C.CONTEXT_BATCH_ENTRIES)
