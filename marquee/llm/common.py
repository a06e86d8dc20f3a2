"""What the operators share: Arrow plumbing, tables staged in the shared folder, digests."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import run_folder

#: Characters of text handled at a time inside a task.
CHUNK_CHARS = 2_000_000


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files.

    This cuts the lineage, so the loss of an executor never repeats what came before.
    """
    path = f"{run_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Sent:
    """An object of this package for all tasks. It goes by value, so that workers need no copy of the package; a task unpacks it once."""

    def __init__(self, spark: SparkSession, thing: object):
        self._packed, self._thing = spark.sparkContext.broadcast(cloudpickle.dumps(thing)), None

    def __getstate__(self) -> dict[str, object]:
        return {"_packed": self._packed, "_thing": None}

    @property
    def value(self) -> object:
        if self._thing is None:
            self._thing = cloudpickle.loads(self._packed.value)
        return self._thing


def arrow_map(df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, object]], text: str = "text") -> DataFrame:
    """Apply ``work`` to column lists of ``df``, at most CHUNK_CHARS of ``text`` (or one row) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = work({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in out.values()], names=list(out))
        give_back()

    return df.mapInArrow(run, schema)


def with_result(docs: DataFrame, name: str, kind: str, make: Callable[[], Callable[[list[str | None]], pa.Array]], keep: list[str] | None = None,
                text: str = "text", most: int = CHUNK_CHARS) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all of them by default) and ``name``, computed from the whole ``text`` of every row.

    ``make`` runs once in a task and gives the function from texts, ``most`` characters at a time, to results. The other columns pass by untouched, whatever
    their names; one that is called ``name`` itself is an error.
    """
    keep = docs.columns if keep is None else keep
    if name in keep:
        raise ValueError(f"column {name} exists")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, "text", most):
                yield pa.RecordBatch.from_arrays([part.column("row"), work(part.column("text").to_pylist())], names=["row", "result"])
        give_back()

    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, result {kind}")
    return done.select("row.*", F.col("result").alias(name))


def slices(batch: pa.RecordBatch, text: str, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold ``most`` bytes at most; a longer text comes alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def held(kind: str, key: object, make: Callable[[], object]) -> object:
    """One object for all tasks of a worker process, made anew when another kind or ``key`` is asked for, so that only one takes memory.

    It is kept on ``sys`` because functions that are sent by value get globals of their own in every task. Only what may be lost or
    made twice belongs here: vocabularies, models and what was computed from them.
    """
    store = sys.__dict__.setdefault("_marquee_held", {})
    if (kind, key) not in store:
        store.clear()
        give_back()
        store[kind, key] = make()
    return store[kind, key]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on through all stages, and neither Python, Arrow nor the C library does so by itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def crc_mod(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def blocks(units: Iterator[str], most: int = 300_000) -> Iterator[list[str]]:
    """Lists of ``most`` units, for texts too long to hold all of theirs."""
    while block := list(islice(units, most)):
        yield block


class Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Remembered:
    """Ids of units (words with their space, say), computed once for all their occurrences while a task remembers them."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.known = Numbering()
        self.ids, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, units: list[list[str]]) -> list[np.ndarray]:
        """The ids of every list of units."""
        if len(self.known) > self.most:
            self.forget()
        before = len(self.known)
        row = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units)))
        if fresh := list(islice(self.known, before, None)):
            ids, lens = self.encode(fresh)
            self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
        size, begin = self.lens[row], (np.cumsum(self.lens) - self.lens)[row]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        cuts = np.r_[0, upto][np.cumsum([0, *map(len, units)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
