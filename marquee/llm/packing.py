"""Best-fit packing of documents into sequences of bounded length, partition by partition and then up a tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import held, slices, stage
from marquee.llm.token_store import TextEncoder

#: Tokens of a sequence.
MOST = 2048
#: Pieces that a task packs at a time.
BLOCK = 1 << 16
#: Nodes that meet in one node of the next level of the tree, and levels that a tree can have (16 to the 8th partitions).
FAN, LEVELS = 16, 8
#: Bits of a sequence's number that count within a partition.
WITHIN = 40

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def best_fit(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin: the largest items first, each into the fullest bin that has room.

    Bins wait in stacks by their room; a bit for each room that some bin has finds the smallest one that is large enough.
    """
    rooms: list[list[int]] = [[] for _ in range(most + 1)]
    taken, bits, fills = sizes.tolist(), 0, []
    where, offset = [0] * len(taken), [0] * len(taken)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = taken[i]
        if enough := bits >> size:
            room = size + (enough & -enough).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            room, b = most, len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += size
        if room := room - size:
            rooms[room].append(b)
            bits |= 1 << room
    return np.array(where, np.int64), np.array(offset, np.int64), np.array(fills, np.int64)


def _open(fills: np.ndarray, most: int) -> np.ndarray:
    """Which bins go on to the next round.

    After a best fit no two bins fit together, so at most one is half full or less. Only such bins can ever move, one from each node, and
    FAN * LEVELS is more than can arrive on the way to the root; so that one and as many of the other bins, those with most room, are enough
    to take whatever could be taken. All other bins, nearly full or without a possible partner, are done.
    """
    out = np.zeros(len(fills), bool)
    out[np.argsort(fills, kind="stable")[:FAN * LEVELS + 1]] = True
    return out & (fills < most)


def _cut(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces: only the first piece of a longer document may be shorter than ``most``."""
    counts = -(-lengths // most)
    doc = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = lengths - (counts - 1) * most
    start = np.where(piece > 0, first[doc] + (piece - 1) * most, 0)
    return doc, piece, start, np.where(piece > 0, most, first[doc])


class Packer:
    """Packs the pieces of one partition block by block; its open bins are items of the next block."""

    def __init__(self, part: int, most: int):
        self.part, self.most, self.made = part, most, 0
        self.waiting: list[dict[str, np.ndarray]] = []
        self.size = 0
        #: Rows of the open bins, with ``bin`` as a number from 0 and ``offset`` inside it, and their fills.
        self.rows: dict[str, np.ndarray] | None = None
        self.fills = np.zeros(0, np.int64)

    def add(self, rows: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        self.waiting.append(rows)
        self.size += len(rows["length"])
        if self.size >= BLOCK:
            yield self._pack(False)

    def close(self) -> Iterator[dict[str, np.ndarray]]:
        if self.waiting or self.rows is not None:
            yield self._pack(True)

    def _pack(self, last: bool) -> dict[str, np.ndarray]:
        """Rows of the bins that are done; at the end all rows, those of open bins marked."""
        n = len(self.fills)
        fresh = {c: np.concatenate([w[c] for w in self.waiting]) for c in self.waiting[0]} if self.waiting else {}
        self.waiting, self.size = [], 0
        if fresh:
            fresh |= {"bin": n + np.arange(len(fresh["length"])), "offset": np.zeros(len(fresh["length"]), np.int64)}
        kept = [r for r in (self.rows, fresh) if r]
        rows = {c: np.concatenate([r[c] for r in kept]) for c in kept[0]}
        where, shift, fills = best_fit(np.concatenate([self.fills, fresh["length"]]) if fresh else self.fills, self.most)
        rows["offset"], rows["bin"] = rows["offset"] + shift[rows["bin"]], where[rows["bin"]]
        open_ = _open(fills, self.most)
        stays = open_[rows["bin"]]
        number = np.zeros(len(fills), np.int64)
        if last:
            number[:] = self.made + np.arange(len(fills))
            done = rows | {"open": stays}
        else:
            number[~open_] = self.made + np.arange(int((~open_).sum()))
            done = {c: x[~stays] for c, x in rows.items()} | {"open": np.zeros(int((~stays).sum()), bool)}
            place = np.cumsum(open_) - 1
            self.rows = {c: x[stays] for c, x in rows.items()} | {"bin": place[rows["bin"][stays]]}
            self.fills = fills[open_]
        self.made += len(fills) if last else int((~open_).sum())
        return done | {"bin": (self.part << WITHIN) + number[done["bin"]]}


def packed_by_partition(docs: DataFrame, model: str, end: int, most: int = MOST) -> DataFrame:
    """(node, bin, offset, open) and the columns PIECES: all pieces, packed by best fit inside each partition of ``docs``."""
    spark = docs.sparkSession
    with open(model, encoding="utf-8") as f:
        model_text = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held("text encoder", hash(model_text.value), lambda: TextEncoder(model_text.value))
        part = TaskContext.get().partitionId()
        packer = Packer(part, most)

        def batch_of(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            known = pa.array(rows["doc_id"], pa.int64(), mask=rows["null"])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(known), part, np.int32)), pa.array(rows["bin"]), pa.array(rows["offset"]), pa.array(rows["open"]), known,
                 pa.array(rows["piece"].astype(np.int32)), pa.array(rows["start"]), pa.array(rows["length"]), pa.array(rows["crc"])],
                names=["node", "bin", "offset", "open", "doc_id", "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            for some in slices(batch, "text"):
                ids = [np.append(i, end).astype("<u4") for i in encode(some.column("text").to_pylist())]
                doc, piece, start, length = _cut(np.array([len(i) for i in ids]), most)
                crc = [zlib.crc32(ids[d][a:a + n].tobytes()) for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                name = some.column("doc_id")
                null, name = name.is_null().to_numpy(zero_copy_only=False), name.fill_null(0).to_numpy(zero_copy_only=False)
                for done in packer.add({"doc_id": name[doc], "null": null[doc], "piece": piece, "start": start, "length": length, "crc": np.array(crc, np.int64)}):
                    yield batch_of(done)
        for done in packer.close():
            yield batch_of(done)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"node int, bin bigint, offset bigint, open boolean, {PIECES}")


def _merged(opened: DataFrame, most: int) -> DataFrame:
    """One level of the tree: the open bins of FAN nodes are items of a best fit. (node, bin, into, shift, fill, open)."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        bins = table.column("bin").to_numpy()
        where, shift, fills = best_fit(table.column("fill").to_numpy(), most)
        into = np.zeros(len(fills), np.int64)
        into[where[shift == 0]] = bins[shift == 0]  # a bin keeps the number of its first item
        return pa.table({"node": table.column("node"), "bin": bins, "into": into[where], "shift": shift, "fill": fills[where], "open": _open(fills, most)[where]})

    up = opened.select(F.floor(F.col("node") / FAN).cast("int").alias("node"), "bin", "fill")
    return up.groupBy("node").applyInArrow(meet, "node int, bin bigint, into bigint, shift bigint, fill bigint, open boolean")


def pack(docs: DataFrame, model: str, end: int, most: int = MOST) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents packed into sequences of at most ``most`` tokens.

    Every text is encoded by the tokenizers library, with ``end`` after it (null as empty). A document longer than ``most`` is cut into
    pieces of ``most`` tokens, of which the first may be shorter. A partition packs its pieces by best fit, the largest first, and keeps
    its open bins; up a tree of FAN nodes each, open bins are themselves items of a further best fit, until one node is left. A node
    holds FAN * (FAN * LEVELS + 1) bins at most, and at most one bin moves from each node, so only bins that were open at a partition's
    end are joined with the moves. In the result at most one sequence is half full or less.

    A text that stands in several rows is packed for each of them. Rows without a doc_id keep a null. Other columns are ignored. An
    empty table has no piece. The pieces are written before the tree is built, so a lost executor changes no number.
    """
    if most < 1:
        raise ValueError("a sequence holds one token at least")
    placed = stage(packed_by_partition(docs, model, end, most), "packed")
    opened = placed.where("open").groupBy("node", "bin").agg(F.sum("length").alias("fill"))
    nodes = (placed.agg(F.max("node")).first()[0] or 0) + 1
    rounds = []
    while nodes > 1:
        met = stage(_merged(opened, most), "met")
        rounds.append(met.where("bin <> into").select("bin", "into", "shift"))
        opened, nodes = met.where("bin = into and open").select("node", "bin", "fill"), -(-nodes // FAN)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if not rounds:
        return placed.select(*columns, F.col("bin").alias("sequence_id"), "offset")

    def above(later: DataFrame, step: DataFrame) -> DataFrame:
        """The moves of a level, carried on by those of the levels above it, and these."""
        top = later.select(F.col("bin").alias("into"), F.col("into").alias("_into"), F.col("shift").alias("_shift"))
        return later.unionByName(step.join(top, "into", "left").select(
            "bin", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift")))

    moves = stage(reduce(above, reversed(rounds)), "moves")
    moved = placed.where("open").join(moves, "bin", "left").select(
        *columns, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return placed.where("not open").select(*columns, F.col("bin").alias("sequence_id"), "offset").unionByName(moved)
