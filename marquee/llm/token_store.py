"""Token ids on disk as directly addressable codes."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marquee.llm.common import CHUNK_CHARS, Remembered, blocks, held, slices, stage

MAGIC = b"DAC1"
#: Bits of a chunk, and bits of a bitmap for each entry of its rank directory.
CHUNK, RANKED = 8, 512
#: Where the pre-tokenizer always starts anew: at a space before a visible character (but a full stop or comma), and at a full stop,
#: comma or line end after a letter or digit. The space is left out of its unit; only units without one begin with the other three.
CUT = r" (?=[!-+\-/-~\w])|(?=[.,\n])(?<=[^\W_])"
#: Marks the unit that begins a text. No other unit begins with it.
BARE = "\0"
#: Units that are encoded as one text.
SIDE_BY_SIDE = 5_000
#: Units that a worker remembers.
UNITS_HELD = 1_200_000
#: A shard ends with the document that brings it to so many ids.
SHARD_IDS = 1 << 18


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of non-negative ids.

    Level k holds chunk k (8 bits) of every id that is long enough. A bitmap for each level but the last says which of its entries
    go on; the rank directory counts the ones before every 512th bit, which gives an entry's place in the next level.
    Layout: magic, number of levels, number of ids at each level, then for each level chunks, bitmap and directory.
    """
    levels, left = [], np.asarray(ids, np.uint32)
    while True:
        goes_on = left >> CHUNK > 0
        levels.append(((left & 255).astype(np.uint8), goes_on))
        if not goes_on.any():
            break
        left = left[goes_on] >> CHUNK
    out = [MAGIC, struct.pack("<I", len(levels)), np.array([len(c) for c, _ in levels], "<u8").tobytes()]
    for k, (chunks, goes_on) in enumerate(levels):
        out.append(chunks.tobytes())
        if k + 1 < len(levels):
            padded = np.pad(goes_on, (0, -len(goes_on) % RANKED))
            ones = padded.reshape(-1, RANKED).sum(axis=1)
            out += [np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
    return b"".join(out)


class Packed:
    """Reads what ``pack`` wrote."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        n = struct.unpack_from("<I", data, 4)[0]
        self.sizes = np.frombuffer(data, "<u8", n, 8).astype(int).tolist()
        self.chunks, self.bits, self.ranks, at = [], [], [], 8 + 8 * n
        for k, size in enumerate(self.sizes):
            self.chunks.append(np.frombuffer(data, np.uint8, size, at))
            at += size
            if k + 1 < n:
                blocks = -(-size // RANKED)
                self.bits.append(np.frombuffer(data, np.uint8, blocks * RANKED // 8, at))
                at += blocks * RANKED // 8
                self.ranks.append(np.frombuffer(data, "<u4", blocks, at))
                at += 4 * blocks

    def __len__(self) -> int:
        return self.sizes[0]

    def __getitem__(self, i: int) -> int:
        """One id: one chunk and one rank at each of its levels; nothing else is decoded."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, chunks in enumerate(self.chunks):
            value |= int(chunks[i]) << (CHUNK * k)
            if k == len(self.bits) or not self.bits[k][i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANKED
            within = int.from_bytes(self.bits[k][block * RANKED // 8:(block + 1) * RANKED // 8].tobytes(), "little")
            i = int(self.ranks[k][block]) + (within & ((1 << (i % RANKED)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, from the last level up."""
        left = self.chunks[-1].astype(np.uint32)
        for k in range(len(self.bits) - 1, -1, -1):
            here = self.chunks[k].astype(np.uint32)
            here[np.flatnonzero(np.unpackbits(self.bits[k], bitorder="little")[:len(here)])] |= left << CHUNK
            left = here
        return left


class TextEncoder:
    """The tokenizers library over whole texts, called once for each distinct unit.

    A byte-level pre-tokenizer always starts anew at a space before a visible character, so a text may be cut there. Other
    tokenizers get whole texts.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        plan = json.loads(model)
        pre = plan.get("pre_tokenizer") or {}
        self.cut = re.compile(CUT) if (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                                                   and not plan.get("normalizer") and not plan.get("truncation")) else None
        # a special token with a space inside, or one that takes spaces from around it, would not survive the cut
        if any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in plan.get("added_tokens", [])):
            self.cut = None
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(self.model.get_vocab_size(), np.int64)  # bytes of each token: a byte-level piece has a character for each
        for piece, i in vocabulary.items():
            self.lengths[i] = len(piece)
        for t in plan.get("added_tokens", []):
            self.lengths[t["id"]] = len(t["content"].encode())
        self.units = Remembered(self._encode, UNITS_HELD)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units. Those with a space before them are encoded side by side as one text, and told apart by the tokens' bytes."""
        out, sizes = [], np.zeros(len(units), np.int64)
        alone = [i for i, u in enumerate(units) if u[0] in ".,\n\0"]
        for i, got in zip(alone, self.model.encode_batch_fast([units[i].removeprefix(BARE) for i in alone], add_special_tokens=False), strict=True):
            out.append((np.array([i]), np.array(got.ids, np.int64)))
            sizes[i] = len(got.ids)
        spaced = np.setdiff1d(np.arange(len(units)), alone)
        for k in range(0, len(spaced), SIDE_BY_SIDE):
            some = spaced[k:k + SIDE_BY_SIDE]
            texts = [" " + units[i] for i in some.tolist()]
            ids = np.array(self.model.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum([len(t.encode()) for t in texts])
            upto = np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="right")
            sizes[some] = np.diff(np.r_[0, upto])
            out.append((some, ids))
        flat = np.zeros(int(sizes.sum()), np.int32)
        begin = np.cumsum(sizes) - sizes
        for some, ids in out:
            n = sizes[some]
            flat[np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return flat, sizes

    def _cut_slowly(self, text: str) -> Iterator[str]:
        """The units of a very long text, one by one."""
        start, mark = 0, BARE
        for m in self.cut.finditer(text):
            if m.start() > start or not mark:
                yield mark + text[start:m.start()]
            start, mark = m.end(), ""
        if start < len(text):
            yield mark + text[start:]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.cut is None:
            return [np.array(e.ids, np.int32) for e in self.model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(texts) == 1 and len(texts[0] or "") > CHUNK_CHARS:
            return [np.concatenate([self.units([part])[0] for part in blocks(self._cut_slowly(texts[0]))])]
        units = []
        for t in texts:
            parts = self.cut.split(t or "")
            parts[0] = BARE + parts[0]
            units.append(parts if len(parts[0]) > 1 else parts[1:])
        return self.units(units)


def write(docs: DataFrame, model: str, end: int) -> DataFrame:
    """Encode every text, append ``end``, and write shards in ascending doc_id order: (part, seq, n_ids, doc_ids, counts, payload).

    Rows are range-partitioned by doc_id (equal ids by a hash of the text, null ids first) and sorted; a task encodes its rows in
    that order and cuts shards at documents, so it holds one shard at a time. The shards are Parquet rows whose ``payload`` is the
    file format: Spark commits them as a whole, so a lost task leaves no half-written file. An empty table writes no shard.
    """
    spark = docs.sparkSession
    with open(model, encoding="utf-8") as f:
        model_text = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held("text encoder", hash(model_text.value), lambda: TextEncoder(model_text.value))
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                                               pa.array([[len(i) for i in ids]], pa.list_(pa.int64())), pa.array([pack(np.concatenate(ids))], pa.binary())],
                                              names=["part", "seq", "n_ids", "doc_ids", "counts", "payload"])

        for batch in batches:
            for some in slices(batch, "text"):
                for name, got in zip(some.column("doc_id").to_pylist(), encode(some.column("text").to_pylist()), strict=True):
                    ids.append(np.append(got, end))
                    names.append(name)
                    size += len(ids[-1])
                    if size >= SHARD_IDS:
                        yield shard()
                        seq, size, ids, names = seq + 1, 0, [], []
        if ids:
            yield shard()

    return stage(dealt.mapInArrow(run, "part int, seq int, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, payload binary"), "shards")


def offsets(shards: DataFrame) -> DataFrame:
    """(part, seq, first): ids before each shard. Sums by part meet first; only one row for each part is put in line."""
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return (shards.select("part", "seq", "n_ids").withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("first")))


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids from the shards; ids are little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, doc_ids, counts, payload in zip(*[batch.column(n).to_pylist() for n in ("part", "seq", "doc_ids", "counts", "payload")], strict=True):
                ids = Packed(payload).all().astype("<u4")
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(counts), pa.int32()), pa.array([seq] * len(counts), pa.int32()), pa.array(doc_ids, pa.int64()),
                                                  pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                                                  pa.array([ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), counts, strict=True)], pa.binary())],
                                                 names=["part", "seq", "doc_id", "within", "n_tokens", "ids"])

    return shards.mapInArrow(run, "part int, seq int, doc_id bigint, within bigint, n_tokens bigint, ids binary")


def index(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all read back from the shards. ``start`` counts the ids of all documents before."""
    rows = read(shards).select("part", "seq", "doc_id", "within", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(offsets(shards), ["part", "seq"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_at(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, id): the id at each of ``positions`` (a bigint column ``position``), without decoding anything else.

    A position asked for twice gives one row, one outside the file none.
    """
    stripe = lambda c: F.floor(c / SHARD_IDS).cast("bigint")
    placed = (offsets(shards).join(shards.select("part", "seq", "n_ids"), ["part", "seq"])
              .withColumn("_stripe", F.explode(F.sequence(stripe(F.col("first")), stripe(F.col("first") + F.col("n_ids") - 1)))))
    where = (positions.select("position", stripe(F.col("position")).alias("_stripe")).distinct().join(placed, "_stripe")
             .where((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_ids"))))
    asked = where.groupBy("part", "seq").agg(F.collect_list(F.col("position")).alias("positions"), F.first("first").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, wanted, payload in zip(*[batch.column(n).to_pylist() for n in ("first", "positions", "payload")], strict=True):
                shard = Packed(payload)
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([shard[p - first] for p in wanted], pa.int64())], names=["position", "id"])

    return asked.join(shards.select("part", "seq", "payload"), ["part", "seq"]).select("first", "positions", "payload").mapInArrow(run, "position bigint, id bigint")
