"""SimHash fingerprints, and near duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marquee.llm.common import arrow_map, stage
from marquee.operators.components import components

SEED = 42
#: Shingles whose bits are spread out at a time (64 bytes each).
BLOCK = 1 << 17


def _hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words, repeats included; fewer words make one shingle."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - width].tolist(), ends[width - 1:].tolist(), strict=True)]


def _ones(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def _majorities(texts: list[str | None], width: int) -> np.ndarray:
    """The fingerprint of every text, as signed 64-bit numbers."""
    return majorities((_hashes(t, width) for t in texts), len(texts))


def majorities(found: Iterable[Sequence[int]], n: int) -> np.ndarray:
    """The fingerprints of ``n`` texts from the hashes of their shingles, as signed 64-bit numbers."""
    out = np.zeros(n, np.uint64)
    held: list[tuple[int, Sequence[int]]] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        counts = np.array([len(h) for _, h in held])
        flat = np.concatenate([np.array(h, np.uint64) for _, h in held])
        ones = _ones(flat, np.cumsum(counts) - counts)
        out[[i for i, _ in held]] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        held.clear()

    for i, h in enumerate(found):
        if len(h) > BLOCK:  # a very long text is summed block by block
            ones = sum(_ones(np.array(h[k:k + BLOCK], np.uint64), np.array([0])) for k in range(0, len(h), BLOCK))
            out[i] = np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8")[0, 0]
        elif len(h):
            held.append((i, h))
            size += len(h)
            if size > BLOCK:
                flush()
                size = 0
    flush()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits): the 64-bit SimHash of every row's whole text.

    Bit i is 1 if it is set in more than half of the hashes of the text's word shingles. Null,
    empty and white texts have fingerprint zero. Repeated rows stay; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, f"doc_id {kind}, bits bigint",
                     lambda c: {"doc_id": pa.array(c["doc_id"]) if any(x is not None for x in c["doc_id"]) else pa.nulls(len(c["doc_id"]), pa.int64()),
                                "bits": _majorities(c["text"], width)})


def links(prints: DataFrame, bits: str = "bits") -> DataFrame:
    """(a, b): links that connect all distinct fingerprints at 2 or fewer differing bits.

    Multi-index hashing with two 32-bit segments: of two fingerprints at distance 2 or less, each
    is within one bit, in one segment, of a common point. Every fingerprint therefore enumerates
    the ball of radius 1 in each segment, keeps the other segment as it is, and looks the points
    up in one table. A point has at most 65 fingerprints around it, so no bucket can grow with the
    data, however many copies there are; each is linked to the smallest one there once the
    complete distance is verified. Two that share a point are at most two links apart, and no
    link between different fingerprints is lost to the components.
    """
    segment = F.explode(F.sequence(F.lit(-1), F.lit(63)))  # -1: the point itself; 0-31 and 32-63: a flip in either segment
    flip = F.expr("if(_flip < 0, 0L, shiftleft(1L, _flip))")
    probes = (prints.select(F.col(bits).alias("b"), segment.alias("_flip"))
              .select("b", F.col("b").bitwiseXOR(flip).alias("point")))
    met = probes.withColumn("a", F.min("b").over(W.partitionBy("point")))
    return met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b").distinct()


def groups(prints: DataFrame) -> DataFrame:
    """(bits, component_id, n): every distinct fingerprint with the smallest doc_id of its component.

    ``prints`` has (doc_id, bits) and is read twice, so it should be staged. Copies meet in one
    map-side combined minimum. A component without any doc_id has a null component_id.
    """
    distinct = stage(prints.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    pairs = stage(links(distinct), "links")
    members = pairs.select(F.col("b").alias("bits"), F.col("a").alias("point")).unionByName(
        pairs.select(F.col("a").alias("bits"), F.col("a").alias("point")).distinct())
    roots = stage(components(members, "bits", "point", "root"), "roots")
    least = roots.join(distinct, "bits").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("bits", "component_id")
    return stage(distinct.join(named, "bits", "left").select("bits", F.coalesce("component_id", "least").alias("component_id"), "n"), "groups")


def near_duplicates(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits, component_id): one row for every row of ``docs``.

    Ties and copies share their component; the component's id is its smallest doc_id (null ids
    count last, and a component of null ids alone has a null id). An empty table gives no rows.
    """
    prints = stage(fingerprints(docs, width, doc_id, text), "prints")
    named = groups(prints).select("bits", "component_id")
    return prints.join(named, "bits").select("doc_id", "bits", "component_id")


def deduplicate(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest doc_id.

    Rows that repeat that doc_id are reduced to one. Rows without a doc_id take part in no group
    and stay as they are.
    """
    known = docs.where("doc_id is not null")
    found = near_duplicates(known, width)
    kept = stage(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")), "kept")
    # nearly every document is kept, so its ids outgrow a broadcast; dealing both sides by id costs the same at every size
    once, often = kept.where("_n = 1").select("doc_id").hint("merge"), kept.where("_n > 1").select("doc_id")
    return (known.join(once, "doc_id", "left_semi").select(docs.columns)
            .unionByName(known.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
            .unionByName(docs.where("doc_id is null")))
