"""Document fingerprints: quartile digests of hashed byte triplets, and their bounded difference."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marquee.llm.common import CHUNK_CHARS, slices, stage

BUCKETS = 256
#: Distance of two quartile codes by their difference; opposite ends count more than three steps.
STEPS = np.array([0, 1, 2, 6])
#: Most that a difference of lengths may add to a difference score, which then is at most MOST.
LENGTH_MOST = 2 * BUCKETS
MOST = int(STEPS[-1]) * BUCKETS + LENGTH_MOST


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of bytes for every text: a code of its length, then a quartile (0 to 3) for every bucket.

    Every three consecutive bytes are hashed into one of 256 buckets and counted; a bucket's code says between which quartiles of
    the text's own counts it lies. A text of fewer than three bytes has no triplet and all codes 0.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    for first, last in _blocks(sizes):
        data = np.frombuffer(b"".join(texts[first:last]), np.uint8).astype(np.uint32)
        if len(data) < 3:
            continue
        triplet = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        bucket = ((triplet * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)
        owner = np.repeat(np.arange(last - first), sizes[first:last])
        inside = owner[:-2] == owner[2:]
        counts[first:last] = np.bincount((owner[:-2] * BUCKETS + bucket)[inside], minlength=(last - first) * BUCKETS).reshape(-1, BUCKETS)
    ordered = np.sort(counts, axis=1)
    quartiles = [ordered[:, k * BUCKETS // 4 - 1, None] for k in (1, 2, 3)]
    codes = sum((counts > q).astype(np.uint8) for q in quartiles)
    length = np.minimum(np.round(8 * np.log2(sizes + 1)), 255).astype(np.uint8)
    return np.column_stack([length, codes])


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of CHUNK_CHARS bytes together, or single longer ones."""
    first = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > CHUNK_CHARS:
            yield first, i
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield first, len(sizes)


def spelled(rows: np.ndarray) -> list[str]:
    """Digests as hexadecimal text: two digits of length, two bits for each bucket."""
    codes = rows[:, 1:].reshape(len(rows), -1, 4)
    packed = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    return [bytes(r).hex() for r in np.column_stack([rows[:, :1], packed]).astype(np.uint8)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the difference score over its bound; 1 for equal digests, never below 0."""
    far = STEPS[np.abs(a[:, 1:].astype(np.int64) - b[:, 1:])].sum(axis=1)
    length = np.minimum(4 * np.abs(a[:, 0].astype(np.int64) - b[:, 0]), LENGTH_MOST)
    return 1 - (far + length) / MOST


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``, or all of them."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
          ("near_edited", pa.float64()), ("near_next", pa.float64())]
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(ids: list[int | None], texts: list[str], following: list[str]) -> list[pa.Array]:
    """The result columns for texts and the ones that follow them."""
    changed = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
    chain = len(texts) > 1 and all(following[i] is texts[i + 1] for i in range(len(texts) - 1))
    own = digests([t.encode() for t in texts])
    after = np.concatenate([own[1:], digests([following[-1].encode()])]) if chain else digests([f.encode() for f in following])
    made = digests(changed)
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], spelled(own), spelled(made), likeness(own, made), likeness(own, after)]
    return [pa.array(c, kind) for c, (_, kind) in zip(columns, RESULT, strict=True)]


def compare_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row for every row of ``docs``.

    The next document is the next in ascending doc_id order, equal ids by a hash of their text, null ids first; after the last comes the
    first, and a single document follows itself. Null texts count as empty. Texts are shuffled once, into ranges of doc_id that are
    sorted; a task goes through its range and knows the next text of every row but the last. The first and last row of every range
    are put aside with their texts, and the few of them are joined in a second, small step.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    names = [n for n, _ in RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = TaskContext.get().partitionId(), None

        def out(columns: list[pa.Array], edge: str | None = None, text: str | None = None) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array([text] * n, pa.string())],
                                              names=[*names, "part", "edge", "edge_text"])

        def aside(doc_id: int | None, text: str, edge: str) -> pa.RecordBatch:
            return out([pa.array([doc_id], pa.int64()), *[pa.nulls(1, kind) for _, kind in RESULT[1:]]], edge, text)

        for batch in batches:
            for some in slices(batch, "text"):
                ids, texts = some.column("doc_id").to_pylist(), some.column("text").to_pylist()
                if waiting is None:
                    yield aside(ids[0], texts[0], "first")
                else:
                    ids, texts = [waiting[0], *ids], [waiting[1], *texts]
                if len(ids) > 1:
                    yield out(_judge(ids[:-1], texts[:-1], texts[1:]))
                waiting = ids[-1], texts[-1]
        if waiting is not None:
            yield aside(*waiting, "last")

    found = stage(dealt.mapInArrow(run, f"{SCHEMA}, part int, edge string, edge_text string"), "digests")
    firsts = found.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("edge_text").alias("following"))
    lasts = found.where("edge = 'last'").select("part", "doc_id", "edge_text")
    # one row for every range that has rows
    parts = lasts.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy(F.lit(1)))))

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "edge_text"):
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays(_judge(*[some.column(n).to_pylist() for n in ("doc_id", "edge_text", "following")]), names=names)

    ends = lasts.join(parts, "part").join(firsts, "next_part").select("doc_id", "edge_text", "following").mapInArrow(join_ends, SCHEMA)
    return found.where("edge is null").select(*names).unionByName(ends)
