"""Near copies by the exact Jaccard similarity of word shingles: proposed by SimHash with multi-index hashing, completed by a prefix filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marquee.llm import simhash
from marquee.llm.common import held, slices, stage
from marquee.llm.simhash import _hashes
from marquee.operators.components import components

#: Words of a shingle, and the least similarity of near copies as a fraction (0.8).
WIDTH, LEAST = 5, (4, 5)
#: Shingles are counted in 2 ** BUCKET_BITS buckets; a bucket is common if it holds so many times the mean (and so many shingles at least).
BUCKET_BITS, COMMON = 20, 8
#: A shingle of at most so many texts has all its pairs compared at once; a larger one is compared with so many of its texts in the first
#: turn and with four times as many in each one after.
SMALL, HEADS = 64, 32
#: Words of the bitmap of wanted documents, as a power of two.
WORD_BITS = 20
#: Shingles are counted in 2 ** SKETCH_BITS parts of a set's sketch; a set with more than MOST_SKETCHED shingles has none.
SKETCH_BITS, MOST_SKETCHED = 7, 32767


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; fewer words make one shingle, no word none."""
    return np.unique(np.array(_hashes(text, width), np.uint64))


def _node(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def prefix(found: np.ndarray, common: dict[int, int]) -> np.ndarray:
    """The first shingles in the order of rarity: those of common buckets come last, by their count; otherwise the hash decides.

    Of two sets with the least similarity, both hold a shared shingle among their first n - ceil(0.8 n) + 1, whatever the order is,
    as long as it is one order for all.
    """
    up, down = LEAST
    want = len(found) + up * len(found) // -down + 1
    count = np.array([common.get(b, 0) for b in (found >> np.uint64(64 - BUCKET_BITS)).tolist()]) if common else np.zeros(len(found))
    return found[np.lexsort((found, count))[:want]]


def _mapped(docs: DataFrame, schema: str, make) -> DataFrame:
    """``make()`` in every task gives the function from (doc ids, texts) to a batch, and one for what comes at the task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near copies", 0, lambda: None)  # a worker of an earlier stage lets go of its model
        work, close = make()
        for batch in batches:
            for part in slices(batch, "text"):
                yield work(part.column("doc_id"), part.column("text").to_pylist())
        yield from close()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, bits) of every row, ``bits`` its SimHash; and as rows without a node what a task counts: (bucket, n) of buckets common in it,
    bucket -1 for all."""
    kind = docs.schema["doc_id"].dataType

    def make():
        counts = np.zeros(1 << BUCKET_BITS, np.int64)

        def work(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            sets = [shingles(t, width) for t in texts]
            np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            nothing = pa.nulls(len(ids), pa.int64())
            return pa.RecordBatch.from_arrays([ids, pa.array([_node(s) for s in sets], pa.binary()), pa.array(simhash.majorities(sets, len(sets))), nothing, nothing],
                                              names=["doc_id", "node", "bits", "bucket", "n"])

        def close() -> Iterator[pa.RecordBatch]:
            often = np.flatnonzero(counts >= max(COMMON, COMMON * counts.mean()))
            k = len(often) + 1
            yield pa.RecordBatch.from_arrays([pa.nulls(k, ids_kind), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(np.r_[-1, often]), pa.array(np.r_[counts.sum(), counts[often]])],
                                             names=["doc_id", "node", "bits", "bucket", "n"])

        return work, close

    from pyspark.sql.pandas.types import to_arrow_type

    ids_kind = to_arrow_type(kind)
    return _mapped(docs, f"doc_id {kind.simpleString()}, node binary, bits bigint, bucket bigint, n bigint", make)


def _common(prints: DataFrame) -> dict[int, int]:
    """Counts of the common buckets of all texts. No more than 2 ** BUCKET_BITS / COMMON buckets can hold COMMON times the mean."""
    counts = prints.where("node is null").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = counts.where("bucket = -1").first()
    least = max(COMMON, COMMON * (total.n if total else 0) / (1 << BUCKET_BITS))
    return {r.bucket: r.n for r in counts.where((F.col("bucket") >= 0) & (F.col("n") >= least)).collect()}


def _index(docs: DataFrame, common: dict[int, int], width: int) -> DataFrame:
    """(token, node, size, pos): the prefix of every text; a task gives a node's once."""
    known = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        seen: set[bytes] = set()

        def work(_: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            found, nodes, sizes = [], [], []
            for t in texts:
                s = shingles(t, width)
                node = _node(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    found.append(prefix(s, known.value))
                    nodes.append(node)
                    sizes.append(len(s))
            n = np.array([len(f) for f in found], np.int64)
            tokens = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(nodes, pa.binary()).take(pa.array(row)), pa.array(np.array(sizes, np.int32)[row], pa.int32()),
                                               pa.array((np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))], names=["token", "node", "size", "pos"])

        return work, lambda: ()

    return _mapped(docs, "token bigint, node binary, size int, pos int", make)


def _marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of ``ids`` (column doc_id): 2 ** WORD_BITS words of 64 bits, however many there are."""
    h = F.xxhash64("doc_id")
    words = ids.groupBy(h.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(doc_id), {WORD_BITS}) & 63 AS int))")).alias("bits"))
    out = np.zeros(1 << WORD_BITS, np.int64)
    for r in words.collect():
        out[r.word] = r.bits
    return out


def sketch(found: np.ndarray) -> np.ndarray | None:
    """How many shingles of a set begin with each of 2 ** SKETCH_BITS bit patterns: two sets share no more than the smaller counts add up to."""
    return np.bincount((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.int16) if len(found) <= MOST_SKETCHED else None


def _sets(docs: DataFrame, wanted: DataFrame, width: int, kind: str) -> DataFrame:
    """(node, size, found, sketch) of the documents with the ``wanted`` ids, and of few others whose ids share their bits; a task gives a node's once.

    ``found`` has whole hashes (bigint) or the distinct first 16 bits of them (smallint), ``sketch`` the counts of :func:`sketch`. Texts stay where they are: the bitmap tells which
    are needed. A full one would only let more through.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_marked(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near copies", 0, lambda: None)  # a worker of an earlier stage lets go of its model
        seen: set[bytes] = set()
        for batch in batches:
            h = batch.column("h").to_numpy()
            kept = batch.filter(pa.array((bits.value[h & ((1 << WORD_BITS) - 1)] >> (h >> WORD_BITS & 63) & 1).astype(bool)))
            for part in slices(kept, "text"):
                found = {_node(s): s for s in (shingles(t, width) for t in part.column("text").to_pylist())}
                new = {k: s for k, s in found.items() if k not in seen}
                seen.update(new)
                whole = [s.view(np.int64) if kind == "bigint" else np.unique((s >> np.uint64(48)).astype(np.uint16)).view(np.int16) for s in new.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([len(s) for s in new.values()], pa.int32()),
                                                  pa.array(whole, pa.list_(pa.int64() if kind == "bigint" else pa.int16())),
                                                  pa.array([sketch(s) for s in new.values()], pa.list_(pa.int16()))], names=["node", "size", "found", "sketch"])

    return docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, f"node binary, size int, found array<{kind}>, sketch array<smallint>")


def _proposed(named: DataFrame) -> DataFrame:
    """Pairs (a, b) that operator 8 proposes: nodes whose SimHash differs in two bits or fewer, by multi-index hashing.

    A node of the same SimHash is paired with the smallest one of it, and these are paired as their SimHashes are linked: no pairs of copies.
    """
    heads = stage(named.groupBy("bits").agg(F.min("node").alias("head")), "heads_of_bits")
    left, right = (heads.select(F.col("bits").alias(c), F.col("head").alias(f"h{c}")) for c in "ab")
    far = simhash.links(heads).join(left, "a").join(right, "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    same = named.join(heads, "bits").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return stage(far.unionByName(same), "proposed")


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes."""
    members = links.select(F.col("b").alias("node"), F.col("a").alias("point")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("point")).distinct())
    return stage(components(members, "node", "point", "root"), "roots")


def _possible(a: str, b: str) -> Column:
    """Whether two sets that meet at these places of their prefixes can be similar enough, if it is the first place where they meet."""
    up, down = LEAST
    size = [F.col(f"{x}.size") for x in (a, b)]
    left = F.least(*[F.col(f"{x}.size") - F.col(f"{x}.pos") for x in (a, b)])
    return (down * F.least(*size) >= up * F.greatest(*size)) & ((up + down) * left >= up * (size[0] + size[1]))


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the least similarity, so that whole rows of shingles travel for few pairs only."""
    left, right = (sets.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    up, down = LEAST
    most = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.join(right, "b").join(left, "a").where(F.coalesce((up + down) * most >= up * (F.col("na") + F.col("nb")), F.lit(True))).select("a", "b").distinct()


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets can have the least similarity. With whole hashes this is the exact similarity.

    Hashes of one set that share their first bits make ``found`` shorter than the set; so many more may be common.
    """
    left, right = (sets.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("found").alias(f"s{c}")) for c in "ab")
    up, down = LEAST
    lost = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb")) + lost
    return pairs.join(right, "b").join(left, "a").where((up + down) * common >= up * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, component_id): one row for every row of ``docs``, with the smallest doc_id of its group of near copies.

    Texts with equal shingle sets are one node, found by a map-side combined minimum. Two nodes are linked if their exact similarity is
    0.8 or more; no link that joins two groups is lost. Linked nodes share a shingle of their prefixes, so nodes meet only there; what
    many texts share comes last in the order and is rarely in a prefix. First the pairs that SimHash proposes are compared, and every node with
    the smallest node that it meets; the rest makes this whole, since two similar sets may differ in many bits. Where a shingle's nodes are not all in one group then, all its pairs across groups are compared, or, if there are more than
    SMALL, all with some of them, four times as many in each turn, until they are one group or every node has been a head. Sizes and places in the prefix
    rule pairs out before any set is fetched; only ids travel. Then sketches of a fixed size and two bytes of every shingle are compared, which can rule out but never
    wrongly, and whole sets are made for the rest. Texts without a word are one group, and so are null texts; a null doc_id
    counts last. An empty table gives no rows; other columns are ignored.
    """
    prints = stage(_prints(docs, width), "prints")
    of_docs = prints.where("node is not null")
    named = stage(of_docs.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("bits").alias("bits")), "nodes")
    proposed = _proposed(named)
    here = W.partitionBy("token")
    at = F.struct("node", "size", "pos")
    first = _index(docs, _common(prints), width).withColumn("at", at).withColumns(
        {"head": F.min("at").over(here), "last": F.max("at").over(here), "n": F.count(F.lit(1)).over(here)})
    met = stage(first.where("head.node <> last.node").where((F.col("n") > 2) | _possible("head", "last")).select("token", "at", "head").distinct(), "met")

    meant = met.select("at.node").union(proposed.select("a")).union(proposed.select("b"))
    some = meant.distinct().join(named, "node").select(F.col("least").alias("doc_id")).distinct()
    short = stage(_sets(docs, some, width, "smallint"), "short")

    def verified(pairs: DataFrame) -> DataFrame:
        """Linked pairs: sketches rule most pairs out, then two bytes a shingle, and whole sets decide on the rest."""
        near = stage(_bounded(pairs, short), "near")
        likely = stage(_compared(near, short), "likely")
        nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        whole = stage(_sets(docs, nodes.join(named, "node").select(F.col("least").alias("doc_id")), width, "bigint"), "whole")
        return stage(_compared(likely, whole), "links")

    star = met.where(F.col("at.node") != F.col("head.node")).where(_possible("at", "head")).groupBy(F.col("at.node").alias("b")).agg(F.min("head.node").alias("a"))
    links = verified(star.select("a", "b").union(proposed.select("a", "b")).distinct())
    roots, rest, most = _roots(links), met.select("token", "at"), HEADS
    while True:
        placed = stage(rest.withColumn("node", F.col("at.node")).join(roots, "node", "left").select("token", "at", F.coalesce("root", "node").alias("root")), "placed")
        split = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("token", "n")
        live = stage(placed.join(split, "token"), "live")
        if live.isEmpty():
            break
        ranked = live.withColumn("k", F.row_number().over(here.orderBy("at.node"))).where(F.col("k") <= max(SMALL, most))
        heads = stage(ranked.where((F.col("n") <= SMALL) | (F.col("k") <= most)).select("token", F.col("at").alias("x"), F.col("root").alias("rx")), "heads")
        against = live.select("token", F.col("at").alias("y"), F.col("root").alias("ry"))
        a, b = F.least("x.node", "y.node"), F.greatest("x.node", "y.node")
        pairs = heads.join(against, "token").where((F.col("rx") != F.col("ry")) & _possible("x", "y")).select(a.alias("a"), b.alias("b")).distinct()
        more = verified(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = _roots(links)
        done = heads.select("token", F.col("x.node").alias("node"))
        large = live.where(F.col("n") > SMALL).select("token", "at", F.col("at.node").alias("node"))
        rest, most = large.join(done, ["token", "node"], "left_anti").select("token", "at"), 4 * most
    least = roots.join(named, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = named.join(roots.join(least, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return of_docs.select("doc_id", "node").join(of_node, "node").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id.

    Rows that repeat that doc_id are reduced to one. Rows without a doc_id take part in no group and stay as they are.
    """
    known = docs.where("doc_id is not null")
    kept = stage(groups(known, width).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")), "kept")
    once, often = kept.where("_n = 1").select("doc_id").hint("merge"), kept.where("_n > 1").select("doc_id")
    return (known.join(once, "doc_id", "left_semi").select(docs.columns)
            .unionByName(known.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
            .unionByName(docs.where("doc_id is null")))
