"""Benchmark decontamination as a prefix-filtered set join, in native DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marquee.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The bitmap of benchmark shingles has 2 ** WORD_BITS words of 64 bits, and so many rows of 16 bytes at most, whatever the benchmark holds.
WORD_BITS = 20


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters and anything beyond ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _shingle(array: str, at: str, size: int) -> Column:
    """64-bit hash of ``size`` consecutive words. The length is a part of it."""
    return F.xxhash64(F.lit(size), *[F.expr(f"{array}[{at} + {i}]") for i in range(size)])


def windows(items: DataFrame, width: int, shingle: int) -> DataFrame:
    """(item_id, win, len, size, offset, hash): the shingles of every window of every item.

    A window is ``width`` consecutive words, or the whole item if it has fewer; ``size`` is the
    shingle length: ``shingle`` words, or the whole window if it has fewer.
    """
    tokens = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = tokens.withColumn("s", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))))
    cut = starts.select("item_id", F.slice("w", F.col("s") + 1, width).alias("win"))
    cut = cut.withColumn("len", F.size("win")).withColumn("size", F.least("len", F.lit(shingle)))
    each = cut.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))))
    pick = reduce(lambda rest, n: F.when(F.col("size") == n, _shingle("win", "offset", n)).otherwise(rest), range(1, shingle + 1), F.lit(None).cast("bigint"))
    return each.withColumn("hash", pick)


def hits(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_rows, n_words, n_hit, items): one row for every doc_id and text.

    1. Every position of a document whose shingle has its bit in a bitmap of the benchmark's is kept,
       with the words around it; a row at position -1 carries the number of words. One pass over the
       texts. Other shingles that share a bit (one in 300 at 200 000 benchmark shingles) match nothing later.
    2. Shingles are ordered by how often they occur in the corpus. To contain a window, a document
       must contain its rarest shingle: that prefix of one token is joined, and only that.
    3. The shingle's offset in the window bounds the window's place in the document, which must
       hold the window's length; then all words are compared.
    4. Occurrences are laid over each other by their positions.

    A document with a passage that a third of the corpus shares costs as many rows as the passage
    has words. ``items`` that are null, empty or without words have no window.
    """
    bench = stage(windows(items, width, shingle), "windows")
    known = stage(bench.select("hash", "size").distinct(), "shingles")
    sizes = sorted(r[0] for r in known.select("size").distinct().collect()) or [shingle]
    mask = (1 << WORD_BITS) - 1
    bit = F.expr(f"shiftleft(1L, cast(shiftright(hash, {WORD_BITS}) & 63 AS int))")
    marks = F.broadcast(stage(known.groupBy(F.col("hash").bitwiseAND(F.lit(mask)).alias("word")).agg(F.bit_or(bit).alias("bits")), "marks"))

    body = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    at = body.withColumn("pos", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)))
    one = [F.when((F.col("pos") >= 0) & (F.col("pos") + n <= F.size("w")), _shingle("w", "pos", n)) for n in sizes]
    probed = (at.withColumn("hash", one[0]) if len(one) == 1 else
              at.withColumn("hash", F.explode(F.when(F.col("pos") < 0, F.array(F.lit(None).cast("bigint"))).otherwise(F.array(*one)))))
    probed = (probed.where("pos < 0 or hash is not null").withColumn("word", F.col("hash").bitwiseAND(F.lit(mask))).join(marks, "word", "left")
              .where((F.col("pos") < 0) | (F.col("bits").bitwiseAND(bit) != 0)))
    reach = width - 1
    near = F.slice("w", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.lit(2 * reach + shingle))
    found = stage(probed.select("doc_id", "text_hash", "pos", "hash", F.size("w").alias("n_words"), F.when(F.col("pos") >= 0, near).alias("near")), "found")

    seen = found.where("pos >= 0").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("item_id", "win").orderBy("n", "hash", "offset"))
    ranked = bench.join(seen, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # a window with a shingle that the corpus lacks occurs nowhere
    prefix = ranked.withColumn("r", first).where("r = 1 and n > 0").select("hash", "item_id", "win", "len", "offset")
    text_at = F.col("pos") - F.greatest(F.col("pos") - reach, F.lit(0)) - F.col("offset")  # the window's place in ``near``
    start = F.col("pos") - F.col("offset")
    met = (found.where("pos >= 0").join(prefix, "hash")
           .where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
           .where(F.slice("near", text_at + 1, F.col("len")) == F.col("win"))
           .select("doc_id", "text_hash", start.alias("s"), (start + F.col("len")).alias("e"), "item_id"))
    met = stage(met, "met")

    key = ["doc_id", "text_hash"]
    spans = met.select(*key, "s", "e").distinct()
    ended = F.max("e").over(W.partitionBy(*key).orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1))
    covered = spans.withColumn("before", F.coalesce(ended, F.lit(0))).select(*key, F.greatest(F.col("e") - F.greatest("s", "before"), F.lit(0)).alias("hit"))
    parts = (found.where("pos < 0").select(*key, F.lit(1).alias("rows"), "n_words", F.lit(0).alias("hit"), F.lit(None).cast("string").alias("item_id"))
             .unionByName(covered.select(*key, F.lit(0).alias("rows"), F.lit(0).alias("n_words"), "hit", F.lit(None).cast("string").alias("item_id")))
             .unionByName(met.select(*key, "item_id").distinct().select(*key, F.lit(0).alias("rows"), F.lit(0).alias("n_words"), F.lit(0).alias("hit"), "item_id")))
    return parts.groupBy(*key).agg(F.sum("rows").alias("n_rows"), F.max("n_words").cast("bigint").alias("n_words"), F.sum("hit").alias("n_hit"),
                                   F.array_sort(F.collect_set("item_id")).alias("items"))


def report(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): one row for every row of ``docs``.

    Null texts have no words. Repeated rows give equal rows; rows that share a doc_id but not the
    text are judged each by its own text.
    """
    per = hits(docs, items, width, shingle).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    return per.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 5) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    bad = stage(hits(docs, items, width, shingle).where("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_h"]), "left_anti")
