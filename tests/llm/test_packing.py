"""Best-fit packing: whole, gapless, small; the tree; odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(BYTES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 64))
def test_best_fit_equals_looking_at_every_bin(sizes, most):
    where, offset, fills = packing.best_fit(np.array(sizes, np.int64), most)
    bins = []
    for size in sorted(sizes, reverse=True):
        fit = [f for f in bins if f + size <= most]
        if fit:
            bins.remove(max(fit))
        bins.append((max(fit) if fit else 0) + size)
    assert sorted(fills.tolist()) == sorted(bins)
    for b, fill in enumerate(fills.tolist()):
        spans = sorted((o, o + s) for w, o, s in zip(where.tolist(), offset.tolist(), sizes, strict=True) if w == b)
        assert [s for s, _ in spans] == [0, *[e for _, e in spans[:-1]]] and spans[-1][1] == fill <= most


def check(rows, texts, end, most):
    """Every document is there once, cut as it should be, and every sequence is gapless and within its bound."""
    ids = {d: [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, end] for d, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for d, found in by_doc.items():
        found.sort(key=lambda r: r.piece)
        n = len(ids[d])
        want = [n % most or most] + [most] * (-(-n // most) - 1)
        assert [(r.piece, r.start, r.length) for r in found] == [(k, sum(want[:k]), w) for k, w in enumerate(want)]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start:r.start + r.length], "<u4").tobytes()) for r in found)
    fills = []
    for found in by_sequence.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))]
        fills.append(sum(r.length for r in found))
    assert max(fills) <= most and sum(2 * f <= most for f in fills) <= 1
    return fills


def test_op11(spark, table):
    texts = [(r.doc_id, r.text) for r in table("documents").collect()]
    fills = check(queries.QUERIES["op11_best_fit_packing"](spark, FOLDER).collect(), texts, 0, 2048)
    assert len(fills) <= 1.02 * sum(fills) / 2048 + 1


def test_many_partitions_meet_in_a_tree(spark):
    rng = random.Random(5)
    texts = [(d, " ".join(rng.choice(["one", "two", "longer"]) for _ in range(int(rng.paretovariate(1.1) * 8)))) for d in range(1500)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(40)
    fills = check(packing.pack(docs, BYTES, 7, 128).collect(), texts, 7, 128)
    whole = packing.best_fit(np.concatenate([packing._cut(np.array([len(TOKENIZER.encode(t).ids) + 1 for _, t in texts]), 128)[3]]), 128)[2]
    assert len(fills) <= len(whole) + 4


def test_blocks_of_one_partition(monkeypatch):
    rng = np.random.default_rng(3)
    packer, sizes, rows = packing.Packer(3, 100), rng.integers(1, 60, 2000), []
    monkeypatch.setattr(packing, "BLOCK", 300)
    for k in range(0, 2000, 70):
        n = sizes[k:k + 70]
        rows += packer.add({"length": n, "row": np.arange(k, k + len(n))})
    rows += packer.close()
    got = {c: np.concatenate([r[c] for r in rows]) for c in ("length", "row", "bin", "offset", "open")}
    assert sorted(got["row"].tolist()) == list(range(2000)) and (got["bin"] >> packing.WITHIN == 3).all()
    fills = defaultdict(int)
    for b, o, n in sorted(zip(got["bin"].tolist(), got["offset"].tolist(), got["length"].tolist(), strict=True)):
        assert o == fills[b]
        fills[b] += n
    assert max(fills.values()) <= 100 and len(fills) <= 1.03 * sizes.sum() / 100 and any(got["open"])


def test_odd_rows(spark, odd, none):
    rows = packing.pack(odd, BYTES, 0, 64).collect()
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id] += r.length
    assert whole[1] == whole[2] == 1 and whole[4] == 2 * whole[5] and None in whole and whole[3] > 10_000
    fills = defaultdict(list)
    for r in rows:
        fills[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(v)[:k]) for v in fills.values() for k, (o, _) in enumerate(sorted(v))) and max(sum(n for _, n in v) for v in fills.values()) <= 64
    assert packing.pack(none, BYTES, 0).count() == 0


def test_one_text_in_a_third_of_all_rows(spark):
    docs = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "the same words again").otherwise(F.concat_ws(" ", F.lit("text"), "id")).alias("text")).withColumnRenamed("id", "doc_id")
    check(packing.pack(docs, BYTES, 0, 50).collect(), [(r.doc_id, r.text) for r in docs.collect()], 0, 50)
