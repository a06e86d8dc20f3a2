"""Sketches rule out pairs before their shingles travel, never a near copy."""

import numpy as np

from marquee.llm import near_copies


def drawn(rng, n):
    return np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 9000):
        a = drawn(rng, n)
        b = np.unique(np.r_[a[::2], drawn(rng, n)])
        assert np.minimum(near_copies.sketch(a), near_copies.sketch(b)).sum() >= len(np.intersect1d(a, b))
    assert near_copies.sketch(drawn(rng, near_copies.MOST_SKETCHED + 1)) is None


def test_unlike_sets_do_not_travel(spark):
    rng = np.random.default_rng(2)
    a, far, huge = drawn(rng, 400), drawn(rng, 400), drawn(rng, near_copies.MOST_SKETCHED + 9)
    near = np.unique(np.r_[a[:370], drawn(rng, 10)])
    rows = [(n.encode(), len(s), None if (k := near_copies.sketch(s)) is None else k.tolist()) for n, s in (("a", a), ("b", near), ("c", far), ("d", huge), ("e", huge[1:]))]
    sets = spark.createDataFrame(rows, "node BINARY, size INT, sketch ARRAY<SMALLINT>")
    pairs = spark.createDataFrame([(b"a", b"b"), (b"a", b"c"), (b"b", b"c"), (b"d", b"e")], "a BINARY, b BINARY")
    assert {(bytes(r.a), bytes(r.b)) for r in near_copies._bounded(pairs, sets).collect()} == {(b"a", b"b"), (b"d", b"e")}
