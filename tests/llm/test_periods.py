"""Periodic runs against every place and period."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import periods, queries

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(s):
    """{(start, length): smallest period} of all stretches that no neighbour extends."""
    out = {}
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in out.items())


def brute_row(doc_id, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {k for i, m, q in found for k in range(i + q, i + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{i},{m},{q}\n" for i, m, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())


def test_op13(spark, table):
    rows = queries.QUERIES["op13_periodic_runs"](spark, FOLDER).collect()
    got = sorted((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows)
    want = sorted(brute_row(r.doc_id, r.text) for r in table("documents").collect())
    assert got == want and sum(r[1] > 0 for r in got) > 5


part = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)).map(lambda p: p[0] * p[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(part, st.lists(st.integers(0, 5), max_size=5)), max_size=6).map(lambda ps: [x for p in ps for x in p]), max_size=5))
def test_runs_equal_brute_force(seqs):
    got = periods.runs([np.array(s, np.int64) for s in seqs])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(s) for s in seqs]


@pytest.mark.parametrize("cover, modulus", [(periods.COVER, periods.MODULUS), ((0, 1, 3), 7), ((0, 1, 3, 9), 13)])
def test_extensions_equal_word_by_word(cover, modulus):
    rng = np.random.default_rng(modulus)
    for letters in (1, 2, 40):
        s = np.tile(rng.integers(0, letters, 37), 9)
        s[rng.integers(0, len(s), 2)] = letters
        i, j = rng.integers(0, len(s), (2, 500))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            want.append(n)
        assert periods.Extensions(s, cover, modulus)(i, j).tolist() == want
    with pytest.raises(ValueError):
        periods.Extensions(s, cover[:-1], modulus)


def test_long_text_of_one_phrase(spark):
    docs = spark.createDataFrame([(1, "a b c " * 100_000), (2, "x " * 5), (3, "x " * 6 + "y")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1].periodic.runs] == [(0, 300_000, 3)] and got[1].periodic.collapsed == "a b c"
    assert got[2].periodic.runs == [] and got[2].periodic.collapsed == "x x x x x" and got[3].periodic.collapsed == "x y"


def test_odd_rows(spark, odd, none):
    rows = periods.periodic_runs(odd, "found_").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert [tuple(x) for x in r.found_.runs] == (brute(words_of(r.text)) if r.doc_id != 3 else [(0, 60_000, 3)])
        assert r.doc_id == 3 or r.found_.collapsed == " ".join(words_of(r.text))
    assert periods.periodic_runs(none, "found_").count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(odd, "score")
    planted = {r.doc_id: r.text for r in queries.with_planted_runs(odd).collect()}
    assert planted.keys() == {r.doc_id for r in rows}
