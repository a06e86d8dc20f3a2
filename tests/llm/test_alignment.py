"""Alignment of two tokenizers against brute force over byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marquee.llm import alignment, queries

FOLDER = "/root/testdata/sf0.001"
BYTES, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=MODEL)
A.encode_special_tokens = True
SIDES = alignment.Sides(open(BYTES, encoding="utf-8").read(), open(MODEL, "rb").read())
ALPHABET = alignment._byte_alphabet()


def spelled_a(i):
    return bytes(ALPHABET[c] for c in A.id_to_token(i))


def spelled_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def brute(text):
    """(a ids, b ids, groups as lists of ids of both) by the sets of ends."""
    if not text:
        return [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    ends = []
    for ids, spell in ((a, spelled_a), (b, spelled_b)):
        if b"".join(map(spell, ids)) != (" " + text).encode():
            return [], [], []
        ends.append(np.cumsum([len(spell(i)) for i in ids]).tolist())
    groups, x, y = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
        groups.append((a[x:p], b[y:q]))
        x, y = p, q
    return a, b, groups


def brute_rows(texts):
    found = [(d, *brute(t)) for d, t in texts]
    count = Counter((a[-1], b[-1]) for *_, groups in found for a, b in groups)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    listed = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return sorted((d, len(a), len(b), len(g), len(g), sum(count[x[-1], y[-1]] == best[y[-1]] for x, y in g), sum(count[x[-1], y[-1]] for x, y in g),
                   hashlib.sha256(listed(g).encode()).hexdigest() if g else "") for d, a, b, g in found)


def test_op12(spark, table):
    rows = queries.QUERIES["op12_tokenizer_alignment"](spark, FOLDER).collect()
    got = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)
    assert got == brute_rows([(r.doc_id, r.text) for r in table("documents").collect()])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab ▁\n\t.éß漢字😀\x00ertñ<0x41>'  "), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=4))
def test_sides_and_ends(texts):
    a, b = SIDES(texts)
    for t, x, y in zip(texts, a, b, strict=True):
        assert (list(x), list(y)) == brute(t)[:2]
    some = [k for k in range(len(a)) if len(a[k])]
    flat = [np.concatenate([np.zeros(0, np.int64), *[np.asarray(s[k], np.int64) for k in some]]) for s in (a, b)]
    starts = [np.cumsum([0, *[len(s[k]) for k in some]])[:-1] for s in (a, b)]
    ends = [np.cumsum(lens[ids]) for lens, ids in zip((SIDES.a_lens, SIDES.b_lens), flat, strict=True)]
    x, y = alignment.common_ends(*ends, *starts)
    assert ends[0][x].tolist() == ends[1][y].tolist() == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


@pytest.mark.parametrize("seed", range(20))
def test_lanes_inside_long_documents(seed):
    rng = np.random.default_rng(seed)
    share = rng.random(3)
    marks = rng.random((3, 40_000)) < share[:, None] * [[0.3], [0.7], [0.7]]
    marks[:, -1] = True
    a, b = np.flatnonzero(marks[0] | marks[1]), np.flatnonzero(marks[0] | marks[2])
    x, y = alignment.common_ends(a, b, np.zeros(1, np.int64), np.zeros(1, np.int64))
    assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()


def test_strings_of_special_tokens_are_plain_text():
    texts = ["one <|endoftext|> two", "<s> three </s><unk>", "<|endoftext|>"]
    for t, a in zip(texts, SIDES(texts)[0], strict=True):
        assert a.tolist() == A.encode(" " + t, add_special_tokens=False).ids and 50256 not in a


def test_odd_rows_chunks_and_repeats(spark, odd, none, monkeypatch):
    found = alignment.align(odd, BYTES, MODEL, "found_")
    assert found.columns == [*odd.columns, "found_"]
    rows = found.select("doc_id", "text", "found_.*").collect()
    assert len(rows) == odd.count()
    for r in rows:
        a, b, groups = brute(r.text)
        assert (r.n_a, r.n_b, r.n_groups) == (len(a), len(b), len(groups)) and len(r.links) == 4 * len(groups)
    wide = found.select("doc_id", *[f"`{c}`" for c in odd.columns if c != "doc_id"], "found_.links")
    counted = alignment.link_counts(wide.repartition(3)).collect()
    assert {r.doc_id: r.n_links for r in counted} == {r.doc_id: r.n_groups for r in rows} and len(counted) == len(rows)
    total = {d: s for d, *_, s, _ in brute_rows([(r.doc_id if r.doc_id is not None else -1, r.text) for r in rows])}
    assert {r.doc_id if r.doc_id is not None else -1: r.count_sum for r in counted} == total
    assert alignment.link_counts(alignment.align(none, BYTES, MODEL, "found_").select("doc_id", "found_.links")).count() == 0
    with pytest.raises(ValueError):
        alignment.link_counts(found.selectExpr("found_.links", "doc_id AS n_best"))
