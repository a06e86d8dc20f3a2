"""Pieces, token counts and the token store against the libraries."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marquee.llm import common, pieces, queries, token_counts, token_store

FOLDER = "/root/testdata/sf0.001"
MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
VOCABULARY = pieces.load(MODEL)
CODEC = pieces.Codec(VOCABULARY)
TOKENIZER = Tokenizer.from_file(BYTES)
STORE = token_store.TextEncoder(open(BYTES, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab ▁\n\t.éß漢字😀\x00ertñ<0x41>'  "), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_pieces_equal_the_library(text):
    ids = CODEC.encode([text])[0]
    assert ids.tolist() == [1, *LIBRARY.encode(text), 2]
    assert CODEC.decode(ids) == LIBRARY.decode(ids.tolist())
    assert STORE([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 700, "漢" * 1000, "▁ " * 300, "the" * 2000])
def test_long_runs(text):
    assert CODEC.encode([text], ends=False)[0].tolist() == LIBRARY.encode(text)


def test_decode_any_ids():
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(12)]
        assert CODEC.decode(np.array(ids)) == LIBRARY.decode(ids)


def test_op2(spark, table):
    got = {r.doc_id: r for r in queries.QUERIES["op2_sentencepiece"](spark, FOLDER).collect()}
    for r in table("documents").collect():
        ids = [1, *LIBRARY.encode(r.text or ""), 2]
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def field(number, kind, value):
    def varint(n):
        out = b""
        while True:
            n, low = n >> 7, n & 127
            out += bytes([low | (128 if n else 0)])
            if not n:
                return out

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)


def test_counts_equal_a_unigram_model(spark, table):
    """The library with a model of the same pieces, our scores, and the unigram kind."""
    scores = token_counts.unigram_scores(VOCABULARY)
    kinds = {"normal": 1, "unknown": 2, "control": 3, "byte": 6}
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", scores.get(p, 0.0) if k == "normal" else 0.0)) + field(3, 0, kinds[k]))
                     for p, k in zip(VOCABULARY.pieces, VOCABULARY.kinds, strict=True))
    model += field(2, 2, field(3, 0, 1) + field(35, 0, 1) + field(40, 0, 0) + field(41, 0, 1) + field(42, 0, 2)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0))
    unigram = sentencepiece.SentencePieceProcessor()
    unigram.LoadFromSerializedProto(model)
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op1_token_counts"](spark, FOLDER).collect()}
    assert got == {r.doc_id: len(unigram.encode(r.text or "")) for r in table("documents").collect()}
    trie, rng = token_counts.Trie(scores, True), random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("ab ▁\n.éß漢😀\x00ertñ<0x41>") for _ in range(rng.randrange(1, 50)))
        assert trie.totals([re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁"))])[0] == len(unigram.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_addressable_codes(ids):
    shard = token_store.Packed(token_store.pack(np.array(ids, np.uint32)))
    assert shard.all().tolist() == ids and len(shard) == len(ids)
    for i in range(0, len(ids), 37):
        assert shard[i] == ids[i]


def test_op6(spark, table):
    start, want = 0, {}
    for r in sorted(table("documents").collect(), key=lambda r: r.doc_id):
        ids = [*TOKENIZER.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op6_token_store"](spark, FOLDER).collect()}
    assert got == want


def test_random_access(spark, table, monkeypatch):
    shards = token_store.write(table("documents"), BYTES, 2)
    whole = [i for r in sorted(token_store.index(shards).join(token_store.read(shards), "doc_id").collect(), key=lambda r: r.start) for i in np.frombuffer(r.ids, "<u4").tolist()]
    asked = [0, 5, 5, 1000, len(whole) - 1, len(whole), -1]
    got = {r.position: r.id for r in token_store.token_at(shards, spark.createDataFrame([(p,) for p in asked], "position bigint")).collect()}
    assert got == {p: whole[p] for p in asked if 0 <= p < len(whole)}


def test_odd_rows(odd, none):
    for made in (pieces.encode_decode(odd, MODEL), token_counts.counts(odd, MODEL, "counts_"), token_store.index(token_store.write(odd, BYTES, 2))):
        assert made.count() == odd.count()
    decoded = pieces.encode_decode(odd, MODEL).where("doc_id = 1 or doc_id = 2").collect()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == [1, 2] and r.decoded == "" for r in decoded)
    assert [tuple(r) for r in token_counts.counts(odd, MODEL, "c_", ["doc_id"]).where("doc_id = 1").select("c_.*").collect()] == [(0, 0)]
    for made in (pieces.encode_decode(none, MODEL), token_counts.counts(none, MODEL, "c_"), token_store.index(token_store.write(none, BYTES, 2))):
        assert made.count() == 0


def test_very_long_texts_are_done_in_blocks(monkeypatch):
    text = "".join(random.Random(8).choice(["the ", "of", " a", "\n", ". ", ",b", "é ", "  ", "x\ny"]) for _ in range(30_000))
    want = ([1, *LIBRARY.encode(text), 2], TOKENIZER.encode(text, add_special_tokens=False).ids)
    for module in (pieces, token_store):
        monkeypatch.setattr(module, "CHUNK_CHARS", 1000)
        monkeypatch.setattr(module, "blocks", lambda units, most=700: common.blocks(units, most))
    assert CODEC.encode([text])[0].tolist() == want[0] and STORE([text])[0].tolist() == want[1]
