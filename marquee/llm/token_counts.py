"""Token counts of a unigram model, by dynamic programming shared along a trie of pre-tokens."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marquee.llm.common import CHUNK_CHARS, Numbering, blocks, held, with_result
from marquee.llm.pieces import SPACE, Lookup, Vocabulary, load

#: What an unknown character costs more than the rarest piece.
UNKNOWN_PENALTY = 10.0
#: Pre-tokens whose counts a worker remembers; beyond it it starts anew, which changes no count.
WORDS_HELD = 600_000
#: Characters of new pre-tokens whose trie is built at a time.
TRIE_CHARS = 1_500_000
BASE = np.uint64(0x5851F42D4C957F2D)


def unigram_scores(v: Vocabulary) -> dict[str, float]:
    """Log-probabilities of the normal pieces by Zipf's law over their order in the vocabulary. They are rounded to 32 bits, as model files keep them."""
    normal = [p for p, k in zip(v.pieces, v.kinds, strict=True) if k == "normal"]
    total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
    return {p: float(np.float32(-math.log(r + 1) - total)) for r, p in enumerate(normal)}


def _hashes(texts: list[str]) -> np.ndarray:
    out = []
    for t in texts:
        h = 0
        for c in t:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        out.append(h)
    return np.array(out, np.uint64)


class Trie:
    """Counts tokens of pre-tokens. A node of the trie is a prefix; it holds its forward score and the tokens of its best segmentation.

    Both depend on the prefix alone, so they are computed once for all pre-tokens that go through it. The trie of the pre-tokens that
    are new is made level by level: all nodes of a level look for pieces that end there, the shortest first, for as long as a longer
    piece could still end there. A node keeps hashes of its last characters and its ancestors, one for each length of a piece.
    Terminal counts are remembered, the trie itself is not.
    """

    def __init__(self, scores: dict[str, float], byte_fallback: bool):
        self.byte_fallback = byte_fallback
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        tails = list({p[i:] for p in scores for i in range(len(p))})
        self.tails = Lookup(_hashes(tails), np.array([scores.get(t, -np.inf) for t in tails], np.float64))  # -inf: no piece, but the end of one
        self.clear()

    def clear(self) -> None:
        self.known = Numbering()
        self.counts = np.zeros(0, np.int64)

    def totals(self, docs: list[list[str]]) -> np.ndarray:
        """Tokens of every list of pre-tokens."""
        if len(self.known) > WORDS_HELD:
            self.clear()
        before = len(self.known)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        row = np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        fresh = list(islice(self.known, before, None))
        start = held_chars = 0
        for i, w in enumerate(fresh):
            held_chars += len(w)
            if held_chars >= TRIE_CHARS or i + 1 == len(fresh):
                self.counts = np.concatenate([self.counts, self._insert(fresh[start:i + 1])])
                start, held_chars = i + 1, 0
        upto = np.r_[0, np.cumsum(self.counts[row])]
        ends = np.cumsum(sizes)
        return upto[ends] - upto[ends - sizes]

    def _insert(self, words: list[str]) -> np.ndarray:
        """Terminal counts of distinct pre-tokens."""
        order = sorted(range(len(words)), key=words.__getitem__)  # words with a common prefix stand together
        codes = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lens = np.array([len(words[i]) for i in order], np.int64)
        first = np.cumsum(lens) - lens
        best, tokens = np.zeros(len(codes) + 1), np.zeros(len(codes) + 1, np.int64)
        # of the level above: node of every word, hashes of the last characters of every node, its ancestors (itself first)
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        tail, above, base, made = np.zeros((1, self.longest), np.uint64), np.zeros((1, self.longest + 1), np.int64), 0, 1
        out = np.zeros(len(words), np.int64)
        depth = 0
        while True:
            going = lens[word] > depth
            word, node = word[going], node[going]
            if not len(word):
                break
            char = codes[first[word] + depth]
            new = np.r_[True, (node[1:] != node[:-1]) | (char[1:] != char[:-1])]
            parent, letter = node[new] - base, char[new]
            tail = np.column_stack([np.zeros(len(parent), np.uint64), tail[parent, :-1]]) * BASE + (letter + np.uint64(1))[:, None]
            ids = made + np.arange(len(parent))
            above = np.column_stack([ids, above[parent, :-1]])
            top, count = np.full(len(parent), -np.inf), np.zeros(len(parent), np.int64)
            live = np.arange(len(parent))
            for n in range(1, min(self.longest, depth + 1) + 1):
                score = self.tails.find(tail[live, n - 1], np.nan)
                if n == 1:
                    strange = np.isnan(score) | np.isneginf(score)
                live, score = live[~np.isnan(score)], score[~np.isnan(score)]
                if not len(live):
                    break
                piece = np.flatnonzero(~np.isneginf(score))
                here = live[piece]
                value = best[above[here, n]] + score[piece]
                better = value >= top[here]
                here = here[better]
                top[here], count[here] = value[better], tokens[above[here, n]] + 1
            odd = np.flatnonzero(strange)
            value = best[above[odd, 1]] + self.unknown
            odd, value = odd[value > top[odd]], value[value > top[odd]]
            c = letter[odd]
            size = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000) if self.byte_fallback else 1
            top[odd], count[odd] = value, tokens[above[odd, 1]] + size
            best[ids], tokens[ids] = top, count
            base, made, depth = made, made + len(ids), depth + 1
            node = ids[np.cumsum(new) - 1]
            out[word] = tokens[node]  # the last level of a word leaves its terminal count
        counts = np.zeros(len(words), np.int64)
        counts[order] = out
        return counts


def counts(docs: DataFrame, model: str, name: str = "counts", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``name``: a struct of pre_tokens and tokens of the whole text.

    Pre-tokens are words with the spaces before them, as no piece of the vocabulary goes on after a character and a space. Tokens are
    those of the best segmentation under the unigram scores; of equal ones that with the longer last piece. A character that is no
    piece counts its UTF-8 bytes. Null and empty texts have none. Every row gets its result; a task inserts distinct pre-tokens only.
    """
    vocabulary = load(model)
    scores, fallback = unigram_scores(vocabulary), "byte" in vocabulary.kinds
    whole = any(SPACE in p.lstrip(SPACE) for p in scores)
    sent = docs.sparkSession.sparkContext.broadcast(scores)

    def make() -> Callable[[list[str | None]], pa.Array]:
        trie = held("unigram trie", (model, len(sent.value)), lambda: Trie(sent.value, fallback))
        unit = re.compile("(?s).+" if whole else f"{SPACE}+[^{SPACE}]*")

        def work(texts: list[str | None]) -> pa.Array:
            if len(texts) == 1 and len(texts[0] or "") > CHUNK_CHARS:  # a very long text is counted block by block
                parts = [(len(part), int(trie.totals([part])[0])) for part in blocks(m.group() for m in unit.finditer(SPACE + texts[0].replace(" ", SPACE)))]
                return pa.StructArray.from_arrays([pa.array([sum(c)], pa.int64()) for c in zip(*parts, strict=True)], names=["pre_tokens", "tokens"])
            units = [unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
            return pa.StructArray.from_arrays([pa.array([len(u) for u in units], pa.int64()), pa.array(trie.totals(units), pa.int64())], names=["pre_tokens", "tokens"])

        return work

    return with_result(docs, name, "struct<pre_tokens:bigint,tokens:bigint>", make, keep)
