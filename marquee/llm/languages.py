"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import Sent, arrow_map, held, with_result

#: Name for a text without a letter.
UNKNOWN = "und"
#: Documents of each language that training reads (expected number; all of them where there are fewer).
PER_LANGUAGE = 4000
#: Cost of a change of language, in nats.
SWITCH = 15.0
#: Least share of a language's training words for a script to be one of its own.
SCRIPT_SHARE = 0.02
#: What a word costs in a language that does not use its script, where another does.
FOREIGN = -40.0
#: Bits of the hashed counts of one, two and three characters.
BITS = (12, 15, 17)
#: Strength of the shorter context.
BACKOFF = 4.0
WORD = re.compile(r"[^\W\d_]+")

# First and last code point of script ranges.
SCRIPTS = (("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
           ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F),
           ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))
NAMES = ["other", *dict.fromkeys(n for n, _, _ in SCRIPTS)]


def _script(words: list[str]) -> np.ndarray:
    """Number in NAMES of the script of every word, by its first letter."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    for name, low, high in SCRIPTS:
        out[(first >= low) & (first <= high)] = NAMES.index(name)
    return out


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every character to predict (the word's end too): hashes of its context of one and two, of itself, and with each context; its word."""
    codes = np.frombuffer("".join([f"\x02\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 3
    starts = np.cumsum(lens) - lens
    real = np.ones(len(codes), bool)
    real[starts] = real[starts + 1] = False
    at = np.flatnonzero(real)
    a, b, c = codes[at - 2], codes[at - 1], codes[at]

    def mix(x: np.ndarray, bits: int) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    one, two, three = BITS
    step = np.uint64(21)
    return mix(b, one), mix(a << step | b, two), mix(c, one), mix(b << step | c, two), mix((a << (step + step)) ^ (b << step) ^ c, three), np.repeat(np.arange(len(words)), lens - 2)


@dataclass
class Model:
    """Counts of hashed character runs by language, and the scripts of each language."""

    langs: list[str]
    counts: list[np.ndarray]  # for runs of one, two and three: buckets by languages
    scripts: np.ndarray  # scripts by languages: True if it is one of the language's own

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of every lower-case word in every language."""
        c1, c2, w1, w2, w3, word = _grams(words)
        one, two, three = self.counts
        total = one.sum(axis=0) + 1
        out = np.zeros((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            p = (one[w1, k] + 0.1) / (total[k] + 0.1 * len(one))
            p = (two[w2, k] + BACKOFF * p) / (one[c1, k] + BACKOFF)
            p = (three[w3, k] + BACKOFF * p) / (two[c2, k] + BACKOFF)
            out[:, k] = np.bincount(word, np.log(np.minimum(p, 1.0)), minlength=len(words))
        own = self.scripts[_script(words)]
        some = own.any(axis=1)
        out[some] = np.where(own[some], out[some], out[some] + FOREIGN)
        out[~some] = 0.0  # a script that no language uses says nothing
        return out


def fit(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the ``text`` and non-null ``lang`` of the ``usable`` rows.

    Of every language about ``per_language`` different texts are taken, by a hash of them; copies count once. Runs of characters are counted where the
    texts lie, summed by Spark, and only the tables reach the driver: 1.3 MB for every language, of which all are learned. Without any usable row no language is known.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    different = rows.select(F.xxhash64("text").alias("text"), "lang").distinct()
    sizes = {r["lang"]: r["count"] for r in different.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [np.zeros((1 << b, 0)) for b in BITS], np.zeros((len(NAMES), 0), bool))
    number = F.create_map(*[F.lit(x) for k, name in enumerate(langs) for x in (name, k)])
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, int(min(1.0, per_language / sizes[name]) * (1 << 30)))])
    rows = rows.where(F.col("lang").isin(langs))
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")]).select("text", number[F.col("lang")].alias("lang")).distinct()

    def work(c: dict[str, list]) -> dict[str, object]:
        held("language counts", 0, lambda: None)  # a worker of an earlier stage lets go of its model
        out: list[np.ndarray] = []
        for k in set(c["lang"]):
            found = [w for t, lang in zip(c["text"], c["lang"], strict=True) if lang == k for w in WORD.findall(t.lower())]
            found, times = np.unique(np.array(found or ["a"], object), return_counts=True)
            words = found.tolist()
            _, _, w1, w2, w3, word = _grams(words)
            for kind, (buckets, weight) in enumerate([(w1, times[word]), (w2, times[word]), (w3, times[word]), (_script(words), times)]):
                n = np.bincount(buckets, weight)
                at = np.flatnonzero(n)
                out.append(np.stack([np.full(len(at), k), np.full(len(at), kind), at, n[at].astype(np.int64)]))
        lang, kind, bucket, n = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        return {"lang": pa.array(lang, pa.int32()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(n, pa.int64())}

    counted = arrow_map(picked, "lang int, kind int, bucket int, n bigint", work).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, kind, bucket, n = (counted.column(c).to_numpy() for c in ("lang", "kind", "bucket", "n"))
    counts = []
    for k, size in enumerate([*(1 << b for b in BITS), len(NAMES)]):
        table = np.zeros((size, len(langs)))
        here = kind == k
        table[bucket[here], lang[here]] = n[here]
        counts.append(table)
    scripts = counts.pop()
    return Model(langs, [c.astype(np.float32) for c in counts], scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def _constant(scores: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(language, sure): the best single language of every document, and whether no path with a change can beat it.

    Leaving the language for a stretch costs a change at least; so if no stretch gains more than that, the constant path is best.
    The largest gain of a stretch is the largest difference between a running sum and the least one before it.
    """
    total = np.stack([np.bincount(doc, scores[:, k], minlength=n_docs) for k in range(scores.shape[1])], axis=1)
    best = total.argmax(axis=1)
    own = scores[np.arange(len(scores)), best[doc]]
    others = scores.copy()
    others[np.arange(len(scores)), best[doc]] = -np.inf
    gain = others.max(axis=1) - own
    if scores.shape[1] == 1:
        return best, np.ones(n_docs, bool)
    level = np.cumsum(gain)
    apart = 2 * np.abs(gain).sum() + 1  # documents on levels of their own, so that a running minimum does not cross them
    before = level - gain - doc * apart
    rise = level - doc * apart - np.minimum.accumulate(before)
    most = np.zeros(n_docs)
    np.maximum.at(most, doc, rise)
    return best, most <= SWITCH


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best sequence of languages for every document's word scores, all documents side by side, word after word."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lens = np.array([len(scores[i]) for i in order])
    if not len(lens) or not lens[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # documents with a word at t
    flat, first = np.concatenate([scores[i] for i in order]), np.cumsum(lens) - lens
    value = np.zeros((len(order), flat.shape[1]))
    came: list[np.ndarray] = []
    for t, n in enumerate(active.tolist()):
        v = value[:n]
        top = v.argmax(axis=1)
        jump = v[np.arange(n), top] - switch
        moved = jump[:, None] > v
        came.append(np.where(moved, top[:, None], np.arange(flat.shape[1])).astype(np.int16))
        value[:n] = np.where(moved, jump[:, None], v) + flat[first[:n] + t]
    state = value.argmax(axis=1)
    path = np.zeros(len(flat), np.int64)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        path[first[:n] + t] = state[:n]
        state[:n] = came[t][np.arange(n), state[:n]]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for k, i in enumerate(order):
        out[i] = path[first[k]:first[k] + lens[k]]
    return out


class Labeller:
    """Labels texts with one model. A word is scored once while it is remembered."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int]]]]:
        """(language, share of the letters that are in it, [(language, words) of each span]) of every text."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known, self.table = {}, self.table[:0]
        flat = [w for doc in words for w in doc]
        if fresh := [w for w in dict.fromkeys(flat) if w not in self.known]:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, self.model.scores(fresh)])
        unknown: tuple[str, float, list[tuple[str, int]]] = (UNKNOWN, 0.0, [])
        lettered = [any(any(c.isalpha() for c in w) for w in doc) for doc in words]
        if not flat or not self.model.langs:
            return [unknown] * len(texts)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        scores = self.table[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]
        letters = np.fromiter(map(len, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), counts)
        best, sure = _constant(scores, doc, len(texts))
        ends = np.cumsum(counts)
        mixed = np.flatnonzero(~sure).tolist()
        paths = dict(zip(mixed, viterbi([scores[ends[i] - counts[i]:ends[i]] for i in mixed]), strict=True))
        out = []
        for i, name in enumerate(best.tolist()):
            if not lettered[i]:
                out.append(unknown)
            elif i not in paths:
                out.append((self.model.langs[name], 1.0, [(self.model.langs[name], int(counts[i]))]))
            else:
                path = paths[i]
                held = np.bincount(path, letters[ends[i] - counts[i]:ends[i]], minlength=len(self.model.langs))
                cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
                spans = [(self.model.langs[path[a]], int(b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
                out.append((self.model.langs[int(held.argmax())], float(held.max() / held.sum()), spans))
        return out


def identify(docs: DataFrame, model: Model, name: str = "language", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``name``: a struct of lang, score (0 to 1) and spans (language and number of words of each).

    ``lang`` has the most letters in the best path, ``score`` is its share of them. Texts that are null, empty or without a letter
    are ``und`` with score 0 and no span. Every row gets its result; equal texts get equal ones. Only ``text`` is read.
    """
    sent, name_of_model = Sent(docs.sparkSession, model), uuid.uuid4().hex
    span = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def make() -> Callable[[list[str | None]], pa.Array]:
        label = held("labeller", name_of_model, lambda: Labeller(sent.value))

        def work(texts: list[str | None]) -> pa.Array:
            found = label(texts)
            return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                                               pa.array([[{"lang": a, "words": n} for a, n in f[2]] for f in found], span)], names=["lang", "score", "spans"])

        return work

    return with_result(docs, name, "struct<lang:string,score:double,spans:array<struct<lang:string,words:int>>>", make, keep)
