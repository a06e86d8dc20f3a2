"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import Sent, arrow_map, stage, with_result

#: Labelled documents of each class that training reads (expected number; all where there are fewer).
PER_CLASS = 8000
#: Hash buckets of terms, and labelled documents a term must occur in to be a feature, whatever their labels.
BUCKETS, LEAST_DOCS = 1 << 20, 4
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 12, 128, 0.1, 1e-4
#: Standard deviation of factors at the beginning: small, as a text has hundreds of features and their pairs add up.
SPREAD = 0.01
#: z-score, of either sign, from which on a term says something alone: such terms are learned first. All others follow.
ALONE_Z = 4.0
#: Where sums of squared gradients begin when all features are learned; epochs without a gain on the tested documents that end it, and epochs at most.
HELD, PATIENCE, MOST_EPOCHS = 1e-4, 4, 24
WORD = re.compile(r"\w+")
#: Lengths of word beginnings that are terms besides the whole word, and the longest word of a script with spaces that has no others.
STEMS, LONGEST = (4, 5, 6), 20
#: Lengths of the runs that are terms, at every position, of words in scripts without spaces; longer words of other scripts have runs of STEMS.
RUNS = (1, 2, 3, 4)
#: Thai to Myanmar, Khmer, kana, Han and their extensions.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
STEP = np.uint64(1099511628211)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _runs(word: str, lengths: tuple[int, ...]) -> np.ndarray:
    """Buckets of the word's distinct runs of these lengths at all positions; a run has the bucket of an equal beginning."""
    codes, out = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), []
    for n in lengths:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, 7, np.uint64)
            for j in range(n):
                h = h * STEP + codes[j:len(codes) - n + 1 + j]
            out.append(np.unique(_bucket(h * np.uint64(5) + np.uint64(n))))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _terms(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): hashed terms of every lower-case word: the whole word and its beginnings; runs at all positions of long and unspaced ones."""
    parts = []
    for i, w in enumerate(words):
        unspaced = UNSPACED.search(w) is not None
        if unspaced or len(w) > LONGEST:
            runs = np.unique(_runs(w, tuple({*RUNS, *STEMS}) if unspaced else STEMS))
            parts.append((runs, np.full(len(runs), i)))
    width = min(LONGEST, max(map(len, words), default=1))
    grid = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    running, hashes = np.full(len(words), 7, np.uint64), {}
    for j in range(width):
        running = np.where(grid[:, j] > 0, running * STEP + grid[:, j], running)
        if j + 1 in STEMS:
            hashes[j + 1] = running
    long = np.flatnonzero(lens > LONGEST)
    if len(long):
        running[long] = [xxhash.xxh64_intdigest(words[i].encode("utf-8", "surrogatepass")) for i in long.tolist()]
    parts.append((_bucket(running * np.uint64(3)), np.arange(len(words))))
    for n, h in hashes.items():
        at = np.flatnonzero((lens >= n) & (lens <= LONGEST))
        parts.append((_bucket(h[at] * np.uint64(5) + np.uint64(n)), at))
    return np.concatenate([b for b, _ in parts]), np.concatenate([w for _, w in parts])


class Features:
    """The features of texts: which of the chosen buckets occur. A word's are computed once while it is remembered."""

    def __init__(self, chosen: np.ndarray | None = None, most: int = 300_000):
        self.place = np.arange(BUCKETS) if chosen is None else np.full(BUCKETS, -1)
        if chosen is not None:
            self.place[chosen] = np.arange(len(chosen))
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature): every feature of every text once, by text."""
        words = [set(WORD.findall(t.lower())) if t else set() for t in texts]
        if len(self.known) > self.most or len(self.flat) > 20 * self.most:
            self.forget()
        fresh = list({w for doc in words for w in doc if w not in self.known})
        if fresh:
            bucket, word = _terms(fresh)
            feature = self.place[bucket]
            word, feature = word[feature >= 0], feature[feature >= 0]
            order = np.argsort(word, kind="stable")
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.flat = np.concatenate([self.flat, feature[order]])
            self.counts = np.concatenate([self.counts, np.bincount(word, minlength=len(fresh))])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        row = np.fromiter((self.known[w] for doc in words for w in doc), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        some = self.counts[row] > 0
        row, text = row[some], text[some]
        size, begin = self.counts[row], (np.cumsum(self.counts) - self.counts)[row]
        upto = np.cumsum(size)
        feature = self.flat[np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        width = int(self.place.max()) + 1 if len(self.place) else 1
        pairs = np.unique(np.repeat(text, size) * max(width, 1) + feature)
        return pairs // max(width, 1), pairs % max(width, 1)


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the products of their factors)."""

    chosen: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def _parts(self, row: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid and sums of factors; ``row`` is sorted."""
        factor, sums = self.factor[feature], np.zeros((n, FACTORS))
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][:len(row)])
        if len(starts):
            sums[row[starts]] = np.add.reduceat(factor, starts)
        squares = np.bincount(row, np.einsum("ij,ij->i", factor, factor), minlength=n)
        linear = np.bincount(row, self.weight[feature], minlength=n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._parts(row, feature, n)[0], -30, 30)))

    def train(self, row: np.ndarray, feature: np.ndarray, label: np.ndarray, seed: int = 5, epochs: int = EPOCHS, held: float = 1e-6, over: Callable[[], bool] | None = None,
              docs: np.ndarray | None = None) -> None:
        """Logistic loss by Adagrad over small batches; pairs learn by the factors of their members.

        ``held`` is where the sums of squared gradients begin: the larger, the smaller the first steps. ``over`` is asked after each epoch.
        Only ``docs`` are learned from, if given.
        """
        rng, ends = np.random.default_rng(seed), np.searchsorted(row, np.arange(len(label) + 1, dtype=row.dtype))
        docs = np.arange(len(label)) if docs is None else docs
        gw, gv, gb = np.full(len(self.weight), held), np.full(self.factor.shape, held), held
        for _ in range(epochs):
            order = rng.permutation(docs)
            for k in range(0, len(order), BATCH):
                some = order[k:k + BATCH]
                sizes = ends[some + 1] - ends[some]
                at = np.repeat(ends[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                f, r = feature[at], np.repeat(np.arange(len(some)), sizes)
                z, sums = self._parts(r, f, len(some))
                miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]
                by = np.argsort(f, kind="stable")
                f, r = f[by], r[by]
                starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]][:len(f)])
                used = f[starts]
                if len(used):
                    total = np.add.reduceat(miss[r], starts)
                    dw = total / len(some) + DECAY * self.weight[used]
                    dv = np.add.reduceat((miss[:, None] * sums)[r], starts) - total[:, None] * self.factor[used]
                    dv = dv / len(some) + DECAY * self.factor[used]
                else:
                    dw, dv = np.zeros(0), np.zeros((0, FACTORS))
                db = miss.mean()
                gw[used] += dw**2
                gv[used] += dv**2
                gb += db**2
                self.weight[used] -= RATE * dw / np.sqrt(gw[used])
                self.factor[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
                self.bias -= RATE * db / np.sqrt(gb)
            if over and over():
                break

    def learn(self, row: np.ndarray, feature: np.ndarray, label: np.ndarray, seed: int = 5) -> None:
        """Training of many features on few documents: those that say something alone first, then all of them from there.

        A fifth of the documents tells how many epochs over all features lower the loss of documents not learned from; then all are learned.
        """
        n, size = len(label), len(self.weight)
        rng = np.random.default_rng(seed)
        tested = rng.random(n) < 0.2
        begin = self.bias, self.weight.copy(), self.factor.copy()

        def run(docs: np.ndarray, epochs: int, over: Callable[[], bool] | None = None) -> None:
            self.bias, self.weight, self.factor = begin[0], begin[1].copy(), begin[2].copy()
            y, mine = label[docs], docs[row]
            both, prior = np.bincount(feature[mine], minlength=size), y.mean() if len(y) else 0.0
            z = (np.bincount(feature[mine & (label == 1)[row]], minlength=size) - both * prior) / np.sqrt(both * prior * (1 - prior) + 1e-9)
            alone = np.flatnonzero(np.abs(z) >= ALONE_Z)
            place = np.full(size, -1)
            place[alone] = np.arange(len(alone))
            told = mine & (place >= 0)[feature]
            small = Machine(alone, self.bias, self.weight[alone], self.factor[alone])
            small.train((np.cumsum(docs) - 1)[row[told]], place[feature[told]], y, seed)
            self.bias, self.weight[alone], self.factor[alone] = small.bias, small.weight, small.factor
            del mine, told
            if over is None or not over():
                self.train(row, feature, label, seed, epochs, HELD, over, np.flatnonzero(docs))

        losses: list[float] = []
        ends = np.searchsorted(row, np.arange(n + 1, dtype=row.dtype))

        def over() -> bool:
            lost = []
            for some in np.array_split(np.flatnonzero(tested), tested.sum() // BATCH + 1):
                r = np.repeat(np.arange(len(some)), ends[some + 1] - ends[some])
                p = self.scores(r, np.concatenate([feature[ends[i]:ends[i + 1]] for i in some.tolist()]), len(some)) if len(some) else np.zeros(0)
                p = np.clip(p, 1e-6, 1 - 1e-6)
                lost.append(-np.where(label[some] > 0, np.log(p), np.log(1 - p)).sum())
            losses.append(float(sum(lost)))
            return len(losses) > PATIENCE and min(losses[-PATIENCE:]) >= min(losses[:-PATIENCE])

        if not tested.any() or tested.all():
            run(np.ones(n, bool), EPOCHS)
            return
        run(~tested, MOST_EPOCHS, over)
        run(np.ones(n, bool), int(np.argmin(losses)))


def fit(docs: DataFrame, marks: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """Learn from ``docs`` (doc_id, text) and ``marks`` (doc_id, label), one row for a doc_id, label 0 or 1; null labels and texts are not used.

    Of each class about ``per_class`` marks are taken by a hash of the id; being of bounded number, they are broadcast to the texts.
    Every term of LEAST_DOCS documents or more is a feature, whatever the labels, so that terms that say nothing alone can be learned in
    pairs. Terms are counted by Spark, and only the feature lists of the sample reach the driver.
    The bias is moved to the share of label 1 in all marks. Without marks of both classes the score is the known share for every text.
    """
    rows = marks.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = [sizes.get(0, 0), sizes.get(1, 0)]
    share = min(max(n[1] / max(sum(n), 1), 1e-3), 1 - 1e-3)
    machine = Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    if not all(n):
        return machine
    parts = [int(min(1.0, per_class / k) * (1 << 30)) for k in n]
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("label") == 1, parts[1]).otherwise(parts[0]))
    picked = stage(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label"), "labelled")

    def count(c: dict[str, list]) -> dict[str, object]:
        _, bucket = Features()(c["text"])
        at, times = np.unique(bucket, return_counts=True)
        return {"bucket": pa.array(at), "n": pa.array(times)}

    sampled = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    prior = sampled.get(1, 0) / max(sum(sampled.values()), 1)
    counts = arrow_map(picked.select("text"), "bucket bigint, n bigint", count).groupBy("bucket").agg(F.sum("n").alias("n"))
    chosen = np.sort(counts.where(F.col("n") >= LEAST_DOCS).select("bucket").toArrow().column("bucket").to_numpy())
    if not len(chosen):
        return machine

    def listed(c: dict[str, list]) -> dict[str, object]:
        row, feature = Features(chosen)(c["text"])
        cuts = np.searchsorted(row, np.arange(len(c["text"]) + 1))
        return {"label": pa.array(c["label"], pa.int32()), "features": pa.array([feature[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)], pa.list_(pa.int32()))}

    got = arrow_map(picked, "label int, features array<int>", listed).groupBy("label", "features").count().orderBy("label", "features").limit(4 * per_class).toArrow()
    lists, times = got.column("features").combine_chunks(), np.minimum(got.column("count").to_numpy(), per_class)
    order = np.repeat(np.arange(len(lists)), times)
    label = got.column("label").to_numpy()[order]
    sizes, flat = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(order), dtype=np.int32), sizes[order])  # ten million entries: no wider than they must be
    feature = np.concatenate([flat[begin[i]:begin[i] + sizes[i]] for i in order.tolist()])
    del got, lists, flat
    rng = np.random.default_rng(3)
    machine = Machine(chosen, 0.0, np.zeros(len(chosen)), rng.normal(0, SPREAD, (len(chosen), FACTORS)))
    machine.learn(row, feature, label)
    machine.bias += float(np.log(share / (1 - share)) - np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    return machine


def score(docs: DataFrame, machine: Machine, name: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``name``, the score of the whole text (0 to 1). Null and empty texts have the score of no term."""
    held = Sent(docs.sparkSession, machine)

    def make() -> Callable[[list[str | None]], pa.Array]:
        model = held.value
        features = Features(model.chosen)

        def work(texts: list[str | None]) -> pa.Array:
            row, feature = features(texts) if len(model.chosen) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.array(model.scores(row, feature, len(texts)), pa.float64())

        return work

    return with_result(docs, name, "double", make, keep)
