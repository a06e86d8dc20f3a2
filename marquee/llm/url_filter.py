"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import Sent, with_result
from marquee.llm.decontaminate import LOWER, UPPER

#: Labelled URLs that training reads (expected number; all where there are fewer).
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, SHRINK = 60, 3, 0.2, 32, 10, 1.0
#: Suffixes whose statistics a model keeps: the most frequent ones of the sample.
SUFFIXES = 2000


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: list[tuple[str, str, str]], at_host: Column, at_path: Column) -> Column:
    """The rule (verdict, host, path) that fits: a struct of rule and verdict, or null.

    A rule fits its host and all subdomains if the path starts with its own. The longest wins, of equal ones that of the longer host.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((at_host == h) | at_host.endswith("." + h)) & at_path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(url: str) -> list[float]:
    """Length, depth, digit ratio, entropy and parameter counts of one URL."""
    _, _, rest = url.partition("://")
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    name, tail = rest[:cut], rest[cut:]
    plain, _, query = tail.partition("#")[0].partition("?")
    counts = Counter(url)
    entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in counts.values()) if url else 0.0
    letters = sum(c.isdigit() for c in url)
    return [len(url), len(name), len(plain), len(query), sum(1 for s in plain.split("/") if s), name.count(".") + 1, letters / max(len(url), 1), sum(c.isdigit() for c in name) / max(len(name), 1),
            entropy, sum(1 for s in query.split("&") if s), name.count("-"), float(url.startswith("https")), max(map(len, name.split(".")), default=0), float("%" in url)]


def suffix(url: str) -> str:
    """The last label of the host."""
    rest = url.partition("://")[2]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return rest[:cut].lower().rpartition(".")[2]


@dataclass
class Trees:
    """Boosted regression trees on log odds. A node is (feature, threshold) with children 2n+1 and 2n+2, or a leaf."""

    start: float
    suffixes: dict[str, tuple[float, float]] = field(default_factory=dict)  # smoothed log odds and log count
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def features(self, urls: list[str | None]) -> np.ndarray:
        rows = [[*lexical(u or ""), *self.suffixes.get(suffix(u or ""), (self.start, 0.0))] for u in urls]
        return np.array(rows, float).reshape(len(urls), -1)

    def _leaf(self, x: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = feature[node]
            right = x[np.arange(len(x)), np.maximum(at, 0)] > threshold[node]
            node = np.where(at < 0, node, 2 * node + 1 + right)
        return node

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Probability of a block."""
        total = np.full(len(urls), self.start)
        if self.trees and urls:
            x = self.features(urls)
            for feature, threshold, value in self.trees:
                total += value[self._leaf(x, feature, threshold)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def train(self, urls: list[str], y: np.ndarray) -> None:
        """Newton boosting with histograms: every split takes the largest gain over BINS quantiles of each feature."""
        names = np.array([suffix(u) for u in urls])
        for name, n in Counter(names.tolist()).most_common(SUFFIXES):
            bad = y[names == name].sum()
            self.suffixes[name] = (float(np.log((bad + 1) / (n - bad + 1))), float(np.log1p(n)))
        x = self.features(urls)
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
        total = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, p * (1 - p)
            size = 2 ** (DEPTH + 1) - 1
            feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            members = {0: np.arange(len(y))}
            for node in range(size):
                if (rows := members.pop(node, None)) is None:
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                value[node] = RATE * g / (h + SHRINK)
                if 2 * node + 2 >= size or len(rows) < 2 * LEAST_LEAF:
                    continue
                best = (1e-6, -1, 0)
                for k, c in enumerate(cuts):
                    gl = np.cumsum(np.bincount(binned[rows, k], grad[rows], minlength=len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, k], hess[rows], minlength=len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, k], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + SHRINK) + (g - gl) ** 2 / (h - hl + SHRINK) - g * g / (h + SHRINK)
                    gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), k, int(gain.argmax()))
                if best[1] >= 0:
                    _, k, b = best
                    feature[node], threshold[node] = k, cuts[k][b]
                    left = binned[rows, k] <= b
                    members[2 * node + 1], members[2 * node + 2] = rows[left], rows[~left]
            total += value[self._leaf(x, feature, threshold)]
            self.trees.append((feature, threshold, value))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Learn from (url, block): about ``train_rows`` distinct URLs by their hash. Without both labels the score is the known share, 0 without any."""
    rows = labelled.where("url is not null and block is not null").select("url", F.col("block").cast("int").alias("block"))
    n = rows.select(F.xxhash64("url"), "block").distinct().count()  # copies count once, as their share is taken by the same hash
    part = int(min(1.0, train_rows / max(n, 1)) * (1 << 30))
    got = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < part).distinct().orderBy("url", "block").limit(4 * train_rows).toArrow()
    urls, y = got.column("url").to_pylist(), np.array(got.column("block").to_pylist(), float)
    if not len(y) or not y.any() or y.all():
        return Trees(30.0 if len(y) and y.all() else -30.0)
    model = Trees(float(np.log(y.mean() / (1 - y.mean()))))
    model.train(urls, y)
    return model


def score(pages: DataFrame, model: Trees, name: str = "block_score", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``pages`` with ``name``, the probability of a block by the row's ``url``. A null URL counts as empty."""
    held = Sent(pages.sparkSession, model)

    def make() -> Callable[[list[str | None]], pa.Array]:
        trees = held.value
        return lambda urls: pa.array(trees.scores(urls), pa.float64())

    return with_result(pages, name, "double", make, keep, text="url")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score): one row for every row of ``pages``.

    The rules label the URLs they fit; the trees learn from these and decide the others: ``block`` from a probability of 0.5 on.
    A null URL or one without ``://`` has an empty host and path, fits no rule, and is judged by the trees.
    """
    parsed = pages.select(F.col(page_id).alias("page_id"), "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    ruled = parsed.withColumn("fit", rule(rules, F.col("host"), F.col("path")))
    model = fit(ruled.where("fit is not null").select("url", (F.col("fit.verdict") == "block").alias("block")))
    scored = score(ruled, model, keep=["page_id", "host", "path", "fit"])
    verdict = F.coalesce("fit.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "block_score")
