"""Periodic runs of words, by longest common extensions over a difference cover."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marquee.llm.common import Numbering, with_result

#: A difference cover: every difference modulo MODULUS is that of two of these residues.
COVER, MODULUS = (1, 5, 11, 24, 25, 27), 31
#: A run holds at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of the harmonic grid that are compared at a time.
PAIRS = 1 << 20


class Extensions:
    """How far a sequence agrees with itself from two places on.

    Only suffixes that begin at a residue of the cover are sorted. Two places are at most ``modulus`` - 1 words before two such
    suffixes; those words are compared one by one, and the rest is the smallest common prefix of neighbours between the two in sorted
    order, from a sparse table of minima.
    """

    def __init__(self, s: np.ndarray, cover: tuple[int, ...] = COVER, modulus: int = MODULUS):
        n, v = len(s), modulus
        self.v, top = v, int(s.max(initial=0)) + 1
        self.s = np.concatenate([s, np.arange(top, top + 2 * v)]).astype(np.int64)
        inside = np.zeros(v, bool)
        inside[list(cover)] = True
        both = np.array([[inside[(a + np.arange(v)) % v] & inside[(b + np.arange(v)) % v] for b in range(v)] for a in range(v)])
        if not both.any(axis=2).all():
            raise ValueError("the residues are no difference cover")
        self.skip = both.argmax(axis=2)
        # samples of one residue follow each other; each residue's last block has words of its own, so no comparison passes it
        starts = [np.arange(d, n + v, v) for d in cover]
        at = np.concatenate(starts)
        self.number = np.full(n + 2 * v, -1)
        self.number[at] = np.arange(len(at))
        levels = [self._block_ranks(at)]
        while levels[-1].max(initial=0) + 1 < len(at):
            last, step = levels[-1], 1 << (len(levels) - 1)
            after = np.zeros(len(at), np.int64)
            after[:-step] = last[step:] + 1
            levels.append(_dense(last * (len(at) + 1) + after))
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        self.least = [self._common(at, order[:-1], order[1:], levels)]
        while (step := 1 << (len(self.least) - 1)) * 2 <= len(self.least[0]):
            self.least.append(np.minimum(self.least[-1][:-step], self.least[-1][step:]))

    def _block_ranks(self, at: np.ndarray) -> np.ndarray:
        """Dense ranks of the ``modulus`` words from each of the places on."""
        blocks = np.lib.stride_tricks.sliding_window_view(self.s.astype(">u4"), self.v)[at]
        return _dense(np.ascontiguousarray(blocks).view(f"S{4 * self.v}")[:, 0])

    def _common(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that samples ``a`` and ``b`` share: whole blocks from the widest level down, then word by word."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            step = 1 << k
            same = np.flatnonzero((a + step <= len(at)) & (b + step <= len(at)))
            same = same[levels[k][a[same]] == levels[k][b[same]]]
            a[same] += step
            b[same] += step
            total[same] += step * self.v
        left, right = at[a], at[b]
        live = np.arange(len(a))
        for t in range(self.v):
            live = live[self.s[left[live] + t] == self.s[right[live] + t]]
            total[live] += 1
        return total

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different places, the number of words that agree from there on."""
        need, found = self.skip[i % self.v, j % self.v], np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for t in range(self.v):
            live = live[need[live] > t]
            if not len(live):
                break
            live = live[self.s[i[live] + t] == self.s[j[live] + t]]
            found[live] = t + 1
        synced = np.flatnonzero(found == need)
        a, b = self.rank[self.number[(i + need)[synced]]], self.rank[self.number[(j + need)[synced]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level).tolist():
            some = level == k
            found[synced[some]] += np.minimum(self.least[k][low[some]], self.least[k][high[some] - (1 << k)])
        return found


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
    return out


def _joined(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences one after the other, each followed by a number of its own, and where each starts."""
    top = max(int(s.max(initial=0)) for s in seqs) + 1
    flat = np.concatenate([x for k, s in enumerate(seqs) for x in (s, [top + k])])
    lens = np.array([len(s) + 1 for s in seqs])
    return flat, np.cumsum(lens) - lens


def _grid(flat: np.ndarray, lens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): grid places k * q that can lie in a run of period q.

    ``lens`` falls, so the sequences long enough for q are a prefix. A run of four periods holds four grid places of like words.
    """
    periods = np.arange(1, int(lens[0]) // LEAST_PERIODS + 1)
    long_enough = np.searchsorted(-lens, -np.maximum(LEAST_WORDS, LEAST_PERIODS * periods), side="right")
    upto = (starts + lens)[long_enough - 1]
    counts = np.maximum(0, (upto - 1) // periods - 2)
    total, found, k = np.cumsum(counts), [], 0
    while k < len(periods):
        stop = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIRS, side="right")))
        c = counts[k:stop]
        q = np.repeat(periods[k:stop], c)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)) * q
        for t in range(1, 4):
            like = np.flatnonzero(flat[i] == flat[i + t * q])
            i, q = i[like], q[like]
        found.append((i, q))
        k = stop
    return np.concatenate([i for i, _ in found]), np.concatenate([q for _, q in found])


def runs(seqs: list[np.ndarray]) -> list[np.ndarray]:
    """For every sequence of non-negative numbers its runs, as rows (start, length, period) by start, then period.

    A run is a longest stretch with smallest period q that holds max(6, 4 q) words or more. For every q the places k * q of a grid are
    compared with the next ones, n / q of them, and extended to both sides; the first grid place of a run finds it. All multiples of q
    give the same stretch, of which the smallest period is kept.
    """
    out = [np.zeros((0, 3), np.int64)] * len(seqs)
    order = [k for k in sorted(range(len(seqs)), key=lambda k: -len(seqs[k])) if len(seqs[k]) >= LEAST_WORDS]
    if not order:
        return out
    flat, starts = _joined([seqs[k] for k in order])
    lens = np.array([len(seqs[k]) for k in order])
    i, q = _grid(flat, lens, starts)
    owner = np.searchsorted(starts, i, side="right") - 1
    inside = i + 3 * q < (starts + lens)[owner]
    i, q, owner = i[inside], q[inside], owner[inside]
    if not len(i):
        return out
    # the index is built over the sequences that have such places
    some, number = np.unique(owner, return_inverse=True)
    flat, begin = _joined([seqs[order[k]] for k in some.tolist()])
    i = i - starts[owner] + begin[number]
    extend = Extensions(flat)
    ahead = extend(i, i + q)
    far = ahead > 2 * q
    i, q, number, ahead = i[far], q[far], number[far], ahead[far]
    room = np.minimum(q, i - begin[number])
    first = np.ones(len(i), bool)  # not if the grid place before lies in the run as well
    whole = np.flatnonzero(room == q)
    first[whole] = extend(i[whole] - q[whole], i[whole]) < q[whole]
    i, q, number, ahead, room = i[first], q[first], number[first], ahead[first], room[first]
    low, high = np.zeros(len(i), np.int64), room  # how far the run goes back: halving
    while (todo := np.flatnonzero(low < high)).size:
        back = (low[todo] + high[todo] + 1) // 2
        p = i[todo] - back
        good = extend(p, p + q[todo]) >= back
        low[todo[good]] = back[good]
        high[todo[~good]] = back[~good] - 1
    length = low + q + ahead
    enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    start, length, q, number = (i - low)[enough], length[enough], q[enough], number[enough]
    sort = np.lexsort((q, length, start))
    start, length, q, number = start[sort], length[sort], q[sort], number[sort]
    least = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(start)]
    start, length, q, number = start[least], length[least], q[least], number[least]
    sort = np.lexsort((q, start))
    rows = np.column_stack([start - begin[number], length, q])[sort]
    cuts = np.searchsorted(number[sort], np.arange(len(some) + 1))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        out[order[some[k]]] = rows[a:b]
    return out


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that are not in a run after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def periodic_runs(docs: DataFrame, name: str = "periodic", keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``name`` of ``runs`` (start, length, period in words) and ``collapsed``.

    Words are what stands between ASCII white space. ``collapsed`` is the text without the repeats: words that lie in a run after its
    first period are left out, the others are joined by one space. Null, empty and white texts have no word, no run and an empty
    collapsed text. Every row is taken by itself, so repeated rows, null ids and other columns pass by; one that is called ``name``
    is an error. An empty table gives no rows. One pass without a shuffle; a task holds about 2 MB of text, or one longer text.
    """

    def work(texts: list[str | None]) -> pa.Array:
        words = [(t or "").encode().split() for t in texts]
        number = Numbering()
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        cuts = np.cumsum([0, *map(len, words)]).tolist()
        found = runs([flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        rows = np.concatenate([*found, np.zeros((0, 3), np.int64)])
        listed = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32),
                                          pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"]))
        short = pa.array([collapsed(w, f).decode() for w, f in zip(words, found, strict=True)], pa.string())
        return pa.StructArray.from_arrays([listed, short], ["runs", "collapsed"])

    kind = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
    return with_result(docs, name, kind, lambda: work, keep, text)
