"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import Sent, arrow_map, with_result

KINDS = ["email", "ip", "card", "phone"]
SPANS = "array<struct<start:int,kind:int,end:int>>"
# Characters of an address before its @, and the patterns of the other kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@](?:[^\n]{0,8}[0-9@])*")

#: Characters of a window, and of the step from one to the next. Windows begin at multiples of the step around digits and @.
WINDOW, STEP = 64, 32
#: Documents with a digit or @ that training reads (expected number; all where there are fewer), and windows it takes from one of them.
TRAIN_DOCS, TRAIN_WINDOWS = 2500, 3
HIDDEN, EMBED, UPDATES, BATCH, RATE = 20, 10, 250, 64, 0.01
#: Pairs of windows that are set side by side, for each window with a span.
PAIRS = 3
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _valid(kind: int, text: str) -> bool:
    """What a match of a kind must fulfil besides its pattern."""
    if KINDS[kind] == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in text.split(".")))
    digits = _digits(text)
    if KINDS[kind] == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return KINDS[kind] == "email" or 10 <= len(digits) <= 15


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all valid matches, leftmost and non-overlapping within a kind; a failing match is dropped as a whole.

    An address is found from its @, so a long run of letters is not tried from each of its characters.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return sorted(out)


def _symbols(text: str) -> np.ndarray:
    """Characters as numbers below 102: printable ASCII, line ends, other white space, other letters, anything else; 0 is padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 26, 5)
    for i in np.flatnonzero(out == 5).tolist():
        c = text[i]
        out[i] = 1 if c in "\r\n" else 2 if c.isspace() else 3 if c.isalpha() else 4
    return out


def _windows(text: str) -> list[int]:
    """Starts of the windows: every multiple of the step whose window holds a digit or @ in its inner part.

    Text without either cannot hold a span of any kind, as each kind's check asks for one.
    """
    starts: set[int] = set()
    for m in TRIGGER.finditer(text):
        starts.update(range(max(0, (m.start() - WINDOW) // STEP + 1) * STEP, m.end() + STEP, STEP))
    return sorted(s for s in starts if s == 0 or s < len(text))


def _tags(spans: list[tuple[int, int, int]], start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for s, kind, e in spans:
        a, b = max(s, start), min(e, start + WINDOW)
        if a < b and not out[a - start:b - start].any():
            out[a - start:b - start] = 2 + 2 * kind
            if s >= start:
                out[s - start] = 1 + 2 * kind
    return out


def _cut(symbols: np.ndarray, start: int) -> np.ndarray:
    part = symbols[start:start + WINDOW]
    return np.pad(part, (0, WINDOW - len(part)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Embedding, one LSTM in each direction, a linear layer, and a CRF over the tags."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def init(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.p = {"embed": rng.normal(0, 0.5, (102, EMBED)), "out": init(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for side in "fb":
            self.p |= {"w" + side: init(EMBED + HIDDEN, 4 * HIDDEN), "b" + side: np.r_[np.ones(HIDDEN), np.zeros(3 * HIDDEN)]}
        # an inside tag follows only the begin or inside of its kind
        self.barred = np.zeros((TAGS, TAGS))
        for tag in range(2, TAGS, 2):
            self.barred[[t for t in range(TAGS) if t not in (tag, tag - 1)], tag] = -1e4

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list[tuple]]:
        """Hidden states over time (first axis), and what the way back needs."""
        w, b = self.p["w" + side], self.p["b" + side]
        h = c = np.zeros((x.shape[1], HIDDEN))
        out, kept = np.zeros((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            z = np.concatenate([x[t], h], axis=1)
            a = z @ w + b
            gates = _sigmoid(a[:, :3 * HIDDEN])
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(a[:, 3 * HIDDEN:])
            kept.append((t, z, f, i, o, g, c))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = h
        return out, kept

    def _lstm_back(self, grad: np.ndarray, kept: list[tuple], side: str, into: dict[str, np.ndarray]) -> np.ndarray:
        w = self.p["w" + side]
        dx = np.zeros((*grad.shape[:2], EMBED))
        dh = dc = np.zeros((grad.shape[1], HIDDEN))
        for t, z, f, i, o, g, before in reversed(kept):
            c = f * before + i * g
            tc = np.tanh(c)
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * before * f * (1 - f), dc * g * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            into["w" + side] += z.T @ da
            into["b" + side] += da.sum(axis=0)
            dz = da @ w.T
            dx[t], dh, dc = dz[:, :EMBED], dz[:, EMBED:], dc * f
        return dx

    def _emit(self, symbols: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["embed"][symbols.T]
        hf, kf = self._lstm(x, "f")
        hb, kb = self._lstm(x, "b")
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["out"] + self.p["out_b"], (h, kf, kb)

    def loss(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        n, steps = symbols.shape
        e, (h, kf, kb) = self._emit(symbols)
        move = self.p["move"] + self.barred
        forward = np.zeros_like(e)
        forward[0] = e[0] + self.p["first"] + self.barred[0]
        for t in range(1, steps):
            forward[t] = _logsum(forward[t - 1][:, :, None] + move, 1) + e[t]
        log_z = _logsum(forward[-1], 1)
        back = np.zeros_like(e)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(steps - 2, -1, -1):
            ahead = back[t + 1] + e[t + 1]
            back[t] = _logsum(move + ahead[:, None, :], 2)
            grads["move"] += np.exp(forward[t][:, :, None] + move + ahead[:, None, :] - log_z[:, None, None]).sum(axis=0)
        de = np.exp(forward + back - log_z[:, None])
        grads["first"] += de[0].sum(axis=0)
        row, y = np.arange(n), tags.T
        gold = self.p["first"][y[0]] + self.barred[0][y[0]]
        np.subtract.at(grads["first"], y[0], 1)
        for t in range(steps):
            gold = gold + e[t][row, y[t]]
            de[t][row, y[t]] -= 1
            if t:
                gold = gold + move[y[t - 1], y[t]]
                np.subtract.at(grads["move"], (y[t - 1], y[t]), 1)
        grads["out"] += np.einsum("tnh,tnk->hk", h, de)
        grads["out_b"] += de.sum(axis=(0, 1))
        dh = de @ self.p["out"].T
        dx = self._lstm_back(dh[:, :, :HIDDEN], kf, "f", grads) + self._lstm_back(dh[:, :, HIDDEN:], kb, "b", grads)
        np.add.at(grads["embed"], symbols.T, dx)
        return float((log_z - gold).mean()), {k: g / n for k, g in grads.items()}

    def train(self, symbols: np.ndarray, tags: np.ndarray, updates: int = UPDATES, seed: int = 7) -> float:
        """Adam over shuffled windows, pass after pass up to ``updates`` steps; the mean loss of the last pass."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        while len(symbols) and step < updates:
            order, losses = rng.permutation(len(symbols)), []
            for k in range(0, len(order), BATCH)[:updates - step]:
                some = order[k:k + BATCH]
                loss, grads = self.loss(symbols[some], tags[some])
                losses.append(loss)
                step += 1
                norm = max(1.0, np.sqrt(sum((g * g).sum() for g in grads.values())) / 5)
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g / norm
                    v[name] = 0.999 * v[name] + 0.001 * (g / norm) ** 2
                    self.p[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return float(np.mean(losses)) if losses else 0.0

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """The best tags of every window, by Viterbi."""
        e, _ = self._emit(symbols)
        move = self.p["move"] + self.barred
        value, came = e[0] + self.p["first"] + self.barred[0], []
        for t in range(1, len(e)):
            paths = value[:, :, None] + move
            came.append(paths.argmax(axis=1))
            value = paths.max(axis=1) + e[t]
        out = np.zeros(symbols.shape, np.int64)
        out[:, -1] = value.argmax(axis=1)
        row = np.arange(len(out))
        for t in range(len(e) - 2, -1, -1):
            out[:, t] = came[t][row, out[:, t + 1]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Tagger | None:
    """Train on windows around the base spans of about ``train_docs`` documents, taken by a hash of their text.

    The labels are the base spans. Windows are also set side by side in pairs, cut at their spans, so that spans that touch are
    learned, which the patterns run together. None if the corpus has no span.
    """
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    n = rows.select(F.xxhash64("text")).distinct().count()  # copies count once, as their share is taken by the same hash
    if not n:
        return None
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, train_docs / n) * (1 << 30))).distinct()

    def work(c: dict[str, list]) -> dict[str, object]:
        symbols, tags = [], []
        for text in c["text"]:
            spans, codes = base(text), _symbols(text)
            near = [max(0, s - (7 * s) % 29) for s, _, _ in spans][:TRAIN_WINDOWS] + _windows(text)[:1]
            for start in near:
                symbols.append(_cut(codes, start).tolist())
                tags.append(_tags(spans, start).tolist())
        return {"symbols": pa.array(symbols, pa.list_(pa.int32())), "tags": pa.array(tags, pa.list_(pa.int32()))}

    got = arrow_map(picked, "symbols array<int>, tags array<int>", work).distinct().orderBy("symbols").limit(train_docs * (TRAIN_WINDOWS + 1)).toArrow()
    x, y = (np.array(got.column(k).to_pylist(), np.int64).reshape(-1, WINDOW) for k in ("symbols", "tags"))
    if not y.any():
        return None
    whole = lambda rows: ~((rows[:, 0] > 0) & (rows[:, 0] % 2 == 0))  # noqa: E731  a window that begins inside a span has no valid path
    x, y = x[whole(y)], y[whole(y)]
    rng = np.random.default_rng(11)
    spanned = np.flatnonzero((y > 0).any(axis=1))
    glued_x, glued_y = [], []
    for a, b in zip(np.concatenate([rng.permutation(spanned) for _ in range(PAIRS)]), np.concatenate([rng.permutation(spanned) for _ in range(PAIRS)]), strict=True):
        end = int(np.flatnonzero(y[a] > 0)[0])
        while end < WINDOW and y[a][end] > 0:
            end += 1
        begin = int(np.flatnonzero(y[b] > 0)[0])
        gap = [_symbols(" ")[0]]
        glued_x.append(np.concatenate([x[a][:end], gap, x[b][begin:], np.zeros(WINDOW, np.int64)])[max(0, end - 40):][:WINDOW])
        glued_y.append(np.concatenate([y[a][:end], [0], y[b][begin:], np.zeros(WINDOW, np.int64)])[max(0, end - 40):][:WINDOW])
    tagger = Tagger()
    if glued_y:
        more_x, more_y = np.array(glued_x), np.array(glued_y)
        x, y = np.concatenate([x, more_x[whole(more_y)]]), np.concatenate([y, more_y[whole(more_y)]])
    tagger.train(x, y)
    return tagger


def added(tagger: Tagger, texts: list[str], known: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans the tagger finds besides the ``known`` ones in every text.

    Windows overlap by half. A character takes its tag from the window in whose middle it lies most; spans are then read from the
    whole text's tags, so one that crosses windows is found once. A span counts if it fulfils its kind's check, has only its kind's
    characters, and touches no known span.
    """
    where, stack = [], []
    for i, text in enumerate(texts):
        if starts := _windows(text):
            codes = _symbols(text)
            where += [(i, s) for s in starts]
            stack += [_cut(codes, s) for s in starts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    tags: dict[int, dict[int, tuple[int, int]]] = {}
    for k in range(0, len(stack), 2048):
        for (i, s), path in zip(where[k:k + 2048], tagger.decode(np.array(stack[k:k + 2048])), strict=True):
            mine = tags.setdefault(i, {})
            for at in np.flatnonzero(path).tolist():
                mine.setdefault(s + at, (0, -1))
            for at in range(WINDOW):
                depth = min(at, WINDOW - 1 - at) if s else WINDOW - 1 - at
                if s + at in mine and depth > mine[s + at][1]:
                    mine[s + at] = (int(path[at]), depth)
    for i, found in tags.items():
        spans, text = [], texts[i]
        for at in sorted(found):
            tag = found[at][0]
            if not tag or at >= len(text):
                continue
            kind = (tag - 1) // 2
            if tag % 2 == 0 and spans and spans[-1][2] == at and spans[-1][1] == kind:
                spans[-1][2] = at + 1
            else:
                spans.append([at, kind, at + 1])
        out[i] = [(s, k, e) for s, k, e in spans if _shaped(k, text[s:e]) and all(e <= a or b <= s for a, _, b in known[i])]
    return out


def _shaped(kind: int, text: str) -> bool:
    pattern = (None, IP, CARD, PHONE)[kind]
    if pattern is None:
        name, _, rest = text.partition("@")
        return bool(name) and set(name) <= LOCAL and bool(DOMAIN.fullmatch("@" + rest))
    return bool(pattern.fullmatch(text)) and _valid(kind, text)


def detect(docs: DataFrame, tagger: Tagger | None, name: str = "personal", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``name``: a struct of ``base`` and ``added`` spans (start, number of the kind, end).

    Positions are code points. Null and empty texts have no span. Every row gets its result, other columns pass by.
    """
    held = Sent(docs.sparkSession, tagger)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def rows(spans: list[list[tuple[int, int, int]]]) -> pa.Array:
        return pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in doc] for doc in spans], kind)

    def make() -> Callable[[list[str | None]], pa.Array]:
        model = held.value

        def work(texts: list[str | None]) -> pa.Array:
            whole = [t or "" for t in texts]
            known = [base(t) for t in whole]
            more = added(model, whole, known) if model else [[] for _ in whole]
            return pa.StructArray.from_arrays([rows(known), rows(more)], names=["base", "added"])

        return work

    return with_result(docs, name, f"struct<base:{SPANS},added:{SPANS}>", make, keep)


def listed(spans: str) -> str:
    """SQL for spans as text: kind:start:end by start, then kind, then end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"concat_ws(',', transform(array_sort({spans}), s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)))"


def masked(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; ``n_chars`` follows. Spans that overlap become one."""
    held = Sent(docs.sparkSession, tagger)

    def cover(text: str, spans: list[tuple[int, int, int]]) -> Iterator[str]:
        at = 0
        for start, kind, end in sorted(spans):
            if start >= at:
                yield text[at:start]
                yield f"[{KINDS[kind].upper()}]"
            at = max(at, end)
        yield text[at:]

    def make() -> Callable[[list[str | None]], pa.Array]:
        model = held.value

        def work(texts: list[str | None]) -> pa.Array:
            whole = [t or "" for t in texts]
            known = [base(t) for t in whole]
            more = added(model, whole, known) if model else [[] for _ in whole]
            return pa.array([t if t is None else "".join(cover(t, a + b)) for t, a, b in zip(texts, known, more, strict=True)], pa.string())

        return work

    name = "_masked"
    while name in docs.columns:
        name += "_"
    done = with_result(docs, name, "string", make)
    out = [F.col(name).alias(c) if c == "text" else F.length(name).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*out)
