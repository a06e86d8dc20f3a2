"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import codecs
import heapq
import re
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import CHUNK_CHARS, Remembered, Sent, arrow_map, blocks, held

SPACE = "▁"
#: No pair: above every rank.
NONE = np.int32(2**31 - 1)
#: Rounds after which the few words still open (long runs of one character, say) are merged one by one, in the same order.
ROUNDS = 128


def _per_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


class Lookup:
    """Numbers by 64-bit key, by open addressing: a key lies within ``probes`` slots of its own."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.used, self.keys, self.values = np.zeros(size + 64, bool), np.zeros(size + 64, np.uint64), np.zeros(size + 64, np.asarray(values).dtype)
        keys = np.asarray(keys).astype(np.uint64)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            free = ~self.used[slot]
            got, first = np.unique(slot[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            self.used[got], self.keys[got], self.values[got] = True, keys[todo[winners]], np.asarray(values)[todo[winners]]
            rest = np.ones(len(todo), bool)
            rest[winners] = False
            todo, slot = todo[rest], slot[rest] + 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray, missing: float) -> np.ndarray:
        keys = keys.astype(np.uint64)
        slot, out = self._slot(keys), np.full(len(keys), missing, self.values.dtype)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            at = slot[todo]
            hit = self.used[at] & (self.keys[at] == keys[todo])
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & self.used[at]]
            if not len(todo):
                break
            slot[todo] += 1
        return out


@dataclass
class Vocabulary:
    """The pieces of a model file, as plain data that can be sent to the workers."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]  # normal, byte, control or unknown
    bos: int
    eos: int
    unk: int


def load(path: str) -> Vocabulary:
    """Read a BPE model with identity normalisation, dummy prefix and byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "normal" for i in range(n)]
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds, sp.bos_id(), sp.eos_id(), sp.unk_id())


class Codec:
    """Encodes and decodes with one vocabulary. Symbols are numbers: piece ids, then other characters of pieces."""

    def __init__(self, v: Vocabulary):
        self.v = v
        normal = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == "normal"}
        order = {s: r for r, s in enumerate(sorted({-v.scores[i] for i in normal.values()}))}
        node = dict(normal)
        for p in normal:
            for c in p:
                node.setdefault(c, len(v.pieces) + len(node) - len(normal))
        self.n = len(v.pieces) + len(node) - len(normal)
        left, right, merged = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                if (a := node.get(p[:k])) is not None and (b := node.get(p[k:])) is not None:
                    left.append(a), right.append(b), merged.append(i)
        rank = np.full(self.n, NONE, np.int32)
        for i in normal.values():
            rank[i] = order[-v.scores[i]]
        self.rank = rank
        left, right, merged = np.array(left), np.array(right), np.array(merged)
        # a piece is safe if no pair with it comes as early as the piece itself: then all its occurrences may be merged at once
        self.safe = np.ones(self.n, bool)
        for side in (left, right):
            self.safe[side[rank[merged] <= rank[side]]] = False
        self.pairs = Lookup(left * self.n + right, merged.astype(np.int32))
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in node.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        inner = any(SPACE in p.lstrip(SPACE) for p in normal)  # else no merge goes from another character to a space
        self.unit = re.compile("(?s).+" if inner else f"{SPACE}+[^{SPACE}]*")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == "byte"}
        self.surface = [b"" if k == "control" else bytes([int(p[3:5], 16)]) if k == "byte" else " ⁇ ".encode() if k == "unknown" else p.replace(SPACE, " ").encode()
                        for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.spelled = {c: i for c, i in node.items() if i >= len(v.pieces)}  # characters that are not pieces
        codecs.register_error("per_byte", _per_byte)
        self.ids = Remembered(self.words)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        out = np.full(len(a), -1, np.int32)
        known = np.flatnonzero((a < self.n) & (b < self.n))
        out[known] = self.pairs.find(a[known].astype(np.int64) * self.n + b[known], -1)
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the pieces of every non-empty word, one after the other.

        Every round takes, in each word, the least rank of its pairs, merges that pair (everywhere in the word if the piece is safe,
        else only at the leftmost place), and closes the gaps. Words without a pair leave.
        """
        lens = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char[code].astype(np.int64)
        strange = np.flatnonzero(sym < 0)
        chars, index = np.unique(code[strange], return_inverse=True)
        sym[strange] = self.n + index
        word = np.repeat(np.arange(len(words)), lens)
        made = np.full(len(sym), -1, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        made[inside] = self._merged(sym[inside], sym[inside + 1])
        rank = np.where(made >= 0, self.rank[made], NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for turn in range(ROUNDS + 1):
            if not len(sym):
                break
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lens = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            if turn == ROUNDS:
                for s, n in zip(starts.tolist(), lens.tolist(), strict=True):
                    got = self._one_by_one(sym[s:s + n].tolist())
                    done.append((np.full(len(got), word[s]), np.array(got)))
                break
            closed = np.repeat(least == NONE, lens)
            if closed.any():
                done.append((word[closed], sym[closed]))
                keep = ~closed
                sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
                open_ = least != NONE
                least, lens = least[open_], lens[open_]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lens))
            owner = word[at]
            first = np.r_[True, owner[1:] != owner[:-1]]
            group = np.cumsum(first) - 1
            single = np.bincount(group, ~self.safe[made[at]]) > 0
            # of overlapping occurrences every second one is taken, from the left
            run = np.r_[True, at[1:] != at[:-1] + 1] | first
            head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            take = at[np.where(single[group], first, (np.arange(len(at)) - head) % 2 == 0)]
            sym[take] = made[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
            now = place[take]
            now = np.unique(np.concatenate([now, now[now > 0] - 1]))
            right = np.minimum(now + 1, len(sym) - 1)
            pair = (now + 1 < len(sym)) & (word[right] == word[now])
            new = np.full(len(now), -1, np.int32)
            new[pair] = self._merged(sym[now[pair]], sym[right[pair]])
            made[now], rank[now] = new, np.where(new >= 0, self.rank[new], NONE)
        owner = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return self._spell(owner[order], sym[order], chars, len(words))

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """Merge one word with a heap: the least rank first, of equal ranks the leftmost."""
        n = len(sym)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        table = self.__dict__.setdefault("_pairs", dict(zip(self.pairs.keys[self.pairs.used].tolist(), self.pairs.values[self.pairs.used].tolist(), strict=True)))

        def look(i: int) -> None:
            j = after[i]
            if j < n and sym[i] < self.n and sym[j] < self.n and (m := table.get(sym[i] * self.n + sym[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, sym[i], sym[j], m))

        for i in range(n):
            look(i)
        gone = [False] * n
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if gone[i] or sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], gone[j], after[i] = m, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def _spell(self, owner: np.ndarray, sym: np.ndarray, chars: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are not pieces become the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(sym >= len(self.v.pieces))
        if not len(odd):
            return sym.astype(np.int32), np.bincount(owner, minlength=n)
        names = {i: c for c, i in self.spelled.items()} | {self.n + k: chr(c) for k, c in enumerate(chars.tolist())}
        spelled = {i: np.array([self.bytes.get(b, self.v.unk) for b in names[i].encode("utf-8", "surrogatepass")], np.int64) for i in set(sym[odd].tolist())}
        size = np.ones(len(sym), np.int64)
        size[odd] = [len(spelled[i]) for i in sym[odd].tolist()]
        out = np.repeat(sym, size)
        for p, i in zip((np.cumsum(size) - size)[odd].tolist(), sym[odd].tolist(), strict=True):
            out[p:p + len(spelled[i])] = spelled[i]
        return out.astype(np.int32), np.bincount(np.repeat(owner, size), minlength=n)

    def encode(self, texts: list[str | None], ends: bool = True) -> list[np.ndarray]:
        """The ids of every text, with begin and end ids if asked for. Null is as empty: no piece."""
        if len(texts) == 1 and len(texts[0] or "") > CHUNK_CHARS:
            parts = blocks(m.group() for m in self.unit.finditer(SPACE + texts[0].replace(" ", SPACE)))
            found = [np.concatenate([self.ids([part])[0] for part in parts])]
        else:
            found = self.ids([self.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts])
        before, after = ([self.v.bos], [self.v.eos]) if ends else ([], [])
        return [np.concatenate([before, ids, after]).astype("<u4") for ids in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces are silent, the first space is the dummy one, a byte that makes no character is U+FFFD."""
        ids = [i for i in np.asarray(ids).tolist() if self.v.kinds[i] != "control"]
        if not ids:
            return ""
        parts = itemgetter(*ids)(self.surface)
        joined = b"".join(parts) if len(ids) > 1 else parts
        spaced = self.v.kinds[ids[0]] == "normal" and self.v.pieces[ids[0]].startswith(SPACE)
        return joined[spaced:].decode("utf-8", "per_byte")


def encode_decode(docs: DataFrame, model: str, ends: bool = True) -> DataFrame:
    """(doc_id, ids, decoded): every row's ids as little-endian unsigned 32-bit numbers, and the text decoded from them.

    Null and empty texts have no piece, only the begin and end ids. Repeated rows stay, other columns are ignored. The model file is
    read once, on the driver; tasks get its pieces. Words are merged once for all their occurrences in a run of rows.
    """
    vocabulary = Sent(docs.sparkSession, load(model))

    def work(c: dict[str, list]) -> dict[str, object]:
        codec = held("piece codec", (model, len(vocabulary.value.pieces)), lambda: Codec(vocabulary.value))
        ids = codec.encode(c["text"], ends)
        return {"doc_id": pa.array(c["doc_id"], pa.int64()), "ids": pa.array([i.tobytes() for i in ids], pa.binary()),
                "decoded": pa.array([codec.decode(i) for i in ids], pa.string())}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id bigint, ids binary, decoded string", work)
