"""Alignment of two tokenizers' tokens by diagonal run skipping, and how often tokens end together in the corpus."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import CHUNK_CHARS, Remembered, blocks, held, slices, stage, with_result
from marquee.llm.pieces import SPACE
from marquee.llm.token_store import TextEncoder

#: Tokens of A in a lane. Lanes are aligned side by side.
LANE = 256
#: Tokens of A that are tried for the start of a lane inside a document.
TRIED = 32
#: Units of each tokenizer that a worker remembers.
UNITS_HELD = 120_000
#: Characters of text that are aligned at a time.
ALIGNED_CHARS = 250_000
#: Links and documents of a chunk that shares one table of pairs.
CHUNK_LINKS, CHUNK_DOCS = 1 << 19, 4096


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceEncoder:
    """The sentencepiece library over whole texts, called once for each distinct unit of spaces and what follows them."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes, inner = [], False
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode())
            inner |= not self.model.is_control(i) and SPACE in piece.lstrip(SPACE)
        self.unit = re.compile(r"(?s).+" if inner else r" +[^ ]+(?: +\Z)?| +")  # no piece goes from another character to a space
        self.units = Remembered(self._encode, UNITS_HELD)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units; the library adds the first space of each."""
        found = self.model.encode([u[1:] for u in units], num_threads=1)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(lens.sum())), lens

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0] or "") > CHUNK_CHARS:
            return [np.concatenate([self.units([part])[0] for part in blocks(m.group() for m in self.unit.finditer(f" {texts[0]}"))])]
        return self.units([self.unit.findall(f" {t}") if t else [] for t in texts])


class Sides:
    """The tokens of a byte-level tokenizer (A) and of a piece model (B), with the bytes of each."""

    def __init__(self, a_model: str, b_model: bytes):
        plan = json.loads(a_model)
        special = {t["content"] for t in plan.get("added_tokens", []) if t.get("special")}
        plan["added_tokens"] = [t for t in plan.get("added_tokens", []) if t["content"] not in special]  # then their strings are plain text
        plan["post_processor"] = None
        self.a = TextEncoder(json.dumps(plan, ensure_ascii=False))
        self.a.units.most = UNITS_HELD
        self.b = PieceEncoder(b_model)
        byte = _byte_alphabet()
        names = {i: p for p, i in self.a.model.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(byte[c] for c in names[i]) if i in names and all(c in byte for c in names[i]) else names.get(i, "").encode()
                        for i in range(max(names) + 1)]
        self.b_bytes = self.b.bytes
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids have 16 bits at most")
        self.shown = [f"{i}{c}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for c in ",|;"]
        self.a_lens, self.b_lens = (np.array([len(b) for b in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every text in A and B; none if either does not spell the text with a space before it."""
        a = self.a([f" {t}" if t else "" for t in texts])
        b = self.b(texts)
        none = np.zeros(0, np.int64)
        for k, t in enumerate(texts):
            whole = f" {t}".encode() if t else b""
            if not t or any(b"".join(map(side.__getitem__, ids.tolist())) != whole for side, ids in ((self.a_bytes, a[k]), (self.b_bytes, b[k]))):
                a[k] = b[k] = none
        return a, b


def _lanes(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes begin in A and B: at documents, and in long ones after a common end near every LANE-th token, if one is close."""
    near = np.arange(LANE, len(ends_a) - TRIED, LANE)
    if not len(near):
        return starts_a, starts_b
    tried = near[:, None] + np.arange(TRIED)
    found = np.searchsorted(ends_b, ends_a[tried])
    common = ends_b[np.minimum(found, len(ends_b) - 1)] == ends_a[tried]
    some = common.any(axis=1)
    first = common[some].argmax(axis=1)
    at = near[some] + first
    begin_a = np.concatenate([starts_a, at + 1])
    begin_b = np.concatenate([starts_b, found[some, first] + 1])
    inside = (begin_a < len(ends_a)) & (begin_b < len(ends_b))
    begin_a, keep = np.unique(begin_a[inside], return_index=True)
    return begin_a, begin_b[inside][keep]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the tokens of A and B, in order, that end at the same byte.

    Ends rise strictly, and each document's tokens (which begin at ``starts_a``, ``starts_b``) end together. A lane stands at a place in
    both arrays, whose difference is its shift. It compares the ends at that shift, twice as many each time as long as all are equal, and
    jumps over the equal ones, which are groups of one to one. At an unequal one, the side that is behind goes on token by token until
    both end together; that closes the irregular group, and the lane goes on with the new shift. All lanes step at the same time.
    """
    if not len(ends_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = _lanes(ends_a, ends_b, starts_a, starts_b)
    last_a, last_b = np.r_[i[1:], len(ends_a)], np.r_[j[1:], len(ends_b)]
    width, met = np.full(len(i), 2), []
    while len(i):
        n = np.minimum(width, np.minimum(last_a - i, last_b - j))
        lane = np.repeat(np.arange(len(i)), n)
        t = np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n)
        apart = np.flatnonzero(ends_a[i[lane] + t] != ends_b[j[lane] + t])
        equal = n.copy()
        owner = lane[apart]
        first = np.r_[True, owner[1:] != owner[:-1]][:len(owner)]
        equal[owner[first]] = t[apart[first]]
        run = t < equal[lane]
        met.append((i[lane[run]] + t[run], j[lane[run]] + t[run]))
        i, j = i + equal, j + equal
        width = np.where(equal == n, 2 * width, 2)
        odd = np.flatnonzero(equal < n)
        a, b, live = i[odd], j[odd], np.arange(len(odd))
        while len(live):
            behind = ends_a[a[live]] < ends_b[b[live]]
            a[live[behind]] += 1
            b[live[~behind]] += 1
            live = live[ends_a[a[live]] != ends_b[b[live]]]
        met.append((a, b))
        i[odd], j[odd] = a + 1, b + 1
        going = i < last_a
        i, j, last_a, last_b, width = i[going], j[going], last_a[going], last_b[going], width[going]
    return np.sort(np.concatenate([a for a, _ in met])), np.sort(np.concatenate([b for _, b in met]))


def _listed(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, cuts: np.ndarray, shown: list[str]) -> list[str]:
    """The groups' text ``a1,a2|b1;a3|b2,b3`` of every document. Groups have so many tokens of A and B, documents so many of both.

    ``shown`` has every id followed by a comma, a bar and a semicolon.
    """
    upto_a, upto_b = np.cumsum(size_a), np.cumsum(size_b)
    code_a, code_b = 3 * a, 3 * b
    code_a[upto_a - 1] += 1
    code_b[upto_b - 1] += 2
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)] = code_a
    codes[np.arange(len(b)) + np.repeat(upto_a, size_b)] = code_b
    return ["".join(map(shown.__getitem__, codes[s:e].tolist()))[:-1] for s, e in zip(cuts, cuts[1:], strict=False)]


def align(docs: DataFrame, a_model: str, b_model: str, name: str = "alignment", keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``name`` of ``n_a``, ``n_b``, ``n_groups``, ``groups`` and ``links``.

    A reads a space and the text, B the text, to which it adds that space; strings of special tokens are plain text. The byte offsets
    where tokens of both end cut the tokens into groups; ``groups`` lists them as ``a1,a2|b1;a3|b2,b3`` in ids. ``links`` has the pair of
    tokens that end each group, as two little-endian unsigned 16-bit ids a link. Null and empty texts, and texts that either side does not
    spell byte by byte (a text with U+2581, say), have no token, no group and an empty ``groups``. Every row is taken by itself, so
    repeated rows, null ids and other columns pass by; one that is called ``name`` is an error. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(a_model, encoding="utf-8") as f, open(b_model, "rb") as g:
        models = spark.sparkContext.broadcast((f.read(), g.read()))

    def make():
        sides = held("alignment", hash(models.value), lambda: Sides(*models.value))

        def work(texts: list[str | None]) -> pa.Array:
            a, b = sides(texts)
            n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
            flat_a, flat_b = (np.concatenate([np.asarray(x, np.int64) for x in side]) if side else np.zeros(0, np.int64) for side in (a, b))
            upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
            some = n_a > 0
            last_a, last_b = common_ends(np.cumsum(sides.a_lens[flat_a]), np.cumsum(sides.b_lens[flat_b]), (upto_a - n_a)[some], (upto_b - n_b)[some])
            upto = np.searchsorted(last_a, upto_a)  # groups that end before each document's end
            n_groups = np.diff(np.r_[0, upto])
            groups = _listed(flat_a, flat_b, np.diff(np.r_[-1, last_a]), np.diff(np.r_[-1, last_b]), np.r_[0, upto_a + upto_b], sides.shown)
            links = np.column_stack([flat_a[last_a], flat_b[last_b]]).astype("<u2").tobytes()
            bounds = np.r_[0, upto].tolist()
            return pa.StructArray.from_arrays(
                [pa.array(n_a), pa.array(n_b), pa.array(n_groups, pa.int64()), pa.array(groups, pa.string()),
                 pa.array([links[4 * s:4 * e] for s, e in zip(bounds, bounds[1:], strict=False)], pa.binary())], ["n_a", "n_b", "n_groups", "groups", "links"])

        return work

    return with_result(docs, name, "struct<n_a: bigint, n_b: bigint, n_groups: bigint, groups: string, links: binary>", make, keep, text, ALIGNED_CHARS)


def link_counts(aligned: DataFrame, links: str = "links") -> DataFrame:
    """``aligned`` without the column ``links`` and with ``n_links``, ``n_best`` and ``count_sum``.

    The count of a pair of ids is the number of links of all rows that hold it. ``n_best`` counts the row's links whose pair has the
    highest count of its B id, ties included; ``count_sum`` adds the counts of all its links. Rows are dealt into chunks where they stand;
    a chunk holds CHUNK_LINKS links (or one row with more) and one table of its different pairs, so what is shuffled by pair is a row for
    each chunk and pair, not for each link, and a pair that stands everywhere has a row for each chunk, which a skewed join can split.
    The counts come back as one row for each chunk, whose links look them up by number. Null links are none. An empty table gives no rows.
    """
    added = [c for c in ("n_links", "n_best", "count_sum") if c in aligned.columns]
    if added:
        raise ValueError(f"columns {added} exist")
    kept = [c for c in aligned.columns if c != links]
    rows = aligned.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(links).alias("links"))
    kind = rows.schema["row"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("links", 0, lambda: None)  # a worker that encoded before lets go of its vocabularies
        part, seq = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []
        n_links = n_rows = 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            found = [np.frombuffer(x or b"", "<u4") for x in table.column("links").to_pylist()]
            pairs, index, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            row = table.column("row").combine_chunks()
            row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.ListArray.from_arrays(np.array([0, len(row)], np.int32), row), pa.array([[len(x) for x in found]], pa.list_(pa.int32())),
                 pa.array([pairs.astype(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([index.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()], pa.binary())],
                names=["chunk", "rows", "sizes", "pairs", "counts", "index"])

        for batch in batches:
            for some in slices(batch, "links", 4 * CHUNK_LINKS):
                size = pa.compute.sum(pa.compute.binary_length(some.column("links"))).as_py() or 0
                if waiting and (n_links + size // 4 > CHUNK_LINKS or n_rows + len(some) > CHUNK_DOCS):
                    yield chunk()
                    seq, n_links, n_rows, waiting = seq + 1, 0, 0, []
                waiting.append(some)
                n_links, n_rows = n_links + size // 4, n_rows + len(some)
        if waiting:
            yield chunk()

    chunks = stage(rows.mapInArrow(deal, f"chunk bigint, rows array<{kind}>, sizes array<int>, pairs array<bigint>, counts array<bigint>, index binary"), "chunks")
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("k", "p")).select("chunk", "k", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    # a link's number holds the id of B in the upper half; an id of B has at most one pair for each id of A
    counts = stage(listed.groupBy("pair").agg(F.sum("n").alias("n")), "pairs").withColumn("b", F.shiftright("pair", 16))
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    scored = stage(counts.join(best, "b").select("pair", F.when(F.col("n") == F.col("most"), F.col("n")).otherwise(-F.col("n")).alias("count")), "scored")
    table = listed.select("chunk", "k", "pair").join(scored, "pair").select("chunk", "k", "count")

    def look_up(chunk: pa.Table, table: pa.Table) -> pa.Table:
        """Counts of pairs that are not the best of their B id come as negative numbers."""
        count = np.zeros(len(table), np.int64)
        count[table.column("k").to_numpy()] = table.column("count").to_numpy()
        done = []
        for one in chunk.to_batches(max_chunksize=1):
            sizes = one.column("sizes")[0].values.to_numpy().astype(np.int64)
            upto = np.cumsum(sizes)
            index = one.column("index")[0].as_py()
            got = count[np.frombuffer(index, "<u2" if len(index) == 2 * upto[-1] else "<u4")]
            good = np.r_[0, np.cumsum(got > 0)]
            total = np.r_[0, np.cumsum(np.abs(got, out=got))]
            done.append(pa.table({"row": one.column("rows")[0].values, "n_links": sizes, "n_best": good[upto] - good[upto - sizes], "count_sum": total[upto] - total[upto - sizes]}))
        return pa.concat_tables(done)

    joined = chunks.select(F.col("chunk").alias("of"), "rows", "sizes", "index").groupBy("of").cogroup(table.groupBy("chunk"))
    return joined.applyInArrow(look_up, f"row {kind}, n_links bigint, n_best bigint, count_sum bigint").select("row.*", "n_links", "n_best", "count_sum")
