"""SimHash, decontamination and quartile digests against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from marquee.llm import decontaminate, quartile_digest, queries, simhash

FOLDER = "/root/testdata/sf0.001"


def fingerprint(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """{row: smallest id} for rows of (id, fingerprint), by comparing all pairs."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_equals_all_pairs(spark, table):
    docs = [(r.doc_id, fingerprint(r.text)) for r in table("documents").collect()]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(docs, brute_components(docs), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op8_simhash"](spark, FOLDER).collect()}
    assert got == want


def test_links_chains_and_dense_groups(spark):
    rng = random.Random(4)
    points = [rng.getrandbits(64) for _ in range(30)]
    chain = [points[0]]
    for _ in range(40):  # each two bits from the one before
        chain.append(chain[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    dense = [points[1] ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)][:300]
    rows = list(enumerate([*points, *chain, *dense, *dense[:50], 0, 0, 1 << 63]))
    frame = spark.createDataFrame([(d, int(np.uint64(f).astype(np.int64))) for d, f in rows], "doc_id bigint, bits bigint")
    label = {r.bits: r.component_id for r in simhash.groups(frame).collect()}
    want = brute_components(rows)
    assert [label[int(np.uint64(f).astype(np.int64))] for _, f in rows] == want


def test_simhash_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert len(got) == odd.count()
    assert {c for d, c in got if d in (4, 5)} == {4} and {c for d, c in got if d in (1, 2)} == {1}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "6", "7", "8", "None"])
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(docs, items, width=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[i:i + width]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_short_items_overlaps_and_nulls(spark, odd, none):
    items = [(1, "Same TEXT here"), (2, "word and word and word and word and word and word"), (3, None), (4, "..."), (5, "twice"), (None, "text without"), (6, " ".join("abcdefghijklmn")), (6, "no")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    more = spark.createDataFrame([(20, "x a b c d e f g h i j k l m n y"), (21, "a b c d e f g h i k"), (22, "b c d e f g h i j k a b c d e f g h i j z"), (22, "word " * 9)], "doc_id bigint, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    got = sorted((tuple(r) for r in decontaminate.report(docs, bench).collect()), key=str)
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(i if i is not None else None, t) for i, t in items if i is not None] + [("\0", "text without")])
    strip = lambda rows: sorted(((r[0], r[1], r[2], r[5]) for r in rows), key=str)  # noqa: E731  the item without an id has no name
    assert strip(got) == strip(want)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in want if not r[5])
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_is_native(spark, table):
    plan = decontaminate.report(table("documents"), table("benchmark"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quartile_digests(spark, table):
    docs = sorted((r.doc_id, r.text or "") for r in table("documents").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op9_quartile_digest"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    near = 0
    for i, (d, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        changed = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        own, made, after = quartile_digest.digests([t.encode() for t in (text, changed, following)])
        assert got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[d].n_chars == len(text)
        assert [got[d].fingerprint, got[d].edited_fingerprint] == quartile_digest.spelled(np.array([own, made]))
        assert got[d].near_edited == quartile_digest.likeness(own[None], made[None])[0] and got[d].near_next == quartile_digest.likeness(own[None], after[None])[0]
        near += got[d].near_edited > got[d].near_next
    assert near > 0.95 * len(docs)


def test_quartile_digest_by_hand():
    text = b"abcabdab" * 5
    counts = [0] * 256
    for i in range(len(text) - 2):
        v = text[i] << 16 | text[i + 1] << 8 | text[i + 2]
        counts[v * 2654435761 % 2**32 >> 24] += 1
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    assert quartile_digest.digests([b"", text, b"ab"])[1, 1:].tolist() == [sum(c > x for x in q) for c in counts]


def test_quartile_digest_odd_rows(odd, none, spark):
    rows = quartile_digest.compare_edited(odd).collect()
    assert len(rows) == odd.count()
    same = [r.fingerprint for r in rows if r.doc_id in (4, 5)]
    assert len(set(same)) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert quartile_digest.compare_edited(none).count() == 0
    single = quartile_digest.compare_edited(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).collect()
    assert single[0].near_next == 1.0 and single[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
