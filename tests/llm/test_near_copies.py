"""Near copies against brute-force Jaccard similarity."""

import random
from collections import Counter, defaultdict

import corpus_pipeline

from marquee.llm import near_copies


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows):
    found, where, shared = {d: sets(t) for d, t in rows}, defaultdict(list), Counter()
    for d, s in found.items():
        for x in s:
            where[x].append(d)
    for ids in where.values():
        shared.update((a, b) for i, b in enumerate(sorted(ids)) for a in sorted(ids)[:i])
    return [p for p, n in shared.items() if 5 * n >= 4 * (len(found[p[0]]) + len(found[p[1]]) - n)]


def brute_components(rows):
    label = {d: d for d, _ in rows}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in brute_links(rows):
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {d: find(d) for d in label}


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    assert sum(sets(dict(rows)[a]) != sets(dict(rows)[b]) for a, b in brute_links(rows)) > 3
    assert {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()} == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()) == sorted(set(want.values()))


def test_large_group_chains_and_texts_just_apart(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    core = [word() for _ in range(200)]
    texts = [" ".join([*core[:k], word(), *core[k + 1:]]) for k in (rng.randrange(200) for _ in range(300))]  # one word changed
    walk = [word() for _ in range(200)]
    for _ in range(12):  # ten words at the end are changed from one to the next
        walk = walk[10:] + [word() for _ in range(10)]
        texts.append(" ".join(walk))
    for n in (20, 22, 24, 40):  # about the border
        alone = [word() for _ in range(200)]
        texts += [" ".join(alone), " ".join(alone[:-n] + [word() for _ in range(n)])]
    rows = list(enumerate([*texts, *[texts[-1]] * 50, "", " \t"]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows) | {rows[-1][0]: rows[-2][0]}
    assert {r.doc_id: r.component_id for r in near_copies.groups(frame).collect()} == want


def test_pairs_that_share_a_long_passage(spark):
    """Every pair is just similar enough; all texts share 150 words, so any shingle of these stands in all of them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    shared, rows = " ".join(word() for _ in range(150)), []
    for k in range(400):
        own = [word() for _ in range(110)]
        rows += [(2 * k, f"{shared} {' '.join(own)}"), (2 * k + 1, f"{shared} {' '.join(own[:-22])} {' '.join(word() for _ in range(22))}")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    n = len(sets(rows[0][1]) & sets(rows[1][1]))
    assert 0.8 <= n / len(sets(rows[0][1]) | sets(rows[1][1])) < 0.85
    assert {r.doc_id: r.component_id for r in near_copies.groups(frame).collect()} == {d: d // 2 * 2 for d, _ in rows}


def test_large_bucket_of_several_groups_and_odd_tables(spark, odd, none, monkeypatch):
    """All shingles count alike and buckets of more than three texts go turn by turn, three heads each."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows = [(d, " ".join(words[k:k + rng.randrange(18, 24)])) for d, k in enumerate(5 * rng.randrange(8) for _ in range(70))]
    want = brute_components(rows)
    assert 1 < len(set(want.values())) < 60
    monkeypatch.setattr(near_copies, "SMALL", 3)
    monkeypatch.setattr(near_copies, "HEADS", 3)
    monkeypatch.setattr(near_copies, "COMMON", 1 << 30)
    assert {r.doc_id: r.component_id for r in near_copies.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()} == want
    got = {r.doc_id: r.component_id for r in near_copies.groups(odd).collect()}
    assert len(got) == len({r.doc_id for r in odd.select("doc_id").collect()}) and got[1] == got[2] == 1 and got[4] == got[5] == 4
    assert near_copies.groups(none).count() == 0 and near_copies.deduplicate(none).count() == 0
    kept = near_copies.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8]


def test_pairs_come_from_simhash_first(spark, monkeypatch):
    """Operator 8's hashing proposes pairs: all prints at two bits or fewer are joined, and the groups are built from what it proposes."""
    rng, seen, proposed = random.Random(8), [], near_copies._proposed
    core = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    texts = [" ".join([*core[:k], "other", *core[k + 1:]]) for k in rng.sample(range(400), 30)]
    texts += [" ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(60)) for _ in range(10)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def kept(named):
        seen.append((named.collect(), (out := proposed(named)).collect()))
        return out

    monkeypatch.setattr(near_copies, "_proposed", kept)
    assert {r.component_id for r in near_copies.groups(frame).collect() if r.doc_id < 30} == {0}
    nodes, pairs = seen[0]
    label = {r.node: r.node for r in nodes}
    want = dict(label)
    for links, of in ((pairs, label), ([(a.node, b.node) for a in nodes for b in nodes if bin((a.bits ^ b.bits) & (1 << 64) - 1).count("1") <= 2], want)):
        for a, b in links:
            low, high = sorted((of[a], of[b]))
            of.update({k: low for k, v in of.items() if v == high})
    assert pairs and label == want
