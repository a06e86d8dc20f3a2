"""Components, positions and batches against plain loops, with hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import batching
from marquee.operators.batching import greedy_batches
from marquee.operators.components import RedirectCycle, components, resolve_chain
from marquee.operators.duplicates import exact_groups, ordered_members, pair_verdicts
from marquee.operators.ranking import positions


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    by_key = {}
    for m, k in pairs:
        a, b = find(m), find(by_key.setdefault(k, m))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {m: find(m) for m, _ in pairs}


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"m{rng.randrange(120):03d}", f"k{rng.randrange(150):03d}") for _ in range(200)]
    got = components(spark.createDataFrame(pairs, "m STRING, k STRING"), "m", "k")
    assert {r["m"]: r["component"] for r in got.collect()} == union_find(pairs)


def test_components_with_a_hot_key_and_a_long_chain(spark):
    chain = [(f"c{i:04d}", f"l{j:04d}") for i in range(300) for j in (i, i + 1)]
    hot = [(f"h{i:04d}", "hot") for i in range(600)]
    single = [(f"s{i:04d}", f"s{i}") for i in range(300)]
    pairs = chain + hot + single
    got = components(spark.createDataFrame(pairs, "m STRING, k STRING"), "m", "k")
    assert {r["m"]: r["component"] for r in got.collect()} == union_find(pairs)


def test_redirects(spark):
    rows = [(f"r{i}", f"r{i + 1}") for i in range(37)] + [("r37", None), ("lost", "nowhere")]
    got = {r["n"]: r["resolved"] for r in resolve_chain(spark.createDataFrame(rows, "n STRING, t STRING"), "n", "t").collect()}
    assert got.pop("lost") is None and set(got.values()) == {"r37"} and len(got) == 38
    with pytest.raises(RedirectCycle):
        resolve_chain(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "n STRING, t STRING"), "n", "t")


def test_positions_with_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), F.xxhash64("id").alias("o"))
    got = positions(rows, ["g"], ["o"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["o"], r["position"]))
    assert len(got) == 3000
    for items in groups.values():
        assert [p for _, p in sorted(items)] == list(range(len(items)))


def loop_batches(sizes, limit, entries):
    out, number, total, members = [], 0, 0, 0
    for size in sizes:
        if members and (total + size > limit or members >= entries):
            number, total, members = number + 1, 0, 0
        out.append(number)
        total, members = total + size, members + 1
    return out


@pytest.mark.parametrize("seed, chunk, entries", [(1, 5, 2), (2, 7, 5), (3, 50, 24), (4, 24, 24)])
def test_batches_match_the_loop(spark, monkeypatch, seed, chunk, entries):
    monkeypatch.setattr(batching, "RUN", 3)  # so that chunks of an owner make several runs
    rng = random.Random(seed)
    sizes = {o: [rng.choice([0, 1, 10, 300, 999, 1500]) for _ in range(n)] for o, n in (("hot", 211), ("a", 24), ("b", 1), ("c", 53))}
    rows = [(o, i, s) for o, items in sizes.items() for i, s in enumerate(items)]
    got = greedy_batches(spark.createDataFrame(rows, "o STRING, i INT, s INT"), ["o"], ["i"], "s", 1000, entries, chunk).collect()
    assert len(got) == len(rows)
    for o, items in sizes.items():
        assert [r["batch_no"] for r in sorted((r for r in got if r["o"] == o), key=lambda r: r["i"])] == loop_batches(items, 1000, entries)


POST = "ip_slug STRING, obs_id STRING, source_id STRING, kind STRING, canonical_content_id STRING, content_hash STRING, text STRING, day INT, outbound_urls ARRAY<STRING>, media_hashes ARRAY<STRING>"


def posts(spark, rows):
    base = ("ip", None, None, "k", None, None, None, 1, [], [])
    full = []
    for number, row in enumerate(rows):
        item = dict(zip([c.split()[0] for c in POST.split(", ")], base))
        item.update(obs_id=f"o{number}", source_id=f"s{number}", content_hash=f"h{number}", text=f"text {number} unlike the others {number * 7919}")
        item.update(row)
        full.append(tuple(item.values()))
    return spark.createDataFrame(full, POST).withColumn("published_at", F.timestamp_seconds(F.col("day") * 86400)).drop("day")


def test_shared_link_never_merges_and_the_primary_is_the_earliest(spark):
    df = posts(spark, [
        {"text": "Same, text!", "day": 9}, {"text": "same text", "day": 2}, {"outbound_urls": ["https://e.com/a?utm_x=1"]}, {"outbound_urls": ["https://E.com/a/"]},
        {"content_hash": "hx"}, {"content_hash": "hx", "ip_slug": "other"}, {"canonical_content_id": "7", "kind": "x"}, {"canonical_content_id": "7", "kind": "y"}])
    got = {r["obs_id"]: r["primary_id"] for r in exact_groups(df).collect()}
    assert got == {"o0": "o1", "o1": "o1", "o2": "o2", "o3": "o3", "o4": "o4", "o5": "o5", "o6": "o6", "o7": "o6"}
    apart = {r["obs_id"]: r["primary_id"] for r in exact_groups(df, namespaced_canonical=True).collect()}
    assert apart["o7"] == "o7"
    assert {r["obs_id"]: r["member_no"] for r in ordered_members(exact_groups(df)).collect()}["o0"] == 1


def test_pair_verdicts(spark):
    df = posts(spark, [
        {"text": "abcdefgh", "media_hashes": ["m"]}, {"text": "abcdefxx", "media_hashes": ["m"]}, {"text": "zzzzzzzz", "media_hashes": ["m"]}, {"outbound_urls": ["https://e.com/a?utm_x=1"]},
        {"outbound_urls": ["https://E.com/a/"]}, {"content_hash": "hx"}, {"content_hash": "hx"}])
    pairs = spark.createDataFrame([("o0", "o1"), ("o0", "o2"), ("o3", "o4"), ("o5", "o6"), ("o0", "o3")], "left_id STRING, right_id STRING")
    got = {(r["left_id"], r["right_id"]): r["verdict"] for r in pair_verdicts(pairs, df).collect()}
    assert got == {("o0", "o1"): "same_material", ("o0", "o2"): "distinct", ("o3", "o4"): "same_material", ("o5", "o6"): "exact", ("o0", "o3"): "distinct"}
