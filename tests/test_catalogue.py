"""Merging and facts against run-by-run loops."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.functions.evidence import aligned
from marquee.functions.times import instant
from marquee.operators import additions
from marquee.operators import facts as facts_module
from marquee.operators.consolidation import consolidate_activities, partner_targets
from marquee.operators.facts import judge_updates, latest_facts
from marquee.operators.merging import merge_scalars

FIELDS = {"rules": False, "partner": False, "title": True}


def loop_merge(stored, newer, drafts):
    """One draft after the other, as the rule is written."""
    current, conflicts, fresh = dict(stored), set(), newer
    for name, fields in drafts:
        before = dict(current)
        for field, value in fields.items():
            if value is None or before.get(field) == value or (FIELDS[field] and not fresh):
                continue
            if before.get(field) is None or fresh:
                current[field] = value
            else:
                conflicts.add((field, name, value))
        if current != before:
            fresh = False
    return current, conflicts


def test_scalar_merge_equals_the_loop(spark):
    rng = random.Random(5)
    stored, drafts, runs, want, clashes = [], [], [], {}, set()
    pick = lambda: rng.choice([None, "a", "b", "c"])
    for n in range(150):
        key, newer = f"c{n}", n % 3 != 0
        have = {f: v for f in FIELDS if (v := pick()) is not None}
        offers = [(f"d{n}-{i}", {f: pick() for f in FIELDS}) for i in range(rng.randrange(5))]
        stored += [(key, key, f, v) for f, v in have.items()]
        drafts += [(key, key, f, v, FIELDS[f], i, name) for i, (name, fields) in enumerate(offers) for f, v in fields.items() if v is not None]
        runs.append((key, newer))
        final, bad = loop_merge(have, newer, offers)
        want.update({(key, f): v for f, v in final.items()})
        clashes |= {(key, *b) for b in bad}
    s = spark.createDataFrame(stored, "campaign_id STRING, entity_id STRING, field STRING, value STRING")
    d = spark.createDataFrame(drafts, "campaign_id STRING, entity_id STRING, field STRING, value STRING, newer_only BOOLEAN, i INT, draft_id STRING").withColumn("published_at", F.timestamp_seconds("i")).drop("i")
    r = spark.createDataFrame(runs, "campaign_id STRING, newer BOOLEAN").select("campaign_id", F.when(F.col("newer"), instant("2000-01-01 00:00:00")).otherwise(instant("2040-01-01 00:00:00")).alias("updated_at"))
    facts, changes, conflicts = merge_scalars(s, d, r, instant("2020-01-01 00:00:00"))
    assert {(x["campaign_id"], x["field"]): x["value"] for x in facts.collect() if x["value"] is not None} == want
    # a draft before the first change agrees with what is stored, so only later ones can clash
    assert {(x["campaign_id"], x["field"], x["draft_id"], x["incoming_value"]) for x in conflicts.collect()} == clashes
    assert changes.where("value <=> old_value").count() == 0


def judged(spark, updates, facts, posts=None):
    u = spark.createDataFrame(updates, "group_id STRING, campaign_id STRING, field_path STRING, value STRING, obs_id STRING, quote STRING")
    f = spark.createDataFrame(facts, "campaign_id STRING, field_path STRING, value STRING, day INT").select("campaign_id", "field_path", "value", F.timestamp_seconds(F.col("day") * 86400).alias("published_at"))
    p = spark.createDataFrame(posts or [(f"p{i}", i) for i in range(1, 9)], "obs_id STRING, day INT").select("obs_id", F.col("obs_id").alias("source_id"), F.lit("h").alias("content_hash"), F.timestamp_seconds(F.col("day") * 86400).alias("published_at"), F.lit("新规则：限购两件").alias("text"))
    e = spark.createDataFrame([("c", "a1"), ("c", "x1")], "campaign_id STRING, entity_id STRING")
    s = spark.createDataFrame([("c", 5)], "campaign_id STRING, day INT").select("campaign_id", F.timestamp_seconds(F.col("day") * 86400).alias("published_at"))
    return {(r["group_id"], r["field_path"], r["obs_id"]): (r["outcome"], r["problem"], r["group_ok"]) for r in judge_updates(u, f, p, e, s).collect()}


def test_updates_follow_publication_time(spark):
    q = "限购两件"
    got = judged(spark, [
        ("g1", "c", "activities.a1.rules", "new", "p6", q), ("g2", "c", "activities.a1.title", "t", "p3", q), ("g3", "c", "activities.a1.end_date", "2026-01-01", "p4", q),
        ("g4", "c", "activities.a1.actions.x1.scope", "s", "p2", q), ("g5", "c", "partner", "same", "p1", q), ("g6", "c", "title", "late", "p4", q)],
        [("c", "activities.a1.rules", "old", 5), ("c", "activities.a1.title", "kept", 4), ("c", "activities.a1.end_date", "2025-01-01", 4), ("c", "partner", "same", 9), ("c", "title", "old", None)])
    assert {k[0]: (v[0], v[1]) for k, v in got.items()} == {
        "g1": ("applied", None), "g2": ("older", None), "g3": ("rejected", "same-time conflicting evidence requires review"), "g4": ("applied", None),
        "g5": ("same", None), "g6": ("rejected", "older conflicting fact without provenance")}


def test_one_bad_update_rejects_its_group(spark):
    q = "限购两件"
    got = judged(spark, [
        ("g", "c", "activities.a1.rules", "x", "p6", q), ("g", "c", "activities.a1.ghost", "x", "p6", q), ("h", "c", "activities.zz.rules", "x", "p6", q), ("i", "c", "status", "ongoing", "p6", q),
        ("j", "c", "rules.x", "x", "p6", q), ("k", "c", "title", None, "p6", q), ("l", "c", "title", "x", "p6", "没有这句话"), ("m", "c", "title", "x", "p6", q), ("m", "c", "title", "y", "p7", q)], [("c", "none", "x", 1)])
    problems = {}
    for (group, *_), (_, problem, ok) in got.items():
        assert ok is False
        problems.setdefault(group, set()).add(problem)
    assert problems == {"g": {None, "field is not editable"}, "h": {"fact target must identify one existing entity"}, "i": {"only explicit official status is editable"},
                        "j": {"invalid fact target"}, "k": {"null is not a deletion instruction"}, "l": {"fact must cite supplied original text"}, "m": {"duplicate field operation"}}


def test_nested_targets_must_name_their_activity(spark):
    q, at = "限购两件", F.timestamp_seconds(F.lit(86400))
    u = spark.createDataFrame([("g", "c", "activities.a1.actions.x1.title", "t", "p", q), ("h", "c", "activities.a2.actions.x1.title", "t", "p", q), ("i", "c", "activities.a2.rules", "t", "p", q)],
                              "group_id STRING, campaign_id STRING, field_path STRING, value STRING, obs_id STRING, quote STRING")
    p = spark.createDataFrame([("p", "s", "h", "每人限购两件")], "obs_id STRING, source_id STRING, content_hash STRING, text STRING").withColumn("published_at", at)
    f = spark.createDataFrame([("c", "none", "x")], "campaign_id STRING, field_path STRING, value STRING").withColumn("published_at", at)
    e = spark.createDataFrame([("c", "a1", None), ("c", "a2", None), ("c", "x1", "a1")], "campaign_id STRING, entity_id STRING, parent_id STRING")
    got = {r["group_id"]: r["problem"] for r in judge_updates(u, f, p, e).collect()}
    assert got == {"g": None, "h": "fact target must identify one existing entity", "i": None}


def test_groups_of_a_run_settle_on_one_value(spark):
    q = "限购两件"
    got = judged(spark, [
        ("a", "c", "title", "t3", "p3", q), ("b", "c", "title", "t6", "p6", q), ("d", "c", "title", "t2", "p2", q), ("e", "c", "activities.a1.rules", "r", "p4", q), ("f", "c", "activities.a1.rules", "s", "p4", q),
        ("f", "c", "partner", "x", "p4", q), ("g", "c", "activities.a1.rules", "u", "p2", q), ("h", "c", "activities.a1.end_date", "2026-01-01", "p6", q), ("i", "c", "activities.a1.actions.x1.end_at", "2026-01-03T00:00:00+08:00", "p6", q)],
        [("c", "activities.a1.start_date", "2026-02-01", 1), ("c", "activities.a1.actions.x1.at", "2026-01-02T00:00:00+08:00", 1)])
    short = {(k[0], k[1].rsplit(".", 1)[-1]): (v[0], v[2]) for k, v in got.items()}
    assert short == {("d", "title"): ("applied", True), ("g", "rules"): ("applied", True), ("a", "title"): ("applied", True), ("e", "rules"): ("applied", True), ("f", "rules"): ("rejected", False),
                     ("f", "partner"): ("applied", False), ("b", "title"): ("applied", True), ("h", "end_date"): ("rejected", False), ("i", "end_at"): ("applied", True)}


def loop_over_groups(updates, stored, day_of, newest):
    """The rule, group after group: {(group, path): (outcome, problem, group_ok)} and the facts that are left."""
    facts, out = dict(stored), {}
    groups = {}
    for g, path, value, post in updates:
        groups.setdefault(g, []).append((path, value, post))
    for g in sorted(groups, key=lambda g: (max(day_of[p] for *_, p in groups[g]), g)):
        trial, rows, cited = dict(facts), {}, []
        for path, value, post in groups[g]:
            old, at = facts.get(path, (None, None))
            if old is not None and at is None and day_of[post] < newest:
                rows[path] = ("rejected", "older conflicting fact without provenance")
            elif value == old:
                rows[path] = ("same", None)
            elif old is not None and at is not None and day_of[post] == at:
                rows[path] = ("rejected", "same-time conflicting evidence requires review")
            elif old is not None and at is not None and day_of[post] < at:
                rows[path] = ("older", None)
            else:
                rows[path], trial[path] = ("applied", None), (value, day_of[post])
                cited.append(day_of[post])
        for path, (outcome, _) in list(rows.items()):
            entity, _, field = path.rpartition(".")
            start, end = (trial.get(f"{entity}.{f}", (None,))[0] for f in ("start_date", "end_date"))
            if outcome == "applied" and field in ("start_date", "end_date") and start and end and end < start:
                rows[path] = ("rejected", "end date precedes start date")
        ok = all(problem is None for _, problem in rows.values())
        if ok:
            facts, newest = trial, max([newest, *cited])
        out |= {(g, path): (*row, ok) for path, row in rows.items()}
    return out, facts


@pytest.mark.parametrize("seed, slices", [(1, 4096), (2, 3), (3, 1)])
def test_updates_equal_a_loop_over_groups(spark, monkeypatch, seed, slices):
    monkeypatch.setattr(facts_module, "SLICE", slices)
    rng, q = random.Random(seed), "限购两件"
    day_of = {f"p{i}": rng.randrange(2, 12) for i in range(1, 13)}
    paths = [f"activities.a{k}.{f}" for k in (1, 2) for f in ("start_date", "end_date", "rules")] + ["title"]
    updates, stored = [], {}
    for c in range(12):
        for g in range(rng.randrange(2, 14)):
            for path in rng.sample(paths, rng.randrange(1, 4)):
                updates.append((f"c{c}", f"g{c}-{g:02d}", path, f"2024-05-{rng.randrange(1, 7):02d}", rng.choice(list(day_of))))
        stored[f"c{c}"] = {p: (f"2024-05-{rng.randrange(1, 7):02d}" if not p.endswith("end_date") else "2024-05-06", rng.choice([None, 3, 4, 7])) for p in paths if rng.random() < 0.5}
    want, left = {}, {}
    for c, known in stored.items():
        out, after = loop_over_groups([u[1:] for u in updates if u[0] == c], known, day_of, 5)
        want |= out
        left |= {(c, p): v[0] for p, v in after.items()}
    day = lambda c: F.timestamp_seconds(F.col(c) * 86400)
    u = spark.createDataFrame([(g, c, p, v, o, q) for c, g, p, v, o in updates], "group_id STRING, campaign_id STRING, field_path STRING, value STRING, obs_id STRING, quote STRING")
    f = spark.createDataFrame([(c, p, v, d) for c, known in stored.items() for p, (v, d) in known.items()], "campaign_id STRING, field_path STRING, value STRING, day INT").select(
        "campaign_id", "field_path", "value", day("day").alias("published_at"))
    p = spark.createDataFrame(list(day_of.items()), "obs_id STRING, day INT").select("obs_id", F.col("obs_id").alias("source_id"), F.lit("h").alias("content_hash"), day("day").alias("published_at"), F.lit("新规则：限购两件").alias("text"))
    e = spark.createDataFrame([(f"c{c}", a) for c in range(12) for a in ("a1", "a2")], "campaign_id STRING, entity_id STRING")
    s = spark.createDataFrame([(f"c{c}", "first", 5) for c in range(12)], "campaign_id STRING, source_id STRING, day INT").select("campaign_id", "source_id", day("day").alias("published_at"))
    done = judge_updates(u, f, p, e, s).cache()
    assert {(r["group_id"], r["field_path"]): (r["outcome"], r["problem"], r["group_ok"]) for r in done.collect()} == want
    assert {(r["campaign_id"], r["field_path"]): r["value"] for r in facts_module.apply_updates(f, done).collect()} == left
    applied = {(r["campaign_id"], r["source_id"]) for r in done.collect() if r["group_ok"] and r["outcome"] == "applied"}
    assert {(r["campaign_id"], r["source_id"]) for r in facts_module.cited_sources(s, done).collect()} == applied | {(f"c{c}", "first") for c in range(12)}
    assert {v[1] for v in want.values()} >= {"end date precedes start date", "same-time conflicting evidence requires review", None}


def test_two_groups_that_only_together_turn_an_interval(spark):
    q = "限购两件"
    got = judged(spark, [("g1", "c", "activities.a1.start_date", "2024-05-10", "p6", q), ("g2", "c", "activities.a1.end_date", "2024-05-01", "p7", q)], [("c", "none", "x", 1)])
    assert {k[0]: v for k, v in got.items()} == {"g1": ("applied", None, True), "g2": ("rejected", "end date precedes start date", False)}


def test_groups_over_several_campaigns_and_turns_of_what_changed(spark, monkeypatch):
    """a fails, so b of two campaigns stands, so c fails; a campaign without such a chain is judged once. Slices are counted in a campaign."""
    q, turns = "限购两件", []
    judge = facts_module._judge_turn
    monkeypatch.setattr(facts_module, "SLICE", 3)
    monkeypatch.setattr(facts_module, "_judge_turn", lambda rows, sliced: turns.append((sliced, {r.campaign_id for r in rows.select("campaign_id").collect()})) or judge(rows, sliced))
    got = judged(spark, [("a", "c", "title", "t", "p4", q), ("a", "c", "activities.a1.start_date", "2026-03-01", "p4", q), ("b", "c", "title", "u", "p4", q), ("b", "d", "partner", "x", "p4", q), ("c", "d", "partner", "y", "p4", q),
                         ("k", "e", "title", "t", "p2", q), ("l", "e", "title", "u", "p3", q)], [("c", "activities.a1.end_date", "2026-02-01", 1)])
    assert {(k[0], k[1]): v[::2] for k, v in got.items()} == {
        ("a", "title"): ("applied", False), ("a", "activities.a1.start_date"): ("rejected", False), ("b", "title"): ("applied", True), ("b", "partner"): ("applied", True), ("c", "partner"): ("rejected", False),
        ("k", "title"): ("applied", True), ("l", "title"): ("applied", True)}
    assert [sliced for sliced, _ in turns] == [False] * len(turns) and turns[0][1] == {"c", "d", "e"} and all(held == {"c", "d"} for _, held in turns[1:]) and len(turns) > 2


def test_latest_facts_mark_ties(spark):
    rows = spark.createDataFrame([("c", "f", "a", 1), ("c", "f", "b", 2), ("c", "g", "a", 3), ("c", "g", "b", 3)], "campaign_id STRING, field_path STRING, value STRING, published_at INT")
    got = {r["field_path"]: (r["value"], r["tied"]) for r in latest_facts(rows).collect()}
    assert got == {"f": ("b", False), "g": ("a", True)}


def test_consolidation_rekeys_only_different_activities(spark):
    c = spark.createDataFrame([("c1", "ip", "Brand A", 1), ("c2", "ip", "brand-a", 2), ("c3", "ip", None, 3)], "campaign_id STRING, ip_slug STRING, partner STRING, day INT").select(
        "*", F.timestamp_seconds(F.col("day") * 86400).alias("first_seen_at"), F.lit(None).cast("string").alias("redirected_to"))
    a = spark.createDataFrame([("c1", "a", "x"), ("c2", "a", "x"), ("c2", "b", "y"), ("c1", "b", "z")], "campaign_id STRING, activity_id STRING, signature STRING")
    moved, redirects = consolidate_activities(a, partner_targets(c))
    rows = moved.collect()
    assert len(rows) == 3 and {r["campaign_id"] for r in rows} == {"c1"}
    only = redirects.collect()
    assert [(r["campaign_id"], r["old_id"]) for r in only] == [("c2", "b")] and only[0]["new_id"].startswith("activity-")


@pytest.mark.parametrize("newest", [8, 1])
def test_quotes_by_anchors_equal_all_pairs(spark, monkeypatch, newest):
    """Quotes that are cut, edited, negated or short, in groups of which one holds most texts."""
    monkeypatch.setattr(facts_module, "NEWEST", newest)
    rng = random.Random(newest)
    parts = ["限购两件，", "九月八日开售。", "Doors open at nine", "「每人」一份", " and more words here", "不", "全新周边_上架", "！", "价格 128 元", "same boilerplate line everywhere "]
    members, claims = [], []
    for i in range(160):
        g = "hot" if rng.random() < 0.6 else f"g{i % 5}"
        members.append((g, f"o{i}", f"s{i}", f"h{rng.randrange(120)}", i % 50, None if i == 3 else "".join(rng.choice(parts) for _ in range(8))))
    texts = {}
    members = [(g, o, s, h, d, texts.setdefault((g, h), t)) for g, o, s, h, d, t in members]
    for i in range(220):
        g, *_, text = rng.choice(members)
        text = text or "nothing"
        a = rng.randrange(max(1, len(text) - 3))
        quote = text[a:a + rng.choice([2, 6, 12, 30])]
        if rng.random() < 0.4:
            quote = quote.replace("，", rng.choice(["", "!", "，，"])).replace("九", rng.choice(["九", "十"]))
        claims.append((g, f"c{i}", rng.choice([quote, quote, "，。", None]) if i % 9 == 0 else quote))
    m = spark.createDataFrame(members, "group_id STRING, obs_id STRING, source_id STRING, content_hash STRING, day INT, text STRING").withColumn("published_at", F.timestamp_seconds(F.col("day") * 86400)).drop("day")
    c = spark.createDataFrame(claims, "group_id STRING, claim_id STRING, quote STRING")
    best = {}
    for g, o, s, h, d, t in members:
        best[g, h] = max(best.get((g, h), (-1,)), (d, o, t))
    want = {k: max([(d, o) for (gg, _), (d, o, t) in best.items() if gg == g and aligned(q, t)], default=(None, None))[1] for g, k, q in claims}
    assert {r["claim_id"]: r["obs_id"] for r in facts_module.claim_provenance(c, m).collect()} == want
    assert sum(v is not None for v in want.values()) > 60 and None in want.values()


def test_quotes_of_signs_where_they_are_asked_for(spark):
    """A lone sign or an empty quote stands in its text only if the caller says so; letters keep their rule."""
    c = spark.createDataFrame([("g", "dot", "."), ("g", "empty", ""), ("g", "other", "!"), ("g", "word", "B"), ("g", "none", None)], "group_id STRING, claim_id STRING, quote STRING")
    m = spark.createDataFrame([("g", "o1", "s", "h", "A."), ("g", "o2", "s", "h", "A.")], "group_id STRING, obs_id STRING, source_id STRING, content_hash STRING, text STRING").withColumn("published_at", F.timestamp_seconds(F.lit(0)))
    found = lambda **k: {r["claim_id"]: r["obs_id"] for r in facts_module.claim_provenance(c, m, **k).collect()}
    assert found(signs=True) == {"dot": "o2", "empty": "o2", "other": None, "word": None, "none": None}
    assert set(found().values()) == {None}


def test_exclusions_by_a_lone_sign(spark):
    asked = spark.createDataFrame([("c", "a1", "o", "."), ("c", "a2", "o", "!")], "campaign_id STRING, activity_id STRING, obs_id STRING, quote STRING").withColumn("reason", F.lit("r"))
    posts = spark.createDataFrame([("o", "A.")], "obs_id STRING, text STRING")
    judged = lambda **k: {r["activity_id"]: r["problem"] for r in additions.judge_exclusions(asked, asked, posts, **k).collect()}
    bad = "invalid scope exclusion evidence"
    assert judged(signs=True) == {"a1": None, "a2": bad} and judged() == {"a1": bad, "a2": bad}
