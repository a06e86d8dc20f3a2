"""Queued reviews against the loop that merges one after the other."""

import datetime
import random

from pyspark.sql import functions as F

from marquee.functions.times import instant
from marquee.operators import reviews
from marquee.operators.reviews import merge_reviews, settle_reviews
from reviews_loop import loop_reviews

AT = datetime.datetime(2024, 1, 1)
CAMPAIGN = "campaign_id STRING, ip_slug STRING, partner STRING, title STRING, status STRING, announced_at TIMESTAMP, first_seen_at TIMESTAMP, updated_at TIMESTAMP, revision INT, redirected_to STRING"
SOURCE = "source_id STRING, content_hash STRING, summary STRING"
NOW = "2024-03-01 00:00:00"


def tables(seed, n_campaigns, n_reviews, n_sources):
    """Campaigns and reviews of two names with few partners and sources, so that most drafts need earlier ones."""
    rng = random.Random(seed)
    day = lambda: AT + datetime.timedelta(days=rng.randrange(40))
    row = lambda i: (rng.choice(["a", "b"]), rng.choice([None, "", "P", "p ", "Q", "R"]), rng.choice(["t", "u"]), rng.choice([None, "announced"]), rng.choice([None, day()]), day(), day(), 1)
    campaigns = [(f"c{i}", *row(i), "c0" if rng.random() < 0.1 and i else None) for i in range(n_campaigns)]
    reviews = [(f"r{i:04}", rng.choice([None, f"c{rng.randrange(2 * n_campaigns + 1)}", f"n{rng.randrange(n_reviews)}"]), *row(i), None, None) for i in range(n_reviews)]
    cited = lambda k: {(f"s{rng.randrange(n_sources)}", f"h{rng.randrange(9)}", rng.choice(["", "x"])) for _ in range(k)}
    of_campaigns = [(c[0], *s) for c in campaigns for s in {x[0]: x for x in cited(rng.randrange(3))}.values()]
    of_reviews = [(r[0], *s) for r in reviews for s in {x[0]: x for x in cited(rng.randrange(3))}.values()]
    return campaigns, of_campaigns, reviews, of_reviews


def frames(spark, campaigns, of_campaigns, reviews, of_reviews):
    return (spark.createDataFrame(reviews, f"review_id STRING, {CAMPAIGN}, resolved_campaign_id STRING"), spark.createDataFrame(of_reviews, f"review_id STRING, {SOURCE}"),
            spark.createDataFrame(campaigns, CAMPAIGN), spark.createDataFrame(of_campaigns, f"campaign_id STRING, {SOURCE}"))


def test_reviews_equal_the_loop(spark):
    for seed, sizes in ((1, (6, 60, 25)), (2, (1, 80, 120))):
        made = tables(seed, *sizes)
        went, kept, sources = loop_reviews(*made, datetime.datetime.fromisoformat(NOW))
        stored, held, closed, _ = merge_reviews(*frames(spark, *made), instant(NOW))
        assert {r["review_id"]: r["resolved_campaign_id"] for r in closed.collect()} == went
        assert {r["campaign_id"]: (r["partner"], r["title"], r["status"], r["announced_at"]) for r in stored.collect()} == kept
        assert {(r["campaign_id"], r["source_id"]) for r in held.collect()} == sources


def test_a_chain_of_reviews(spark):
    """Every review shares a source with the one before it only: all go to the campaign that the first one opens."""
    campaigns = [("c", "other", None, "t", None, None, AT, AT, 1, None)]
    reviews = [(f"r{i}", f"n{i}", "a", None, "t", None, None, AT, AT, 1, None, None) for i in range(6)]
    cited = [(f"r{i}", f"s{i + k}", "h", "") for i in range(6) for k in (0, 1)]
    out = settle_reviews(*frames(spark, campaigns, [("c", "s0", "h", "")], reviews, cited)).collect()
    assert {(r["review_id"], r["campaign_id"], r["opened"]) for r in out} == {(f"r{i}", "n0", i == 0) for i in range(6)}


def test_a_partner_closes_a_campaign_to_others(spark):
    """The first draft with a partner gives it to the campaign; a later one with another partner opens its own, one without joins the eldest."""
    campaigns = [("c", "a", None, "t", None, None, AT, AT, 1, None)]
    row = lambda i, partner: (f"r{i}", f"n{i}", "a", partner, "t", None, None, AT + datetime.timedelta(days=i + 1), AT, 1, None, None)
    reviews = [row(0, "P"), row(1, "Q"), row(2, None), row(3, "q")]
    cited = [(f"r{i}", "s", "h", "") for i in range(3)]
    out = settle_reviews(*frames(spark, campaigns, [("c", "s", "h", "")], reviews, cited)).collect()
    assert {r["review_id"]: (r["campaign_id"], r["reason"]) for r in out} == {
        "r0": ("c", "same source identity"), "r1": ("n1", None), "r2": ("c", "same source identity"), "r3": ("n1", "same IP and partner")}


def test_no_reviews(spark):
    made = tables(4, 3, 1, 4)
    reviews, cited, campaigns, sources = frames(spark, *made)
    stored, held, closed, conflicts = merge_reviews(reviews.where("false"), cited.where("false"), campaigns, sources, F.lit(NOW).cast("timestamp"))
    assert stored.count() == 3 and held.count() == sources.count() and closed.isEmpty() and conflicts.isEmpty()


def test_guesses_do_not_multiply(spark, monkeypatch):
    """Drafts of different partners want one id: no table of a guess may grow with the square of their number."""
    rows, kept = [], reviews.materialize

    def counted(frame):
        out = kept(frame)
        rows.append(out.count())
        return out

    monkeypatch.setattr(reviews, "materialize", counted)
    n, campaigns = 150, [("c", "other", None, "t", None, None, AT, AT, 1, None)]
    drafts = [(f"r{i:03}", "n", "a", f"p{i}", "t", None, None, AT, AT, 1, None, None) for i in range(n)]
    cited = [(f"r{i:03}", f"s{i}", "h", "") for i in range(n)]
    out = settle_reviews(*frames(spark, campaigns, [("c", "s", "h", "")], drafts, cited)).collect()
    assert len({r["campaign_id"] for r in out}) == n and {r["review_id"] for r in out if r["campaign_id"] == "n"} == {"r000"}
    assert max(rows) < 100 * n
