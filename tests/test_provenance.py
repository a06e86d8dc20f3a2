"""The texts of a group are fetched once for all of its quotes."""

from marquee.operators import facts


def test_texts_are_fetched_once(spark):
    long = "The quick brown fox jumps over the lazy dog number "
    posts = [("g", f"o{i}", "s", f"h{i % 6}", None, long + str(i % 6)) for i in range(12)] + [("k", "p", "s", "h0", None, long + "0"), ("k", "r", "s", "h9", None, "A. B")]
    members = spark.createDataFrame(posts, "group_id STRING, obs_id STRING, source_id STRING, content_hash STRING, published_at TIMESTAMP, text STRING")
    asked = [("g", "c1", long + "3"), ("g", "c2", long + "9"), ("k", "c3", "A. B"), ("k", "c4", long + "3"), ("k", "c5", "lazy dog number 0"), ("g", "c6", "A. B"), (None, "c7", long + "3"), ("g", "c8", None)]
    out = facts.claim_provenance(spark.createDataFrame(asked, "group_id STRING, claim_id STRING, quote STRING"), members)
    plan = out._jdf.queryExecution().executedPlan().toString()
    want = {"c1": "o9", "c2": None, "c3": "r", "c4": None, "c5": "p", "c6": None, "c7": None, "c8": None}
    assert {r.claim_id: r.obs_id for r in out.collect()} == want
    assert "text#" not in plan and "ArrowEvalPython" not in plan and plan.count("Join") <= 2
