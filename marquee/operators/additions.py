"""New entities for stored campaigns: selected, evidenced, not repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import ids
from marquee.functions.evidence import quote_matches
from marquee.operators.assembly import with_status


def select_activities(requested: DataFrame, extracted: DataFrame) -> DataFrame:
    """Requests (group_id, request_no, title, kind) with the one extracted activity they name.

    Anything but exactly one match, or two requests for one activity, is a problem of the request.
    """
    key = ["group_id", "title", "kind"]
    found = extracted.groupBy(*key).agg(F.min("activity_no").alias("activity_no"), F.count(F.lit(1)).alias("_n"))
    rows = requested.join(found, key, "left")
    uses = rows.groupBy(F.col("group_id").alias("_g"), F.col("activity_no").alias("_a")).agg(F.count(F.lit(1)).alias("_uses"))
    rows = rows.join(uses, (F.col("group_id") == F.col("_g")) & (F.col("activity_no") == F.col("_a")), "left").drop("_g", "_a")
    bad = F.col("_n").isNull() | (F.col("_n") != 1) | (F.col("_uses") > 1)
    return rows.withColumn("problem", F.when(bad, "new activity must identify one extracted activity")).drop("_n", "_uses")


def reindex_claims(claims: DataFrame, selected: DataFrame) -> DataFrame:
    """Claims of selected activities under their new position; other activity claims are left out."""
    number = F.regexp_extract("field_path", r"^activities\[(\d+)\]", 1)
    rows = claims.withColumn("activity_no", F.when(number != "", number.cast("int")))
    general = rows.where("activity_no is null").drop("activity_no")
    moved = rows.join(selected.where("problem is null").select("group_id", "activity_no", "request_no"), ["group_id", "activity_no"])
    tail = F.regexp_replace("field_path", r"^activities\[\d+\]", "")
    moved = moved.withColumn("field_path", F.concat(F.lit("activities["), F.col("request_no").cast("string"), F.lit("]"), tail))
    return general.unionByName(moved.drop("activity_no", "request_no"))


def unseen(incoming: DataFrame, stored: DataFrame, parent: str, key: str, signature: str = "signature") -> DataFrame:
    """Rows whose id and whose public content are both new under their parent."""
    fresh = incoming.join(stored.select(parent, key), [parent, key], "left_anti")
    return fresh.join(stored.select(parent, signature), [parent, signature], "left_anti")


def new_children(additions: DataFrame, activities: DataFrame, posts: DataFrame, collection: str, signs: bool = False) -> DataFrame:
    """Additions (activity_id, obs_id, quote, payload) with their id and, where they cannot stand, a problem.

    ``payload`` is the canonical JSON of the new action or venue. ``signs``: see :func:`quote_matches`.
    """
    known = activities.select("activity_id", "campaign_id").dropDuplicates(["activity_id"])
    cited = posts.select("obs_id", "source_id", F.col("text").alias("_text"))
    rows = additions.join(known, "activity_id", "left").join(cited, "obs_id", "left").withColumn("_ok", quote_matches("quote", "_text", signs))
    identity = F.concat_ws(":", "activity_id", F.lit(collection), "obs_id", "payload")
    bad = F.col("campaign_id").isNull() | ~F.coalesce("_ok", F.lit(False))
    entity = F.concat(F.lit(collection + "-"), ids.digest(identity, 16))
    return (rows.withColumn("entity_id", entity).withColumn("problem", F.when(bad, "invalid addition target or evidence"))
            .withColumn("field_path", F.concat_ws(".", F.lit("activities"), "activity_id", F.lit(collection), "entity_id"))
            .drop("_text", "_ok"))


def judge_exclusions(exclusions: DataFrame, activities: DataFrame, posts: DataFrame, signs: bool = False) -> DataFrame:
    """Exclusions (campaign_id, activity_id, obs_id, quote, reason) with a problem where unproven.

    ``activities`` are those stored before the run: only they can be excluded. ``signs``: see :func:`quote_matches`.
    """
    known = activities.select("campaign_id", "activity_id").distinct().withColumn("_known", F.lit(True))
    cited = posts.select("obs_id", F.col("text").alias("_text"))
    rows = exclusions.join(known, ["campaign_id", "activity_id"], "left").join(cited, "obs_id", "left").withColumn("_ok", quote_matches("quote", "_text", signs))
    problem = (F.when(~F.coalesce("_ok", F.lit(False)), "invalid scope exclusion evidence")
               .when(F.col("_known").isNull(), "scope exclusion must refer to legacy activity"))
    return rows.withColumn("problem", problem).drop("_text", "_ok", "_known")


def exclude(activities: DataFrame, judged: DataFrame) -> DataFrame:
    """Move proven exclusions to the excluded set; their history stays."""
    hits = judged.where("problem is null").select("campaign_id", "activity_id").distinct().withColumn("_x", F.lit(True))
    return activities.join(hits, ["campaign_id", "activity_id"], "left").withColumn(
        "excluded", F.coalesce("_x", "excluded")).drop("_x")


def scope_reviews(judged: DataFrame) -> DataFrame:
    """What is kept of every proven exclusion: (campaign_id, activity_id, obs_id, quote, reason)."""
    return judged.where("problem is null").select("campaign_id", "activity_id", "obs_id", "quote", "reason").distinct()


def status_after_exclusions(campaigns: DataFrame, activities: DataFrame, judged: DataFrame) -> DataFrame:
    """Campaigns that lost an activity get the status of the remaining ones; a cancelled campaign and all others keep theirs."""
    touched = judged.where("problem is null").select("campaign_id").distinct()
    left = exclude(activities.join(touched, "campaign_id", "left_semi"), judged)
    rolled = with_status(campaigns.join(touched, "campaign_id", "left_semi"), left)
    return campaigns.join(touched, "campaign_id", "left_anti").unionByName(rolled.select(campaigns.columns))


def normalise_resolutions(resolutions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Resolutions (group_id, existing_id, decision, title, partner) made consistent with the store.

    An existing campaign needs the decision ``update`` and keeps its stored title and partner; a new
    one may not carry a decision.
    """
    known = campaigns.select(F.col("campaign_id").alias("existing_id"), F.col("title").alias("_t"), F.col("partner").alias("_p"))
    rows = resolutions.join(known, "existing_id", "left")
    old = F.col("existing_id").isNotNull()
    problem = (F.when(old & ~F.coalesce(F.col("decision") == "update", F.lit(False)), "existing campaign requires reconciliation")
               .when(~old & F.col("decision").isNotNull(), "new campaign cannot update existing entities"))
    return (rows.withColumn("problem", problem).withColumn("title", F.when(old, F.col("_t")).otherwise(F.col("title")))
            .withColumn("partner", F.when(old, F.col("_p")).otherwise(F.col("partner"))).drop("_t", "_p"))


def activity_claims_only(claims: DataFrame) -> DataFrame:
    """Updates of a stored campaign keep only claims about activities."""
    return claims.where(F.col("field_path").startswith("activities["))


def keep_as_new(drafts: DataFrame, matched: DataFrame) -> DataFrame:
    """A separate edition: container fields come from the stored campaign, activities are not matched.

    ``matched`` is (draft_id, campaign_id, title, partner, announced_at).
    """
    own = [c for c in drafts.columns if c not in ("campaign_id", "title", "partner", "announced_at")]
    return drafts.select(*own).join(matched, "draft_id")


