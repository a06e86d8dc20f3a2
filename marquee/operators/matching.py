"""Which stored row does a draft belong to? Lookups against one row per key, never pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import fold


def _elder() -> Column:
    return F.min(F.struct("first_seen_at", "campaign_id")).alias("elder")


def match_campaigns(drafts: DataFrame, draft_sources: DataFrame, campaigns: DataFrame, campaign_sources: DataFrame) -> DataFrame:
    """(draft_id, campaign_id, reason) for drafts that belong to a stored campaign.

    Same name is required, and two known partners must agree. Then the same id, a shared source or
    the same partner match; the campaign seen first wins. Each rule looks up the eldest campaign of
    its key, so a partner or source with very many campaigns still costs one row per draft.
    """
    known = campaigns.where("redirected_to is null").select("ip_slug", "campaign_id", "first_seen_at", fold("partner").alias("p"))
    asked = drafts.select("draft_id", "ip_slug", F.col("campaign_id").alias("wanted"), fold("partner").alias("dp"))
    same_id = (asked.join(known.withColumnRenamed("campaign_id", "wanted"), ["ip_slug", "wanted"])
               .where("p = '' or dp = '' or p = dp")
               .select("draft_id", F.struct("first_seen_at", F.col("wanted").alias("campaign_id")).alias("elder")))
    by_partner = known.where("p <> ''").groupBy("ip_slug", F.col("p").alias("dp")).agg(_elder())
    same_partner = asked.join(by_partner, ["ip_slug", "dp"]).select("draft_id", "elder")
    held = campaign_sources.select("campaign_id", "source_id").distinct().join(known, "campaign_id")
    per_partner = held.groupBy("ip_slug", "source_id", "p").agg(_elder())
    any_partner = per_partner.groupBy("ip_slug", "source_id").agg(F.min("elder").alias("elder"))
    cited = draft_sources.select("draft_id", "source_id").distinct().join(asked, "draft_id")
    unnamed = cited.where("dp = ''").join(any_partner, ["ip_slug", "source_id"]).select("draft_id", "elder")
    wishes = cited.where("dp <> ''").select("draft_id", "ip_slug", "source_id", F.explode(F.array(F.lit(""), "dp")).alias("p"))
    named = wishes.join(per_partner, ["ip_slug", "source_id", "p"]).select("draft_id", "elder")
    sources = unnamed.unionByName(named)
    tagged = reduce(DataFrame.unionByName, [
        same_id.withColumn("rule", F.lit(1)), sources.withColumn("rule", F.lit(2)), same_partner.withColumn("rule", F.lit(3))])
    best = tagged.groupBy("draft_id").agg(F.min(F.struct("elder", "rule")).alias("b"))
    reason = F.element_at(F.array(F.lit("same campaign id"), F.lit("same source identity"), F.lit("same IP and partner")), F.col("b.rule"))
    return best.select("draft_id", F.col("b.elder.campaign_id").alias("campaign_id"), reason.alias("reason"))


def route_partner(routes: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Routes (route_id, ip_slug, campaign_id, partner) with the stored campaign they mean.

    A reference to another name's campaign is an error; without one, the first campaign of the same
    name and partner is taken.
    """
    known = campaigns.where("redirected_to is null").select(
        F.col("campaign_id").alias("k"), F.col("ip_slug").alias("k_ip"), fold("partner").alias("kp"))
    by_partner = known.where("kp <> ''").groupBy(F.col("k_ip").alias("ip_slug"), F.col("kp").alias("p")).agg(F.min("k").alias("same_partner"))
    rows = (routes.withColumn("p", fold("partner"))
            .join(known.select("k", "k_ip"), F.col("campaign_id") == F.col("k"), "left")
            .join(by_partner, ["ip_slug", "p"], "left"))
    bad = F.col("campaign_id").isNotNull() & ~F.col("k_ip").eqNullSafe(F.col("ip_slug"))
    return rows.select("route_id", "ip_slug", "partner",
                       F.when(F.col("campaign_id").isNotNull(), F.when(~bad, F.col("campaign_id"))).otherwise(F.col("same_partner")).alias("existing_id"),
                       F.when(bad, "invalid campaign reference").alias("problem"))


def _only(asked: DataFrame, stored: DataFrame, key: str, found: str) -> DataFrame:
    """Drafts whose lookups lead to exactly one stored id: its smallest and largest hit agree."""
    ends = stored.groupBy("lookup").agg(F.min(found).alias("lo"), F.max(found).alias("hi"))
    hits = asked.join(ends, "lookup").groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return hits.where("lo = hi").select(key, F.col("lo").alias(found))


def _lookup(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def match_activities(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """(draft_activity_id, activity_id) by id, else by a unique, compatible title.

    Both tables carry campaign_id, activity_id, kind, title, ``cities`` and ``dates`` arrays; drafts
    also carry ``shared_source``. Cities are compatible when one side has none or both sets agree;
    dates when the campaigns share a source, one side has none, or a date is common. Every way to be
    compatible becomes one lookup key, on both sides.
    """
    cities = lambda: F.array_join(F.array_sort(F.array_distinct(F.transform("cities", fold))), "|")
    base = lambda: [F.col("campaign_id"), F.col("kind"), fold("title")]
    days = lambda: F.array_distinct("dates")
    by_id = drafts.join(stored.select("campaign_id", "activity_id"), ["campaign_id", "activity_id"]).select(
        F.col("activity_id").alias("draft_activity_id"), "activity_id")
    rest = drafts.join(by_id.select(F.col("draft_activity_id").alias("activity_id")), "activity_id", "left_anti")
    # stored side: under its own cities and under "any cities", with each date, "no date" and "any date"
    shelf = stored.select(*[c.alias(f"b{i}") for i, c in enumerate(base())], "activity_id", cities().alias("c"), days().alias("d"))
    shelf = shelf.withColumn("c", F.explode(F.array(F.concat(F.lit("="), "c"), F.lit("any"))))
    dated = F.concat(F.array(F.lit("any")), F.when(F.size("d") == 0, F.array(F.lit("none"))).otherwise(F.col("d")))
    shelf = shelf.withColumn("d", F.explode(dated)).select(_lookup(*[F.col(f"b{i}") for i in range(3)], F.col("c"), F.col("d")).alias("lookup"), "activity_id")
    # draft side: own cities and "no cities", or anything when it names none; same for dates
    ask = rest.select(*[c.alias(f"b{i}") for i, c in enumerate(base())], F.col("activity_id").alias("draft_activity_id"),
                      cities().alias("c"), days().alias("d"), F.coalesce("shared_source", F.lit(False)).alias("s"))
    ask = ask.withColumn("c", F.explode(F.when(F.col("c") == "", F.array(F.lit("any"))).otherwise(F.array(F.concat(F.lit("="), "c"), F.lit("=")))))
    free = F.col("s") | (F.size("d") == 0)
    ask = ask.withColumn("d", F.explode(F.when(free, F.array(F.lit("any"))).otherwise(F.concat("d", F.array(F.lit("none")))))).select(
        "draft_activity_id", _lookup(*[F.col(f"b{i}") for i in range(3)], F.col("c"), F.col("d")).alias("lookup"))
    return by_id.unionByName(_only(ask, shelf, "draft_activity_id", "activity_id"))


def match_actions(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """(draft_action_id, action_id) by id, else by a unique kind and title in the same activity."""
    by_id = drafts.join(stored.select("activity_id", "action_id"), ["activity_id", "action_id"]).select(
        F.col("action_id").alias("draft_action_id"), "action_id")
    rest = drafts.join(by_id.select(F.col("draft_action_id").alias("action_id")), "action_id", "left_anti")
    key = lambda: _lookup(F.col("activity_id"), F.col("kind"), fold("title")).alias("lookup")
    return by_id.unionByName(_only(rest.select(F.col("action_id").alias("draft_action_id"), key()),
                                   stored.select("action_id", key()), "draft_action_id", "action_id"))
