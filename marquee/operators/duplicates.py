"""Repeats of one post: typed keys, exact groups, pair verdicts, shared material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.text import fold, jaccard, not_blank, shingles
from marquee.functions.urls import canonical_url
from marquee.operators.components import components
from marquee.operators.ranking import positions


def duplicate_keys(obs: DataFrame, namespaced_canonical: bool = False) -> DataFrame:
    """One row per post and key that identifies its material inside one watched name.

    The canonical content id is compared without its platform unless asked otherwise.
    """
    ip = F.col("ip_slug")
    tag = lambda kind, *value: F.concat_ws("\x1f", ip, F.lit(kind), *value)
    canonical = ([F.col("kind")] if namespaced_canonical else []) + [F.col("canonical_content_id")]
    # the digest of a text without letters stands for "no text"
    text, blank = F.sha2(fold("text"), 256), F.sha2(F.lit(""), 256)
    keys = F.array(
        tag("id", F.col("obs_id")), tag("source", F.col("source_id")), tag("hash", F.col("content_hash")),
        F.when(not_blank("canonical_content_id"), tag("canonical", *canonical)),
        F.when(F.col("_text") != blank, tag("text", F.col("_text"))))
    return obs.withColumn("_text", text).select("obs_id", F.explode(F.array_compact(keys)).alias("key"))


def exact_members(obs: DataFrame, namespaced_canonical: bool = False) -> DataFrame:
    """Posts with the label of their exact-duplicate group: obs columns plus ``component``."""
    labels = components(duplicate_keys(obs, namespaced_canonical), "obs_id", "key")
    return obs.join(labels, "obs_id")


def group_primaries(members: DataFrame) -> DataFrame:
    """One row per group: its primary is the first post by (published_at, source_id, obs_id)."""
    first = F.min(F.struct("published_at", "source_id", "obs_id"))
    return (members.groupBy("ip_slug", "component")
            .agg(first.alias("_p"), F.count(F.lit(1)).alias("n_members"))
            .select("ip_slug", "component", F.col("_p.obs_id").alias("primary_id"),
                    F.col("_p.published_at").alias("primary_at"), "n_members"))


def exact_groups(obs: DataFrame, namespaced_canonical: bool = False) -> DataFrame:
    """(ip_slug, obs_id, primary_id, primary_at, n_members) for every post."""
    slim = obs.select("ip_slug", "obs_id", "source_id", "kind", "canonical_content_id", "content_hash", "text", "published_at")
    members = exact_members(slim, namespaced_canonical).select("ip_slug", "component", "obs_id", "source_id", "published_at")
    return members.join(group_primaries(members), ["ip_slug", "component"]).drop("component")


def ordered_members(groups: DataFrame) -> DataFrame:
    """Add the position of a post inside its group, for groups of any size."""
    return positions(groups, ["ip_slug", "primary_id"], ["published_at", "source_id", "obs_id"], "member_no")


def verdict(same_id: Column, same_canonical: Column, same_hash: Column, same_text: Column, shared_url: Column,
            shared_media: Column, similarity: Column) -> list[Column]:
    """Kind and reason of a pair; the first rule that fires wins."""
    rules = [
        (same_id, "exact", C.REASON_SAME_SOURCE), (same_canonical, "exact", C.REASON_SAME_CANONICAL),
        (same_hash, "exact", C.REASON_SAME_HASH), (same_text, "exact", C.REASON_SAME_TEXT),
        (shared_url, "same_material", C.REASON_SHARED_URL),
        (shared_media & (similarity >= C.SIMILAR_TEXT_RATIO), "same_material", C.REASON_SHARED_MEDIA)]
    kind = reason = None
    for test, label, text in rules:
        hit = F.coalesce(test, F.lit(False))
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
        reason = F.when(hit, text) if reason is None else reason.when(hit, text)
    return [kind.otherwise("distinct").alias("verdict"), reason.otherwise(C.REASON_NONE).alias("reason")]


def _pair_side(obs: DataFrame, id_name: str, side: str) -> DataFrame:
    urls = F.array_distinct(F.transform(F.coalesce("outbound_urls", F.array().cast("array<string>")), canonical_url))
    row = F.struct("obs_id", "source_id", "canonical_content_id", "content_hash", fold("text").alias("text"),
                   urls.alias("urls"), F.coalesce("media_hashes", F.array().cast("array<string>")).alias("media"))
    return obs.select(F.col("obs_id").alias(id_name), row.alias(side))


def pair_verdicts(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Compare the given pairs (left_id, right_id) of posts, whose texts are folded once, before they meet. Never builds pairs itself."""
    both = (pairs.join(_pair_side(obs, "left_id", "l"), "left_id").join(_pair_side(obs, "right_id", "r"), "right_id"))
    l, r = F.col("l"), F.col("r")
    both = both.withColumn("_media", F.arrays_overlap(l["media"], r["media"])).withColumn("_text", l["text"] == r["text"])
    # shingles are cut only for pairs that share a medium and are not copies
    close = both.withColumn("_near", F.when(F.col("_media") & ~F.col("_text"), jaccard(shingles(l["text"]), shingles(r["text"]))).otherwise(F.lit(0.0)))
    return close.select("left_id", "right_id", *verdict(
        (l["obs_id"] == r["obs_id"]) | (l["source_id"] == r["source_id"]),
        not_blank(l["canonical_content_id"]) & (l["canonical_content_id"] == r["canonical_content_id"]),
        l["content_hash"] == r["content_hash"],
        F.col("_text") & not_blank(l["text"]),
        F.arrays_overlap(l["urls"], r["urls"]), F.col("_media"), F.col("_near")))


def material_tokens(obs: DataFrame) -> DataFrame:
    """Shared-material keys of a post: canonical outbound addresses and media hashes."""
    url = F.transform(F.coalesce("outbound_urls", F.array().cast("array<string>")),
                      lambda u: F.concat(F.lit("url\x1f"), canonical_url(u)))
    media = F.transform(F.coalesce("media_hashes", F.array().cast("array<string>")), lambda h: F.concat(F.lit("media\x1f"), h))
    return obs.select("ip_slug", "obs_id", "published_at", F.explode(F.array_distinct(F.concat(url, media))).alias("token"))


def material_links(obs: DataFrame) -> DataFrame:
    """Each post against the earliest post that shares an address or a medium with it.

    A token held by n posts gives n - 1 links, so sharing stays visible at any group size; other
    pairs can be asked of :func:`pair_verdicts`.
    """
    tokens = material_tokens(obs)
    first = F.min(F.struct("published_at", "obs_id"))
    anchors = tokens.groupBy("ip_slug", "token").agg(first.alias("_a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    links = (tokens.join(anchors, ["ip_slug", "token"]).where(F.col("_a.obs_id") != F.col("obs_id"))
             .select(F.col("_a.obs_id").alias("left_id"), F.col("obs_id").alias("right_id")).distinct())
    return pair_verdicts(links, obs)


def group_sources(members: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One row per source of a group, first member first, with a supplied summary preferred.

    ``members`` carries (primary_id, obs_id, source_id, published_at, summary).
    """
    rows = members
    if summaries is not None:
        rows = (members.join(summaries.select("obs_id", F.col("summary").alias("_s")), "obs_id", "left")
                .withColumn("summary", F.coalesce("_s", "summary")).drop("_s"))
    first = F.min_by(F.struct("obs_id", "summary"), F.struct("published_at", "source_id", "obs_id"))
    return (rows.groupBy("primary_id", "source_id").agg(first.alias("_f"))
            .select("primary_id", "source_id", F.col("_f.obs_id").alias("obs_id"), F.col("_f.summary").alias("summary")))


def source_media(members: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct media of a source of a group, with their first place in member order."""
    rows = members.select("primary_id", "source_id", "published_at", "obs_id", F.posexplode(column).alias("_i", name))
    return rows.groupBy("primary_id", "source_id", name).agg(F.min(F.struct("published_at", "obs_id", "_i")).alias("first_place"))
