"""Published views and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.times import iso_local, local_day


def activity_visible(now: Column, zone: str = C.DEFAULT_ZONE) -> Column:
    ahead = F.when(F.col("end_at").isNotNull(), F.col("end_at") >= now).when(
        F.col("end_date").isNotNull(), F.col("end_date") >= local_day(now, zone)).otherwise(F.lit(True))
    return ~F.col("status").isin(C.CLOSED) & ahead


def visible_activities(activities: DataFrame, now: Column, zone: str = C.DEFAULT_ZONE) -> DataFrame:
    shown = activities if "excluded" not in activities.columns else activities.where("not excluded")
    return shown.where(activity_visible(now, zone))


def visible_campaigns(campaigns: DataFrame, activities: DataFrame, now: Column, zone: str = C.DEFAULT_ZONE) -> DataFrame:
    """Not redirected, not closed, and without activities or with a visible one."""
    held = activities if "excluded" not in activities.columns else activities.where("not excluded")
    counts = held.groupBy("campaign_id").agg(F.bool_or(activity_visible(now, zone)).alias("_any"))
    rows = campaigns.where("redirected_to is null").where(~F.col("status").isin(C.CLOSED)).join(counts, "campaign_id", "left")
    return rows.where(F.coalesce("_any", F.lit(True))).drop("_any")


def watched_only(df: DataFrame, watched: DataFrame) -> DataFrame:
    return df.join(watched.select("ip_slug"), "ip_slug", "left_semi")


def active_catalogue(campaigns: DataFrame, activities: DataFrame, now: Column, zone: str = C.DEFAULT_ZONE) -> DataFrame:
    """Visible campaigns with their visible activities, one row each; newest campaign first when sorted."""
    heads = visible_campaigns(campaigns, activities, now, zone).select(
        "campaign_id", "ip_slug", "ip_name", "partner", F.col("title").alias("campaign_title"), F.col("status").alias("campaign_status"), "updated_at")
    parts = visible_activities(activities, now, zone).select("campaign_id", "activity_id", "kind", "title", "status", "start_at", "end_at")
    return heads.join(parts, "campaign_id", "left")


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("updated_at"), F.desc("campaign_id"))


def reachability(venues: DataFrame, activities: DataFrame, origin: str | None, reachable: list[str]) -> DataFrame:
    """Place class of every activity: online, nationwide, unknown, local, reachable or cross_region.

    ``reachable`` is a short list from the settings.
    """
    city = F.trim("city")
    near = [c.strip() for c in reachable if c.strip()]
    seen = venues.groupBy("activity_id").agg(
        F.bool_or(F.coalesce(F.col("online_platform") != "", F.lit(False))).alias("_online"),
        F.bool_or(F.coalesce("nationwide", F.lit(False))).alias("_all"),
        F.bool_or(F.coalesce(F.col("city") != "", F.lit(False))).alias("_placed"),
        F.bool_or(F.coalesce(city == F.lit((origin or "").strip()), F.lit(False))).alias("_local"),
        F.bool_or(F.coalesce(city.isin(near), F.lit(False)) if near else F.lit(False)).alias("_near"))
    rows = activities.select("activity_id").join(seen, "activity_id", "left")
    place = (F.when(F.col("_online"), "online").when(F.col("_all"), "nationwide")
             .when(~F.coalesce("_placed", F.lit(False)) | F.lit(not origin), "unknown").when(F.col("_local"), "local")
             .when(F.col("_near"), "reachable").otherwise("cross_region"))
    return rows.select("activity_id", place.alias("reachability"))


def next_points(points: DataFrame, activities: DataFrame, now: Column, zone: str = C.DEFAULT_ZONE) -> DataFrame:
    """Visible activities with their next point, null when none is ahead."""
    ahead = points.where((F.col("at") >= now) | (F.col("start_date") == local_day(now, zone)))
    soonest = ahead.groupBy("activity_id").agg(F.min(F.struct("at", "action_id", "title", "start_date")).alias("_n"))
    return activities.join(soonest, "activity_id", "left").select(
        "campaign_id", "activity_id", F.col("title").alias("activity_title"), F.col("_n.title").alias("next_title"),
        F.col("_n.at").alias("next_at"), F.col("_n.start_date").alias("next_date"))


def soonest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("next_at"), "activity_id")


def calendar(points: DataFrame, activities: DataFrame, campaigns: DataFrame, now: Column, zone: str = C.DEFAULT_ZONE) -> DataFrame:
    """Calendar items from today on, once per (campaign, activity, action), keyed by month and day."""
    ahead = points.where(local_day("at", zone) >= local_day(now, zone))
    rows = ahead.join(activities.select("activity_id", "campaign_id"), "activity_id").join(
        campaigns.select("campaign_id", "ip_name"), "campaign_id")
    once = rows.groupBy("campaign_id", "activity_id", "action_id").agg(F.min(F.struct("at", "title", "kind", "ip_name")).alias("_p"))
    day = local_day("_p.at", zone)
    return once.select(F.date_format(day, "yyyy-MM").alias("month"), F.date_format(day, "yyyy-MM-dd").alias("day"), "campaign_id", "activity_id",
                       "action_id", F.col("_p.ip_name").alias("ip_name"), F.col("_p.title").alias("title"), F.col("_p.kind").alias("kind"),
                       iso_local("_p.at", zone).alias("at"))


def campaign_media(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """Pictures of a campaign's sources with their catalogue row, if stored.

    ``sources``: campaign_id, source_id, account_name, media_urls, media_hashes.
    """
    rows = sources.select("campaign_id", "source_id", "account_name", "media_hashes", F.posexplode("media_urls").alias("media_no", "source_url"))
    rows = rows.withColumn("source_media_hash", F.get("media_hashes", F.col("media_no"))).drop("media_hashes")
    once = rows.groupBy("campaign_id", "source_id", "account_name", "source_url").agg(F.min(F.struct("media_no", "source_media_hash")).alias("_m"))
    return once.select("campaign_id", "source_id", "account_name", "source_url", F.col("_m.media_no").alias("media_no"),
                       F.col("_m.source_media_hash").alias("source_media_hash")).join(assets, "source_url", "left")


def wanted_media(sources: DataFrame, visible: DataFrame) -> DataFrame:
    """Distinct picture addresses of visible campaigns."""
    return sources.join(visible.select("campaign_id"), "campaign_id", "left_semi").select(F.explode("media_urls").alias("source_url")).distinct()


def campaign_detail(campaigns: DataFrame, activities: DataFrame, places: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Detail rows of a campaign: one for each activity with its place class, and with ``media`` (of :func:`campaign_media`) one for each picture.

    A campaign without activities has a row of its own. Long form keeps a campaign with many pictures out of one row.
    """
    heads = campaigns.select("campaign_id", "ip_name", "partner", F.col("title").alias("campaign_title"), F.col("status").alias("campaign_status"))
    rows = heads.join(activities.drop("ip_name"), "campaign_id", "left").join(places, "activity_id", "left")
    if media is None:
        return rows
    return rows.unionByName(heads.join(media.select("campaign_id", "source_url", "asset_path", "source_media_hash"), "campaign_id"), allowMissingColumns=True)


def today_items(items: DataFrame, visible: DataFrame, shown: DataFrame) -> DataFrame:
    """Due items a reader may open: their campaign is visible, or they belong to a candidate; so is their activity."""
    seen = visible.select("campaign_id").withColumn("_v", F.lit(True))
    open_ = shown.select("activity_id").withColumn("_a", F.lit(True))
    rows = items.join(seen, "campaign_id", "left").join(open_, "activity_id", "left")
    return rows.where((F.col("candidate_id").isNotNull() | F.col("_v")) & (F.col("activity_id").isNull() | F.col("_a"))).drop("_v", "_a")


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows that contain the text anywhere, without regard to case."""
    return df.where(F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(text.strip().lower())))


def reminder_history(snapshots: DataFrame, today: DataFrame, redirects: DataFrame, resolved: DataFrame, notices: DataFrame,
                     excluded: DataFrame, visible: DataFrame, day: Column) -> DataFrame:
    """Seven days of told reasons, brought up to date: (day, campaign_id, activity_id, summary, linked).

    snapshots, today: day, campaign_id, activity_id, kind, summary, action_id. Old anchors follow their
    redirects, cards of candidates that were structured later join their campaign without the raw
    post they once carried, excluded activities leave, and a link is kept only while its target is
    visible (``visible``: campaign_id, activity_id).
    """
    rows = snapshots.where((F.col("day") <= day) & (F.col("day") > F.date_sub(day, C.RETENTION_DAYS))).unionByName(today)
    told = notices.where("status = 'structured'").select(F.col("candidate_id").alias("_n"), F.col("campaign_id").alias("_nc"), F.col("public_text").alias("_text"))
    rows = rows.join(told, F.col("campaign_id") == F.col("_n"), "left")
    styled = F.col("summary").startswith(C.STRUCTURED_SUMMARY) | F.col("summary").startswith(C.SUPPLEMENT_SUMMARY)
    tail = F.concat(F.lit("\n"), F.col("_text"))
    cut = styled & F.coalesce(F.col("_text") != "", F.lit(False)) & F.coalesce(F.endswith("summary", tail), F.lit(False))
    rows = rows.withColumn("summary", F.when(cut, F.substr("summary", F.lit(1), F.length("summary") - F.length(tail))).otherwise(F.col("summary")))
    rows = rows.withColumn("campaign_id", F.coalesce("_nc", "campaign_id")).drop("_n", "_nc", "_text")
    rows = rows.join(redirects.select("campaign_id", F.col("old_id").alias("activity_id"), "new_id"), ["campaign_id", "activity_id"], "left")
    rows = rows.withColumn("activity_id", F.coalesce("new_id", "activity_id")).drop("new_id")
    rows = rows.join(resolved.select("campaign_id", "resolved_id"), "campaign_id", "left").withColumn(
        "campaign_id", F.coalesce("resolved_id", "campaign_id")).drop("resolved_id")
    rows = rows.join(excluded.select("activity_id"), "activity_id", "left_anti")
    rows = rows.select("day", "campaign_id", "activity_id", "kind", "summary", "action_id").distinct()
    whole = visible.select("campaign_id").distinct().withColumn("_c", F.lit(True))
    part = visible.select("campaign_id", "activity_id").distinct().withColumn("_a", F.lit(True))
    rows = rows.join(whole, "campaign_id", "left").join(part, ["campaign_id", "activity_id"], "left")
    linked = F.coalesce(F.when(F.col("activity_id").isNull(), F.col("_c")).otherwise(F.col("_a")), F.lit(False))
    return rows.withColumn("linked", linked).drop("_c", "_a")


def retain(rows: DataFrame, column: str, day: Column, keep: Column | None = None) -> DataFrame:
    """Rows of the last seven local days, and those ``keep`` holds for ever."""
    recent = F.col(column) >= F.date_sub(day, C.RETENTION_DAYS - 1)
    return rows.where(recent if keep is None else recent | keep)


def retain_jobs(jobs: DataFrame, receipts: DataFrame, day: Column, column: str = "due_date") -> DataFrame:
    """Old jobs stay as long as they have no receipt."""
    sent = receipts.select("job_id").distinct().withColumn("_sent", F.lit(True))
    rows = jobs.join(sent, "job_id", "left")
    return retain(rows, column, day, F.col("_sent").isNull()).drop("_sent")
