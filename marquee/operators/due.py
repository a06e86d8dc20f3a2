"""What is due today, its cards and its digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.text import lines, not_blank
from marquee.functions.times import display_time, iso_local, local_day
from marquee.operators.ranking import positions
from marquee.session import materialize

CARD = ["campaign_id", "activity_id"]


def collect_due(jobs: DataFrame, receipts: DataFrame, points: DataFrame, activities: DataFrame, campaigns: DataFrame,
                day: Column, now: Column, zone: str = C.DEFAULT_ZONE, watched: list[str] | None = None,
                include_delivered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Jobs to tell on a local day, and the skipped ones with their reason.

    A job is skipped when it was sent (unless sent today and asked for), when its point no longer
    stands at the same instant in an open activity, or when its point has passed. A date-only point
    stays due through its whole local day. Jobs of unwatched names are neither told nor skipped.
    """
    due = jobs.where(F.col("due_date") <= day)
    sent = receipts.groupBy("job_id").agg(F.bool_or(F.col("delivery_day") == day).alias("_today"))
    owner = activities.groupBy("activity_id").agg(F.min(F.struct("campaign_id", "status")).alias("_a"))
    heads = campaigns.where("redirected_to is null").select(
        F.col("campaign_id").alias("_c"), "ip_slug", "ip_name", F.col("title").alias("campaign_title"), F.col("status").alias("_cs"))
    # only points of activities that a due job names are dealt for the join
    asked = due.where("action_id is not null").select("activity_id").distinct()
    live = points.join(asked, "activity_id", "left_semi").select("activity_id", "action_id", F.col("at").alias("_point_at"), F.col("start_date").alias("_point_day"))
    rows = due.join(owner, "activity_id", "left").withColumn("_c", F.coalesce("_a.campaign_id", "campaign_id")).join(heads, "_c", "left")
    if watched is not None:
        # names are a short list from the settings; what nobody watches leaves before the larger joins
        rows = rows.where(F.col("ip_slug").isNull() | F.col("ip_slug").isin(watched))
    rows = rows.join(sent, "job_id", "left").join(live, ["activity_id", "action_id"], "left")
    was_sent = F.col("_today").isNotNull()
    retold = was_sent & F.lit(include_delivered) & F.coalesce("_today", F.lit(False))
    closed = F.coalesce(F.col("_cs").isin(C.CLOSED), F.lit(False)) | F.coalesce(F.col("_a.status").isin(C.CLOSED), F.lit(False))
    stands = F.col("action_id").isNull() | (~closed & F.coalesce(F.col("_point_at") == F.col("expected_at"), F.lit(False)))
    target = F.coalesce("expected_date", "_point_day")
    passed = F.col("expected_at").isNotNull() & ~retold & F.coalesce(
        F.when(target.isNotNull(), target < day).otherwise(F.col("expected_at") <= now), F.lit(False))
    why = (F.when(was_sent & ~retold, "sent").when(F.col("ip_slug").isNull(), "no campaign").when(~stands, "changed").when(passed, "passed"))
    today = F.col("expected_at").isNotNull() & ~retold & (F.coalesce(target, local_day("expected_at", zone)) == day)
    rows = rows.withColumn("skipped", why).withColumn("date_only", target).withColumn(
        "summary", F.when(today, F.replace(F.col("summary"), F.lit(C.TOMORROW), F.lit(C.TODAY))).otherwise(F.col("summary")))
    rows = rows.withColumn("campaign_id", F.coalesce("_c", "campaign_id"))
    keep = [*jobs.columns, "ip_slug", "ip_name", "campaign_title", "date_only"]
    return rows.where("skipped is null").select(*keep), rows.where("skipped is not null").select("job_id", "skipped")


def overlay_candidates(items: DataFrame, notices: DataFrame) -> DataFrame:
    """Source-level jobs speak for their notice: its title, its status, its public text.

    ``notices``: candidate_id, n_ip_name, status, public_text, review_reason, n_title (its campaign's title, if any).
    """
    rows = items.join(notices, "candidate_id", "left")
    own = F.col("status").isNotNull()
    settled = (F.col("status") == "structured") & F.col("n_title").isNotNull()
    styled = F.col("summary").startswith(C.STRUCTURED_SUMMARY) | F.col("summary").startswith(C.SUPPLEMENT_SUMMARY)
    text = (F.when(F.col("status") == "unconfirmed", F.concat(F.lit(C.REVIEW_PREFIX), F.coalesce("review_reason", F.lit(C.REVIEW_DEFAULT))))
            .when(own & ~(settled & styled), F.concat_ws("\n", "summary", "public_text")).otherwise(F.col("summary")))
    title = F.when(own, F.coalesce("n_title", F.concat("n_ip_name", F.lit(C.CANDIDATE_TITLE_SUFFIX)))).otherwise(F.col("campaign_title"))
    card = F.when(own & ~settled, F.col("candidate_id")).otherwise(F.col("campaign_id"))
    return rows.withColumn("summary", text).withColumn("campaign_title", title).withColumn("campaign_id", card).withColumn(
        "extraction_status", F.col("status")).drop("n_ip_name", "n_title", "status", "public_text", "review_reason")


def reader_summary(jobs: DataFrame, values: DataFrame) -> DataFrame:
    """Wording of jobs that name a field path: "<title> · <label>已更新：<value>", generic when the path is gone.

    ``values`` is (campaign_id, field_path, entity_title, value) of current facts.
    """
    path = F.regexp_extract("summary", f"^{C.FACT_UPDATE_SUMMARY}(.*)$", 1)
    rows = jobs.withColumn("field_path", F.when((path != "") & ~F.coalesce("campaign_notice", F.lit(False)), path)).join(
        values, ["campaign_id", "field_path"], "left")
    names = F.create_map(*[F.lit(x) for kv in C.READER_LABELS.items() for x in kv])
    label = F.coalesce(F.try_element_at(names, F.regexp_extract("field_path", r"([^.]+)$", 1)), F.lit(C.READER_DEFAULT))
    told = F.concat("entity_title", F.lit(" · "), label, F.lit("已更新："), "value")
    return rows.withColumn("summary", F.when(F.col("field_path").isNull(), F.col("summary")).otherwise(
        F.coalesce(told, F.lit(C.GENERIC_UPDATE)))).drop("field_path", "entity_title", "value")


def _carded(items: DataFrame) -> DataFrame:
    """A campaign with a campaign-level notice has one card: its activity cards lose their activity."""
    whole = items.where("campaign_notice").select("campaign_id").distinct().withColumn("_whole", F.lit(True))
    rows = items.join(whole, "campaign_id", "left")
    return rows.withColumn("activity_id", F.when(F.col("_whole"), F.lit(None).cast("string")).otherwise(F.col("activity_id"))).drop("_whole")


def cards(items: DataFrame) -> DataFrame:
    """One row per (campaign, activity), described by its last job by id."""
    last = F.max(F.struct("job_id", "campaign_title", "ip_name"))
    return _carded(items).groupBy(*CARD).agg(
        last.alias("_l"), F.bool_or(F.coalesce("campaign_notice", F.lit(False))).alias("campaign_notice"), F.count(F.lit(1)).alias("n_jobs")).select(
        *CARD, F.col("_l.campaign_title").alias("campaign_title"), F.col("_l.ip_name").alias("ip_name"), "campaign_notice", "n_jobs")


def card_reasons(items: DataFrame, zone: str = C.DEFAULT_ZONE) -> DataFrame:
    """Distinct reasons of a card, each with the first job that gives it."""
    rows = _carded(items).select(*CARD, "kind", "summary", "action_id", iso_local("expected_at", zone).alias("expected_at"),
                                 F.col("date_only").cast("string").alias("date_only"), "job_id")
    return rows.groupBy(*CARD, "kind", "summary", "action_id", "expected_at", "date_only").agg(F.min("job_id").alias("first_job"))


def card_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of a card, one per address, the last one by id."""
    held = _carded(items).select(*CARD).distinct().join(sources, "campaign_id")
    columns = [c for c in sources.columns if c not in ("campaign_id", "url")]
    return held.groupBy(*CARD, "url").agg(F.max(F.struct(*columns)).alias("_s")).select(*CARD, "url", "_s.*")


def digest_lines(items: DataFrame, activities: DataFrame, actions: DataFrame, venues: DataFrame, sources: DataFrame,
                 generated_at: Column, zone: str = C.DEFAULT_ZONE, texts: DataFrame | None = None) -> DataFrame:
    """The digest as ordered lines: (card_at, ip_name, card_job, section, line_key, line).

    ``texts`` (job_id, text_key, line) has the lines of notices in order; they follow the summary of their job.

    Cards come in the order of their first job by (time or now, name, job id). Sorting by all five
    keys gives the text; it is written by a range-sorted job and never built in one task.
    """
    at = F.coalesce("expected_at", generated_at)
    # seven kinds of lines read the due items, so they are written once
    items = materialize(_carded(items))
    first = items.groupBy(*CARD).agg(F.min(F.struct(at.alias("card_at"), "ip_name", "job_id")).alias("_f"), F.max("campaign_title").alias("campaign_title"))
    heads = first.select(*CARD, "campaign_title", F.col("_f.card_at").alias("card_at"), F.col("_f.ip_name").alias("ip_name"), F.col("_f.job_id").alias("card_job"))
    place = ["card_at", "ip_name", "card_job"]
    line = lambda df, section, key, text: df.select(*place, F.lit(section).alias("section"), key.cast("string").alias("line_key"), text.alias("line"))
    named = heads.join(activities.select("activity_id", F.col("title").alias("a_title")), "activity_id", "left")
    title = line(named, 0, F.lit("0"), F.concat(F.lit("【"), F.coalesce("a_title", "campaign_title"), F.lit("】")))
    sub = line(named.where("a_title is not null and a_title <> campaign_title"), 1, F.lit("0"), F.col("campaign_title"))
    inside = heads.where("activity_id is not null")
    keyed = F.concat(F.coalesce("campaign_id", F.lit("")), F.lit("\x1f"), F.coalesce("activity_id", F.lit("")))
    reasons = card_reasons(items.withColumn("campaign_notice", F.lit(False)), zone).withColumn("_k", keyed).drop(*CARD).join(
        heads.withColumn("_k", keyed), "_k")
    why = line(reasons, 2, F.concat_ws("-", "first_job", "action_id"), F.col("summary"))
    if texts is not None:
        told = items.select("job_id", keyed.alias("_k")).join(texts, "job_id").join(heads.withColumn("_k", keyed), "_k")
        why = why.unionByName(line(told, 2, F.concat_ws("-", "job_id", F.lit("\uffff"), "text_key"), F.col("line")))
    shown = F.concat_ws(" · ", *[F.when(not_blank(c), F.col(c)) for c in ("province", "city", "name", "address", "online_platform")])
    where = line(inside.join(venues.drop("campaign_id"), "activity_id"), 3, F.col("venue_id"), F.concat(F.lit(C.VENUE_LINE), shown))
    when = lines(F.concat(F.col("title"), F.lit("："), display_time("at", "start_date", zone)),
                 F.when(F.col("end_at").isNotNull() | F.col("end_date").isNotNull(), F.concat(F.lit(C.END_LINE), display_time("end_at", "end_date", zone))),
                 F.col("rules"), F.col("scope"), F.col("quantity_limit"), F.col("end_condition"), F.col("url"))
    does = line(inside.join(actions.where(~F.coalesce("cancelled", F.lit(False))).drop("campaign_id"), "activity_id"), 4, F.col("action_id"), when)
    cited = line(heads.join(sources, "campaign_id"), 5, F.col("url"),
                 F.concat(F.lit(C.SOURCE_LINE), F.coalesce("summary", "account_name"), F.lit(" "), F.col("url")))
    return reduce(DataFrame.unionByName, [title, sub, why, where, does, cited])


DIGEST_ORDER = ["card_at", "ip_name", "card_job", "section", "line_key", "line"]


def numbered_digest(digest: DataFrame) -> DataFrame:
    """The digest's lines with ``line_no``, their place in the whole text: a rank within a range of lines plus the lines of the ranges before."""
    return positions(digest, [], DIGEST_ORDER, "line_no")


def write_digest(digest: DataFrame, path: str) -> None:
    digest.orderBy(*DIGEST_ORDER).select("line").write.mode("overwrite").text(path)


def freeze_day(items: DataFrame, snapshots: DataFrame, day: Column) -> DataFrame:
    """Jobs the day's digest covers: the frozen set when the day was frozen before, else today's items."""
    frozen = snapshots.where(F.col("delivery_day") == day)
    fresh = items.select("job_id", "candidate_id", "campaign_id", "campaign_notice", "semantic_key").withColumn("delivery_day", day)
    marker = frozen.select("delivery_day").distinct()
    return frozen.select(*fresh.columns).unionByName(fresh.join(marker, "delivery_day", "left_anti"))


def day_receipts(frozen: DataFrame, receipts: DataFrame, sent_at: Column, day: Column) -> DataFrame:
    """Receipts of exactly the frozen jobs plus the one that closes the day; none when it is closed."""
    closing = F.concat(F.lit("daily-digest-"), day.cast("string"))
    closed = receipts.where((F.col("delivery_day") == day) & (F.col("job_id") == closing)).select("delivery_day").distinct()
    rows = frozen.select("job_id", "candidate_id", "semantic_key", F.when(F.col("campaign_notice"), F.col("campaign_id")).alias("campaign_id"), "delivery_day")
    end = frozen.select("delivery_day").distinct().select(
        closing.alias("job_id"), F.lit(None).cast("string").alias("candidate_id"), F.concat(F.lit("daily-digest:"), day.cast("string")).alias("semantic_key"),
        F.lit(None).cast("string").alias("campaign_id"), "delivery_day")
    return rows.unionByName(end).join(closed, "delivery_day", "left_anti").select(*rows.columns).withColumn("sent_at", sent_at).withColumn("channel", F.lit("email"))


def send_gate(pending: DataFrame, watched: list[str], final_retry: bool) -> DataFrame:
    """One row: may the digest go out? Yes without watched pending rows, or on the last retry."""
    held = F.count_if(F.col("ip_slug").isin(watched))
    return pending.agg(held.cast("bigint").alias("n_pending"), ((held == 0) | F.lit(final_retry)).alias("ready"))
