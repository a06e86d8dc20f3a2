"""Queued work, failures, partly finished batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions import ids


def retry_due(now: Column) -> Column:
    """Only limits of the service hold a row back; ordinary waits do not."""
    limited = F.coalesce(F.col("error_category").isin(C.COOLDOWN_CATEGORIES), F.lit(False)) | F.coalesce("retry_after_explicit", F.lit(False))
    return ~(limited & F.coalesce(F.col("next_retry_at") > now, F.lit(False)))


def retry_delay(category: Column, explicit: Column) -> Column:
    return (F.when(category.isin("quota", "authentication"), F.greatest(F.coalesce(explicit, F.lit(0)), F.lit(C.RETRY_LONG_SECONDS)))
            .when(explicit.isNotNull(), explicit).when(category == "rate_limit", F.lit(C.RETRY_RATE_SECONDS)).otherwise(F.lit(0)))


def record_failures(pending: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Pending rows after a pass. failures: pending_id, category, retry_after_seconds. Deferred work changes nothing."""
    f = failures.where("category <> 'deferred'").select("pending_id", F.col("category").alias("_c"), F.col("retry_after_seconds").cast("bigint").alias("_s"))
    rows = pending.join(f, "pending_id", "left")
    hit, delay = F.col("_c").isNotNull(), retry_delay(F.col("_c"), F.col("_s"))
    later = F.when(delay > 0, F.timestamp_seconds(F.unix_seconds(now) + delay))
    return (rows.withColumn("attempts", F.col("attempts") + hit.cast("int"))
            .withColumn("next_retry_at", F.when(hit, later).otherwise(F.col("next_retry_at")))
            .withColumn("retry_after_explicit", F.when(hit, F.col("_s").isNotNull()).otherwise(F.col("retry_after_explicit")))
            .withColumn("error_category", F.coalesce("_c", "error_category"))
            .withColumn("reason", F.when(hit, C.FAILURE_REASON).otherwise(F.col("reason"))).drop("_c", "_s"))


def work_items(pending_posts: DataFrame, posts: DataFrame) -> DataFrame:
    """Stored posts of pending rows, once per name. pending_posts: pending_id, ip_slug, obs_id."""
    wanted = pending_posts.select("ip_slug", "obs_id").distinct()
    return wanted.join(posts.drop("ip_slug"), "obs_id")


def pending_ids(groups: DataFrame) -> DataFrame:
    """Work id of every group over the set of its members: (primary_id, pending_id). ``groups`` has primary_id and obs_id.
    """
    marks = ids.set_digest(groups, ["primary_id"], F.col("obs_id"), size=20, name="mark")
    return marks.select("primary_id", F.concat(F.lit("pending-ai-"), "mark").alias("pending_id"))


def superseded(pending_posts: DataFrame, group_posts: DataFrame) -> DataFrame:
    """Older pending rows whose posts all lie in one new group of the same name: (pending_id, group_id).

    pending_posts: pending_id, ip_slug, obs_id; group_posts: group_id, ip_slug, obs_id. A post lies in
    one group, so members meet one to one and only counts are compared.
    """
    size = pending_posts.groupBy("pending_id").agg(F.countDistinct("obs_id").alias("_n"))
    met = pending_posts.distinct().join(group_posts.distinct(), ["ip_slug", "obs_id"]).groupBy("pending_id", "group_id").agg(F.count(F.lit(1)).alias("_hit"))
    return met.join(size, "pending_id").where("_hit = _n and pending_id <> group_id").select("pending_id", "group_id")


def reopen_notices(notices: DataFrame, fresh: DataFrame, notice_sources: DataFrame) -> DataFrame:
    """Notices that cite new material enter scheme 2: pending without campaigns, else structured.

    ``fresh`` is (ip_slug, source_id, content_hash). An attached campaign is required for structured.
    """
    hit = notice_sources.select("candidate_id", "source_id", "content_hash").join(fresh.distinct(), ["source_id", "content_hash"])
    marks = hit.select("candidate_id", "ip_slug", F.col("ip_slug").alias("_ip")).distinct()
    rows = notices.join(marks, ["candidate_id", "ip_slug"], "left")
    touched = F.col("_ip").isNotNull()
    status = F.when(touched & (F.col("n_campaigns") == 0), "pending").when(touched & F.col("campaign_id").isNotNull(), "structured").otherwise(F.col("status"))
    return rows.withColumn("status", status).withColumn(
        "resolution_version", F.when(touched, F.lit(2)).otherwise(F.col("resolution_version"))).drop("_ip")


def batch_signatures(members: DataFrame, by: str = "batch_id") -> DataFrame:
    """Signature of a batch over the set of its (post, content hash) pairs."""
    pair = F.concat(F.lit('["'), F.col("obs_id"), F.lit('", "'), F.col("content_hash"), F.lit('"]'))
    return ids.set_digest(members, [by], pair, size=64, name="signature")


def left_open(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Pending rows that stay after a pass: an irrelevant result or a stored one settles its row. results: pending_id, relevant, stored."""
    settled = results.where("not relevant or stored").select("pending_id")
    return pending.join(settled, "pending_id", "left_anti")


def open_groups(routes: DataFrame, signatures: DataFrame, completed: DataFrame) -> DataFrame:
    """Routes (batch_id, route_no) of batches whose signature has not finished that route yet."""
    return routes.join(signatures, "batch_id").join(completed.select("signature", "route_no"), ["signature", "route_no"], "left_anti")


def associations(routes: DataFrame, route_posts: DataFrame, results: DataFrame, unconfirmed: DataFrame) -> DataFrame:
    """Posts and their campaigns, only from batches in which every route is done.

    routes: batch_id, route_no; route_posts: batch_id, route_no, obs_id; results: batch_id, route_no,
    campaign_id (null for a route that named nothing); unconfirmed: batch_id, obs_id, reason.
    """
    done = results.select("batch_id", "route_no", "campaign_id", F.lit(True).alias("_done"))
    state = routes.join(done, ["batch_id", "route_no"], "left")
    ready = state.groupBy("batch_id").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("complete"))
    links = (route_posts.join(results.where("campaign_id is not null"), ["batch_id", "route_no"])
             .groupBy("batch_id", "obs_id", "campaign_id").agg(F.min("route_no").alias("route_no"))
             .withColumn("reason", F.lit(None).cast("string")))
    alone = unconfirmed.select("batch_id", "obs_id", F.lit(None).cast("string").alias("campaign_id"), F.lit(None).cast("int").alias("route_no"), "reason")
    rows = links.withColumn("route_no", F.col("route_no").cast("int")).unionByName(alone).join(ready, "batch_id")
    status = F.when(~F.col("complete"), "pending").when(F.col("campaign_id").isNotNull(), "structured").otherwise("unconfirmed")
    return rows.withColumn("status", status).withColumn("campaign_id", F.when(F.col("complete"), F.col("campaign_id")))


def reset_validation(pending: DataFrame) -> DataFrame:
    """Rows that failed validation may be tried at once."""
    return pending.withColumn("next_retry_at", F.when(F.col("error_category") != "validation", F.col("next_retry_at")).otherwise(
        F.when(F.col("error_category").isNull(), F.col("next_retry_at"))))


def _known(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(allowed), value).otherwise("other")


def _bounded(value: Column, top: int) -> Column:
    return F.when((value >= 0) & (value <= top) & ~F.isnan(value), value)


def safe_diagnostics(rows: DataFrame) -> DataFrame:
    """Diagnostics with known words and bounded numbers only; anything else becomes other or null.

    Optional columns: code, exception_type, usage (a struct of whole numbers) and validation_errors (an array of type and field, of
    which the first few are kept).
    """
    codes = [*C.PROBLEM_CODES, *[p.replace(" ", "_") for p in C.PROBLEM_TEXTS]]
    if "code" in rows.columns:
        rows = rows.withColumn("code", _known(F.col("code"), codes))
    if "exception_type" in rows.columns:
        rows = rows.withColumn("exception_type", F.when(F.col("exception_type").isNotNull(), _known(F.col("exception_type"), C.EXCEPTION_TYPES)))
    if "usage" in rows.columns:
        count = lambda c: F.when((c >= 0) & (c <= C.USAGE_MOST), c.cast("bigint"))
        rows = rows.withColumn("usage", F.when(F.col("usage").isNotNull(), F.struct(*[count(F.col("usage")[n]).alias(n) for n in C.USAGE_COUNTS])))
    if "validation_errors" in rows.columns:
        rows = rows.withColumn("validation_errors", F.transform(first_issues(F.col("validation_errors")), lambda e: F.struct(
            _known(e["type"], C.VALIDATION_TYPES).alias("type"), _known(e["field"], C.DIAGNOSTIC_FIELDS).alias("field"))))
    return (rows.withColumn("operation", _known(F.col("operation"), C.DIAGNOSTIC_OPERATIONS))
            .withColumn("stage", _known(F.col("stage"), C.DIAGNOSTIC_STAGES))
            .withColumn("category", F.when(F.col("category").isNotNull(), _known(F.col("category"), C.DIAGNOSTIC_CATEGORIES)))
            .withColumn("finish_reason", F.when(F.col("finish_reason").isNotNull(), _known(F.col("finish_reason"), C.FINISH_REASONS)))
            .withColumn("attempt", _bounded(F.col("attempt").cast("double"), 1000))
            .withColumn("elapsed_seconds", _bounded(F.col("elapsed_seconds").cast("double"), 86400))
            .withColumn("http_status", _bounded(F.col("http_status").cast("double"), 599)))


def first_issues(issues: Column) -> Column:
    return F.slice(issues, 1, C.ISSUE_LIMIT)


def last_rows(rows: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """The last ``limit`` rows of every group in their order; the limit is the feature here."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")
