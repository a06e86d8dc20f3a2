"""Queries over published views, retention, queued work, streams and run checks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.times import instant
from marquee.operators import passes, pending, review, screening, views
from marquee.operators.delivery import Ledger
from marquee.plans.catalog import query, set_sql
from marquee.plans.catalogue import _LINES, extractions
from marquee.plans.material import big, day_text, stamp
from marquee.plans.reminders import points
from marquee.plans.stand_ins import ACTION_TERMS, TERMS, Tables
from marquee.plans.views_sql import sql
from marquee.session import materialize, run_folder, state_folder
from marquee.sources.snapshots import Snapshots
from marquee.streaming import intake as streams

# --- views --------------------------------------------------------------------------------------

_SHOWN = """va AS (SELECT * FROM activities WHERE NOT excluded AND status NOT IN ('ended','cancelled') AND CASE WHEN end_at IS NOT NULL THEN end_at >= TIMESTAMP '1998-06-01' WHEN end_date IS NOT NULL THEN end_date >= DATE '1998-06-01' ELSE true END),
    vc AS (SELECT * FROM campaigns c WHERE redirected_to IS NULL AND status NOT IN ('ended','cancelled') AND (campaign_id IN (SELECT campaign_id FROM va) OR campaign_id NOT IN (SELECT campaign_id FROM activities WHERE NOT excluded)))"""


@query("visible_activities", sql("campaigns", "activities", body=_SHOWN + " SELECT activity_id, campaign_id FROM va"))
def visible_activities(t: Tables) -> DataFrame:
    return views.visible_activities(t.activities(), t.now).select("activity_id", "campaign_id")


@query("visible_campaigns", sql("campaigns", "activities", body=_SHOWN + " SELECT campaign_id FROM vc WHERE ip_slug IN ('ip-1','ip-2','ip-3')"))
def visible_campaigns(t: Tables) -> DataFrame:
    watched = t.campaigns().where(F.col("ip_slug").isin("ip-1", "ip-2", "ip-3")).select("ip_slug").distinct()
    return views.watched_only(views.visible_campaigns(t.campaigns(), t.activities(), t.now), watched).select("campaign_id")


@query("active_catalogue", sql("campaigns", "activities", body=_SHOWN + """
    SELECT vc.campaign_id, vc.ip_name, vc.partner, vc.title AS campaign_title, activity_id, va.kind, va.title, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at FROM vc LEFT JOIN va USING (campaign_id)"""))
def active_catalogue(t: Tables) -> DataFrame:
    rows = views.newest_first(views.active_catalogue(t.campaigns(), t.activities(), t.now))
    return rows.select("campaign_id", "ip_name", "partner", "campaign_title", "activity_id", "kind", "title", stamp("start_at").alias("start_at"))


_PLACE = """pl AS (SELECT activity_id, CASE WHEN bool_or(online_platform IS NOT NULL) THEN 'online' WHEN bool_or(nationwide) THEN 'nationwide' WHEN NOT bool_or(city IS NOT NULL) THEN 'unknown' WHEN bool_or(city = 'CITY_7') THEN 'local'
      WHEN bool_or(city IN ('CITY_3','CITY_4')) THEN 'reachable' ELSE 'cross_region' END AS r FROM venues GROUP BY 1)"""


@query("reachability", sql("activities", "venues", body=_PLACE + " SELECT activity_id, coalesce(r, 'unknown') AS reachability FROM activities LEFT JOIN pl USING (activity_id)"))
def reachability(t: Tables) -> DataFrame:
    return views.reachability(t.venues(), t.activities(), " CITY_7 ", ["CITY_3", " CITY_4", " "])


@query("campaign_detail", sql("campaigns", "activities", "venues", body=_SHOWN + "," + _PLACE + """
    SELECT vc.campaign_id, vc.title AS campaign_title, activity_id, CASE WHEN activity_id IS NOT NULL THEN coalesce(r, 'unknown') END AS reachability FROM vc LEFT JOIN va USING (campaign_id) LEFT JOIN pl USING (activity_id)"""))
def campaign_detail(t: Tables) -> DataFrame:
    a = t.activities()
    places = views.reachability(t.venues(), a, "CITY_7", ["CITY_3", "CITY_4"])
    rows = views.campaign_detail(views.visible_campaigns(t.campaigns(), a, t.now), views.visible_activities(a, t.now), places)
    return rows.select("campaign_id", "campaign_title", "activity_id", "reachability")


@query("next_point_cards", sql("campaigns", "activities", "actions", "points", body=_SHOWN + """,
    nx AS (SELECT activity_id, arg_min(title, (at_, action_id)) AS next_title, min(at_) AS next_at FROM points WHERE at_ >= TIMESTAMP '1998-06-01' OR start_date = DATE '1998-06-01' GROUP BY 1)
    SELECT va.campaign_id, activity_id, next_title, strftime(next_at, '%Y-%m-%d %H:%M:%S') AS next_at FROM va LEFT JOIN nx USING (activity_id)"""))
def next_point_cards(t: Tables) -> DataFrame:
    rows = views.soonest_first(views.next_points(points(t), views.visible_activities(t.activities(), t.now), t.now))
    return rows.select("campaign_id", "activity_id", "next_title", stamp("next_at").alias("next_at"))


@query("calendar", sql("campaigns", "activities", "actions", "points", body=_SHOWN + """
    SELECT strftime(p.at_ + INTERVAL 8 HOUR, '%Y-%m') AS month, strftime(p.at_ + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, vc.campaign_id, p.activity_id, p.action_id, ip_name, p.title, p.kind, strftime(p.at_ + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') AS "at"
    FROM points p JOIN va USING (activity_id) JOIN vc ON vc.campaign_id = va.campaign_id WHERE (p.at_ + INTERVAL 8 HOUR)::DATE >= DATE '1998-06-01'"""))
def calendar(t: Tables) -> DataFrame:
    a = t.activities()
    return views.calendar(points(t), views.visible_activities(a, t.now), views.visible_campaigns(t.campaigns(), a, t.now), t.now)


@query("today_view", sql("campaigns", "activities", body=_SHOWN + """
    SELECT 'j-' || activity_id AS job_id FROM activities a WHERE (orderkey % 10 = 0 OR campaign_id IN (SELECT campaign_id FROM vc)) AND activity_id IN (SELECT activity_id FROM va)"""))
def today_view(t: Tables) -> DataFrame:
    a = t.activities()
    items = a.select(F.concat(F.lit("j-"), "activity_id").alias("job_id"), "campaign_id", "activity_id", F.when(F.col("orderkey") % 10 == 0, "c").alias("candidate_id"))
    return views.today_items(items, views.visible_campaigns(t.campaigns(), a, t.now), views.visible_activities(a, t.now)).select("job_id")


@query("catalogue_search", sql("campaigns", body="SELECT campaign_id FROM campaigns WHERE contains(lower(concat_ws('|', campaign_id, ip_name, partner, title)), 'nation_1') OR contains(lower(partner), 'nation_1')"))
def catalogue_search(t: Tables) -> DataFrame:
    return views.search(t.campaigns().select("campaign_id", "ip_name", "partner", "title"), " Nation_1 ").select("campaign_id")


def _media_sources(t: Tables) -> DataFrame:
    url = lambda n: F.concat(F.lit("https://m.example.org/"), (F.col("custkey") % n).cast("string"))
    return t.campaigns().select("campaign_id", F.col("campaign_id").alias("source_id"), F.col("ip_name").alias("account_name"), F.array(url(7), url(5), url(7)).alias("media_urls"), F.array(F.lit("h0")).alias("media_hashes"))


_MEDIA = """mu AS (SELECT campaign_id, ip_name AS account_name, 'https://m.example.org/' || (custkey % 7) AS source_url, 0 AS n FROM campaigns UNION ALL SELECT campaign_id, ip_name, 'https://m.example.org/' || (custkey % 5), 1 FROM campaigns),
    mm AS (SELECT campaign_id, account_name, source_url, min(n) AS n FROM mu GROUP BY ALL)"""


@query("campaign_media", sql("campaigns", body=_MEDIA + """
    SELECT campaign_id, source_url, n::BIGINT AS media_no, CASE WHEN n = 0 THEN 'h0' END AS source_media_hash, CASE WHEN source_url[-1:] IN ('1','2','3') THEN 'assets/media/' || source_url[-1:] END AS asset_path FROM mm"""))
def campaign_media(t: Tables) -> DataFrame:
    last = F.substring("source_url", -1, 1)
    assets = _media_sources(t).select(F.explode("media_urls").alias("source_url")).distinct().where(last.isin("1", "2", "3")).withColumn("asset_path", F.concat(F.lit("assets/media/"), last))
    return views.campaign_media(_media_sources(t), assets).select("campaign_id", "source_url", big("media_no").alias("media_no"), "source_media_hash", "asset_path")


@query("detail_media", sql("campaigns", "activities", body=_SHOWN + "," + _MEDIA + """
    SELECT campaign_id, activity_id, NULL AS source_url FROM vc LEFT JOIN va USING (campaign_id) UNION ALL SELECT campaign_id, NULL, source_url FROM vc JOIN mm USING (campaign_id)"""))
def detail_media(t: Tables) -> DataFrame:
    """Details of the visible campaigns with their pictures."""
    a = t.activities()
    assets = _media_sources(t).select(F.explode("media_urls").alias("source_url")).distinct().withColumn("asset_path", F.lit("assets/media/x"))
    rows = views.campaign_detail(views.visible_campaigns(t.campaigns(), a, t.now), views.visible_activities(a, t.now), views.reachability(t.venues(), a, "CITY_7", ["CITY_3", "CITY_4"]),
                                 views.campaign_media(_media_sources(t), assets))
    return rows.select("campaign_id", "activity_id", "source_url")


@query("wanted_media", sql("campaigns", "activities", body=_SHOWN + "," + _MEDIA + " SELECT DISTINCT source_url FROM mm WHERE campaign_id IN (SELECT campaign_id FROM vc)"))
def wanted_media(t: Tables) -> DataFrame:
    return views.wanted_media(_media_sources(t), views.visible_campaigns(t.campaigns(), t.activities(), t.now))


_HIST = """sn AS (SELECT ts::DATE AS day, CASE WHEN user_id % 9 = 0 THEN 'cand-' ELSE 'm-' END || user_id AS campaign_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS activity_id, 'update' AS kind,
      '联动信息：' || event_type || CASE WHEN user_id % 9 = 0 AND event_id % 2 = 0 THEN chr(10) || 'raw post' ELSE '' END AS summary, (event_id % 4)::VARCHAR AS action_id, user_id FROM events),
    w AS (SELECT day, kind, action_id, user_id, CASE WHEN user_id % 9 = 0 THEN 'm-' || user_id ELSE campaign_id END AS cid, CASE WHEN activity_id = 'click' AND user_id % 9 = 0 THEN 'clack' ELSE activity_id END AS aid,
      '联动信息：' || regexp_extract(summary, '：([a-z]+)', 1) AS summary FROM sn WHERE day <= DATE '2024-01-20' AND day > DATE '2024-01-13'),
    r AS (SELECT *, CASE WHEN user_id % 8 = 0 THEN 'm-' || (user_id + 1) ELSE cid END AS rid FROM w),
    d AS (SELECT DISTINCT day, rid AS campaign_id, aid AS activity_id, kind, summary, action_id FROM r WHERE coalesce(aid, '') <> 'error')"""


@query("reminder_history", "WITH " + _HIST + """
    SELECT day::VARCHAR AS day, campaign_id, activity_id, summary, action_id, CASE WHEN activity_id IS NULL THEN campaign_id IN (SELECT 'm-' || user_id FROM events) AND campaign_id <> 'm-5' ELSE activity_id IN ('view','clack') AND campaign_id <> 'm-5' AND campaign_id IN (SELECT 'm-' || user_id FROM events) END AS linked FROM d""")
def reminder_history(t: Tables) -> DataFrame:
    """Events as told reasons; users divisible by nine were candidates, those by eight were redirected."""
    e, u = t.raw("events"), F.col("user_id").cast("string")
    m = F.concat(F.lit("m-"), u)
    post = (F.col("user_id") % 9 == 0) & (F.col("event_id") % 2 == 0)
    snap = e.select(F.to_date("ts").alias("day"), F.when(F.col("user_id") % 9 == 0, F.concat(F.lit("cand-"), u)).otherwise(m).alias("campaign_id"),
                    F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("activity_id"), F.lit("update").alias("kind"),
                    F.concat(F.lit("联动信息："), "event_type", F.when(post, "\nraw post").otherwise("")).alias("summary"), (F.col("event_id") % 4).cast("string").alias("action_id"))
    users = e.select("user_id", m.alias("campaign_id")).distinct()
    notices = users.where("user_id % 9 = 0").select(F.concat(F.lit("cand-"), u).alias("candidate_id"), "campaign_id", F.lit("structured").alias("status"), F.lit("raw post").alias("public_text"))
    redirects = notices.select("campaign_id", F.lit("click").alias("old_id"), F.lit("clack").alias("new_id"))
    resolved = users.where("user_id % 8 = 0").select("campaign_id", F.concat(F.lit("m-"), (F.col("user_id") + 1).cast("string")).alias("resolved_id"))
    visible = users.where("campaign_id <> 'm-5'").select("campaign_id", F.explode(F.array(F.lit("view"), F.lit("clack"))).alias("activity_id"))
    excluded = e.where("event_type = 'error'").select(F.col("event_type").alias("activity_id")).distinct()
    day = F.lit("2024-01-20").cast("date")
    rows = views.reminder_history(snap.where(F.col("day") < day), snap.where(F.col("day") == day), redirects, resolved, notices, excluded, visible, day)
    return rows.select(day_text("day").alias("day"), "campaign_id", "activity_id", "summary", "action_id", "linked")


@query("retention", sql(body="SELECT event_id FROM events WHERE ts::DATE >= DATE '2024-01-14'"))
def retention(t: Tables) -> DataFrame:
    return views.retain(t.raw("events").withColumn("day", F.to_date("ts")), "day", F.lit("2024-01-20").cast("date")).select("event_id")


@query("retained_jobs", sql(body="SELECT event_id FROM events WHERE ts::DATE >= DATE '2024-01-14' OR event_id % 3 <> 0"))
def retained_jobs(t: Tables) -> DataFrame:
    jobs = t.raw("events").select("event_id", F.col("event_id").cast("string").alias("job_id"), F.to_date("ts").alias("due_date"))
    return views.retain_jobs(jobs, jobs.where("event_id % 3 = 0"), F.lit("2024-01-20").cast("date")).select("event_id")


# --- queued work --------------------------------------------------------------------------------

def _pending(t: Tables) -> DataFrame:
    n = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("rate_limit", "quota", "authentication", "validation", "transient")]), (n % 5 + 1).cast("int"))
    return t.raw("events").select(
        n.cast("string").alias("pending_id"), F.when(n % 11 != 0, kind).alias("error_category"), (n % 4 == 0).alias("retry_after_explicit"),
        F.when(n % 6 != 0, F.col("ts").cast("timestamp")).alias("next_retry_at"), (n % 3).cast("int").alias("attempts"), F.lit("queued").alias("reason"))


_PEND = """p AS (SELECT event_id::VARCHAR AS pending_id, CASE WHEN event_id % 11 <> 0 THEN (['rate_limit','quota','authentication','validation','transient'])[(event_id % 5 + 1)::INT] END AS error_category, event_id % 4 = 0 AS explicit,
      CASE WHEN event_id % 6 <> 0 THEN ts END AS next_retry_at, event_id FROM events)"""


@query("retry_due", "WITH " + _PEND + " SELECT pending_id FROM p WHERE NOT ((coalesce(error_category, '') IN ('rate_limit','quota','authentication') OR explicit) AND coalesce(next_retry_at > TIMESTAMP '2024-01-20', false))")
def retry_due(t: Tables) -> DataFrame:
    return _pending(t).where(pending.retry_due(t.event_now)).select("pending_id")


@query("failure_update", "WITH " + _PEND + """, f AS (SELECT *, (['quota','rate_limit','validation','deferred','authentication','transient'])[(event_id % 6 + 1)::INT] AS c, CASE WHEN event_id % 7 = 0 THEN 60 END AS s FROM p),
    g AS (SELECT *, CASE WHEN c IN ('quota','authentication') THEN 86400 WHEN s IS NOT NULL THEN s WHEN c = 'rate_limit' THEN 300 ELSE 0 END AS delay FROM f)
    SELECT pending_id, (event_id % 3 + CASE WHEN c <> 'deferred' THEN 1 ELSE 0 END)::BIGINT AS attempts, CASE WHEN c = 'deferred' THEN error_category ELSE c END AS error_category,
      CASE WHEN c = 'deferred' THEN strftime(next_retry_at, '%Y-%m-%d %H:%M:%S') WHEN delay > 0 THEN strftime(TIMESTAMP '2024-01-20' + to_seconds(delay), '%Y-%m-%d %H:%M:%S') END AS next_retry_at,
      CASE WHEN c = 'deferred' THEN explicit ELSE s IS NOT NULL END AS explicit FROM g""")
def failure_update(t: Tables) -> DataFrame:
    n = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("quota", "rate_limit", "validation", "deferred", "authentication", "transient")]), (n % 6 + 1).cast("int"))
    failures = t.raw("events").select(n.cast("string").alias("pending_id"), kind.alias("category"), F.when(n % 7 == 0, 60).alias("retry_after_seconds"))
    rows = pending.record_failures(_pending(t), failures, t.event_now)
    return rows.select("pending_id", big("attempts").alias("attempts"), "error_category", stamp("next_retry_at").alias("next_retry_at"), F.col("retry_after_explicit").alias("explicit"))


@query("reset_validation", "WITH " + _PEND + " SELECT pending_id, CASE WHEN coalesce(error_category, '') <> 'validation' THEN strftime(next_retry_at, '%Y-%m-%d %H:%M:%S') END AS next_retry_at FROM p")
def reset_validation(t: Tables) -> DataFrame:
    return pending.reset_validation(_pending(t)).select("pending_id", stamp("next_retry_at").alias("next_retry_at"))


@query("work_items", sql("posts", body="SELECT ip_slug, obs_id, content_hash FROM posts WHERE doc_id % 3 = 0 OR doc_id % 5 = 0"))
def work_items(t: Tables) -> DataFrame:
    p = t.posts()
    wanted = p.where("doc_id % 3 = 0").select("ip_slug", "obs_id").unionByName(p.where("doc_id % 5 = 0").select("ip_slug", "obs_id")).withColumn("pending_id", F.lit("p"))
    return pending.work_items(wanted, p).select("ip_slug", "obs_id", "content_hash")


@query("left_open", sql("posts", body="SELECT obs_id AS pending_id FROM posts WHERE doc_id % 4 = 1 OR doc_id % 6 = 0 AND doc_id % 4 <> 0"))
def left_open(t: Tables) -> DataFrame:
    """Queued posts after a pass: every fourth is irrelevant, the others are stored unless their turn failed or never came."""
    d = F.col("doc_id")
    p = t.posts().select("doc_id", F.col("obs_id").alias("pending_id"))
    return pending.left_open(p.select("pending_id"), p.where("doc_id % 4 <> 1").select("pending_id", (d % 4 != 0).alias("relevant"), (d % 6 != 0).alias("stored")))


@query("work_ids", sql("posts", body=f"SELECT ip_slug || '/' || account_id AS primary_id, 'pending-ai-' || {set_sql('obs_id', 20)} AS pending_id FROM posts GROUP BY 1"))
def work_ids(t: Tables) -> DataFrame:
    return pending.pending_ids(t.posts().select(F.concat_ws("/", "ip_slug", "account_id").alias("primary_id"), "obs_id"))


@query("superseded_work", sql("posts", body="""g AS (SELECT ip_slug || '/' || account_id AS group_id, ip_slug, obs_id FROM posts WHERE doc_id % 2 = 0), p AS (SELECT 'old-' || ip_slug || '/' || account_id || '/' || (doc_id % 4) AS pending_id, ip_slug, obs_id FROM posts)
    SELECT pending_id, min(group_id) AS group_id FROM p LEFT JOIN g USING (ip_slug, obs_id) GROUP BY pending_id HAVING count(*) = count(group_id) AND count(DISTINCT group_id) = 1"""))
def superseded_work(t: Tables) -> DataFrame:
    p = t.posts()
    groups = p.where("doc_id % 2 = 0").select(F.concat_ws("/", "ip_slug", "account_id").alias("group_id"), "ip_slug", "obs_id")
    old = p.select(F.concat(F.lit("old-"), F.concat_ws("/", "ip_slug", "account_id", (F.col("doc_id") % 4).cast("string"))).alias("pending_id"), "ip_slug", "obs_id")
    return pending.superseded(old, groups)


@query("reopened_notices", sql("posts", body="""n AS (SELECT DISTINCT 'n-' || account_id || '-' || ip_slug AS candidate_id, ip_slug, account_id FROM posts), h AS (SELECT DISTINCT 'n-' || account_id || '-' || ip_slug AS candidate_id FROM posts WHERE doc_id % 40 = 3)
    SELECT candidate_id, CASE WHEN h.candidate_id IS NULL THEN 'unconfirmed' WHEN account_id IN ('src1','src3') THEN 'pending' ELSE 'structured' END AS status, (CASE WHEN h.candidate_id IS NULL THEN 1 ELSE 2 END)::BIGINT AS version FROM n LEFT JOIN h USING (candidate_id)"""))
def reopened_notices(t: Tables) -> DataFrame:
    p = t.posts().withColumn("candidate_id", F.concat_ws("-", F.lit("n"), "account_id", "ip_slug"))
    bare = F.col("account_id").isin("src1", "src3")
    n = p.select("candidate_id", "ip_slug", F.lit("unconfirmed").alias("status"), F.lit(1).alias("resolution_version"), F.when(bare, 0).otherwise(2).alias("n_campaigns"), F.when(~bare, "k").alias("campaign_id")).distinct()
    rows = pending.reopen_notices(n, p.where("doc_id % 40 = 3").select("ip_slug", "source_id", "content_hash"), p.select("candidate_id", "source_id", "content_hash"))
    return rows.select("candidate_id", "status", big("resolution_version").alias("version"))


def _batches(t: Tables) -> DataFrame:
    return t.posts().select(F.concat(F.lit("b-"), F.floor(F.col("doc_id") / 24).cast("string")).alias("batch_id"), "obs_id", "content_hash", "doc_id", "account_id")


_SIG = """b AS (SELECT 'b-' || (doc_id // 24) AS batch_id, '["' || obs_id || '", "' || content_hash || '"]' AS item, * FROM posts),
    sg AS (SELECT batch_id, """ + set_sql("item", 64) + """ AS signature FROM b GROUP BY 1)"""


@query("batch_signatures", sql("posts", body=_SIG + " SELECT * FROM sg"))
def batch_signatures(t: Tables) -> DataFrame:
    return pending.batch_signatures(_batches(t))


@query("resumed_batches", sql("posts", body=_SIG + ", r AS (SELECT DISTINCT batch_id, doc_id % 3 AS route_no FROM b) SELECT batch_id, route_no::BIGINT AS route_no FROM r WHERE NOT (route_no < 2 AND regexp_extract(batch_id, '[0-9]+')::INT % 2 = 0)"))
def resumed_batches(t: Tables) -> DataFrame:
    b = _batches(t)
    routes = b.select("batch_id", (F.col("doc_id") % 3).alias("route_no")).distinct()
    marks = pending.batch_signatures(b)
    done = routes.where((F.col("route_no") < 2) & (F.regexp_extract("batch_id", r"(\d+)", 1).cast("int") % 2 == 0)).join(marks, "batch_id").select("signature", "route_no")
    return pending.open_groups(routes, marks, done).select("batch_id", "route_no")


@query("associations", sql("posts", body=_SIG + """, l AS (SELECT batch_id, doc_id % 3 AS no, obs_id, doc_id // 24 AS bn FROM b WHERE doc_id % 4 <> 3)
    SELECT batch_id, obs_id, CASE WHEN bn % 5 <> 0 THEN 'k-' || no END AS campaign_id, CASE WHEN bn % 5 = 0 THEN 'pending' ELSE 'structured' END AS status FROM l WHERE NOT (bn % 5 = 0 AND no = 2)
    UNION ALL SELECT batch_id, obs_id, NULL, CASE WHEN (doc_id // 24) % 5 = 0 THEN 'pending' ELSE 'unconfirmed' END FROM b WHERE doc_id % 4 = 3"""))
def associations(t: Tables) -> DataFrame:
    """Every fifth batch has an unfinished third route, so nothing of it is associated yet."""
    b = _batches(t).withColumn("route_no", (F.col("doc_id") % 3).cast("int")).withColumn("bn", F.floor(F.col("doc_id") / 24))
    routed = b.where("doc_id % 4 <> 3").select("batch_id", "route_no", "obs_id", "bn")
    routes = routed.select("batch_id", "route_no", "bn").distinct()
    results = routes.where("not (bn % 5 = 0 and route_no = 2)").select("batch_id", "route_no", F.concat(F.lit("k-"), F.col("route_no").cast("string")).alias("campaign_id"))
    aside = b.where("doc_id % 4 = 3").select("batch_id", "obs_id", F.lit("unclear").alias("reason"))
    return pending.associations(routes.drop("bn"), routed.drop("bn"), results, aside).select("batch_id", "obs_id", "campaign_id", "status")


@query("safe_diagnostics", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'extract' ELSE 'other' END AS operation, CASE WHEN event_id % 2 = 0 THEN 'request' ELSE 'other' END AS stage, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'quota' ELSE 'other' END AS category,
      CASE WHEN value BETWEEN 0 AND 599 THEN round(value, 4) END AS http_status, CASE WHEN event_id % 1500 <= 1000 THEN (event_id % 1500)::DOUBLE END AS attempt,
      CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'field_is_not_editable' ELSE 'other' END AS code, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'KeyError' ELSE 'other' END AS exception_type,
      CASE WHEN event_id % 7 <> 0 THEN user_id END AS total_tokens, CASE WHEN event_id % 2 = 0 THEN 'missing/partner missing/other' ELSE 'other/other' END AS issues FROM events""")
def safe_diagnostics(t: Tables) -> DataFrame:
    n = F.col("event_id")
    rows = t.raw("events").select("event_id", F.when(n % 3 == 0, "extract").otherwise(F.col("props")).alias("operation"), F.when(n % 2 == 0, "request").otherwise(F.col("event_type")).alias("stage"),
                                  F.when(n % 4 == 1, "quota").when(n % 4 > 1, F.col("event_type")).alias("category"), F.lit("stop").alias("finish_reason"), (n % 1500).alias("attempt"),
                                  F.lit(1.0).alias("elapsed_seconds"), F.col("value").alias("http_status"),
                                  F.when(n % 3 == 0, "ok").when(n % 3 == 1, "field_is_not_editable").otherwise(F.col("props")).alias("code"),
                                  F.when(n % 5 == 1, "KeyError").when(n % 5 > 1, F.col("event_type")).alias("exception_type"),
                                  F.struct(F.lit(1).cast("bigint").alias("prompt_tokens"), F.lit(-1).cast("bigint").alias("completion_tokens"), F.when(n % 7 == 0, F.lit(2 * 10**9)).otherwise(F.col("user_id")).alias("total_tokens")).alias("usage"),
                                  F.when(n % 2 == 0, F.array(*[F.struct(F.lit("missing").alias("type"), F.lit(f).alias("field")) for f in ("partner", "secret")])).otherwise(
                                      F.array(F.struct(F.col("event_type").alias("type"), F.col("props").alias("field")))).alias("validation_errors"))
    return pending.safe_diagnostics(rows).select("event_id", "operation", "stage", "category", F.round("http_status", 4).alias("http_status"), "attempt", "code", "exception_type",
                                                 F.col("usage.total_tokens").alias("total_tokens"), F.array_join(F.transform("validation_errors", lambda e: F.concat_ws("/", e["type"], e["field"])), " ").alias("issues"))


@query("diagnostics_tail", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 8")
def diagnostics_tail(t: Tables) -> DataFrame:
    return pending.last_rows(t.raw("events").select("event_id", "user_id"), "user_id", "event_id", 8)


# --- streams ------------------------------------------------------------------------------------

#: Ranges of time in which a table lands.
LANDED = 12


def _folder(t: Tables) -> str:
    return f"{state_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _land(t: Tables, rows: DataFrame, time: str, block: str | None = None) -> str:
    """Land rows in files by ranges of ``time`` (no file holds two of ``block``), written by one job; the files' times are in that order, as if they had come one by one.

    There are LANDED files at every size, or as many for a block: the batches of a stream grow with the table, not their number.
    """
    path = f"{_folder(t)}/landing"
    writer = rows.repartitionByRange(LANDED, time).sortWithinPartitions(time).write
    (writer.partitionBy(block) if block else writer).parquet(path)
    place = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    listed, found = files.listFiles(place, True), []
    while listed.hasNext():
        file = listed.next().getPath()
        if file.getName().startswith("part-"):
            found.append(file)
    for k, file in enumerate(sorted(found, key=lambda p: (p.getParent().getName(), p.getName()))):
        files.setTimes(file, 1_700_000_000_000 + 1000 * k, -1)
    return path


def _event_stream(t: Tables) -> DataFrame:
    """The events as they land: files in order of time, two to a batch."""
    e = t.raw("events")
    return streams.landing(t.spark, _land(t, e, "ts"), e.schema, maxFilesPerTrigger="2").withColumn("published_at", F.col("ts").cast("timestamp"))


@query("stream_late", """
    WITH l AS (SELECT *, epoch(CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL 5 DAY ELSE ts END)::BIGINT // 172800 AS block FROM events),
    m AS (SELECT block, max(max(ts)) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM l GROUP BY block)
    SELECT event_id, coalesce(ts < newest - INTERVAL 2 DAY, false) AS late FROM l JOIN m USING (block)""")
def stream_late(t: Tables) -> DataFrame:
    """Events land in blocks of two days, every fiftieth five days late: what comes more than two days after its time is kept apart."""
    at = F.col("ts").cast("timestamp")
    landed = F.when(F.col("event_id") % 50 == 0, at + F.expr("INTERVAL 5 DAYS")).otherwise(at)
    e = t.raw("events").select("event_id", at.alias("at"), landed.alias("landed"), F.floor(F.unix_seconds(landed) / 172800).alias("block"))
    folder, kind = _folder(t), e.schema
    streams.split_late(streams.landing(t.spark, _land(t, e, "landed", "block"), kind, maxFilesPerTrigger="1").select("event_id", "at"), folder, "at")
    kind = e.select("event_id", "at").schema
    rows = streams.drained(t.spark, folder, kind).select("event_id", F.lit(False).alias("late"))
    return rows.unionByName(streams.late_rows(t.spark, folder, kind).select("event_id", F.lit(True).alias("late")))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Versions of (user, type) once each, from a stream."""
    rows = _event_stream(t).select(F.col("user_id").alias("obs_id"), F.col("event_type").alias("content_hash"), "published_at")
    folder = _folder(t)
    once = streams.once_per_version(rows)
    streams.drain(once, folder)
    return streams.drained(t.spark, folder, once.schema).select(F.col("obs_id").alias("user_id"), F.col("content_hash").alias("event_type"))


@query("stream_daily", "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_daily(t: Tables) -> DataFrame:
    folder = _folder(t)
    tally = streams.daily_tally(_event_stream(t), "published_at", ["event_type"])
    streams.drain(tally, folder, "update")
    return streams.latest_per_key(streams.drained(t.spark, folder, tally.schema), ["day", "event_type"]).select("day", "event_type", "n")


@query("account_bursts", """
    WITH o AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM o)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*)::BIGINT AS n FROM b GROUP BY user_id, no""")
def account_bursts(t: Tables) -> DataFrame:
    """Sessions of an account, six hours apart."""
    rows = streams.bursts(t.raw("events").withColumn("at", F.col("ts").cast("timestamp")), "at", ["user_id"], "6 hours")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n")


@query("stream_latest", """
    WITH o AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS prev FROM events)
    SELECT 'u-' || user_id AS obs_id, event_type AS content_hash, CASE WHEN prev IS NULL THEN 'new' ELSE 'edited' END AS change, count(*)::BIGINT AS n FROM o WHERE prev IS NULL OR prev <> event_type GROUP BY ALL""")
def stream_latest(t: Tables) -> DataFrame:
    """New and edited versions of a keyed post, from a stream with keyed state."""
    rows = _event_stream(t).select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("obs_id"), F.col("event_type").alias("content_hash"), F.col("published_at").alias("seen_at"))
    folder = _folder(t)
    streams.drain(streams.version_changes(rows), folder)
    return streams.drained(t.spark, folder, streams.VERSION).groupBy("obs_id", "content_hash", "change").agg(F.count(F.lit(1)).alias("n"))


# --- checks and tallies ---------------------------------------------------------------------------

@query("route_coverage", """
    WITH c AS (SELECT 'b-' || (conv_id // 10) AS batch_id, 'o-' || conv_id || '-' || turn AS obs_id, conv_id, turn FROM conversations)
    SELECT batch_id, obs_id AS item, 'not covered' AS problem FROM c WHERE turn % 5 = 4 UNION ALL SELECT batch_id, 'x' || obs_id, 'not supplied' FROM c WHERE conv_id % 13 = 0
    UNION ALL SELECT batch_id, obs_id, 'routed and set aside' FROM c WHERE turn % 5 = 2 UNION ALL SELECT batch_id, 'k-' || min(conv_id % 3), 'repeated identity' FROM c GROUP BY batch_id, conv_id % 3 HAVING count(DISTINCT conv_id) > 1
    UNION ALL SELECT batch_id, 'k-2', 'invalid campaign candidate' FROM (SELECT DISTINCT batch_id, conv_id FROM c WHERE conv_id % 3 = 2)""")
def route_coverage(t: Tables) -> DataFrame:
    c = t.raw("conversations").select(F.concat(F.lit("b-"), F.floor(F.col("conv_id") / 10).cast("string")).alias("batch_id"),
                                      F.concat_ws("-", F.lit("o"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("obs_id"), "conv_id", "turn")
    extra = c.where("conv_id % 13 = 0").withColumn("obs_id", F.concat(F.lit("x"), "obs_id"))
    routed = c.where("turn % 5 in (0, 1, 2)").unionByName(extra).select("batch_id", F.col("conv_id").alias("route_no"), "obs_id")
    identity = c.select("batch_id", F.col("conv_id").alias("route_no"), F.concat(F.lit("k-"), (F.col("conv_id") % 3).cast("string")).alias("campaign_id"), F.lit(None).cast("string").alias("partner"), F.lit("p").alias("phrase")).distinct()
    known = identity.where("campaign_id <> 'k-2'").select("campaign_id").distinct()
    return review.route_coverage(c.select("batch_id", "obs_id"), routed, c.where("turn % 5 in (2, 3)").select("batch_id", "obs_id"), identity, known)


@query("result_checks", sql("posts", body="""
    SELECT obs_id, doc_id % 10 <> 9 AS relevant, doc_id % 2 = 0 AND contains('Title ' || obs_id || coalesce(CASE WHEN doc_id % 3 <> 0 THEN ' ' || account_id END, ''), '1') AS campaign_entities, len(string_split(text, chr(10))) = 3 AS activity_count,
           false AS no_invented_times, false AS no_invented_venues, true AS no_invented_action_urls, true AS source_quotes, false AS missing_time_of_day_reported FROM posts"""))
def result_checks(t: Tables) -> DataFrame:
    checks = ["relevant", "campaign_entities", "activity_count", "no_invented_times", "no_invented_venues", "no_invented_action_urls", "source_quotes", "missing_time_of_day_reported"]
    return review.result_checks(extractions(t), ["Title", "1"], 3).select("obs_id", *checks)


@query("source_tally", sql("posts", body="""s AS (SELECT *, (contains(lower(text),'license') OR contains(lower(text),'apache') OR contains(lower(text),'mit')) AND (is_official OR contains(lower(text), ip_slug)) AS relevant FROM posts)
    SELECT ip_slug, account_id, count(*)::BIGINT AS fetched, count(*) FILTER (WHERE relevant)::BIGINT AS candidates, count(*) FILTER (WHERE relevant AND NOT contains(text, 'Apache'))::BIGINT AS eligible FROM s GROUP BY ALL"""))
def source_tally(t: Tables) -> DataFrame:
    rows = screening.screen(t.posts(), F.array("ip_slug"), collaboration=TERMS, actions=ACTION_TERMS)
    return review.candidate_tally(rows, by=["ip_slug", "account_id"], excluded=F.contains("text", F.lit("Apache")))


@query("replay_split", sql("posts", body="SELECT CASE WHEN published_at < TIMESTAMP '2024-01-15' THEN 'before' ELSE 'after' END AS side, count(*)::BIGINT AS n, strftime(min(published_at), '%Y-%m-%d %H:%M:%S') AS first FROM posts GROUP BY 1"))
def replay_split(t: Tables) -> DataFrame:
    rows = review.replay_split(t.posts(), instant("2024-01-15 00:00:00"))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("published_at"), "yyyy-MM-dd HH:mm:ss").alias("first"))


@query("held_out_texts", r"""
    WITH p AS (SELECT 'doc-' || doc_id AS obs_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
    h AS (SELECT item_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM benchmark),
    hr AS (SELECT DISTINCT item_id, w[i:i + 7] AS run FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM h WHERE len(w) > 0)),
    pr AS (SELECT DISTINCT obs_id, w[i:i + n - 1] AS run FROM (SELECT obs_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM p, (SELECT DISTINCT len(run) AS n FROM hr) WHERE len(w) >= n))
    SELECT DISTINCT obs_id, item_id FROM pr JOIN hr USING (run)""")
def held_out_texts(t: Tables) -> DataFrame:
    """Posts that repeat a passage of an evaluation item."""
    return review.held_out_texts(t.posts().select("obs_id", "text"), t.raw("benchmark"))


@query("held_out_posts", "SELECT 'doc-' || doc_id AS obs_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def held_out_posts(t: Tables) -> DataFrame:
    """Labelled posts of good quality are examples; they may not be evaluated."""
    examples = t.raw("labels").where("quality = 1").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("obs_id"))
    return review.held_out_hits(t.posts(), examples).select("obs_id")


@query("fingerprints", "SELECT 'f-' || page_id AS file FROM pages WHERE page_id % 6 = 0 OR page_id % 9 = 1")
def fingerprints(t: Tables) -> DataFrame:
    files = t.raw("pages").select("page_id", F.concat(F.lit("f-"), F.col("page_id").cast("string")).alias("file"), F.col("html").alias("content"))
    pinned = files.select("file", F.when(F.col("page_id") % 6 == 0, "stale").otherwise(F.sha2("content", 256)).alias("sha256"))
    return review.fingerprint_mismatches(files.where("page_id % 9 <> 1"), pinned).select("file")


_PASS = _LINES + """,
    cp AS (SELECT DISTINCT campaign_id FROM drafted), kept AS (SELECT campaign_id, activity_id, fl, published_at, no, obs_id FROM drafted QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY obs_id, no) = 1),
    xs AS (SELECT activity_id, 'action-' || sha256(replace(activity_id, '-', '') || chr(31) || 'saleopen' || chr(31) || fl)[1:16] AS action_id, published_at, no FROM drafted
           QUALIFY row_number() OVER (PARTITION BY activity_id, fl ORDER BY obs_id, no) = 1),
    pts AS (SELECT activity_id, action_id AS point FROM xs WHERE no % 2 = 0
      UNION SELECT activity_id, activity_id || '--start' FROM kept k WHERE no % 5 = 0 AND NOT EXISTS (SELECT 1 FROM xs WHERE xs.activity_id = k.activity_id AND xs.no % 2 = 0 AND xs.published_at = k.published_at)
      UNION SELECT activity_id, activity_id || '--end' FROM kept WHERE no % 5 = 0)"""


@query("idempotence", sql("posts", body=_PASS + """
    SELECT name, n, 0::BIGINT AS differences FROM (SELECT 'posts' AS name, count(*)::BIGINT AS n FROM posts UNION ALL SELECT 'campaigns', count(*) FROM cp UNION ALL SELECT 'activities', count(*) FROM kept
      UNION ALL SELECT 'actions', count(*) FROM xs UNION ALL SELECT 'jobs', (SELECT count(*) FROM cp) + (SELECT count(*) FROM pts) UNION ALL SELECT 'receipts', count(*) + 1 FROM cp)"""))
def idempotence(t: Tables) -> DataFrame:
    """The composed pass run twice over all posts: rows of every table, and by how many the second run differs."""
    state, ledger = new_state(t)
    posts = extractions(t).withColumn("updated_at", F.col("first_seen_at"))
    now, day = instant("2000-01-01 00:00:00"), "2000-01-01"
    first = passes.daily_pass(state, ledger, posts, day, now)
    sent = materialize(ledger.receipts())
    second = passes.daily_pass(state, ledger, posts, day, now)
    pairs = [(name, state.read(name, first), state.read(name, second)) for name in passes.KEYS] + [("receipts", sent, ledger.receipts())]
    count = lambda df, name, n, differences: df.agg(F.lit(name).alias("name"), n.cast("bigint").alias("n"), differences.cast("bigint").alias("differences"))
    rows, zero = F.count(F.lit(1)), F.lit(0)
    both = [count(a, name, rows, zero) for name, a, _ in pairs] + [count(review.repeat_differences(a, b), name, zero, rows) for name, a, b in pairs]
    return reduce(DataFrame.unionByName, both).groupBy("name").agg(F.sum("n").alias("n"), F.sum("differences").alias("differences"))


@query("pass_receipts", sql("posts", body=_PASS + """
    SELECT job_id, n FROM (SELECT 'job-' || sha256('change:' || campaign_id || ':new_campaign')[1:20] AS job_id, 1::BIGINT AS n FROM cp UNION ALL SELECT 'daily-digest-2000-01-02', 1)"""))
def pass_receipts(t: Tables) -> DataFrame:
    """A delivery that breaks off after each of its writes and is repeated, with more due by then: one receipt for every job frozen first."""
    state, ledger = new_state(t)
    posts = extractions(t).withColumn("updated_at", F.col("first_seen_at"))
    now, day = instant("2000-01-01 00:00:00"), "2000-01-02"
    version = passes.daily_pass(state, ledger, posts, day, now, deliver=False)
    jobs = state.read("jobs", version).where("kind = 'announcement'")
    items = jobs.select("job_id", F.lit(None).cast("string").alias("candidate_id"), "semantic_key", "campaign_id", F.lit(True).alias("campaign_notice"))
    facts = jobs.select("job_id", F.lit("campaign").alias("entity_id"), F.lit("状态").alias("label"), F.lit("active").alias("value"))
    covers = jobs.select("job_id", F.concat(F.lit("cand-"), "campaign_id").alias("candidate_id"))
    texts = covers.select("candidate_id", F.lit("text").alias("public_text"))
    ledger.freeze(day, items, texts, facts, facts.limit(0).withColumnRenamed("job_id", "candidate_id"), covers)
    for done in range(4):
        for step in ledger.steps(day, now)[:done]:
            step()
        ledger.freeze(day, items.withColumn("job_id", F.concat("job_id", F.lit("-late"))), texts, facts, facts.limit(0).withColumnRenamed("job_id", "candidate_id"), covers)
    ledger.settle(day, now)
    ledger.settle(day, instant("2000-01-03 00:00:00"))
    held = ledger.facts().select("job_id").join(ledger.read("receipt_covers").select("job_id"), "job_id").withColumn("_held", F.lit(True))
    rows = ledger.receipts().join(held, "job_id", "left").where("_held or campaign_id is null")
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


def new_state(t: Tables) -> tuple[Snapshots, Ledger]:
    """An empty state and an empty ledger in the run's folder."""
    folder = f"{run_folder(t.spark)}/state-{uuid.uuid4().hex}"
    return Snapshots(t.spark, f"{folder}/tables"), Ledger(t.spark, f"{folder}/ledger")


@query("new_jobs", sql("feed", body="SELECT post_id AS job_id FROM feed WHERE published_at >= TIMESTAMP '2024-01-25'"))
def new_jobs(t: Tables) -> DataFrame:
    jobs = t.feed().withColumnRenamed("post_id", "job_id")
    return review.new_ids(jobs, jobs.where(F.col("published_at") < instant("2024-01-25 00:00:00")), "job_id")


@query("run_report", sql("posts", body="SELECT count(*)::BIGINT AS observations, count(*) FILTER (WHERE doc_id % 4 = 0)::BIGINT AS unchanged, sum(n_chars)::BIGINT AS chars FROM posts"))
def run_report(t: Tables) -> DataFrame:
    passes = t.posts().groupBy("ip_slug", "account_id").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("doc_id") % 4 == 0).alias("unchanged"), F.sum("n_chars").alias("chars"))
    return review.run_report(passes)
