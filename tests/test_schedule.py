"""Dated points, reminders, due sets."""

from pyspark.sql import functions as F

from marquee.functions.times import instant
from marquee.operators import due, schedule, views

ACT = "activity_id STRING, campaign_id STRING, title STRING, status STRING, start_at STRING, end_at STRING, start_date DATE, end_date DATE"
ACN = "action_id STRING, activity_id STRING, kind STRING, title STRING, at STRING, end_at STRING, start_date STRING, end_date STRING, cancelled BOOLEAN, ended BOOLEAN"


def tables(spark, acts, acns):
    a = spark.createDataFrame(acts, ACT.replace("DATE", "STRING")).withColumns({c: F.col(c).cast("timestamp") for c in ("start_at", "end_at")}).withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    x = spark.createDataFrame(acns, ACN).withColumns({c: F.col(c).cast("timestamp") for c in ("at", "end_at")}).withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    return a, x


def test_points_and_wording(spark):
    a, x = tables(spark, [("a", "c", "Pop-up", "upcoming", None, None, "2026-09-01", "2026-09-10")],
                  [("x", "a", "reservation_open", "Book", "2026-09-05 02:00:00", None, None, "2026-09-07", False, False),
                   ("y", "a", "event_start", "Open", None, None, "2026-09-01", None, False, False), ("z", "a", "gift", "Gone", "2026-09-02 00:00:00", None, None, None, True, False),
                   ("n", "a", "announcement", "News", "2026-09-02 00:00:00", None, None, None, False, False)])
    got = {r["action_id"]: (r["kind"], r["title"], str(r["at"]), r["is_deadline"]) for r in schedule.schedule_points(a, x).collect()}
    assert got == {
        "x": ("reservation_open", "Book", "2026-09-05 02:00:00", False), "x--end": ("reservation_close", "Book截止", "2026-09-06 16:00:00", True),
        "y": ("event_start", "Open", "2026-08-31 16:00:00", False), "a--end": ("event_end", "Pop-up结束", "2026-09-09 16:00:00", True)}
    jobs = schedule.future_jobs(schedule.schedule_points(a, x), a.select("activity_id", "campaign_id"), instant("2026-09-01 10:00:00"))
    said = {r["action_id"]: (str(r["due_date"]), r["kind"], r["summary"]) for r in jobs.collect()}
    # a date-only point stays ahead for its whole day
    assert said["y"] == ("2026-08-31", "day_before", "明天开始：Open") and said["x"] == ("2026-09-04", "day_before", "明天开放预约：Book")
    assert said["x--end"] == ("2026-09-06", "deadline", "明天截止：Book截止") and len(said) == 4
    assert schedule.future_jobs(schedule.schedule_points(a, x), a.select("activity_id", "campaign_id"), instant("2026-09-01 10:00:00"), remind_day_before=False).count() == 0


def test_closed_campaigns_have_no_jobs_and_changed_times_fall(spark):
    a, x = tables(spark, [("a", "c", "T", "upcoming", "2026-09-01 00:00:00", None, None, None), ("b", "d", "T", "upcoming", "2026-09-01 00:00:00", None, None, None)], [("x", "a", "gift", "G", "2026-09-03 00:00:00", None, None, None, False, False)])
    c = spark.createDataFrame([("c", "announced", "ip"), ("d", "cancelled", "ip")], "campaign_id STRING, status STRING, ip_slug STRING").select("*", F.lit("IP").alias("ip_name"), F.lit("Title").alias("title"), F.lit(None).cast("string").alias("redirected_to"))
    points = schedule.schedule_points(a, x)
    jobs = schedule.future_jobs(points, schedule.open_activities(a, c), instant("2026-08-20 00:00:00"))
    assert {r["campaign_id"] for r in jobs.collect()} == {"c"}
    late = schedule.schedule_points(a, x.withColumn("at", F.col("at") + F.expr("INTERVAL 2 HOURS")))
    assert schedule.valid_jobs(jobs, late, schedule.open_activities(a, c)).select("action_id").collect()[0][0] == "a--start"
    stored = jobs.withColumns({"candidate_id": F.lit(None).cast("string"), "campaign_notice": F.lit(False)})
    none = spark.createDataFrame([], "job_id STRING, delivery_day DATE")
    items, skipped = due.collect_due(stored, none, late, a, c, F.lit("2026-09-03").cast("date"), instant("2026-09-03 00:30:00"))
    assert items.count() == 0 and {r["skipped"] for r in skipped.collect()} == {"changed", "passed"}
    items, _ = due.collect_due(stored, none, points, a, c, F.lit("2026-09-03").cast("date"), instant("2026-09-02 20:00:00"))
    assert [r["summary"] for r in items.collect()] == ["今天需要关注：G"]


def test_retention_keeps_unsent_jobs_and_day_six(spark):
    jobs = spark.createDataFrame([("old-sent", "2026-08-24"), ("old-open", "2026-08-24"), ("edge", "2026-08-25")], "job_id STRING, due_date STRING").withColumn("due_date", F.col("due_date").cast("date"))
    sent = spark.createDataFrame([("old-sent",), ("edge",)], "job_id STRING")
    assert {r["job_id"] for r in views.retain_jobs(jobs, sent, F.lit("2026-08-31").cast("date")).collect()} == {"old-open", "edge"}


def test_second_digest_of_a_day_changes_nothing(spark):
    frozen = spark.createDataFrame([("j1", None, "c", True, "k")], "job_id STRING, candidate_id STRING, campaign_id STRING, campaign_notice BOOLEAN, semantic_key STRING").withColumn("delivery_day", F.lit("2026-08-31").cast("date"))
    day = F.lit("2026-08-31").cast("date")
    none = spark.createDataFrame([], "job_id STRING, delivery_day DATE")
    first = due.day_receipts(frozen, none, instant("2026-08-31 13:00:00"), day)
    assert {r["job_id"] for r in first.collect()} == {"j1", "daily-digest-2026-08-31"}
    assert due.day_receipts(frozen, first.select("job_id", "delivery_day"), instant("2026-08-31 15:00:00"), day).count() == 0
    again = due.freeze_day(frozen.withColumn("job_id", F.lit("j2")).drop("delivery_day"), frozen, day)
    assert [r["job_id"] for r in again.collect()] == ["j1"]


def test_due_jobs_deal_only_the_points_they_name(spark):
    """Points of activities that no due job names leave where they are made, before the join deals them again."""
    from marquee.plans import reminders
    from marquee.plans.stand_ins import Tables

    items, _ = reminders._due(Tables(spark, "/root/testdata/sf0.001"))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[:plan.index("Window")]
