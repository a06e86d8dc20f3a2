"""What is left out before rows are dealt changes no job."""

import random

from pyspark.sql import functions as F

from marquee.functions.times import instant
from marquee.operators import schedule

NOW = "2026-09-01 10:00:00"
KINDS = ["sale_open", "event_start", "reservation_open", "announcement"]


def tables(spark, odd):
    """Activities and actions around NOW; with ``odd`` some have a day to come and an instant that is over."""
    rng = random.Random(6)
    at = lambda: rng.choice([None, f"2026-08-{rng.randrange(29, 32)} 1{rng.randrange(2)}:00:00", f"2026-09-0{rng.randrange(1, 3)} 1{rng.randrange(2)}:00:00"])
    day = lambda a: None if a and not odd else rng.choice([None, f"2026-08-{rng.randrange(30, 32)}", f"2026-09-0{rng.randrange(1, 4)}"])
    pair = lambda: (lambda a, b: (a, b, day(a), day(b)))(at(), at())
    acts = [(f"a{i}", "c", "t", rng.choice(["upcoming", "upcoming", "ended"]), *pair()) for i in range(120)]
    acts += [(f"z{i}", "c", "t", "upcoming", "2026-08-30 10:00:00", None, "2026-09-02" if odd else None, None) for i in range(3)]
    moves = [(f"x{i}", f"a{rng.randrange(120)}", rng.choice(KINDS), "t", False, False, *pair()) for i in range(400)]
    moves += [(f"y{i}", f"z{i}", "event_start", "t", False, False, "2026-08-30 10:00:00", None, None, None) for i in range(2)]
    ends = lambda first: f"{first} string, end_at string, start_date string, end_date string"
    cast = lambda df, first: df.withColumns({c: F.col(c).cast("timestamp" if c.endswith("at") else "date") for c in (first, "end_at", "start_date", "end_date")})
    return (cast(spark.createDataFrame(acts, "activity_id string, campaign_id string, title string, status string, " + ends("start_at")), "start_at"),
            cast(spark.createDataFrame(moves, "action_id string, activity_id string, kind string, title string, cancelled boolean, ended boolean, " + ends("at")), "at"))


def test_coming_points_make_the_same_jobs(spark):
    for odd in (False, True):
        a, x = tables(spark, odd)
        owners = schedule.still_open(a).select("activity_id", "campaign_id")
        every = schedule.schedule_points(a, x)
        coming = schedule.coming_points(schedule.still_open(a), x, instant(NOW))
        jobs = [sorted(map(tuple, schedule.future_jobs(p, owners, instant(NOW)).collect()), key=repr) for p in (every, coming)]
        assert jobs[0] == jobs[1] and jobs[0]
        assert odd or coming.where(F.col("at") < "2026-08-31 16:00:00").isEmpty() and not every.where(F.col("at") < "2026-08-31 16:00:00").isEmpty()


def test_valid_jobs_do_not_deal_all_points(spark):
    a, x = tables(spark, False)
    owners, points = schedule.still_open(a).select("activity_id", "campaign_id"), schedule.schedule_points(a, x)
    jobs = schedule.future_jobs(points, owners, instant(NOW)).localCheckpoint()
    late = jobs.withColumn("job_id", F.concat(F.lit("late-"), "job_id")).withColumn("expected_at", F.col("expected_at") + F.expr("INTERVAL 7 MINUTES"))
    closed = jobs.withColumns({"job_id": F.concat(F.lit("closed-"), "job_id"), "activity_id": F.lit("nobody")})
    free = jobs.limit(1).withColumns({"job_id": F.lit("free"), "action_id": F.lit(None).cast("string")})
    out = schedule.valid_jobs(jobs.unionByName(late).unionByName(closed).unionByName(free), points, owners)
    assert sorted(r["job_id"] for r in out.collect()) == sorted([r["job_id"] for r in jobs.collect()] + ["free"])
    assert schedule.valid_jobs(free, points, owners).count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "2026-" in plan  # the points are bounded by the instants of the jobs
