"""Dated points of activities, reminder jobs, and keeping stored jobs in step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.ids import job_key
from marquee.functions.times import iso_local, local_day, local_midnight
from marquee.session import materialize

POINT = ["activity_id", "action_id", "kind", "title", "at", "start_date", "is_deadline"]


def schedule_points(activities: DataFrame, actions: DataFrame, zone: str = C.DEFAULT_ZONE, wanted: Column | None = None) -> DataFrame:
    """All dated points: open remindable actions, their derived ends, and activity starts and ends.

    A day without an hour becomes local midnight here and nowhere else. An activity's own start or
    end is left out where a point at that instant already plays the same role. With ``wanted``, a condition on ``at``, only points that
    meet it are made; as roles are compared at one instant, these are the same as without it.
    """
    moment = lambda at, day: F.coalesce(F.col(at), local_midnight(day, zone))

    def both(df: DataFrame, first: dict[str, Column], last: dict[str, Column]) -> DataFrame:
        """Start and end points of every row from one pass over the table."""
        point = lambda parts: F.struct(*[parts[k].alias(k) for k in ("action_id", "kind", "title", "at", "start_date")])
        wide = df.select("activity_id", point(first).alias("first"), point(last).alias("last"))
        rows = wide.unpivot(["activity_id"], ["first", "last"], "side", "point").where("point.at is not null")
        return rows.select("activity_id", "point.*").withColumn("is_deadline", F.col("kind").isin(C.DEADLINE_KINDS)).select(*POINT)

    suffixed = lambda name, text: F.concat(name, F.lit(text))
    usable = actions.where(~F.coalesce("cancelled", F.lit(False)) & ~F.coalesce("ended", F.lit(False)) & F.col("kind").isin(C.REMINDABLE_KINDS))
    closing = F.when(F.col("kind") == "reservation_open", "reservation_close").when(F.col("kind") == "sale_open", "sale_close").otherwise("event_end")
    points = both(usable,
                  {"action_id": F.col("action_id"), "kind": F.col("kind"), "title": F.col("title"), "at": moment("at", "start_date"), "start_date": F.col("start_date")},
                  {"action_id": suffixed("action_id", "--end"), "kind": closing, "title": suffixed("title", C.DEADLINE_SUFFIX), "at": moment("end_at", "end_date"),
                   "start_date": F.col("end_date")})
    extra = both(activities,
                 {"action_id": suffixed("activity_id", "--start"), "kind": F.lit("event_start"), "title": suffixed("title", C.START_SUFFIX),
                  "at": moment("start_at", "start_date"), "start_date": F.col("start_date")},
                 {"action_id": suffixed("activity_id", "--end"), "kind": F.lit("event_end"), "title": suffixed("title", C.END_SUFFIX),
                  "at": moment("end_at", "end_date"), "start_date": F.col("end_date")})
    # actions are read once: an activity's own point stays where no action has one of the same role at that instant
    both_sides = points.withColumn("_own", F.lit(False)).unionByName(extra.withColumn("_own", F.lit(True)))
    both_sides = both_sides if wanted is None else both_sides.where(wanted)
    alone = F.min("_own").over(W.partitionBy("activity_id", "at", "is_deadline"))
    return both_sides.withColumn("_alone", alone).where("not _own or _alone").select(*POINT)


def wording(kind: Column, title: Column) -> Column:
    prefix = reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), list(C.SUMMARY_PREFIX.items())[1:],
                    F.when(kind == list(C.SUMMARY_PREFIX)[0], list(C.SUMMARY_PREFIX.values())[0]))
    return F.concat(prefix.when(kind.isin(C.DEADLINE_KINDS), C.SUMMARY_DEADLINE).otherwise(C.SUMMARY_OTHER), title)


def still_open(activities: DataFrame) -> DataFrame:
    """Activities that are not closed themselves, whatever their campaign is."""
    return activities.where(~F.col("status").isin(C.CLOSED))


def open_activities(activities: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Activities that are open inside campaigns that are open: activity_id, campaign_id."""
    heads = campaigns.where(~F.col("status").isin(C.CLOSED)).select("campaign_id")
    return still_open(activities).select("activity_id", "campaign_id").join(heads, "campaign_id", "left_semi")


def future_jobs(points: DataFrame, owners: DataFrame, now: Column, zone: str = C.DEFAULT_ZONE, remind_day_before: bool = True) -> DataFrame:
    """One reminder per coming point of an open activity, due on the local day before it."""
    today = local_day(now, zone)
    ahead = F.when(F.col("start_date").isNotNull(), F.col("start_date") >= today).otherwise(F.col("at") > now)
    rows = points.where(ahead).join(owners, "activity_id") if remind_day_before else points.where(F.lit(False)).join(owners, "activity_id")
    kind = F.when(F.col("is_deadline"), "deadline").otherwise("day_before")
    key = F.concat_ws(":", F.lit("schedule"), "activity_id", "action_id", kind, iso_local("at", zone))
    return rows.select(job_key(key).alias("job_id"), "campaign_id", "activity_id", "action_id", kind.alias("kind"),
                       F.date_sub(local_day("at", zone), 1).alias("due_date"), F.col("at").alias("expected_at"),
                       F.col("start_date").alias("expected_date"), key.alias("semantic_key"), wording(F.col("kind"), F.col("title")).alias("summary"))


def coming_points(activities: DataFrame, actions: DataFrame, now: Column, zone: str = C.DEFAULT_ZONE) -> DataFrame:
    """The points of :func:`schedule_points` from which :func:`future_jobs` makes jobs, and perhaps more.

    Those before today are left out before anything is dealt, unless some row has a day to come and an instant that is over: a point counts by its day,
    but its role is told by its instant.
    """
    start = local_midnight(local_day(now, zone), zone)
    odd = lambda at, day: F.coalesce((F.col(at) < start) & (F.col(day) >= local_day(now, zone)), F.lit(False))
    strange = reduce(DataFrame.unionByName, [df.where(odd(a, "start_date") | odd("end_at", "end_date")).select(F.lit(1).alias("n")) for df, a in ((activities, "start_at"), (actions, "at"))])
    return schedule_points(activities, actions, zone, F.col("at") >= start if strange.isEmpty() else None)


def change_jobs(changes: DataFrame, zone: str = C.DEFAULT_ZONE) -> DataFrame:
    """Jobs for change records: an announcement for a new campaign, an update otherwise, none for a source."""
    key = F.concat(F.lit("change:"), "semantic_key")
    return changes.where("kind <> 'source_added'").select(
        job_key(key).alias("job_id"), "campaign_id", "activity_id", "change_id",
        F.when(F.col("kind") == "new_campaign", "announcement").otherwise("update").alias("kind"),
        local_day("detected_at", zone).alias("due_date"), key.alias("semantic_key"), "summary")


def reuse_job_ids(desired: DataFrame, stored: DataFrame) -> DataFrame:
    """Keep the id of a stored job for the same point, so its receipt still counts."""
    key = ["activity_id", "action_id", "expected_at", "kind"]
    first = F.struct("due_date", "job_id", "semantic_key")
    # two aggregates, so that who needs the ids alone moves no long keys
    old = stored.where("action_id is not null").groupBy(*key).agg(F.min(F.struct("due_date", "job_id")).alias("_o"), F.min_by("semantic_key", first).alias("_k"))
    rows = desired.join(old, key, "left")
    return rows.withColumn("job_id", F.coalesce("_o.job_id", "job_id")).withColumn("semantic_key", F.coalesce("_k", "semantic_key")).select(*desired.columns)


def reconcile(desired: DataFrame, stored: DataFrame, manifest: DataFrame, owners: DataFrame) -> DataFrame:
    """What to do with every job id: (job_id, campaign_id, change) with change in keep, add, delete.

    ``manifest`` is (campaign_id, job_id) of the previous compile; ``owners`` is (activity_id,
    campaign_id) of all stored activities. An obsolete job stays when its activity now belongs to
    another campaign, whose own compile takes it over.
    """
    wanted = materialize(reuse_job_ids(desired, stored).select("job_id", "campaign_id"))  # read twice, joined once
    have = stored.select("job_id", F.lit(True).alias("_have"))
    wants = wanted.join(have, "job_id", "left").select(
        "job_id", "campaign_id", F.when(F.col("_have"), "keep").otherwise("add").alias("change"))
    gone = manifest.join(wanted.select("job_id"), "job_id", "left_anti")
    # what is gone is found first: only that looks for its owner
    place = gone.join(stored.select("job_id", "activity_id"), "job_id")
    elsewhere = place.join(owners.select("activity_id", F.col("campaign_id").alias("_owner")), "activity_id").where("_owner <> campaign_id").select("job_id")
    drop = gone.join(elsewhere, "job_id", "left_anti").select("job_id", "campaign_id", F.lit("delete").alias("change"))
    return wants.unionByName(drop)


def manifest_of(wanted: DataFrame, campaigns: DataFrame) -> DataFrame:
    return wanted.join(campaigns.select("campaign_id", "revision"), "campaign_id").select("campaign_id", "revision", "job_id", "due_date")


def reparent(jobs: DataFrame, activities: DataFrame) -> DataFrame:
    """Jobs whose activity moved follow it to the campaign that holds it now."""
    owner = activities.groupBy("activity_id").agg(F.min("campaign_id").alias("_owner"))
    return jobs.join(owner, "activity_id", "left").withColumn("campaign_id", F.coalesce("_owner", "campaign_id")).drop("_owner")


def valid_jobs(jobs: DataFrame, points: DataFrame, owners: DataFrame) -> DataFrame:
    """Jobs without an action, and jobs whose point still stands at the same instant in an open activity.

    ``jobs`` is a stored table: it is asked first between which instants its points can lie.
    """
    low, high = jobs.where("action_id is not null").agg(F.min("expected_at"), F.max("expected_at")).first()
    inside = F.col("at").between(F.lit(low), F.lit(high)) if low is not None else F.lit(False)
    live = points.where(inside).select("activity_id", "action_id", F.col("at").alias("expected_at"))
    free = jobs.where("action_id is null")
    # jobs meet the points, then owners are asked for the jobs that are left, not for all points
    stand = jobs.where("action_id is not null").join(live, ["activity_id", "action_id", "expected_at"], "left_semi").join(owners.select("activity_id"), "activity_id", "left_semi")
    return free.unionByName(stand.select(*jobs.columns))
