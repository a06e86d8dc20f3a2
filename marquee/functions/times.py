"""Zone-aware times. Instants are UTC timestamps, days are dates, and no day becomes midnight in a fact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.constants import DEFAULT_ZONE, HOUR_PENDING, TIME_PENDING, UTC_DEADLINE
from marquee.functions.text import col

ISO_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})$"


def local_time(ts: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    return F.from_utc_timestamp(col(ts), zone)


def local_day(ts: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    return F.to_date(local_time(ts, zone))


def local_midnight(day: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    return F.to_utc_timestamp(col(day).cast("timestamp"), zone)


def instant(text: str) -> Column:
    """A literal UTC instant."""
    return F.lit(text).cast("timestamp")


def iso_local(ts: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    """ISO text of the local time with its offset; fraction only when there is one."""
    value = col(ts)
    local = local_time(value, zone)
    shift = F.unix_seconds(local) - F.unix_seconds(value)
    size = F.abs(shift)
    offset = F.concat(F.when(shift < 0, "-").otherwise("+"),
                      F.lpad(F.floor(size / 3600).cast("string"), 2, "0"), F.lit(":"),
                      F.lpad(F.floor(size % 3600 / 60).cast("string"), 2, "0"))
    micros = F.date_format(local, "SSSSSS")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), offset)


def display_time(ts: Column | str, day: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    return F.coalesce(F.date_format(local_time(ts, zone), "yyyy-MM-dd HH:mm"),
                      F.concat(col(day).cast("string"), F.lit(HOUR_PENDING)), F.lit(TIME_PENDING))


def has_zone(text: Column | str) -> Column:
    """True for an ISO text that names its offset."""
    return F.coalesce(col(text).rlike(ISO_ZONED), F.lit(False))


def epoch_time(value: Column | str) -> Column:
    return F.timestamp_seconds(F.try_to_number(F.trim(col(value).cast("string")), F.lit("99999999999999")).cast("bigint"))


def feed_time(text: Column | str) -> Column:
    """``Sun Aug 30 10:00:00 +0800 2026``; the week day name carries no information."""
    return F.try_to_timestamp(F.regexp_replace(col(text), "^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))


def news_time(text: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    """ISO text; without an offset it is local time."""
    value = F.regexp_replace(col(text), "T", " ")
    return F.when(has_zone(text), F.try_to_timestamp(col(text))).otherwise(
        F.to_utc_timestamp(F.try_to_timestamp(value), zone))


def explicit_deadline(quote: Column, rules: Column) -> Column:
    """The one fully written UTC deadline of a cited quote that the rules repeat, else null."""
    found = F.regexp_extract_all(quote, F.lit(UTC_DEADLINE), 0)
    first = F.element_at(found, 1)
    number = lambda i: F.regexp_extract(first, UTC_DEADLINE, i).cast("int")
    wall = F.make_timestamp(number(1), number(2), number(3), number(4), number(5), F.lit(0))
    shifted = F.timestamp_seconds(F.unix_seconds(wall) - number(6) * 3600)
    return F.when((F.size(found) == 1) & F.contains(rules, first), shifted)


LOCAL_CLOCK = r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"


def nest_time(at: Column, day: Column, zone: str = DEFAULT_ZONE) -> Column:
    """Flat instant and day to one ``{date, time, timezone}`` value; the instant wins."""
    local = local_time(at, zone)
    nested = lambda d, t: F.struct(d.alias("date"), t.alias("time"), F.lit(zone).alias("timezone"))
    return F.when(at.isNotNull(), nested(F.date_format(local, "yyyy-MM-dd"), F.date_format(local, "HH:mm:ss"))).when(
        day.isNotNull(), nested(F.date_format(day, "yyyy-MM-dd"), F.lit(None).cast("string")))


def nested_time_ok(nested: Column, zone: str = DEFAULT_ZONE) -> Column:
    day_ok = F.try_to_date(nested["date"], "yyyy-MM-dd").isNotNull()
    clock_ok = nested["time"].isNull() | nested["time"].rlike(LOCAL_CLOCK)
    return nested.isNull() | F.coalesce(day_ok & (nested["timezone"] == zone) & clock_ok, F.lit(False))


def flat_instant(nested: Column, zone: str = DEFAULT_ZONE) -> Column:
    return F.when(nested["time"].isNotNull(), F.to_utc_timestamp(
        F.try_to_timestamp(F.concat_ws(" ", nested["date"], nested["time"])), zone))


def flat_day(nested: Column) -> Column:
    return F.when(nested["time"].isNull(), F.try_to_date(nested["date"], "yyyy-MM-dd"))


def nest_path(path: Column) -> Column:
    """Claim path of a flat time field to the path of its nested value."""
    return F.regexp_replace(F.regexp_replace(path, r"\.(at|start_at|start_date)$", ".start"),
                            r"\.(end_at|end_date)$", ".end")


def flat_path(path: Column, start: Column, end: Column) -> Column:
    """Claim path of a nested value to the flat field that holds it after conversion."""
    base = F.regexp_extract(path, r"^(.*)\.(?:start|end)(?:\.|$)", 1)
    on_action = F.contains(path, F.lit(".actions["))
    is_start = path.rlike(r"\.start(\.|$)")
    timed = lambda v: v["time"].isNotNull()
    start_field = F.when(timed(start), F.when(on_action, "at").otherwise("start_at")).otherwise("start_date")
    end_field = F.when(timed(end), "end_at").otherwise("end_date")
    return F.when(path.rlike(r"\.(start|end)(\.|$)"),
                  F.concat(base, F.lit("."), F.when(is_start, start_field).otherwise(end_field))).otherwise(path)
