"""The supplied tables read as announcement data.

documents are posts, pages are linked posts, orders are activities, lineitem rows are actions,
customers are campaigns (name = nation, partner = market segment), suppliers are venues, and events
are feed rows, facts and receipts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.times import instant
from marquee.sources.tables import scan

TERMS = ["license", "apache", "mit"]
ACTION_TERMS = ["copyright", "software"]
NOW = "1998-06-01 00:00:00"
EVENT_NOW = "2024-01-20 00:00:00"
POST_EPOCH = 1704067200  # 2024-01-01T00:00:00Z


class Tables:
    """Lazy access to one folder of the supplied tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return scan(self.spark, f"{self.folder}/{name}.parquet")

    @property
    def now(self):
        return instant(NOW)

    @property
    def event_now(self):
        return instant(EVENT_NOW)

    def posts(self) -> DataFrame:
        d = F.col("doc_id")
        at = F.timestamp_seconds(F.lit(POST_EPOCH) + F.pmod(d * 37, F.lit(43200)) * 60)
        return self.raw("documents").select(
            "doc_id", F.concat(F.lit("doc-"), d.cast("string")).alias("obs_id"), F.concat(F.lit("doc-"), d.cast("string")).alias("source_id"),
            F.lit("website").alias("kind"), F.concat(F.lit("https://posts.example.org/"), d.cast("string")).alias("url"),
            F.col("source").alias("account_name"), F.col("source").alias("account_id"), F.col("lang").alias("ip_slug"),
            F.when(d % 10 == 0, F.concat(F.lit("canon-"), F.floor(d / 20).cast("string"))).alias("canonical_content_id"),
            (d % 3 != 0).alias("is_official"), at.alias("published_at"), (at + F.expr("INTERVAL 1 HOUR")).alias("first_seen_at"),
            F.lit(None).cast("timestamp").alias("updated_at"), F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("string").alias("summary"),
            "text", F.col("n_chars").cast("bigint").alias("n_chars"))

    def page_posts(self) -> DataFrame:
        """Pages as posts: each links to its own address and carries one medium named by its host."""
        host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
        p = F.col("page_id")
        return self.raw("pages").select(
            F.concat(F.lit("page-"), p.cast("string")).alias("obs_id"), F.concat(F.lit("page-"), p.cast("string")).alias("source_id"),
            F.lit("website").alias("kind"), host.alias("account_id"), F.lit("web").alias("ip_slug"),
            F.lit(None).cast("string").alias("canonical_content_id"), F.timestamp_seconds(F.lit(POST_EPOCH) + p * 60).alias("published_at"),
            F.sha2("html", 256).alias("content_hash"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("text"), "html", "url",
            F.array("url").alias("outbound_urls"), F.array(F.sha2(F.regexp_extract("url", r"([^./]+\.[^./]+)/", 1), 256)).alias("media_hashes"))

    def campaigns(self) -> DataFrame:
        """Customers as campaigns of a nation; every seventh has no partner."""
        k = F.col("c_custkey")
        seen = F.timestamp_seconds(F.lit(757382400) + F.pmod(k * 7919, F.lit(1000)) * 86400)  # from 1994-01-01
        status = F.when(k % 11 == 0, "cancelled").when(k % 13 == 0, "ended").otherwise("announced")
        return self.raw("customer").select(
            F.concat(F.lit("camp-"), k.cast("string")).alias("campaign_id"), F.concat(F.lit("ip-"), F.col("c_nationkey").cast("string")).alias("ip_slug"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("ip_name"),
            F.when(k % 7 != 0, F.col("c_mktsegment")).alias("partner"), F.col("c_name").alias("title"), status.alias("status"),
            seen.alias("announced_at"), seen.alias("first_seen_at"), (seen + F.expr("INTERVAL 30 DAYS")).alias("updated_at"),
            F.lit(1).alias("revision"), F.when((k % 17 == 0) & (k > 0), F.concat(F.lit("camp-"), F.floor(k / 17).cast("string"))).alias("redirected_to"), k.alias("custkey"))

    def activities(self) -> DataFrame:
        """Orders as activities. A third is dated by instants, a third by days, a third not at all."""
        k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
        start = F.when(k % 3 == 0, F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int")))
        kind = F.element_at(F.array(*[F.lit(x) for x in ("product", "food", "popup", "exhibition", "online")]), (k % 5 + 1).cast("int"))
        status = F.when(F.col("o_orderstatus") == "F", "ended").when(k % 29 == 0, "cancelled").otherwise("upcoming")
        return self.raw("orders").select(
            F.concat(F.lit("act-"), k.cast("string")).alias("activity_id"), F.concat(F.lit("camp-"), F.col("o_custkey").cast("string")).alias("campaign_id"),
            kind.alias("kind"), F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" "), (k % 4).cast("string")).alias("title"), status.alias("status"),
            start.alias("start_at"), (start + F.expr("INTERVAL 20 DAYS")).alias("end_at"),
            F.when(k % 3 == 1, day).alias("start_date"), F.when(k % 3 == 1, F.date_add(day, 30)).alias("end_date"),
            F.when(k % 4 == 0, F.col("o_orderpriority")).alias("rules"), F.lit(None).cast("string").alias("related_offers"),
            (k % 50 == 7).alias("excluded"), k.alias("orderkey"))

    def actions(self) -> DataFrame:
        """Line items as actions; the kind follows the two flags."""
        flags = F.concat("l_returnflag", "l_linestatus")
        pairs = [("AO", "sale_open"), ("AF", "gift"), ("RO", "reservation_open"), ("NO", "event_start"), ("NF", "sale_close"), ("RF", "announcement")]
        kind = F.create_map(*[F.lit(x) for p in pairs for x in p])[flags]
        key = F.concat_ws("-", F.lit("actn"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
        timed = F.col("l_linenumber") % 2 == 0
        at = F.when(timed, F.col("l_shipdate").cast("timestamp") + F.make_interval(hours=(F.col("l_suppkey") % 24).cast("int")))
        day = F.to_date("l_shipdate")
        return self.raw("lineitem").select(
            key.alias("action_id"), F.concat(F.lit("act-"), F.col("l_orderkey").cast("string")).alias("activity_id"), kind.alias("kind"),
            F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"), at.alias("at"),
            F.when(F.col("l_quantity") > 40, at + F.expr("INTERVAL 5 DAYS")).alias("end_at"),
            F.when(~timed, day).alias("start_date"), F.when(~timed & (F.col("l_quantity") > 40), F.date_add(day, 5)).alias("end_date"),
            F.when(F.col("l_tax") > 0.06, F.concat(F.lit("tax "), F.col("l_tax").cast("string"))).alias("rules"), F.lit(None).cast("string").alias("scope"),
            F.when(F.col("l_discount") > 0.08, F.concat(F.lit("limit "), F.col("l_quantity").cast("int").cast("string"))).alias("quantity_limit"),
            F.lit(None).cast("string").alias("end_condition"), (F.col("l_discount") == 0.0).alias("cancelled"), (F.col("l_tax") == 0.0).alias("ended"),
            F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("url"),
            F.when(F.col("l_linenumber") == 1, True).alias("requires_reservation"), F.when(F.col("l_linenumber") == 2, False).alias("requires_rush"),
            "l_orderkey", "l_suppkey")

    def venues(self) -> DataFrame:
        """One venue per distinct supplier of an order: its nation is the city, every 19th is online, every 23rd nationwide."""
        s = F.col("s_suppkey")
        places = self.raw("supplier").select(
            s.alias("l_suppkey"), F.concat(F.lit("CITY_"), F.col("s_nationkey").cast("string")).alias("city"), F.col("s_name").alias("name"),
            F.when(s % 19 == 0, "webshop").alias("online_platform"), (s % 23 == 0).alias("nationwide"))
        held = self.raw("lineitem").select("l_orderkey", "l_suppkey").distinct()
        return held.join(places, "l_suppkey").select(
            F.concat_ws("-", F.lit("ven"), F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("venue_id"),
            F.concat(F.lit("act-"), F.col("l_orderkey").cast("string")).alias("activity_id"), "name", "city", "online_platform", "nationwide",
            F.lit(None).cast("string").alias("province"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("business_hours"))

    def feed(self) -> DataFrame:
        """Events as rows of 50 source feeds."""
        return self.raw("events").select(
            F.lit("website").alias("kind"), F.concat(F.lit("acc-"), (F.col("user_id") % 50).cast("string")).alias("account_id"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("post_id"), F.col("ts").cast("timestamp").alias("published_at"), "event_type", "value")

    def proposals(self) -> DataFrame:
        """Events as proposed facts of a user, by event type; minutes make equal times possible."""
        return self.raw("events").select(
            F.concat(F.lit("camp-"), F.col("user_id").cast("string")).alias("campaign_id"), F.col("event_type").alias("field_path"),
            F.floor("value").cast("bigint").cast("string").alias("value"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("published_at"), "event_id")

    def receipts(self) -> DataFrame:
        """Events as delivered facts: one receipt per event."""
        return self.raw("events").select(
            F.concat(F.lit("r-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("job_id"),
            F.concat(F.lit("camp-"), F.col("user_id").cast("string")).alias("campaign_id"), F.lit("entity").alias("entity_id"),
            F.col("event_type").alias("label"), F.format_string("%.2f", "value").alias("value"), F.col("ts").cast("timestamp").alias("sent_at"),
            F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai")).alias("delivery_day"))
