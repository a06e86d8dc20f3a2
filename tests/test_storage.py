"""Tables, sinks, pages, feeds, streams and plan shapes."""

import io
import json
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from marquee.functions.times import instant
from marquee.plans import publishing
from marquee.plans.stand_ins import Tables
from marquee.operators import due
from marquee.sources import extraction, feeds, pages, registry, sinks, tables
from marquee.sources.pages import read_page
from marquee.streaming import intake as streams


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_buckets_prune_and_replace(spark, tmp_path):
    path = str(tmp_path / "jobs")
    rows = spark.createDataFrame([("a", "2026-08-01"), ("b", "2026-08-02"), ("c", "2026-08-02")], "job_id STRING, due_date STRING").withColumn("due_date", F.col("due_date").cast("date"))
    tables.write_buckets(rows, path, "due_date")
    stored = tables.scan(spark, path, "job_id STRING, due_date DATE")
    one = tables.bucket(stored, "due_date", "2026-08-01")
    assert [r["job_id"] for r in one.collect()] == ["a"] and "PartitionFilters: [isnotnull(due_date" in plan(one)
    moved = rows.where("job_id = 'b'").withColumn("due_date", F.lit("2026-08-01").cast("date"))
    touched = tables.touched_buckets(stored, moved, "job_id", "due_date")
    assert touched.count() == 2
    after = tables.upsert(stored, moved, "job_id")
    assert {(r["job_id"], str(r["due_date"])) for r in after.collect()} == {("a", "2026-08-01"), ("b", "2026-08-01"), ("c", "2026-08-02")}


def test_views_refuse_secrets(spark, tmp_path):
    df = spark.createDataFrame([("c", "mail to someone@example.org", ["x"])], "campaign_id STRING, text STRING, tags ARRAY<STRING>")
    with pytest.raises(sinks.SecretFound):
        sinks.write_view(df, str(tmp_path / "v"), ["campaign_id"], ["someone@example.org"])
    sinks.write_view(df, str(tmp_path / "v"), ["campaign_id"], ["short"])
    assert spark.read.text(str(tmp_path / "v")).count() == 1


@pytest.mark.parametrize("markup, text, images, links", [
    ("<p>A<br>B</p><script>no</script>C&nbsp;D", "A\nB\nC D", [], []),
    ("<nav><p>menu<a href='https://n.org'>x</a></p></nav><div>t<img src='https://i.org/1'><img src='/r'><a href='https://l.org'>go</a></div>", "tgo", ["https://i.org/1"], ["https://l.org"]),
    ("<header><div>h</div></header>a</header>b<li>c<li>d", "ab\nc\nd", [], []),
    ("x<iframe><p>y</iframe>z", "xz", [], []),
])
def test_pages(markup, text, images, links):
    assert read_page(markup, False, "https://") == (text, images, links)


def test_paragraph_mode(spark):
    markup = "<div>skip<p>keep <img src='https://web.hycdn.cn/upload/image/a'><img src='https://o.org/b'></p>skip<h2>head</h2></div>"
    assert read_page(markup, True, "https://web.hycdn.cn/upload/image/") == ("keep\nhead", ["https://web.hycdn.cn/upload/image/a"], [])
    assert spark.createDataFrame([(markup,), (None,)], "h STRING").select(pages.page_material("h")["text"]).count() == 2


def test_feed_problems_are_kept(spark):
    body = '{"ok":1,"data":{"cards":[{"card_type":9,"mblog":{"id":1,"created_at":"bad","text":"x"}},{"card_type":9,"mblog":{"id":2,"created_at":"Sun Aug 30 10:00:00 +0800 2026","text":"cut","isLongText":true}}]}}'
    landed = spark.createDataFrame([(body, "acc", "Acc")], "payload STRING, account_id STRING, account_name STRING").withColumn("first_seen_at", instant("2026-09-01 00:00:00"))
    got = {r["obs_id"]: r["problem"] for r in feeds.microblog_posts(landed).collect()}
    assert got == {"weibo-1": "unsupported publication time", "weibo-2": "long post content was not found"}


def test_builtin_registry(spark):
    asked = spark.createDataFrame([(0, "HSR"), (1, "原神"), (2, "genshin"), (3, "nobody")], "position INT, requested STRING")
    table = registry.builtin_registry(spark)
    assert {r["slug"]: r["position"] for r in registry.resolve(asked, table).collect()} == {"honkai-star-rail": 0, "genshin-impact": 1}
    assert [r[0] for r in registry.unsupported(asked, table).collect()] == ["nobody"]


def test_stream_repeats_and_edits(spark, tmp_path):
    schema = "obs_id STRING, content_hash STRING, published_at TIMESTAMP"
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, "obs_id STRING, content_hash STRING, t STRING").select("obs_id", "content_hash", F.col("t").cast("timestamp").alias("published_at")).coalesce(1).write.mode("append").parquet(land)
    stream = lambda: streams.once_per_version(streams.landing(spark, land, schema))
    put([("a", "1", "2026-08-30 01:00:00"), ("a", "1", "2026-08-30 01:00:00")])
    streams.drain(stream(), out)
    put([("a", "1", "2026-08-30 02:00:00"), ("a", "2", "2026-08-30 03:00:00")])
    streams.drain(stream(), out)
    assert sorted((r["obs_id"], r["content_hash"]) for r in streams.drained(spark, out, schema).collect()) == [("a", "1"), ("a", "2")]


def test_late_posts_and_local_days(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    schema = "account STRING, at TIMESTAMP"
    for batch in ([("a", "2026-01-01 15:59:00"), ("a", "2026-01-01 16:01:00")], [("a", "2026-01-02 16:30:00"), ("a", "2026-01-09 00:00:00")], [("a", "2026-01-01 01:00:00"), ("a", "2026-01-08 00:00:00")]):
        spark.createDataFrame(batch, "account STRING, s STRING").selectExpr("account", "timestamp(s) AS at").coalesce(1).write.mode("append").parquet(land)
        streams.drain(streams.daily_tally(streams.landing(spark, land, spark.createDataFrame([], schema).schema, maxFilesPerTrigger="1"), "at", ["account"]), out, "update")
    got = {r["day"]: r["n"] for r in streams.latest_per_key(streams.drained(spark, out, "day STRING, account STRING, n BIGINT"), ["day", "account"]).collect()}
    # the first day of the third file lies more than two days behind the second file and is left out
    assert got == {"2026-01-01": 1, "2026-01-02": 1, "2026-01-03": 1, "2026-01-09": 1, "2026-01-08": 1}


def test_stream_versions_keep_state(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    schema = "obs_id STRING, content_hash STRING, seen_at TIMESTAMP"
    put = lambda rows: spark.createDataFrame(rows, "obs_id STRING, content_hash STRING, t STRING").select("obs_id", "content_hash", F.col("t").cast("timestamp").alias("seen_at")).coalesce(1).write.mode("append").parquet(land)
    for rows in ([("a", "1", "2026-08-30 01:00:00"), ("b", "1", "2026-08-30 01:00:00")], [("a", "1", "2026-08-31 01:00:00"), ("b", "2", "2026-08-31 01:00:00")]):
        put(rows)
        streams.drain(streams.version_changes(streams.landing(spark, land, schema)), out)
    got = sorted((r["obs_id"], r["change"], str(r["first_seen_at"])) for r in streams.drained(spark, out, streams.VERSION).collect())
    assert got == [("a", "new", "2026-08-30 01:00:00"), ("b", "edited", "2026-08-30 01:00:00"), ("b", "new", "2026-08-30 01:00:00")]


def test_scans_read_only_what_they_need(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    text = plan(t.actions().where("l_suppkey = 3").select("action_id"))
    assert "EqualTo(l_suppkey,3)" in text and "l_extendedprice" not in text


def test_batches_run_a_job_each(spark, tmp_path):
    land, out, seen = str(tmp_path / "land"), str(tmp_path / "out"), []
    for k in range(3):
        spark.createDataFrame([(k,)], "n INT").coalesce(1).write.mode("append").parquet(land)
    streams.each_batch(streams.landing(spark, land, spark.createDataFrame([], "n INT").schema, maxFilesPerTrigger="1"), out, lambda batch, number: seen.append((number, batch.count())))
    assert seen == [(0, 1), (1, 1), (2, 1)]


def test_digest_text_keeps_the_order_of_its_lines(spark, tmp_path):
    rows = [("2026-01-02 00:00:00", "b", "j2", 0, "0", "third"), ("2026-01-01 00:00:00", "b", "j1", 1, "0", "second"), ("2026-01-01 00:00:00", "b", "j1", 0, "0", "first"), ("2026-01-02 00:00:00", "c", "j3", 0, "0", "last")]
    due.write_digest(spark.createDataFrame(rows, "card_at STRING, ip_name STRING, card_job STRING, section INT, line_key STRING, line STRING"), str(tmp_path / "d"))
    text = [line for part in sorted((tmp_path / "d").glob("part-*")) for line in part.read_text().splitlines()]
    assert text == ["first", "second", "third", "last"]


def test_answers_and_due_buckets(spark):
    answers = spark.createDataFrame([('```json\n{"relevant": true, "partner": "P"}\n```',), ("no json",)], "answer STRING")
    got = [r["extraction"] for r in extraction.parse_answers(answers).collect()]
    assert got[0]["relevant"] is True and got[0]["partner"] == "P" and (got[1] is None or got[1]["relevant"] is None)
    days = spark.sql("SELECT explode(sequence(date'2026-01-01', date'2026-01-05')) AS d")
    assert tables.due_until(days, "d", "2026-01-03").count() == 3


def test_forum_texts_that_begin_like_json(spark):
    """Only content that is JSON from end to end is read as JSON."""
    content = ["47 Of thend", '"a" b', '{"describe":"x"} tail', '{"describe":" y "}', '"z"', "12", "1, 2", "null", "[1]\n"]
    rows = [(str(i), json.dumps({"data": {"post": {"post": {"post_id": str(i), "subject": "", "created_at": 1, "content": c}}}})) for i, c in enumerate(content)]
    landed = spark.createDataFrame(rows, "post_id STRING, payload STRING").selectExpr("'a' AS account_id", "'n' AS account_name", "timestamp'2024-01-01' AS first_seen_at", "payload")
    got = {r["canonical_content_id"]: r["text"] for r in feeds.forum_posts(landed).collect()}
    assert [got[str(i)] for i in range(len(content))] == ["47 Of thend", '"a" b', '{"describe":"x"} tail', "y", "z", "", "1, 2", "", ""]


def test_batches_of_a_stream_do_not_grow_in_number(spark):
    """A table of any size lands in as many files, in order of time."""
    rows = spark.range(1_500_000).select("id", F.timestamp_seconds("id").alias("ts"))
    files = spark.read.parquet(publishing._land(Tables(spark, ""), rows, "ts")).groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n")).orderBy("lo").collect()
    assert len(files) == publishing.LANDED and sum(f["n"] for f in files) == 1_500_000
    assert all(a["hi"] < b["lo"] for a, b in zip(files, files[1:]))


def test_stream_versions_without_a_time_or_hash_come_last(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", None, "2026-08-30 01:00:00"), ("a", "1", None), ("a", "2", "2026-08-30 01:00:00")], "obs_id STRING, content_hash STRING, t STRING")
    rows.select("obs_id", "content_hash", F.col("t").cast("timestamp").alias("seen_at")).coalesce(1).write.parquet(land)
    streams.drain(streams.version_changes(streams.landing(spark, land, "obs_id STRING, content_hash STRING, seen_at TIMESTAMP")), out)
    got = [(r["content_hash"], r["change"]) for r in streams.drained(spark, out, streams.VERSION).collect()]
    assert sorted(got, key=str) == sorted([("2", "new"), (None, "edited"), ("1", "edited")], key=str)


def test_posts_that_want_no_long_text_do_not_meet_in_one_task(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        post = "named_struct('card_type', 9, 'mblog', named_struct('id', string(id), 'created_at', 'Mon Jan 01 20:00:00 +0800 2024', 'text', 'body', 'isLongText', id % 10 = 0))"
        landed = spark.range(2000).selectExpr("'a' AS account_id", "'n' AS account_name", "timestamp'2024-01-01' AS first_seen_at", f"to_json(named_struct('data', named_struct('cards', array({post})))) AS payload")
        full = feeds.long_texts(spark.range(0, 2000, 20).selectExpr("string(id) AS post_id", "to_json(named_struct('data', named_struct('longTextContent', 'full'))) AS payload"))
        posts = feeds.microblog_posts(landed, full)
        assert max(r["n"] for r in posts.select("text", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("text").alias("n"), F.max("text")).collect()) < 1000
        assert {(r["text"], r["problem"]): r["count"] for r in posts.groupBy("text", "problem").count().collect()} == {("body", None): 1800, ("full", None): 100, ("body", "long post content was not found"): 100}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
