"""Facts that travel by entity give what facts that travel one by one give."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from marquee.operators import notices

FACTS = [("c", "campaign", "状态", "active"), ("c", "a", "活动", "T"), ("c", "a", "状态", "active"), ("c", "a", "规则", 'say "]," twice'), ("c", "a", "地点:city", "Rome"),
         ("c", "x", "事项", "I"), ("c", "x", "规则", "new"), ("c", "x", "已取消", "False"), ("c", "x", "已结束", "True"), ("d", "y", "时间", "1998-01-02"), ("d", "y", "规则", "R")]
OLD = [("c", "campaign", "状态", "ended"), ("c", "a", "活动", "T"), ("c", "a", "规则", "old"), ("c", "x", "规则", "older"), ("c", "x", "规则", "old"), ("c", "x", "已取消", "True"), ("c", "gone", "规则", "old")]
TITLES = [("c", "campaign", "C", "campaign"), ("c", "a", "T", "a"), ("c", "x", "T / I", "a"), ("d", "y", None, None)]


def whole(rows):
    """Rows of entities; what is told of places comes in a row of its own, as from venues."""
    return rows.groupBy("campaign_id", "entity_id", F.col("label").startswith("地点").alias("p")).agg(notices.packed(F.collect_list(F.struct("label", "value"))).alias("facts")).drop("p")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_entities_tell_the_same_news(spark):
    facts = "campaign_id STRING, entity_id STRING, label STRING, value STRING"
    now, old = spark.createDataFrame(FACTS, facts), spark.createDataFrame(OLD, facts)
    titles = spark.createDataFrame(TITLES, "campaign_id STRING, entity_id STRING, entity_title STRING, scope STRING")
    shown = spark.createDataFrame([("d", "1月2日")], "campaign_id STRING, public_text STRING")
    current = whole(now).join(titles, ["campaign_id", "entity_id"])
    by_row, by_entity = notices.fact_delta(now, old, shown), notices.entity_delta(current, whole(old), shown)
    news = [*notices.FACT, "old_value"]
    assert rows_of(by_row, *news) == rows_of(notices.unpacked(by_entity, notices.NEWS), *news) and by_row.count() == 9
    lines = ["campaign_id", "scope", "entity_id", "title", "label", "display"]
    assert rows_of(notices.described(by_row, titles), *lines) == rows_of(notices.described(by_entity), *lines)
    sent = lambda rows: rows.withColumn("job_id", F.lit("j")).withColumn("sent_at", F.lit("2024-01-01").cast("timestamp"))
    assert rows_of(notices.last_delivered(sent(old)), *notices.FACT) == rows_of(notices.unpacked(notices.last_delivered(sent(whole(old)))), *notices.FACT)


def test_notices_deal_entities_not_facts(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = contract.queries()["notice_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert not any("label" in line or "value#" in line or "_same" in line for line in dealt)
    assert sum("scope#" in line.split("hashpartitioning")[1] for line in dealt) == 1
