"""Hand vectors for text, address, time and evidence functions."""

import pytest
from pyspark.sql import functions as F

from marquee.functions import times
from marquee.functions.evidence import aligned, quote_matches
from marquee.functions.ids import set_digest
from marquee.functions.text import already_shown, bigrams, fold, jaccard, strip_code_fence, strip_markup
from marquee.functions.urls import canonical_url
from marquee.operators.screening import named_crossovers, screen


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).head()[0]


@pytest.mark.parametrize("raw, expected", [
    ("https://EXAMPLE.com/event/?utm_source=x&id=7#top", "https://example.com/event?id=7"),
    ("HTTP://Shop.Example.com/A/B/", "http://shop.example.com/A/B"),
    ("https://e.com/?b=2&a=1&SPM=9", "https://e.com?b=2&a=1"),
    ("https://e.com/x?flag=&from=y", "https://e.com/x?flag="),
    ("https://e.com/x?q=a%20b~c*", "https://e.com/x?q=a+b~c%2A"),
])
def test_canonical_url(spark, raw, expected):
    assert one(spark, canonical_url("u"), u=raw) == expected


def test_fold_and_shingles(spark):
    assert one(spark, fold("t"), t=" Ab-c，联动 1.\n") == "abc联动1"
    assert one(spark, F.array_sort(bigrams("t")), t="abcab") == ["ab", "bc", "ca"]
    assert one(spark, bigrams("t"), t="a!") == ["a"]
    assert one(spark, bigrams("t"), t="!!") == []
    assert one(spark, jaccard(bigrams("a"), bigrams("b")), a="abcd", b="abce") == pytest.approx(0.5)
    assert one(spark, jaccard(bigrams("a"), bigrams("b")), a="", b="abc") == 0.0


def test_markup_and_fences(spark):
    assert one(spark, strip_markup("t"), t=" <b>A &amp; B</b>&hellip; ") == "A & B…"
    assert one(spark, strip_code_fence("t"), t="```JSON\n{}\n```") == "{}"
    assert one(spark, strip_code_fence("t"), t=" {} ") == "{}"


@pytest.mark.parametrize("quote, text, expected", [
    ("7月1日开售", "活动将于7月1日开售。", True),
    ("“联动套餐”", "推出「联动套餐」", True),
    ("限定套餐，全国门店同步上线", "限定套餐 全国门店同步上线！", True),
    ("开售", "本次不开售", False),
    ("开售", "先不开售，后开售", True),
    ("7月1日开售", "7月2日开售", False),
    ("，。！", "你好，。！", False),
    ("", "text", False),
    ("全国门店同步上线限定套餐", "全国门店（一）、（二）、（三）同步上线限定套餐", False),
])
def test_quotes(spark, quote, text, expected):
    assert aligned(quote, text) is expected
    assert spark.createDataFrame([(quote, text)], "q STRING, t STRING").select(quote_matches("q", "t")).first()[0] is expected


@pytest.mark.parametrize("line, count", [
    ("原神 × 肯德基 联动", 1), ("肯德基×原神", 1), ("《原神》×《kfc》", 1), ("原神 x pizza", 1), ("原神x肯德基", 1), ("genshin × 必胜客", 1),
    ("原神 ×800份", 0), ("800份×原神", 0), ("原神x2", 0), ("原神 和 肯德基", 0), ("原神\n× 肯德基", 0), ("mygenshin2 x kfc2", 0), ("×原神", 0),
])
def test_crossovers(spark, line, count):
    found = one(spark, named_crossovers(F.lower("m"), F.array(F.lit("原神"), F.lit("Genshin"))), m=line)
    assert (len(found) > 0) == (count > 0), found


def test_screen_needs_terms_and_a_reason_to_belong(spark):
    rows = spark.createDataFrame([("a", "某店联动 预约", False), ("b", "原神联动", False), ("c", "今日联名", True), ("d", "原神更新", True)], "obs_id STRING, text STRING, is_official BOOLEAN")
    got = {r["obs_id"]: (r["relevant"], r["score"]) for r in screen(rows, F.array(F.lit("原神"))).collect()}
    assert got == {"a": (False, 4), "b": (True, 5), "c": (True, 4), "d": (False, 3)}


@pytest.mark.parametrize("value, text, expected", [
    ("2026-08-30T10:00:00+08:00", "8月30日 10:00开始", True), ("2026-08-30T10:00:00+08:00", "8月30日开始", False),
    ("2026-08-05", "08月05日", True), ("2026-08-05", "8月5日", True), ("2026-08-05", "9月5日", False), ("限 量", "限量100份", True),
    ("2026-08-30T09:05:00+08:00", "8月30日 9:05", True),
])
def test_already_shown(spark, value, text, expected):
    assert one(spark, already_shown(F.col("v"), F.col("t")), v=value, t=text) is expected


def test_times(spark):
    at = times.instant("2026-08-30 02:00:00")
    assert one(spark, times.iso_local(at)) == "2026-08-30T10:00:00+08:00"
    assert str(one(spark, times.local_day(times.instant("2026-08-30 16:00:00")))) == "2026-08-31"
    assert str(one(spark, times.local_midnight(F.lit("2026-08-31").cast("date")))) == "2026-08-30 16:00:00"
    assert str(one(spark, times.feed_time("t"), t="Sun Aug 30 10:00:00 +0800 2026")) == "2026-08-30 02:00:00"
    assert str(one(spark, times.news_time("t"), t="2026-10-22 12:00:00")) == "2026-10-22 04:00:00"
    assert one(spark, times.feed_time("t"), t="yesterday") is None
    assert one(spark, times.nested_time_ok(F.struct(F.lit("2026-02-30").alias("date"), F.lit(None).cast("string").alias("time"), F.lit("Asia/Shanghai").alias("timezone")))) is False


def test_set_digest_has_one_rule_for_all_sizes(spark):
    import hashlib

    def by_hand(items):
        marks = [hashlib.sha256(x.encode()).hexdigest() for x in set(items)]
        sums = [sum(int(m[15 * i:15 * i + 15], 16) for m in marks) for i in range(4)]
        return hashlib.sha256(":".join(map(str, [len(marks), *sums])).encode()).hexdigest()[:20]

    rows = spark.range(30_010).selectExpr("if(id < 30000, 'large', 'small') AS k", "cast(id AS string) AS v")
    got = {r["k"]: r["set_id"] for r in set_digest(rows.unionByName(rows.limit(500)), ["k"], F.col("v"), size=20).collect()}
    assert got == {"large": by_hand(map(str, range(30_000))), "small": by_hand(map(str, range(30_000, 30_010)))}
