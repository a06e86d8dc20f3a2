"""Folding and shingles against plain Python, and what a comparison of posts computes."""

import random
import re

from pyspark.sql import functions as F

from marquee.functions.text import bigrams, fold
from marquee.operators.duplicates import pair_verdicts


def test_fold_and_bigrams_equal_plain_python(spark):
    rng = random.Random(4)
    letters = "abzAZ019 .,\n\r _-éИя中㐀鿿ꀀ\U00020000\U0001f600\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(600)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold("t").alias("f"), bigrams("t").alias("b")).collect()
    for r in rows:
        f = re.sub("[^0-9A-Za-z㐀-鿿]", "", r.t or "").lower()
        assert r.f == f and r.b == (list(dict.fromkeys(f[i:i + 2] for i in range(len(f) - 1))) if len(f) > 2 else [f] if f else [])


def test_texts_are_folded_once_a_side(spark):
    posts = spark.sql("SELECT 'a' AS obs_id, 's' AS source_id, 'c' AS canonical_content_id, 'h' AS content_hash, 'x' AS text, array('u') AS outbound_urls, array('m') AS media_hashes")
    # read from a table, so that the text is no constant
    posts = posts.withColumn("text", F.concat("text", F.rand().cast("string")))
    pairs = spark.sql("SELECT 'a' AS left_id, 'a' AS right_id")
    plan = pair_verdicts(pairs, posts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("㐀-鿿") == 2
