"""Training samples are shares of different texts, however many copies there are."""

import random

from pyspark.sql import functions as F

from marquee.llm import languages, url_filter


def test_copies_do_not_starve_or_drown_a_language(spark):
    rng = random.Random(2)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(8))
    one, two = [text("abcdefg") for _ in range(60)], [text("tuvwxyz") for _ in range(60)]
    rows = [(t, "one") for t in one + [one[0]] * 5000] + [(t, "two") for t in two]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = languages.fit(docs, F.lit(True), per_language=100)
    words = {k: sum(1 for t in ts for _ in t.split()) for k, ts in (("one", one), ("two", two))}
    ends = model.counts[0][languages._grams(["a"])[2][-1]]  # how often the end of a word was counted: once for every word of different texts
    assert {k: int(n) for k, n in zip(model.langs, ends, strict=True)} == words
    label = languages.Labeller(model)
    assert [f[0] for f in label([text("abcdefg"), text("tuvwxyz")])] == ["one", "two"]


def test_copies_do_not_starve_the_url_trees(spark):
    rows = [(f"http://{'casino' if i % 2 else 'news'}{i}.com/", i % 2 == 1) for i in range(80)]
    frame = spark.createDataFrame(rows + [rows[0]] * 8000, "url string, block boolean")
    model = url_filter.fit(frame, train_rows=100)
    scores = model.scores(["http://casino45.com/", "http://news44.com/"])
    assert scores[0] > 0.5 > scores[1]


def test_models_reach_workers_without_the_package(tmp_path):
    """A run whose Python workers can't import the package: the driver finds it by a path of its own."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys, types
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
import public_tokenizers
from marquee.llm import languages, personal_data, pieces, toxicity, url_filter
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
docs = spark.createDataFrame([(i, "mail a.b@example.com now " + w * 5, "one" if i % 2 else "two") for i, w in enumerate(["alpha ", "omega "] * 30)], "doc_id bigint, text string, lang string")
print("found", languages.identify(docs, languages.fit(docs, F.lit(True))).count(), pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).agg(F.sum(F.length("decoded"))).first()[0] > 0,
      toxicity.score(docs, toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS label"))).agg(F.sum("toxicity")).first()[0] >= 0,
      personal_data.detect(docs, personal_data.fit(docs), keep=["doc_id"]).count(),
      url_filter.judge(spark.createDataFrame([(i, f"http://h{{i}}.net/a{{i}}") for i in range(20)], "page_id bigint, url string"), [("block", "net", "/")]).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != root), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "found 60 True True 60 20" in done.stdout, done.stderr[-3000:]
