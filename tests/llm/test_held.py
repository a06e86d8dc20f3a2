"""A worker keeps one model, and nothing of the one before."""

import sys
import weakref

import corpus_pipeline
import pyarrow as pa

from marquee.llm.common import held


class Model:
    def __init__(self):
        self.me = self  # a cycle, which only the collector frees


def test_the_model_before_is_freed_at_once():
    before = weakref.ref(held("one", 0, Model))
    assert before() is held("one", 0, Model)
    kept = pa.default_memory_pool().bytes_allocated()
    held("two", 0, lambda: None)
    assert before() is None and pa.default_memory_pool().bytes_allocated() <= kept
    assert list(sys._marquee_held) == [("two", 0)]


def test_learning_languages_lets_go_of_the_codec(spark):
    """All tasks of a stage run in the same few workers: none of them holds the codec of an encoding stage while counts are taken."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(1).localCheckpoint()
    corpus_pipeline.encoding(spark, docs, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()

    def seen(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in sys.__dict__.get("_marquee_held", {})] or ["nothing"]})

    kinds = lambda: {r["kind"] for r in docs.select("doc_id").repartition(32).mapInArrow(seen, "kind string").collect()}
    assert "piece codec" in kinds()
    for _ in range(3):
        corpus_pipeline.languages.fit(docs.repartition(32), docs["doc_id"] >= 0)
    assert "language counts" in kinds()
