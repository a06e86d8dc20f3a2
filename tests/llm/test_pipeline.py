"""Every stage of the pipeline on its own input, against brute force, and the whole run."""

import re

import corpus_pipeline
import pytest
from test_duplicates import brute_hits
from test_near_copies import brute_components
from test_tokens import LIBRARY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, step in corpus_pipeline.STAGES:
        after = step(spark, docs, FOLDER).cache()
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def test_language_keeps_documents_with_a_language(staged):
    before, after = staged[0]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {r.doc_id for r in before if len(re.findall(r"[^\W\d_]", r.text or "")) < 40}


def test_one_of_each_group(staged):
    before, after = staged[1]
    assert sorted(r.doc_id for r in after) == sorted(set(brute_components([(r.doc_id, r.text) for r in before]).values()))


def test_no_benchmark_window_is_left(staged, table):
    before, after = staged[2]
    hits = brute_hits([(r.doc_id, r.text) for r in before], [(r.item_id, r.text) for r in table("benchmark").collect()])
    assert sorted(r.doc_id for r in after) == sorted(h[0] for h in hits if not h[5])


def test_masked_texts(staged):
    before, after = ({r.doc_id: r for r in rows} for rows in staged[3])
    assert before.keys() == after.keys() and all(r.n_chars == len(r.text) for r in after.values())
    for d, r in before.items():
        if not re.search("[0-9@]", r.text or ""):
            assert after[d].text == r.text
        assert not re.search(r"@[a-z0-9-]+\.[a-z]", after[d].text)


def test_encoded_texts(staged):
    before, after = staged[4]
    got = {r.doc_id: r for r in after}
    for r in before:
        ids = [1, *LIBRARY.encode(r.text), 2]
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].decoded == LIBRARY.decode(ids)


def test_odd_rows_pass_every_stage(spark, odd, none):
    columns = odd.columns
    for frame in (odd, none):
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, frame, FOLDER)
            assert out.count() <= frame.count()
            assert k == 4 or out.columns == columns


def test_run(spark, staged):
    rows = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, rows)) == sorted((r.doc_id, r.n_tokens) for r in staged[4][1])
