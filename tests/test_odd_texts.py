"""Queries that quote or pack whole texts agree with their statements on texts without words."""

import duckdb
import oracle
import pytest

import __spark_entry__ as contract

TEXTS = ["8294846167456848", "true", "[1, 2]", ".", "***", "", " \n", "<&>", "A.", "+1 (168) 555-5254", "-5", "null", "12 words", "Plain text."]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Every text at three ids in a row, and an activity for every id but some."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(3 * n + k, t) for n, t in enumerate(TEXTS) for k in range(3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute(f"COPY (SELECT *, 'en' AS lang, 'src1' AS source, length(text) AS n_chars FROM documents) TO '{folder}/documents.parquet'")
    con.execute(f"""COPY (SELECT doc_id AS o_orderkey, doc_id AS o_custkey, 'O' AS o_orderstatus, TIMESTAMP '1998-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority
                    FROM documents WHERE doc_id % 5 <> 0) TO '{folder}/orders.parquet'""")
    return folder


@pytest.mark.parametrize("name", ["forum_feed", "quote_alignment", "new_children"])
def test_texts_without_words(spark, odd, name):
    assert oracle.compare(contract.queries()[name](spark, odd), oracle.connect(odd), contract.oracle_sql()[name]) is None
