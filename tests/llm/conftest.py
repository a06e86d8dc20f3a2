import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")


#: Rows that must not break anything: nulls in every column, empty and very long texts, ties, repeated rows.
ODD = [(1, None, "en", "s"), (2, "", None, None), (3, "word and word " * 20_000, "en", "s"), (4, "same text here, twice", "en", "s"), (4, "same text here, twice", "en", "s"),
       (5, "same text here, twice", "de", None), (None, "a text without an id", None, "s"), (6, "\t\n  \x00 漢字 😀 ▁", "fr", "s"), (7, "mail a.b@example.com or 10.0.0.1 now", "en", "s"), (8, "!!! ... 123", "en", "s")]
#: Names that operators use inside.
CLASHING = ["row", "result", "bits", "w", "pos", "hash", "score", "component_id", "part", "seq", "_n", "_d", "_h", "ids", "language", "toxicity", "personal", "_language", "_masked", "ROW_"]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, len(r[1] or ""), *(f"{c}-{i}" if i % 2 else None for c in CLASHING)) for i, r in enumerate(ODD)], schema)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)
