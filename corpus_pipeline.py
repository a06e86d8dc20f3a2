"""The corpus pipeline: language ID, near-duplicate removal, decontamination, masking of personal data, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared folder and
hands the files to the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from marquee.llm import decontaminate, languages, near_copies, personal_data, pieces
from marquee.llm.common import crc_mod, stage
from marquee.session import prepare
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document stays if one language holds at least this share of its letters.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds half of the letters, go.

    The languages are learned from the labelled rows of ``docs`` itself; without any label nothing can be told and every document stays.
    """
    prepare(spark)
    model = languages.fit(docs, crc_mod("doc_id", 3) != 1)
    if not model.langs:
        return docs
    name = "_language"
    while name in docs.columns:
        name += "_"
    found = languages.identify(docs, model, name)
    return found.where((F.col(f"{name}.lang") != languages.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more) stays: the one with the smallest id."""
    prepare(spark)
    return near_copies.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind, and ``n_chars`` follows."""
    prepare(spark)
    return personal_data.masked(docs, personal_data.fit(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the pieces of every text with begin and end ids, and the text decoded from them."""
    prepare(spark)
    found = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data_masking), ("encoding", encoding)]

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
