"""The registered queries over the supplied tables. Each fixes its operator's parameters and its result's digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from marquee.llm import alignment, decontaminate, languages, packing, periods, personal_data, pieces, quartile_digest, simhash, token_counts, token_store, toxicity, url_filter
from marquee.llm.common import crc_mod
from marquee.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(work: Callable) -> Callable:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return work(lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    QUERIES[work.__name__] = run
    return work


@query
def op8_simhash(table) -> DataFrame:
    """Fingerprints of all documents and the component of each at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table("documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_decontaminate(table) -> DataFrame:
    """Words of all documents inside 10-word windows of benchmark items."""
    return decontaminate.report(table("documents"), table("benchmark"))


ORACLES["op4_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[p:p + 9] AS win FROM s),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
pos AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n),
met AS (SELECT r, p, n, item_id FROM (SELECT r, p, n, w[p:p + n - 1] AS win FROM pos) a JOIN win USING (win)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM met) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""


@query
def op2_sentencepiece(table) -> DataFrame:
    """Ids of all documents by merge rounds, and the texts decoded from them."""
    found = pieces.encode_decode(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op6_token_store(table) -> DataFrame:
    """All documents' ids written as directly addressable codes and read back."""
    return token_store.index(token_store.write(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2))


@query
def op3_language(table) -> DataFrame:
    """Language of all documents, learned from two thirds of them."""
    docs = table("documents")
    held_out = crc_mod("doc_id", 3) == 1
    found = languages.identify(docs, languages.fit(docs, ~held_out), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query
def op10_personal_data(table) -> DataFrame:
    """Personal data in all documents: counts and digest of the patterns' spans, and all spans with those that the tagger adds.

    The counts and ``base_sha256`` are of the patterns' spans; ``n_added`` counts the tagger's.
    """
    docs = table("documents")
    found = personal_data.detect(docs, personal_data.fit(docs), keep=["doc_id"])
    counts = [F.expr(f"cast(size(filter(personal.base, s -> s.kind = {k})) AS bigint)").alias(f"n_{name}") for k, name in enumerate(personal_data.KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(personal_data.listed("personal.base")), 256).alias("base_sha256"),
                        F.expr(personal_data.listed("concat(personal.base, personal.added)")).alias("spans"), F.size("personal.added").cast("bigint").alias("n_added"))


@query
def op7_toxicity(table) -> DataFrame:
    """Toxicity of all documents, learned from four fifths of the labelled ones."""
    docs, labels = table("documents"), table("labels")
    held_out = crc_mod("doc_id", 5) == 0
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    machine = toxicity.fit(docs, marks.where(~held_out))
    found = toxicity.score(docs, machine, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query
def op9_quartile_digest(table) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness to these and to the next documents."""
    return quartile_digest.compare_edited(table("documents"))


# The rules of the query (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op5_url_filter(table) -> DataFrame:
    """Verdicts on the URLs of all pages, by rules and by trees that learn from the rules."""
    return url_filter.judge(table("pages"), URL_RULES)


@query
def op1_token_counts(table) -> DataFrame:
    """Pre-tokens and tokens of all documents under a unigram model."""
    found = token_counts.counts(table("documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", F.col("counts.pre_tokens").alias("n_pre_tokens"), F.col("counts.tokens").alias("n_tokens"))


@query
def op11_best_fit_packing(table) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, a row for each piece."""
    return packing.pack(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0, most=2048)


@query
def op12_tokenizer_alignment(table) -> DataFrame:
    """Groups of tokens of two tokenizers in all documents, and how often the tokens that end them do so in the corpus."""
    found = alignment.align(table("documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    listed = F.col("alignment.groups")
    rows = found.select("doc_id", "alignment.n_a", "alignment.n_b", "alignment.n_groups",
                        F.when(listed != "", F.sha2(listed.cast("binary"), 256)).otherwise("").alias("groups_sha256"), "alignment.links")
    return alignment.link_counts(rows)


#: Of ten documents by the crc32 of their id, one is read with a stretch of its words repeated from a place ``a`` on every ``p`` words.
_H = "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary))"
_WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32(doc_id) is a multiple of ten, word i >= a becomes word a + (i - a) % p. A null id counts as the empty text."""
    rows = docs.select("doc_id", "text", F.expr(f"{_H} div 10").alias("g"), F.expr(f"if({_H} % 10 = 0, {_WORDS}, null)").alias("w"))
    placed = rows.select("doc_id", "text", "g", "w", F.expr("if(size(w) > 0, g % size(w), null)").alias("a"))
    sized = placed.select("doc_id", "text", "w", "a", F.expr("1 + (size(w) - a) div (3 + g % 8)").alias("p"))
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p AS int) + 1))), ' ')")
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(table) -> DataFrame:
    """Periodic runs of words of all documents, the run of greatest exponent, and digests of the runs and of the texts without repeats."""
    found = periods.periodic_runs(with_planted_runs(table("documents")), keep=["doc_id"])
    # runs come by start, then period, so the first one of the greatest exponent is kept; lengths and periods are compared crosswise
    best = F.expr("""aggregate(periodic.runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>),
                     (a, r) -> if(a IS NULL OR r.length * a.period > a.length * r.period, r, a))""")
    listed = F.expr("array_join(transform(periodic.runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    rows = found.select("doc_id", F.size("periodic.runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("periodic.collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
