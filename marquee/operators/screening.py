"""Rule screening before any costly work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.text import col

# Pattern pieces of a named crossover (fixed values); input is lower case.
_WRAP = r"[\x20\t　《》「」『』【】（）()\[\]“”‘’\"'@]*"
_GAP = r"[ \t　]"
_CROSS = rf"(?:{_GAP}*×{_GAP}*|{_GAP}+[xｘ]{_GAP}+|(?<=[㐀-鿿])[xｘ](?=[㐀-鿿]))"
_PARTNER = r"[^\W\d_][\w·・&.'’\-]*"


def material_of(obs: DataFrame) -> Column:
    """Text and text found in media, lower case."""
    parts = [F.col("text")]
    if "media_text" in obs.columns:
        parts.append(F.array_join(F.coalesce("media_text", F.array().cast("array<string>")), "\n"))
    return F.lower(F.concat_ws("\n", *parts))


def _quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.lower(F.trim(name)), F.lit(r"\E"))


def named_crossovers(material: Column, names: Column) -> Column:
    """Distinct "name × partner" spellings on one line, in either order."""
    empty = F.array().cast("array<string>")
    usable = F.filter(F.coalesce(names, empty), lambda n: F.trim(n) != "")
    name_first = lambda n: F.concat(F.lit("(?U)(?<![a-z0-9_])"), _quoted(n), F.lit(_WRAP + _CROSS + _WRAP + _PARTNER))
    name_last = lambda n: F.concat(F.lit(r"(?U)(?<!\w)" + _PARTNER + _WRAP + _CROSS + _WRAP), _quoted(n), F.lit("(?![a-z0-9_])"))
    hits = F.flatten(F.transform(usable, lambda n: F.concat(
        F.regexp_extract_all(material, name_first(n), F.lit(0)), F.regexp_extract_all(material, name_last(n), F.lit(0)))))
    # only texts with a crossing sign on board pay for the patterns
    return F.when(material.rlike("[×xｘ]"), F.array_distinct(hits)).otherwise(empty)


def _found(material: Column, terms: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(material, F.lit(t.lower())), F.lit(t)) for t in sorted(terms)]))


def screen(obs: DataFrame, names: Column | None = None, official: Column | str = "is_official", *,
           collaboration: list[str] | None = None, actions: list[str] | None = None) -> DataFrame:
    """Add relevant, score, matched_terms and reason.

    ``names`` is an array column of the watched name and its aliases. Only the terms decide; the
    score orders candidates.
    """
    collaboration = collaboration or C.COLLABORATION_TERMS + [t for t in C.OFFLINE_TERMS if t not in C.COLLABORATION_TERMS]
    actions = actions or C.ACTION_TERMS
    material, flag = F.col("_material"), F.coalesce(col(official), F.lit(False))
    empty = F.array().cast("array<string>")
    names = empty if names is None else F.coalesce(names, empty)
    by_name = F.array_sort(F.filter(names, lambda n: F.contains(material, F.lower(n))))
    by_term = F.array_sort(F.array_union(_found(material, collaboration), named_crossovers(material, names)))
    terms = obs.withColumn("_material", material_of(obs)).withColumns(
        {"_collab": by_term, "_action": _found(material, actions), "_named": by_name})
    has = lambda name: F.size(name) > 0
    points = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0))
    relevant = has("_collab") & (flag | has("_named"))
    return (terms
            .withColumn("score", points(has("_collab"), C.SCORE_COLLABORATION) + points(has("_action"), C.SCORE_ACTION)
                        + points(has("_named"), C.SCORE_NAMED) + points(flag, C.SCORE_OFFICIAL))
            .withColumn("relevant", relevant)
            .withColumn("matched_terms", F.concat("_collab", "_action", "_named"))
            .withColumn("reason", F.when(relevant, C.RELEVANT_REASON).otherwise(C.IRRELEVANT_REASON))
            .drop("_material", "_collab", "_action", "_named"))


def accepted_groups(screened: DataFrame, groups: DataFrame) -> DataFrame:
    """A group is accepted when any of its members is relevant."""
    rows = groups.join(screened.select("obs_id", "relevant"), "obs_id")
    return rows.groupBy("ip_slug", "primary_id").agg(
        F.bool_or("relevant").alias("accepted"), F.count(F.lit(1)).alias("n_members"), F.min("primary_at").alias("primary_at"))
