"""Text functions as native column expressions."""

from __future__ import annotations

import html
import string
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# letters and digits one by one: Java looks them up in a table, where it tries ranges in turn
NAME_NOISE = f"[^{string.digits}{string.ascii_letters}㐀-鿿]+"
SPACE_EDGES = r"(?U)^\s+|\s+$"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fold(value: Column | str) -> Column:
    """Keep ASCII letters, digits and CJK ideographs, in lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(col(value), F.lit("")), NAME_NOISE, ""))


def squeeze(value: Column | str) -> Column:
    """Remove all white space."""
    return F.regexp_replace(col(value), r"(?U)\s+", "")


def trim_all(value: Column | str) -> Column:
    return F.regexp_replace(col(value), SPACE_EDGES, "")


def not_blank(value: Column | str) -> Column:
    return F.coalesce(F.length(col(value)) > 0, F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(folded: Column) -> Column:
    """Distinct two-character shingles of a folded text, whose characters are single code units; the whole text when shorter."""
    return (F.when(F.length(folded) == 0, F.array().cast("array<string>"))
            .when(F.length(folded) <= 2, F.array(folded))
            .otherwise(F.array_distinct(F.regexp_extract_all(folded, F.lit("(?=(..))"), F.lit(1)))))


def bigrams(value: Column | str) -> Column:
    """:func:`shingles` of the folded text, which is folded once."""
    return bound(fold(value), shingles)


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two shingle sets, 0 when either side is empty."""
    ratio = lambda a, b, both: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))
    return bound(left, lambda a: bound(right, lambda b: bound(F.size(F.array_intersect(a, b)), lambda both: ratio(a, b, both))))


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: html.unescape(v) if isinstance(v, str) and "&" in v else v)


def strip_markup(value: Column | str) -> Column:
    """Drop tags, decode character references, trim."""
    return trim_all(_unescape(F.regexp_replace(col(value), "<[^>]+>", "")))


def strip_markup_native(value: Column | str) -> Column:
    """As :func:`strip_markup` for the six common references; never leaves the JVM."""
    text = F.regexp_replace(col(value), "<[^>]+>", "")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return trim_all(text)


def excerpt(value: Column | str, size: int = 500) -> Column:
    return F.substring(col(value), 1, size)


def strip_code_fence(value: Column | str) -> Column:
    """Remove a Markdown fence around a JSON answer; other text only loses its outer spaces."""
    text = trim_all(value)
    inner = F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(text.startswith("```"), trim_all(inner)).otherwise(text)


def lines(*parts: Column) -> Column:
    """Join the non-empty parts with line feeds."""
    return F.concat_ws("\n", *[F.when(not_blank(p), p) for p in parts])


def already_shown(value: Column, text: Column) -> Column:
    """True when a reader of ``text`` has seen ``value``.

    The value counts without regard to white space. An ISO value also counts by a Chinese or ISO
    form of its day, together with its hour and minute if it is timed.
    """
    iso = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}))?", 0)
    day, clock = F.substring(iso, 1, 10), F.substring(iso, 12, 5)
    month, dom = F.substring(day, 6, 2), F.substring(day, 9, 2)
    short = lambda part: F.regexp_replace(part, "^0", "")
    day_forms = [F.concat(short(month), F.lit("月"), short(dom), F.lit("日")),
                 F.concat(month, F.lit("月"), dom, F.lit("日")), day]
    day_seen = reduce(lambda a, b: a | b, [F.contains(text, form) for form in day_forms])
    clock_seen = (clock == "") | F.contains(text, clock) | F.contains(text, short(clock))
    return F.coalesce(F.contains(squeeze(text), squeeze(value)) | ((iso != "") & day_seen & clock_seen), F.lit(False))
