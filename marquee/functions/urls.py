"""URL functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.constants import TRACKING_PARAMETERS
from marquee.functions.text import col

# scheme, authority, path, query; the fragment is dropped
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _form_encode(value: Column) -> Column:
    # URL form encoding keeps "~" and writes "*" as %2A; the JVM encoder does the opposite.
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _form_decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def canonical_url(value: Column | str) -> Column:
    """Lower-case scheme and host, no trailing slash, fragment or tracking parameters."""
    url = col(value)
    part = lambda i: F.regexp_extract(url, URL_PARTS, i)
    scheme, host, query = F.lower(part(1)), F.lower(part(2)), part(4)
    path = F.regexp_replace(part(3), "/+$", "")
    pairs = F.filter(F.split(query, "&", -1), lambda p: p != "")
    name = lambda p: _form_decode(F.substring_index(p, "=", 1))
    content = lambda p: F.when(F.contains(p, F.lit("=")), _form_decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit(""))
    keep = F.filter(pairs, lambda p: ~(F.lower(name(p)).startswith("utm_") | F.lower(name(p)).isin(TRACKING_PARAMETERS)))
    packed = F.array_join(F.transform(keep, lambda p: F.concat(_form_encode(name(p)), F.lit("="), _form_encode(content(p)))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        path,
        F.when(packed != "", F.concat(F.lit("?"), packed)).otherwise(F.lit("")))


def is_http(value: Column) -> Column:
    return F.coalesce(value.startswith("https://") | value.startswith("http://"), F.lit(False))


def http_urls(values: Column | str) -> Column:
    """Order-preserving distinct http(s) addresses of an array; null becomes an empty array."""
    return F.array_distinct(F.filter(F.coalesce(col(values), F.array().cast("array<string>")), is_http))
