"""Landed feed payloads to normalised posts.

Every reader takes rows (payload STRING, account_id, account_name, first_seen_at) as landed by the
fetcher and returns observation columns. A post that cannot be normalised keeps its row with a
``problem``; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.constants import REPOST_PREFIX
from marquee.functions.text import excerpt, lines, not_blank, strip_markup, trim_all
from marquee.functions.times import epoch_time, feed_time, news_time
from marquee.functions.urls import http_urls, is_http
from marquee.sources.pages import page_material

_EMPTY = "array<string>"
_LINKS = "ARRAY<STRUCT<long_url STRING, url_title STRING>>"
_POST = (f"id STRING, bid STRING, created_at STRING, text STRING, text_raw STRING, isLongText BOOLEAN, "
         f"pics ARRAY<STRUCT<pid STRING, large STRUCT<url STRING>>>, url_struct {_LINKS}, page_info STRUCT<page_url STRING>")
MICROBLOG = f"ok INT, data STRUCT<cards ARRAY<STRUCT<card_type INT, mblog STRUCT<{_POST}, retweeted_status STRUCT<{_POST}>>>>>"
LONG_TEXT = f"ok INT, data STRUCT<longTextContent STRING, url_struct {_LINKS}>"
FORUM = ("retcode INT, data STRUCT<post STRUCT<post STRUCT<post_id STRING, subject STRING, created_at STRING, "
         "structured_content STRING, content STRING, images VARIANT>, image_list VARIANT>>")
SLICES = ("code INT, data STRUCT<item STRUCT<id STRING, itemId STRING, title STRING, publishedAtTs STRING, createdAtTs STRING, "
          "publishAtTs STRING, format STRING, textSlice ARRAY<STRUCT<id STRING, c STRING>>, imageListSlice VARIANT, "
          "imageList VARIANT, linkSlice ARRAY<STRUCT<url STRING, href STRING, link STRING>>, caption STRING>>")
SLICE_FORMAT = ("data ARRAY<STRUCT<type STRING, contents ARRAY<STRUCT<type STRING, contentId STRING, id STRING, text STRING>>>>")
NEWS_DETAIL = "retcode INT, data STRUCT<iInfoId STRING, sTitle STRING, dtStartTime STRING, sContent STRING>"
NEWS_LIST = "code INT, data STRUCT<list ARRAY<STRUCT<cid STRING, title STRING, displayTime STRING>>>"


def _array(value: Column) -> Column:
    return F.coalesce(value, F.array().cast(_EMPTY))


def _finish(df: DataFrame, kind: str, url: Column, problem: Column, hash_parts: list[Column] | None = None) -> DataFrame:
    """Shared tail: identity, content hash and excerpt from text, canonical id and pictures."""
    parts = hash_parts or [F.concat_ws("\n", F.array("text", "canonical_content_id"), F.col("media_urls"))]
    post = F.concat(F.lit(kind + "-"), F.col("post_id"))
    return df.select(
        post.alias("obs_id"), post.alias("source_id"), F.lit(kind).alias("kind"), url.alias("url"), "account_name", "account_id",
        "canonical_content_id", F.lit(True).alias("is_official"), "published_at", "first_seen_at",
        F.lit(None).cast("timestamp").alias("updated_at"), F.sha2(F.concat_ws("\n", *parts), 256).alias("content_hash"),
        excerpt("text").alias("excerpt"), F.lit(None).cast("string").alias("summary"), "text", "media_urls", "media_hashes",
        F.array().cast(_EMPTY).alias("media_text"), "outbound_urls", problem.alias("problem"))


def _token_hashes(tokens: Column) -> Column:
    return F.transform(F.array_distinct(tokens), lambda t: F.sha2(t, 256))


# --- micro-blog ---------------------------------------------------------------------------------

def _pictures(post: Column) -> Column:
    return F.filter(F.transform(F.coalesce(post["pics"], F.array()), lambda p: p["large"]["url"]), is_http)


def _picture_tokens(post: Column) -> Column:
    named = lambda p: F.coalesce(F.when(not_blank(p["pid"]), p["pid"]), F.when(not_blank(p["large"]["url"]), p["large"]["url"]))
    return F.array_compact(F.transform(F.coalesce(post["pics"], F.array()), named))


def _links(post: Column, extra: Column) -> Column:
    pick = lambda l: F.coalesce(F.when(not_blank(l["long_url"]), l["long_url"]), l["url_title"])
    listed = F.transform(F.concat(F.coalesce(post["url_struct"], F.array()), F.coalesce(extra, F.array())), pick)
    return F.filter(F.array_compact(F.concat(listed, F.array(post["page_info"]["page_url"]))), is_http)


def _raw_text(post: Column, full: Column) -> Column:
    return F.coalesce(full, F.when(not_blank(post["text_raw"]), post["text_raw"]), post["text"], F.lit(""))


def long_texts(payloads: DataFrame) -> DataFrame:
    """Landed long-text answers (post_id, payload) to (post_id, full_text, full_links)."""
    body = F.from_json("payload", LONG_TEXT)
    return payloads.select("post_id", body["data"]["longTextContent"].alias("full_text"),
                           body["data"]["url_struct"].alias("full_links")).dropDuplicates(["post_id"])


def microblog_posts(payloads: DataFrame, full: DataFrame | None = None, kind: str = "weibo") -> DataFrame:
    """List pages to posts: clean text, repost text appended, pictures, links, hash.

    ``full`` from :func:`long_texts` replaces truncated texts of the post and of its repost; a
    truncated text without its full text is a problem.
    """
    cards = F.filter(F.from_json("payload", MICROBLOG)["data"]["cards"], lambda c: (c["card_type"] == 9) & c["mblog"].isNotNull())
    rows = payloads.select("account_id", "account_name", "first_seen_at", F.explode(cards).alias("card")).select(
        "account_id", "account_name", "first_seen_at", F.col("card.mblog").alias("p")).withColumn("r", F.col("p.retweeted_status"))
    links_type = rows.schema["p"].dataType["url_struct"].dataType
    for side in ("p", "r"):
        wanted = F.when(F.coalesce(F.col(f"{side}.isLongText"), F.lit(False)), F.col(f"{side}.id"))
        if full is None:
            rows = rows.withColumns({f"{side}_full": F.lit(None).cast("string"), f"{side}_links": F.lit(None).cast(links_type)})
        else:
            found = full.select(F.col("post_id").alias(f"{side}_id"), F.col("full_text").alias(f"{side}_full"),
                                F.col("full_links").alias(f"{side}_links"))
            # posts that want no text are dealt by their content: as one null key they would all go to one task
            own = F.xxhash64("p.id", "p.created_at", "p.text").cast("string")
            rows = rows.withColumn(f"{side}_want", wanted).withColumn(f"{side}_key", F.coalesce(f"{side}_want", own))
            rows = rows.join(found, (F.col(f"{side}_key") == F.col(f"{side}_id")) & F.col(f"{side}_want").isNotNull(), "left")
    p, r = F.col("p"), F.col("r")
    repost = strip_markup(_raw_text(r, F.col("r_full")))
    rows = (rows
            .withColumn("own_text", strip_markup(_raw_text(p, F.col("p_full"))))
            .withColumn("repost_text", F.when(r.isNotNull(), repost))
            .withColumn("text", lines(F.col("own_text"), F.when(not_blank("repost_text"), F.concat(F.lit(REPOST_PREFIX), "repost_text"))))
            .withColumn("post_id", p["id"])
            .withColumn("canonical_content_id", F.coalesce(F.when(not_blank(r["id"]), r["id"]), p["id"]))
            .withColumn("published_at", feed_time(p["created_at"]))
            .withColumn("media_urls", F.array_distinct(F.concat(_pictures(p), _array(_pictures(r)))))
            .withColumn("media_hashes", _token_hashes(F.concat(_picture_tokens(p), _array(_picture_tokens(r)))))
            .withColumn("outbound_urls", F.array_distinct(F.concat(_links(p, F.col("p_links")), _array(_links(r, F.col("r_links")))))))
    missing = lambda s: F.coalesce(F.col(f"{s}.isLongText"), F.lit(False)) & F.col(f"{s}_full").isNull()
    problem = (F.when(~not_blank("post_id"), "post is missing an id").when(F.col("published_at").isNull(), "unsupported publication time")
               .when(missing("p") | missing("r"), "long post content was not found"))
    name = F.coalesce(F.when(not_blank(p["bid"]), p["bid"]), p["id"])
    return _finish(rows, kind, F.concat(F.lit("https://weibo.com/"), "account_id", F.lit("/"), name), problem)


# --- forum --------------------------------------------------------------------------------------

def _kind_of(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _text_at(value: Column, path: str) -> Column:
    """A member of a variant only when it is a string."""
    return F.when(_kind_of(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def whole_json(text: Column) -> Column:
    """Text that is JSON from end to end as a variant, else null: Spark's own parser passes over what follows the first value."""
    end = F.sha2(text, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit('\n,"'), end, F.lit('"]')))
    return F.when(_text_at(pair, "$[1]") == end, F.try_parse_json(text))


def _picture_list(value: Column) -> Column:
    """A list of addresses or of objects with an address."""
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.array_compact(F.transform(items, lambda v: F.coalesce(_text_at(v, "$"), _text_at(v, "$.url"))))


def forum_posts(payloads: DataFrame, kind: str = "miyoushe", subsite: str = "ys") -> DataFrame:
    """Detail payloads to posts. Rich text is a list of inserts: text, pictures and links."""
    wrap = F.from_json("payload", FORUM)["data"]["post"]
    rows = payloads.select("account_id", "account_name", "first_seen_at", wrap.alias("w")).withColumn("p", F.col("w.post"))
    structured, legacy = F.col("p.structured_content"), F.col("p.content")
    rich = not_blank(trim_all(structured))
    ops = F.coalesce(F.from_json(structured, "ARRAY<STRUCT<insert VARIANT, attributes STRUCT<link STRING>>>"), F.array())
    ops = F.filter(ops, lambda o: o.isNotNull())
    said = F.array_join(F.array_compact(F.transform(ops, lambda o: _text_at(o["insert"], "$"))), "")
    shown = F.flatten(F.transform(ops, lambda o: F.array(_text_at(o["insert"], "$.image"), _text_at(o["insert"], "$.image_url"))))
    linked = F.flatten(F.transform(ops, lambda o: F.array(
        F.when(_kind_of(o["insert"]) == "STRING", o["attributes"]["link"]), _text_at(o["insert"], "$.link"), _text_at(o["insert"], "$.url"))))
    old = whole_json(legacy)
    plain = F.when(~not_blank(trim_all(legacy)), "").when(old.isNull(), legacy).otherwise(
        F.coalesce(_text_at(old, "$.describe"), _text_at(old, "$"), F.lit("")))
    none = F.array().cast(_EMPTY)
    rows = (rows
            .withColumn("ops", ops)
            .withColumn("body", trim_all(F.when(rich, said).otherwise(F.coalesce(plain, F.lit("")))))
            .withColumn("text", lines(trim_all(F.coalesce("p.subject", F.lit(""))), F.col("body")))
            .withColumn("post_id", F.col("p.post_id")).withColumn("canonical_content_id", F.col("p.post_id"))
            .withColumn("published_at", epoch_time("p.created_at"))
            .withColumn("media_urls", http_urls(F.concat(_picture_list(F.col("w.image_list")), _picture_list(F.col("p.images")),
                                                         F.when(rich, F.array_compact(shown)).otherwise(none))))
            .withColumn("media_hashes", _token_hashes(F.col("media_urls")))
            .withColumn("outbound_urls", http_urls(F.when(rich, F.array_compact(linked)).otherwise(none))))
    bad = rich & F.from_json(structured, "ARRAY<STRUCT<insert VARIANT>>").isNull()
    problem = (F.when(F.col("p").isNull(), "post detail was not found").when(bad, "post content could not be decoded")
               .when(F.col("published_at").isNull(), "unsupported publication time"))
    return _finish(rows, kind, F.concat(F.lit(f"https://www.miyoushe.com/{subsite}/article/"), "post_id"), problem)


# --- slices -------------------------------------------------------------------------------------

def slice_posts(payloads: DataFrame, kind: str = "skland") -> DataFrame:
    """Detail payloads whose paragraphs refer to text slices by id."""
    rows = payloads.select("account_id", "account_name", "first_seen_at", F.from_json("payload", SLICES)["data"]["item"].alias("i"))
    slices = F.filter(F.coalesce("i.textSlice", F.array()), lambda s: s["id"].isNotNull() & s["c"].isNotNull())
    # the last slice of an id counts, and keeps the place of the first one
    ids = F.array_distinct(F.transform(slices, lambda s: s["id"]))
    last = lambda key: F.element_at(F.filter(slices, lambda s: s["id"] == key), -1)["c"]
    table = F.map_from_arrays(ids, F.transform(ids, last))
    rows = rows.withColumn("said", table)
    nodes = F.from_json("i.format", SLICE_FORMAT)["data"]
    worded = lambda c: F.coalesce(F.try_element_at("said", F.coalesce(c["contentId"], F.lit(""))), c["text"], F.lit(""))
    piece = lambda c: F.when(c["type"].isin("text", "link"), worded(c)).when(
        (c["type"] == "emoji") & not_blank(c["id"]), F.concat(F.lit(":"), c["id"], F.lit(":"))).otherwise("")
    paragraphs = F.transform(F.filter(nodes, lambda n: n["type"] == "paragraph"), lambda n: trim_all(
        F.array_join(F.transform(F.coalesce(n["contents"], F.array()), piece), "")))
    body = F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n")
    spoken = trim_all(F.array_join(F.filter(F.map_values("said"), lambda v: v != ""), "\n"))
    caption = trim_all(F.coalesce("i.caption", F.lit("")))
    formatted = not_blank(trim_all(F.col("i.format")))
    links = F.flatten(F.transform(F.coalesce("i.linkSlice", F.array()), lambda l: F.array(l["url"], l["href"], l["link"])))
    first = lambda *names: F.coalesce(*[F.when(not_blank(f"i.{n}"), F.col(f"i.{n}")) for n in names])
    rows = (rows
            .withColumn("body", F.coalesce(F.when(formatted & not_blank(body), body), F.when(caption != "", caption), spoken))
            .withColumn("text", lines(trim_all(F.coalesce("i.title", F.lit(""))), F.col("body")))
            .withColumn("post_id", first("id", "itemId")).withColumn("canonical_content_id", F.col("post_id"))
            .withColumn("published_at", epoch_time(first("publishedAtTs", "createdAtTs", "publishAtTs")))
            .withColumn("media_urls", http_urls(F.concat(_picture_list(F.col("i.imageListSlice")), _picture_list(F.col("i.imageList")))))
            .withColumn("media_hashes", _token_hashes(F.col("media_urls")))
            .withColumn("outbound_urls", http_urls(F.array_compact(links))))
    problem = (F.when(F.col("i").isNull(), "post detail was not found")
               .when(formatted & nodes.isNull(), "post content could not be decoded")
               .when(F.col("published_at").isNull(), "unsupported publication time"))
    return _finish(rows, kind, F.concat(F.lit("https://www.skland.com/article?id="), "post_id"), problem)


# --- news ---------------------------------------------------------------------------------------

def _news(rows: DataFrame, paragraphs_only: bool, image_prefix: str, kind: str, problem: Column) -> DataFrame:
    rows = (rows.withColumn("m", page_material("markup", paragraphs_only, image_prefix))
            .withColumn("text", lines(trim_all(F.coalesce("title", F.lit(""))), F.col("m.text")))
            .withColumn("media_urls", F.col("m.images")).withColumn("outbound_urls", F.col("m.links"))
            .withColumn("media_hashes", _token_hashes(F.col("media_urls")))
            .withColumn("canonical_content_id", F.col("number"))
            .withColumn("post_id", F.concat_ws("-", "account_id", "number")))
    issue = problem.when(~not_blank(trim_all(F.col("title"))), "news content was unavailable").when(
        F.col("published_at").isNull(), "publication time was unavailable")
    return _finish(rows, kind, F.col("page_url"), issue, [F.concat_ws("\n", F.array("text"), "media_urls", "outbound_urls")])


def news_posts(payloads: DataFrame, kind: str = "website") -> DataFrame:
    """Detail payloads with HTML inside; ``page_base`` is the address before the article number."""
    d = F.from_json("payload", NEWS_DETAIL)["data"]
    rows = payloads.select("account_id", "account_name", "first_seen_at", "page_base", d.alias("d")).select(
        "account_id", "account_name", "first_seen_at", F.col("d.iInfoId").alias("number"), F.col("d.sTitle").alias("title"),
        F.coalesce("d.sContent", F.lit("")).alias("markup"), news_time("d.dtStartTime").alias("published_at"),
        F.concat("page_base", "d.iInfoId").alias("page_url"))
    return _news(rows, False, "https://", kind, F.when(~F.coalesce(F.col("number").rlike(r"^\d+$"), F.lit(False)), "identifier was unavailable"))


def article_posts(pages: DataFrame, listing: DataFrame, kind: str = "website",
                  image_prefix: str = "https://web.hycdn.cn/upload/image/") -> DataFrame:
    """Article pages (account_id, number, page_url, html) titled and dated by their list payloads."""
    items = listing.select("account_id", F.explode(F.from_json("payload", NEWS_LIST)["data"]["list"]).alias("i")).select(
        "account_id", F.col("i.cid").alias("number"), F.col("i.title").alias("title"), epoch_time("i.displayTime").alias("published_at"))
    rows = pages.withColumnRenamed("html", "markup").join(items.dropDuplicates(["account_id", "number"]), ["account_id", "number"])
    return _news(rows, True, image_prefix, kind, F.when(~F.coalesce(F.col("number").rlike(r"^\d+$"), F.lit(False)), "identifier was unavailable"))
