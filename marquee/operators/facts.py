"""Evidence-backed facts in flat form: (campaign_id, field_path, value, published_at, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.evidence import anchors, quote_matches
from marquee.operators.components import components
from marquee.operators.ranking import positions
from marquee.session import materialize

#: Groups of one campaign that a window reads in a row; later slices get what earlier ones hold from one row each.
SLICE = 4096
#: Texts of a quote's rarest anchor that are aligned before the others.
NEWEST = 8


def _scope(parts: Column) -> Column:
    """Entity level named by a split path, null when the nesting is not allowed."""
    at = lambda i: F.try_element_at(parts, F.lit(i))
    depth = F.size(parts)
    return (F.when(depth == 1, "campaign").when((depth == 3) & (at(1) == "activities"), "activities")
            .when((depth == 5) & (at(1) == "activities") & at(3).isin("actions", "venues"), at(3)))


def _editable(scope: Column, field: Column) -> Column:
    tests = [(scope == level) & field.isin(fields) for level, fields in C.EDITABLE.items()]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def judge_updates(updates: DataFrame, facts: DataFrame, posts: DataFrame, entities: DataFrame,
                  campaign_sources: DataFrame | None = None) -> DataFrame:
    """Every proposed update with its ``outcome``: applied, same, older or rejected with a ``problem``.

    updates:  group_id, campaign_id, field_path, value, obs_id, quote
    facts:    campaign_id, field_path, value, published_at (null without provenance)
    posts:    obs_id, source_id, content_hash, published_at, text
    entities: campaign_id, entity_id of existing activities, actions and venues, and with parent_id (null or empty for activities)
      the activity that an action or venue belongs to, which a nested target must name
    campaign_sources (optional): campaign_id, published_at; guards values without provenance

    Groups are judged one after the other, by their newest cited post and then by id, each against the facts that the groups before it left.
    ``group_ok`` is false on all rows of a group that holds one rejected row or turns an interval round: such a group changes nothing. Rows
    of a rejected group have the outcome that they would have had alone.

    What a row depends on is which earlier rows of its field, its entity's interval and its campaign's sources took effect. All rows are
    judged at once from a first guess of that, and again from the result, until nothing changes. The earliest group is right at once and
    every turn settles at least one more group along every chain of groups that touch each other, so the end is what judging them in
    order gives; groups that touch nothing in common, and chains in which no group fails, need no turn of their own. Campaigns that no
    group ties to a row that changed are settled: a turn judges only the others again.
    """
    rows = materialize(_sound_rows(updates, facts, posts, entities, campaign_sources))
    sliced = (rows.agg(F.max("_slice")).first()[0] or 0) > 0
    ties = rows.groupBy("group_id").agg(F.min("campaign_id").alias("low"), F.max("campaign_id").alias("high")).where("low <> high")
    domain, alone = "campaign_id", ties.isEmpty()
    if not alone:
        domain = "_domain"
        rows = materialize(rows.join(components(rows.select("campaign_id", "group_id").distinct(), "campaign_id", "group_id", domain), "campaign_id"))
    settled: list[DataFrame] = []
    while True:
        judged = _judge_turn(rows, sliced)
        # one deal by campaign and slice serves these as well, where no group and no campaign lies in two of its parts
        judged = _marked(judged, F.col("problem").isNotNull(), "group_id", "_bad", ["campaign_id", "_slice"] if alone else None)
        judged = judged.withColumn("group_ok", ~F.col("_bad")).withColumn("now", F.col("group_ok") & (F.col("outcome") == "applied"))
        done = materialize(_marked(judged, F.col("live") != F.col("now"), domain, "_moved", ["_slice"] if alone and not sliced else None))
        settled.append(done.where("not _moved").select(*updates.columns, "source_id", "content_hash", "cited_at", "old_value", "problem", "outcome", "group_ok"))
        moved = done.where("_moved")
        if moved.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        rows = moved.withColumn("live", F.col("now")).select(*rows.columns)


def _marked(rows: DataFrame, test: Column, key: str, name: str, within: list[str] | None) -> DataFrame:
    """``rows`` with a column that is true on all rows of a key if the test holds on one of them; the keys of ``within`` deal the rows already."""
    if within is not None:
        return rows.withColumn(name, F.bool_or(test).over(W.partitionBy(*within, key)))
    rows = materialize(rows)
    hit = rows.where(test).select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(hit, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _sound_rows(updates: DataFrame, facts: DataFrame, posts: DataFrame, entities: DataFrame, campaign_sources: DataFrame | None) -> DataFrame:
    """Updates with all that does not depend on other groups: ``fault``, what is stored, the place ``seq`` of the group, a first ``live``."""
    parts = F.split("field_path", r"\.")
    rows = updates.withColumn("_parts", parts).withColumn("_scope", _scope(F.col("_parts"))).withColumn(
        "_entity", F.when(F.size("_parts") > 1, F.element_at("_parts", -2))).withColumn("_field", F.element_at("_parts", -1))
    repeated = updates.groupBy("group_id", "campaign_id", "field_path").agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    cited = posts.select("obs_id", "source_id", "content_hash", F.col("published_at").alias("cited_at"), F.col("text").alias("_text"))
    # the quote is looked up where the text is met, so that texts do not go through the joins after it
    rows = rows.join(cited, "obs_id", "left").withColumn("_quoted", F.coalesce(quote_matches("quote", "_text"), F.lit(False))).drop("_text")
    nested = "parent_id" in entities.columns
    inside = F.coalesce("parent_id", F.lit("")) if nested else F.lit("")
    known = entities.select("campaign_id", F.col("entity_id").alias("_entity"), inside.alias("_parent")).distinct().withColumn("_known", F.lit(True))
    rows = rows.withColumn("_parent", F.when((F.size("_parts") == 5) & F.lit(nested), F.try_element_at("_parts", F.lit(2))).otherwise(""))
    stored = facts.select("campaign_id", "field_path", F.col("value").alias("stored_value"), F.col("published_at").alias("proven_at"))
    rows = (rows.join(repeated, ["group_id", "campaign_id", "field_path"])
            .join(known, ["campaign_id", "_entity", "_parent"], "left").join(stored, ["campaign_id", "field_path"], "left"))
    newest = F.lit(None).cast("timestamp")
    if campaign_sources is not None:
        rows = rows.join(campaign_sources.groupBy("campaign_id").agg(F.max("published_at").alias("_newest")), "campaign_id", "left")
        newest = F.col("_newest")
    status_ok = (F.col("_field") != "status") | F.col("value").isin(C.EDITABLE_STATUS)
    faults = [("repeated", F.col("_repeated")), ("quote", ~F.col("_quoted")), ("null", F.col("value").isNull()),
              ("target", F.col("_scope").isNull()), ("entity", F.col("_entity").isNotNull() & F.col("_known").isNull()),
              ("field", ~_editable(F.col("_scope"), F.col("_field"))), ("status", ~status_ok)]
    fault = F.coalesce(*[F.when(test, C.FACT_PROBLEMS[name]) for name, test in faults])
    owner = F.when(F.col("_field").isin(C.INTERVAL_FIELDS), F.regexp_extract("field_path", r"^(.*?)[^.]+$", 1))
    # the bounds that are stored for the interval that a row touches
    bounds = facts.withColumn("_field", F.element_at(F.split("field_path", r"\."), -1)).select("campaign_id", owner.alias("_owner"), "_field", "value")
    bounds = bounds.where("_owner is not null").groupBy("campaign_id", "_owner").agg(
        F.struct(*[F.max(F.when(F.col("_field") == f, F.col("value"))).alias(f) for f in C.INTERVAL_FIELDS]).alias("bounds"))
    rows = rows.withColumn("_owner", owner).join(bounds, ["campaign_id", "_owner"], "left")
    rows = materialize(rows.select(*updates.columns, "source_id", "content_hash", "cited_at", "stored_value", "proven_at", newest.alias("newest"),
                                   fault.alias("fault"), "_field", "_owner", "bounds"))
    # a group's place is counted in each campaign that it touches: only groups of one campaign meet
    whole = W.partitionBy("group_id")
    groups = rows.groupBy("campaign_id", "group_id").agg(F.max("cited_at").alias("_at"), F.bool_and(F.col("fault").isNull()).alias("sound"))
    groups = groups.withColumns({"_at": F.max("_at").over(whole), "sound": F.bool_and("sound").over(whole)})
    placed = positions(groups, ["campaign_id"], ["_at", "group_id"], "seq").select("campaign_id", "group_id", "sound", "seq")
    first = F.col("sound") & ~F.coalesce((F.col("value") == F.col("stored_value")) | (F.col("cited_at") <= F.col("proven_at")), F.lit(False))
    return rows.join(placed, ["campaign_id", "group_id"]).withColumn("_slice", F.floor(F.col("seq") / SLICE)).withColumn("live", first)


def _before(rows: DataFrame, keys: list[str], found: dict[str, Column], sliced: bool) -> DataFrame:
    """``rows`` with the greatest of each of ``found`` among the rows of earlier groups with the same ``keys``.

    A key of any size is read slice by slice of SLICE groups; one row for each slice carries what the earlier slices hold.
    """
    inside = W.partitionBy(*keys, "_slice").orderBy("seq").rangeBetween(W.unboundedPreceding, -1)
    if not sliced:  # all groups of every campaign are in its first slice
        return rows.withColumns({n: F.max(c).over(inside) for n, c in found.items()})
    ahead = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_slice").agg(*[F.max(c).alias(f"_c_{n}") for n, c in found.items()])
    carried = carried.select(*keys, "_slice", *[F.max(f"_c_{n}").over(ahead).alias(f"_c_{n}") for n in found]).where("_slice > 0")
    seen = rows.withColumns({n: F.max(c).over(inside) for n, c in found.items()})
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_slice"]]
    return seen.alias("s").join(carried.alias("c"), same, "left").select("s.*", *[f"c._c_{n}" for n in found]).withColumns({n: F.coalesce(n, f"_c_{n}") for n in found}).drop(*[f"_c_{n}" for n in found])


def _judge_turn(rows: DataFrame, sliced: bool) -> DataFrame:
    """All rows judged as if just the ``live`` rows of earlier groups had taken effect."""
    live, kept = F.col("live"), rows.columns
    # all keys below begin with the campaign and the slice, so one shuffle serves all windows
    rows = _before(rows, ["campaign_id"], {"_source": F.when(live, F.col("cited_at"))}, sliced)
    rows = _before(rows, ["campaign_id", "field_path"], {"_last": F.when(live, F.struct("seq", "value", "cited_at"))}, sliced)
    changed = F.col("_last").isNotNull()
    rows = rows.withColumn("old_value", F.when(changed, F.col("_last.value")).otherwise(F.col("stored_value"))).withColumn(
        "_proven", F.when(changed, F.col("_last.cited_at")).otherwise(F.col("proven_at")))
    same = F.coalesce(F.col("value") == F.col("old_value"), F.lit(False))
    guarded = F.col("old_value").isNotNull() & F.col("_proven").isNull() & (F.col("cited_at") < F.greatest("newest", F.when(F.col("newest").isNotNull(), F.col("_source"))))
    problem = F.coalesce("fault", F.when(guarded, C.FACT_PROBLEMS["unproven"]).when(
        ~same & F.col("old_value").isNotNull() & (F.col("cited_at") == F.col("_proven")), C.SAME_TIME_CONFLICT))
    outcome = (F.when(F.col("problem").isNotNull(), "rejected").when(same, "same")
               .when(F.col("old_value").isNotNull() & (F.col("cited_at") < F.col("_proven")), "older").otherwise("applied"))
    rows = rows.withColumn("problem", problem).withColumn("outcome", outcome)
    # bounds after the group: its own, else the last that took effect before, else what is stored
    of = lambda f: F.col("_field") == f
    rows = _before(rows, ["campaign_id", "_owner"], {f"_b_{f}": F.when(live & of(f), F.struct("seq", "value")) for f in C.INTERVAL_FIELDS}, sliced)
    peers = W.partitionBy("campaign_id", "_owner", "_slice", "seq")
    after = {f"_b_{f}": F.coalesce(F.max(F.when(of(f) & (F.col("outcome") == "applied"), F.col("value"))).over(peers), F.col(f"_b_{f}.value"), F.col(f"bounds.{f}"))
             for f in C.INTERVAL_FIELDS}
    rows = rows.withColumns(after)
    at = lambda f: F.try_to_timestamp(F.col(f"_b_{f}"))
    turned = (F.when(at("end_date") < at("start_date"), C.FACT_PROBLEMS["dates"])
              .when((at("end_at") < at("start_at")) | (at("end_at") < at("at")), C.FACT_PROBLEMS["times"]))
    hit = F.coalesce(F.col("_owner").isNotNull() & (F.col("outcome") == "applied") & turned.isNotNull(), F.lit(False))
    rows = rows.withColumn("problem", F.when(hit, turned).otherwise(F.col("problem"))).withColumn("outcome", F.when(hit, "rejected").otherwise(F.col("outcome")))
    return rows.select(*kept, "old_value", "problem", "outcome")


def cited_sources(campaign_sources: DataFrame, judged: DataFrame) -> DataFrame:
    """(campaign_id, source_id, published_at): a campaign's sources with those of applied updates that it did not have."""
    known = campaign_sources.select("campaign_id", "source_id", "published_at")
    new = judged.where("group_ok and outcome = 'applied'").groupBy("campaign_id", "source_id").agg(F.max("cited_at").alias("published_at"))
    return known.unionByName(new.join(known, ["campaign_id", "source_id"], "left_anti"))


def apply_updates(facts: DataFrame, judged: DataFrame) -> DataFrame:
    """Stored facts after the accepted groups; an unchanged value keeps its old provenance."""
    fresh = judged.where("group_ok and outcome = 'applied'").select(
        "campaign_id", "field_path", "value", F.col("cited_at").alias("published_at"), "obs_id", "source_id", "content_hash", "quote")
    # of several that took effect one after the other the newest stays: each was newer than the one before
    last = F.max(F.struct("published_at", *[c for c in fresh.columns if c not in ("campaign_id", "field_path", "published_at")])).alias("l")
    new = fresh.groupBy("campaign_id", "field_path").agg(last).select("campaign_id", "field_path", "l.*")
    return facts.join(new, ["campaign_id", "field_path"], "left_anti").unionByName(new, allowMissingColumns=True)


def update_changes(judged: DataFrame, revisions: DataFrame) -> DataFrame:
    """Change rows of applied updates, keyed by the new revision of their campaign."""
    rows = judged.where("group_ok and outcome = 'applied'").join(revisions.select("campaign_id", "revision"), "campaign_id")
    last = F.regexp_extract("field_path", r"([^.]+)$", 1)
    return rows.select("campaign_id", F.when(F.col("field_path").startswith("activities."), F.element_at(F.split("field_path", r"\."), 2)).alias("activity_id"),
                       F.when(last.isin("at", "start_at", "end_at"), "schedule_changed").otherwise("field_updated").alias("kind"),
                       F.concat(F.lit(C.FACT_UPDATE_SUMMARY), "field_path").alias("summary"),
                       F.concat(F.lit("revision-"), (F.col("revision") + 1).cast("string"), F.lit("-"), "field_path").alias("semantic_suffix"), "source_id")


def latest_facts(proposals: DataFrame) -> DataFrame:
    """Newest published value per field, for bulk loads: (…, value, published_at, tied).

    ``tied`` marks a field whose newest moment carries different values and needs review.
    """
    key = ["campaign_id", "field_path"]
    moments = proposals.groupBy(*key, "published_at").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    newest = moments.groupBy(*key).agg(F.max(F.struct("published_at", "_lo", "_hi")).alias("_n"))
    return newest.select(*key, F.col("_n._lo").alias("value"), F.col("_n.published_at").alias("published_at"),
                         (F.col("_n._lo") != F.col("_n._hi")).alias("tied"))


def merge_catalogue(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat key/value facts with evidence rows: (facts, delta).

    Both are (campaign_id, key, value, source_id, quote), one row per evidence. Evidence adds up
    while a value is unchanged and starts anew with a new value; facts not mentioned stay.
    """
    key = ["campaign_id", "key"]
    old = stored.groupBy(*key).agg(F.max("value").alias("before"))
    new = incoming.groupBy(*key).agg(F.max("value").alias("after"))
    delta = new.join(old, key, "left").where("not (before <=> after)").select(*key, "before", "after")
    kept = stored.join(delta.select(*key), key, "left_anti")
    return kept.unionByName(incoming).distinct(), delta


def invalid_intervals(entities: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose known end lies before their known start, by instant or by day."""
    instants = F.col(end) < F.col(start)
    days = F.col("end_date") < F.col("start_date")
    return entities.where(F.coalesce(instants, F.lit(False)) | F.coalesce(days, F.lit(False))).withColumn(
        "problem", F.when(days, "end date precedes start date").otherwise("end precedes start"))


def claim_provenance(claims: DataFrame, members: DataFrame, signs: bool = False) -> DataFrame:
    """Newest member post that contains the quote of a claim; claims no member supports come back with nulls.

    claims: group_id, claim_id, quote; members: group_id, obs_id, source_id, content_hash, published_at, text.
    Copies of one text, told by their content hash, are checked once, with the newest copy standing for them, and so are claims of one
    quote. A quote meets only the texts that hold the rarest of its anchors (:func:`marquee.functions.evidence.anchors_of`) within the
    group; hashes of the anchors meet under numbers, and texts are fetched once for those pairs. The newest NEWEST of them are aligned, the others only if those fail.
    Quotes too short for an anchor meet all texts of their group. ``signs``: see :func:`marquee.functions.evidence.quote_matches`.
    """
    newest = members.groupBy("group_id", "content_hash").agg(F.max(F.struct("published_at", "obs_id", "source_id", "content_hash")).alias("m"))
    held = newest.select("group_id", F.col("m.obs_id").alias("obs_id"), "m")
    number, key = F.monotonically_increasing_id(), F.xxhash64("group_id", "anchor").alias("key")
    texts = materialize(members.select("group_id", "obs_id", "text").join(held, ["group_id", "obs_id"]).select(number.alias("t"), "group_id", "m", "text", anchors("text").alias("anchors")))
    quotes = materialize(claims.select("group_id", "quote").distinct().select(number.alias("q"), "group_id", "quote", anchors("quote").alias("anchors")))
    asked = quotes.select("q", "group_id", F.explode("anchors").alias("anchor")).select("q", key)
    placed = materialize(texts.select("t", "group_id", F.explode("anchors").alias("anchor")).select("t", key).join(asked.select("key"), "key", "left_semi"))
    # an anchor that no text of the group has rules its quote out
    often = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(often, "key", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("r")).where("r.n > 0")
    pairs = rarest.select("q", F.col("r.key").alias("key")).join(placed, "key").select("q", "t").join(texts.select("t", "m"), "t")
    pairs = materialize(pairs.select("q", "t", (F.row_number().over(W.partitionBy("q").orderBy(F.desc("m"))) <= NEWEST).alias("place")))
    short = quotes.where("anchors is null").select("q", "group_id").join(texts.select("t", "group_id"), "group_id").select("q", "t")
    asks, said = quotes.select("q", "group_id", "quote"), texts.select("t", F.col("group_id").alias("_of"), "m", "text")
    # keys are hashes, so groups are compared where texts are at hand
    best = lambda rows: rows.join(asks, "q").join(said, "t").where(F.col("group_id") == F.col("_of")).where(quote_matches("quote", "text", signs)).groupBy("q").agg(F.max("m").alias("m"))
    found = materialize(best(pairs.where("place").select("q", "t").unionByName(short)))
    rest = materialize(pairs.where("not place").select("q", "t").join(found, "q", "left_anti"))
    if not rest.isEmpty():
        found = found.unionByName(best(rest))
    return claims.join(found.join(asks, "q").drop("q"), ["group_id", "quote"], "left").select("claim_id", *[c for c in claims.columns if c != "claim_id"], "m.*")


def verified_groups(proven: DataFrame) -> DataFrame:
    """A group stands only when every one of its quotes was found."""
    return proven.groupBy("group_id").agg(F.bool_and(F.col("obs_id").isNotNull()).alias("verified"), F.count(F.lit(1)).alias("n_claims"))


