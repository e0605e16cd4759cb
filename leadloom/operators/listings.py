"""Listing de-duplication without pairs: every match rule is an equality key with a side condition.

Two listings are the same business when both have a place id and those are equal; or, unless both
have (different) place ids, when their map links are equal, or their name keys are and either both
addresses are known and equal, or one is unknown and the domains are equal. "Is there a match, and
which comes first" then needs only the smallest order per key, split by whether the row has a
place id and an address. A key shared by a third of all rows costs one summary row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import urls
from leadloom.functions.text import normalize_name_key, normalize_text
from leadloom.graphs import components
from leadloom.scale import join_summary, positions, top_k, with_block
from leadloom.session import materialize

IDENTITY = ("place", "link", "name_key", "address_key", "domain_key")


def identify(df: DataFrame) -> DataFrame:
    """The comparison keys of listings (place_id, maps_url, name, address, domain)."""
    return df.withColumns({
        "place": normalize_text(F.col("place_id")), "link": normalize_text(F.col("maps_url")),
        "name_key": normalize_name_key(F.col("name")), "address_key": normalize_name_key(F.col("address")),
        "domain_key": urls.normalize_domain(F.col("domain"))})


def _key(rule: str, *columns: str) -> Column:
    """A key text; NULL (and dropped) when a column is."""
    return F.concat(F.lit(rule), *[part for c in columns for part in (F.lit("\u0001"), F.col(c))])


def _offered_keys(scope: str = "") -> Column:
    """Keys a reference row can be found under, by rule; the suffixes say what a probe may require:
    u = it has no place id, o = it has no address."""
    unplaced, open_ = F.col("place").isNull(), F.col("address_key").isNull()
    return F.array_compact(F.array(
        _key(scope + "p", "place"), _key(scope + "l", "link"), F.when(unplaced, _key(scope + "lu", "link")),
        _key(scope + "s", "name_key", "address_key"), F.when(unplaced, _key(scope + "su", "name_key", "address_key")),
        _key(scope + "d", "name_key", "domain_key"), F.when(unplaced, _key(scope + "du", "name_key", "domain_key")),
        F.when(open_, _key(scope + "do", "name_key", "domain_key")), F.when(open_ & unplaced, _key(scope + "dou", "name_key", "domain_key"))))


def _wanted_keys(scope: str = "") -> Column:
    """Keys a probe row looks under: with a place id only rows without one can match by anything
    else, with an address only rows without one can match by domain."""
    unplaced, open_ = F.col("place").isNull(), F.col("address_key").isNull()

    def wanted(rule: str, *columns: str) -> Column:
        return F.when(unplaced, _key(scope + rule, *columns)).otherwise(_key(scope + rule + "u", *columns))

    site = ("name_key", "domain_key")
    return F.array_compact(F.array(
        _key(scope + "p", "place"), wanted("l", "link"), wanted("s", "name_key", "address_key"),
        F.when(open_, wanted("d", *site)).otherwise(wanted("do", *site))))


def _met(looked: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows (probe, key), several a probe, with the summary of their key, where there is one; a key may be wanted by a third of all rows."""
    wanted = looked.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    return join_summary(looked, wanted.join(summary, "__key"), ["__key"], "__n", how="inner")


def _smallest_matches(probe: DataFrame, probe_id: str, refs: DataFrame, values: dict[str, Column],
                      offered: Column, wanted: Column) -> DataFrame:
    """Probe rows with, per value, its minimum over the matching reference rows (NULL without a match)."""
    minima = {name: F.min(name).alias(name) for name in values}
    summary = refs.select(F.explode(offered).alias("__key"), *[v.alias(n) for n, v in values.items()]).groupBy("__key").agg(*minima.values())
    hits = _met(probe.select(F.col(probe_id).alias("__probe"), F.explode(wanted).alias("__key")), summary).groupBy("__probe").agg(*minima.values())
    return probe.join(hits, probe[probe_id] == hits["__probe"], "left").drop("__probe")


def first_match(found: DataFrame, saved: DataFrame, probe_id: str = "arrival") -> DataFrame:
    """Found listings (identified) with the first saved one that is the same business, or NULL.

    ``saved``: identified rows with id and campaign_id; the found row's own campaign comes first.
    """
    def both(keys) -> Column:
        campaign = F.concat(F.col("campaign_id").cast("string"), F.lit("\u0002"))
        return F.concat(keys(), F.transform(keys(), lambda k: F.concat(campaign, k)))

    # keys within the campaign sort out which match comes first: own campaign, then id
    order = F.struct("id", "campaign_id")
    refs = saved.withColumn("__order", order)
    summary = refs.select(F.explode(both(_offered_keys)).alias("__key"), "__order").groupBy("__key").agg(F.min("__order").alias("__order"))
    looked = found.select(F.col(probe_id).alias("__probe"), F.explode(both(_wanted_keys)).alias("__key"))
    foreign = ~F.contains(F.col("__key"), F.lit("\u0002"))
    hits = _met(looked, summary).groupBy("__probe").agg(F.min(F.struct(foreign.alias("foreign"), "__order")).alias("__best"))
    return (found.join(hits, found[probe_id] == hits["__probe"], "left").withColumn("match", F.col("__best.__order"))
            .drop("__probe", "__best"))


def new_listings(found: DataFrame, saved: DataFrame, probe_id: str = "arrival") -> DataFrame:
    """Found listings no saved business matches."""
    return first_match(found, saved, probe_id).where(F.col("match").isNull()).drop("match")


ROUNDS = 3  # in which whoever waits for nobody is decided; what is left then waits in chains
FOLDED = 1 << 17  # rows of a chain, or a knot of chains, that one task decides in order


def greedy_dedupe(found: DataFrame, saved: DataFrame | None = None, arrival: str = "arrival") -> DataFrame:
    """Accept a listing iff it matches no saved and no already accepted one, in arrival order.

    The match is not transitive, so this is not a connected-components question; but rows that share no key, directly or
    through others, cannot matter to one another. Copies with equal keys collapse to their first arrival. Then, in rounds: whoever matches an
    accepted row is rejected, whoever has no earlier undecided match is accepted. A round is one grouped minimum over keys and
    one join of what is still open. After a few rounds only chains of rows that wait for one another are open: connected
    components over shared keys separate them, in rounds that grow with the logarithm of a chain, and each is decided in arrival order by look-ups. Components
    that are too large for a task go through the plain rounds until they are small or done. Returns the found rows with ``accepted``.
    """
    rows = identify(found)
    matchable = (F.col("place").isNotNull() | F.col("link").isNotNull()
                 | (F.col("name_key").isNotNull() & (F.col("address_key").isNotNull() | F.col("domain_key").isNotNull())))
    rows = rows.withColumn("__matchable", matchable)
    firsts = rows.where("__matchable").groupBy(*IDENTITY).agg(F.min(arrival).alias("first"))
    if saved is not None:
        firsts = _smallest_matches(firsts, "first", identify(saved), {"stored": F.lit(1)}, _offered_keys(), _wanted_keys()).where(
            F.col("stored").isNull()).drop("stored")
    open_, fresh, accepted = materialize(firsts), None, []
    while True:
        for _ in range(ROUNDS):
            fresh, open_ = _round(open_, fresh)
            accepted.append(fresh.select(F.col("first").alias("__winner")))
            if open_.isEmpty():
                break
        if open_.isEmpty():
            break
        # rows that wait only for one another are decided at once; what the last round accepted has yet to reject its matches
        open_ = _unmatched(open_, fresh)
        decided, open_ = _chains(open_)
        fresh = decided
        accepted.append(decided.select(F.col("first").alias("__winner")))
        if open_.isEmpty():
            break
    winners = functools.reduce(DataFrame.unionByName, accepted)
    joined = rows.join(winners, F.col(arrival) == F.col("__winner"), "left")
    return joined.withColumn("accepted", ~F.col("__matchable") | F.col("__winner").isNotNull()).select(*found.columns, "accepted")


def _round(open_: DataFrame, fresh: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Who of the open rows is accepted, and who stays open, after what the last round accepted."""
    # whoever an earlier round accepted has met all that is open already: only the last round's are asked again
    in_play = open_.withColumn("__in", F.lit(False))
    if fresh is not None:
        in_play = in_play.unionByName(fresh.withColumn("__in", F.lit(True)))
    judged = _smallest_matches(open_, "first", in_play, {"taken": F.when(F.col("__in"), F.col("first")), "waiting": F.when(~F.col("__in"), F.col("first"))},
                               _offered_keys(), _wanted_keys())
    decision = F.when(F.col("taken").isNotNull(), False).when(F.coalesce("waiting", "first") >= F.col("first"), True)
    judged = materialize(judged.withColumn("decided", decision).drop("taken", "waiting").where(F.coalesce("decided", F.lit(True))))
    return judged.where("decided").drop("decided"), judged.where(F.col("decided").isNull()).drop("decided")


def _unmatched(open_: DataFrame, fresh: DataFrame) -> DataFrame:
    judged = _smallest_matches(open_, "first", fresh, {"taken": F.col("first")}, _offered_keys(), _wanted_keys())
    return materialize(judged.where(F.col("taken").isNull()).drop("taken"))


def _chains(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows of the components of open rows over shared keys, and the rows of components that are too large for a task.

    A node is twice a row's arrival, or the odd hash of a key.
    """
    keyed = open_.select("first", _offered_keys().alias("offered"), _wanted_keys().alias("wanted"))
    node = 2 * F.col("first").cast("long")
    key = F.explode(F.transform(F.array_union("offered", "wanted"), lambda k: F.xxhash64(k).bitwiseOR(F.lit(1).cast("long"))))
    found = components(keyed.select(node.alias("a"), key.alias("b")))
    placed = materialize(keyed.join(found, node == F.col("node"), "left").select(
        "first", "offered", "wanted", F.coalesce("component", node).alias("of")))
    large = placed.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED).select("of")
    folded = placed.join(large, "of", "left_anti")
    ordered = folded.repartition("of").sortWithinPartitions("of", "first")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, taken = None, set()
        for batch in batches:
            out = []
            for component, first, offered, wanted in zip(batch["of"], batch["first"], batch["offered"], batch["wanted"]):
                if component != of:
                    of, taken = component, set()
                if taken.isdisjoint(wanted):
                    taken.update(offered)
                    out.append(first)
            yield pd.DataFrame({"winner": out}, dtype="int64")

    kind = dict(open_.dtypes)["first"]
    winners = materialize(ordered.mapInPandas(decide, f"winner {kind}"))
    accepted = open_.join(winners, F.col("first") == F.col("winner"), "left_semi")
    rest = placed.join(large, "of", "left_semi").select(F.col("first").alias("left"))
    return accepted, materialize(open_.join(rest, F.col("first") == F.col("left"), "left_semi"))


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, arrival: str) -> DataFrame:
    """Incoming rows to append: non-empty keys not stored yet, the first arrival of each; blank keys never collide."""
    filled = F.coalesce(key, F.lit("")) != ""
    first = top_k(incoming.where(filled), [key], [F.col(arrival)], 1).drop("rank")
    stored = existing.where(filled).select(key)
    return first.join(stored, key, "left_anti").unionByName(incoming.where(~filled))


def refresh_fields(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored businesses with newly read details (id and any column prefixed ``new_``), and what changed.

    Category, rating, reviews and hours are overwritten by non-empty different values (hours not by
    a shorter list); phone, website, domain, city, state and postal code only fill blanks.
    """
    rows = existing.join(fresh, "id", "left")
    offered = {c[4:] for c in fresh.columns if c.startswith("new_")}
    changes = {}
    for c in ("category", "google_rating", "google_review_count", "opening_hours"):
        if c in offered:
            new, old = F.col(f"new_{c}"), F.col(c)
            given = new.isNotNull() & (F.size(new) > 0 if c == "opening_hours" else new.cast("string") != "")
            fuller = F.size(new) >= F.greatest(F.size(old), F.lit(0)) if c == "opening_hours" else F.lit(True)
            changes[c] = given & fuller & ~new.eqNullSafe(old)
    for c in ("phone", "website_url", "domain", "city", "state", "postal_code"):
        if c in offered:
            changes[c] = (F.coalesce(F.col(f"new_{c}"), F.lit("")) != "") & (F.coalesce(F.col(c), F.lit("")) == "")
    flags = {f"__{c}": F.coalesce(test, F.lit(False)) for c, test in changes.items()}
    rows = rows.withColumns(flags)
    changed = F.array_compact(F.array(*[F.when(F.col(f"__{c}"), F.lit(c)) for c in changes]))
    values = [F.when(F.col(f"__{c}"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in existing.columns]
    return rows.select(*values, changed.alias("changed"))


def backfill_place_ids(businesses: DataFrame) -> DataFrame:
    """Place ids read from the map link where missing: (id, place_id, taken). The lowest id gets a
    place nobody has; the others are reported as taken."""
    has = F.coalesce("google_place_id", F.lit("")) != ""
    taken = businesses.where(has).select(F.col("google_place_id").alias("place_id")).distinct().withColumn("__stored", F.lit(True))
    read = businesses.where(~has).select("id", urls.place_id_from_url(F.col("google_maps_url")).alias("place_id")).where(F.col("place_id").isNotNull())
    lowest = read.groupBy("place_id").agg(F.min("id").alias("__lowest"), F.count(F.lit(1)).alias("__n"))
    facts = lowest.join(taken, "place_id", "left")
    return (join_summary(read, facts, ["place_id"], "__n")
            .select("id", "place_id", (F.col("__stored").isNotNull() | (F.col("id") != F.col("__lowest"))).alias("taken")))


BLOCK = 256  # queries, or blocks of them, that are put together in one row


def remaining_demand(results: DataFrame, known: DataFrame, limit: int, per_search: int = 240) -> DataFrame:
    """Search results (campaign_id, query_no, position, is_new) that a campaign takes until ``limit`` new ones are accepted.

    Queries run in order. Each asks for what is still missing plus the businesses the campaign already
    had (``known``: campaign_id, known), at most ``per_search``, gets no more than that, and none runs
    once the limit is reached. So a query turns the number accepted before it into the number after it: a table of ``limit + 1`` numbers
    that saturates. Tables of neighbouring queries compose, ``BLOCK`` at a time and block by block again, which gives every query
    the number before it without running a campaign's queries one after the other in one place.
    """
    received = results.where(F.col("position") < per_search)
    queries = received.groupBy("campaign_id", "query_no").agg(F.array_sort(F.collect_list(F.when(F.col("is_new"), F.col("position")))).alias("new"))
    queries = queries.join(known, "campaign_id", "left").withColumn("known", F.coalesce("known", F.lit(0)).cast("long"))

    def taken(before: Column) -> Column:
        """The new results that a query takes after so many: within what it asks for, and no more than are missing."""
        asked = F.least(F.lit(limit) - before + F.col("known"), F.lit(per_search))
        return F.when(before < limit, F.slice(F.filter("new", lambda p: p < asked), F.lit(1), F.greatest(F.lit(limit) - before, F.lit(0)))).otherwise(
            F.slice(F.col("new"), 1, 0))

    numbered = positions(with_block(queries, F.col("query_no")), ["campaign_id"], [F.col("query_no")], [F.col("__part")], out="n").drop("__part")
    numbered = materialize(numbered.withColumn("after", F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda a: (a + F.size(taken(a))).cast("int"))))
    before = _before(numbered.select("campaign_id", "n", "after"), limit).withColumnsRenamed({"campaign_id": "of", "n": "at"})
    reached = numbered.join(before, F.col("campaign_id").eqNullSafe(F.col("of")) & (F.col("n") == F.col("at")))
    return reached.select("campaign_id", "query_no", F.explode(taken(F.col("before"))).alias("position"))


def _before(steps: DataFrame, limit: int) -> DataFrame:
    """(campaign_id, n, before): the number that steps (campaign_id, n from 0, after: table) 0 to n - 1 lead to from 0."""
    through = lambda table, x: F.get(table, x)
    blocks = steps.groupBy("campaign_id", F.floor(F.col("n") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "after"))).alias("steps"))
    blocks = materialize(blocks.withColumn("after", F.aggregate(
        "steps", F.sequence(F.lit(0), F.lit(limit)), lambda table, step: F.transform(table, lambda x: through(step["after"], x)))))
    if blocks.where("block > 0").isEmpty():
        entered = blocks.withColumn("before", F.lit(0))
    else:
        outer = _before(blocks.select("campaign_id", F.col("block").alias("n"), "after"), limit).withColumnsRenamed({"campaign_id": "of", "n": "at"})
        entered = blocks.join(outer, F.col("campaign_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    start = F.struct(F.col("before").alias("now"), F.array().cast("array<struct<n:bigint,before:int>>").alias("seen"))

    def go(held: Column, step: Column) -> Column:
        seen = F.array_append(held["seen"], F.struct(step["n"].alias("n"), held["now"].alias("before")))
        return F.struct(through(step["after"], held["now"]).alias("now"), seen.alias("seen"))

    return entered.select("campaign_id", F.explode(F.aggregate("steps", start, go, lambda held: held["seen"])).alias("s")).select("campaign_id", "s.n", "s.before")
