"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's share of all tokens, to the power of an exponent between 0 and 1 and normalised, is its
weight: 1 leaves the shares as they are, 0 makes all sources equal. The exponent is the largest at
which the weights' entropy reaches ``entropy`` (a share of the most that so many sources can have), or,
where a small source would be repeated more than ``max_repeats`` times, the smallest that avoids it.
Both are found by bisection; a pass over the sources measures 63 exponents at once, which is six
halvings.

A source's budget is its weight times ``budget`` tokens (by default, all that there are). Its documents
are dealt into blocks by a hash, blocks are put in a random order and so are documents within a block.
As many whole rounds as the budget pays for take every document; a last round takes documents from the
beginning of the permutation up to the rest of the budget, the one that crosses it too if that lands nearer (``tokens_before`` plus half its
tokens is no more than the rest), so a source of one document does not vanish. Only sums per block cross blocks, so a source
of a third of all rows is never in one task.

DataFrame functions only. Tokens are counted as words, runs of characters that are no ASCII white space.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm.common import fresh
from leadloom.scale import join_summary
from leadloom.session import materialize

ENTROPY = 0.95
MAX_REPEATS = 4.0
BLOCK_DOCS = 1024
SEED = 6
HALVINGS = 6  # a pass
PASSES = 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def measure(sources: DataFrame, exponents: list[float], budget_share: float) -> dict[float, tuple[float, float]]:
    """Per exponent the entropy of the weights and how often the most repeated source is repeated."""
    power = F.pow("share", F.col("t"))
    rows = (sources.where(F.col("share") > 0).select("share", F.explode(F.array(*map(F.lit, exponents))).alias("t"))
            .groupBy("t").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("a"), F.max(power / F.col("share")).alias("m")))
    return {r["t"]: (math.log(r["z"]) - r["t"] * r["a"] / r["z"], budget_share * r["m"] / r["z"]) for r in rows.collect()}


def find_exponent(sources: DataFrame, budget_share: float, entropy: float, max_repeats: float) -> float:
    """The exponent, to six places. ``sources`` has a share per source; without any, 1."""
    n = sources.where(F.col("share") > 0).count()
    if not n:
        return 1.0
    target = entropy * math.log(n)
    flat, rare = [0.0, 1.0], [0.0, 1.0]  # from .. to; flat enough at the lower end, rare enough at the upper
    for _ in range(PASSES):
        step = 1 << HALVINGS
        asked = sorted({b[0] + (b[1] - b[0]) * i / step for b in (flat, rare) for i in range(step + 1)})
        found = measure(sources, asked, budget_share)
        here = [t for t in asked if flat[0] <= t <= flat[1] and found[t][0] >= target - 1e-12]
        above = [t for t in asked if flat[0] <= t <= flat[1] and t > max(here, default=0.0)]
        flat = [max(here, default=0.0), min(above, default=max(here, default=0.0))]
        here = [t for t in asked if rare[0] <= t <= rare[1] and found[t][1] <= max_repeats + 1e-12]
        below = [t for t in asked if rare[0] <= t <= rare[1] and t < min(here, default=1.0)]
        rare = [max(below, default=min(here, default=1.0)), min(here, default=1.0)]
    return round(max(flat[0], rare[1]), 6)


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", entropy: float = ENTROPY,
        max_repeats: float = MAX_REPEATS, budget: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """Add n_tokens, weight (of the source), tokens_before (in its permutation) and copies (how often the mixture holds the row).

    All rows and columns stay; added names replace columns of the same name. Rows without source are a
    source of their own. Rows that repeat id, source and text are one document whose tokens count for
    all of them. Rows without tokens cost nothing. An empty table stays empty.
    """
    own = dict(zip(fresh(docs, "source", "id", "hash"), (F.col(source).cast("string"), F.col(doc_id).cast("string"), F.coalesce(F.xxhash64(text), F.lit(0)))))
    rows, keys = docs.withColumns(own), ("__source", "__id", "__hash")
    units = rows.select(*[F.col(c).alias(k) for c, k in zip(own, keys)], word_count(F.col(text)).alias("tokens")).groupBy(*keys).agg(
        F.first("tokens").alias("n_tokens"), F.sum("tokens").alias("tokens"))
    units = materialize(units)
    sources = units.groupBy("__source").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("units"))
    total = sources.agg(F.sum("held")).first()[0] or 0
    budget = total if budget is None else budget
    sources = materialize(sources.withColumn("share", F.col("held") / F.lit(float(total or 1))))
    exponent = find_exponent(sources, budget / (total or 1), entropy, max_repeats)
    norm = sources.where(F.col("share") > 0).agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
    weight = F.when(F.col("share") > 0, F.round(F.pow("share", F.lit(exponent)) / F.lit(norm), 12)).otherwise(0.0)
    sources = sources.withColumn("weight", weight).withColumn("own", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))
    sources = sources.select("__source", "units", "weight", "held", F.ceil(F.col("units") / block_docs).alias("blocks"),
                             F.when(F.col("held") > 0, F.floor(F.col("own") / F.col("held"))).otherwise(0).alias("rounds"), "own")
    sources = sources.withColumn("rest", F.col("own") - F.col("rounds") * F.col("held")).drop("own", "held")

    def mark(*parts):
        return F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]), "UTF-8"))

    dealt = join_summary(units, sources, ["__source"], "units").withColumn("__mark", mark(F.col("__source"), F.col("__id")))
    dealt = dealt.withColumn("__block", F.conv(F.substring("__mark", 1, 8), 16, 10).cast("long") % F.col("blocks"))
    inside = Window.partitionBy("__source", "__block").orderBy("__mark", "__id", "__hash").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("__inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    blocks = dealt.groupBy("__source", "__block").agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.withColumn("__order", mark(F.col("__source"), F.lit("block"), F.col("__block")))
    earlier = Window.partitionBy("__source").orderBy("__order", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("__source").alias("__of"), F.col("__block").alias("__in"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("__earlier"))
    placed = dealt.join(blocks, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__block") == F.col("__in")))
    before = F.col("__earlier") + F.col("__inside")
    of = fresh(docs, "source_of", "id_of", "hash_of")
    placed = placed.select(*[F.col(k).alias(c) for k, c in zip(keys, of)], "n_tokens", "weight", before.alias("tokens_before"),
                           (F.col("rounds") + F.when(2 * before + F.col("tokens") <= 2 * F.col("rest"), 1).otherwise(0)).cast("int").alias("copies"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(own, of)]
    added = ["n_tokens", "weight", "tokens_before", "copies"]
    kept = [c for c in docs.columns if c.lower() not in added]
    return rows.select(*kept, *own).join(placed, same).select(*kept, *added)


def realised(docs: DataFrame, **settings) -> DataFrame:
    """The mixture: every row of ``docs`` as often as it is drawn; the columns of ``docs``, those of the names ``mix`` adds included."""
    added = ["n_tokens", "weight", "tokens_before", "copies"]
    clashing = [c for c in docs.columns if c.lower() in added]
    aside = dict(zip(clashing, fresh(docs, *clashing)))
    mixed = mix(docs.withColumnsRenamed(aside), **settings).where(F.col("copies") > 0)
    drawn = mixed.withColumn(fresh(mixed, "copy")[0], F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return drawn.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
