"""Ordered computations that stay distributed when one key holds a third of the rows.

A plain ``row_number()`` or running ``sum()`` over ``PARTITION BY key`` sorts the whole key in one
task. The helpers here cut every key into *blocks* along the order: ``with_block`` takes the
borders from approximate quantiles of all rows, so a block never holds more than about one in
``BLOCKS`` of them, however the values lie and whatever a key holds. Windows run inside
``(key, block)``; one summary row per block crosses block borders, at most ``BLOCKS`` of a key.

Top-k per group needs none of this: ``row_number() <= k`` plans a WindowGroupLimit, which keeps k
rows per key in every map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = 1024


def with_block(df: DataFrame, value: Column, of: DataFrame | None = None, name: str = "__part", blocks: int = BLOCKS) -> DataFrame:
    """Rows with their counted block by a whole-number value that the order rises with.

    The borders are a scalar subquery over ``of`` (by default the rows themselves): one more pass over
    this column, which nothing but ``blocks`` numbers leaves. NULL values come into block 0.
    """
    value = value.cast("long")
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    borders = (df if of is None else of).select(F.percentile_approx(value, shares, F.lit(20 * blocks))).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((blocks - 1).bit_length()))])

    def further(at, step):  # binary search: how many borders are not above the value
        return F.when(F.try_element_at("__borders", at + step) <= value, at + step).otherwise(at)

    return df.withColumn("__borders", borders).withColumn(name, F.aggregate(steps, F.lit(0), further)).drop("__borders")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys, of which NULL equals NULL."""
    names = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right, on).drop(*names.values()) if keys else left.crossJoin(right)


def not_broadcast(df: DataFrame) -> DataFrame:
    """Rows that joins sort and shuffle. Spark's estimate leaves out how many rows an explode makes, so it would broadcast tables
    made by one, and adaptive execution keeps such a plan because any other has more shuffles."""
    return df.hint("merge")


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small table that are about to become many, in as many tasks as a shuffle has: a file of them is one task, and
    adaptive execution would join partitions again by what they hold before."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group (pre-limited in each map task)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], levels: Sequence[Column],
              out: str = "position") -> DataFrame:
    """0-based position of every row in its group.

    ``levels`` are non-decreasing along ``order``, coarse to fine; a full combination covers a
    bounded number of rows (the last is usually that of ``with_block``). NULL keys are a group. Offsets are added up level by level, so no task ever sees more than
    one block of rows or one level of block counts.
    """
    names = [f"__level{i}" for i in range(len(levels))]
    keys = list(keys)
    df = df.withColumns(dict(zip(names, levels)))
    block = keys + names
    counts = df.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts
    for depth, name in enumerate(names):
        parent, here = keys + names[:depth], keys + names[: depth + 1]
        before = Window.partitionBy(*parent).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        level = counts if depth == len(names) - 1 else counts.groupBy(*here).agg(F.sum("__n").alias("__n"))
        level = level.select(*here, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__before{depth}"))
        offsets = level if len(names) == 1 else _same(offsets, level, here)
    total = sum((F.col(f"__before{i}") for i in range(len(names))), F.lit(0))
    offsets = offsets.select(*block, total.alias("__offset"))
    inside = Window.partitionBy(*block).orderBy(*order)
    return (_same(df.withColumn("__row", F.row_number().over(inside)), offsets, block)
            .withColumn(out, (F.col("__offset") + F.col("__row") - 1).cast("long"))
            .drop("__row", "__offset", *names))


def running(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], *,
            sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None,
            before: bool = False) -> DataFrame:
    """Running sums and last non-NULL values along the order of each group.

    With ``before`` the row itself is left out (what held when the row arrived). NULL keys are a group.
    """
    sums, lasts, keys = dict(sums or {}), dict(lasts or {}), list(keys)
    inputs = {f"__in_{name}": column for name, column in {**sums, **lasts}.items()}
    df = df.withColumns({"__block": block, **inputs})
    group = [*keys, "__block"]
    end = -1 if before else 0
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = df.withColumns({
        **{f"__local_{name}": F.coalesce(F.sum(f"__in_{name}").over(inside), F.lit(0)) for name in sums},
        **{f"__local_{name}": F.last(f"__in_{name}", ignorenulls=True).over(inside) for name in lasts},
    })
    position = F.struct(*order)
    totals = df.groupBy(*group).agg(
        *[F.sum(f"__in_{name}").alias(f"__total_{name}") for name in sums],
        *[F.max_by(f"__in_{name}", F.when(F.col(f"__in_{name}").isNotNull(), position)).alias(f"__total_{name}")
          for name in lasts])
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group,
        *[F.coalesce(F.sum(f"__total_{name}").over(earlier), F.lit(0)).alias(f"__carry_{name}") for name in sums],
        *[F.last(f"__total_{name}", ignorenulls=True).over(earlier).alias(f"__carry_{name}") for name in lasts])
    joined = _same(local, carried, group)
    result = joined.withColumns({
        **{name: F.col(f"__local_{name}") + F.col(f"__carry_{name}") for name in sums},
        **{name: F.coalesce(F.col(f"__local_{name}"), F.col(f"__carry_{name}")) for name in lasts},
    })
    return result.drop("__block", *inputs, *[f"{prefix}{name}" for name in [*sums, *lasts]
                                             for prefix in ("__local_", "__carry_")])


def _short(rows: DataFrame) -> list[Column]:
    """What tells most rows apart without reading long values: plain columns, and the first characters of texts."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    plain = [F.substring(c, 1, 32) if kind in ("string", "binary") else F.col(c) for c, kind in kinds.items()
             if kind not in ("map", "array", "struct", "variant")]
    return plain or [F.col(c) for c, kind in kinds.items() if kind in ("array", "struct")] or [F.lit(0)]


HOT_KEYS = 1024  # keys whose summary rows may travel to every task


def join_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str], size: str, how: str = "left",
                 keep_size: bool = False) -> DataFrame:
    """Join every row to the one summary row of its key; no key's rows meet in one task.

    Adaptive execution does not split a join against a ``groupBy`` of the same key, because the
    aggregate hands its partitioning on to the join. So the largest keys by ``size`` (rows per key)
    are broadcast, at most ``HOT_KEYS`` of them by LIMIT; every other key holds less than one in
    ``HOT_KEYS`` rows and meets its rows in a shuffled join, in which rows already served are dealt
    out by a hash of the row (of texts, their beginnings). The summary must have a row for every key that can be hot, matched
    or not: group the rows themselves. NULL keys match NULL keys. ``how`` is left or inner.
    """
    values = [c for c in summary.columns if c not in keys and (keep_size or c != size)]
    found = F.struct(*[F.col(c) for c in values])
    # the lane of a summary row is 0, computed so that the optimizer cannot take it out of the join's keys
    hot = summary.orderBy(F.desc(size), *keys).limit(HOT_KEYS)
    hot = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys], found.alias("__hot"))
    cold = summary.select(*[F.col(k).alias(f"__cold_{k}") for k in keys], F.least(F.col(size), F.lit(0)).cast("int").alias("__cold_lane"), found.alias("__cold"))
    same = [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys]
    rows_hash = F.pmod(F.xxhash64(*_short(rows)), F.lit(1 << 20))
    served = (rows.withColumn("__row_hash", rows_hash.cast("int")).join(F.broadcast(hot), same, "left")
              .withColumn("__lane", F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.col("__row_hash"))))
    same = [F.col("__lane") == F.col("__cold_lane")] + [F.col(k).eqNullSafe(F.col(f"__cold_{k}")) for k in keys]
    joined = served.join(cold, same, "left")
    if how == "inner":
        joined = joined.where(F.col("__hot").isNotNull() | F.col("__cold").isNotNull())
    both = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*[F.col(c) for c in rows.columns], *[both[c].alias(c) for c in values])
