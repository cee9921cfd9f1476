"""Ranks over a whole table without sending it to one task.

Rows are dealt to value ranges whose bounds are approximate quantiles, or a bounded sample of keys
where an order has several columns, counted per range, and numbered inside their range. The bounds (at
most ``BOUNDS`` a column) and the ranges' counts are read when the DataFrame is
built, by two small jobs, and stand in the plan as constants; so the plan holds its
input once or twice, not once for every number it needs. Each function reads its
input a few times: pass a stored table (``sources.write_once``).
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of the value ranges, the same in every run. A key is compared with the last bound of each of FAN groups, then
# with the bounds of one group.
FAN = 16
BOUNDS = FAN * FAN - 1


def _with_range(keys: DataFrame, key: str) -> DataFrame:
    """Adds ``_range``: the number of the value range that a row's key lies in."""
    sample = keys.select(F.struct(F.col(key).alias("k")).alias("s")).orderBy(F.xxhash64("s"), "s").limit(BOUNDS)
    ordered = F.array_sort(F.collect_list("s"))
    groups = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.slice("o", i * FAN + 1, FAN))
    found = sample.agg(ordered.alias("o")).select(
        F.to_json(groups), F.to_json(F.transform(F.filter(groups, lambda g: F.size(g) == FAN), lambda g: F.element_at(g, -1)))).first()
    kind = T.ArrayType(T.StructType([T.StructField("k", keys.schema[key].dataType)]))
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b["k"] < F.col(key)))
    return keys.withColumn("_group", below(F.from_json(F.lit(found[1]), kind))).withColumn(
        "_range", F.col("_group") * FAN + below(F.get(F.from_json(F.lit(found[0]), T.ArrayType(kind)), F.col("_group")))).drop("_group")


def _value_ranges(df: DataFrame, values: list[Column]) -> tuple[Column, int]:
    """The number of the value range of a ``_key`` (c, z, v), column after column; and how many there are.

    Bounds are approximate quantiles, at most ``BOUNDS`` a column, from one aggregate. Numbers are compared with
    numbers: structs take ten times as long. NULLs have a range of their own, the first or (z) the last."""
    # One text for all shares: literals cost a call each.
    shares = F.expr(f"array({', '.join(f'{k / (BOUNDS + 1)}D' for k in range(1, BOUNDS + 1))})")
    found = df.agg(*[F.percentile_approx(v.cast("double"), shares, 4 * BOUNDS).alias(f"q{i}") for i, v in enumerate(values)]).first()
    bounds = [sorted(set(own or [])) for own in found]
    groups = [[own[i:i + FAN] for i in range(0, len(own), FAN)] + [[]] for own in bounds]
    lasts = [[g[-1] for g in own if len(g) == FAN] for own in groups]
    known = lambda x, kind: F.get(F.from_json(F.lit(json.dumps(x)), kind), F.col("_key.c"))
    below = lambda x: F.size(F.filter(x, lambda b: b < F.col("_key.v")))
    width = max(map(len, bounds)) + 3
    group = below(known(lasts, "array<array<double>>"))
    place = group * FAN + below(F.get(known(groups, "array<array<array<double>>>"), group)) + 1
    own = F.when(F.col("_key.v").isNotNull(), place).when(F.col("_key.z"), F.lit(width - 1)).otherwise(F.lit(0))
    return F.col("_key.c") * width + own, width * len(values)


def with_cumulative(keys: DataFrame, key: str, count: str, out: str) -> tuple[DataFrame, int]:
    """Adds ``out``: the sum of ``count`` over all rows with a smaller ``key``; and the whole sum.

    ``key`` must be unique and not NULL (a struct may hold NULLs; they come first).
    """
    ranged = _with_range(keys, key)
    return _cumulative(ranged, dict(ranged.groupBy("_range").agg(F.sum(count)).collect()), BOUNDS + 1, key, count, out)


def _cumulative(ranged: DataFrame, found: dict, ranges: int, key: str, count: str, out: str) -> tuple[DataFrame, int]:
    """``with_cumulative`` of rows with their ``_range``, where ``found`` has the ranges' sums."""
    sums = list(accumulate((found.get(i, 0) for i in range(ranges)), initial=0))
    before = F.get(F.from_json(F.lit(str(sums)), "array<bigint>"), F.col("_range"))
    inner = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(count).over(inner), F.lit(0))
    return ranged.withColumn(out, (before + inside).cast("bigint")).drop("_range"), sums[-1]


def with_row_number(df: DataFrame, order: list[Column], out: str) -> tuple[DataFrame, int]:
    """ROW_NUMBER() OVER (ORDER BY order) for an order that is unique for each row, NULLs first; and the number of rows."""
    keyed = df.withColumn("_key", F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]))
    placed, total = with_cumulative(keyed.withColumn("_one", F.lit(1).cast("bigint")), "_key", "_one", out)
    return placed.withColumn(out, F.col(out) + 1).drop("_key", "_one"), total


def with_percent_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds PERCENT_RANK() OVER (ORDER BY column ASC NULLS FIRST) for each output -> column.

    No two rows of ``df`` are equal. All columns share the passes: their values are stacked,
    counted by (column, value), and the count of smaller values is joined back, once for
    all, so rows of one value cost a row of the counted table however many they are.
    """
    joined, total = _with_smaller(df, {o: F.col(c) for o, c in columns.items()})
    share = [(F.col(f"_smaller_{o}") / F.lit(float(max(total - 1, 1)))).alias(o) for o in columns]
    return joined.select(*df.columns, *share)


def with_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds RANK() OVER (ORDER BY column DESC); NULLs last. No two rows of ``df`` are equal."""
    joined, _ = _with_smaller(df, {out: -F.col(column)}, nulls_last=True)
    return joined.select(*df.columns, (F.col(f"_smaller_{out}") + 1).cast("int").alias(out))


def _with_smaller(df: DataFrame, values: dict[str, Column], nulls_last: bool = False) -> tuple[DataFrame, int]:
    """Adds for each output the number of rows whose value is smaller; and the number of rows."""
    parts = [F.struct(F.lit(i).alias("c"), (v.isNull() & F.lit(nulls_last)).alias("z"), v.cast("double").alias("v"))
             for i, v in enumerate(values.values())]
    stacked = df.select(*df.columns, F.explode(F.array(*parts)).alias("_key"))
    counts = stacked.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    place, ranges = _value_ranges(df, list(values.values()))
    # Rows are counted without their values: nothing but the ranges' numbers is shuffled.
    found = dict(stacked.select(place.alias("_range")).groupBy("_range").count().collect())
    below, total = _cumulative(counts.withColumn("_range", place), found, ranges, "_key", "_n", "_below")
    # Counts run over all columns, one after the other; each column has as many rows as df.
    total //= len(values)
    placed = stacked.join(below.select("_key", "_below"), "_key").withColumn(
        "_below", F.col("_below") - F.col("_key.c") * F.lit(total))
    picks = [F.max(F.when(F.col("_key.c") == i, F.col("_below"))).alias(f"_smaller_{o}") for i, o in enumerate(values)]
    # Rows differ, so each is a group of its own, and its columns need no aggregate.
    return placed.groupBy(*df.columns).agg(*picks), total
