"""Ranks, running sums and quantiles over any number of rows: no window without a partition, no group in one task.

Rows are partitioned by ranges of (group, order) and written to the shared folder with their range; each range's sums
(one row for a range and group) give the offsets of the ranges after it, and windows run within ranges only. Ranges are
cut by sampling, which affects their sizes, never results. Equal rows of a total order may end up in any of their places.
Inputs that the planner estimates at SMALL bytes or less are one range: a plain window gives the same at less fixed cost.

Empty tables give no rows (quantiles of all rows: one row of nulls). Null and NaN values have no place among quantiles.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.session import cut, fresh_name


#: Bytes of an input, as the planner estimates them, that one range may have.
SMALL = 8 << 20


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def running(df: DataFrame, order: Iterable[Column], sums: dict[str, Column], by: Iterable[str] = ()) -> DataFrame:
    """df with, for each name of sums, the sum of that expression over the rows up to and with this one in its group.

    Within a range rows of equal order are summed one by one, so make the order total or the rows distinct.
    """
    by, order = list(by), list(order)
    if _estimated_bytes(df) <= SMALL:
        upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    part, packed = fresh_name("part", [*df.columns, *sums]), fresh_name("group", [*df.columns, *sums])
    own = {n: fresh_name(f"own{k}", [*df.columns, *sums]) for k, n in enumerate(sums)}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.withColumns({packed: F.to_json(F.struct(*by)) if by else F.lit("")} | {own[n]: c for n, c in sums.items()})
    x = cut(x.repartitionByRange(tasks, *(F.col(c) for c in by), *order).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(packed).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = x.groupBy(packed, part).agg(*(F.sum(o).alias(o) for o in own.values()))
    parts = parts.select(packed, part, *(F.coalesce(F.sum(o).over(before), F.lit(0)).alias(f"{o}_before") for o in own.values()))
    within = Window.partitionBy(packed, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(parts, [packed, part])
    return x.withColumns({n: F.sum(o).over(within) + F.col(f"{o}_before") for n, o in own.items()}).select(*df.columns, *sums)


def global_rank(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """1..N in the given total order, over all rows."""
    return running(df, order, {out: F.lit(1).cast("long")}).withColumn(out, F.col(out).cast("int"))


def quantiles(df: DataFrame, value: str, probabilities: Iterable[float], by: Iterable[str] = ()) -> DataFrame:
    """by and q: the exact quantiles of value in each group, between neighbours by distance (as SQL's quantile_cont).

    Values become (group, value, count) first; only the two values around each quantile leave their range.
    """
    by, probabilities = list(by), list(probabilities)
    v = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    upto = running(v, [F.col("_v")], {"_upto": F.col("_c")}, by)
    total = upto.groupBy(*by).agg(F.max("_upto").alias("_n"))
    if by:
        same = [F.col(f"_k{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)]
        named = total.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)), "_n")
        x = upto.join(named, same).drop(*(f"_k{k}" for k in range(len(by))))
    else:
        x = upto.crossJoin(F.broadcast(total))  # one row
    picks = []
    for k, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for end, place in (("l", F.floor(at)), ("h", F.ceil(at))):
            picks.append(F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place), F.col("_v"))).alias(f"_{end}{k}"))
    g = x.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)

    def between(k: int, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_l{k}"), F.col(f"_h{k}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return g.select(*by, F.array(*(between(k, p) for k, p in enumerate(probabilities))).alias("q"))


def with_quantiles(grouped: DataFrame, by: list[str], df: DataFrame, named: dict[str, tuple[str, float]], digits: int | None = 6) -> DataFrame:
    """grouped (a row per group of by, or one row) with a column for each name of named: (value column, probability)."""
    values: dict[str, list[tuple[str, float]]] = {}
    for name, (value, p) in named.items():
        values.setdefault(value, []).append((name, p))
    for value, wanted in values.items():
        q = quantiles(df, value, [p for _, p in wanted], by)
        cell = lambda k: F.round(F.col("q")[k], digits) if digits is not None else F.col("q")[k]
        q = q.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)), *(cell(k).alias(n) for k, (n, _) in enumerate(wanted)))
        if by:
            grouped = grouped.join(q, [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(by)], "left").drop(*(f"_k{k}" for k in range(len(by))))
        else:
            grouped = grouped.crossJoin(F.broadcast(q))  # one row
    return grouped
