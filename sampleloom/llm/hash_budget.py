"""Nested hash thresholds: the rows of least hash of a group whose weights reach a budget, found without sorting rows.

Weights are summed by group and hash bucket (partial sums before the shuffle; groups x BUCKETS rows whatever the input),
running sums over the buckets find the bucket in which each budget ends, and only that bucket is refined: its rows are
summed by BUCKETS finer buckets. What is left to look at row by row is one of BUCKETS x BUCKETS buckets of a group.
Thresholds of one group nest: a larger budget keeps what a smaller one keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.operators.skew import join_dimension

#: Buckets of the 60-bit hash, and of each bucket that is refined.
BITS = 12
BUCKETS = 1 << BITS


def hash63(*cols: str, seed: str = "") -> Column:
    """A hash from 0 to 2^63-1 that other engines can compute too: 15 hex digits of an md5."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bucket(h: Column) -> Column:
    """The bucket of a 60-bit hash."""
    return F.shiftright(h, 60 - BITS).cast("int")


def fine_bucket(h: Column) -> Column:
    """The refined bucket of a 60-bit hash."""
    return F.shiftright(h, 60 - 2 * BITS).cast("int")


def _ends(sums: DataFrame, budgets: DataFrame, group: list[str], budget_id: list[str], key: list[str]) -> DataFrame:
    """budgets with e: the least bucket in which `start` and the sums of key's buckets up to it reach the budget, and the sum before."""
    upto = Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most BUCKETS rows
    sums = sums.withColumn("upto", F.sum("w").over(upto))
    reached = F.col("start") + F.col("upto")
    return budgets.join(sums, key, "left").groupBy(*budget_id, *group, "budget").agg(
        F.min(F.when(reached >= F.col("budget"), F.struct("b", (reached - F.col("w")).alias("before")))).alias("e"), F.coalesce(F.max(reached), F.lit(0)).alias("all")
    )


def boundaries(rows: DataFrame, budgets: DataFrame, group: list[str], budget_id: list[str]) -> DataFrame:
    """budgets with the fine bucket `b` in which their `budget` ends (BUCKETS^2: it isn't reached) and the sum `before` it.

    rows: group columns, h, weight. budgets: budget_id and group columns, budget.
    """
    coarse = rows.groupBy(*group, bucket(F.col("h")).alias("b")).agg(F.sum("weight").alias("w"))
    first = _ends(coarse, budgets.withColumn("start", F.lit(0)), group, budget_id, group)
    first = first.select(*budget_id, *group, "budget", F.col("e.b").alias("coarse"), F.col("e.before").alias("start"), "all")
    some = first.where("coarse is not null").select(*budget_id, *group, "budget", "coarse", "start")
    near = join_dimension(rows.withColumn("coarse", bucket(F.col("h"))), some, [*group, "coarse"])
    fine = near.groupBy(*budget_id, *group, fine_bucket(F.col("h")).alias("b")).agg(F.sum("weight").alias("w"))
    second = _ends(fine, some, group, budget_id, [*budget_id, *group]).select(*budget_id, *group, "e")
    both = first.join(second, [*budget_id, *group], "left")
    return both.select(*budget_id, *group, "budget", F.coalesce("e.b", F.lit(BUCKETS * BUCKETS)).alias("b"), F.coalesce("e.before", "all").alias("before"))
