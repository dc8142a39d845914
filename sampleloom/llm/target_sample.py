"""A sample whose category shares match targets, by divisor-method priorities (rank - 0.5) / target.

In each batch the candidates of a category get a random rank. The first min_rows of each category come first, then the
smallest priorities of the batch up to the draw size; equal priorities go by rank and category. Seats that an exhausted
category can't fill go to the next priorities by themselves. How many seats each category gets follows from the counts
of candidates alone (`seats`: one row a category), so candidates of a batch never meet in one place: they are counted by
category and hash bucket, which gives each bucket its first rank, buckets beyond a category's seats are left out, and
candidates are ranked within their bucket only. A category with a third of all rows is spread over thousands of buckets.

Candidates are distinct (batch, category, candidate keys); a null batch, category or first key makes a row
no candidate, other keys may be null. Categories
are compared as simple words. Categories without a target are not drawn; targets without candidates are reported with 0.
A null or negative target counts as 0, a null min_rows as 0, a null draw size as 0. Repeated target rows count once.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.functions.text import simple_words
from sampleloom.llm.hash_budget import bucket, hash63
from sampleloom.operators.skew import join_dimension
from sampleloom.session import cut


def _targets(targets: DataFrame, batch: str, category: str) -> DataFrame:
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    rows = targets.select(F.col(batch).alias("batch"), F.col(category).alias("name"), simple_words(F.col(category)).alias("cat"), zero("target").alias("target"), zero("min_rows").alias("least"), zero("draw_size").alias("draw"), F.coalesce("target_share", F.lit(0.0)).alias("share"))
    return rows.where("batch is not null and cat is not null").groupBy("batch", "cat").agg(*(F.max(c).alias(c) for c in ("name", "target", "least", "draw", "share")))


def _candidates(rows: DataFrame, batch: str, category: str, keys: list[str], seed: str) -> DataFrame:
    named = rows.select(F.col(batch).alias("batch"), simple_words(F.col(category)).alias("cat"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    ids = [f"k{i}" for i in range(len(keys))]
    return named.dropna(subset=["batch", "cat", "k0"]).dropDuplicates(["batch", "cat", *ids]).withColumn("h", hash63("batch", "cat", *ids, seed=seed))


def _counted(rows: DataFrame, targets: DataFrame, batch: str, category: str, keys: list[str], seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, candidates with their hash bucket, and candidates by category and bucket; the last two are written once."""
    have = cut(_candidates(rows, batch, category, keys, seed).withColumn("b", bucket(F.col("h"))))
    return _targets(targets, batch, category), have, cut(have.groupBy("batch", "cat", "b").agg(F.count("*").alias("n")))


def target_report(goal: DataFrame, sums: DataFrame, batch: str, category: str) -> DataFrame:
    """Per target: batch, category as named there, target, min_rows, available candidates and the shortfall."""
    have = sums.groupBy("batch", "cat").agg(F.sum("n").alias("available"))
    need = F.greatest("target", "least")
    full = goal.join(have, ["batch", "cat"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return full.select(F.col("batch").alias(batch), F.col("name").alias(category), "target", F.col("least").alias("min_rows"), "available", F.greatest(need - F.col("available"), F.lit(0)).alias("shortfall"))


def seats(categories: list[tuple[str, int, int, int]], size: int) -> dict[str, int]:
    """Seats of each (category, available, target, floor) in a draw of `size`: floors first, then least priorities."""
    floor = {c: min(a, f) for c, a, t, f in categories}
    most = {c: a if t > 0 else floor[c] for c, a, t, f in categories}
    target = {c: t for c, a, t, f in categories}
    if sum(floor.values()) >= size:  # floors by rank and category
        low, high = 0, max(floor.values(), default=0)
        while low < high:
            level = (low + high + 1) // 2
            low, high = (level, high) if sum(min(n, level) for n in floor.values()) <= size else (low, level - 1)
        given = {c: min(n, low) for c, n in floor.items()}
        for c in sorted(c for c, n in floor.items() if n > low)[: size - sum(given.values())]:
            given[c] += 1
        return given

    def upto(c: str, x: float) -> int:
        """Ranks of a category with a priority of at most x."""
        n = min(most[c], math.floor(x * target[c] + 0.5)) if target[c] else 0
        while n < most[c] and target[c] and (n + 0.5) / target[c] <= x:
            n += 1
        while n > 0 and (n - 0.5) / target[c] > x:
            n -= 1
        return max(floor[c], n)

    low, high = 0.0, max([(most[c] + 1) / target[c] for c in most if target[c]], default=0.0)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(upto(c, middle) for c in most) <= size else (low, middle)
    given = {c: upto(c, low) for c in most}
    left = size - sum(given.values())
    # what is left has about one priority
    heads = [((given[c] + 0.5) / target[c], given[c] + 1, c) for c in most if given[c] < most[c]]
    heapq.heapify(heads)
    while left > 0 and heads:
        _, rank, c = heapq.heappop(heads)
        given[c], left = rank, left - 1
        if rank < most[c]:
            heapq.heappush(heads, ((rank + 0.5) / target[c], rank + 1, c))
    return given


def _batch_seats(pdf: pd.DataFrame) -> pd.DataFrame:
    given = seats(list(zip(pdf["cat"], pdf["available"].tolist(), pdf["target"].tolist(), pdf["least"].tolist())), int(pdf["draw"].max()))
    return pdf[["batch", "cat", "name"]].assign(seats=pdf["cat"].map(given))


def _drawn(goal: DataFrame, have: DataFrame, sums: DataFrame) -> DataFrame:
    """The drawn rows of have, with the target's name and their rank in the category."""
    ids = [c for c in have.columns if c not in ("batch", "cat", "h", "b")]
    available = sums.groupBy("batch", "cat").agg(F.sum("n").alias("available"))
    kinds = goal.join(available, ["batch", "cat"]).select("batch", "cat", "name", "available", F.col("target").cast("long").alias("target"), F.col("least").cast("long").alias("least"), F.col("draw").cast("long").alias("draw"))
    given = kinds.groupBy("batch").applyInPandas(_batch_seats, f"batch {kinds.schema['batch'].dataType.simpleString()}, cat string, name string, seats long")  # a row a target
    before = F.sum("n").over(Window.partitionBy("batch", "cat").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # at most BUCKETS rows
    first = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(given, ["batch", "cat"]).where("before < seats")
    near = join_dimension(have, first.select("batch", "cat", "b", "before", "name", "seats"), ["batch", "cat", "b"])
    ranked = near.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("batch", "cat", "b").orderBy("h", *ids)))
    return ranked.where("rank <= seats")


def draw(rows: DataFrame, targets: DataFrame, batch: str, category: str, keys: list[str], seed: str = "draw") -> DataFrame:
    """The drawn candidates: batch, category as named in targets, the keys, and their rank in the category."""
    drawn = _drawn(*_counted(rows, targets, batch, category, keys, seed))
    return drawn.select(F.col("batch").alias(batch), F.col("name").alias(category), *(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "rank")


def draw_report(rows: DataFrame, targets: DataFrame, batch: str, category: str, keys: list[str], seed: str = "draw") -> DataFrame:
    """target_report with the rows drawn of each category."""
    goal, have, sums = _counted(rows, targets, batch, category, keys, seed)
    drawn = _drawn(goal, have, sums).groupBy(F.col("batch").alias(batch), F.col("name").alias(category)).agg(F.count("*").alias("drawn"))
    return target_report(goal, sums, batch, category).join(drawn, [batch, category], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
