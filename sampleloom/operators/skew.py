"""Per-key work when a handful of keys hold most records: fragment and replicate by estimated load.

A load plan counts rows by hash bucket of the key (one small shuffle, whatever the number of keys), counts keys only
inside overloaded buckets, splits keys above `shard_rows` into proportionate shards and packs shards and light buckets
onto tasks, largest first. There are BUCKETS_PER_TASK buckets to a task, so any number of tasks gets its share of light
keys. The driver holds the bucket counts and the heavy keys; as a heavy key has more than shard_rows rows and shard_rows
is at least rows / MAX_HEAVY, there are fewer than MAX_HEAVY of them and none is left out.

Null keys are kept as one key by the aggregation and match nothing in the join, as in SQL. Empty inputs give an empty
plan and empty results. Columns of ours are given names that clash with none of the caller's.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.session import cut, fresh_name

#: Light keys are packed by this many hash buckets for each task.
BUCKETS_PER_TASK = 16
#: Heavy keys are fewer than this; the plan with them is sent to the tasks.
MAX_HEAVY = 100_000
#: Most bytes of a side that is broadcast.
MAX_BROADCAST = 32 << 20


def key_hash(*keys: str) -> Column:
    """A 64-bit hash of the key; heavy keys are known by it, so two keys of one hash would share shards, not results."""
    return F.xxhash64(*keys)


@dataclass(frozen=True)
class LoadPlan:
    """Which task does what: `heavy` maps a key hash to the tasks of its shards, `light` a bucket to its task."""

    tasks: int
    heavy: dict[int, list[int]] = field(default_factory=dict)
    light: list[int] = field(default_factory=lambda: [0])


def _rows(weight: str | None) -> Column:
    return (F.sum(weight) if weight else F.count("*")).alias("n")


def bucket_loads(df: DataFrame, keys: list[str], buckets: int, weight: str | None = None) -> list[int]:
    """Rows of each hash bucket of the key: one pass with partial sums, `buckets` rows to the driver."""
    counts = {r["b"]: r["n"] for r in df.groupBy(F.pmod(key_hash(*keys), F.lit(buckets)).alias("b")).agg(_rows(weight)).collect()}
    return [counts.get(b, 0) for b in range(buckets)]


def heavy_loads(df: DataFrame, keys: list[str], loads: list[int], shard_rows: int, weight: str | None = None) -> tuple[dict[int, int], list[int]]:
    """Rows of each key with more than shard_rows rows, and of each bucket without these; keys are counted only in
    buckets above shard_rows."""
    over, loads = [b for b, n in enumerate(loads) if n > shard_rows], list(loads)
    if not over:
        return {}, loads
    h, buckets = key_hash(*keys), len(loads)
    per_key = df.where(F.pmod(h, F.lit(buckets)).isin(over)).groupBy(h.alias("h")).agg(_rows(weight)).where(F.col("n") > shard_rows)
    heavy = {r["h"]: r["n"] for r in per_key.collect()}  # fewer than rows / shard_rows
    for h_, n in heavy.items():
        loads[h_ % buckets] -= n
    return heavy, loads


def plan_load(df: DataFrame, keys: list[str], tasks: int | None = None, shard_rows: int | None = None, weight: str | None = None) -> LoadPlan:
    """Bin-pack the keys of df onto tasks (default: the session's shuffle partitions), no shard above shard_rows rows.

    The default of shard_rows is a quarter of a task's fair share; below 1000 rows nothing is worth a split. A given
    shard_rows is raised to rows / MAX_HEAVY where it is less than that. With `weight`, a column of counts, a row of df
    stands for so many rows.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loads = bucket_loads(df, keys, BUCKETS_PER_TASK * tasks, weight)
    shard_rows = max(shard_rows or max(1000, math.ceil(sum(loads) / (4 * tasks))), math.ceil(sum(loads) / MAX_HEAVY))
    heavy, loads = heavy_loads(df, keys, loads, shard_rows, weight)
    parts = []
    for h, n in heavy.items():
        shards = math.ceil(n / shard_rows)
        parts += [(n / shards, ("heavy", h))] * shards
    parts += [(n, ("light", b)) for b, n in enumerate(loads)]
    parts.sort(key=lambda x: (-x[0], x[1]))
    free = [(0.0, t) for t in range(tasks)]
    placed: dict[int, list[int]] = {}
    light = [0] * len(loads)
    for n, (kind, what) in parts:
        load, task = heapq.heappop(free)
        heapq.heappush(free, (load + n, task))
        if kind == "heavy":
            placed.setdefault(what, []).append(task)
        else:
            light[what] = task
    return LoadPlan(tasks, placed, light)


def _with_plan(df: DataFrame, plan: LoadPlan, keys: list[str], to_shards) -> tuple[DataFrame, str, str]:
    """df with its shard and task; to_shards says which of a heavy key's shards a row goes to."""
    shard, task = fresh_name("shard", df.columns), fresh_name("task", df.columns)
    h, tasks = fresh_name("hash", df.columns), fresh_name("tasks", df.columns)
    spread = df.withColumn(h, key_hash(*keys))
    if plan.heavy:
        small = df.sparkSession.createDataFrame(list(plan.heavy.items()), f"{h} long, {tasks} array<int>")
        spread = spread.join(F.broadcast(small), h, "left")  # fewer than MAX_HEAVY keys
        spread = spread.withColumn(shard, to_shards(F.col(tasks)))
    else:
        spread = spread.withColumn(tasks, F.lit(None).cast("array<int>")).withColumn(shard, F.lit(0))
    # one constant, however many buckets there are
    light = F.element_at(F.split(F.lit(",".join(map(str, plan.light))), ",").cast("array<int>"), F.pmod(F.col(h), F.lit(len(plan.light))).cast("int") + 1)
    spread = spread.withColumn(task, F.coalesce(F.get(F.col(tasks), F.col(shard)), light)).drop(h, tasks)
    return spread, shard, task


def fragment(df: DataFrame, plan: LoadPlan, keys: list[str], by: list[str]) -> tuple[DataFrame, str, str]:
    """Each row with one shard of its key, chosen by the hash of `by`, and the shard's task: (rows, shard, task)."""
    return _with_plan(df, plan, keys, lambda tasks: F.coalesce(F.pmod(F.xxhash64(*by), F.size(tasks).cast("long")).cast("int"), F.lit(0)))


def replicate(df: DataFrame, plan: LoadPlan, keys: list[str]) -> tuple[DataFrame, str, str]:
    """The matching side: each row once for every shard of its key (once for a light key)."""
    return _with_plan(df, plan, keys, lambda tasks: F.explode(F.when(tasks.isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(tasks) - 1))))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", plan: LoadPlan | None = None, by: list[str] | None = None) -> DataFrame:
    """left JOIN right USING (key) with the heavy keys of left spread over shards; how: inner, left or left_semi.

    Without a plan, the loads of left are counted first. `by` spreads the rows of a key (default: all columns of left).
    """
    plan = plan or plan_load(left, [key])
    if not plan.heavy:
        return left.join(right, key, how)
    a, shard, task = fragment(left, plan, [key], by or left.columns)
    b, shard_b, task_b = replicate(right, plan, [key])
    b = b.withColumnRenamed(shard_b, shard).drop(task_b)
    return a.drop(task).join(b, [key, shard], how).drop(shard)


def broadcastable(df: DataFrame) -> bool:
    """Whether df's rows are found to take at most MAX_BROADCAST bytes (as JSON, names left out), and to be at most MAX_HEAVY."""
    size = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.array(*(F.col(c).cast("string") for c in df.columns))))).alias("b")).first()
    return size["n"] <= MAX_HEAVY and (size["b"] or 0) <= MAX_BROADCAST


def join_dimension(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows JOIN small, where small has a row or a few per key: it is broadcast if its rows and bytes are found to be
    few (`broadcastable`), else joined by fragments; either way no key of rows is gathered in one task."""
    small = cut(small)
    if broadcastable(small):
        return rows.join(F.broadcast(small), keys, how)
    packed = fresh_name("key", [*rows.columns, *small.columns])
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    whole = lambda df: df.withColumn(packed, F.when(known, F.to_json(F.struct(*keys))))
    return fragment_replicate_join(whole(rows), whole(small).drop(*keys), packed, how).drop(packed)


def sharded_aggregate(df: DataFrame, keys: list[str], by: list[str], partial: dict[str, Column], final: dict[str, Column], plan: LoadPlan | None = None, per_item: dict[str, Column] | None = None) -> DataFrame:
    """Per-key results in two steps: `partial` within a shard, `final` over the shards (it names the partial columns).

    Rows of equal `by` share a shard. With `per_item`, the rows of one (key, by) are first made one row by these
    aggregates, so that repeats count once; it takes no further shuffle.
    """
    plan = plan or plan_load(df, keys)
    rows, shard, task = fragment(df, plan, keys, by)
    rows = rows.drop(shard).repartitionById(plan.tasks, F.col(task))
    if per_item is not None:
        rows = rows.groupBy(task, *keys, *by).agg(*(c.alias(k) for k, c in per_item.items()))
    shards = rows.groupBy(task, *keys).agg(*(c.alias(k) for k, c in partial.items()))
    return shards.groupBy(*keys).agg(*(c.alias(k) for k, c in final.items()))
