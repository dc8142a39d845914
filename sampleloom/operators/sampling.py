"""Deterministic sampling and allocation: the random key is an md5 of seed and key, which any engine can compute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.operators.order import global_rank, running
from sampleloom.operators.windows import ranked


def draw_key(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def uniform(df: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """k rows without replacement (all if there are fewer); a top-k by hash, no global sort."""
    return df.orderBy(draw_key(seed, key), key).limit(k)


def per_class(df: DataFrame, label: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows of each class."""
    return ranked(df.withColumn("_h", draw_key(seed, key)), F.col("_h"), F.col(key), by=[label], out="_k").where(F.col("_k") <= k).drop("_h", "_k")


def negatives(df: DataFrame, label: str, key: str, ratio: float, seed: str) -> DataFrame:
    """All positives and min(ratio x positives, available) negatives."""
    need = df.agg(F.floor(F.count_if(F.col(label) == 1) * F.lit(ratio)).alias("_need"))
    r = global_rank(df.where(F.col(label) == 0).withColumn("_h", draw_key(seed, key)), F.col("_h"), F.col(key), out="_k")
    drawn = r.crossJoin(F.broadcast(need)).where("_k <= _need").select(*df.columns)
    return df.where(F.col(label) == 1).unionByName(drawn)


def pools(key: str, **named: DataFrame) -> DataFrame:
    """(key, pool): union of pools in their order; a key in several keeps the first."""
    rows = None
    for place, (name, df) in enumerate(named.items()):
        part = df.select(key, F.lit(name).alias("pool"), F.lit(place).alias("_p"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min_by("pool", "_p").alias("pool"))


def weighted(df: DataFrame, key: str, weight: str, k: int, seed: str) -> DataFrame:
    """k rows without replacement with chances by weight (exponential keys)."""
    u = (F.conv(F.substring(draw_key(seed, key), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(16**13))
    return df.where(F.col(weight) > 0).orderBy(-F.ln(u) / F.col(weight), key).limit(k)


def even_allocation(capacity: DataFrame, key: str, available: str, target: int) -> DataFrame:
    """Seats as even as capacities allow, the shortfall going to those with room; `unmet` is what nobody can take.

    The water level is found over the sorted capacities: with all capacities at most c filled, the rest share evenly.
    """
    w = Window.orderBy(available, key).rowsBetween(Window.unboundedPreceding, -1)  # one row per category
    x = capacity.select(key, available).crossJoin(F.broadcast(capacity.agg(F.count("*").alias("_n"), F.sum(available).alias("_all"))))
    x = x.withColumn("_before", F.coalesce(F.sum(available).over(w), F.lit(0))).withColumn("_i", F.row_number().over(Window.orderBy(available, key)) - 1)
    x = x.withColumn("_left", F.lit(target) - F.col("_before")).withColumn("_m", F.col("_n") - F.col("_i"))
    x = x.withColumn("_full", F.col(available) * F.col("_m") <= F.col("_left"))
    open_ = x.where("not _full").agg(F.min("_i").alias("_first"))
    x = x.crossJoin(F.broadcast(open_))
    level = x.where("_i = _first").agg(F.max(F.floor(F.col("_left") / F.col("_m"))).alias("_level"), F.max(F.pmod(F.col("_left"), F.col("_m"))).alias("_extra"))
    x = x.crossJoin(F.broadcast(level))
    seats = F.when(F.col("_first").isNull() | (F.col("_i") < F.col("_first")), F.col(available)).otherwise(F.col("_level") + ((F.col("_n") - F.col("_i")) <= F.col("_extra")).cast("int"))
    return x.select(key, available, seats.cast("long").alias("seats"), F.greatest(F.lit(target) - F.col("_all"), F.lit(0)).cast("long").alias("unmet"))


def share_cap(df: DataFrame, label: str, key: str, percent: float, seed: str) -> DataFrame:
    """Classes sampled down to floor(percent of all rows); the freed rows aren't given to others."""
    n = df.agg(F.floor(F.count("*") * F.lit(percent) / 100).alias("_cap"))
    r = ranked(df.withColumn("_h", draw_key(seed, key)), F.col("_h"), F.col(key), by=[label], out="_k")
    return r.crossJoin(F.broadcast(n)).where("_k <= _cap").select(*df.columns)


def matched_classes(df: DataFrame, bucket: str, label: str, key: str, ratio: int, seed: str) -> DataFrame:
    """In each bucket p positives and ratio x p negatives, p being the most that both classes allow."""
    n = df.groupBy(bucket).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")).withColumn("_p", F.least(F.col("_pos"), F.floor(F.col("_neg") / ratio)))
    r = ranked(df.withColumn("_h", draw_key(seed, key)), F.col("_h"), F.col(key), by=[bucket, label], out="_k").join(n, bucket)
    return r.where(F.when(F.col(label) == 1, F.col("_k") <= F.col("_p")).otherwise(F.col("_k") <= F.col("_p") * ratio)).select(*df.columns)


def exact_thresholds(df: DataFrame, by: str, value: str, least: int = 5, most: int = 30) -> DataFrame:
    """Per group and m in [least, most]: a threshold with two decimals that exactly m values exceed, where there is one."""
    r = ranked(df, F.desc(value), by=[by], out="m").where(F.col("m") <= most + 1)
    mid = F.round((F.col(value) + F.lead(value).over(Window.partitionBy(by).orderBy("m"))) / 2, 2)
    cut = r.withColumn("threshold", mid).withColumn("_next", F.lead(value).over(Window.partitionBy(by).orderBy("m")))
    return cut.where((F.col("m").between(least, most)) & (F.col(value) > F.col("threshold")) & (F.col("_next") <= F.col("threshold"))).select(by, F.col("m").cast("int").alias("m"), "threshold")


#: Steps through the pairs of a group; the first that shares no factor with their number visits each once.
STEPS = (7919, 104729, 1299709, 15485863, 179424673)


def unordered_pairs(df: DataFrame, by: str, name: str, k: int, seed: str) -> DataFrame:
    """k different unordered pairs of each group (all, if there are fewer), by hash; no other pair is ever made.

    The n (n - 1) / 2 pairs of a group are numbered; from a start by hash, a step prime to their number gives k different
    numbers, and each number names its two places in the order of names. Null names are left out.
    """
    names = df.select(by, name).where(F.col(name).isNotNull() & F.col(by).isNotNull()).distinct()
    placed = running(names, [F.col(name)], {"_i": F.lit(1).cast("long")}, [by])
    groups = placed.groupBy(by).agg(F.max("_i").alias("_n")).withColumn("_m", F.expr("(_n * (_n - 1)) div 2")).where("_m > 0")
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"))), 1, 15), 16, 10).cast("long"), F.col("_m"))
    step = F.coalesce(*(F.when(F.col("_m") % p != 0, F.lit(p)) for p in STEPS), F.lit(1)).cast("long")
    turns = F.sequence(F.lit(0).cast("long"), F.least(F.col("_m"), F.lit(k)) - 1)
    picked = groups.select(by, "_n", "_m", start.alias("_s"), step.alias("_t"), F.explode(turns).alias("_j")).withColumn("_p", F.pmod(F.col("_s") + F.col("_j") * F.col("_t"), F.col("_m")))
    m = 2 * F.col("_n") - 1
    a = F.floor((m - F.sqrt((m * m - 8 * F.col("_p")).cast("double"))) / 2)
    first = lambda c: F.expr(f"({c} * (2 * _n - {c} - 1)) div 2")
    x = picked.withColumn("_a", a).withColumn("_a", F.when(first("_a") > F.col("_p"), F.col("_a") - 1).when(first("(_a + 1)") <= F.col("_p"), F.col("_a") + 1).otherwise(F.col("_a")))
    x = x.select(by, (F.col("_a") + 1).alias("_x"), (F.col("_p") - first("_a") + F.col("_a") + 2).alias("_y"))
    left, right = (placed.select(by, F.col("_i").alias(c), F.col(name).alias(n)) for c, n in (("_x", "a"), ("_y", "b")))
    return x.join(left, [by, "_x"]).join(right, [by, "_y"]).select(by, "a", "b")


def longest_match(text: str, df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The first vocabulary entry in the text, longer entries being tried first."""
    tries = sorted(set(vocabulary), key=lambda x: (-len(x), x))
    return df.withColumn("match", F.coalesce(*(F.when(F.contains(F.lower(F.col(text)), F.lit(v.lower())), F.lit(v)) for v in tries)))


def snake_folds(df: DataFrame, group: str, folds: int, seed: str) -> DataFrame:
    """(group, n, fold): groups by size downwards, dealt back and forth over the folds, so none is split."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    k = F.pmod(F.row_number().over(Window.orderBy(F.desc("n"), draw_key(seed, group))) - 1, F.lit(2 * folds))  # one row per group
    return sizes.withColumn("_k", k).withColumn("fold", F.when(F.col("_k") < folds, F.col("_k")).otherwise(2 * folds - 1 - F.col("_k")).cast("int")).drop("_k")


def nested_folds(df: DataFrame, group: str, fold: str, outer: int, inner: int, seed: str) -> DataFrame:
    """(outer_fold, group, n, inner_fold): the training groups of every outer fold dealt over inner folds."""
    parts = [snake_folds(df.where(F.col(fold) != k), group, inner, seed).select(F.lit(k).alias("outer_fold"), group, "n", F.col("fold").alias("inner_fold")) for k in range(outer)]
    return reduce(DataFrame.unionByName, parts)
