"""Ranking and analytic operators; row_number() <= k stays a filter, so that ranks are cut before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.operators.order import global_rank, quantiles


def ranked(df: DataFrame, *order: Column, by: list[str] = (), out: str = "rank") -> DataFrame:
    """1..N in the given order, within `by`."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_share(df: DataFrame, rank: str, percent: float, out: str = "selected") -> DataFrame:
    """Whether the rank is among the first ceil(N x percent / 100)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    n = df.agg(F.ceil(F.count("*") * F.lit(percent) / 100).alias("_cut"))
    return df.crossJoin(F.broadcast(n)).withColumn(out, F.col(rank) <= F.col("_cut")).drop("_cut")  # one row


def extremes(df: DataFrame, by: list[str], value: str, name: str, n: int, largest: bool = True) -> DataFrame:
    """The n largest (or least) rows of each group, ties by name, with boundary_tie: the next row has the same value."""
    order = [F.desc(value) if largest else F.asc(value), F.asc(name)]
    one_more = ranked(df, *order, by=by).where(F.col("rank") <= n + 1)
    w = Window.partitionBy(*by)
    last = F.max(F.when(F.col("rank") == n, F.col(value))).over(w)
    beyond = F.max(F.when(F.col("rank") == n + 1, F.col(value))).over(w)
    return one_more.withColumn("boundary_tie", F.coalesce(last == beyond, F.lit(False))).where(F.col("rank") <= n)


def top_lists(df: DataFrame, by: str, name: str, value: str, k: int, gate: Column) -> DataFrame:
    """Per group the names of the k largest positive and k least negative values that pass the gate; short if fewer pass."""
    passed = df.where(gate)
    up = ranked(passed.where(F.col(value) > 0), F.desc(value), F.asc(name), by=[by]).where(F.col("rank") <= k).withColumn("s", F.lit("up"))
    down = ranked(passed.where(F.col(value) < 0), F.asc(value), F.asc(name), by=[by]).where(F.col("rank") <= k).withColumn("s", F.lit("down"))
    both = up.unionByName(down).groupBy(by, "s").agg(F.array_sort(F.collect_list(F.struct("rank", name))).alias("l"))  # at most k
    names = lambda s: F.array_join(F.max(F.when(F.col("s") == s, F.transform("l", lambda x: x[name].cast("string")))), ",")
    return both.groupBy(by).agg(names("up").alias("top_up"), names("down").alias("top_down"))


def average_rank(df: DataFrame, value: str, by: list[str] = (), out: str = "avg_rank") -> DataFrame:
    """Ranks from 1, ties sharing the mean; two windows of which the second is over equal values."""
    r = ranked(df, F.asc(value), by=list(by), out="_r")
    w = Window.partitionBy(*by, value)
    return r.withColumn(out, (F.min("_r").over(w) + F.max("_r").over(w)) / F.lit(2.0)).drop("_r")


def centred_rank(df: DataFrame, value: str, by: list[str], out: str = "centred") -> DataFrame:
    """Average ranks within a group, from -0.5 to 0.5; 0 for a single row."""
    n = F.count("*").over(Window.partitionBy(*by))
    return average_rank(df, value, by, "_a").withColumn("_n", n).withColumn(out, F.when(F.col("_n") > 1, (F.col("_a") - 1) / (F.col("_n") - 1) - 0.5).otherwise(F.lit(0.0))).drop("_a", "_n")


def zscore(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """Z-score within a group; 0 where the deviation is below 1e-12 x max(1, |mean|) or the group has one row."""
    s = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
    flat = (F.col("_n") < 2) | (F.col("_s") <= F.lit(1e-12) * F.greatest(F.lit(1.0), F.abs("_m")))
    return df.join(s, list(by)).withColumn(out, F.when(flat, F.lit(0.0)).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s", "_n")


def tertiles(df: DataFrame, value: str, names: tuple[str, str, str] = ("minimal", "moderate", "large"), unknown: str = "unknown", out: str = "bucket") -> DataFrame:
    """Buckets cut at the population's tertile values (not at counts); null or NaN values are unknown."""
    cuts = quantiles(df, value, [1 / 3, 2 / 3]).withColumnRenamed("q", "_c")
    v = F.col(value)
    b = F.when(v.isNull() | F.isnan(v), unknown).when(v <= F.col("_c")[0], names[0]).when(v <= F.col("_c")[1], names[1]).otherwise(names[2])
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, b).drop("_c")


def quantile_normalised(df: DataFrame, sample: str, item: str, value: str, reference: DataFrame | None = None) -> DataFrame:
    """Each value by the mean of the reference's i-th order statistics over its tie run; the reference defaults to df."""
    order = lambda x: ranked(x, F.asc(value), F.asc(item), by=[sample], out="_i")
    own = order(df)
    ref = (order(reference) if reference is not None else own).groupBy("_i").agg(F.avg(value).alias("_ref"))
    return own.join(ref, "_i").withColumn("normalised", F.avg("_ref").over(Window.partitionBy(sample, value))).drop("_i", "_ref")


def round_robin(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows from as many groups as possible: first rows of all groups, then second ones, by hash order."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    own = ranked(df.withColumn("_h", h), F.col("_h"), by=[group], out="_k").where(F.col("_k") <= n)
    g = F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")))
    return own.orderBy("_k", g, "_h").limit(n).drop("_h", "_k")


def capped(df: DataFrame, group: list[str], key: str, cap: int, seed: str) -> DataFrame:
    """At most `cap` rows of each group, by hash."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    return ranked(df.withColumn("_h", h), F.col("_h"), by=group, out="_k").where(F.col("_k") <= cap).drop("_h", "_k")


def chunks(df: DataFrame, key: str, n: int) -> DataFrame:
    """The chunk of each row when rows in key order are cut into n pieces of ceil(N / n)."""
    one = df.agg(F.ceil(F.count("*") / F.lit(n)).alias("_size"))
    return global_rank(df, F.asc(key), out="_r").crossJoin(F.broadcast(one)).withColumn("chunk", F.floor((F.col("_r") - 1) / F.col("_size")).cast("int")).drop("_r", "_size")


def length_batches(df: DataFrame, key: str, length: str, batch: int, workers: int, seed: str) -> DataFrame:
    """Random megabatches of batch x workers rows, sorted by length downwards, dealt to the workers in turn."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    mega = global_rank(df.withColumn("_h", h), F.col("_h"), F.col(key), out="_r").withColumn("megabatch", F.floor((F.col("_r") - 1) / F.lit(batch * workers)).cast("int"))
    dealt = ranked(mega, F.desc(length), F.asc(key), by=["megabatch"], out="place")
    return dealt.withColumn("worker", F.pmod(F.col("place") - 1, F.lit(workers)).cast("int")).drop("_h", "_r")


def top_of_array(values: Column, k: int) -> Column:
    """The k largest values of an array with their places, largest first."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("m"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["i"].alias("place"), (-p["m"]).alias("value")))
