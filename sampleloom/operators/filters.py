"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_at_most(df: DataFrame, column: str, limit: float, inclusive: bool = True) -> DataFrame:
    """Rows with column <= limit (< without `inclusive`); all rows where the table has no such column."""
    if column not in df.columns:
        return df
    return df.where(F.col(column) <= limit if inclusive else F.col(column) < limit)


def keep_stats(df: DataFrame, condition: Column) -> DataFrame:
    """total, kept, excluded and the share kept in percent, in one pass."""
    kept = F.count_if(condition)
    return df.agg(F.count("*").alias("total"), kept.alias("kept"), (F.count("*") - kept).alias("excluded"), F.round(kept * 100.0 / F.count("*"), 4).alias("pct_kept"))


def having_total(fact: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """Keys whose values sum up to at least `least`, with the sum."""
    return fact.groupBy(key).agg(F.sum(value).alias("total")).where(F.col("total") >= least)


def detected_in(fact: DataFrame, item: str, key: str, value: str, above: float, share: float) -> DataFrame:
    """Items whose value exceeds `above` in at least `share` of all keys (absent pairs are zeros)."""
    n = fact.select(F.countDistinct(key).alias("n"))
    hits = fact.groupBy(item).agg(F.count_if(F.col(value) > above).alias("hits"))
    return hits.crossJoin(F.broadcast(n)).where(F.col("hits") >= share * F.col("n")).select(item, "hits")  # n is one row


def usable_items(fact: DataFrame, item: str, value: str, sentinel: float, least_sd: float) -> DataFrame:
    """Items without the sentinel value anywhere and with a population deviation of at least least_sd."""
    stats = fact.groupBy(item).agg(F.bool_or(F.col(value) == sentinel).alias("absent"), F.stddev_pop(value).alias("sd"))
    return stats.where(~F.col("absent") & (F.col("sd") >= least_sd)).select(item)


def nameable(symbol: Column, accession: Column) -> Column:
    """A symbol is there, isn't the accession and is no ENSG identifier, without regard to case and blanks."""
    s = F.upper(F.trim(F.coalesce(symbol, F.lit(""))))
    return (s != "") & (s != F.upper(F.trim(F.coalesce(accession, F.lit(""))))) & ~F.startswith(s, F.lit("ENSG"))


def unannotated(symbol: Column) -> Column:
    return F.rlike(symbol, F.lit(r"^ENSG\d+$"))


def prune_rare(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of labels with at least `least` rows; the counts are joined, no row goes through a window of its label."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(counts, label, "left_semi")


def in_order(df: DataFrame, column: str, priority: list[str]) -> DataFrame:
    """df with `place`: the position of the value in a list of priorities, after it for others."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(column))
    return df.withColumn("place", F.when(place > 0, place).otherwise(F.lit(len(priority) + 1)).cast("int"))


def relabel(c: Column, names: dict[str, str]) -> Column:
    """Old labels by their new names; others stay. Applying it again changes nothing."""
    out = c
    for old, new in names.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def finite_first(names: Column, values: Column, limit: int) -> Column:
    """The first `limit` (name, value) pairs whose value is finite."""
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
    return F.slice(F.filter(pairs, lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]) & (F.abs(x["value"]) != float("inf"))), 1, limit)


def by_width(features: Column, widths: dict[int, str]) -> Column:
    """What a vector is, told by its width."""
    out = F.lit("unknown")
    for w, name in widths.items():
        out = F.when(F.size(features) == w, F.lit(name)).otherwise(out)
    return out


def attrition(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(gate, place, passed, dropped): rows that pass the gates up to each, in order, in one pass."""
    so_far, exprs = F.lit(True), [F.count("*").alias("g0")]
    for k, c in enumerate(gates.values(), 1):
        so_far = so_far & F.coalesce(c, F.lit(False))
        exprs.append(F.count_if(so_far).alias(f"g{k}"))
    one = df.agg(*exprs)
    rows = [F.struct(F.lit(n).alias("gate"), F.lit(k).alias("place"), F.col(f"g{k}").alias("passed"), (F.col(f"g{k - 1}") - F.col(f"g{k}")).alias("dropped")) for k, n in enumerate(gates, 1)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def per_condition(df: DataFrame, label: str, condition: str, conditions: list[str]) -> DataFrame:
    """For each of a few conditions: all negatives (label 0) and the positives of that condition."""
    of = F.when(F.col(label) == 0, F.array(*map(F.lit, conditions))).otherwise(F.filter(F.array(*map(F.lit, conditions)), lambda x: x == F.col(condition)))
    return df.withColumn("of", F.explode(of))


def strongest(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of largest absolute value per key."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs(value)), *[c for c in df.columns if c not in (key, value)])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
