"""Aggregations: each is one or two levels of partial aggregation, with one-row results joined as scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.operators.joins import with_scalars
from sampleloom.operators.order import quantiles, with_quantiles


def composition(df: DataFrame, groupings: dict[str, Column]) -> DataFrame:
    """Stacked (grouping, level, count) of several ways to group, in one pass."""
    pairs = F.array(*(F.struct(F.lit(n).alias("grouping"), c.cast("string").alias("level")) for n, c in groupings.items()))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.grouping", "p.level").agg(F.count("*").alias("count"))


def mad(df: DataFrame, value: str) -> DataFrame:
    """median and the median absolute deviation from it."""
    centre = quantiles(df, value, [0.5]).select(F.col("q")[0].alias("centre"))
    away = df.select(F.col(value).cast("double").alias("_v")).crossJoin(F.broadcast(centre)).select(F.abs(F.col("_v") - F.col("centre")).alias("_d"))  # one row
    return centre.crossJoin(F.broadcast(quantiles(away, "_d", [0.5]).select(F.col("q")[0].alias("mad"))))


def mad_flags(df: DataFrame, value: str, detected: str, times: float = 3.0) -> DataFrame:
    """is_low, is_high: log10(max(value, 1)) beyond times x 1.4826 x MAD; is_poor: few detected by the same measure."""
    x = df.withColumn("_x", F.log10(F.greatest(F.col(value).cast("double"), F.lit(1.0)))).withColumn("_d", F.col(detected).cast("double"))
    one = lambda c, m, s: mad(x, c).select(F.col("centre").alias(m), F.greatest("mad", F.lit(1e-9)).alias(s))
    x = x.crossJoin(F.broadcast(one("_x", "_xm", "_xs"))).crossJoin(F.broadcast(one("_d", "_dm", "_ds")))  # single rows
    wide = lambda s: F.lit(times * 1.4826) * F.col(s)
    return x.withColumn("is_low", F.col("_x") < F.col("_xm") - wide("_xs")).withColumn("is_high", F.col("_x") > F.col("_xm") + wide("_xs")).withColumn("is_poor", F.col("_d") < F.col("_dm") - wide("_ds")).drop("_x", "_d", "_xm", "_dm", "_xs", "_ds")


def distribution(value: str, stem: str) -> list[Column]:
    """mean and maximum of a column, as aggregates; null for no values."""
    return [F.round(F.avg(value), 6).alias(f"{stem}_mean"), F.max(value).cast("double").alias(f"{stem}_max")]


def quartiles(value: str, stem: str) -> dict[str, tuple[str, float]]:
    """What with_quantiles adds to distribution."""
    return {f"{stem}_median": (value, 0.5), f"{stem}_q1": (value, 0.25), f"{stem}_q3": (value, 0.75)}


def group_metrics(df: DataFrame, group: str, patient: str, series: str, resolved: Column, value: str) -> DataFrame:
    """Per group: patients, samples, series, samples per patient (distribution), value (distribution), resolved patients."""
    counts = df.groupBy(group, patient).agg(F.count("*").alias("k")).where(F.col(patient).isNotNull())
    per_patient = with_quantiles(counts.groupBy(group).agg(F.count("*").alias("n_patients"), *distribution("k", "samples_per_patient")), [group], counts, quartiles("k", "samples_per_patient"))
    whole = df.groupBy(group).agg(
        F.count("*").alias("n_samples"), F.countDistinct(series).alias("n_series"), *distribution(value, value), F.count(value).alias(f"{value}_n"),
        F.count_if(resolved).alias("n_resolved_samples"), F.countDistinct(F.when(resolved, F.col(patient))).alias("n_resolved_patients"),
    )
    whole = with_quantiles(whole, [group], df, quartiles(value, value))
    return whole.join(per_patient.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g").withColumn("n_patients", F.coalesce("n_patients", F.lit(0))).withColumn("resolution_pct", F.round(F.col("n_resolved_samples") * 100.0 / F.col("n_samples"), 4))


def zero_filled(domain: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """All keys of a fixed domain, with 0 for those that have no counts."""
    return domain.join(counts, key, "left").fillna(0, [c for c in counts.columns if c != key])


def concentration(counts: DataFrame, n: str = "n") -> DataFrame:
    """Shares of groups: how many hold 50 and 80 %, HHI, effective number, Gini, singletons, the largest share."""
    w = Window.orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, 0)  # one row per group
    rows = with_scalars(counts.select(n), F.sum(n).alias("total"), F.count("*").alias("groups"))
    share = F.col(n) / F.col("total")
    rows = rows.select(n, "groups", "total", share.alias("share"), (F.sum(n).over(w) / F.col("total")).alias("cum"), F.row_number().over(Window.orderBy(F.desc(n))).alias("r"))
    return rows.groupBy("groups", "total").agg(
        (F.count_if(F.col("cum") < 0.5) + 1).alias("n_50"), (F.count_if(F.col("cum") < 0.8) + 1).alias("n_80"), F.round(F.sum(F.col("share") * F.col("share")), 8).alias("hhi"),
        F.round(1 / F.sum(F.col("share") * F.col("share")), 4).alias("effective_n"), F.round((F.first("groups") + 1 - 2 * F.sum(F.col("r") * F.col("share"))) / F.first("groups") * F.lit(1.0), 6).alias("gini"),
        F.count_if(F.col(n) == 1).alias("singletons"), F.round(F.max("share"), 8).alias("top_share"),
    )


def mixed_groups(df: DataFrame, group: str, positive: Column) -> DataFrame:
    """Groups that hold both classes, with their counts."""
    return df.groupBy(group).agg(F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg")).where("n_pos > 0 and n_neg > 0")


def single_class_groups(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups that hold one class only (offenders of a guard)."""
    return df.groupBy(group).agg(F.countDistinct(label).alias("classes"), F.count("*").alias("n")).where("classes < 2").select(group, "n")


def collapse_rare(df: DataFrame, label: str, least: int, other: str = "__other__", missing: str = "__missing__") -> DataFrame:
    """Labels of fewer than `least` rows as `other`, null or blank ones as `missing`."""
    named = df.withColumn(label, F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit(missing)))
    frequent = named.groupBy(label).agg(F.count("*").alias("_n")).where((F.col("_n") >= least) | (F.col(label) == missing)).select(F.col(label).alias("_f"))
    return named.join(frequent, F.col(label) == F.col("_f"), "left").withColumn(label, F.coalesce("_f", F.lit(other))).drop("_f")


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; null (not an error) where a variance is 0."""
    return F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)), F.lit(0.0))


def correlation_r2(df: DataFrame, item: str, x: str, y: str) -> DataFrame:
    """Squared Pearson correlation per item; null where a variance is 0."""
    zero = (F.var_pop(x) < 1e-12) | (F.var_pop(y) < 1e-12)
    return df.groupBy(item).agg(F.when(~zero, F.pow(safe_corr(x, y), 2)).alias("r2"))


def eta_squared(df: DataFrame, item: str, group: str, x: str) -> DataFrame:
    """Sum of squares between groups over the total one, per item (one-way ANOVA effect size)."""
    parts = df.groupBy(item, group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    per = parts.groupBy(item).agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return per.select(item, F.when(between + F.col("w") > 1e-12, between / (between + F.col("w"))).alias("eta2"))


def matched_contrast(df: DataFrame, stratum: Column, side: str, value: str, least: int) -> DataFrame:
    """Medians of value on either side (a boolean) within strata that have at least `least` rows on both."""
    v = df.select(stratum.alias("stratum"), F.col(side).alias("_side"), F.when(F.col(side), F.col(value)).alias("_in"), F.when(~F.col(side), F.col(value)).alias("_out"))
    s = v.groupBy("stratum").agg(F.count_if("_side").alias("n_in"), F.count_if(~F.col("_side")).alias("n_out"))
    s = with_quantiles(s, ["stratum"], v, {"median_in": ("_in", 0.5), "median_out": ("_out", 0.5)}, digits=None)
    return s.where((F.col("n_in") >= least) & (F.col("n_out") >= least))


def overlap_regions(flags: DataFrame, names: list[str]) -> DataFrame:
    """Rows in each exclusive region of several membership flags."""
    region = F.concat_ws("+", *(F.when(F.col(n), F.lit(n)) for n in names))
    return flags.groupBy(region.alias("region")).agg(F.count("*").alias("n"))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that either side has more often than the other."""
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))


def identifier_profile(df: DataFrame, name: str) -> DataFrame:
    c = F.col(name)
    return df.agg(
        F.count("*").alias("n"), F.countDistinct(c).alias("n_unique"), F.count_if(F.rlike(c, F.lit(r"^ENSG\d+$"))).alias("n_ensembl"), F.count_if(F.rlike(c, F.lit(r"^[A-Z0-9-]+$")) & ~F.rlike(c, F.lit(r"^ENSG\d+$"))).alias("n_symbol"),
        F.count_if(c != F.upper(c)).alias("n_lower"), F.count_if(c != F.trim(c)).alias("n_untrimmed"), F.count_if(c.isNull() | (F.trim(c) == "")).alias("n_empty"),
    )


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins of [lo, hi]; the last bin holds hi."""
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def melt_distribution(df: DataFrame, metrics: list[str]) -> DataFrame:
    """A row per metric: n, mean, median, p05, p95."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("r")).select("r.*").where("v is not null and not isnan(v)")
    grouped = rows.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    return with_quantiles(grouped, ["metric"], rows, {"median": ("v", 0.5), "p05": ("v", 0.05), "p95": ("v", 0.95)})


def sanity(df: DataFrame, value: str, rank: str, by: list[str] = ()) -> DataFrame:
    """nulls, NaNs, infinities and negatives of a value, and whether the ranks are 1..N, for each group."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"), F.count_if(v < 0).alias("n_negative"),
        F.coalesce((F.min(rank) == 1) & (F.max(rank) == F.count("*")) & (F.countDistinct(rank) == F.count("*")), F.lit(False)).alias("is_permutation"),
    )
