"""Ranking metrics without threshold bins: one sort by score serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.operators.order import quantiles, running, with_quantiles
from sampleloom.operators.windows import average_rank, zscore


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """by, n_pos, n_neg, auc: rank-sum with ties counting half; null where a class is missing.

    Scores are first made one row per distinct value, whose running sums are taken over ranges of values.
    """
    v = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    v = running(v, [F.col("_s")], {"_upto": F.col("_n")}, by).withColumn("_below", F.col("_upto") - F.col("_n"))
    g = v.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum((F.col("_p") * (F.col("_below") * 2 + F.col("_n"))).cast("double")).alias("_w"))
    return g.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (2.0 * F.col("n_pos") * F.col("n_neg")))).drop("_w")


def pr_auc(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """by, average_precision (steps) and pr_trapezoid (trapezoids from recall 0 at precision 1), by distinct threshold."""
    v = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count("*").alias("_a"))
    v = running(v, [F.desc("_s")], {"_tp": F.col("_p"), "_all": F.col("_a")}, by).withColumn("_pr", F.col("_tp") / F.col("_all"))
    # the threshold before; none: precision 1
    v = v.withColumn("_last", F.when(F.col("_all") > F.col("_a"), (F.col("_tp") - F.col("_p")) / (F.col("_all") - F.col("_a"))).otherwise(1.0))
    g = v.groupBy(*by).agg(F.sum("_p").alias("_t"), F.sum(F.col("_p") * F.col("_pr")).alias("_ap"), F.sum(F.col("_p") * (F.col("_pr") + F.col("_last")) / 2).alias("_tz"))
    some = lambda c: F.when(F.col("_t") > 0, F.col(c) / F.col("_t"))
    return g.select(*by, some("_ap").alias("average_precision"), some("_tz").alias("pr_trapezoid"))


def confusion(df: DataFrame, label: str, predicted: Column, by: list[str] = ()) -> DataFrame:
    """tp, fp, tn, fn and the metrics made of them; null where undefined."""
    y = F.col(label) == 1
    g = df.groupBy(*by).agg(F.count_if(y & predicted).alias("tp"), F.count_if(~y & predicted).alias("fp"), F.count_if(~y & ~predicted).alias("tn"), F.count_if(y & ~predicted).alias("fn"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 8)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return g.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def brier(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def within_groups(df: DataFrame, label: str, score: str, group: str, least: int = 6) -> DataFrame:
    """One row: AUC within groups of at least `least` rows and both classes: pair-weighted, mean, deviation, median."""
    g = roc_auc(df, label, score, [group]).where((F.col("n_pos") + F.col("n_neg") >= least) & F.col("auc").isNotNull())
    pairs = F.col("n_pos") * F.col("n_neg")
    one = g.agg(F.count("*").alias("n_groups"), F.round(F.sum(F.col("auc") * pairs) / F.sum(pairs), 8).alias("pair_weighted"), F.round(F.avg("auc"), 8).alias("mean_auc"), F.round(F.stddev_pop("auc"), 8).alias("sd_auc"), F.count_if(F.col("auc") > 0.5).alias("n_above_half"))
    return with_quantiles(one, [], g, {"median_auc": ("auc", 0.5)}, digits=8)


def skipped_groups(df: DataFrame, label: str, score: str, group: str, least: int = 6) -> DataFrame:
    """Groups without an AUC and why."""
    g = roc_auc(df, label, score, [group])
    reason = F.when(F.col("n_pos") + F.col("n_neg") < least, "too few rows").when(F.col("auc").isNull(), "single class")
    return g.select(group, reason.alias("reason")).where("reason is not null")


def pairwise_auc(df: DataFrame, label: str, score: str, group: str) -> DataFrame:
    """AUC over all positive-negative pairs of a same group."""
    g = roc_auc(df, label, score, [group]).where("auc is not null")
    pairs = F.col("n_pos") * F.col("n_neg")
    return g.agg(F.round(F.sum(F.col("auc") * pairs) / F.sum(pairs), 8).alias("pairwise_auc"), F.sum(pairs).alias("n_pairs"))


def shortcut_diagnostics(df: DataFrame, label: str, score: str, group: str, least: int = 6) -> DataFrame:
    """One row: pooled, within-group, pairwise and group-centred AUC, and the gap of pooled and within-group."""
    pooled = roc_auc(df, label, score).select(F.round("auc", 8).alias("pooled_auc"))
    within = within_groups(df, label, score, group, least).select("pair_weighted", "n_groups")
    pair = pairwise_auc(df, label, score, group).select("pairwise_auc")
    centred = roc_auc(zscore(df, score, [group], "_z").withColumn("_z", F.round("_z", 9)), label, "_z").select(F.round("auc", 8).alias("centred_auc"))
    return pooled.crossJoin(within).crossJoin(pair).crossJoin(centred).withColumn("gap", F.round(F.col("pooled_auc") - F.col("pair_weighted"), 8))  # single rows


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and share of positives in bins between the score's quantiles."""
    edges = quantiles(df, score, [k / bins for k in range(1, bins)]).withColumnRenamed("q", "_e")
    b = F.aggregate("_e", F.lit(0), lambda acc, x: acc + (F.col(score) > x).cast("int"))
    return df.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(label), 6).alias("share_positive"))


def shuffled_control(df: DataFrame, score: str, rank: str) -> DataFrame:
    """One row: how far scores move when every row is given the next one's input, in deviations of the scores, and the
    verdict: below 0.25 the input is ignored, below 0.6 its use is weak."""
    n = df.agg(F.count("*").alias("_n"))
    own = df.select(F.col(score).alias("_a"), F.col(rank).alias("_r")).crossJoin(F.broadcast(n))  # one row
    other = df.select(F.col(score).alias("_b"), F.col(rank).alias("_next"))
    both = own.withColumn("_next", F.pmod(F.col("_r"), F.col("_n")) + 1).join(other, "_next")
    g = both.agg(F.count("*").alias("n"), (F.avg(F.abs(F.col("_a") - F.col("_b"))) / F.nullif(F.stddev_pop("_a"), F.lit(0.0))).alias("_s"))
    s = F.coalesce("_s", F.lit(0.0))
    return g.select("n", F.round(s, 6).alias("sensitivity"), F.when(s < 0.25, "ignored").when(s < 0.6, "weak").otherwise("used").alias("verdict"))


__all__ = ["average_rank", "brier", "calibration", "confusion", "pairwise_auc", "pr_auc", "roc_auc", "shortcut_diagnostics", "shuffled_control", "skipped_groups", "within_groups"]
