"""Figures per series of a sample table of which a few series carry most samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.functions.text import name_list
from sampleloom.operators.skew import LoadPlan, fragment_replicate_join, plan_load, sharded_aggregate


def series_rows(samples: DataFrame, *more: str) -> DataFrame:
    """(series_id, sample_index, ...): a row for each cleaned series that a row of samples names."""
    return samples.where("sample_index is not null").select(F.explode(name_list(F.col("series_id"))).alias("series_id"), "sample_index", *more)


def series_figures(samples: DataFrame, labels: DataFrame | None = None, plan: LoadPlan | None = None) -> DataFrame:
    """series_id, n_samples, n_holdout (and n_cvd, n_not_cvd, n_cvd_unknown with labels), counting distinct samples.

    A sample that names several series counts for each; one without a series for none. A sample is held out if a row of
    it says so. Samples without a label row, or with a null label, are unknown; of several labels the true one counts.
    Labels are matched by fragments: a sample delivered any number of times is split over shards, and its label goes to
    these shards only.
    """
    rows = series_rows(samples, F.coalesce("in_holdout", F.lit(False)).alias("held"))
    plan = plan or plan_load(rows, ["series_id"])
    item, partial = {"held": F.max("held")}, {"n_samples": F.count("*"), "n_holdout": F.count_if("held")}
    if labels is not None:
        one = labels.groupBy("sample_index").agg(F.max("is_cvd_disease").alias("cvd"))
        rows = fragment_replicate_join(rows, one, "sample_index", "left")
        item["cvd"] = F.max("cvd")
        partial |= {"n_cvd": F.count_if("cvd"), "n_not_cvd": F.count_if(~F.col("cvd")), "n_cvd_unknown": F.count_if(F.col("cvd").isNull())}
    return sharded_aggregate(rows, ["series_id"], ["sample_index"], partial, {k: F.sum(k) for k in partial}, plan, item)


def large_series(samples: DataFrame, labels: DataFrame | None = None, share: float = 0.02) -> DataFrame:
    """Figures of the series with at least `share` of all distinct samples, with or without a series."""
    total = samples.agg(F.countDistinct("sample_index").alias("total"))
    return series_figures(samples, labels).crossJoin(total).where(F.col("n_samples") >= share * F.col("total"))  # total is one row


def sample_against_series(samples: DataFrame) -> DataFrame:
    """Each sample with its mean_abs_z less the mean of its series: the series' figures go to every shard of the series."""
    one = samples.groupBy("sample_index", F.upper("series_id").alias("series_id")).agg(F.max("mean_abs_z").alias("mean_abs_z"))
    rows = series_rows(one, "mean_abs_z").groupBy("series_id", "sample_index").agg(F.max("mean_abs_z").cast("decimal(20,9)").alias("mean_abs_z"))
    plan = plan_load(series_rows(samples), ["series_id"])
    partial = {"s": F.sum("mean_abs_z"), "n": F.count("mean_abs_z"), "m": F.count("*")}
    means = sharded_aggregate(rows, ["series_id"], ["sample_index"], partial, {"s": F.sum("s"), "n": F.sum("n"), "n_samples": F.sum("m")}, plan)
    means = means.select("series_id", (F.col("s").cast("double") / F.when(F.col("n") > 0, F.col("n"))).alias("series_mean"), "n_samples")
    joined = fragment_replicate_join(rows, means, "series_id", plan=plan, by=["sample_index"])
    return joined.select("series_id", "sample_index", "n_samples", F.round(F.col("mean_abs_z").cast("double") - F.col("series_mean"), 6).alias("above_series"))
