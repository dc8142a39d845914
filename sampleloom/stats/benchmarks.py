"""Benchmark metrics over answers: yes/no, multiple choice, soft accuracy, generation quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yes_no_metrics(df: DataFrame, said: Column, truth: Column, by: list[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1 and the share of yes, with 1e-6 against empty denominators."""
    yes, right = said == "yes", truth == "yes"
    g = df.groupBy(*by).agg(F.count_if(yes & right).alias("tp"), F.count_if(yes & ~right).alias("fp"), F.count_if(~yes & ~right).alias("tn"), F.count_if(~yes & right).alias("fn"))
    e = F.lit(1e-6)
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    p, r = tp / (tp + fp + e), tp / (tp + fn + e)
    return g.withColumns({"accuracy": F.round((tp + tn) / (tp + fp + tn + fn + e), 6), "precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(2 * p * r / (p + r + e), 6), "yes_share": F.round((tp + fp) / (tp + fp + tn + fn + e), 6)})


def soft_accuracy(answers: DataFrame, references: DataFrame, key: str, answer: str, reference: str) -> DataFrame:
    """(key, score): the mean over the references, each left out in turn, of min(1, matches among the others / 3)."""
    w = Window.partitionBy(key, "_v")
    refs = references.select(key, F.col(reference).alias("_v")).withColumn("_same", F.count("*").over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    both = answers.select(key, F.col(answer).alias("_a")).join(refs, key)
    total = F.sum(F.when(F.col("_v") == F.col("_a"), 1).otherwise(0))
    g = both.groupBy(key).agg(total.alias("_m"), F.max("_n").alias("_n"))
    # leaving out one of the m matches leaves m - 1, leaving out another leaves m
    hit = F.least(F.lit(1.0), (F.col("_m") - 1) / 3.0) * F.col("_m") + F.least(F.lit(1.0), F.col("_m") / 3.0) * (F.col("_n") - F.col("_m"))
    return g.select(key, F.round(F.when(F.col("_m") > 0, hit / F.col("_n")).otherwise(F.lit(0.0)), 6).alias("score"))


def multiclass_auc(predictions: DataFrame, label: str, probabilities: str, classes: int, by: list[str] = ()) -> DataFrame:
    """(by, class, n_pos, n_neg, auc): one class against the rest; classes without rows are left out."""
    from sampleloom.stats.auc import roc_auc

    long = predictions.select(*by, F.col(label).alias("_y"), F.posexplode(probabilities).alias("class", "_s")).where(F.col("class") < classes)
    return roc_auc(long.withColumn("_l", (F.col("_y") == F.col("class")).cast("int")), "_l", "_s", [*by, "class"]).where("n_pos > 0")
