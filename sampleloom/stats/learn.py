"""Learners on our own grouped folds; fits are pyspark.ml, those of a search step together (`elastic.py`); sizes of what they see stay those of the inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.operators.sampling import snake_folds
from sampleloom.session import cut, discard
from sampleloom.stats import elastic as elastic_fits
from sampleloom.stats.auc import pr_auc, roc_auc


def vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """_w: n / (2 x rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = df.agg(F.count("*").alias("_t"), F.countDistinct(label).alias("_k"))
    return df.join(n, label).crossJoin(F.broadcast(total)).withColumn("_w", F.col("_t") / (F.col("_k") * F.col("_c"))).drop("_c", "_t", "_k")


def probe(df: DataFrame, features: str, label: str, fold: str, folds: int, least: int = 25, elastic: float = 0.0, reg: float = 1e-3, pca: int | None = None, key: str = "key", layers: list[int] | None = None, estimator: Callable[[str], Estimator] | None = None) -> DataFrame:
    """Out-of-fold (key, fold, label, score): scaled (and PCA-reduced) features, balanced weights, a fit per fold.

    A fold whose training part has fewer than `least` rows of a class is skipped. `layers` fits a perceptron instead,
    `estimator` (name of the features column -> estimator of column "label") any other.
    """
    x = cut(vectors(df.select(F.col(key).alias("key"), features, F.col(label).cast("double").alias("label"), F.col(fold).alias("fold")), features).drop(features))
    out = None
    for k in range(folds):
        train, test = x.where(F.col("fold") != k), x.where(F.col("fold") == k)
        sizes = [r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()]
        if len(sizes) < 2 or min(sizes) < least:
            continue
        scaler = StandardScaler(withMean=True, inputCol="_x", outputCol="_s").fit(train)
        train, test, col = scaler.transform(train), scaler.transform(test), "_s"
        if pca:
            p = PCA(k=pca, inputCol="_s", outputCol="_p").fit(train)
            train, test, col = p.transform(train), p.transform(test), "_p"
        if estimator:
            model = estimator(col).fit(balanced(train, "label"))
        elif layers:
            model = MultilayerPerceptronClassifier(layers=layers, featuresCol=col, labelCol="label", seed=7, maxIter=30).fit(train)
        else:
            model = LogisticRegression(featuresCol=col, labelCol="label", weightCol="_w", regParam=reg, elasticNetParam=elastic, standardization=False, maxIter=60).fit(balanced(train, "label"))
        scored = model.transform(test).select("key", "fold", F.col("label").cast("int").alias("label"), F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return x.limit(0).select("key", "fold", F.col("label").cast("int").alias("label"), F.lit(None).cast("double").alias("score"))
    return out


def searched_probe(df: DataFrame, features: str, label: str, group: str, fold: str, folds: int, regs: list[float], elastics: list[float], inner: int = 3, key: str = "key") -> DataFrame:
    """Out-of-fold (key, fold, label, score, reg, elastic): an elastic net per fold, its pair the best on inner grouped folds.

    Inner folds are dealt over the training groups only (fewer where these are few); the pair with the largest mean average
    precision, the first of equal ones, is fitted again to the whole training part. All fits of the search step together, and
    so do the last ones, so that the passes over the rows are those of one fit (see `stats/elastic.py`).
    """
    x = cut(df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("label"), F.col(group).alias("group"), F.col(fold).alias("fold")))
    seen = x.agg(F.max(F.size("x")).alias("d"), *(F.countDistinct(F.when(F.col("fold") != k, F.struct("group"))).alias(f"n{k}") for k in range(folds))).first()
    if seen["d"] is None:
        return x.select("key", "fold", F.col("label").cast("int").alias("label"), *(F.lit(None).cast("double").alias(c) for c in ("score", "reg", "elastic")))
    n_inner = [inner if seen[f"n{k}"] >= inner else max(2, seen[f"n{k}"] - 1) for k in range(folds)]
    parts, dealt = [], x
    for k in range(folds):
        dealt = dealt.join(snake_folds(x.where(F.col("fold") != k), "group", n_inner[k], "in").select("group", F.col("fold").alias(f"_in{k}")), "group", "left")
        parts.append(F.when(F.col("fold") != k, F.coalesce(f"_in{k}", F.lit(elastic_fits.NONE))).otherwise(elastic_fits.TEST))
    rows = cut(dealt.select("key", "x", "label", "fold", F.array(*parts).alias("part")))
    discard(x)

    pairs = [(r, e) for e in elastics for r in regs]
    sets = [(k, i) for k in range(folds) for i in [*range(n_inner[k]), None]]
    scaled = dict(zip(sets, elastic_fits.scales(rows, sets, seen["d"])))
    if lost := [k for k in range(folds) if not (scaled[k, None][4] or scaled[k, None][5])]:
        raise ValueError(f"no labels to train on outside of folds {lost}")
    fits = [(s, p) for s in sets if s[1] is not None for p in pairs]
    own, scales = [s for s, _ in fits], [scaled[s] for s, _ in fits]
    tried = elastic_fits.tried(rows, own, scales, elastic_fits.fitted(rows, own, scales, [p for _, p in fits]))
    precision = {r["fit"]: r["average_precision"] or 0.0 for r in pr_auc(tried, "label", "score", ["fit"]).collect()}  # a row per fit
    total = {(k, p): 0.0 for k in range(folds) for p in pairs}
    for f, ((k, _), p) in enumerate(fits):
        total[k, p] += precision.get(f, 0.0)
    best = [max(pairs, key=lambda p: total[k, p]) for k in range(folds)]
    last = [(k, None) for k in range(folds)]
    return elastic_fits.scored(rows, [scaled[s] for s in last], best, elastic_fits.fitted(rows, last, [scaled[s] for s in last], best))


def multiclass_probe(df: DataFrame, features: str, label: str, fold: str, folds: int, pca: int, reg: float, key: str = "key") -> DataFrame:
    """Out-of-fold (key, fold, label, p): scaled and PCA-reduced features, a multinomial fit per fold, each row scored once."""
    x = cut(vectors(df.select(F.col(key).alias("key"), features, F.col(label).cast("int").alias("label"), F.col(fold).alias("fold")), features).drop(features))
    out = None
    for k in range(folds):
        train, test = x.where(F.col("fold") != k), x.where(F.col("fold") == k)
        scaler = StandardScaler(withMean=True, inputCol="_x", outputCol="_s").fit(train)
        p = PCA(k=pca, inputCol="_s", outputCol="_p").fit(scaler.transform(train))
        m = LogisticRegression(featuresCol="_p", labelCol="label", family="multinomial", regParam=reg, maxIter=50).fit(p.transform(scaler.transform(train)))
        scored = m.transform(p.transform(scaler.transform(test))).select("key", "fold", "label", vector_to_array("probability").alias("p"))
        out = scored if out is None else out.unionByName(scored)
    return out


def fold_auc(predictions: DataFrame) -> DataFrame:
    return roc_auc(predictions, "label", "score", ["fold"])


def coefficients(df: DataFrame, features: str, label: str, names: DataFrame, elastic: float, reg: float) -> DataFrame:
    """(gene, coefficient) of an elastic-net fit projected back on the whole axis (0 for features left out) and iterations."""
    x = vectors(df.select(features, F.col(label).cast("double").alias("label")), features)
    s = StandardScaler(withMean=True, inputCol="_x", outputCol="_s").fit(x).transform(x)
    m = LogisticRegression(featuresCol="_s", labelCol="label", regParam=reg, elasticNetParam=elastic, standardization=False, maxIter=100).fit(s)
    c = df.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(m.coefficients)], "gene int, coefficient double")
    return names.join(c, "gene", "left").select("gene", F.coalesce("coefficient", F.lit(0.0)).alias("coefficient"), F.lit(m.summary.totalIterations).alias("iterations"))


def principal_components(df: DataFrame, features: str, key: str, k: int) -> DataFrame:
    """(key, scores, explained): scores on the first k components of centred features, with their explained shares."""
    x = vectors(df.select(key, features), features)
    x = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_s").fit(x).transform(x)
    m = PCA(k=k, inputCol="_s", outputCol="_p").fit(x)
    return m.transform(x).select(key, vector_to_array("_p").alias("scores"), F.array(*(F.lit(float(v)) for v in m.explainedVariance)).alias("explained"))
