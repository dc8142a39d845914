"""Queries of the evaluation metrics (M10 to M28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.plans.common import DE, LAB, SCORED, scored
from sampleloom.registry import query
from sampleloom.session import table
from sampleloom.stats import auc

_S = f"{DE}, {LAB}, {SCORED}"
#: AUC over distinct scores, as the operator defines it.
_AUC = """SELECT {by} sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (2 * below + n))::DOUBLE / (2.0::DOUBLE * sum(p) * sum(n)) END AS auc FROM (
  SELECT *, coalesce(sum(n) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {by} score, count_if(y = 1) AS p, count_if(y = 0) AS n FROM {src} GROUP BY ALL)) {group}"""
_POOLED, _BY = _AUC.format(by="", part="", group="", src="scored"), _AUC.format(by="series_id,", part="PARTITION BY series_id", group="GROUP BY series_id", src="scored")


@query("m10_roc_auc", f"WITH {_S} SELECT n_pos, n_neg, round(auc, 8) AS auc FROM ({_POOLED})")
def m10(s, d):
    return auc.roc_auc(scored(s, d), "y", "score").select("n_pos", "n_neg", F.round("auc", 8).alias("auc"))


@query("m10_roc_auc_by_series", f"WITH {_S} SELECT series_id, n_pos, n_neg, round(auc, 8) AS auc FROM ({_BY})")
def m10b(s, d):
    return auc.roc_auc(scored(s, d), "y", "score", ["series_id"]).select("series_id", "n_pos", "n_neg", F.round("auc", 8).alias("auc"))


_PR = f"""WITH {_S}, v AS (SELECT score, sum(y) AS p, count(*) AS a FROM scored GROUP BY 1), c AS (SELECT p, score, sum(p) OVER (ORDER BY score DESC) / sum(a) OVER (ORDER BY score DESC) AS pr FROM v), l AS (SELECT p, pr, coalesce(lag(pr) OVER (ORDER BY score DESC), 1) AS last FROM c)"""


@query("m11_m12_pr_auc", f"{_PR} SELECT round(sum(p * pr) / sum(p), 8)::DOUBLE AS average_precision, round(sum(p * (pr + last) / 2) / sum(p), 8)::DOUBLE AS pr_trapezoid FROM l")
def m11(s, d):
    return auc.pr_auc(scored(s, d), "y", "score").select(F.round("average_precision", 8).alias("average_precision"), F.round("pr_trapezoid", 8).alias("pr_trapezoid"))


@query("m13_confusion", f"""WITH {_S}, c AS (SELECT count_if(y = 1 AND score >= 1) AS tp, count_if(y = 0 AND score >= 1) AS fp, count_if(y = 0 AND score < 1) AS tn, count_if(y = 1 AND score < 1) AS fn FROM scored)
SELECT *, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 8) AS accuracy, round(tp / nullif(tp + fn, 0), 8) AS sensitivity, round(tn / nullif(tn + fp, 0), 8) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 8) AS f1 FROM c""")
def m13(s, d):
    return auc.confusion(scored(s, d), "y", F.col("score") >= 1)


@query("m14_brier", f"WITH {_S} SELECT round(avg((least(score, 1) - y) ** 2), 8) AS brier FROM scored")
def m14(s, d):
    return auc.brier(scored(s, d).withColumn("score", F.least("score", F.lit(1.0))), "y", "score").select(F.round("brier", 8).alias("brier"))


@query("m15_within_series", f"WITH {_S}, g AS ({_BY}), k AS (SELECT * FROM g WHERE n_pos + n_neg >= 6 AND auc IS NOT NULL) SELECT count(*) AS n_groups, round(sum(auc * n_pos * n_neg) / sum(n_pos * n_neg), 8) AS pair_weighted, round(avg(auc), 8) AS mean_auc, round(stddev_pop(auc), 8) AS sd_auc, round(median(auc), 8) AS median_auc, count_if(auc > 0.5) AS n_above_half FROM k")
def m15(s, d):
    return auc.within_groups(scored(s, d), "y", "score", "series_id")


@query("m15_skipped", f"WITH {_S}, g AS ({_BY}) SELECT series_id, CASE WHEN n_pos + n_neg < 6 THEN 'too few rows' ELSE 'single class' END AS reason FROM g WHERE n_pos + n_neg < 6 OR auc IS NULL")
def m15s(s, d):
    return auc.skipped_groups(scored(s, d), "y", "score", "series_id")


@query("m16_pairwise", f"WITH {_S}, g AS ({_BY}) SELECT round(sum(auc * n_pos * n_neg) / sum(n_pos * n_neg), 8) AS pairwise_auc, sum(n_pos * n_neg)::BIGINT AS n_pairs FROM g WHERE auc IS NOT NULL")
def m16(s, d):
    return auc.pairwise_auc(scored(s, d), "y", "score", "series_id")


_Z = "st AS (SELECT series_id, avg(score) AS m, stddev_pop(score) AS sd, count(*) AS k FROM scored GROUP BY 1), z AS (SELECT y, round(CASE WHEN k < 2 OR sd <= 1e-12 * greatest(1, abs(m)) THEN 0 ELSE (score - m) / sd END, 9) AS score FROM scored JOIN st USING (series_id))"


@query("m17_centred", f"WITH {_S}, {_Z} SELECT round(auc, 6) AS auc FROM ({_AUC.format(by='', part='', group='', src='z')})")
def m17(s, d):
    from sampleloom.operators.windows import zscore

    return auc.roc_auc(zscore(scored(s, d), "score", ["series_id"]).withColumn("z", F.round("z", 9)), "y", "z").select(F.round("auc", 6).alias("auc"))


@query("m18_shortcut", f"WITH {_S}, {_Z}, g AS ({_BY}), a AS ({_POOLED}), c AS ({_AUC.format(by='', part='', group='', src='z')}), k AS (SELECT count(*) AS n_groups, round(sum(auc * n_pos * n_neg) / sum(n_pos * n_neg), 8) AS w FROM g WHERE n_pos + n_neg >= 6 AND auc IS NOT NULL), p AS (SELECT round(sum(auc * n_pos * n_neg) / sum(n_pos * n_neg), 8) AS p FROM g WHERE auc IS NOT NULL) SELECT round(a.auc, 6) AS pooled_auc, round(w, 6) AS pair_weighted, n_groups, round(p, 6) AS pairwise_auc, round(c.auc, 6) AS centred_auc, round(a.auc - w, 6) AS gap FROM a, c, k, p")
def m18(s, d):
    x = auc.shortcut_diagnostics(scored(s, d), "y", "score", "series_id")
    return x.select("n_groups", *(F.round(c, 6).alias(c) for c in ("pooled_auc", "pair_weighted", "pairwise_auc", "centred_auc", "gap")))


@query("m19_per_series", f"WITH {_S} SELECT series_id, count(*) AS n, round(avg(y), 8) AS share, round(avg(score), 6) AS mean_score, round(avg((score >= 1 AND y = 1 OR score < 1 AND y = 0)::INTEGER), 8) AS accuracy FROM scored GROUP BY 1")
def m19(s, d):
    right = (F.col("score") >= 1) == (F.col("y") == 1)
    return scored(s, d).groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.avg("y"), 8).alias("share"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(right.cast("int")), 8).alias("accuracy"))


@query("m20_prior", f"WITH {_S} SELECT count(*) AS n, round(avg(y), 8) AS prior, round(greatest(avg(y), 1 - avg(y)), 8) AS accuracy, round(avg(y) * (1 - avg(y)), 8) AS brier FROM scored")
def m20(s, d):
    p = F.avg("y")
    return scored(s, d).agg(F.count("*").alias("n"), F.round(p, 8).alias("prior"), F.round(F.greatest(p, 1 - p), 8).alias("accuracy"), F.round(p * (1 - p), 8).alias("brier"))


_FOLD = "f AS (SELECT l.*, (('0x' || substr(md5('bayes|' || upper(trim(series_id))), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM lab l)"


@query("m22_bayes_rule", f"""WITH {LAB}, {_FOLD}, k AS (SELECT unnest(range(5))::INTEGER AS fold), t AS (SELECT k.fold, disease_category AS c, avg(is_cvd_tissue::INTEGER) AS r FROM f JOIN k ON f.fold <> k.fold GROUP BY 1, 2), p AS (SELECT k.fold, avg(is_cvd_tissue::INTEGER) AS r FROM f JOIN k ON f.fold <> k.fold GROUP BY 1)
SELECT f.fold, count(*) AS n, count_if(t.r IS NULL) AS n_unseen, round(avg((coalesce(t.r, p.r) - is_cvd_tissue::INTEGER) ** 2), 8) AS brier FROM f JOIN p USING (fold) LEFT JOIN t ON t.fold = f.fold AND t.c = f.disease_category GROUP BY 1""")
def m22(s, d):
    from sampleloom.plans.common import lab

    h = F.conv(F.substring(F.md5(F.concat(F.lit("bayes|"), F.upper(F.trim("series_id")))), 1, 8), 16, 10).cast("long")
    x = lab(s, d).where("series_id is not null").select(F.pmod(h, F.lit(5)).cast("int").alias("own"), F.col("disease_category").alias("c"), F.col("is_cvd_tissue").cast("int").alias("y"))
    train = x.withColumn("fold", F.explode(F.array_except(F.array(*map(F.lit, range(5))), F.array("own"))))
    rates, prior = train.groupBy("fold", "c").agg(F.avg("y").alias("r")), train.groupBy("fold").agg(F.avg("y").alias("p"))
    both = x.withColumnRenamed("own", "fold").join(rates, ["fold", "c"], "left").join(prior, "fold")
    return both.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("r").isNull()).alias("n_unseen"), F.round(F.avg(F.pow(F.coalesce("r", "p") - F.col("y"), 2)), 8).alias("brier"))


@query("m23_one_hot", f"WITH {LAB} SELECT sample_index, (disease_category = 'cardiovascular')::INTEGER AS is_cardiovascular, (disease_category = 'infectious')::INTEGER AS is_infectious, (disease_category = 'control')::INTEGER AS is_control FROM lab")
def m23(s, d):
    from sampleloom.plans.common import lab

    return lab(s, d).select("sample_index", *((F.col("disease_category") == v).cast("int").alias(f"is_{v}") for v in ("cardiovascular", "infectious", "control")))


@query("m24_paired_folds", "WITH f AS (SELECT DISTINCT run_id, fold, roc_auc AS a, pr_auc AS b FROM fold_result WHERE roc_auc IS NOT NULL AND pr_auc IS NOT NULL) SELECT run_id, count(*) AS n_folds, round(avg(b - a), 8) AS mean_delta, count_if(b > a) AS wins, round(avg(b - 0.5) / nullif(avg(a - 0.5), 0), 6) AS excess_ratio FROM f GROUP BY 1")
def m24(s, d):
    f = table(s, d, "fold_result").where("roc_auc is not null and pr_auc is not null").select("run_id", "fold", F.col("roc_auc").alias("a"), F.col("pr_auc").alias("b")).distinct()
    return f.groupBy("run_id").agg(F.count("*").alias("n_folds"), F.round(F.avg(F.col("b") - F.col("a")), 8).alias("mean_delta"), F.count_if(F.col("b") > F.col("a")).alias("wins"), F.round(F.avg(F.col("b") - 0.5) / F.nullif(F.avg(F.col("a") - 0.5), F.lit(0.0)), 6).alias("excess_ratio"))


@query("m26_unseen_only", f"WITH {_S}, s AS (SELECT * FROM scored WHERE series_id NOT IN (SELECT upper(trim(series_id)) FROM de WHERE in_holdout AND series_id IS NOT NULL)) SELECT n_pos, n_neg, round(auc, 8) AS auc FROM ({_AUC.format(by='', part='', group='', src='s')})")
def m26(s, d):
    from sampleloom.plans.common import de

    seen = de(s, d).where("in_holdout and series_id is not null").select(F.upper(F.trim("series_id")).alias("series_id"))
    return auc.roc_auc(scored(s, d).join(seen, "series_id", "left_anti"), "y", "score").select("n_pos", "n_neg", F.round("auc", 8).alias("auc"))


@query("m27_phrasing", """WITH p AS (SELECT category, template_index // 2 AS phrase, template_index % 2 AS ordering, is_positive::INTEGER AS v FROM generation_plan WHERE template_index >= 0 AND is_positive IS NOT NULL),
f AS (SELECT category, phrase, avg(v) AS m, avg(CASE WHEN ordering = 0 THEN v END) - avg(CASE WHEN ordering = 1 THEN v END) AS gap FROM p GROUP BY 1, 2)
SELECT category, count(*) AS n_phrasings, round(min(m), 8) AS least, round(max(m), 8) AS most, round(max(m) - min(m), 8) AS spread, round(max(abs(gap)), 8) AS order_gap, round(avg(gap), 8) AS mean_shift FROM f GROUP BY 1""")
def m27(s, d):
    """Templates come in pairs that ask the same in two orders: the spread over phrasings and the gap of the orders."""
    p = table(s, d, "generation_plan").where("template_index >= 0 and is_positive is not null")
    p = p.select("category", F.floor(F.col("template_index") / 2).alias("phrase"), F.pmod("template_index", F.lit(2)).alias("ordering"), F.col("is_positive").cast("int").alias("v"))
    half = lambda k: F.avg(F.when(F.col("ordering") == k, F.col("v")))
    f = p.groupBy("category", "phrase").agg(F.avg("v").alias("m"), (half(0) - half(1)).alias("gap"))
    return f.groupBy("category").agg(F.count("*").alias("n_phrasings"), F.round(F.min("m"), 8).alias("least"), F.round(F.max("m"), 8).alias("most"), F.round(F.max("m") - F.min("m"), 8).alias("spread"), F.round(F.max(F.abs("gap")), 8).alias("order_gap"), F.round(F.avg("gap"), 8).alias("mean_shift"))


_LINEAR = """e AS (SELECT vec_id, label, unnest(range(len(embedding)))::INTEGER AS gene, unnest(embedding)::DOUBLE AS v FROM embeddings), w AS (SELECT gene, avg(CASE WHEN label < 5 THEN v END) - avg(CASE WHEN label >= 5 THEN v END) AS w FROM e GROUP BY 1),
x AS (SELECT vec_id, sum(v * w) AS score, row_number() OVER (ORDER BY md5('shuffle|' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM e JOIN w USING (gene) GROUP BY vec_id), c AS (SELECT a.score, b.score AS other FROM x a JOIN x b ON b.r = a.r % a.n + 1)"""


@query("m28_shuffled_control", f"WITH {_LINEAR}, g AS (SELECT count(*) AS n, avg(abs(score - other)) / stddev_pop(score) AS s, avg(abs(0.0)) AS ignoring FROM c) SELECT n, round(s, 6) AS sensitivity, CASE WHEN s < 0.25 THEN 'ignored' WHEN s < 0.6 THEN 'weak' ELSE 'used' END AS verdict FROM g")
def m28(s, d):
    """Scores of a linear scorer on each sample's own vector and on another one's: every sample gets the next one's vector
    in an order by hash."""
    from sampleloom.operators.order import global_rank
    from sampleloom.operators.sampling import draw_key
    from sampleloom.plans.common import emb

    e = emb(s, d)
    half = lambda c: F.avg(F.when(c, F.col("v")))
    w = e.groupBy("gene").agg((half(F.col("label") < 5) - half(F.col("label") >= 5)).alias("w"))
    own = e.join(w, "gene").groupBy("sample_index").agg(F.sum(F.col("v") * F.col("w")).alias("score"))
    x = global_rank(own.withColumn("h", draw_key("shuffle", "sample_index")), F.col("h"), F.col("sample_index"), out="r")
    return auc.shuffled_control(x, "score", "r")


@query("m41_headline", "SELECT arg_max(run_id, auc) AS best_run, arg_min(run_id, auc) AS worst_run, round(max(auc), 8) AS best, round(min(auc), 8) AS worst FROM (SELECT run_id, avg(roc_auc) AS auc FROM (SELECT DISTINCT * FROM fold_result) WHERE NOT skipped GROUP BY 1)")
def m41(s, d):
    g = table(s, d, "fold_result").distinct().where("not skipped").groupBy("run_id").agg(F.avg("roc_auc").alias("auc"))
    return g.agg(F.max_by("run_id", "auc").alias("best_run"), F.min_by("run_id", "auc").alias("worst_run"), F.round(F.max("auc"), 8).alias("best"), F.round(F.min("auc"), 8).alias("worst"))
