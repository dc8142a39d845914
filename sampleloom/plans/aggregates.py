"""Queries of the aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.operators.order import with_quantiles
from sampleloom.operators import aggregates as op
from sampleloom.operators.windows import ranked
from sampleloom.plans.common import DE, EMB, EXPR, LAB, de, emb, expr, lab
from sampleloom.registry import query
from sampleloom.session import table


@query("a01_composition", f"WITH {LAB} SELECT 'disease_category' AS grouping, disease_category AS level, count(*) AS count FROM lab GROUP BY 2 UNION ALL SELECT 'cvd_subtype', cvd_subtype, count(*) FROM lab GROUP BY 2 UNION ALL SELECT 'is_cvd_pool', is_cvd_pool::VARCHAR, count(*) FROM lab GROUP BY 2")
def a01(s, d):
    return op.composition(lab(s, d), {c: F.col(c) for c in ("disease_category", "cvd_subtype", "is_cvd_pool")})


_SIZES = "sizes AS (SELECT sample_index, sum(n)::BIGINT AS library_size, count_if(n > 0) AS genes_detected FROM expr GROUP BY 1)"


def sizes(s, d):
    return expr(s, d).groupBy("sample_index").agg(F.sum("n").alias("library_size"), F.count_if(F.col("n") > 0).alias("genes_detected"))


@query("a02_library_size", f"WITH {EXPR}, {_SIZES} SELECT * FROM sizes")
def a02(s, d):
    return sizes(s, d)


@query("a03_gene_summary", f"WITH {EXPR}, t AS (SELECT count(DISTINCT sample_index) AS t FROM expr) SELECT gene, round(count_if(n > 0) / t.t, 8) AS detection_rate, round(sum(n)::BIGINT / t.t, 8) AS mean_count FROM expr, t GROUP BY gene, t.t")
def a03(s, d):
    x = expr(s, d)
    g = x.groupBy("gene").agg(F.count_if(F.col("n") > 0).alias("k"), F.sum("n").alias("m"))
    return g.crossJoin(F.broadcast(x.select(F.countDistinct("sample_index").alias("t")))).select("gene", F.round(F.col("k") / F.col("t"), 8).alias("detection_rate"), F.round(F.col("m") / F.col("t"), 8).alias("mean_count"))


@query("a04_mad", f"WITH {EXPR}, {_SIZES} SELECT median(library_size)::DOUBLE AS centre, mad(library_size)::DOUBLE AS mad FROM sizes")
def a04(s, d):
    return op.mad(sizes(s, d), "library_size").select(F.col("centre").cast("double").alias("centre"), F.col("mad").cast("double").alias("mad"))


@query("a05_mad_flags", f"""WITH {EXPR}, {_SIZES}, x AS (SELECT sample_index, log10(greatest(library_size, 1)) AS x, genes_detected::DOUBLE AS g FROM sizes), m AS (SELECT median(x) AS xm, median(g) AS gm, greatest(mad(x), 1e-9) AS xs, greatest(mad(g), 1e-9) AS gs FROM x)
SELECT sample_index, x < xm - 2 * 1.4826 * xs AS is_low, x > xm + 2 * 1.4826 * xs AS is_high, g < gm - 2 * 1.4826 * gs AS is_poor FROM x, m""")
def a05(s, d):
    return op.mad_flags(sizes(s, d), "library_size", "genes_detected", 2.0).select("sample_index", "is_low", "is_high", "is_poor")


_METRICS = f"""{DE}, {LAB}, x AS (SELECT lab.sample_index, disease_category AS g, has_resolved_patient AS r, upper(trim(lab.series_id)) AS series, upper(trim(patient_key)) AS p, max_abs_z::DOUBLE AS v FROM lab LEFT JOIN de USING (sample_index)),
pp AS (SELECT g, p, count(*) AS k FROM x WHERE p IS NOT NULL GROUP BY 1, 2)"""


def _labelled(s, d):
    x = lab(s, d).join(de(s, d, "max_abs_z").select("sample_index", F.col("max_abs_z").cast("double").alias("v")), "sample_index", "left")
    return x.select("sample_index", F.col("disease_category").alias("g"), F.col("has_resolved_patient").alias("r"), F.upper(F.trim("series_id")).alias("series"), F.upper(F.trim("patient_key")).alias("p"), "v")


@query("a06_group_metrics", f"""WITH {_METRICS}, a AS (SELECT g, count(*) AS n_samples, count(DISTINCT series) AS n_series, round(avg(v), 6) AS v_mean, round(quantile_cont(v, .5), 6) AS v_median, round(quantile_cont(v, .25), 6) AS v_q1, round(quantile_cont(v, .75), 6) AS v_q3, max(v) AS v_max, count(v) AS v_n,
count_if(r) AS n_resolved_samples, count(DISTINCT CASE WHEN r THEN p END) AS n_resolved_patients, round(count_if(r) * 100.0 / count(*), 4)::DOUBLE AS resolution_pct FROM x GROUP BY 1),
b AS (SELECT g, count(*) AS n_patients, round(avg(k), 6) AS samples_per_patient_mean, round(quantile_cont(k::DOUBLE, .5), 6) AS samples_per_patient_median, round(quantile_cont(k::DOUBLE, .25), 6) AS samples_per_patient_q1, round(quantile_cont(k::DOUBLE, .75), 6) AS samples_per_patient_q3, max(k)::DOUBLE AS samples_per_patient_max FROM pp GROUP BY 1)
SELECT * FROM a LEFT JOIN b USING (g)""")
def a06(s, d):
    return op.group_metrics(_labelled(s, d), "g", "p", "series", F.col("r"), "v").withColumn("resolution_pct", F.col("resolution_pct").cast("double"))


@query("a07_distribution", f"WITH {DE} SELECT round(avg(max_abs_z::DOUBLE), 6) AS z_mean, round(quantile_cont(max_abs_z::DOUBLE, .5), 6) AS z_median, round(quantile_cont(max_abs_z::DOUBLE, .25), 6) AS z_q1, round(quantile_cont(max_abs_z::DOUBLE, .75), 6) AS z_q3, max(max_abs_z)::DOUBLE AS z_max FROM de")
def a07(s, d):
    z = de(s, d).select(F.col("max_abs_z").cast("double").alias("z"))
    return with_quantiles(z.agg(*op.distribution("z", "z")), [], z, op.quartiles("z", "z"))


@query("a08_total_row", f"WITH {LAB} SELECT CASE WHEN grouping(disease_category) = 1 THEN 'total' ELSE disease_category END AS category, count(*) AS n, count_if(is_cvd_pool) AS n_pool FROM lab GROUP BY ROLLUP (disease_category)")
def a08(s, d):
    g = lab(s, d).rollup("disease_category").agg(F.count("*").alias("n"), F.count_if("is_cvd_pool").alias("n_pool"), F.grouping("disease_category").alias("t"))
    return g.select(F.when(F.col("t") == 1, "total").otherwise(F.col("disease_category")).alias("category"), "n", "n_pool")


@query("a09_zero_fill", "WITH dom AS (SELECT unnest(['cardiovascular', 'cancer', 'infectious', 'metabolic', 'no_such']) AS disease_category), c AS (SELECT disease_category, count(*) AS n FROM sample_labels GROUP BY 1) SELECT disease_category, coalesce(n, 0) AS n FROM dom LEFT JOIN c USING (disease_category)")
def a09(s, d):
    dom = s.createDataFrame([(x,) for x in ("cardiovascular", "cancer", "infectious", "metabolic", "no_such")], "disease_category string")
    return op.zero_filled(dom, table(s, d, "sample_labels").groupBy("disease_category").agg(F.count("*").alias("n")), "disease_category")


@query("a10_resolution", f"WITH {LAB} SELECT count(*) AS n, count_if(has_resolved_patient) AS n_resolved, count(DISTINCT CASE WHEN has_resolved_patient THEN upper(trim(patient_key)) END) AS n_patients FROM lab")
def a10(s, d):
    r = F.col("has_resolved_patient")
    return lab(s, d).agg(F.count("*").alias("n"), F.count_if(r).alias("n_resolved"), F.countDistinct(F.when(r, F.upper(F.trim("patient_key")))).alias("n_patients"))


@query("a11_coverage", f"WITH {DE} SELECT status, reference_scope, count(*) AS n, count(mean_abs_z) AS n_scored FROM de GROUP BY 1, 2")
def a11(s, d):
    return de(s, d).groupBy("status", "reference_scope").agg(F.count("*").alias("n"), F.count("mean_abs_z").alias("n_scored"))


@query("a12_pool_composition", f"WITH {LAB} SELECT count_if(is_cvd_disease AND NOT is_cvd_tissue) AS only_disease, count_if(is_cvd_tissue AND NOT is_cvd_disease) AS only_tissue, count_if(is_cvd_tissue AND is_cvd_disease) AS both_parts, count_if(n_disease_categories_matched >= 2) AS comorbid FROM lab")
def a12(s, d):
    a, b = F.col("is_cvd_disease"), F.col("is_cvd_tissue")
    return lab(s, d).agg(F.count_if(a & ~b).alias("only_disease"), F.count_if(b & ~a).alias("only_tissue"), F.count_if(a & b).alias("both_parts"), F.count_if(F.col("n_disease_categories_matched") >= 2).alias("comorbid"))


@query("a13_cross_check", f"WITH {LAB} SELECT count_if(is_cvd_pool <> (is_cvd_disease OR is_cvd_tissue)) AS pool_mismatch, count_if((cvd_subtype = '') = is_cvd_pool) AS subtype_mismatch, count_if(is_cvd_disease AND disease_category <> 'cardiovascular') AS category_mismatch, count_if(has_resolved_patient AND patient_key IS NULL) AS key_mismatch FROM lab")
def a13(s, d):
    c = F.col
    return lab(s, d).agg(
        F.count_if(c("is_cvd_pool") != (c("is_cvd_disease") | c("is_cvd_tissue"))).alias("pool_mismatch"), F.count_if((c("cvd_subtype") == "") == c("is_cvd_pool")).alias("subtype_mismatch"),
        F.count_if(c("is_cvd_disease") & (c("disease_category") != "cardiovascular")).alias("category_mismatch"), F.count_if(c("has_resolved_patient") & c("patient_key").isNull()).alias("key_mismatch"),
    )


@query("a14_variance", f"WITH {EMB} SELECT gene, round(var_samp(v), 8) AS variance FROM emb GROUP BY 1")
def a14(s, d):
    return emb(s, d).groupBy("gene").agg(F.round(F.var_samp("v"), 8).alias("variance"))


@query("a15_across_folds", "SELECT variant, pool, round(avg(roc_auc), 8) AS mean, round(median(roc_auc), 8) AS median, round(abs(avg(roc_auc)), 8) AS abs_mean, round(avg((roc_auc > 0.5)::INTEGER), 8) AS above_half FROM (SELECT DISTINCT * FROM fold_result) WHERE NOT skipped GROUP BY 1, 2")
def a15(s, d):
    f = table(s, d, "fold_result").distinct().where("not skipped")
    return f.groupBy("variant", "pool").agg(F.round(F.avg("roc_auc"), 8).alias("mean"), F.round(F.median("roc_auc"), 8).alias("median"), F.round(F.abs(F.avg("roc_auc")), 8).alias("abs_mean"), F.round(F.avg((F.col("roc_auc") > 0.5).cast("int")), 8).alias("above_half"))


@query("a16_reference_stats", f"WITH {EMB}, g AS (SELECT label, gene, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM emb GROUP BY GROUPING SETS ((label, gene), (gene))) SELECT label, gene, round(m, 8) AS m, round(sd, 8) AS sd, n FROM g WHERE label IS NULL OR n >= 30")
def a16(s, d):
    g = emb(s, d).groupingSets([["label", "gene"], ["gene"]], "label", "gene").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n"))
    return g.where("label is null or n >= 30").select("label", "gene", F.round("m", 8).alias("m"), F.round("sd", 8).alias("sd"), "n")


@query("a17_in_degree", "WITH g AS (SELECT DISTINCT gene FROM coexpression_edges WHERE gene IS NOT NULL), c AS (SELECT partner AS gene, count(DISTINCT gene) AS in_degree FROM coexpression_edges GROUP BY 1) SELECT gene, coalesce(in_degree, 0) AS in_degree FROM g LEFT JOIN c USING (gene)")
def a17(s, d):
    e = table(s, d, "coexpression_edges")
    c = e.groupBy(F.col("partner").alias("gene")).agg(F.countDistinct("gene").alias("in_degree"))
    return op.zero_filled(e.where("gene is not null").select("gene").distinct(), c, "gene")


@query("a18_depth_r2", f"WITH {EMB}, t AS (SELECT sample_index, sum(v) AS depth FROM emb GROUP BY 1) SELECT gene, round(corr(v, depth) ** 2, 8) AS r2 FROM emb JOIN t USING (sample_index) GROUP BY 1")
def a18(s, d):
    x = emb(s, d)
    return op.correlation_r2(x.join(x.groupBy("sample_index").agg(F.sum("v").alias("depth")), "sample_index"), "gene", "v", "depth").select("gene", F.round("r2", 8).alias("r2"))


_ETA = f"{EMB}, g AS (SELECT gene, label, count(*) AS n, avg(v) AS m, var_pop(v) AS w FROM emb GROUP BY 1, 2), eta AS (SELECT gene, (sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (sum(n * m * m) - sum(n * m) ** 2 / sum(n) + sum(n * w)) AS eta2 FROM g GROUP BY 1)"


@query("a19_eta_squared", f"WITH {_ETA} SELECT gene, round(eta2, 8) AS eta2 FROM eta")
def a19(s, d):
    return op.eta_squared(emb(s, d), "gene", "label", "v").select("gene", F.round("eta2", 8).alias("eta2"))


@query("a20_arm_summary", f"WITH {_ETA} SELECT gene < 32 AS arm, round(median(eta2), 8) AS median, round(avg(eta2), 8) AS mean, round(quantile_cont(eta2, .9), 8) AS p90, round(avg((eta2 > 0.05)::INTEGER), 8) AS over FROM eta GROUP BY 1")
def a20(s, d):
    e = op.eta_squared(emb(s, d), "gene", "label", "v").withColumn("arm", F.col("gene") < 32)
    g = e.groupBy("arm").agg(F.round(F.avg("eta2"), 8).alias("mean"), F.round(F.avg((F.col("eta2") > 0.05).cast("int")), 8).alias("over"))
    return with_quantiles(g, ["arm"], e, {"median": ("eta2", 0.5), "p90": ("eta2", 0.9)}, digits=8)


@query("a21_matched_contrast", f"""WITH {DE}, {LAB}, x AS (SELECT greatest(ceil(frac_genes_abs_z_gt2::DOUBLE / 0.02), 1)::INTEGER AS stratum, is_cvd_disease AS side, mean_abs_z::DOUBLE AS v FROM de JOIN lab USING (sample_index) WHERE status = 'ok'),
g AS (SELECT stratum, count_if(side) AS n_in, count_if(NOT side) AS n_out, round(median(CASE WHEN side THEN v END), 6) AS median_in, round(median(CASE WHEN NOT side THEN v END), 6) AS median_out FROM x GROUP BY 1) SELECT * FROM g WHERE n_in >= 30 AND n_out >= 30""")
def a21(s, d):
    x = de(s, d).where("status = 'ok'").join(lab(s, d).select("sample_index", "is_cvd_disease"), "sample_index").withColumn("v", F.col("mean_abs_z").cast("double"))
    stratum = F.greatest(F.ceil(F.col("frac_genes_abs_z_gt2").cast("double") / 0.02), F.lit(1)).cast("int")
    g = op.matched_contrast(x, stratum, "is_cvd_disease", "v", 30)
    return g.withColumn("median_in", F.round("median_in", 6)).withColumn("median_out", F.round("median_out", 6))


@query("a22_overlap", f"""WITH {DE}, a AS (SELECT DISTINCT gene FROM coexpression_edges WHERE gene IS NOT NULL), b AS (SELECT DISTINCT unnest(top_up_genes) AS gene FROM de), c AS (SELECT DISTINCT unnest(top_down_genes) AS gene FROM de),
u AS (SELECT gene FROM a UNION SELECT gene FROM b UNION SELECT gene FROM c) SELECT concat_ws('+', CASE WHEN gene IN (FROM a) THEN 'in_graph' END, CASE WHEN gene IN (FROM b) THEN 'in_up' END, CASE WHEN gene IN (FROM c) THEN 'in_down' END) AS region, count(*) AS n FROM u GROUP BY 1""")
def a22(s, d):
    from sampleloom.operators.joins import provenance_union

    x = de(s, d)
    flags = provenance_union("gene", graph=table(s, d, "coexpression_edges").select("gene"), up=x.select(F.explode("top_up_genes").alias("gene")), down=x.select(F.explode("top_down_genes").alias("gene")))
    return op.overlap_regions(flags, ["in_graph", "in_up", "in_down"])


@query("a23_identifiers", r"""SELECT count(*) AS n, count(DISTINCT partner) AS n_unique, count_if(regexp_matches(partner, '^ENSG\d+$')) AS n_ensembl, count_if(regexp_matches(partner, '^[A-Z0-9-]+$') AND NOT regexp_matches(partner, '^ENSG\d+$')) AS n_symbol,
count_if(partner <> upper(partner)) AS n_lower, count_if(partner <> trim(partner)) AS n_untrimmed, count_if(partner IS NULL OR trim(partner) = '') AS n_empty FROM coexpression_edges""")
def a23(s, d):
    return op.identifier_profile(table(s, d, "coexpression_edges"), "partner")


@query("a23_same_universe", "SELECT (SELECT count(*) FROM (SELECT sample_index FROM per_sample_de EXCEPT ALL SELECT sample_index FROM sample_labels)) AS only_a, (SELECT count(*) FROM (SELECT sample_index FROM sample_labels EXCEPT ALL SELECT sample_index FROM per_sample_de)) AS only_b")
def a23u(s, d):
    return op.same_multiset(table(s, d, "per_sample_de").select("sample_index"), table(s, d, "sample_labels").select("sample_index"))


@query("a24_concentration", f"""WITH {DE}, c AS (SELECT upper(trim(series_id)) AS g, count(*) AS n FROM de WHERE series_id IS NOT NULL GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total, count(*) AS groups FROM c),
r AS (SELECT n, n / total AS share, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) / total AS cum, row_number() OVER (ORDER BY n DESC) AS r, groups, total FROM c, t)
SELECT groups, total, count_if(cum < 0.5) + 1 AS n_50, count_if(cum < 0.8) + 1 AS n_80, round(sum(share * share), 8) AS hhi, round(1 / sum(share * share), 4) AS effective_n, round((groups + 1 - 2 * sum(r * share)) / groups, 6) AS gini, count_if(n = 1) AS singletons, round(max(share), 8) AS top_share FROM r GROUP BY groups, total""")
def a24(s, d):
    c = de(s, d, "series_id").where("series_id is not null").groupBy(F.upper(F.trim("series_id")).alias("g")).agg(F.count("*").alias("n"))
    return op.concentration(c)


@query("a25_mixed_series", f"WITH {LAB} SELECT upper(trim(series_id)) AS series, count_if(is_cvd_disease) AS n_pos, count_if(NOT is_cvd_disease) AS n_neg FROM lab GROUP BY 1 HAVING count_if(is_cvd_disease) > 0 AND count_if(NOT is_cvd_disease) > 0")
def a25(s, d):
    return op.mixed_groups(lab(s, d).withColumn("series", F.upper(F.trim("series_id"))), "series", F.col("is_cvd_disease"))


@query("a26_single_class_series", f"WITH {LAB} SELECT upper(trim(series_id)) AS series, count(*) AS n FROM lab GROUP BY 1 HAVING count(DISTINCT is_cvd_disease) < 2")
def a26(s, d):
    return op.single_class_groups(lab(s, d).withColumn("series", F.upper(F.trim("series_id"))), "series", "is_cvd_disease")


@query("a27_fold_counts", "SELECT fold, count(*) AS n, sum(n_val_pos)::BIGINT AS pos, sum(n_val_neg)::BIGINT AS neg, count(DISTINCT run_id) AS runs FROM (SELECT DISTINCT * FROM fold_result) GROUP BY 1")
def a27(s, d):
    return table(s, d, "fold_result").distinct().groupBy("fold").agg(F.count("*").alias("n"), F.sum("n_val_pos").alias("pos"), F.sum("n_val_neg").alias("neg"), F.countDistinct("run_id").alias("runs"))


@query("a28_collapse_rare", f"""WITH {LAB}, x AS (SELECT sample_index, coalesce(nullif(trim(cvd_subtype), ''), '__missing__') AS l FROM lab), c AS (SELECT l, count(*) AS n FROM x GROUP BY 1)
SELECT CASE WHEN n >= 200 OR l = '__missing__' THEN l ELSE '__other__' END AS cvd_subtype, count(*) AS n FROM x JOIN c USING (l) GROUP BY 1""")
def a28(s, d):
    return op.collapse_rare(lab(s, d), "cvd_subtype", 200).groupBy("cvd_subtype").agg(F.count("*").alias("n"))


_CAP = f"{LAB}, c AS (SELECT disease_category AS b, count_if(is_cvd_tissue) AS p, count_if(NOT is_cvd_tissue) AS q FROM lab GROUP BY 1)"


def _cap(s, d):
    t = F.col("is_cvd_tissue")
    return lab(s, d).groupBy(F.col("disease_category").alias("b")).agg(F.count_if(t).alias("p"), F.count_if(~t).alias("q"))


@query("a29_matching_capacity", f"WITH {_CAP} SELECT b, p, q, least(q, floor(2 * p))::BIGINT AS capacity, p = 0 OR q = 0 AS no_counterpart FROM c")
def a29(s, d):
    return _cap(s, d).select("b", "p", "q", F.least("q", F.floor(F.col("p") * 2)).alias("capacity"), ((F.col("p") == 0) | (F.col("q") == 0)).alias("no_counterpart"))


@query("a30_feasibility", f"""WITH {LAB}, s AS (SELECT disease_category AS b, upper(trim(series_id)) AS g, count_if(is_cvd_tissue) AS p, count_if(NOT is_cvd_tissue) AS q FROM lab GROUP BY 1, 2), caps AS (SELECT unnest([2, 5, 20]) AS cap),
t AS (SELECT cap, b, sum(least(p, cap))::BIGINT AS p, sum(least(q, cap))::BIGINT AS q FROM s, caps GROUP BY 1, 2) SELECT cap, sum(least(p, q))::BIGINT AS matched FROM t GROUP BY 1""")
def a30(s, d):
    t = F.col("is_cvd_tissue")
    x = lab(s, d).groupBy(F.col("disease_category").alias("b"), F.upper(F.trim("series_id")).alias("g")).agg(F.count_if(t).alias("p"), F.count_if(~t).alias("q"))
    x = x.withColumn("cap", F.explode(F.array(*map(F.lit, (2, 5, 20))))).groupBy("cap", "b").agg(F.sum(F.least("p", "cap")).alias("p"), F.sum(F.least("q", "cap")).alias("q"))
    return x.groupBy("cap").agg(F.sum(F.least("p", "q")).alias("matched"))


@query("a31_purity", f"WITH {LAB}, c AS (SELECT upper(trim(series_id)) AS g, count(*) AS n, avg(is_cvd_disease::INTEGER) AS f FROM lab GROUP BY 1) SELECT g, n, round(f, 8) AS pos_share, f <= 0.02 OR f >= 0.98 AS pure FROM c WHERE n >= 20")
def a31(s, d):
    x = lab(s, d).groupBy(F.upper(F.trim("series_id")).alias("g")).agg(F.count("*").alias("n"), F.avg(F.col("is_cvd_disease").cast("int")).alias("f")).where("n >= 20")
    return x.select("g", "n", F.round("f", 8).alias("pos_share"), ((F.col("f") <= 0.02) | (F.col("f") >= 0.98)).alias("pure"))


@query("a32_corpus", """WITH g AS (SELECT category, length(paraphrased_answer) AS l, paraphrased_answer AS a FROM generation_results WHERE status = 'ok')
SELECT category, count(*) AS n, count(DISTINCT a) AS n_unique, round(avg(l), 6) AS mean_length, round(quantile_cont(l::DOUBLE, .95), 6) AS p95_length, max(l) AS max_length, round(count(DISTINCT a) / count(*), 8) AS distinct_ratio FROM g GROUP BY 1""")
def a32(s, d):
    g = table(s, d, "generation_results").where("status = 'ok'").select("category", F.length("paraphrased_answer").cast("long").alias("l"), F.col("paraphrased_answer").alias("a"))
    # answers are told apart by 128 bits of their digest, so texts aren't shuffled
    a = F.substring(F.sha2("a", 256), 1, 32)
    c = g.select("category", "l", a.alias("a")).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("a").alias("n_unique"), F.round(F.avg("l"), 6).alias("mean_length"), F.max("l").alias("max_length"), F.round(F.countDistinct("a") / F.count("*"), 8).alias("distinct_ratio"))
    return with_quantiles(c, ["category"], g, {"p95_length": ("l", 0.95)})


@query("a33_token_frequency", "WITH t AS (SELECT line_no, unnest(list_distinct(regexp_extract_all(lower(paraphrased_answer), '[a-z]+'))) AS token FROM generation_results), n AS (SELECT count(*) AS n FROM generation_results) SELECT token, count(*) AS n_lines, round(count(*) * 100.0 / n.n, 6)::DOUBLE AS pct FROM t, n GROUP BY token, n.n")
def a33(s, d):
    g = table(s, d, "generation_results")
    t = g.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("paraphrased_answer"), F.lit("[a-z]+"), F.lit(0)))).alias("token")).groupBy("token").agg(F.count("*").alias("n_lines"))
    return t.crossJoin(F.broadcast(g.agg(F.count("*").alias("n")))).select("token", "n_lines", F.round(F.col("n_lines") * 100.0 / F.col("n"), 6).cast("double").alias("pct"))


@query("a34_repetition", f"WITH {DE}, g AS (SELECT unnest(top_up_genes) AS gene FROM de), c AS (SELECT gene, count(*) AS n FROM g GROUP BY 1), t AS (SELECT n FROM c ORDER BY n DESC, gene LIMIT 20) SELECT (SELECT count(*) FROM g) AS slots, (SELECT count(*) FROM c) AS n_distinct, round((SELECT sum(n) FROM t) / (SELECT count(*) FROM g), 8) AS top20_share")
def a34(s, d):
    c = de(s, d, "top_up_genes").select(F.explode("top_up_genes").alias("gene")).groupBy("gene").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "gene").limit(20).agg(F.sum("n").alias("t"))
    return c.agg(F.sum("n").alias("slots"), F.count("*").alias("n_distinct")).crossJoin(top).select("slots", "n_distinct", F.round(F.col("t") / F.col("slots"), 8).alias("top20_share"))


@query("a35_distinct_gate", "SELECT category, round(count(DISTINCT paraphrased_answer) / count(*), 8) AS ratio, count(DISTINCT paraphrased_answer) >= 0.9 * count(*) AS passes FROM generation_results WHERE status = 'ok' GROUP BY 1")
def a35(s, d):
    g = table(s, d, "generation_results").where("status = 'ok'").groupBy("category").agg(F.countDistinct("paraphrased_answer").alias("u"), F.count("*").alias("n"))
    return g.select("category", F.round(F.col("u") / F.col("n"), 8).alias("ratio"), (F.col("u") >= F.lit(0.9) * F.col("n")).alias("passes"))


@query("a36_balance_gate", "SELECT template_index, count(*) AS n, round(avg(is_positive::INTEGER), 8) AS share, avg(is_positive::INTEGER) BETWEEN 0.45 AND 0.55 AS balanced FROM generation_plan GROUP BY 1")
def a36(s, d):
    g = table(s, d, "generation_plan").groupBy("template_index").agg(F.count("*").alias("n"), F.avg(F.col("is_positive").cast("int")).alias("f"))
    return g.select("template_index", "n", F.round("f", 8).alias("share"), F.col("f").between(0.45, 0.55).alias("balanced"))


@query("a37_usage", """SELECT status, count(*) AS n, sum(usage.cache_hit_tokens)::BIGINT AS hit, sum(usage.cache_miss_tokens)::BIGINT AS miss, sum(usage.output_tokens)::BIGINT AS output,
round((sum(usage.cache_hit_tokens) * 0.028 + sum(usage.cache_miss_tokens) * 0.28 + sum(usage.output_tokens) * 0.42) / 1e6, 8)::DOUBLE AS cost, round(sum(usage.cache_hit_tokens) / nullif(sum(usage.cache_hit_tokens) + sum(usage.cache_miss_tokens), 0), 8)::DOUBLE AS hit_rate FROM generation_results GROUP BY 1""")
def a37(s, d):
    g = table(s, d, "generation_results").groupBy("status").agg(F.count("*").alias("n"), F.sum("usage.cache_hit_tokens").alias("hit"), F.sum("usage.cache_miss_tokens").alias("miss"), F.sum("usage.output_tokens").alias("output"))
    cost = (F.col("hit") * F.lit(0.028) + F.col("miss") * F.lit(0.28) + F.col("output") * F.lit(0.42)) / F.lit(1e6)
    return g.withColumn("cost", F.round(cost, 8)).withColumn("hit_rate", F.round(F.col("hit") / F.nullif(F.col("hit") + F.col("miss"), F.lit(0)), 8))


@query("a38_checksum", "SELECT category, count(*) AS n, sum(('0x' || substr(md5(line_no::VARCHAR || '|' || coalesce(gt_answer, '')), 1, 12))::BIGINT)::HUGEINT::VARCHAR AS checksum FROM generation_results GROUP BY 1")
def a38(s, d):
    h = F.conv(F.substring(F.md5(F.concat(F.col("line_no").cast("string"), F.lit("|"), F.coalesce("gt_answer", F.lit("")))), 1, 12), 16, 10).cast("decimal(20,0)")
    return table(s, d, "generation_results").groupBy("category").agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("checksum"))


@query("a39_rank_one", f"WITH {DE} SELECT top_up_genes[1] AS gene, count(*) AS n FROM de WHERE len(top_up_genes) > 0 GROUP BY 1")
def a39(s, d):
    return de(s, d).where(F.size("top_up_genes") > 0).groupBy(F.element_at("top_up_genes", 1).alias("gene")).agg(F.count("*").alias("n"))


@query("a40_max_merge", "SELECT gene, partner, max(pearson_r)::DOUBLE AS r, count(*) AS n FROM coexpression_edges WHERE NOT isnan(pearson_r) GROUP BY 1, 2")
def a40(s, d):
    return table(s, d, "coexpression_edges").where("not isnan(pearson_r) and pearson_r is not null").groupBy("gene", "partner").agg(F.max("pearson_r").cast("double").alias("r"), F.count("*").alias("n"))


@query("a41_segmented_mean", f"WITH {EMB} SELECT sample_index, gene // 8 AS segment, round(avg(v), 8) AS v FROM emb GROUP BY 1, 2")
def a41(s, d):
    return emb(s, d).groupBy("sample_index", F.floor(F.col("gene") / 8).cast("int").alias("segment")).agg(F.round(F.avg("v"), 8).alias("v"))


@query("a42_joined_labels", "SELECT geo_accession, CASE WHEN count(DISTINCT upper(trim(series_id))) > 1 THEN 'several' ELSE min(upper(trim(series_id))) END AS series FROM per_sample_de GROUP BY 1")
def a42(s, d):
    x = F.upper(F.trim("series_id"))
    return table(s, d, "per_sample_de").groupBy("geo_accession").agg(F.countDistinct(x).alias("n"), F.min(x).alias("m")).select("geo_accession", F.when(F.col("n") > 1, "several").otherwise(F.col("m")).alias("series"))


@query("a43_fold_summary", "SELECT run_id, round(avg(roc_auc), 8) AS mean, round(stddev_samp(roc_auc), 8) AS sd_sample, round(stddev_pop(roc_auc), 8) AS sd_population, min(roc_auc) AS least, max(roc_auc) AS most FROM (SELECT DISTINCT * FROM fold_result) WHERE NOT isnan(roc_auc) GROUP BY 1")
def a43(s, d):
    f = table(s, d, "fold_result").distinct().where("roc_auc is not null and not isnan(roc_auc)")
    return f.groupBy("run_id").agg(F.round(F.avg("roc_auc"), 8).alias("mean"), F.round(F.stddev_samp("roc_auc"), 8).alias("sd_sample"), F.round(F.stddev_pop("roc_auc"), 8).alias("sd_population"), F.min("roc_auc").alias("least"), F.max("roc_auc").alias("most"))


_TERMS = ["control", "series", "batch", "heart"]


@query("a44_term_search", "WITH t AS (SELECT unnest(['control', 'series', 'batch', 'heart']) AS term) SELECT term, count_if(contains(lower(text), term)) AS in_text, count_if(contains(lower(source), term)) AS in_source, count_if(contains(lower(text), term) OR contains(lower(source), term)) AS in_any FROM documents, t GROUP BY 1")
def a44(s, d):
    x = table(s, d, "documents").select(F.lower("text").alias("t"), F.lower("source").alias("o"))
    counts = [F.count_if(c).alias(f"{n}_{k}") for k, v in enumerate(_TERMS) for n, c in (("in_text", F.contains("t", F.lit(v))), ("in_source", F.contains("o", F.lit(v))), ("in_any", F.contains("t", F.lit(v)) | F.contains("o", F.lit(v))))]
    rows = F.array(*(F.struct(F.lit(v).alias("term"), *(F.col(f"{n}_{k}").alias(n) for n in ("in_text", "in_source", "in_any"))) for k, v in enumerate(_TERMS)))
    return x.agg(*counts).select(F.explode(rows).alias("r")).select("r.*")


@query("a45_class_floor", f"WITH {LAB} SELECT cvd_subtype, count(*) AS n, count(*) // 5 >= 25 AS enough FROM lab GROUP BY 1")
def a45(s, d):
    return lab(s, d).groupBy("cvd_subtype").agg(F.count("*").alias("n")).withColumn("enough", F.floor(F.col("n") / 5) >= 25)


@query("a46_dominance", f"WITH {LAB}, g AS (SELECT disease_category AS g, count(*) AS n, count(DISTINCT upper(trim(series_id))) AS n_series FROM lab GROUP BY 1) SELECT g, n, n_series, n >= 100 AND n / n_series >= 4 AS dominated, n < 25 AS undersized FROM g")
def a46(s, d):
    g = lab(s, d).groupBy(F.col("disease_category").alias("g")).agg(F.count("*").alias("n"), F.countDistinct(F.upper(F.trim("series_id"))).alias("n_series"))
    return g.withColumn("dominated", (F.col("n") >= 100) & (F.col("n") / F.col("n_series") >= 4)).withColumn("undersized", F.col("n") < 25)


@query("a47_histogram", f"WITH {DE} SELECT least(floor(mean_abs_z::DOUBLE / 0.05), 79)::INTEGER AS bin, count(*) AS n FROM de WHERE mean_abs_z BETWEEN 0 AND 4 GROUP BY 1")
def a47(s, d):
    return op.histogram(de(s, d).select(F.col("mean_abs_z").cast("double").alias("v")), "v", 0.0, 4.0, 80)


@query("a48_before_after", "WITH f AS (SELECT run_id, fold, max(roc_auc) AS a, max(pr_auc) AS b FROM fold_result WHERE fold IN (0, 1) GROUP BY 1, 2) SELECT x.run_id, round(y.a - x.a, 8) AS delta_roc, round(y.b - x.b, 8) AS delta_pr FROM f x JOIN f y ON x.run_id = y.run_id AND x.fold = 0 AND y.fold = 1")
def a48(s, d):
    f = table(s, d, "fold_result").where("fold in (0, 1)").groupBy("run_id", "fold").agg(F.max("roc_auc").alias("a"), F.max("pr_auc").alias("b"))
    x, y = f.where("fold = 0"), f.where("fold = 1").select("run_id", F.col("a").alias("a2"), F.col("b").alias("b2"))
    return x.join(y, "run_id").select("run_id", F.round(F.col("a2") - F.col("a"), 8).alias("delta_roc"), F.round(F.col("b2") - F.col("b"), 8).alias("delta_pr"))


@query("a49_flat_entities", "SELECT plan_row, unnest(map_keys(entities)) AS name, unnest(map_values(entities)) AS value FROM generation_plan")
def a49(s, d):
    return table(s, d, "generation_plan").select("plan_row", F.explode("entities").alias("name", "value"))


@query("a50_loss_summary", "WITH r AS (SELECT run_id, fold, max(fit_seconds) AS v FROM fold_result GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY fold) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM r) SELECT run_id, max(n) AS n_steps, arg_min(v, fold) AS first, arg_max(v, fold) AS last, min(v) AS least, round(avg(CASE WHEN i > n - greatest(1, n // 2) THEN v END), 8) AS final_mean FROM x GROUP BY 1")
def a50(s, d):
    from pyspark.sql import Window

    r = table(s, d, "fold_result").groupBy("run_id", "fold").agg(F.max("fit_seconds").alias("v"))
    x = ranked(r, F.asc("fold"), by=["run_id"], out="i").withColumn("n", F.count("*").over(Window.partitionBy("run_id")))
    late = F.when(F.col("i") > F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") / 2)), F.col("v"))
    return x.groupBy("run_id").agg(F.max("n").alias("n_steps"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("fold"))).alias("first"), F.max_by("v", F.when(F.col("v").isNotNull(), F.col("fold"))).alias("last"), F.min("v").alias("least"), F.round(F.avg(late), 8).alias("final_mean"))


@query("a51_release_guard", f"WITH {DE}, {LAB}, m AS (SELECT count(*) AS n FROM de WHERE sample_index NOT IN (SELECT sample_index FROM lab)) SELECT (SELECT count(*) FROM de) AS n_left, (SELECT count(*) FROM lab) AS n_right, m.n AS n_missing, m.n <= 0.001 * (SELECT count(*) FROM de) AS passes FROM m")
def a51(s, d):
    x, y = de(s, d, "status").select("sample_index"), lab(s, d).select("sample_index")
    m = x.join(y, "sample_index", "left_anti").agg(F.count("*").alias("n_missing"))
    return x.agg(F.count("*").alias("n_left")).crossJoin(y.agg(F.count("*").alias("n_right"))).crossJoin(m).withColumn("passes", F.col("n_missing") <= F.lit(0.001) * F.col("n_left"))


@query("a52_class_by_holdout", f"WITH {DE}, {LAB} SELECT in_holdout, is_cvd_disease, count(*) AS n FROM de JOIN lab USING (sample_index) GROUP BY 1, 2")
def a52(s, d):
    return de(s, d, "in_holdout").join(lab(s, d), "sample_index").groupBy("in_holdout", "is_cvd_disease").agg(F.count("*").alias("n"))


_M = ["mean_abs_z", "max_abs_z", "n_genes_compared"]


@query("a53_metric_table", f"WITH {DE}, m AS (SELECT 'mean_abs_z' AS metric, mean_abs_z::DOUBLE AS v FROM de UNION ALL SELECT 'max_abs_z', max_abs_z FROM de UNION ALL SELECT 'n_genes_compared', n_genes_compared FROM de) SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, .05), 6) AS p05, round(quantile_cont(v, .95), 6) AS p95 FROM m GROUP BY 1")
def a53(s, d):
    return op.melt_distribution(de(s, d), _M)


@query("a54_sanity", "SELECT gene, count(*) AS n, count_if(pearson_r IS NULL) AS n_null, coalesce(count_if(isnan(pearson_r)), 0) AS n_nan, coalesce(count_if(isinf(pearson_r)), 0) AS n_inf, coalesce(count_if(pearson_r < 0), 0) AS n_negative, coalesce(min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*), false) AS is_permutation FROM coexpression_edges GROUP BY 1")
def a54(s, d):
    """The ranks as they are stored, which are stale, repeated or null for many genes."""
    return op.sanity(table(s, d, "coexpression_edges"), "pearson_r", "rank", ["gene"])


@query("a55_spot_check", f"WITH {EMB}, v AS (SELECT gene, var_samp(v) AS var FROM emb GROUP BY 1), r AS (SELECT gene, round(var, 8) AS variance, row_number() OVER (ORDER BY var DESC, gene)::INTEGER AS rank FROM v), w AS (SELECT unnest([3, 17, 63, 99])::INTEGER AS gene) SELECT w.gene, r.gene IS NOT NULL AS present, variance, rank FROM w LEFT JOIN r USING (gene)")
def a55(s, d):
    v = ranked(emb(s, d).groupBy("gene").agg(F.var_samp("v").alias("var")), F.desc("var"), F.asc("gene")).select("gene", F.round("var", 8).alias("variance"), "rank", F.lit(True).alias("present"))
    w = s.createDataFrame([(3,), (17,), (63,), (99,)], "gene int")
    return w.join(v, "gene", "left").withColumn("present", F.coalesce("present", F.lit(False)))


@query("a56_artifact_coverage", f"WITH {DE}, {LAB} SELECT is_cvd_disease, count(*) AS n, count_if(sample_index IN (SELECT sample_index FROM de WHERE status = 'ok')) AS n_covered FROM lab GROUP BY 1")
def a56(s, d):
    ok = de(s, d).where("status = 'ok'").select("sample_index", F.lit(True).alias("ok"))
    return lab(s, d).join(ok, "sample_index", "left").groupBy("is_cvd_disease").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_covered"))


