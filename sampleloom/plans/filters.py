"""Queries of the filters (F) and scalar counts over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.functions.text import simple_words
from sampleloom.operators import filters as op
from sampleloom.plans.common import DE, EMB, EXPR, LAB, de, emb, expr, lab
from sampleloom.registry import query
from sampleloom.session import table


@query("f01_bulk_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.05")
def f01(s, d):
    return op.keep_at_most(table(s, d, "lineitem"), "l_discount", 0.05).select("l_orderkey", "l_linenumber")


@query("f01_bulk_stats", "SELECT count(*) AS total, count_if(l_discount <= 0.05) AS kept, count(*) - count_if(l_discount <= 0.05) AS excluded, round(count_if(l_discount <= 0.05) * 100.0 / count(*), 4)::DOUBLE AS pct_kept FROM lineitem")
def f01s(s, d):
    return op.keep_stats(table(s, d, "lineitem"), F.col("l_discount") <= 0.05).withColumn("pct_kept", F.col("pct_kept").cast("double"))


@query("f02_strict_bulk", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.05")
def f02(s, d):
    return op.keep_at_most(table(s, d, "lineitem"), "l_discount", 0.05, inclusive=False).select("l_orderkey", "l_linenumber")


@query("f03_pool", f"WITH {LAB} SELECT sample_index, geo_accession FROM lab WHERE is_cvd_pool")
def f03(s, d):
    return lab(s, d).where("is_cvd_pool").select("sample_index", "geo_accession")


@query("f04_pool_without_excluded", f"WITH {LAB}, {DE} SELECT sample_index FROM lab WHERE is_cvd_pool AND sample_index IN (SELECT sample_index FROM de WHERE frac_genes_abs_z_gt2 <= 0.05)")
def f04(s, d):
    kept = op.keep_at_most(de(s, d), "frac_genes_abs_z_gt2", 0.05)
    return lab(s, d).where("is_cvd_pool").select("sample_index").join(kept, "sample_index", "left_semi")


@query("f05_library_size", f"WITH {EXPR} SELECT sample_index, sum(n)::BIGINT AS total FROM expr GROUP BY 1 HAVING sum(n) >= 15000")
def f05(s, d):
    return op.having_total(expr(s, d), "sample_index", "n", 15000)


@query("f06_detected_genes", f"WITH {EXPR} SELECT gene, count_if(n > 20) AS hits FROM expr GROUP BY 1 HAVING count_if(n > 20) >= 0.1 * (SELECT count(DISTINCT sample_index) FROM expr)")
def f06(s, d):
    return op.detected_in(expr(s, d), "gene", "sample_index", "n", 20, 0.1)


@query("f07_probe_flags", f"WITH {LAB} SELECT sample_index, cvd_subtype NOT IN ('', 'other') AS is_positive, NOT is_cvd_pool AS is_neg_whole_corpus, NOT is_cvd_disease AND is_cvd_tissue AS is_neg_hard FROM lab")
def f07(s, d):
    return lab(s, d).select("sample_index", (~F.col("cvd_subtype").isin("", "other")).alias("is_positive"), (~F.col("is_cvd_pool")).alias("is_neg_whole_corpus"), (~F.col("is_cvd_disease") & F.col("is_cvd_tissue")).alias("is_neg_hard"))


@query("f08_unannotated", "SELECT regexp_matches(gene, '^ENSG\\d+$') AS unannotated, count(DISTINCT gene) AS n_genes, count(*) AS n_rows FROM coexpression_edges GROUP BY 1")
def f08(s, d):
    return table(s, d, "coexpression_edges").groupBy(op.unannotated(F.col("gene")).alias("unannotated")).agg(F.countDistinct("gene").alias("n_genes"), F.count("*").alias("n_rows"))


@query("f09_usable_genes", f"WITH {EMB} SELECT gene FROM emb GROUP BY 1 HAVING NOT bool_or(v = -10) AND stddev_pop(v) >= 0.1")
def f09(s, d):
    return op.usable_items(emb(s, d), "gene", "v", -10.0, 0.1)


@query("f10_nameable", "SELECT DISTINCT partner FROM coexpression_edges WHERE upper(trim(coalesce(partner, ''))) NOT IN ('', upper(trim(coalesce(gene, '')))) AND NOT starts_with(upper(trim(partner)), 'ENSG')")
def f10(s, d):
    return table(s, d, "coexpression_edges").where(op.nameable(F.col("partner"), F.col("gene"))).select("partner").distinct()


_SET = ["VPYG1", "NQSL1", "WZNB1", "HZLP1", "NO_SUCH_GENE"]


@query("f11_symbol_set", "SELECT v.symbol, v.symbol IN (SELECT gene FROM coexpression_edges) AS found FROM (VALUES ('VPYG1'), ('NQSL1'), ('WZNB1'), ('HZLP1'), ('NO_SUCH_GENE')) v(symbol)")
def f11(s, d):
    wanted = s.createDataFrame([(x,) for x in _SET], "symbol string")
    there = table(s, d, "coexpression_edges").where(F.col("gene").isin(_SET)).select(F.col("gene").alias("symbol")).distinct().withColumn("f", F.lit(True))
    return wanted.join(there, "symbol", "left").select("symbol", F.coalesce("f", F.lit(False)).alias("found"))


_GENES = "genes AS (SELECT sample_index, unnest(top_up_genes) AS gene, unnest(top_up_z)::DOUBLE AS z, unnest(top_up_lfc)::DOUBLE AS lfc FROM de WHERE status = 'ok')"


def genes(s, d):
    x = de(s, d).where("status = 'ok'").select("sample_index", F.explode(F.arrays_zip("top_up_genes", "top_up_z", "top_up_lfc")).alias("g"))
    return x.select("sample_index", F.col("g.top_up_genes").alias("gene"), F.col("g.top_up_z").cast("double").alias("z"), F.col("g.top_up_lfc").cast("double").alias("lfc"))


@query("f12_gate_attrition", f"""WITH {DE}, {_GENES}, g AS (SELECT abs(lfc) >= 0.5 AS a, NOT starts_with(gene, 'ENSG') AS b, NOT contains(gene, '-AS') AS c FROM genes)
SELECT 'lfc' AS gate, 1 AS place, count_if(a) AS passed, count(*) - count_if(a) AS dropped FROM g UNION ALL SELECT 'nameable', 2, count_if(a AND b), count_if(a) - count_if(a AND b) FROM g UNION ALL SELECT 'sense', 3, count_if(a AND b AND c), count_if(a AND b) - count_if(a AND b AND c) FROM g""")
def f12(s, d):
    return op.attrition(genes(s, d), {"lfc": F.abs("lfc") >= 0.5, "nameable": ~F.startswith("gene", F.lit("ENSG")), "sense": ~F.contains("gene", F.lit("-AS"))})


@query("f13_threshold", f"WITH {DE}, {_GENES} SELECT sample_index, count(*) AS n_hits, string_agg(gene, ',' ORDER BY z DESC, gene) AS hits FROM genes WHERE z > 5 GROUP BY 1")
def f13(s, d):
    hits = genes(s, d).where("z > 5").groupBy("sample_index").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("z"), "gene"))).alias("h"))  # a profile's list is short
    return hits.select("sample_index", "n_hits", F.array_join(F.col("h.gene"), ",").alias("hits"))


@query("f14_stable_signal", f"""WITH {DE}, {_GENES}, b AS (SELECT gene, count(*) AS n, min(z) AS least, avg(z) AS mean FROM genes GROUP BY 1)
SELECT gene, n, round(mean, 6) AS mean, CASE WHEN mean > 0 THEN 'up' ELSE 'down' END AS direction, row_number() OVER (ORDER BY n DESC, gene)::INTEGER AS rank FROM b WHERE least > 0.8 AND gene IN (SELECT gene FROM coexpression_edges)""")
def f14(s, d):
    b = genes(s, d).groupBy("gene").agg(F.count("*").alias("n"), F.min("z").alias("least"), F.avg("z").alias("mean")).where("least > 0.8")
    b = b.join(table(s, d, "coexpression_edges"), "gene", "left_semi")
    from sampleloom.operators.windows import ranked

    return ranked(b, F.desc("n"), F.asc("gene")).select("gene", "n", F.round("mean", 6).alias("mean"), F.when(F.col("mean") > 0, "up").otherwise("down").alias("direction"), "rank")


@query("f15_without_holdout_series", f"WITH {DE} SELECT sample_index FROM de a WHERE NOT EXISTS (SELECT 1 FROM de b WHERE b.in_holdout AND upper(trim(b.series_id)) = upper(trim(a.series_id)))")
def f15(s, d):
    rows = de(s, d).select("sample_index", "in_holdout", F.upper(F.trim("series_id")).alias("series"))
    return rows.join(rows.where("in_holdout").select("series").distinct(), "series", "left_anti").select("sample_index")


@query("f16_pool_union", f"WITH {LAB} SELECT sample_index, cvd_subtype <> '' AS positive FROM lab WHERE cvd_subtype <> '' OR (NOT is_cvd_disease AND is_cvd_tissue)")
def f16(s, d):
    return lab(s, d).where("cvd_subtype <> '' or (not is_cvd_disease and is_cvd_tissue)").select("sample_index", (F.col("cvd_subtype") != "").alias("positive"))


_COND = ["ischemic", "valvular", "heart_failure"]


@query("f17_per_condition", f"""WITH {LAB}, c AS (SELECT unnest(['ischemic', 'valvular', 'heart_failure']) AS "of") SELECT "of", sample_index, (cvd_subtype <> '')::INTEGER AS y FROM lab, c WHERE cvd_subtype = '' OR cvd_subtype = "of" """)
def f17(s, d):
    y = lab(s, d).withColumn("y", (F.col("cvd_subtype") != "").cast("int"))
    return op.per_condition(y, "y", "cvd_subtype", _COND).select("of", "sample_index", "y")


@query("f18_prune_rare", f"WITH {LAB} SELECT sample_index, disease_category FROM lab WHERE disease_category IN (SELECT disease_category FROM lab GROUP BY 1 HAVING count(*) >= 300)")
def f18(s, d):
    return op.prune_rare(lab(s, d), "disease_category", 300).select("sample_index", "disease_category")


@query("f19_pending", "SELECT DISTINCT id FROM generation_results WHERE status <> 'ok' AND id NOT IN (SELECT id FROM generation_results WHERE status = 'ok')")
def f19(s, d):
    g = table(s, d, "generation_results").select("id", "status")
    return g.where("status <> 'ok'").join(g.where("status = 'ok'"), "id", "left_anti").select("id").distinct()


@query("f20_priority_order", "SELECT disease_category, count(*) AS n, CASE disease_category WHEN 'cardiovascular' THEN 1 WHEN 'cancer' THEN 2 WHEN 'infectious' THEN 3 ELSE 4 END::INTEGER AS place FROM sample_labels GROUP BY ALL")
def f20(s, d):
    return op.in_order(table(s, d, "sample_labels").groupBy("disease_category").agg(F.count("*").alias("n")), "disease_category", ["cardiovascular", "cancer", "infectious"])


@query("f21_relabel", "SELECT CASE cvd_subtype WHEN '' THEN 'outside' WHEN 'ischemic' THEN 'coronary' ELSE cvd_subtype END AS subtype, count(*) AS n FROM sample_labels GROUP BY 1")
def f21(s, d):
    return table(s, d, "sample_labels").groupBy(op.relabel(F.col("cvd_subtype"), {"": "outside", "ischemic": "coronary"}).alias("subtype")).agg(F.count("*").alias("n"))


@query("f22_finite_first", f"WITH {DE} SELECT sample_index, array_to_string(list_transform(list_filter(list_zip(top_up_genes, top_up_z), lambda x: x[2] IS NOT NULL AND NOT isnan(x[2]))[1:3], lambda x: x[1]), ',') AS names FROM de WHERE status = 'ok'")
def f22(s, d):
    first = op.finite_first(F.col("top_up_genes"), F.col("top_up_z"), 3)
    return de(s, d).where("status = 'ok'").select("sample_index", F.array_join(F.transform(first, lambda x: x["name"]), ",").alias("names"))


@query("f23_width_route", "SELECT CASE len(embedding) WHEN 64 THEN 'encoded' WHEN 128 THEN 'raw' ELSE 'unknown' END AS kind, count(*) AS n FROM embeddings GROUP BY 1")
def f23(s, d):
    return table(s, d, "embeddings").groupBy(op.by_width(F.col("embedding"), {64: "encoded", 128: "raw"}).alias("kind")).agg(F.count("*").alias("n"))


@query("x08_tissue_words", "SELECT plan_row, trim(regexp_replace(lower(tissue_coarse), '[^a-z0-9]+', ' ', 'g')) AS tissue FROM generation_plan")
def x08(s, d):
    return table(s, d, "generation_plan").select("plan_row", simple_words(F.col("tissue_coarse")).alias("tissue"))
