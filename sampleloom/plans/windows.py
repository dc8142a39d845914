"""Queries of the rankings and analytic operators (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.operators import windows as op
from sampleloom.plans.common import DE, EMB, EXPR, SCORED, LAB, de, emb, expr, scored
from sampleloom.registry import query
from sampleloom.session import table

_VAR = f"{EMB}, v AS (SELECT gene, var_samp(v) AS var FROM emb GROUP BY 1)"


def _var(s, d):
    return emb(s, d).groupBy("gene").agg(F.var_samp("v").alias("var"))


@query("w01_rank", f"WITH {_VAR} SELECT gene, row_number() OVER (ORDER BY var DESC, gene)::INTEGER AS rank FROM v")
def w01(s, d):
    return op.ranked(_var(s, d), F.desc("var"), F.asc("gene")).select("gene", "rank")


@query("w02_top_share", f"WITH {_VAR}, r AS (SELECT gene, row_number() OVER (ORDER BY var DESC, gene)::INTEGER AS rank FROM v) SELECT gene, rank, rank <= ceil((SELECT count(*) FROM r) * 15 / 100) AS selected FROM r")
def w02(s, d):
    return op.top_share(w01(s, d), "rank", 15.0)


@query("w03_centrality", "WITH c AS (SELECT partner, count(DISTINCT gene) AS k FROM coexpression_edges WHERE partner IS NOT NULL GROUP BY 1) SELECT partner, k, row_number() OVER (ORDER BY k DESC, partner)::INTEGER AS rank FROM c QUALIFY rank <= (SELECT count(DISTINCT cvd_subtype) FROM sample_labels)")
def w03(s, d):
    c = table(s, d, "coexpression_edges").where("partner is not null").groupBy("partner").agg(F.countDistinct("gene").alias("k"))
    n = table(s, d, "sample_labels").agg(F.countDistinct("cvd_subtype").alias("n"))
    return op.ranked(c, F.desc("k"), F.asc("partner")).crossJoin(F.broadcast(n)).where("rank <= n").drop("n")


@query("w04_extremes", f"""WITH {EXPR}, r AS (SELECT sample_index, gene, n, row_number() OVER (PARTITION BY sample_index ORDER BY n DESC, gene)::INTEGER AS rank FROM expr),
t AS (SELECT sample_index, max(CASE WHEN rank = 5 THEN n END) = max(CASE WHEN rank = 6 THEN n END) AS tie FROM r GROUP BY 1) SELECT sample_index, gene, n, rank, coalesce(tie, false) AS boundary_tie FROM r JOIN t USING (sample_index) WHERE rank <= 5""")
def w04(s, d):
    return op.extremes(expr(s, d), ["sample_index"], "n", "gene", 5)


@query("w05_ordered_hits", f"WITH {EXPR} SELECT sample_index, string_agg(gene::VARCHAR, ',' ORDER BY n DESC, gene) AS genes FROM expr WHERE n > 90 GROUP BY 1")
def w05(s, d):
    g = expr(s, d).where("n > 90").groupBy("sample_index").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "gene"))).alias("l"))
    return g.select("sample_index", F.array_join(F.transform("l", lambda x: x["gene"].cast("string")), ",").alias("genes"))


@query("w06_top_lists", f"""WITH {EMB}, u AS (SELECT sample_index, gene, row_number() OVER (PARTITION BY sample_index ORDER BY v DESC, gene) AS r FROM emb WHERE v > 0 AND abs(v) >= 0.15), w AS (SELECT sample_index, gene, row_number() OVER (PARTITION BY sample_index ORDER BY v, gene) AS r FROM emb WHERE v < 0 AND abs(v) >= 0.15),
a AS (SELECT sample_index, string_agg(gene::VARCHAR, ',' ORDER BY r) AS top_up FROM u WHERE r <= 4 GROUP BY 1), b AS (SELECT sample_index, string_agg(gene::VARCHAR, ',' ORDER BY r) AS top_down FROM w WHERE r <= 4 GROUP BY 1) SELECT sample_index, top_up, top_down FROM a FULL JOIN b USING (sample_index)""")
def w06(s, d):
    return op.top_lists(emb(s, d), "sample_index", "gene", "v", 4, F.abs("v") >= 0.15)


@query("w07_drivers", f"WITH {DE}, g AS (SELECT sample_index, unnest(top_up_genes) AS gene, unnest(top_up_z)::DOUBLE AS z FROM de UNION ALL SELECT sample_index, unnest(top_down_genes), unnest(top_down_z) FROM de) SELECT sample_index, gene, row_number() OVER (PARTITION BY sample_index ORDER BY abs(z) DESC, gene)::INTEGER AS rank FROM g WHERE NOT isnan(z) QUALIFY rank <= 3")
def w07(s, d):
    x = de(s, d)
    side = lambda g, z: x.select("sample_index", F.explode(F.arrays_zip(F.col(g).alias("g"), F.col(z).alias("z"))).alias("p"))
    both = side("top_up_genes", "top_up_z").unionByName(side("top_down_genes", "top_down_z")).select("sample_index", F.col("p.g").alias("gene"), F.col("p.z").cast("double").alias("z")).where("z is not null and not isnan(z)")
    return op.ranked(both, F.desc(F.abs("z")), F.asc("gene"), by=["sample_index"]).where("rank <= 3").select("sample_index", "gene", "rank")


_BEST = "SELECT gene, partner, row_number() OVER (PARTITION BY gene ORDER BY r DESC, partner)::INTEGER AS rank FROM (SELECT gene, partner, max(pearson_r) AS r FROM coexpression_edges WHERE gene IS NOT NULL AND partner IS NOT NULL AND pearson_r BETWEEN -1 AND 1 GROUP BY 1, 2) QUALIFY rank <= "


@query("w08_top_partners", f"{_BEST}100")
def w08(s, d):
    e = table(s, d, "coexpression_edges").where("gene is not null and partner is not null and pearson_r between -1 and 1").groupBy("gene", "partner").agg(F.max("pearson_r").alias("r"))
    return op.ranked(e, F.desc("r"), F.asc("partner"), by=["gene"]).where("rank <= 100").select("gene", "partner", "rank")


@query("w09_top_in_degree", f"WITH b AS ({_BEST}10) SELECT partner, count(*) AS in_degree FROM b GROUP BY 1")
def w09(s, d):
    return w08(s, d).where("rank <= 10").groupBy("partner").agg(F.count("*").alias("in_degree"))


@query("w10_cumcount", "SELECT line_no, row_number() OVER (PARTITION BY id ORDER BY line_no) - 1 AS k FROM generation_results")
def w10(s, d):
    return op.ranked(table(s, d, "generation_results"), F.asc("line_no"), by=["id"]).select("line_no", (F.col("rank") - 1).cast("long").alias("k"))


@query("w11_best_per_key", "SELECT id, status, line_no FROM generation_results QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE status WHEN 'ok' THEN 0 ELSE 1 END, line_no DESC) = 1")
def w11(s, d):
    from sampleloom.operators.joins import first_best

    return first_best(table(s, d, "generation_results").select("id", "status", "line_no"), "id", F.when(F.col("status") == "ok", 0).otherwise(1), F.desc("line_no"))


_AVG = f"WITH {DE}, {LAB}, {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM scored), a AS (SELECT *, (min(r) OVER (PARTITION BY series_id, score) + max(r) OVER (PARTITION BY series_id, score)) / 2 AS a FROM r)"


@query("w12_centred_rank", f"{_AVG} SELECT sample_index, round(CASE WHEN n > 1 THEN (a - 1) / (n - 1) - 0.5 ELSE 0 END, 8)::DOUBLE AS centred FROM a")
def w12(s, d):
    return op.centred_rank(scored(s, d), "score", ["series_id"]).select("sample_index", F.round("centred", 8).alias("centred"))


@query("w13_zscore", f"WITH {DE}, {LAB}, {SCORED}, g AS (SELECT series_id, avg(score) AS m, stddev_pop(score) AS sd, count(*) AS n FROM scored GROUP BY 1) SELECT sample_index, round(CASE WHEN n < 2 OR sd <= 1e-12 * greatest(1, abs(m)) THEN 0 ELSE (score - m) / sd END, 6)::DOUBLE AS z FROM scored JOIN g USING (series_id)")
def w13(s, d):
    return op.zscore(scored(s, d), "score", ["series_id"]).select("sample_index", F.round("z", 6).alias("z"))


@query("w14_cumulative_share", "WITH c AS (SELECT disease_category AS g, count(*) AS n FROM sample_labels GROUP BY 1) SELECT g, n, round(sum(n) OVER (ORDER BY n DESC, g ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 8) AS cum FROM c")
def w14(s, d):
    from pyspark.sql import Window

    c = table(s, d, "sample_labels").groupBy(F.col("disease_category").alias("g")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "g").rowsBetween(Window.unboundedPreceding, 0)  # a row per category
    return c.select("g", "n", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 8).alias("cum"))


@query("w15_tertiles", f"WITH {DE}, c AS (SELECT quantile_cont(mean_abs_z::DOUBLE, [1/3, 2/3]) AS q FROM de WHERE mean_abs_z IS NOT NULL) SELECT sample_index, CASE WHEN mean_abs_z IS NULL THEN 'unknown' WHEN mean_abs_z::DOUBLE <= q[1] THEN 'minimal' WHEN mean_abs_z::DOUBLE <= q[2] THEN 'moderate' ELSE 'large' END AS bucket FROM de, c")
def w15(s, d):
    return op.tertiles(de(s, d, "mean_abs_z").select("sample_index", F.col("mean_abs_z").cast("double").alias("v")), "v").select("sample_index", "bucket")


@query("w16_quantile_normalised", f"WITH {EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_index ORDER BY v, gene) AS i FROM emb), f AS (SELECT i, avg(v) AS ref FROM r GROUP BY 1) SELECT sample_index, gene, round(avg(ref) OVER (PARTITION BY sample_index, v), 8) AS normalised FROM r JOIN f USING (i)")
def w16(s, d):
    return op.quantile_normalised(emb(s, d), "sample_index", "gene", "v").select("sample_index", "gene", F.round("normalised", 8).alias("normalised"))


@query("w17_fold_features", f"WITH {EMB}, f AS (SELECT *, (sample_index // 25) % 5 AS fold FROM emb), v AS (SELECT k.fold, gene, var_pop(v) AS var FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY 1, 2) SELECT fold::INTEGER AS fold, gene FROM v QUALIFY row_number() OVER (PARTITION BY fold ORDER BY var DESC, gene) <= 10")
def w17(s, d):
    x = emb(s, d).withColumn("own", F.pmod(F.floor(F.col("sample_index") / 25), F.lit(5)).cast("int"))
    x = x.withColumn("fold", F.explode(F.array_except(F.array(*map(F.lit, range(5))), F.array("own"))))  # a row trains the other folds
    v = x.groupBy("fold", "gene").agg(F.var_pop("v").alias("var"))
    return op.ranked(v, F.desc("var"), F.asc("gene"), by=["fold"]).where("rank <= 10").select("fold", "gene")


@query("w18_round_robin", """WITH r AS (SELECT doc_id, lower(trim(source)) AS source, md5('rr|' || doc_id) AS h FROM documents WHERE source IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS k FROM r) SELECT doc_id, source FROM k ORDER BY k, md5('rr|' || source), h LIMIT 60""")
def w18(s, d):
    x = table(s, d, "documents").where("source is not null").select("doc_id", F.lower(F.trim("source")).alias("source"))
    return op.round_robin(x, "source", "doc_id", 60, "rr")


@query("w19_capped", "SELECT doc_id, lower(trim(source)) AS src FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY md5('cap|' || doc_id)) <= 7")
def w19(s, d):
    return op.capped(table(s, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("src")), ["src"], "doc_id", 7, "cap")


@query("w20_template_lock", "SELECT plan_row, ((row_number() OVER (PARTITION BY batch_id ORDER BY plan_row) - 1) % 4)::INTEGER AS template FROM generation_plan")
def w20(s, d):
    return op.ranked(table(s, d, "generation_plan"), F.asc("plan_row"), by=["batch_id"]).select("plan_row", F.pmod(F.col("rank") - 1, F.lit(4)).alias("template"))


@query("w21_length_batches", """WITH r AS (SELECT doc_id, length(text) AS l, row_number() OVER (ORDER BY md5('len|' || doc_id)) AS r FROM documents), m AS (SELECT doc_id, l, ((r - 1) // 32)::INTEGER AS megabatch FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY megabatch ORDER BY l DESC, doc_id)::INTEGER AS place FROM m)
SELECT doc_id, megabatch, place, ((place - 1) % 4)::INTEGER AS worker FROM p""")
def w21(s, d):
    return op.length_batches(table(s, d, "documents").select("doc_id", F.length("text").alias("l")), "doc_id", "l", 8, 4, "len").select("doc_id", "megabatch", "place", "worker")


@query("w22_chunks", "SELECT line_no, ((row_number() OVER (ORDER BY line_no) - 1) // ceil((SELECT count(*) FROM generation_results) / 7)::BIGINT)::INTEGER AS chunk FROM generation_results")
def w22(s, d):
    return op.chunks(table(s, d, "generation_results").select("line_no"), "line_no", 7)


@query("w23_roc_points", f"WITH {DE}, {LAB}, {SCORED}, v AS (SELECT score, sum(y)::BIGINT AS p, count(*) - sum(y)::BIGINT AS n FROM scored GROUP BY 1) SELECT score, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 8) AS fpr, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 8) AS tpr FROM v")
def w23(s, d):
    from sampleloom.operators.order import running

    v = scored(s, d).groupBy("score").agg(F.sum("y").alias("p"), (F.count("*") - F.sum("y")).alias("n"))
    all_ = v.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    upto = running(v, [F.desc("score")], {"fp": F.col("n"), "tp": F.col("p")}).crossJoin(F.broadcast(all_))  # one row
    return upto.select("score", F.round(F.col("fp") / F.col("all_n"), 8).alias("fpr"), F.round(F.col("tp") / F.col("all_p"), 8).alias("tpr"))


@query("w24_calibration", f"WITH {DE}, {LAB}, {SCORED}, e AS (SELECT quantile_cont(score, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS e FROM scored) SELECT len(list_filter(e, lambda x: score > x))::INTEGER AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS share_positive FROM scored, e GROUP BY 1")
def w24(s, d):
    from sampleloom.stats.auc import calibration

    return calibration(scored(s, d), "y", "score")


@query("w25_top_of_vector", f"WITH {EMB} SELECT sample_index, string_agg(gene::VARCHAR, ',' ORDER BY v DESC, gene) AS places FROM (SELECT * FROM emb QUALIFY row_number() OVER (PARTITION BY sample_index ORDER BY v DESC, gene) <= 5) GROUP BY 1")
def w25(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("sample_index"), F.array_join(F.transform(op.top_of_array(F.col("embedding"), 5), lambda x: x["place"].cast("string")), ",").alias("places"))
