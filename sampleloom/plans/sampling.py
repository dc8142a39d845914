"""Queries of sorting, sampling and allocation (T) and of grouped folds (M01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.operators import sampling as op
from sampleloom.plans.common import EXPR, LAB, expr, lab
from sampleloom.registry import query
from sampleloom.session import table

_LAB_Y = f"{LAB}, x AS (SELECT sample_index, is_cvd_disease::INTEGER AS y, disease_category AS c, upper(trim(series_id)) AS series FROM lab)"


def lab_y(s, d):
    return lab(s, d).select("sample_index", F.col("is_cvd_disease").cast("int").alias("y"), F.col("disease_category").alias("c"), F.upper(F.trim("series_id")).alias("series"))


@query("t01_sorted", "SELECT series, n, n_pos, row_number() OVER (ORDER BY n DESC, n_pos DESC, series)::INTEGER AS place FROM (SELECT upper(trim(series_id)) AS series, count(*) AS n, count_if(is_cvd_disease) AS n_pos FROM sample_labels GROUP BY 1)")
def t01(s, d):
    from sampleloom.operators.windows import ranked

    g = table(s, d, "sample_labels").groupBy(F.upper(F.trim("series_id")).alias("series")).agg(F.count("*").alias("n"), F.count_if("is_cvd_disease").alias("n_pos"))
    return ranked(g, F.desc("n"), F.desc("n_pos"), F.asc_nulls_last("series"), out="place")


@query("t02_head", "SELECT partner, count(*) AS n FROM coexpression_edges GROUP BY 1 ORDER BY n DESC, partner LIMIT 15")
def t02(s, d):
    return table(s, d, "coexpression_edges").groupBy("partner").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "partner").limit(15)


@query("t03_uniform", f"WITH {LAB} SELECT sample_index FROM lab ORDER BY md5('u|' || sample_index), sample_index LIMIT 200")
def t03(s, d):
    return op.uniform(lab(s, d).select("sample_index"), "sample_index", 200, "u")


@query("t04_negatives", f"WITH {_LAB_Y}, n AS (SELECT sample_index, row_number() OVER (ORDER BY md5('n|' || sample_index), sample_index) AS k FROM x WHERE y = 0) SELECT sample_index FROM x WHERE y = 1 UNION ALL SELECT sample_index FROM n WHERE k <= floor((SELECT sum(y) FROM x) * 0.5)")
def t04(s, d):
    return op.negatives(lab_y(s, d), "y", "sample_index", 0.5, "n").select("sample_index")


@query("t05_pools", f"WITH {LAB}, p AS (SELECT sample_index, 'positive' AS pool, 0 AS k FROM lab WHERE is_cvd_disease UNION ALL SELECT sample_index, 'hard', 1 FROM lab WHERE is_cvd_tissue UNION ALL SELECT sample_index, 'rest', 2 FROM lab) SELECT sample_index, arg_min(pool, k) AS pool FROM p GROUP BY 1")
def t05(s, d):
    x = lab(s, d)
    return op.pools("sample_index", positive=x.where("is_cvd_disease"), hard=x.where("is_cvd_tissue"), rest=x)


@query("t06_per_class", f"WITH {_LAB_Y} SELECT sample_index, c FROM x QUALIFY row_number() OVER (PARTITION BY c ORDER BY md5('c|' || sample_index), sample_index) <= 40")
def t06(s, d):
    return op.per_class(lab_y(s, d), "c", "sample_index", 40, "c").select("sample_index", "c")


@query("t07_nested", f"WITH {LAB}, a AS (SELECT sample_index FROM lab ORDER BY md5('u|' || sample_index), sample_index LIMIT 200) SELECT sample_index FROM a ORDER BY md5('v|' || sample_index), sample_index LIMIT 50")
def t07(s, d):
    return op.uniform(t03(s, d), "sample_index", 50, "v")


@query("t08_weighted", "SELECT doc_id FROM documents WHERE n_tokens > 0 ORDER BY -ln((('0x' || substr(md5('w|' || doc_id), 1, 13))::BIGINT + 1) / 16::DOUBLE ** 13) / n_tokens, doc_id LIMIT 100")
def t08(s, d):
    return op.weighted(table(s, d, "documents"), "doc_id", "n_tokens", 100, "w").select("doc_id")


@query(
    "t09_even_allocation",
    """WITH c AS (SELECT disease_category, count(*) AS n FROM sample_labels WHERE disease_category IS NOT NULL GROUP BY 1), l AS (SELECT max(x) AS level FROM (SELECT x, sum(least(n, x)) AS s FROM c, (SELECT unnest(range(2501)) AS x) GROUP BY 1) WHERE s <= 2500),
    k AS (SELECT *, least(n, level) AS base, row_number() OVER (PARTITION BY n > level ORDER BY n DESC, disease_category DESC) AS i FROM c, l)
    SELECT disease_category, n, (base + CASE WHEN n > level AND i <= 2500 - (SELECT sum(base) FROM k) THEN 1 ELSE 0 END)::BIGINT AS seats, greatest(2500 - (SELECT sum(n) FROM c), 0)::BIGINT AS unmet FROM k""",
)
def t09(s, d):
    c = table(s, d, "sample_labels").where("disease_category is not null").groupBy("disease_category").agg(F.count("*").alias("n"))
    return op.even_allocation(c, "disease_category", "n", 2500)


@query("t10_share_cap", f"WITH {_LAB_Y} SELECT sample_index, c FROM x QUALIFY row_number() OVER (PARTITION BY c ORDER BY md5('s|' || sample_index), sample_index) <= floor((SELECT count(*) FROM x) * 12 / 100)")
def t10(s, d):
    return op.share_cap(lab_y(s, d), "c", "sample_index", 12.0, "s").select("sample_index", "c")


@query("t11_matched", f"""WITH {LAB}, x AS (SELECT sample_index, is_cvd_tissue::INTEGER AS y, disease_category AS c FROM lab), n AS (SELECT c, least(count_if(y = 1), count_if(y = 0) // 2) AS p FROM x GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY c, y ORDER BY md5('m|' || sample_index), sample_index) AS k FROM x)
SELECT sample_index, y, c FROM r JOIN n USING (c) WHERE k <= CASE WHEN y = 1 THEN p ELSE 2 * p END""")
def t11(s, d):
    x = lab(s, d).select("sample_index", F.col("is_cvd_tissue").cast("int").alias("y"), F.col("disease_category").alias("c"))
    return op.matched_classes(x, "c", "y", "sample_index", 2, "m")


@query("t12_exact_thresholds", f"""WITH {EXPR}, e AS (SELECT sample_index, n / 7.0::DOUBLE AS v FROM expr), r AS (SELECT sample_index, v, row_number() OVER (PARTITION BY sample_index ORDER BY v DESC)::INTEGER AS m, lead(v) OVER (PARTITION BY sample_index ORDER BY v DESC) AS nx FROM e), t AS (SELECT *, round((v + nx) / 2, 2) AS threshold FROM r)
SELECT sample_index, m, threshold FROM t WHERE m BETWEEN 5 AND 30 AND v > threshold AND nx <= threshold""")
def t12(s, d):
    return op.exact_thresholds(expr(s, d).select("sample_index", (F.col("n") / F.lit(7.0)).alias("v")), "sample_index", "v")


@query("t13_target_thresholds", f"WITH {EXPR}, r AS (SELECT sample_index, n, row_number() OVER (PARTITION BY sample_index ORDER BY n DESC) AS k FROM expr) SELECT DISTINCT sample_index, n AS threshold FROM r WHERE k IN (5, 10, 20)")
def t13(s, d):
    from sampleloom.operators.windows import ranked

    return ranked(expr(s, d), F.desc("n"), by=["sample_index"], out="k").where("k <= 20").where(F.col("k").isin(5, 10, 20)).select("sample_index", F.col("n").alias("threshold")).distinct()


@query("t14_shuffle", "SELECT plan_row, row_number() OVER (PARTITION BY batch_id ORDER BY md5('sh|' || plan_row))::INTEGER AS place FROM generation_plan")
def t14(s, d):
    from sampleloom.operators.windows import ranked

    return ranked(table(s, d, "generation_plan"), op.draw_key("sh", "plan_row"), by=["batch_id"], out="place").select("plan_row", "place")


@query("t15_longest_match", "SELECT doc_id, CASE WHEN contains(lower(text), 'heart failure with') THEN 'heart failure with' WHEN contains(lower(text), 'heart failure') THEN 'heart failure' WHEN contains(lower(text), 'heart') THEN 'heart' END AS match FROM documents")
def t15(s, d):
    return op.longest_match("text", table(s, d, "documents"), ["heart", "heart failure", "heart failure with"]).select("doc_id", "match")


@query(
    "t16_pairs",
    """WITH n AS (SELECT DISTINCT batch_id, tissue_coarse AS t FROM plan_target WHERE batch_id IS NOT NULL AND tissue_coarse IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY t) AS i FROM n), g AS (SELECT batch_id, (count(*) * (count(*) - 1)) // 2 AS m FROM n GROUP BY 1),
    q AS (SELECT batch_id, m, ('0x' || substr(md5('pair|' || batch_id), 1, 15))::BIGINT % m AS s, CASE WHEN m % 7919 <> 0 THEN 7919 ELSE 104729 END AS st FROM g WHERE m > 0), k AS (SELECT batch_id, (s + j * st) % m AS p FROM q, (SELECT unnest(range(4)) AS j) WHERE j < m),
    a AS (SELECT x.batch_id, x.t AS a, y.t AS b, row_number() OVER (PARTITION BY x.batch_id ORDER BY x.i, y.i) - 1 AS p FROM r x JOIN r y ON x.batch_id = y.batch_id AND x.i < y.i) SELECT batch_id, a, b FROM a JOIN k USING (batch_id, p)""",
)
def t16(s, d):
    return op.unordered_pairs(table(s, d, "plan_target"), "batch_id", "tissue_coarse", 4, "pair")


@query("t17_one_per_key", "WITH f AS (SELECT patient, plan_row, md5('k|' || plan_row) AS h FROM generation_plan WHERE patient IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient ORDER BY h) = 1) SELECT patient, plan_row FROM f ORDER BY h LIMIT 80")
def t17(s, d):
    x = table(s, d, "generation_plan").where("patient is not null").select("patient", "plan_row", op.draw_key("k", "plan_row").alias("h"))
    return x.groupBy("patient").agg(F.min_by("plan_row", "h").alias("plan_row"), F.min("h").alias("h")).orderBy("h").limit(80).drop("h")


@query("m01_grouped_folds", f"WITH {_LAB_Y}, g AS (SELECT series, count(*) AS n FROM x WHERE series IS NOT NULL GROUP BY 1), k AS (SELECT *, (row_number() OVER (ORDER BY n DESC, md5('fold|' || series)) - 1) % 10 AS k FROM g) SELECT series, n, CASE WHEN k < 5 THEN k ELSE 9 - k END::INTEGER AS fold FROM k")
def m01(s, d):
    return op.snake_folds(lab_y(s, d).where("series is not null"), "series", 5, "fold")


