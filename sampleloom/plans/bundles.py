"""Composites made of other operators: generation plans under capacities, regeneration, matched plans with their gates,
routes of logged results, the confound report (Q02, Q03, Q04, Q08, Q12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.functions import answers as an
from sampleloom.operators import sampling, windows
from sampleloom.operators.order import global_rank
from sampleloom.plans import aggregates, metrics, text  # noqa: F401  (their queries are parts of the report)
from sampleloom.plans.common import DE, LAB, de, lab
from sampleloom.plans.text import polarity_sql
from sampleloom.qa import corpus
from sampleloom.registry import QUERIES, SQL, query
from sampleloom.session import cut, table
from sampleloom.stats import auc

# Q02 ------------------------------------------------------------------------------------------------------------------

#: Items of stage 1, shared by its categories as evenly as their samples allow.
STAGE_1 = 1500
_NEEDS = {"direct_abundance_query": "n_values >= 1", "threshold_query": "n_values >= 3", "ranking_ordering_query": "n_values >= 5", "comparative_query": "n_up >= 1 AND n_down >= 1", "interaction_network_query": "n_up >= 8"}
_REASONS = {"disease_subtype_classification": "cvd_subtype <> ''", "magnitude_reasoning": "n_values >= 1", "comparative_differential_reasoning": "n_up + n_down >= 2", "gene_driver_reasoning": "is_cvd_disease AND n_values >= 1"}
_ABLE = f"""able AS (SELECT l.sample_index, cvd_subtype, is_cvd_disease, coalesce(len(top_up_genes), 0) AS n_up, coalesce(len(top_down_genes), 0) AS n_down, coalesce(len(top_up_genes), 0) + coalesce(len(top_down_genes), 0) AS n_values FROM lab l JOIN de ON de.sample_index = l.sample_index WHERE is_cvd_pool AND status = 'ok')"""
_FIT = "fit AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, {stage} AS stage, sample_index FROM able WHERE {w}" for stage, kinds in ((1, _NEEDS), (2, _REASONS)) for c, w in kinds.items()) + ")"


@query(
    "q02_generation_plan",
    f"""WITH {DE}, {LAB}, {_ABLE}, {_FIT}, c AS (SELECT category, count(*) AS n FROM fit WHERE stage = 1 GROUP BY 1), l AS (SELECT max(x) AS level FROM (SELECT x, sum(least(n, x)) AS s FROM c, (SELECT unnest(range({STAGE_1 + 1})) AS x) GROUP BY 1) WHERE s <= {STAGE_1}),
    k AS (SELECT *, least(n, level) AS base, row_number() OVER (PARTITION BY n > level ORDER BY n DESC, category DESC) AS i FROM c, l), seats AS (SELECT category, base + CASE WHEN n > level AND i <= {STAGE_1} - (SELECT sum(base) FROM k) THEN 1 ELSE 0 END AS seats FROM k),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', 'plan', category, sample_index::VARCHAR)), sample_index) AS k FROM fit)
    SELECT stage::INTEGER AS stage, category, sample_index, (k - 1) % 10 AS template FROM r LEFT JOIN seats USING (category) WHERE stage = 2 OR k <= seats""",
)
def q02(s, d):
    """Stage 1: five categories, their seats allocated under the samples that can answer them. Stage 2: every sample that
    can answer a category once. Templates take turns."""
    x = lab(s, d).where("is_cvd_pool").join(de(s, d, "status", "top_up_genes", "top_down_genes").where("status = 'ok'"), "sample_index")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    x = x.select("sample_index", "cvd_subtype", "is_cvd_disease", size("top_up_genes").alias("n_up"), size("top_down_genes").alias("n_down")).withColumn("n_values", F.col("n_up") + F.col("n_down"))
    kinds = F.array(*(F.when(F.expr(w), F.struct(F.lit(stage).alias("stage"), F.lit(c).alias("category"))) for stage, ks in ((1, _NEEDS), (2, _REASONS)) for c, w in ks.items()))
    fit = x.select("sample_index", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("sample_index", "k.*")
    capacity = fit.where("stage = 1").groupBy("category").agg(F.count("*").alias("n"))
    seats = sampling.even_allocation(capacity, "category", "n", STAGE_1).select("category", "seats")
    r = windows.ranked(fit, sampling.draw_key("plan", "category", "sample_index"), F.asc("sample_index"), by=["category"], out="k")
    r = r.join(F.broadcast(seats), "category", "left").where("stage = 2 or k <= seats")  # a row a category
    return r.select("stage", "category", "sample_index", F.pmod(F.col("k") - 1, F.lit(10)).cast("long").alias("template"))


# Q03 ------------------------------------------------------------------------------------------------------------------

_WAYS, _TOPS = ("up", "down", "both", "abs"), (3, 5, 10)
_REGEN = f"""p AS (SELECT plan_row, batch_id, category, patient, coalesce(template_index, 0) AS template, md5('regen|' || plan_row) AS h FROM generation_plan
  WHERE stage = 2 AND patient IS NOT NULL AND upper(trim(patient)) NOT IN (SELECT upper(trim(geo_accession)) FROM per_sample_de WHERE in_holdout AND geo_accession IS NOT NULL)),
regen AS (SELECT plan_row, category, batch_id, template, ({list(_WAYS)})[template % 4 + 1] AS direction, ({list(_TOPS)})[template % 3 + 1]::INTEGER AS top_n FROM p QUALIFY row_number() OVER (PARTITION BY category, template ORDER BY h, plan_row) <= 40)"""


def _regen(s, d):
    held = table(s, d, "per_sample_de").where("in_holdout and geo_accession is not null").select(F.upper(F.trim("geo_accession")).alias("a")).distinct()
    p = table(s, d, "generation_plan").where("stage = 2 and patient is not null").join(held, F.upper(F.trim("patient")) == F.col("a"), "left_anti").withColumn("template", F.coalesce("template_index", F.lit(0)))
    r = windows.ranked(p, sampling.draw_key("regen", "plan_row"), F.asc("plan_row"), by=["category", "template"], out="k").where("k <= 40")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), F.pmod("template", F.lit(len(xs))).cast("int"))
    return r.select("plan_row", "category", "batch_id", "template", pick(_WAYS).alias("direction"), pick(_TOPS).alias("top_n"))


@query("q03_regen_plan", f"WITH {_REGEN} SELECT * FROM regen")
def q03(s, d):
    """Reasoning items again, without held-out samples: direction and size follow the template, 40 items a template."""
    return _regen(s, d)


@query("q03_regen_coverage", f"WITH {_REGEN}, t AS (SELECT DISTINCT category, coalesce(template_index, 0) AS template FROM generation_plan WHERE stage = 2) SELECT t.category, count(DISTINCT t.template) AS n_templates, count(DISTINCT regen.template) AS n_covered, count(DISTINCT t.template) = count(DISTINCT regen.template) AS covered FROM t LEFT JOIN regen USING (category, template) GROUP BY 1")
def q03_coverage(s, d):
    """Whether each template of each category has an item left."""
    t = table(s, d, "generation_plan").where("stage = 2").select("category", F.coalesce("template_index", F.lit(0)).alias("template")).distinct()
    have = _regen(s, d).select("category", "template", F.lit(True).alias("have")).distinct()
    g = t.join(have, ["category", "template"], "left").groupBy("category").agg(F.count("*").alias("n_templates"), F.count("have").alias("n_covered"))
    return g.withColumn("covered", F.col("n_templates") == F.col("n_covered"))


# Q04 ------------------------------------------------------------------------------------------------------------------

_MATCHED = f"""{LAB}, c AS (SELECT *, row_number() OVER (PARTITION BY upper(trim(series_id)), is_cvd_tissue ORDER BY md5('cap|' || sample_index)) AS k FROM lab WHERE series_id IS NOT NULL), x AS (SELECT sample_index, is_cvd_tissue::INTEGER AS y, disease_category AS c, upper(trim(series_id)) AS g FROM c WHERE k <= 10),
n AS (SELECT c, least(count_if(y = 1), count_if(y = 0)) AS p FROM x GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY c, y ORDER BY md5('disc|' || sample_index), sample_index) AS k FROM x), m AS (SELECT sample_index, y, c, g FROM r JOIN n USING (c) WHERE k <= p)"""


def _matched(s, d):
    x = lab(s, d).where("series_id is not null").select("sample_index", F.col("is_cvd_tissue").cast("int").alias("y"), F.col("disease_category").alias("c"), F.upper(F.trim("series_id")).alias("g"))
    return sampling.matched_classes(windows.capped(x, ["g", "y"], "sample_index", 10, "cap"), "c", "y", "sample_index", 1, "disc")


@query("q04_discriminative_plan", f"WITH {_MATCHED} SELECT sample_index, y, c FROM m")
def q04(s, d):
    return _matched(s, d).select("sample_index", "y", "c")


@query(
    "q04_discriminative_gates",
    f"""WITH {_MATCHED}, s AS (SELECT g, count(*) AS n, max(k) AS largest, count(*) > 1 AS mixed FROM (SELECT g, y, count(*) AS k FROM m GROUP BY 1, 2) GROUP BY 1), b AS (SELECT c, count_if(y = 1) = count_if(y = 0) AS even FROM m GROUP BY 1)
    SELECT count(*) AS n, count_if(y = 1) AS n_pos, round(avg(y), 8) AS pos_share, avg(y) BETWEEN 0.45 AND 0.55 AS balanced, (SELECT count_if(NOT even) FROM b) AS uneven_categories, (SELECT max(largest) FROM s) AS largest_series_class, (SELECT max(largest) FROM s) <= 10 AS within_cap, (SELECT count(*) FROM s) AS n_series, (SELECT count_if(NOT mixed) FROM s) AS single_class_series FROM m""",
)
def q04_gates(s, d):
    """The gates of the matched plan: balance overall and in each category, the cap a series, series of one class."""
    m = cut(_matched(s, d))
    per = m.groupBy("g", "y").agg(F.count("*").alias("k")).groupBy("g").agg(F.count("*").alias("classes"), F.max("k").alias("largest"))
    per = per.agg(F.max("largest").alias("largest_series_class"), (F.max("largest") <= 10).alias("within_cap"), F.count("*").alias("n_series"), F.count_if(F.col("classes") == 1).alias("single_class_series"))
    even = m.groupBy("c").agg((F.count_if(F.col("y") == 1) != F.count_if(F.col("y") == 0)).alias("uneven")).agg(F.count_if("uneven").alias("uneven_categories"))
    whole = m.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"), F.round(F.avg("y"), 8).alias("pos_share"), F.avg("y").between(0.45, 0.55).alias("balanced"))
    return whole.crossJoin(even).crossJoin(per)  # single rows


# Q08 ------------------------------------------------------------------------------------------------------------------

_NUMS = "list_distinct(regexp_extract_all(coalesce({c}, ''), '[0-9]+(?:[.][0-9]+)?'))"
_ROUTES = f"""{DE}, h AS (SELECT DISTINCT upper(trim(geo_accession)) || '.npy' AS image FROM de WHERE in_holdout), v AS (SELECT *, {_NUMS.replace('{c}', 'gt_answer')} AS gn, {_NUMS.replace('{c}', 'paraphrased_answer')} AS an, {polarity_sql("gt_answer")} AS gp, {polarity_sql("paraphrased_answer")} AS ap,
  regexp_matches(lower(coalesce(paraphrased_answer, '')), '{an.OVERCLAIMS}') AND NOT regexp_matches(lower(coalesce(gt_answer, '')), '{an.OVERCLAIMS}') AS over FROM ({{src}})),
routed AS (SELECT line_no, category, CASE WHEN status IN ('skip', 'skipped') THEN 'skipped' WHEN status <> 'ok' THEN 'error' WHEN image IN (SELECT image FROM h) THEN 'leak' WHEN trim(coalesce(paraphrased_answer, ''), ' ') = '' THEN 'no_answer' WHEN over THEN 'overclaim_reject'
  WHEN gp <> 'undetermined' AND ap <> 'undetermined' AND gp <> ap THEN 'polarity_reject' WHEN len(list_filter(gn, lambda x: NOT list_contains(an, x))) > 0 THEN 'factual_reject' ELSE 'pair' END AS route FROM v)"""
#: Verdicts for the answers of the classification category, right, flipped and overclaimed in turn, as a paraphraser returns them.
_VERDICT_SQL = """SELECT line_no, category, status, image, 'The profile shows evidence of cardiovascular disease.' AS gt_answer, CASE line_no % 3 WHEN 0 THEN 'Yes, cardiovascular disease is present.' WHEN 1 THEN 'Cardiovascular disease could not be confirmed for this sample.' ELSE 'This is a healthy sample with evidence of nothing else.' END AS paraphrased_answer FROM generation_results WHERE category = 'disease_subtype_classification'"""


def _held(s, d):
    return de(s, d).where("in_holdout").select(F.concat(F.upper(F.trim("geo_accession")), F.lit(".npy")).alias("image"))


@query("q08_bundle_routes", f"WITH {_ROUTES.replace('{src}', 'SELECT * FROM generation_results')} SELECT * FROM routed")
def q08(s, d):
    return corpus.route(table(s, d, "generation_results"), _held(s, d))


@query("q08_verdict_routes", f"WITH {_ROUTES.replace('{src}', _VERDICT_SQL)} SELECT * FROM routed")
def q08_verdicts(s, d):
    """Routes of binary verdicts: a third of the answers is right, a third flips the verdict, a third overclaims."""
    g = table(s, d, "generation_results").where("category = 'disease_subtype_classification'")
    k = F.pmod("line_no", F.lit(3))
    said = F.when(k == 0, "Yes, cardiovascular disease is present.").when(k == 1, "Cardiovascular disease could not be confirmed for this sample.").otherwise("This is a healthy sample with evidence of nothing else.")
    g = g.withColumn("gt_answer", F.lit("The profile shows evidence of cardiovascular disease.")).withColumn("paraphrased_answer", said)
    return corpus.route(g, _held(s, d))


@query(
    "q08_bundle_gates",
    f"""WITH {_ROUTES.replace('{src}', 'SELECT * FROM generation_results')}, ids AS (SELECT category, count(DISTINCT id) AS n_ids, count(DISTINCT CASE WHEN route = 'pair' THEN id END) AS n_with_pair, count(*) AS n FROM generation_results JOIN routed USING (line_no, category) GROUP BY 1),
    p AS (SELECT category, count(*) AS n_pairs, count(DISTINCT paraphrased_answer) AS n_distinct FROM generation_results JOIN routed USING (line_no, category) WHERE route = 'pair' GROUP BY 1), r AS (SELECT category, count_if(route = 'leak') AS n_leak, count_if(route LIKE '%reject') AS n_rejected FROM routed GROUP BY 1)
    SELECT category, n, n_ids, n_ids - n_with_pair AS n_missing, coalesce(n_pairs, 0) AS n_pairs, n_leak, n_rejected, round(n_distinct / n_pairs, 8) AS distinct_ratio, coalesce(n_distinct / n_pairs >= 0.9, false) AS distinct_enough, n_rejected <= 0.1 * n AS few_rejects FROM ids JOIN r USING (category) LEFT JOIN p USING (category)""",
)
def q08_gates(s, d):
    """Per category: ids without any pair, leaks, rejects, the ratio of distinct answers and its gate of 0.9."""
    g = table(s, d, "generation_results")
    return corpus.bundle_gates(g, corpus.route(g, _held(s, d)))


# Q12 ------------------------------------------------------------------------------------------------------------------

_RATES = f"""{LAB}, f AS (SELECT sample_index, disease_category AS c, upper(trim(series_id)) AS g, is_cvd_tissue::INTEGER AS y, (('0x' || substr(md5('bayes|' || upper(trim(series_id))), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM lab WHERE series_id IS NOT NULL),
t AS (SELECT k AS fold, c, sum(y)::BIGINT AS p, count(*) AS n FROM f, (SELECT unnest(range(5)) AS k) WHERE f.fold <> k GROUP BY 1, 2), a AS (SELECT k AS fold, sum(y)::BIGINT AS p, count(*) AS n FROM f, (SELECT unnest(range(5)) AS k) WHERE f.fold <> k GROUP BY 1),
own AS (SELECT c, sum(y)::BIGINT AS p, count(*) AS n FROM f GROUP BY 1), ser AS (SELECT g, sum(y)::BIGINT AS p, count(*) AS n FROM f GROUP BY 1),
sc AS (SELECT 'category_auc_grouped' AS name, y, round(coalesce(t.p / t.n, a.p / a.n), 9) AS score FROM f JOIN a USING (fold) LEFT JOIN t ON t.fold = f.fold AND t.c = f.c UNION ALL SELECT 'category_auc_ungrouped', y, round(own.p / own.n, 9) FROM f JOIN own USING (c) UNION ALL SELECT 'series_auc_upper_bound', y, round(ser.p / ser.n, 9) FROM f JOIN ser USING (g)),
dv AS (SELECT name, score, sum(y)::BIGINT AS p, count(*) - sum(y)::BIGINT AS q FROM sc GROUP BY 1, 2), cu AS (SELECT *, sum(q) OVER (PARTITION BY name ORDER BY score) - q AS below FROM dv),
shortcut AS (SELECT name, sum(p * (2 * below + q)) / (2.0::DOUBLE * sum(p) * sum(q)) AS value FROM cu GROUP BY 1)"""
_PARTS = {
    "a24_concentration": {"series_groups": "groups", "series_for_half": "n_50", "series_for_80": "n_80", "series_hhi": "hhi", "largest_series_share": "top_share"},
    "a29_matching_capacity": {"matching_capacity": "sum(capacity)", "categories_without_counterpart": "sum(cast(no_counterpart AS INTEGER))"},
    "a30_feasibility": {"matched_at_cap_2": "sum(CASE WHEN cap = 2 THEN matched ELSE 0 END)", "matched_at_cap_5": "sum(CASE WHEN cap = 5 THEN matched ELSE 0 END)", "matched_at_cap_20": "sum(CASE WHEN cap = 20 THEN matched ELSE 0 END)"},
    "a31_purity": {"series_of_20": "count(*)", "pure_series": "sum(cast(pure AS INTEGER))"},
    "m15_within_series": {"within_series_auc": "pair_weighted", "within_series_groups": "n_groups"},
    "m22_bayes_rule": {"bayes_brier": "avg(brier)", "bayes_unseen": "sum(n_unseen)"},
    "m24_paired_folds": {"paired_wins": "sum(wins)", "paired_delta": "avg(mean_delta)"},
}
_PART_SQL = " UNION ALL ".join(f"SELECT '{q}' AS part, '{n}' AS name, round(({e})::DOUBLE, 6) AS value FROM ({SQL[q]})" for q, ns in _PARTS.items() for n, e in ns.items())


def _shortcuts(s, d):
    """AUC of the rate of positives in a category (from other folds, and from all rows) and in a series."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("bayes|"), F.col("g"))), 1, 8), 16, 10).cast("long")
    f = lab(s, d).where("series_id is not null").select(F.col("disease_category").alias("c"), F.upper(F.trim("series_id")).alias("g"), F.col("is_cvd_tissue").cast("int").alias("y")).withColumn("fold", F.pmod(h, F.lit(5)).cast("int"))
    rate = lambda x, by, n: x.groupBy(*by).agg(F.avg("y").alias(n))
    train = f.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.array_except(F.array(*map(F.lit, range(5))), F.array("own"))))
    x = f.join(rate(train, ["fold"], "prior"), "fold").join(rate(train, ["fold", "c"], "r"), ["fold", "c"], "left").join(rate(f, ["c"], "u"), "c", "left").join(rate(f, ["g"], "s"), "g")
    names = {"category_auc_grouped": F.coalesce("r", "prior"), "category_auc_ungrouped": F.col("u"), "series_auc_upper_bound": F.col("s")}
    scores = x.select("y", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.round(c, 9).alias("score")) for n, c in names.items()))).alias("k")).select("y", "k.*").where("score is not null")
    return auc.roc_auc(scores, "y", "score", ["name"]).select(F.lit("shortcut").alias("part"), "name", F.round("auc", 6).alias("value"))


@query("q12_confound_report", f"WITH {_RATES} SELECT * FROM ({_PART_SQL} UNION ALL SELECT 'shortcut', name, round(value, 6) FROM shortcut WHERE name IS NOT NULL)")
def q12(s, d):
    """What a model could lean on besides the input: concentration, matching capacity and feasibility, purity, the Bayes
    rule by category, AUC of categories and series alone, within-series AUC, paired folds; one figure a row."""
    out = _shortcuts(s, d)
    for q, ns in _PARTS.items():
        one = QUERIES[q](s, d).agg(*(F.expr(e if "(" in e else f"max({e})").cast("double").alias(n) for n, e in ns.items()))
        pairs = F.array(*(F.struct(F.lit(q).alias("part"), F.lit(n).alias("name"), F.round(F.col(n), 6).alias("value")) for n in ns))
        out = out.unionByName(one.select(F.explode(pairs).alias("p")).select("p.*"))
    return out
