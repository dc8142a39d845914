"""Queries of the question engine (P), the composites (Q), correlation (J12, M31, M32, M40) and learning (M02 to M09, M29)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sampleloom.operators import sampling, windows
from sampleloom.operators.joins import alias_rescue, provenance_union
from sampleloom.plans.common import DE, EMB, LAB, de, emb, lab
from sampleloom.qa import corpus, questions
from sampleloom.registry import query
from sampleloom.session import cut, shared_dir, table
from sampleloom.stats import auc, expression, learn


def requests(s, d):
    """The plan's rows as requests. What a category needs and the plan leaves open is bound by the template's number, as a
    template would: threshold, size, direction; the second gene is the first one's best partner."""
    p = table(s, d, "generation_plan")
    e, c, t = F.col("entities"), F.col("category"), F.coalesce("template_index", F.lit(0))
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), F.pmod(t, F.lit(len(xs))).cast("int"))
    n = F.when(c == "ranking_ordering_query", pick(None, "3", "50%", "0.25", "70")).when(c == "interaction_network_query", pick(None, "3", "5", "2.5", "12"))
    way = F.when(c == "threshold_query", pick("above", " Below", "sideways", "over")).when(c == "ranking_ordering_query", pick("top", "bottom", "Highest"))
    r = p.select(F.col("plan_row").alias("row"), "category", F.upper(F.trim("patient")).alias("sample"), e["gene"].alias("gene"), F.coalesce(e["n"], n).alias("n"), F.coalesce(e["direction"], way).alias("direction"), F.when(c == "threshold_query", pick(1.5, -1.0, 0.0, 100.0, None)).cast("double").alias("threshold"))
    second = questions.best_partners(table(s, d, "coexpression_edges")).where("place = 1").select("gene", F.col("partner").alias("gene_b"))
    return r.join(second, "gene", "left")


def _ctx(s, d):
    return questions.context(de(s, d), lab(s, d), table(s, d, "coexpression_edges"))


_pick = lambda *xs: f"(list_value({', '.join(xs)}))[(((coalesce(template_index, 0) % {len(xs)}) + {len(xs)}) % {len(xs)}) + 1]"
_CTX = f"""{DE}, {LAB}, one AS (SELECT upper(trim(geo_accession)) AS sample, arg_min({{'i': sample_index, 's': status, 'u': top_up_genes, 'w': top_down_genes, 'uz': top_up_z, 'dz': top_down_z, 'b': magnitude_bucket, 'g': n_genes_abs_z_gt2}}, sample_index) AS r FROM de WHERE geo_accession IS NOT NULL GROUP BY 1),
lb AS (SELECT sample_index, min(cvd_subtype) AS subtype, bool_or(is_cvd_disease) AS diseased FROM lab GROUP BY 1),
smp AS (SELECT sample, r.i AS sample_index, r.s AS st, r.u AS up, r.w AS down, r.b AS bucket, r.g AS g, subtype, diseased FROM one LEFT JOIN lb ON lb.sample_index = one.r.i),
val AS (SELECT sample, gene, avg(v) AS v FROM (SELECT sample, unnest(r.u) AS gene, unnest(r.uz)::DOUBLE AS v FROM one UNION ALL SELECT sample, unnest(r.w), unnest(r.dz)::DOUBLE FROM one) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2),
lst AS (SELECT sample, list({{'gene': gene, 'v': v}}) AS l FROM val GROUP BY 1),
gr AS (SELECT gene, partner, row_number() OVER (PARTITION BY gene ORDER BY max(pearson_r::DOUBLE) DESC, partner) AS place FROM coexpression_edges WHERE gene <> partner AND NOT isnan(pearson_r) AND pearson_r BETWEEN -1 AND 1 GROUP BY 1, 2 QUALIFY place <= 100),
req0 AS (SELECT plan_row AS "row", category, upper(trim(patient)) AS sample, entities['gene'] AS gene,
  coalesce(entities['n'], CASE category WHEN 'ranking_ordering_query' THEN {_pick("NULL", "'3'", "'50%'", "'0.25'", "'70'")} WHEN 'interaction_network_query' THEN {_pick("NULL", "'3'", "'5'", "'2.5'", "'12'")} END) AS n,
  coalesce(entities['direction'], CASE category WHEN 'threshold_query' THEN {_pick("'above'", "' Below'", "'sideways'", "'over'")} WHEN 'ranking_ordering_query' THEN {_pick("'top'", "'bottom'", "'Highest'")} END) AS direction,
  CASE WHEN category = 'threshold_query' THEN {_pick("1.5", "-1.0", "0.0", "100.0", "NULL")}::DOUBLE END AS threshold FROM generation_plan),
req AS (SELECT req0.*, gr.partner AS gene_b FROM req0 LEFT JOIN gr ON gr.gene = req0.gene AND place = 1)"""
_DIR = "CASE WHEN lower(trim(direction)) IN ('up', 'above', 'over', 'higher', 'top', 'highest', 'raised', '>') THEN 'up' WHEN lower(trim(direction)) IN ('down', 'below', 'under', 'lower', 'bottom', 'lowest', 'lowered', '<') THEN 'down' END"
#: category -> row, reason and answer before refusal
_ASK: dict[str, str] = {}


def _p(name: str, category: str, sql: str):
    @query(name, f"WITH {_CTX} {sql}")
    def run(s, d):
        r = requests(s, d).where(F.col("category") == category)
        return questions.REGISTRY[category](r, _ctx(s, d))

    return run


_OUT = """SELECT "row", CASE WHEN reason IS NULL THEN 'ok' ELSE 'insufficient_data' END AS status, reason, CASE WHEN reason IS NULL THEN a END AS answer FROM ({})"""
_ASK["direct_abundance_query"] = f"""SELECT q."row", CASE WHEN s.sample_index IS NULL THEN 'unknown_sample' WHEN q.gene IS NULL THEN 'no_gene' WHEN v IS NULL THEN 'gene_not_in_matrix' END AS reason, printf('%.4f', round(v, 4)) AS a FROM (SELECT * FROM req WHERE category = 'direct_abundance_query') q LEFT JOIN smp s ON s.sample = q.sample LEFT JOIN val ON val.sample = q.sample AND val.gene = q.gene"""
_ASK["threshold_query"] = f"""SELECT "row", CASE WHEN sample_index IS NULL THEN 'unknown_sample' WHEN d IS NULL THEN 'bad_direction' WHEN threshold IS NULL THEN 'bad_threshold' WHEN l IS NULL THEN 'not_in_matrix' END AS reason,
  len(h) || ' of ' || len(l) || ': ' || coalesce((SELECT string_agg(x.gene, ',' ORDER BY CASE d WHEN 'up' THEN -x.v ELSE x.v END, x.gene) FROM (SELECT unnest(h) AS x)), '') || CASE WHEN len(h) IN (0, len(l)) THEN '*' ELSE '' END AS a
  FROM (SELECT q.*, sample_index, l, {_DIR} AS d, list_filter(l, lambda x: CASE {_DIR} WHEN 'up' THEN x.v > threshold ELSE x.v < threshold END) AS h FROM (SELECT * FROM req WHERE category = 'threshold_query') q LEFT JOIN smp s ON s.sample = q.sample LEFT JOIN lst ON lst.sample = q.sample)"""
_ASK["ranking_ordering_query"] = f"""SELECT "row", CASE WHEN sample_index IS NULL THEN 'unknown_sample' WHEN d IS NULL THEN 'bad_direction' WHEN o IS NULL THEN 'not_in_matrix' WHEN k IS NULL OR k NOT BETWEEN 1 AND len(o) THEN 'bad_size' END AS reason,
  array_to_string(list_transform(o[1:k], lambda x: x.gene), ',') || CASE WHEN o[k].v = o[k + 1].v THEN '*' ELSE '' END AS a
  FROM (SELECT q.*, sample_index, {_DIR} AS d, CASE n WHEN '3' THEN 3 WHEN '70' THEN 70 WHEN '50%' THEN ceil(len(up_) * 0.5)::INTEGER WHEN '0.25' THEN ceil(len(up_) * 0.25)::INTEGER END AS k, CASE {_DIR} WHEN 'up' THEN up_ ELSE down_ END AS o FROM (SELECT * FROM req WHERE category = 'ranking_ordering_query') q LEFT JOIN smp s ON s.sample = q.sample
  LEFT JOIN (SELECT sample, list({{'gene': gene, 'v': v}} ORDER BY v DESC, gene) AS up_, list({{'gene': gene, 'v': v}} ORDER BY v, gene) AS down_ FROM val GROUP BY 1) r ON r.sample = q.sample)"""
_ASK["comparative_query"] = f"""SELECT q."row", CASE WHEN s.sample_index IS NULL THEN 'unknown_sample' WHEN x.v IS NULL THEN 'gene_not_in_matrix' WHEN y.v IS NULL THEN 'second_gene_not_in_matrix' END AS reason,
  CASE WHEN x.v > y.v THEN q.gene WHEN y.v > x.v THEN q.gene_b ELSE 'equal' END || ' ' || printf('%.4f', round(abs(x.v - y.v), 4)) || ' ' || printf('%.4f', round((x.v - y.v) / ln(2::DOUBLE), 4)) AS a FROM (SELECT * FROM req WHERE category = 'comparative_query') q LEFT JOIN smp s ON s.sample = q.sample
  LEFT JOIN val x ON x.sample = q.sample AND x.gene = q.gene LEFT JOIN val y ON y.sample = q.sample AND y.gene = q.gene_b"""
_ASK["interaction_network_query"] = f"""SELECT q."row", CASE WHEN s.sample_index IS NULL THEN 'unknown_sample' WHEN m IS NULL THEN 'gene_not_in_graph' WHEN k IS NULL THEN 'bad_size' WHEN coalesce(found, 0) = 0 THEN 'no_partner_in_sample' END AS reason, said AS a
  FROM (SELECT req.*, m, CASE WHEN regexp_matches(trim(n), '^[+-]?[0-9]+$') AND TRY_CAST(n AS INTEGER) BETWEEN 1 AND m THEN n::INTEGER END AS k FROM req LEFT JOIN (SELECT gene, count(*) AS m FROM gr GROUP BY 1) c ON c.gene = req.gene WHERE category = 'interaction_network_query') q LEFT JOIN smp s ON s.sample = q.sample
  LEFT JOIN (SELECT "row", count(v) AS found, string_agg(gr.partner || '=' || coalesce(printf('%.4f', round(v, 4)), 'na'), ',' ORDER BY place) AS said FROM req JOIN gr ON gr.gene = req.gene LEFT JOIN val ON val.sample = req.sample AND val.gene = gr.partner
    WHERE category = 'interaction_network_query' AND regexp_matches(trim(n), '^[+-]?[0-9]+$') AND place <= TRY_CAST(n AS INTEGER) GROUP BY 1) t ON t."row" = q."row" """
_ASK["disease_subtype_classification"] = f"""SELECT "row", CASE WHEN s.sample_index IS NULL THEN 'unknown_sample' WHEN subtype IS NULL THEN 'no_label' WHEN subtype = '' THEN 'outside_pool' END AS reason, subtype AS a FROM (SELECT * FROM req WHERE category = 'disease_subtype_classification') q LEFT JOIN smp s ON s.sample = q.sample"""
_ASK["comparative_differential_reasoning"] = f"""SELECT "row", CASE WHEN s.sample_index IS NULL THEN 'unknown_sample' WHEN d IS NULL THEN 'bad_direction' WHEN k IS NULL THEN 'bad_size' WHEN coalesce(st, '') <> 'ok' THEN 'de_unavailable' WHEN coalesce(len(CASE d WHEN 'up' THEN up ELSE down END), 0) = 0 THEN 'nothing_passes' END AS reason,
  array_to_string((CASE d WHEN 'up' THEN up ELSE down END)[1:k], ',') AS a FROM (SELECT *, {_DIR} AS d, CASE WHEN TRY_CAST(n AS INTEGER) BETWEEN 1 AND 100 THEN n::INTEGER END AS k FROM req WHERE category = 'comparative_differential_reasoning') q LEFT JOIN smp s ON s.sample = q.sample"""
_ASK["gene_driver_reasoning"] = f"""SELECT "row", CASE WHEN sample_index IS NULL THEN 'unknown_sample' WHEN NOT coalesce(diseased, false) THEN 'not_diseased' WHEN coalesce(st, '') <> 'ok' THEN 'de_unavailable' WHEN k IS NULL THEN 'bad_size' WHEN d IS NULL OR d NOT IN ('up', 'down', 'both', 'abs') THEN 'bad_direction' WHEN coalesce(len(o), 0) = 0 THEN 'nothing_computable' END AS reason,
  (SELECT string_agg(gene || ' ' || printf('%.3f', round(v, 3)), ',' ORDER BY CASE d WHEN 'up' THEN -v WHEN 'down' THEN v ELSE -abs(v) END, gene) FROM (SELECT x.gene AS gene, x.v AS v, row_number() OVER (ORDER BY CASE d WHEN 'up' THEN -x.v WHEN 'down' THEN x.v ELSE -abs(x.v) END, x.gene) AS place FROM (SELECT unnest(o) AS x)) WHERE place <= k) AS a
  FROM (SELECT q.*, sample_index, diseased, st, CASE WHEN TRY_CAST(n AS INTEGER) BETWEEN 1 AND 100 THEN n::INTEGER END AS k, lower(trim(direction)) AS d, list_filter(l, lambda x: CASE lower(trim(direction)) WHEN 'up' THEN x.v > 0 WHEN 'down' THEN x.v < 0 ELSE true END) AS o FROM (SELECT * FROM req WHERE category = 'gene_driver_reasoning') q LEFT JOIN smp s ON s.sample = q.sample LEFT JOIN lst ON lst.sample = q.sample)"""
_ASK["magnitude_reasoning"] = f"""SELECT "row", CASE WHEN s.sample_index IS NULL THEN 'unknown_sample' WHEN coalesce(st, '') <> 'ok' THEN 'de_unavailable' END AS reason, bucket || ' ' || g AS a FROM (SELECT * FROM req WHERE category = 'magnitude_reasoning') q LEFT JOIN smp s ON s.sample = q.sample"""
for _name, _category in (("ask02_direct_abundance", "direct_abundance_query"), ("ask03_threshold", "threshold_query"), ("ask04_ranking", "ranking_ordering_query"), ("ask05_comparative", "comparative_query"), ("ask06_network", "interaction_network_query"), ("ask07_subtype", "disease_subtype_classification"), ("ask08_differential", "comparative_differential_reasoning"), ("ask09_drivers", "gene_driver_reasoning"), ("ask10_magnitude", "magnitude_reasoning")):
    _p(_name, _category, _OUT.format(_ASK[_category]))
_ANSWERED = "answered AS (" + " UNION ALL ".join(f"SELECT *, '{c}' AS category FROM ({_OUT.format(q)})" for c, q in _ASK.items()) + """ UNION ALL SELECT plan_row, 'insufficient_data', 'unknown_category', NULL, category FROM generation_plan WHERE category IS NULL OR category NOT IN (""" + ", ".join(f"'{c}'" for c in _ASK) + "))"


@query("ask11_dispatch", f"WITH {_CTX}, {_ANSWERED} SELECT * FROM answered")
def p11(s, d):
    return questions.answer(requests(s, d), _ctx(s, d)).select("row", "category", "status", "reason", "answer")


# correlation ------------------------------------------------------------------------------------------------------


@query("j12_coexpression", f"WITH {EMB}, c AS (SELECT a.gene, b.gene AS partner, corr(a.v, b.v) AS r FROM emb a JOIN emb b ON a.sample_index = b.sample_index AND a.gene <> b.gene GROUP BY 1, 2) SELECT gene, partner, row_number() OVER (PARTITION BY gene ORDER BY round(r, 12) DESC, partner)::INTEGER AS rank, round(r, 6) AS r FROM c QUALIFY rank <= 10")
def j12(s, d):
    return expression.pearson_top(emb(s, d), 10, block=16).select("gene", "partner", "rank", F.round("r", 6).alias("r"))


@query("j12_coexpression_missing", f"WITH {EMB}, part AS (SELECT * FROM emb WHERE abs(v) >= 0.02), c AS (SELECT a.gene, b.gene AS partner, corr(a.v, b.v) AS r, count(*) AS n FROM part a JOIN part b ON a.sample_index = b.sample_index AND a.gene <> b.gene GROUP BY 1, 2) SELECT gene, partner, row_number() OVER (PARTITION BY gene ORDER BY round(r, 12) DESC, partner)::INTEGER AS rank, round(r, 6) AS r FROM c QUALIFY rank <= 10")
def j12_missing(s, d):
    """Values of less than 0.02 are not detected, so each gene has missing cells of its own."""
    x = emb(s, d).where(F.abs("v") >= 0.02)
    return expression.pearson_top(x, 10, block=16, chunk=300).select("gene", "partner", "rank", F.round("r", 6).alias("r"))


@query("m32_standardised", f"WITH {EMB}, g AS (SELECT gene, avg(v) AS m, stddev_samp(v) AS sd FROM emb GROUP BY 1) SELECT gene, round(sum(((v - m) / sd) ** 2), 4) AS ss, count(*) AS n FROM emb JOIN g USING (gene) GROUP BY 1")
def m32(s, d):
    x = emb(s, d)
    g = x.groupBy("gene").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    return x.join(g, "gene").groupBy("gene").agg(F.round(F.sum(F.pow((F.col("v") - F.col("m")) / F.col("sd"), 2)), 4).alias("ss"), F.count("*").alias("n"))


@query("m40_recomputed_edges", f"WITH {EMB}, p AS (SELECT a.gene AS gene, b.gene AS partner FROM (SELECT DISTINCT gene FROM emb) a JOIN (SELECT DISTINCT gene FROM emb) b ON b.gene = a.gene + 1) SELECT p.gene, p.partner, round(corr(a.v, b.v), 6) AS r FROM p JOIN emb a ON a.gene = p.gene JOIN emb b ON b.gene = p.partner AND b.sample_index = a.sample_index GROUP BY 1, 2")
def m40(s, d):
    x = emb(s, d)
    pairs = x.select("gene").distinct().withColumn("partner", F.col("gene") + 1)
    return expression.pearson_pairs(x, pairs).select("gene", "partner", F.round("r", 6).alias("r"))


@query("m39_cache_check", f"WITH {EMB}, a AS (SELECT sample_index, gene, v, round(v, 4) AS w FROM emb) SELECT round(max(abs(v - w)), 5) AS max_delta, max(abs(v - w)) <= 1e-4 AS within_tolerance FROM a")
def m39(s, d):
    x = emb(s, d).withColumn("w", F.round("v", 4))
    m = F.max(F.abs(F.col("v") - F.col("w")))
    return x.agg(F.round(m, 5).alias("max_delta"), (m <= 1e-4).alias("within_tolerance"))


# composites ---------------------------------------------------------------------------------------------------------


@query("q01_per_sample_scores", f"""WITH {EMB}, g AS (SELECT label, gene, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM emb GROUP BY 1, 2), p AS (SELECT gene, avg(v) AS m, stddev_pop(v) AS sd FROM emb GROUP BY 1),
z AS (SELECT e.sample_index, e.gene, (v - coalesce(g.m, p.m)) / (coalesce(g.sd, p.sd) + 1e-6) AS z FROM emb e LEFT JOIN (SELECT * FROM g WHERE n >= 30) g ON g.label = e.label AND g.gene = e.gene JOIN p ON p.gene = e.gene)
SELECT sample_index, round(avg(abs(z)), 6) AS mean_abs_z, round(max(abs(z)), 6) AS max_abs_z, count_if(abs(z) > 2) AS n_gt2, round(avg((abs(z) > 2)::INTEGER), 8) AS frac_gt2, count(z) AS n_compared FROM z GROUP BY 1""")
def q01(s, d):
    scored = expression.differential(emb(s, d), "label", 30)
    return expression.per_sample_scores(scored, 8, F.abs("lfc") >= 0.05).drop("top_up", "top_down")


@query("q01_top_lists", f"""WITH {EMB}, g AS (SELECT label, gene, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM emb GROUP BY 1, 2), p AS (SELECT gene, avg(v) AS m, stddev_pop(v) AS sd FROM emb GROUP BY 1),
z AS (SELECT e.sample_index, e.gene, v - coalesce(g.m, p.m) AS lfc, (v - coalesce(g.m, p.m)) / (coalesce(g.sd, p.sd) + 1e-6) AS z FROM emb e LEFT JOIN (SELECT * FROM g WHERE n >= 30) g ON g.label = e.label AND g.gene = e.gene JOIN p ON p.gene = e.gene)
SELECT sample_index, array_to_string((list(gene ORDER BY z DESC, gene) FILTER (z > 0 AND abs(lfc) >= 0.05))[1:8], ',') AS top_up, array_to_string((list(gene ORDER BY z, gene) FILTER (z < 0 AND abs(lfc) >= 0.05))[1:8], ',') AS top_down FROM z GROUP BY 1""")
def q01t(s, d):
    scored = expression.differential(emb(s, d), "label", 30)
    return expression.per_sample_scores(scored, 8, F.abs("lfc") >= 0.05).select("sample_index", "top_up", "top_down")


@query("q05_filled", f"""WITH {_CTX}, {_ANSWERED} SELECT req."row", req.category, req.sample, CASE WHEN status = 'ok' THEN (CASE req."row" % 2 WHEN 0 THEN 'Give ' ELSE 'State ' END) || req.category || ': ' || coalesce(req.gene, '') || ' ' || coalesce(req.n, '') || ' ' || coalesce(req.direction, '') || ' in ' || coalesce(req.sample, '') || '?' END AS question, answer, reason AS excluded
FROM req JOIN answered USING ("row")""")
def q05(s, d):
    templates = s.createDataFrame([(c, i, f"{verb} {c}: {{gene}} {{n}} {{direction}} in {{sample}}?") for c in sorted(questions.REGISTRY) for i, verb in enumerate(("Give", "State"))], "category string, template_index int, text string")
    r = requests(s, d)
    return corpus.fill_requests(r, questions.answer(r, _ctx(s, d)), templates)


@query("q06_preflight", "SELECT count(*) AS n, count_if(patient IS NULL) AS no_patient, count_if(category IS NULL) AS no_category, count_if(regexp_matches(coalesce(entities['gene'], ''), '\\{[a-z_]+\\}')) AS unresolved, count(*) - count(DISTINCT plan_row) AS repeated FROM generation_plan")
def q06(s, d):
    p = table(s, d, "generation_plan")
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("patient").isNull()).alias("no_patient"), F.count_if(F.col("category").isNull()).alias("no_category"), F.count_if(corpus.unresolved(F.coalesce(F.col("entities")["gene"], F.lit("")))).alias("unresolved"), (F.count("*") - F.countDistinct("plan_row")).alias("repeated"))


@query("q07_duplicate_ids", "SELECT id, count(*) AS n FROM generation_results GROUP BY 1 HAVING count(*) > 1")
def q07(s, d):
    return corpus.duplicate_ids(table(s, d, "generation_results"), "id")


_RETUNED = "tuned AS (SELECT sample, (v + nx) / 2 AS t FROM (SELECT sample, v, row_number() OVER (PARTITION BY sample ORDER BY v DESC, gene) AS m, lead(v) OVER (PARTITION BY sample ORDER BY v DESC, gene) AS nx FROM val) WHERE m = 3 AND v > nx), req2 AS (SELECT req.* REPLACE (coalesce(tuned.t, threshold) AS threshold) FROM req LEFT JOIN tuned USING (sample))"
_RE_ASKED = _OUT.format(_ASK["threshold_query"].replace("FROM req WHERE", "FROM req2 WHERE"))


@query("q09_unchanged_categories", f"""WITH {_CTX}, {_ANSWERED}, {_RETUNED}, again AS ({_RE_ASKED}), c AS (SELECT a.category, a."row", coalesce(a.answer, a.reason) AS x, CASE WHEN a.category = 'threshold_query' THEN (SELECT coalesce(b.answer, b.reason) FROM again b WHERE b."row" = a."row") ELSE coalesce(a.answer, a.reason) END AS y FROM answered a)
SELECT category, count(*) AS n, count_if(x IS DISTINCT FROM y) AS n_changed, count_if(x IS DISTINCT FROM y) = 0 AS unchanged FROM c WHERE category IS NOT NULL GROUP BY 1""")
def q09(s, d):
    """Thresholds are retuned so that three genes pass where that is possible; all requests are answered again, and the
    checksums of a category's answers say whether it has changed."""
    r, ctx = cut(requests(s, d)), _ctx(s, d)
    ctx = ctx | {"values": cut(ctx["values"]), "samples": cut(ctx["samples"])}
    v = windows.ranked(questions._levels(ctx), F.desc("v"), F.asc("gene"), by=["sample"], out="m").where("m <= 4")
    t = v.groupBy("sample").agg(F.max(F.when(F.col("m") == 3, F.col("v"))).alias("third"), F.max(F.when(F.col("m") == 4, F.col("v"))).alias("fourth"))
    t = t.where("third > fourth").select("sample", ((F.col("third") + F.col("fourth")) / 2).alias("t"))
    tuned = r.join(t, "sample", "left").withColumn("threshold", F.when(F.col("category") == "threshold_query", F.coalesce("t", "threshold")).otherwise(F.col("threshold"))).drop("t")
    said = lambda x, n: questions.answer(x, ctx).select("row", "category", F.coalesce("answer", "reason").alias(n))
    return corpus.unchanged(said(r, "x"), said(tuned, "y"), "row", "category")


@query("q11_curated_pool", f"""WITH {DE}, up AS (SELECT gene, row_number() OVER (ORDER BY n DESC, gene) AS r FROM (SELECT gene, count(*) AS n FROM (SELECT unnest(top_up_genes) AS gene FROM de) GROUP BY 1)), gr AS (SELECT partner AS gene, row_number() OVER (ORDER BY k DESC, partner) AS r FROM (SELECT partner, count(DISTINCT gene) AS k FROM coexpression_edges WHERE partner IS NOT NULL GROUP BY 1)),
uni AS (SELECT DISTINCT partner AS gene FROM coexpression_edges WHERE partner IS NOT NULL), asked AS (SELECT g, regexp_replace(g, '-AS.*$', '') AS stem, row_number() OVER (ORDER BY n DESC, g) AS r FROM (SELECT entities['gene'] AS g, count(*) AS n FROM generation_plan GROUP BY 1) WHERE g IS NOT NULL),
res AS (SELECT coalesce(a.gene, b.gene) AS gene FROM asked LEFT JOIN uni a ON a.gene = g LEFT JOIN uni b ON b.gene = stem WHERE r <= 100),
u AS (SELECT gene, 'up' AS w FROM up WHERE r <= 100 UNION SELECT gene, 'graph' FROM gr WHERE r <= 100 UNION SELECT gene, 'asked' FROM res WHERE gene IS NOT NULL)
SELECT gene, bool_or(w = 'up') AS in_up, bool_or(w = 'graph') AS in_graph, bool_or(w = 'asked') AS in_asked, count(*) AS n_sources FROM u WHERE NOT regexp_matches(gene, '^ENSG[0-9]+$') GROUP BY 1""")
def q11(s, d):
    """The genes raised most often, those most in the lists of others, and those asked for most, the last ones resolved to the
    graph's names by themselves or by their stem; unannotated ones are left out."""
    up = de(s, d, "top_up_genes").select(F.explode("top_up_genes").alias("gene")).groupBy("gene").agg(F.count("*").alias("n"))
    graph = table(s, d, "coexpression_edges").where("partner is not null").groupBy(F.col("partner").alias("gene")).agg(F.countDistinct(F.col("gene")).alias("n"))
    asked = table(s, d, "generation_plan").select(F.col("entities")["gene"].alias("gene")).where("gene is not null").groupBy("gene").agg(F.count("*").alias("n"))
    top = lambda x: x.orderBy(F.desc("n"), "gene").limit(100)  # noqa: E731  (a report of the first hundred)
    named = top(asked).select("gene", F.array(F.regexp_replace("gene", "-AS.*$", "")).alias("aliases"))
    resolved = alias_rescue(named, graph.select("gene"), "gene", "aliases").where("match is not null").select(F.col("match").alias("gene")).distinct()
    return provenance_union("gene", up=top(up), graph=top(graph), asked=resolved).where(~F.rlike("gene", F.lit("^ENSG[0-9]+$")))


@query("q13_loader_contract", "SELECT count(*) AS n_keys, sum(w)::BIGINT AS wrong_width, count_if(v > 1) AS vector_conflicts, count_if(t < n) AS repeated_texts FROM (SELECT label, count(*) AS n, count(DISTINCT embedding) AS v, count(DISTINCT vec_id) AS t, count_if(len(embedding) <> 64) AS w FROM embeddings GROUP BY 1)")
def q13(s, d):
    return corpus.contract(table(s, d, "embeddings"), "label", "vec_id", "embedding", 64)


# learning -------------------------------------------------------------------------------------------------------------


def _labelled(s, d):
    x = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding", (F.col("label") < 5).cast("int").alias("y"), F.floor(F.col("vec_id") / 25).alias("series"))
    return x.join(sampling.snake_folds(x, "series", 3, "cv").select("series", "fold"), "series")


def _rounded(x):
    return x.select("fold", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


@query("m03_elastic_net_folds")
def m03(s, d):
    p = learn.searched_probe(_labelled(s, d), "embedding", "y", "series", "fold", 3, regs=[0.1, 0.01, 0.001], elastics=[0.1, 0.5, 0.9])
    return auc.roc_auc(p, "label", "score", ["fold", "reg", "elastic"]).select("fold", "n_pos", "n_neg", F.round("auc", 4).alias("auc"), "reg", "elastic")


@query("m04_coefficients")
def m04(s, d):
    names = s.range(70).select(F.col("id").cast("int").alias("gene"))
    return learn.coefficients(_labelled(s, d), "embedding", "y", names, 0.5, 0.02).select("gene", F.round("coefficient", 4).alias("coefficient"), "iterations")


@query("m05_linear_probe")
def m05(s, d):
    return _rounded(learn.fold_auc(learn.probe(_labelled(s, d), "embedding", "y", "fold", 3)))


@query("m07_pca_probe")
def m07(s, d):
    return _rounded(learn.fold_auc(learn.probe(_labelled(s, d), "embedding", "y", "fold", 3, pca=16)))


@query("m07_perceptron_probe")
def m07m(s, d):
    return _rounded(learn.fold_auc(learn.probe(_labelled(s, d), "embedding", "y", "fold", 3, layers=[64, 16, 2])))


@query("m08_per_condition")
def m08(s, d):
    from sampleloom.operators.filters import per_condition

    p = learn.probe(_labelled(s, d), "embedding", "y", "fold", 3)
    c = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("condition"))
    x = per_condition(p.join(c, "key"), "label", "condition", [f"c{k}" for k in range(5)])
    return auc.roc_auc(x, "label", "score", ["of"]).select("of", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


@query("m25_out_of_fold")
def m25(s, d):
    return learn.probe(_labelled(s, d), "embedding", "y", "fold", 3).select("key", "fold", "label", F.round("score", 4).alias("score"))


@query("m29_principal_components")
def m29(s, d):
    x = learn.principal_components(table(s, d, "embeddings"), "embedding", "vec_id", 5)
    return x.select("vec_id", F.round(F.abs(F.col("scores")[0]), 4).alias("pc1"), F.round(F.col("explained")[0], 6).alias("share1"))


# streaming ------------------------------------------------------------------------------------------------------------


@query("str_daily_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_daily(s, d):
    from sampleloom.streaming.logs import run_to_table, windowed

    where = f"{shared_dir(s)}/stream-{uuid.uuid4().hex[:10]}"
    src = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    run_to_table(windowed(src, "ts", "event_type", "value", late="3650 days"), f"{where}/out", f"{where}/state", mode="complete")
    return s.read.parquet(f"{where}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str_first_deliveries", "SELECT DISTINCT event_id FROM events")
def str_first(s, d):
    from sampleloom.streaming.logs import first_deliveries, run_to_table

    where = f"{shared_dir(s)}/stream-{uuid.uuid4().hex[:10]}"
    src = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    run_to_table(first_deliveries(src, "event_id", "ts").select("event_id"), f"{where}/out", f"{where}/state")
    return s.read.parquet(f"{where}/out")
