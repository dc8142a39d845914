"""The queries of this subpackage and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm import answer_defects, collapse, cross_split, leakage, mixing, split_groups, target_sample, text_quality, top_items
from sampleloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# 1 ------------------------------------------------------------------------------------------------------------------

_TIES = r"""RECURSIVE keys AS (
  SELECT sample_index, '1:' || unnest(list_filter(regexp_split_to_array(upper(series_id), '[\s,;|/+&]+'), lambda x: x <> '')) AS k FROM per_sample_de WHERE sample_index IS NOT NULL
  UNION SELECT sample_index, '2:' || nullif(upper(trim(geo_accession, E' \t\n\r')), '') FROM per_sample_de WHERE sample_index IS NOT NULL
  UNION SELECT sample_index, '3:' || nullif(upper(trim(patient_key, E' \t\n\r')), '') FROM sample_labels WHERE has_resolved_patient AND sample_index IN (SELECT sample_index FROM per_sample_de)),
several AS (SELECT k FROM keys GROUP BY 1 HAVING count(DISTINCT sample_index) > 1),
kept AS (SELECT DISTINCT sample_index, k FROM keys WHERE k IS NOT NULL AND (k LIKE '1:%' OR k IN (SELECT k FROM several)) {only}),
edges AS (SELECT DISTINCT a.k AS a, b.k AS b FROM kept a JOIN kept b USING (sample_index)),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY 1)"""
_WITH_SERIES = "AND sample_index IN (SELECT sample_index FROM keys WHERE k LIKE '1:%')"
_SPLITS = f"""{_TIES.format(only="")}, part AS (SELECT sample_index, min(root) AS root FROM kept JOIN roots ON node = k GROUP BY 1),
part2 AS (SELECT sample_index, coalesce(root, 'r:' || sample_index) AS component FROM (SELECT DISTINCT sample_index FROM per_sample_de WHERE sample_index IS NOT NULL) LEFT JOIN part USING (sample_index)),
goal AS (SELECT split, sum(share) AS share FROM split_target WHERE split IS NOT NULL AND share > 0 AND NOT isnan(share) GROUP BY 1),
chosen AS (SELECT component, arg_min(split, -ln((('0x' || substr(md5(split || '|' || component), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496) / share) AS split FROM (SELECT DISTINCT component FROM part2), goal GROUP BY 1),
given AS (SELECT sample_index, component, split FROM part2 LEFT JOIN chosen USING (component))"""


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "per_sample_de"), table(spark, d, "sample_labels")


@query(
    "p1_found",
    f"""WITH {_TIES.format(only=_WITH_SERIES)}, s AS (SELECT substr(node, 3) AS series_id, root FROM roots WHERE node LIKE '1:%'),
    g AS (SELECT root, min(series_id) AS group_series_id FROM s GROUP BY 1 HAVING count(*) > 1) SELECT series_id, group_series_id FROM s JOIN g USING (root)""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_groups.series_groups(*_labelled(spark, d))


@query("p1_splits", f"WITH {_SPLITS} SELECT * FROM given")
def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return split_groups.assign_splits(*_labelled(spark, d), table(spark, d, "split_target"))


@query(
    "p1_split_report",
    f"""WITH {_SPLITS}, n AS (SELECT split, count(*) AS n_samples, count(DISTINCT component) AS n_components FROM given GROUP BY 1),
    s AS (SELECT split, count(DISTINCT series) AS n_series FROM given JOIN (SELECT DISTINCT sample_index, substr(k, 3) AS series FROM keys WHERE k LIKE '1:%') USING (sample_index) GROUP BY 1)
    SELECT split, share, n_samples, n_components, round(n_samples / sum(n_samples) OVER (), 6) AS reached, n_series FROM (SELECT DISTINCT split, share FROM split_target) LEFT JOIN n USING (split) LEFT JOIN s USING (split)""",
)
def p1_split_report(spark: SparkSession, d: str) -> DataFrame:
    return split_groups.split_report(*_labelled(spark, d), table(spark, d, "split_target"))


@query(
    "p1_fold_series",
    """WITH f AS (SELECT DISTINCT run_id, fold, train_series_count AS t, val_series_count AS v FROM fold_result WHERE run_id IS NOT NULL AND fold IS NOT NULL AND train_series_count IS NOT NULL AND val_series_count IS NOT NULL)
    SELECT run_id, count(*) AS n_folds, min(t + v) AS n_series, max(t + v) - min(t + v) AS overcounted, sum(v)::BIGINT AS val_sum FROM f GROUP BY 1""",
)
def p1_fold_series(spark: SparkSession, d: str) -> DataFrame:
    return split_groups.fold_overcounts(table(spark, d, "fold_result"))


# 2 ------------------------------------------------------------------------------------------------------------------

_TOP = """SELECT gene, partner, r AS pearson_r, (row_number() OVER (PARTITION BY gene ORDER BY r DESC, partner))::INTEGER AS rank FROM (
  SELECT gene, partner, max(pearson_r::DOUBLE) + 0.0 AS r FROM coexpression_edges
  WHERE gene IS NOT NULL AND partner IS NOT NULL AND pearson_r IS NOT NULL AND NOT isnan(pearson_r) AND pearson_r BETWEEN -1 AND 1 AND gene <> partner GROUP BY 1, 2) QUALIFY rank <= """


def _partners(spark: SparkSession, d: str, n: int) -> DataFrame:
    return top_items.top_items(table(spark, d, "coexpression_edges"), "gene", "partner", "pearson_r", n, (-1.0, 1.0), skip_self=True)


@query("p2_found", f"SELECT gene, partner FROM ({_TOP}5)")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _partners(spark, d, 5).select("gene", "partner")


@query("p2_top_20", f"{_TOP}20")
def p2_top_20(spark: SparkSession, d: str) -> DataFrame:
    return _partners(spark, d, 20)


# 3 ------------------------------------------------------------------------------------------------------------------

_OVERLAPS = r"""latest AS (
  SELECT sample_index, arg_max({'h': in_holdout, 's': status, 'u': top_up_genes, 'd': top_down_genes, 'uz': top_up_z, 'dz': top_down_z}, ingested_at) AS r
  FROM per_sample_de WHERE sample_index IS NOT NULL AND in_holdout IS NOT NULL GROUP BY 1),
tok AS (
  SELECT sample_index, h, side, g, z::DOUBLE AS z FROM (
    SELECT sample_index, r.h AS h, '+' AS side, unnest(r.u) AS g, unnest(r.uz) AS z FROM latest WHERE r.s = 'ok'
    UNION ALL SELECT sample_index, r.h, '-', unnest(r.d), unnest(r.dz) FROM latest WHERE r.s = 'ok')),
n AS (SELECT sample_index, h, count(*) AS n FROM tok GROUP BY ALL),
met AS (
  SELECT a.sample_index AS a, b.sample_index AS b, count(*) AS n_both, count_if(abs(a.z - b.z) < 0.05 * greatest(abs(a.z), abs(b.z))) AS near
  FROM tok a JOIN tok b ON a.side = b.side AND a.g = b.g AND a.h AND NOT b.h GROUP BY 1, 2),
pairs AS (
  SELECT a, b, 'profile' AS how FROM met JOIN n x ON x.sample_index = a JOIN n y ON y.sample_index = b WHERE near = n_both AND n_both >= 0.8 * (x.n + y.n - n_both) - 1e-9
  UNION SELECT x.sample_index, y.sample_index, 'accession' FROM per_sample_de x JOIN per_sample_de y
    ON upper(trim(x.geo_accession, E' \t\n\r')) = upper(trim(y.geo_accession, E' \t\n\r')) AND x.in_holdout AND NOT y.in_holdout AND trim(x.geo_accession, E' \t\n\r') <> '' AND x.sample_index <> y.sample_index)"""


@query("p3_found", f"WITH {_OVERLAPS} SELECT DISTINCT least(a, b) AS sample_index_a, greatest(a, b) AS sample_index_b FROM pairs")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.sample_pairs(table(spark, d, "per_sample_de"))


@query(
    "p3_report",
    rf"""WITH {_OVERLAPS}, one AS (SELECT DISTINCT a, b FROM pairs),
    sides AS (SELECT 'evaluation' AS split, a AS sample_index, count(*) AS links FROM one GROUP BY ALL UNION ALL SELECT 'training', b, count(*) FROM one GROUP BY ALL),
    series AS (SELECT DISTINCT sample_index, unnest(list_filter(regexp_split_to_array(upper(series_id), '[\s,;|/+&]+'), lambda x: x <> '')) AS series_id FROM per_sample_de)
    SELECT split, series_id, count(*) AS n_samples, sum(links)::BIGINT AS n_links FROM sides JOIN series USING (sample_index) GROUP BY 1, 2""",
)
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlap_report(table(spark, d, "per_sample_de"))


# 4 ------------------------------------------------------------------------------------------------------------------


def _ok_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generation_results").where("status = 'ok'")


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return answer_defects.answer_defects(_ok_lines(spark, d)).select("line_no", "defect")


@query("p4_all_defects")
def p4_all_defects(spark: SparkSession, d: str) -> DataFrame:
    return answer_defects.answer_defects(_ok_lines(spark, d)).select("line_no", F.explode("defects").alias("defect"))


# 6 ------------------------------------------------------------------------------------------------------------------

_PLAN = r"""goal AS (
  SELECT batch_id, trim(regexp_replace(lower(tissue_coarse), '[^a-z0-9]+', ' ', 'g')) AS cat, max(tissue_coarse) AS tissue_coarse, max(greatest(coalesce(target, 0), 0)) AS target,
    max(greatest(coalesce(min_rows, 0), 0)) AS min_rows, max(greatest(coalesce(draw_size, 0), 0)) AS draw_size FROM plan_target WHERE batch_id IS NOT NULL AND tissue_coarse IS NOT NULL GROUP BY 1, 2),
cand AS (SELECT DISTINCT batch_id, trim(regexp_replace(lower(tissue_coarse), '[^a-z0-9]+', ' ', 'g')) AS cat, patient, template_index FROM generation_plan
  WHERE batch_id IS NOT NULL AND tissue_coarse IS NOT NULL AND patient IS NOT NULL),
have AS (SELECT batch_id, cat, count(*) AS available FROM cand GROUP BY 1, 2),
report AS (SELECT batch_id, cat, tissue_coarse, target, min_rows, coalesce(available, 0) AS available, greatest(greatest(target, min_rows) - coalesce(available, 0), 0) AS shortfall FROM goal LEFT JOIN have USING (batch_id, cat)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id, cat ORDER BY h, patient, template_index) AS rnk FROM (
    SELECT *, ('0x' || substr(md5(concat_ws('|', 'draw', batch_id::VARCHAR, cat, patient, template_index::VARCHAR)), 1, 15))::BIGINT AS h FROM cand)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY priority, rnk, cat) AS place FROM (
    SELECT *, CASE WHEN rnk <= min_rows THEN -1.0::DOUBLE ELSE (rnk - 0.5::DOUBLE) / greatest(target::DOUBLE, 1e-9::DOUBLE) END AS priority
    FROM ranked JOIN goal USING (batch_id, cat) WHERE rnk <= draw_size AND (target > 0 OR rnk <= min_rows)) QUALIFY place <= draw_size)"""


def _plan(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "generation_plan"), table(spark, d, "plan_target"), "batch_id", "tissue_coarse", ["patient", "template_index"]


@query("p6_found", f"WITH {_PLAN} SELECT batch_id, tissue_coarse FROM report WHERE shortfall > 0")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return target_sample.draw_report(*_plan(spark, d)).where("shortfall > 0").select("batch_id", "tissue_coarse")


@query("p6_draw", f"WITH {_PLAN} SELECT batch_id, tissue_coarse, patient, template_index, rnk AS rank FROM placed")
def p6_draw(spark: SparkSession, d: str) -> DataFrame:
    return target_sample.draw(*_plan(spark, d))


@query("p6_report", f"WITH {_PLAN}, got AS (SELECT batch_id, cat, count(*) AS drawn FROM placed GROUP BY 1, 2) SELECT batch_id, tissue_coarse, target, min_rows, available, shortfall, coalesce(drawn, 0) AS drawn FROM report LEFT JOIN got USING (batch_id, cat)")
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return target_sample.draw_report(*_plan(spark, d))


# 7 ------------------------------------------------------------------------------------------------------------------


def _canon(x: str) -> str:
    """RE2 has no look-around: marks stand for the points and minuses that stay."""
    kept = rf"regexp_replace(lower({x}), '([0-9])[.]([0-9])', '\1\x01\2', 'g')".replace(r"\x01", "〇")
    kept = rf"regexp_replace({kept}, '([0-9])[.]([0-9])', '\1〇\2', 'g')"
    kept = rf"regexp_replace({kept}, '-([0-9])', '〡\1', 'g')"
    return rf"translate(regexp_replace({kept}, '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), '〇〡', '.-')"


_MARK = r"(?:[:=]|[\s\x{A0}][-\x{2013}\x{2014}][\s\x{A0}])"
_NAMED = r"[^\p{L}\p{N};|,/\r\n]*\p{L}[\p{L}\p{N}_ \t\x{A0}]*" + _MARK
_PARTS = rf"string_split(regexp_replace(gt_answer, '[;|,/\r\n]+({_NAMED})', '〢\1', 'g'), '〢')"
_FIELDS = f"WHEN len({_PARTS}) >= 2 AND regexp_matches(gt_answer, '^[\\s;|,/]*{_NAMED}') THEN array_to_string(list_sort(list_filter(list_transform({_PARTS}, lambda x: {_canon('x')}), lambda x: x <> '')), chr(1))"


_COPIES = rf"""ok AS (SELECT line_no, {_canon("coalesce(category, '')")} AS c, {_canon("coalesce(paraphrased_answer, '')")} AS a,
  CASE {_FIELDS} ELSE {_canon("coalesce(gt_answer, '')")} END AS g, category, gt_answer, paraphrased_answer
  FROM generation_results WHERE status = 'ok'),
rec AS (SELECT c, g, a, min(line_no) AS first_line, count(*) AS copies, count(DISTINCT (category, gt_answer, paraphrased_answer)) AS variants FROM ok GROUP BY 1, 2, 3)"""


def _collapsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return collapse.collapse_formatting(_ok_lines(spark, d), "line_no", ["category", "gt_answer", "paraphrased_answer"], ["gt_answer"])


@query("p7_found", f"WITH {_COPIES} SELECT line_no, first_line AS first_line_no FROM ok JOIN rec USING (c, g, a) WHERE copies > 1")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d)[1].select(F.col("line").alias("line_no"), F.col("first_line").alias("first_line_no"))


@query("p7_records", f"WITH {_COPIES} SELECT first_line, copies, variants FROM rec")
def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d)[0].select("first_line", "copies", "variants")


# 8 ------------------------------------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}]', '', 'g')), '[\p{L}\p{N}]+')"
_PASSAGES = f"""dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM eval_item),
dg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw)),
leak AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (p))"""


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "documents"), table(spark, d, "eval_item")


@query("p8_found", f"WITH {_PASSAGES} SELECT doc_id, item_id FROM leak")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(*_texts(spark, d))


@query("p8_edited")
def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(*_texts(spark, d), max_edits=2)


@query(
    "p8_report",
    f"""WITH {_PASSAGES} SELECT benchmark, held_out, count(DISTINCT i.item_id) AS n_items, count(DISTINCT leak.item_id) AS n_leaked, count(DISTINCT doc_id) AS n_documents
    FROM eval_item i LEFT JOIN leak ON leak.item_id = i.item_id GROUP BY 1, 2""",
)
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(*_texts(spark, d))


# 9 ------------------------------------------------------------------------------------------------------------------

_MIX = r"""docs AS (SELECT doc_id, nullif(lower(trim(source, E' \t\n\r')), '') AS src, greatest(coalesce(n_tokens, 0), 0) AS w FROM documents),
tok AS (SELECT src, sum(w)::BIGINT AS tokens FROM docs WHERE src IS NOT NULL GROUP BY 1),
goal AS (SELECT mix_id, nullif(lower(trim(source, E' \t\n\r')), '') AS src, sum(coalesce(target_weight, 0)) AS weight, max(coalesce(max_repeat, 0)) AS max_repeat FROM mix_target WHERE mix_id IS NOT NULL GROUP BY 1, 2),
plan AS (SELECT mix_id, src, weight, max_repeat, coalesce(tokens, 0) AS tokens, weight * (SELECT sum(w) FROM docs) AS wanted, max_repeat * coalesce(tokens, 0) AS most FROM goal LEFT JOIN tok USING (src) WHERE src IS NOT NULL),
plan2 AS (SELECT *, least(wanted, most::DOUBLE) AS budget, CASE WHEN tokens > 0 THEN floor(least(wanted, most::DOUBLE) / tokens)::INTEGER ELSE 0 END AS copies FROM plan),
cum AS (SELECT mix_id, doc_id, src, w, copies, budget - copies * tokens AS rest, sum(w) OVER (PARTITION BY mix_id, src ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM plan2 JOIN (SELECT *, ('0x' || substr(md5('mix|' || doc_id), 1, 15))::BIGINT AS h FROM docs) USING (src)),
sel AS (SELECT mix_id, doc_id, src AS source, w AS tokens, copies + CASE WHEN rest > 0 AND upto - w / 2 <= rest THEN 1 ELSE 0 END AS times FROM cum)"""


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "documents"), table(spark, d, "mix_target")


@query("p9_found", f"WITH {_MIX} SELECT mix_id, src AS source FROM plan2 WHERE wanted > most")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(*_mix(spark, d)).where("short").select("mix_id", "source")


@query("p9_selection", f"WITH {_MIX} SELECT * FROM sel WHERE times > 0")
def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_selection(*_mix(spark, d))


@query(
    "p9_shares",
    f"""WITH {_MIX}, used AS (SELECT mix_id, source AS src, sum(tokens * times)::BIGINT AS used FROM sel GROUP BY 1, 2)
    SELECT mix_id, src AS source, round(weight, 6) AS target_weight, max_repeat, coalesce(used, 0) AS used, round(coalesce(used, 0) / nullif(sum(coalesce(used, 0)) OVER (PARTITION BY mix_id), 0), 6) AS share, wanted > most AS short
    FROM plan2 LEFT JOIN used USING (mix_id, src)""",
)
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(*_mix(spark, d))


# 10 -----------------------------------------------------------------------------------------------------------------


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.text_statistics(table(spark, d, "documents")).where("form <> 'prose'").select("doc_id", "form")


@query("p10_statistics")
def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.text_statistics(table(spark, d, "documents"))
