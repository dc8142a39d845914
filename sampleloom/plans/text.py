"""Queries of the scalar functions (X) and of the text verifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.functions import answers as an
from sampleloom.functions import conversations as cv
from sampleloom.functions import labels as lb
from sampleloom.plans.common import DE, EMB, EXPR, de, emb, expr
from sampleloom.registry import query
from sampleloom.session import table

_NETS = {"cardiac": ["heart", "cardio", "myocard", "ventric"], "immune": ["monocyt", "whole blood", "immun"], "method": ["cross-validation", "elastic net", "mixed model"]}
_RE = {k: "|".join(v) for k, v in _NETS.items()}
_HAY = "hay AS (SELECT doc_id, lower(coalesce(source, '') || ' || ' || coalesce(text, '')) AS h FROM documents)"


def hay(s, d):
    return table(s, d, "documents").select("doc_id", lb.haystack(F.col("source"), F.col("text")).alias("h"))


@query("x01_keyword_net", f"WITH {_HAY} SELECT doc_id, regexp_matches(h, '{_RE['cardiac']}') AS hit FROM hay")
def x01(s, d):
    return hay(s, d).select("doc_id", lb.net(F.col("h"), _NETS["cardiac"]).alias("hit"))


@query("x02_first_category", f"WITH {_HAY} SELECT doc_id, CASE WHEN regexp_matches(h, '{_RE['cardiac']}') THEN 'cardiac' WHEN regexp_matches(h, '{_RE['immune']}') THEN 'immune' WHEN regexp_matches(h, '{_RE['method']}') THEN 'method' ELSE 'other' END AS category FROM hay")
def x02(s, d):
    return hay(s, d).select("doc_id", lb.first_category(F.col("h"), _NETS, "other").alias("category"))


@query("x03_all_categories", f"WITH {_HAY} SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(h, '{_RE['cardiac']}') THEN 'cardiac' END, CASE WHEN regexp_matches(h, '{_RE['immune']}') THEN 'immune' END, CASE WHEN regexp_matches(h, '{_RE['method']}') THEN 'method' END) AS categories FROM hay")
def x03(s, d):
    return hay(s, d).select("doc_id", F.array_join(lb.all_categories(F.col("h"), _NETS), ",").alias("categories"))


@query("x04_gated_subtype", f"WITH {_HAY} SELECT doc_id, CASE WHEN regexp_matches(h, '{_RE['cardiac']}') THEN CASE WHEN contains(h, 'failure') THEN 'heart_failure' WHEN contains(h, 'ischemi') THEN 'ischemic' ELSE 'unspecified' END ELSE '' END AS subtype FROM hay")
def x04(s, d):
    sub = lb.first_category(F.col("h"), {"heart_failure": ["failure"], "ischemic": ["ischemi"]}, "unspecified")
    return hay(s, d).select("doc_id", lb.gated(lb.net(F.col("h"), _NETS["cardiac"]), sub).alias("subtype"))


@query("x05_haystack", f"WITH {_HAY} SELECT doc_id, md5(h) AS h FROM hay")
def x05(s, d):
    return hay(s, d).select("doc_id", F.md5("h").alias("h"))


@query("x06_patient_id", r"""WITH v AS (SELECT doc_id, trim(lower(regexp_extract(text, '(?i)(?:^|[,;\n])\s*(?:donor|patient)\s*[:=]\s*([^,;\n]*)', 1))) AS v FROM documents) SELECT doc_id, CASE WHEN v NOT IN ('', 'na', 'n/a', 'none', 'null', 'unknown', 'not available', 'not provided', 'not applicable', '--', '-', '?') THEN v END AS patient FROM v""")
def x06(s, d):
    return table(s, d, "documents").select("doc_id", lb.patient_id(F.col("text"), ["donor", "patient"]).alias("patient"))


@query("x07_patient_key", "SELECT sample_index, coalesce(CASE WHEN has_resolved_patient THEN series_id || '::' || patient_key END, '__unresolved__::' || geo_accession) AS key FROM sample_labels")
def x07(s, d):
    return table(s, d, "sample_labels").select("sample_index", lb.patient_key(F.col("series_id"), F.when(F.col("has_resolved_patient"), F.col("patient_key")), F.col("geo_accession")).alias("key"))


@query("x09_coarse_tissue", "WITH t AS (SELECT plan_row, trim(regexp_replace(lower(tissue_coarse), '[^a-z0-9]+', ' ', 'g')) AS t FROM generation_plan) SELECT plan_row, CASE WHEN coalesce(t, '') = '' THEN 'unspecified' WHEN regexp_matches(t, 'heart|cardio') THEN 'heart' WHEN regexp_matches(t, 'arter|endoth|vein') THEN 'vessel' WHEN regexp_matches(t, 'blood') THEN 'blood' ELSE 'other' END AS tissue FROM t")
def x09(s, d):
    from sampleloom.functions.text import simple_words

    return table(s, d, "generation_plan").select("plan_row", lb.coarse(simple_words(F.col("tissue_coarse")), [("heart|cardio", "heart"), ("arter|endoth|vein", "vessel"), ("blood", "blood")]).alias("tissue"))


@query("x10_lenient_year", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders")
def x10(s, d):
    t = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("t"))
    return t.select("o_orderkey", lb.lenient_year(F.col("t")).alias("year"))


@query("x11_logs", f"WITH {EXPR} SELECT sample_index, gene, round(log2(n + 1), 8) AS log2p1, round(log10(greatest(n, 1)), 8) AS log10, round(ln(1 + n), 8) AS log1p FROM expr")
def x11(s, d):
    n = F.col("n").cast("double")
    return expr(s, d).select("sample_index", "gene", F.round(F.log2(n + 1), 8).alias("log2p1"), F.round(F.log10(F.greatest(n, F.lit(1.0))), 8).alias("log10"), F.round(F.log1p(n), 8).alias("log1p"))


@query("x12_tpm", f"WITH {EXPR}, r AS (SELECT sample_index, gene, n / (p_size / 10.0::DOUBLE) AS r FROM expr JOIN part ON p_partkey = gene), t AS (SELECT sample_index, sum(r) AS t FROM r GROUP BY 1) SELECT sample_index, gene, round(ln(1 + r / (CASE WHEN t = 0 THEN 1e-6 ELSE t END) * 1e6), 6) AS tpm FROM r JOIN t USING (sample_index)")
def x12(s, d):
    from sampleloom.stats.expression import tpm

    return tpm(expr(s, d), table(s, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") / 10.0).alias("length_kb"))).select("sample_index", "gene", F.round(F.log1p("tpm"), 6).alias("tpm"))


@query("x14_fold_change", f"WITH {EMB}, r AS (SELECT gene, avg(v) AS m FROM emb GROUP BY 1) SELECT sample_index, gene, round((v - m) / ln(2), 4)::DOUBLE AS log2fc FROM emb JOIN r USING (gene)")
def x14(s, d):
    x = emb(s, d)
    return x.join(x.groupBy("gene").agg(F.avg("v").alias("m")), "gene").select("sample_index", "gene", F.round((F.col("v") - F.col("m")) / F.log(F.lit(2.0)), 4).alias("log2fc"))


@query("x18_capped_z", f"WITH {DE} SELECT sample_index, CASE WHEN max_abs_z > 12 THEN '> 12' ELSE printf('%.2f', round(max_abs_z::DOUBLE, 2)) END AS z FROM de WHERE max_abs_z IS NOT NULL")
def x18(s, d):
    return de(s, d).where("max_abs_z is not null").select("sample_index", an.capped_z(F.col("max_abs_z").cast("double"), 12.0).alias("z"))


@query("x19_template", "SELECT plan_row, replace(replace('For {patient} answer item {n} of the list.', '{patient}', coalesce(patient, '')), '{n}', template_index::VARCHAR) AS text FROM generation_plan")
def x19(s, d):
    return table(s, d, "generation_plan").select("plan_row", an.fill(F.lit("For {patient} answer item {n} of the list."), {"patient": F.col("patient"), "n": F.col("template_index")}).alias("text"))


@query("x20_rendered", f"WITH {DE} SELECT sample_index, array_to_string(list_transform(list_zip(top_up_genes, top_up_z), lambda x: x[1] || ' (' || printf('%.3f', x[2]::DOUBLE) || ')'), ', ') AS answer FROM de WHERE status = 'ok'")
def x20(s, d):
    return de(s, d).where("status = 'ok'").select("sample_index", an.named_values(F.col("top_up_genes"), F.col("top_up_z")).alias("answer"))


@query("x21_prompt", "SELECT line_no, 'Rewrite. QUESTION: ' || coalesce(filled_question, '') || ' ANSWER: ' || coalesce(gt_answer, '') AS prompt FROM generation_results")
def x21(s, d):
    return table(s, d, "generation_results").select("line_no", an.fill(F.lit("Rewrite. QUESTION: {q} ANSWER: {a}"), {"q": F.col("filled_question"), "a": F.col("gt_answer")}).alias("prompt"))


_LABEL = r"(?i)^[^\p{L}\p{N}]*(question|answer)[^\p{L}\p{N}]*:[\s\x{A0}]*"
_BLANKS = r"(E' \t\n\r' || chr(160))"


@query(
    "x22_completion",
    f"""WITH t AS (SELECT line_no, '**QUESTION:** ' || paraphrased_question || chr(10) || 'ANSWER: ' || paraphrased_answer AS t FROM generation_results),
    l AS (SELECT line_no, unnest(range(len(string_split(t, chr(10))))) AS i, unnest(string_split(t, chr(10))) AS line FROM t WHERE t IS NOT NULL),
    m AS (SELECT *, lower(regexp_extract(line, '{_LABEL}', 1)) AS lab, trim(regexp_replace(line, '{_LABEL}', ''), {_BLANKS}) AS rest FROM l),
    c AS (SELECT *, last_value(nullif(lab, '') IGNORE NULLS) OVER (PARTITION BY line_no ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM m WHERE lab <> '' OR trim(line, {_BLANKS}) <> ''),
    p AS (SELECT line_no, trim(trim(coalesce(string_agg(rest, ' ' ORDER BY i) FILTER (part = 'question'), ''), {_BLANKS}), ' *_') AS q, trim(trim(coalesce(string_agg(rest, ' ' ORDER BY i) FILTER (part = 'answer'), ''), {_BLANKS}), ' *_') AS a FROM c GROUP BY 1)
    SELECT t.line_no, CASE WHEN t IS NULL THEN 'error' WHEN q = '' OR a = '' THEN 'error' WHEN regexp_matches(a, '(?i)^[^\\p{{L}}\\p{{N}}_]*skip\\b') THEN 'skip' ELSE 'ok' END AS status, nullif(q, '') AS question,
      CASE WHEN regexp_matches(a, '(?i)^[^\\p{{L}}\\p{{N}}_]*skip\\b') AND q <> '' THEN NULL ELSE nullif(a, '') END AS answer, CASE WHEN t IS NULL THEN 'empty' WHEN q = '' OR a = '' THEN 'missing label' WHEN regexp_matches(a, '(?i)^[^\\p{{L}}\\p{{N}}_]*skip\\b') THEN 'skip in answer' END AS anomaly
    FROM t LEFT JOIN p USING (line_no)""",
)
def x22(s, d):
    g = table(s, d, "generation_results").select("line_no", F.concat(F.lit("**QUESTION:** "), "paraphrased_question", F.lit("\nANSWER: "), "paraphrased_answer").alias("t"))
    return g.select("line_no", an.parse_completion("t").alias("p")).select("line_no", "p.*")


def polarity_sql(c: str) -> str:
    t = f"lower(trim(coalesce({c}, '')))"
    q = lambda r: r.replace("'", "''")
    lead = f"regexp_extract({t}, '^(yes|no|status\\s*:\\s*\\w+|disease[- ]?(?:positive|unconfirmed))\\b', 1)"
    pos = f"regexp_matches(regexp_replace({t}, '\\b(?:unconfirmed|non[- ]?confirmed)\\b', ' ', 'g'), '{q(an.POSITIVE)}')"
    neg = f"regexp_matches({t}, '{q(an.NEGATIVE)}')"
    governed = f"regexp_matches({t}, '{q(an.NEGATIVE)}[^.]{{0,60}}{q(an.DISEASE)}|{q(an.DISEASE)}[^.]{{0,60}}{q(an.NEGATIVE)}')"
    return f"CASE WHEN {lead} LIKE 'yes%' THEN 'pos' WHEN {lead} = 'no' OR {lead} LIKE '%unconfirmed%' THEN 'neg' WHEN regexp_matches({lead}, 'positive|confirmed') THEN 'pos' WHEN {neg} AND NOT {pos} THEN 'neg' WHEN {pos} AND NOT {neg} THEN 'pos' WHEN {pos} AND {neg} AND {governed} THEN 'neg' ELSE 'undetermined' END"


@query("x23_polarity", f"SELECT line_no, {polarity_sql('paraphrased_answer')} AS polarity FROM generation_results")
def x23(s, d):
    return table(s, d, "generation_results").select("line_no", an.polarity(F.col("paraphrased_answer")).alias("polarity"))


@query("x23_polarity_documents", f"SELECT doc_id, {polarity_sql('text')} AS polarity FROM documents")
def x23d(s, d):
    return table(s, d, "documents").select("doc_id", an.polarity(F.col("text")).alias("polarity"))


@query("x24_overclaim", f"SELECT doc_id, regexp_matches(lower(text), '{an.OVERCLAIMS}') AS overclaims FROM documents")
def x24(s, d):
    return table(s, d, "documents").select("doc_id", an.overclaims(F.col("text")).alias("overclaims"))


_SYM = "list_filter(list_distinct(regexp_extract_all(coalesce({c}, ''), '[A-Z][A-Z0-9]{{2,14}}(?:-AS[0-9])?')), lambda x: x NOT IN ('DNA', 'RNA', 'TPM', 'CVD', 'GSM'))"
_NUM = "list_distinct(regexp_extract_all(coalesce({c}, ''), '[0-9]+(?:[.][0-9]+)?'))"


@query("x25_factual_check", f"WITH g AS (SELECT line_no, {_SYM.format(c='gt_answer')} AS gs, {_SYM.format(c='paraphrased_answer')} AS as_, {_NUM.format(c='gt_answer')} AS gn, {_NUM.format(c='paraphrased_answer')} AS an FROM generation_results WHERE status = 'ok') SELECT line_no, len(list_filter(as_, lambda x: NOT list_contains(gs, x))) AS invented, len(list_filter(gs, lambda x: NOT list_contains(as_, x))) AS dropped, len(list_filter(an, lambda x: NOT list_contains(gn, x))) AS new_numbers FROM g")
def x25(s, d):
    g, a = F.col("gt_answer"), F.col("paraphrased_answer")
    n = lambda x, y: F.size(F.array_except(x, y)).cast("long")
    return table(s, d, "generation_results").where("status = 'ok'").select("line_no", n(an.symbols(a), an.symbols(g)).alias("invented"), n(an.symbols(g), an.symbols(a)).alias("dropped"), n(an.numbers(a), an.numbers(g)).alias("new_numbers"))


@query("x26_symbol_recall", f"WITH g AS (SELECT line_no, {_SYM.format(c='gt_answer')} AS gs, {_SYM.format(c='paraphrased_answer')} AS as_ FROM generation_results WHERE status = 'ok') SELECT line_no, round(len(list_intersect(gs, as_)) / greatest(len(gs), 1), 8) AS recall FROM g")
def x26(s, d):
    return table(s, d, "generation_results").where("status = 'ok'").select("line_no", F.round(an.recall(an.symbols(F.col("paraphrased_answer")), an.symbols(F.col("gt_answer"))), 8).alias("recall"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}. ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("x27_exact_match", f"SELECT line_no, {_NORM.format(c='paraphrased_question')} = {_NORM.format(c='filled_question')} AS same FROM generation_results")
def x27(s, d):
    return table(s, d, "generation_results").select("line_no", (an.normalise(F.col("paraphrased_question")) == an.normalise(F.col("filled_question"))).alias("same"))


_PRINTS = {"magnitude:": "magnitude_reasoning", "subtype:": "disease_subtype_classification", "closest partners": "interaction_network_query", "log2 ratio": "comparative_query", "in falling order": "ranking_ordering_query", "signature genes": "gene_driver_reasoning", "is raised most": "comparative_differential_reasoning", "genes lie": "threshold_query", "reads": "direct_abundance_query"}


@query("x28_fingerprint", "SELECT line_no, CASE " + " ".join(f"WHEN contains(lower(gt_answer), '{k}') THEN '{c}'" for k, c in _PRINTS.items()) + " ELSE 'other' END AS category FROM generation_results")
def x28(s, d):
    c = F.coalesce(*(F.when(F.contains(F.lower("gt_answer"), F.lit(k)), c) for k, c in _PRINTS.items()), F.lit("other"))
    return table(s, d, "generation_results").select("line_no", c.alias("category"))


@query("x29_mined_labels", "SELECT label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(gt_answer, '(?:subtype|magnitude): ([a-z ]+)', 1)) AS label FROM generation_results) GROUP BY 1")
def x29(s, d):
    return table(s, d, "generation_results").select(F.explode(F.regexp_extract_all("gt_answer", F.lit("(?:subtype|magnitude): ([a-z ]+)"), F.lit(1))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("x30_softmax", f"WITH {DE} SELECT sample_index, round(CASE WHEN a - b >= 0 THEN 1 / (1 + exp(b - a)) ELSE exp(a - b) / (1 + exp(a - b)) END, 8) AS p FROM (SELECT sample_index, max_abs_z::DOUBLE AS a, n_genes_compared::DOUBLE / 500 AS b FROM de WHERE status = 'ok')")
def x30(s, d):
    x = de(s, d).where("status = 'ok'").select("sample_index", F.col("max_abs_z").cast("double").alias("a"), (F.col("n_genes_compared").cast("double") / 500).alias("b"))
    return x.select("sample_index", F.round(an.two_way_softmax(F.col("a"), F.col("b")), 8).alias("p"))


@query("x31_option_orders", "WITH v AS (SELECT unnest(['direct', 'choice']) AS variant), o AS (SELECT unnest(['ab', 'ba']) AS option_order) SELECT item_id, variant, option_order, CASE option_order WHEN 'ab' THEN 'A. yes B. no' ELSE 'A. no B. yes' END AS options FROM eval_item, v, o")
def x31(s, d):
    x = table(s, d, "eval_item").select("item_id", F.explode(F.array(F.lit("direct"), F.lit("choice"))).alias("variant")).withColumn("option_order", F.explode(F.array(F.lit("ab"), F.lit("ba"))))
    return x.withColumn("options", F.when(F.col("option_order") == "ab", "A. yes B. no").otherwise("A. no B. yes"))


_TOK = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"


@query("x32_answer_span", f"WITH t AS (SELECT line_no, {_TOK.format(c='filled_question')} AS q, {_TOK.format(c='gt_answer')} AS a FROM generation_results) SELECT line_no, len(a)::INTEGER AS n, a[1] AS first FROM t")
def x32(s, d):
    q, a = cv.tokens(F.col("filled_question")), cv.tokens(F.col("gt_answer"))
    t = table(s, d, "generation_results").select("line_no", cv.answer_span(F.concat(q, a), q).alias("span"))
    return t.select("line_no", F.size("span").alias("n"), F.get("span", F.lit(0)).alias("first"))


_VQA = r"""regexp_replace(replace(regexp_replace(regexp_replace(lower(paraphrased_answer), '([0-9])[.]', '\1〇', 'g'), '[.]([0-9])', '〇\1', 'g'), '.', ' '), '[;/\[\]"{}()=+\\_<>@`,?!\n]', ' ', 'g')"""
_VQA_NUMBERS = "MAP {" + ", ".join(f"'{w}': '{n}'" for w, n in an._NUMBERS.items()) + "}"


@query("x33_vqa_normalised", f"SELECT line_no, array_to_string(list_transform(list_filter(regexp_split_to_array(replace({_VQA}, '〇', '.'), '[ \\t\\n\\r\\f\\v]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), lambda w: coalesce(({_VQA_NUMBERS})[w], w)), ' ') AS answer FROM generation_results")
def x33(s, d):
    return table(s, d, "generation_results").select("line_no", an.vqa_normalised(F.col("paraphrased_answer")).alias("answer"))


@query("x34_yes_no", "WITH w AS (SELECT line_no, string_split(replace(string_split(lower(paraphrased_answer), '.')[1], ',', ''), ' ') AS w FROM generation_results WHERE paraphrased_answer IS NOT NULL) SELECT line_no, CASE WHEN list_contains(w, 'no') OR list_contains(w, 'not') THEN 'no' ELSE 'yes' END AS verdict FROM w")
def x34(s, d):
    return table(s, d, "generation_results").where("paraphrased_answer is not null").select("line_no", an.yes_no(F.col("paraphrased_answer")).alias("verdict"))


@query("x35_choice_letter", r"WITH t AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C. because' WHEN 2 THEN 'The answer is D.' ELSE 'unsure' END AS t FROM eval_item) SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' END AS letter FROM t")
def x35(s, d):
    m = F.col("item_id") % 4
    t = F.when(m == 0, "B").when(m == 1, "C. because").when(m == 2, "The answer is D.").otherwise("unsure")
    return table(s, d, "eval_item").select("item_id", an.choice_letter(t).alias("letter"))


_OPTIONS = {"A": "heart failure", "B": "valve stenosis", "C": "myocarditis", "D": "pressure overload", "E": "ischemic disease"}
_ENDS = ", ".join(f"CASE WHEN contains(low, '{o}') THEN {{'p': length(t) - instr(reverse(low), '{o[::-1]}'), 'c': '{c}'}} END" for c, o in _OPTIONS.items())


@query("x36_last_choice", f"""WITH x AS (SELECT doc_id, ' ' || regexp_replace(text, '[,.!?;:'']+', ' ', 'g') || ' ' AS t FROM documents), y AS (SELECT doc_id, t, lower(t) AS low FROM x)
SELECT doc_id, coalesce(regexp_extract_all(t, '\\(([A-E])\\)', 1)[-1], regexp_extract_all(regexp_replace(t, '([ \\t\\n\\r\\f\\v])', '\\1\\1', 'g'), '[ \\t\\n\\r\\f\\v]([A-E])[ \\t\\n\\r\\f\\v]', 1)[-1],
  CASE WHEN len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) > 5 THEN list_max(list_filter([{_ENDS}], lambda e: e IS NOT NULL)).c END,
  substr('ABCDE', (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5)::INTEGER + 1, 1)) AS letter FROM y""")
def x36(s, d):
    return table(s, d, "documents").select("doc_id", an.last_choice(F.col("text"), _OPTIONS, F.col("doc_id")).alias("letter"))


@query("x37_question_of_prompt", "SELECT line_no, regexp_extract(filled_question, '^([^?]*[?])', 1) AS question FROM generation_results")
def x37(s, d):
    return table(s, d, "generation_results").select("line_no", F.regexp_extract("filled_question", "^([^?]*[?])", 1).alias("question"))


@query("x38_anls", "WITH x AS (SELECT line_no, lower(trim(paraphrased_question, ' ')) AS a, lower(trim(filled_question, ' ')) AS b FROM generation_results WHERE status = 'ok'), y AS (SELECT line_no, 1 - levenshtein(a, b) / greatest(length(a), length(b), 1) AS s FROM x) SELECT line_no, round(CASE WHEN s >= 0.5 THEN s ELSE 0 END, 8)::DOUBLE AS anls FROM y")
def x38(s, d):
    return table(s, d, "generation_results").where("status = 'ok'").select("line_no", F.round(an.anls(F.col("paraphrased_question"), F.col("filled_question")), 8).alias("anls"))


@query("x39_turn_split", "SELECT line_no, filled_question AS question, gt_answer AS answer FROM generation_results")
def x39(s, d):
    t = table(s, d, "generation_results").select("line_no", cv.turns(F.col("filled_question"), F.col("gt_answer")).alias("c"))
    return t.select("line_no", F.get(cv.questions(F.col("c")), F.lit(0)).alias("question"), F.get(cv.answers(F.col("c")), F.lit(0)).alias("answer"))


@query("x40_rendered_prompt", "SELECT line_no, 'Be brief. USER: <image>' || chr(10) || trim(filled_question, ' ') || ' ASSISTANT: ' || gt_answer || '</s>' AS prompt FROM generation_results")
def x40(s, d):
    q = F.concat(F.col("filled_question"), F.lit(" <image>"))
    return table(s, d, "generation_results").select("line_no", cv.prompt(q, F.col("gt_answer"), "Be brief.").alias("prompt"))


@query("x41_supervision_mask", f"WITH t AS (SELECT line_no, {_TOK.format(c='filled_question')} AS q, {_TOK.format(c='gt_answer')} AS a FROM generation_results) SELECT line_no, array_to_string(list_concat(list_transform(q, lambda x: '-100'), a), ' ') AS labels FROM t")
def x41(s, d):
    return table(s, d, "generation_results").select("line_no", F.array_join(cv.supervised(cv.tokens(F.col("filled_question")), cv.tokens(F.col("gt_answer"))), " ").alias("labels"))


@query("x42_image_token", f"WITH t AS (SELECT line_no, {_TOK.format(c='filled_question')} AS q FROM generation_results) SELECT line_no, '-200 ' || array_to_string(q, ' ') AS tokens FROM t")
def x42(s, d):
    return table(s, d, "generation_results").select("line_no", F.array_join(cv.with_image_token(F.concat(F.lit("<image>"), "filled_question")), " ").alias("tokens"))


@query("x43_lengths", f"WITH t AS (SELECT line_no, image IS NOT NULL AS i, len({_TOK.format(c='filled_question')}) + len({_TOK.format(c='gt_answer')}) AS n FROM generation_results) SELECT line_no, CASE WHEN i THEN n + 128 ELSE -n END::INTEGER AS length FROM t")
def x43(s, d):
    return table(s, d, "generation_results").select("line_no", cv.length(F.col("filled_question"), F.col("gt_answer"), F.col("image").isNotNull()).alias("length"))


@query("x44_padded", f"WITH t AS (SELECT line_no, {_TOK.format(c='gt_answer')} AS a FROM generation_results) SELECT line_no, array_to_string(list_resize(a, 12, '<pad>'), ' ') AS tokens FROM t")
def x44(s, d):
    return table(s, d, "generation_results").select("line_no", F.array_join(cv.padded(cv.tokens(F.col("gt_answer")), 12, "<pad>"), " ").alias("tokens"))


@query("x45_best_resolution", """WITH c AS (SELECT * FROM (VALUES (336, 672), (672, 336), (672, 672), (1008, 336)) c(w, h)), p AS (SELECT p_partkey, 200 + p_size * 20 AS iw, 900 - p_size * 10 AS ih FROM part), s AS (SELECT p_partkey, w, h, least(w / iw, h / ih) AS k, iw, ih FROM p, c), e AS (SELECT p_partkey, w, h, least(floor(iw * k) * floor(ih * k), iw * ih) AS eff, w * h - least(floor(iw * k) * floor(ih * k), iw * ih) AS waste FROM s)
SELECT p_partkey, w::INTEGER AS w, h::INTEGER AS h FROM e QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY eff DESC, waste, w, h) = 1""")
def x45(s, d):
    x = table(s, d, "part").select("p_partkey", (F.lit(200) + F.col("p_size") * 20).alias("iw"), (F.lit(900) - F.col("p_size") * 10).alias("ih"))
    tries = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in ((336, 672), (672, 336), (672, 672), (1008, 336))))

    def key(c):
        k = F.least(c["w"] / F.col("iw"), c["h"] / F.col("ih"))
        eff = F.least(F.floor(F.col("iw") * k) * F.floor(F.col("ih") * k), (F.col("iw") * F.col("ih")).cast("long"))
        return F.struct((-eff).alias("a"), (c["w"] * c["h"] - eff).alias("b"), c["w"].alias("w"), c["h"].alias("h"))

    best = F.get(F.array_sort(F.transform(tries, key)), F.lit(0))
    return x.select("p_partkey", best["w"].alias("w"), best["h"].alias("h"))


@query("x46_redacted", "SELECT line_no, replace(id, split_part(id, '__', 1), '***') AS id FROM generation_results")
def x46(s, d):
    return table(s, d, "generation_results").select("line_no", F.replace(F.col("id"), F.substring_index("id", "__", 1), F.lit("***")).alias("id"))


@query("x47_backoff", "SELECT line_no, least(0.5 * 2 ** (attempts - 1), 30)::DOUBLE AS wait FROM generation_results")
def x47(s, d):
    return table(s, d, "generation_results").select("line_no", F.least(F.lit(0.5) * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(30.0)).alias("wait"))


@query("x49_conversation_pairs", "SELECT line_no, 'human' AS first_role, filled_question AS first_value, 'gpt' AS second_role, gt_answer AS second_value FROM generation_results")
def x49(s, d):
    c = table(s, d, "generation_results").select("line_no", cv.turns(F.col("filled_question"), F.col("gt_answer")).alias("c"))
    return c.select("line_no", F.col("c")[0]["from"].alias("first_role"), F.col("c")[0]["value"].alias("first_value"), F.col("c")[1]["from"].alias("second_role"), F.col("c")[1]["value"].alias("second_value"))


@query("x50_tiles", "SELECT p_partkey, x::INTEGER AS x, y::INTEGER AS y FROM (SELECT p_partkey, p_size, unnest(range(0, p_size * 10, 100)) AS x FROM part) t, LATERAL (SELECT unnest(range(0, 300, 100)) AS y)")
def x50(s, d):
    return table(s, d, "part").select("p_partkey", F.explode(cv.tiles(F.col("p_size") * 10, F.lit(300), 100)).alias("t")).select("p_partkey", "t.x", "t.y")
