"""Queries of the remaining inventory: vector folders, nested folds, multi-class probes, clustering, benchmarks, plans."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from sampleloom.functions import answers as an
from sampleloom.operators import sampling, windows
from sampleloom.plans.common import DE, EMB, LAB, de, emb, lab
from sampleloom.qa import questions
from sampleloom.registry import query
from sampleloom.session import shared_dir, table
from sampleloom.sources import sinks, store, vectors
from sampleloom.stats import benchmarks, embedding, expression, learn


@query("s25_vector_folder", "SELECT vec_id, len(embedding)::INTEGER AS width, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def s25(s, d):
    folder = f"{shared_dir(s)}/vectors-{uuid.uuid4().hex[:10]}"
    store.write_vectors(table(s, d, "embeddings"), "vec_id", "embedding", folder).write.format("noop").mode("overwrite").save()
    x = vectors.read_vectors(s, folder, 64)
    return x.select(F.col("key").cast("long").alias("vec_id"), F.size("features").alias("width"), F.round(F.col("features")[0], 6).alias("first"))


@query("x17_strict_integers", "SELECT plan_row, CASE WHEN regexp_matches(trim(entities['n']), '^[+-]?[0-9]+$') AND TRY_CAST(entities['n'] AS BIGINT) BETWEEN 1 AND 8 THEN entities['n']::INTEGER END AS n, CASE WHEN regexp_matches(trim(entities['gene']), '^[+-]?[0-9]+$') THEN 1 END AS gene FROM generation_plan")
def x17(s, d):
    e = F.col("entities")
    return table(s, d, "generation_plan").select("plan_row", questions.strict_integer(e["n"], 1, 8).alias("n"), questions.strict_integer(e["gene"]).alias("gene"))


@query("ask01_registry", "SELECT category, count(*) AS n, category IN ('direct_abundance_query', 'threshold_query', 'ranking_ordering_query', 'comparative_query', 'interaction_network_query', 'disease_subtype_classification', 'comparative_differential_reasoning', 'gene_driver_reasoning', 'magnitude_reasoning') AS known FROM generation_plan GROUP BY 1")
def p01(s, d):
    return table(s, d, "generation_plan").groupBy("category").agg(F.count("*").alias("n")).withColumn("known", F.col("category").isin(sorted(questions.REGISTRY)))


@query("ask13_formats", """SELECT line_no, unnest(['chat', 'instruction', 'plain']) AS format, unnest(['USER: ' || trim(filled_question, ' ') || ' ASSISTANT: ' || gt_answer || '</s>', '### Instruction:' || chr(10) || filled_question || chr(10) || '### Response:' || chr(10) || gt_answer, filled_question || chr(10) || gt_answer]) AS text FROM generation_results""")
def p13(s, d):
    from sampleloom.functions.conversations import FORMATS

    texts = F.array(*(F.struct(F.lit(n).alias("format"), f(F.col("filled_question"), F.col("gt_answer")).alias("text")) for n, f in sorted(FORMATS.items())))
    return table(s, d, "generation_results").select("line_no", F.explode(texts).alias("p")).select("line_no", "p.*")


@query("s34_axis_agreement", f"WITH {DE} SELECT (SELECT count(*) FROM de) = (SELECT count(DISTINCT sample_index) FROM per_sample_de) AS same_samples, (SELECT count(*) FROM de WHERE len(top_up_genes) <> len(top_up_z)) = 0 AS same_lengths")
def s34(s, d):
    x = de(s, d)
    n = table(s, d, "per_sample_de").agg(F.countDistinct("sample_index").alias("m"))
    return x.agg(F.count("*").alias("n"), F.count_if(F.size("top_up_genes") != F.size("top_up_z")).alias("bad")).crossJoin(n).select((F.col("n") == F.col("m")).alias("same_samples"), (F.col("bad") == 0).alias("same_lengths"))


def _unit_sql(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656)"


def _normal_sql(*parts: str) -> str:
    a, b = (_unit_sql(*parts, f"'{x}'") for x in "ab")
    return f"sqrt(-2 * ln({a})) * cos(2 * pi() * {b})"


_G, _S = "gene::VARCHAR", "sample_index::VARCHAR"


@query("s32_synthetic_counts", f"WITH g AS (SELECT unnest(range(200)) AS sample_index), c AS (SELECT sample_index, unnest(range(50))::INTEGER AS gene FROM g), m AS (SELECT *, exp(1.8 * {_normal_sql(_G, chr(39) + 'g' + chr(39))}) * exp(0.5 * {_normal_sql(_S, chr(39) + 's' + chr(39))}) AS mean FROM c) SELECT sample_index, gene, greatest(floor(mean + sqrt(mean) * {_normal_sql(_S, _G)} + 0.5), 0)::BIGINT AS n FROM m")
def s32(s, d):
    """Counts of a synthetic cohort: log-normal gene means and sample scales from hashes, so the same everywhere."""
    def unit(*c):
        return (F.conv(F.substring(F.md5(F.concat_ws("|", *(x.cast("string") for x in c))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))

    def normal(*c):
        return F.sqrt(-2 * F.ln(unit(*c, F.lit("a")))) * F.cos(F.lit(2 * np.pi) * unit(*c, F.lit("b")))

    gene, sample = F.col("gene"), F.col("sample_index")
    grid = s.range(200).withColumnRenamed("id", "sample_index").select("sample_index", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("gene"))
    mean = F.exp(1.8 * normal(gene, F.lit("g"))) * F.exp(0.5 * normal(sample, F.lit("s")))
    return grid.withColumn("mean", mean).select("sample_index", "gene", F.greatest(F.floor(F.col("mean") + F.sqrt("mean") * normal(sample, gene) + 0.5), F.lit(0)).cast("long").alias("n"))


@query("k09_resumed_scan", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def k09(s, d):
    path = f"{shared_dir(s)}/scan-{uuid.uuid4().hex[:10]}"
    rows = table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    rows.where("doc_id % 3 = 0").write.parquet(path)
    done = s.read.parquet(path)
    rows.join(done.select("doc_id"), "doc_id", "left_anti").write.mode("append").parquet(path)
    return s.read.parquet(path)


@query("k12_pretrain_json", "SELECT line_no, '<image>' || chr(10) || filled_question AS question, image FROM generation_results")
def k12p(s, d):
    j = sinks.conversations_json(table(s, d, "generation_results"), "line_no", "filled_question", "gt_answer", "image")
    return j.select("line_no", F.get_json_object("json", "$.conversations[0].value").alias("question"), F.get_json_object("json", "$.image").alias("image"))


@query("x13_differential", f"""WITH {EMB}, g AS (SELECT label, gene, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM emb GROUP BY 1, 2), p AS (SELECT gene, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM emb GROUP BY 1)
SELECT e.sample_index, e.gene, round((v - coalesce(g.m, p.m)) / (coalesce(g.sd, p.sd) + 1e-6), 6) AS z, coalesce(g.n, p.n) AS reference_n, CASE WHEN g.n IS NULL THEN 'pool' ELSE 'tissue' END AS reference_scope FROM emb e LEFT JOIN (SELECT * FROM g WHERE n >= 40) g ON g.label = e.label AND g.gene = e.gene JOIN p ON p.gene = e.gene""")
def x13(s, d):
    return expression.differential(emb(s, d), "label", 40).select("sample_index", "gene", F.round("z", 6).alias("z"), "reference_n", "reference_scope")


@query("x15_size_spec", "SELECT plan_row, CASE WHEN TRY_CAST(entities['n'] AS INTEGER) BETWEEN 1 AND 8 THEN entities['n']::INTEGER END AS k FROM generation_plan")
def x15(s, d):
    return table(s, d, "generation_plan").select("plan_row", questions.size_spec(F.col("entities")["n"], F.lit(8)).alias("k"))


@query("x16_direction", "SELECT plan_row, CASE entities['direction'] WHEN 'up' THEN 'up' WHEN 'down' THEN 'down' END AS direction FROM generation_plan")
def x16(s, d):
    return table(s, d, "generation_plan").select("plan_row", questions.direction(F.col("entities")["direction"]).alias("direction"))


@query("x48_two_token_probability", "SELECT run_id, fold, round(1 / (1 + exp(specificity - sensitivity)), 8) AS p_yes FROM (SELECT DISTINCT run_id, fold, sensitivity, specificity FROM fold_result) WHERE sensitivity IS NOT NULL AND specificity IS NOT NULL")
def x48(s, d):
    f = table(s, d, "fold_result").select("run_id", "fold", "sensitivity", "specificity").distinct().where("sensitivity is not null and specificity is not null")
    return f.select("run_id", "fold", F.round(an.two_way_softmax(F.col("sensitivity"), F.col("specificity")), 8).alias("p_yes"))


def _vectors(s, d):
    x = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label", (F.col("label") < 5).cast("int").alias("y"), F.floor(F.col("vec_id") / 25).alias("series"))
    return x.join(sampling.snake_folds(x, "series", 3, "cv").select("series", "fold"), "series")


@query("m02_nested_folds", f"""WITH {EMB}, x AS (SELECT DISTINCT sample_index, sample_index // 25 AS series FROM emb), g AS (SELECT series, count(*) AS n FROM x GROUP BY 1), o AS (SELECT *, (row_number() OVER (ORDER BY n DESC, md5('cv|' || series)) - 1) % 6 AS k FROM g), f AS (SELECT series, n, CASE WHEN k < 3 THEN k ELSE 5 - k END::INTEGER AS fold FROM o),
i AS (SELECT h.outer_fold, series, n, (row_number() OVER (PARTITION BY h.outer_fold ORDER BY n DESC, md5('in|' || series)) - 1) % 4 AS k FROM f, (SELECT unnest(range(3))::INTEGER AS outer_fold) h WHERE fold <> h.outer_fold) SELECT outer_fold, series::BIGINT AS series, n, CASE WHEN k < 2 THEN k ELSE 3 - k END::INTEGER AS inner_fold FROM i""")
def m02_all(s, d):
    return sampling.nested_folds(_vectors(s, d), "series", "fold", 3, 2, "in")


@query("m06_multiclass_probe")
def m06(s, d):
    p = learn.multiclass_probe(_vectors(s, d), "embedding", "label", "fold", 3, pca=32, reg=0.01)
    return benchmarks.multiclass_auc(p, "label", "p", 10, ["fold"]).select("fold", "class", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


@query("m09_one_condition_probes")
def m09(s, d):
    x, out = _vectors(s, d), None
    for k in range(5):  # a model per condition
        one = x.where((F.col("label") == k) | (F.col("label") >= 5)).withColumn("t", (F.col("label") == k).cast("int"))
        part = learn.fold_auc(learn.probe(one, "embedding", "t", "fold", 3, least=10)).select(F.lit(k).alias("condition"), "fold", F.round("auc", 4).alias("auc"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m21_category_baseline")
def m21(s, d):
    x = lab(s, d).where("series_id is not null").select(F.col("sample_index").alias("key"), F.col("is_cvd_tissue").cast("int").alias("y"), F.col("disease_category").alias("c"), F.upper(F.trim("series_id")).alias("series"))
    names = [r["c"] for r in x.where("c is not null").select("c").distinct().orderBy("c").collect()]  # a dozen categories
    x = x.withColumn("onehot", F.array(*((F.coalesce(F.col("c") == n, F.lit(False))).cast("double") for n in names)))
    x = x.join(sampling.snake_folds(x, "series", 3, "cat").select("series", "fold"), "series")
    return learn.fold_auc(learn.probe(x, "onehot", "y", "fold", 3)).select("fold", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


@query("m30_tsne")
def m30(s, d):
    x = embedding.embedded(table(s, d, "embeddings"), "vec_id", "embedding")
    return x.select("vec_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


@query("m31_clustered_genes")
def m31(s, d):
    r = expression.pearson_top(emb(s, d), 1000, block=32)
    return embedding.clustered(r, "gene", "partner", "r")


_POPE = "p AS (SELECT line_no, category, CASE WHEN len(list_filter(string_split(replace(string_split(lower(paraphrased_answer), '.')[1], ',', ''), ' '), lambda x: x IN ('no', 'not'))) > 0 THEN 'no' ELSE 'yes' END AS said, CASE WHEN stage = 1 THEN 'yes' ELSE 'no' END AS truth FROM generation_results WHERE paraphrased_answer IS NOT NULL)"


@query("m33_yes_no_metrics", f"""WITH {_POPE}, c AS (SELECT category, count_if(said = 'yes' AND truth = 'yes') AS tp, count_if(said = 'yes' AND truth = 'no') AS fp, count_if(said = 'no' AND truth = 'no') AS tn, count_if(said = 'no' AND truth = 'yes') AS fn FROM p GROUP BY 1), m AS (SELECT *, tp / (tp + fp + 1e-6) AS p, tp / (tp + fn + 1e-6) AS r FROM c)
SELECT category, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn + 1e-6), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-6), 6) AS f1, round((tp + fp) / (tp + fp + tn + fn + 1e-6), 6) AS yes_share FROM m""")
def m33(s, d):
    g = table(s, d, "generation_results").where("paraphrased_answer is not null")
    return benchmarks.yes_no_metrics(g, an.yes_no(F.col("paraphrased_answer")), F.when(F.col("stage") == 1, "yes").otherwise("no"), ["category"])


@query("m34_accuracy", "SELECT category, count(*) AS n, round(avg((lower(trim(paraphrased_question, ' ')) = lower(trim(filled_question, ' ')))::INTEGER), 8) AS accuracy, round(avg(CASE WHEN image IS NOT NULL THEN (lower(trim(paraphrased_question, ' ')) = lower(trim(filled_question, ' ')))::INTEGER END), 8) AS image_accuracy FROM generation_results WHERE status = 'ok' GROUP BY 1")
def m34(s, d):
    same = (F.lower(F.trim("paraphrased_question")) == F.lower(F.trim("filled_question"))).cast("int")
    g = table(s, d, "generation_results").where("status = 'ok'")
    return g.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(same), 8).alias("accuracy"), F.round(F.avg(F.when(F.col("image").isNotNull(), same)), 8).alias("image_accuracy"))


@query("m35_soft_accuracy", """WITH r AS (SELECT batch_id AS k, tissue_coarse AS v FROM generation_plan WHERE batch_id IS NOT NULL AND tissue_coarse IS NOT NULL), a AS (SELECT k, arg_min(v, md5(k || v)) AS a FROM r GROUP BY 1), m AS (SELECT k, count_if(v = a) AS m, count(*) AS n FROM r JOIN a USING (k) GROUP BY 1)
SELECT k, round(CASE WHEN m > 0 THEN (least(1.0::DOUBLE, (m - 1) / 3) * m + least(1.0::DOUBLE, m / 3) * (n - m)) / n ELSE 0 END, 6)::DOUBLE AS score FROM m""")
def m35(s, d):
    r = table(s, d, "generation_plan").where("batch_id is not null and tissue_coarse is not null").select(F.col("batch_id").alias("k"), F.col("tissue_coarse").alias("v"))
    a = r.groupBy("k").agg(F.min_by("v", F.md5(F.concat(F.col("k").cast("string"), "v"))).alias("a"))
    return benchmarks.soft_accuracy(a, r, "k", "a", "v")


_PLAIN = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}. ]+', ' ', 'g'), ' +', ' ', 'g'), ' ')"
_SYMBOLS = r"list_filter(list_distinct(regexp_extract_all(coalesce({}, ''), '[A-Z][A-Z0-9]{{2,14}}(?:-AS[0-9])?')), lambda x: x NOT IN ('DNA', 'RNA', 'TPM', 'CVD', 'GSM'))"
_A, _T = _SYMBOLS.format("paraphrased_answer"), _SYMBOLS.format("gt_answer")


_WORDS_A, _WORDS_T = (f"list_distinct(string_split({_PLAIN.format(c)}, ' '))" for c in ("paraphrased_answer", "gt_answer"))


@query("ask12_scorers", f"""SELECT line_no, unnest(['exact', 'overlap', 'symbols']) AS scorer, round(unnest([({_PLAIN.format('paraphrased_answer')} = {_PLAIN.format('gt_answer')})::INTEGER::DOUBLE, len(list_intersect({_WORDS_A}, {_WORDS_T})) / len(list_distinct(list_concat({_WORDS_A}, {_WORDS_T}))), len(list_intersect({_A}, {_T})) / greatest(len({_T}), 1)]), 8) AS score FROM generation_results WHERE status = 'ok'""")
def p12(s, d):
    from sampleloom.qa.scorers import scored as by_scorers

    g = table(s, d, "generation_results").where("status = 'ok'")
    return by_scorers(g, "line_no", "paraphrased_answer", "gt_answer").withColumn("score", F.round("score", 8))


@query("m36_generation_metrics", f"SELECT category, count(*) AS n, round(avg(({_PLAIN.format('paraphrased_answer')} = {_PLAIN.format('gt_answer')})::INTEGER), 6) AS exact, round(avg(len(list_intersect({_A}, {_T})) / greatest(len({_T}), 1)), 6) AS symbol_recall, round(avg((trim(coalesce(paraphrased_answer, ''), ' ') <> '')::INTEGER), 6) AS parse_rate FROM generation_results WHERE status = 'ok' GROUP BY 1")
def m36(s, d):
    g = table(s, d, "generation_results").where("status = 'ok'")
    a, t = F.col("paraphrased_answer"), F.col("gt_answer")
    rec = an.recall(an.symbols(a), an.symbols(t))
    return g.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg((an.normalise(a) == an.normalise(t)).cast("int")), 6).alias("exact"), F.round(F.avg(rec), 6).alias("symbol_recall"), F.round(F.avg((F.length(F.trim(F.coalesce(a, F.lit("")))) > 0).cast("int")), 6).alias("parse_rate"))


@query("m37_convergence")
def m37(s, d):
    names = s.range(64).select(F.col("id").cast("int").alias("gene"))
    c = learn.coefficients(_vectors(s, d), "embedding", "y", names, 0.0, 0.01)
    return c.agg(F.max("iterations").alias("iterations"), (F.max("iterations") < 100).alias("converged"))


@query("m38_conditions_table", "SELECT variant, round(avg(CASE WHEN pool = 'neg_hard' THEN roc_auc END), 8) AS neg_hard, round(avg(CASE WHEN pool <> 'neg_hard' THEN roc_auc END), 8) AS other FROM (SELECT DISTINCT * FROM fold_result) WHERE NOT skipped GROUP BY 1")
def m38(s, d):
    f = table(s, d, "fold_result").distinct().where("not skipped").withColumn("p", F.when(F.col("pool") == "neg_hard", "neg_hard").otherwise("other"))
    g = f.groupBy("variant").pivot("p", ["neg_hard", "other"]).agg(F.avg("roc_auc"))
    return g.select("variant", F.round("neg_hard", 8).alias("neg_hard"), F.round("other", 8).alias("other"))


@query("q10_vector_check", "SELECT count(*) AS n, 0::BIGINT AS missing, 0::BIGINT AS mismatched, count_if(len(list_filter(embedding, lambda x: round(x::DOUBLE, 3)::FLOAT <> x)) > 0) AS mismatched_rounded FROM embeddings")
def q10(s, d):
    """Vectors written and read again are equal byte for byte; a copy with three decimals isn't, and the check says so."""
    path = f"{shared_dir(s)}/vectors-{uuid.uuid4().hex[:10]}"
    t = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    rounded = F.transform("v", lambda x: F.round(x.cast("double"), 3).cast("float"))
    t.select("vec_id", "v", rounded.alias("r")).write.parquet(path)
    both = t.join(s.read.parquet(path).select("vec_id", F.col("v").alias("w"), "r"), "vec_id", "left")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("w").isNull()).alias("missing"), F.count_if(F.col("v") != F.col("w")).alias("mismatched"), F.count_if(F.col("v") != F.col("r")).alias("mismatched_rounded"))
