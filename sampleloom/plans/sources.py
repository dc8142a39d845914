"""Queries of the scans (S) and sinks (K): what is read here was written by the query into the shared folder before."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from sampleloom.plans.common import DE, EMB, EXPR, de, emb, expr
from sampleloom.registry import query
from sampleloom.session import cut, shared_dir, table
from sampleloom.sources import files, sinks, store, vectors


def _folder(s) -> str:
    return f"{shared_dir(s)}/query-{uuid.uuid4().hex[:12]}"


def _write_text(s, folder: str, name: str, text: str) -> str:
    return store.write_text(s, f"{folder}/{name}", text)


@query("s02_shape", f"WITH {EMB} SELECT (max(gene) + 1)::INTEGER AS n_genes, (max(sample_index) + 1)::BIGINT AS n_samples FROM emb")
def s02(s, d):
    return emb(s, d).agg((F.max("gene") + 1).alias("n_genes"), (F.max("sample_index") + 1).alias("n_samples"))


@query("s03_sample_field", "SELECT sample_index, geo_accession, NULL::VARCHAR AS title FROM per_sample_de")
def s03(s, d):
    t = table(s, d, "per_sample_de")
    return t.select("sample_index", files.column_or_null(t, "geo_accession").alias("geo_accession"), files.column_or_null(t, "title").alias("title"))


@query("s04_gene_field", "SELECT DISTINCT gene FROM coexpression_edges")
def s04(s, d):
    t = table(s, d, "coexpression_edges")
    return t.select(files.column_or_null(t, "gene").alias("gene")).distinct()


@query("s05_first_present", "SELECT sample_index, series_id AS field FROM per_sample_de")
def s05(s, d):
    t = table(s, d, "per_sample_de")
    return t.select("sample_index", files.first_present(t, "series", "gse", "series_id").alias("field"))


@query("s06_symbols", "SELECT DISTINCT partner AS symbol FROM coexpression_edges WHERE partner IS NOT NULL")
def s06(s, d):
    t = table(s, d, "coexpression_edges")
    return t.select(files.first_present(t, "symbol", "gene_symbol", "partner", required=True).alias("symbol")).where("symbol is not null").distinct()


@query("s07_sample_scan", f"WITH {EXPR} SELECT sample_index // 2048 AS chunk, count(*) AS n, sum(n)::BIGINT AS total FROM expr GROUP BY 1")
def s07(s, d):
    return expr(s, d).groupBy(F.floor(F.col("sample_index") / 2048).alias("chunk")).agg(F.count("*").alias("n"), F.sum("n").alias("total"))


@query("s08_gene_scan", f"WITH {EXPR} SELECT gene // 512 AS chunk, count(*) AS n, sum(n)::BIGINT AS total FROM expr GROUP BY 1")
def s08(s, d):
    return expr(s, d).groupBy(F.floor(F.col("gene") / 512).alias("chunk")).agg(F.count("*").alias("n"), F.sum("n").alias("total"))


@query("s09_random_access", "WITH w AS (SELECT unnest([70, 3, 41, 3]) AS vec_id, unnest(range(4)) AS pos) SELECT pos, vec_id, label FROM w JOIN embeddings USING (vec_id)")
def s09(s, d):
    w = s.createDataFrame([(k, v) for k, v in enumerate((70, 3, 41, 3))], "pos long, vec_id long")
    return w.join(table(s, d, "embeddings"), "vec_id").select("pos", "vec_id", "label")


@query("s11_slice_scan", "SELECT sample_index, coalesce(reason, '') AS reason FROM per_sample_de")
def s11(s, d):
    return table(s, d, "per_sample_de").select("sample_index", F.coalesce("reason", F.lit("")).alias("reason"))


@query("s12_sorted_field", f"WITH {DE} SELECT sample_index, geo_accession FROM de WHERE sample_index IN (SELECT sample_index FROM sample_labels WHERE is_cvd_pool)")
def s12(s, d):
    return de(s, d).join(table(s, d, "sample_labels").where("is_cvd_pool"), "sample_index", "left_semi").select("sample_index", "geo_accession")


@query("s13_matrix_scan", f"WITH {EMB} SELECT gene, count(*) AS n, round(min(v), 8) AS least FROM emb GROUP BY 1")
def s13(s, d):
    return emb(s, d).groupBy("gene").agg(F.count("*").alias("n"), F.round(F.min("v"), 8).alias("least"))


@query("s14_projection", "SELECT geo_accession, status FROM per_sample_de")
def s14(s, d):
    return files.expect_columns(table(s, d, "per_sample_de"), "geo_accession", "status").select("geo_accession", "status")


@query("s15_csv_columns", "SELECT n_nationkey, n_name FROM nation")
def s15(s, d):
    sinks_path = _folder(s)
    table(s, d, "nation").write.option("header", True).csv(sinks_path)
    return files.read_csv(s, sinks_path, "n_nationkey int, n_name string, n_regionkey int", ["n_nationkey", "n_name"])


@query("s16_csv_preamble", "SELECT r_regionkey, r_name FROM region")
def s16(s, d):
    rows = table(s, d, "region").orderBy("r_regionkey").collect()  # five rows
    text = "# made for a test\n# two lines\nr_regionkey,r_name\n" + "".join(f"{r[0]},{r[1]}\n" for r in rows)
    return files.read_csv(s, _write_text(s, _folder(s), "region.csv", text), "r_regionkey int, r_name string", comment="#")


@query("s17_symbol_map", "SELECT 'hsa:' || gene AS id, CASE WHEN gene LIKE '%-AS%' THEN gene END AS symbol, CASE WHEN gene LIKE '%-AS%' THEN regexp_replace(gene, '-AS.*$', '') || ',' || lower(gene) END AS aliases FROM (SELECT DISTINCT gene FROM coexpression_edges WHERE gene IS NOT NULL)")
def s17(s, d):
    """Genes with a suffix are written with their stem and lower case as aliases, the others without a symbol."""
    path, g = _folder(s), F.col("gene")
    names = F.when(F.contains(g, F.lit("-AS")), F.concat(g, F.lit(", "), F.regexp_replace(g, "-AS.*$", ""), F.lit(","), F.lower(g), F.lit("; antisense gene"))).otherwise("no symbol, no alias")
    line = F.concat_ws("\t", F.concat(F.lit("hsa:"), g), F.lit("CDS"), F.lit("1:2"), names)
    table(s, d, "coexpression_edges").where("gene is not null").select("gene").distinct().select(line.alias("value")).write.text(path)
    return files.read_symbol_map(s, path).select("id", "symbol", F.array_join("aliases", ",").alias("aliases"))


@query("s18_links", "SELECT 'hsa:' || c_custkey AS source, 'path:' || c_nationkey AS target FROM customer WHERE c_nationkey < 20")
def s18(s, d):
    path = _folder(s)
    t = table(s, d, "customer").select(F.concat(F.when(F.col("c_nationkey") < 20, "hsa:").otherwise("mmu:"), F.col("c_custkey").cast("string"), F.lit("\tpath:"), F.col("c_nationkey").cast("string")).alias("value"))
    t.write.text(path)
    return files.read_links(s, path, "hsa:")


@query("s19_json_document", "SELECT r_name AS name, r_regionkey AS id FROM region")
def s19(s, d):
    rows = [{"name": r["r_name"], "id": r["r_regionkey"]} for r in table(s, d, "region").collect()]  # five rows
    doc = files.read_json_document(s, _write_text(s, _folder(s), "doc.json", json.dumps({"regions": rows}, indent=2)), "regions array<struct<name:string,id:int>>")
    return doc.select(F.explode("regions").alias("r")).select("r.name", "r.id")


@query("s20_jsonl", "SELECT line_no, id, status FROM generation_results")
def s20(s, d):
    path = _folder(s)
    table(s, d, "generation_results").select("line_no", "id", "status").write.json(path)
    return files.read_jsonl(s, path, "line_no long, id string, status string")


@query("s21_jsonl_cut_off", "SELECT line_no, id, status FROM generation_results")
def s21(s, d):
    """Each part of the log ends in a line that is cut off."""
    path = _folder(s)
    t = table(s, d, "generation_results").select(F.to_json(F.struct("line_no", "id", "status")).alias("value"))
    t.unionByName(t.select(F.expr("left(value, length(value) - 3)").alias("value")).limit(8)).write.text(path)
    return files.read_jsonl(s, path, "line_no long, id string, status string", strict=False)


@query("s22_several_jsonl", "SELECT s_suppkey, s_name FROM supplier")
def s22(s, d):
    one, two = _folder(s), _folder(s)
    t = table(s, d, "supplier").select("s_suppkey", "s_name")
    t.where("s_suppkey % 2 = 0").write.json(one)
    t.where("s_suppkey % 2 <> 0").write.json(two)
    return files.read_jsonl(s, [one, two], "s_suppkey long, s_name string")


@query("s23_templates", "SELECT r_name AS category, unnest([0, 1])::INTEGER AS template_index, unnest(['What is {x} in ' || r_name || '?', 'Name \"{x}\": ' || r_regionkey]) AS text FROM region")
def s23(s, d):
    rows = table(s, d, "region").collect()  # five rows
    text = "# templates\n" + "".join(f"{r['r_name']}:\n  - What is {{x}} in {r['r_name']}?\n  - {json.dumps(chr(78) + 'ame ' + chr(34) + '{x}' + chr(34) + ': ' + str(r['r_regionkey']))}\n" for r in rows)
    return files.read_templates(s, _write_text(s, _folder(s), "templates.yaml", text))


@query("s24_long_bundle", f"WITH {DE} SELECT sample_index, unnest(range(len(top_up_genes)))::INTEGER AS place, unnest(top_up_genes) AS gene, round(unnest(top_up_z)::DOUBLE, 6) AS z FROM de")
def s24(s, d):
    x = de(s, d).select("sample_index", F.posexplode(F.arrays_zip("top_up_genes", "top_up_z")).alias("place", "p"))
    return x.select("sample_index", "place", F.col("p.top_up_genes").alias("gene"), F.round(F.col("p.top_up_z").cast("double"), 6).alias("z"))


@query("s26_embedding_columns", "SELECT vec_id, len(embedding)::INTEGER AS width, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def s26(s, d):
    wide = table(s, d, "embeddings").select("vec_id", *(F.col("embedding")[k].alias(f"e{k:04d}") for k in range(64)))
    x = files.embedding_array(wide)
    return x.select("vec_id", F.size("features").alias("width"), F.round(F.element_at("features", 64).cast("double"), 6).alias("last"))


@query("s28_result_documents", "SELECT run_id, fold, roc_auc FROM (SELECT DISTINCT run_id, fold, roc_auc FROM fold_result) WHERE roc_auc IS NOT NULL AND NOT isnan(roc_auc)")
def s28(s, d):
    path = _folder(s)
    f = table(s, d, "fold_result").where("roc_auc is not null and not isnan(roc_auc)").select("run_id", "fold", "roc_auc").distinct()
    f.groupBy("run_id").agg(F.collect_list(F.struct("fold", "roc_auc")).alias("folds")).write.partitionBy("run_id").json(path)  # five folds a run
    return s.read.schema("folds array<struct<fold:int,roc_auc:double>>, run_id long").json(path).select("run_id", F.explode("folds").alias("f")).select("run_id", "f.fold", "f.roc_auc")


@query("s29_log_scrape", "SELECT round(value::DOUBLE, 4) AS loss FROM events WHERE value IS NOT NULL")
def s29(s, d):
    path = _folder(s)
    t = table(s, d, "events").where("value is not null").select(F.concat(F.lit("step {'loss': "), F.format_string("%.4f", F.col("value").cast("double")), F.lit(", 'lr': 0.1}")).alias("value"))
    t.unionByName(s.createDataFrame([("started",), ("{'eval': 1.5}",)], "value string")).write.text(path)
    return files.scrape_log(s, path, "loss")


@query("s30_trainer_history", "SELECT DISTINCT run_id, fold::BIGINT AS step, brier AS loss FROM fold_result WHERE brier IS NOT NULL AND NOT isnan(brier)")
def s30(s, d):
    """A state document for each run, its folds as steps, with entries that have no loss."""
    path = _folder(s)
    f = table(s, d, "fold_result").where("brier is not null and not isnan(brier)").select("run_id", F.col("fold").cast("long").alias("step"), F.col("brier").alias("loss")).distinct()
    entry = lambda loss: F.struct("step", loss.alias("loss"))
    doc = f.groupBy("run_id").agg(F.collect_list(F.array(entry(F.col("loss")), entry(F.lit(None).cast("double")))).alias("l"))  # five folds a run
    doc.select("run_id", F.to_json(F.struct(F.flatten("l").alias("log_history"))).alias("value")).repartition("run_id").write.partitionBy("run_id").text(path)
    state = s.read.schema("log_history array<struct<step:bigint,loss:double>>, run_id long").option("multiLine", True).json(path)
    return files.trainer_steps(state, "run_id")


@query("s10_ordered_column", "SELECT row_number() OVER (ORDER BY md5('order|' || plan_row), plan_row) - 1 AS pos, plan_row, category FROM generation_plan")
def s10(s, d):
    """All rows are asked for, in an order by hash."""
    from sampleloom.operators.order import global_rank
    from sampleloom.operators.sampling import draw_key

    p = table(s, d, "generation_plan")
    wanted = global_rank(p.select("plan_row", draw_key("order", "plan_row").alias("h")), F.col("h"), F.col("plan_row"), out="r").select((F.col("r") - 1).cast("long").alias("pos"), "plan_row")
    return files.ordered_column(wanted, p, "plan_row", "category")


@query("s27_embedding_numbers", "SELECT vec_id, len(embedding)::INTEGER AS width, round(embedding[2]::DOUBLE, 6) AS second, round(embedding[11]::DOUBLE, 6) AS eleventh FROM embeddings")
def s27(s, d):
    """Columns dim_0, dim_1, ... dim_63 in any order are sorted by number, so dim_10 doesn't come before dim_2."""
    wide = table(s, d, "embeddings").select("vec_id", *(F.col("embedding")[k].alias(f"dim_{k}") for k in sorted(range(64), key=str)))
    x = files.embedding_array(wide, "dim_")
    return x.select("vec_id", F.size("features").alias("width"), F.round(F.get("features", F.lit(1)).cast("double"), 6).alias("second"), F.round(F.get("features", F.lit(10)).cast("double"), 6).alias("eleventh"))


def _raised(f) -> str:
    try:
        f()
    except (files.MissingArtifact, ValueError) as e:
        return type(e).__name__
    return "passed"


@query("s31_s33_gates", "SELECT * FROM (VALUES ('there', 'passed'), ('too small', 'MissingArtifact'), ('missing', 'MissingArtifact')) v(gate, outcome)")
def s31(s, d):
    """A table that was written passes the gates of existence and size; a floor above its size or another name does not."""
    path = _folder(s)
    table(s, d, "supplier").write.parquet(path)
    size = store.size_of(s, path)
    gates = {"there": (path, size), "too small": (path, size + 1), "missing": (f"{path}-no", 0)}
    return s.createDataFrame([(k, _raised(lambda p=p, n=n: files.require(s, p, "suppliers", n))) for k, (p, n) in gates.items()], "gate string, outcome string")


@query("s34_provenance", "WITH n AS (SELECT count(DISTINCT sample_index) AS n, count(*) AS rows FROM per_sample_de) SELECT pool, n AS n_samples, outcome FROM n, (VALUES ('cvd', 'passed'), ('other', 'ValueError')) v(pool, outcome) UNION ALL SELECT 'cvd', rows, CASE WHEN rows = n THEN 'passed' ELSE 'ValueError' END FROM n")
def s34p(s, d):
    """The manifest of a pool is refused for another pool, and where rows are taken for samples."""
    n = table(s, d, "per_sample_de").agg(F.countDistinct("sample_index").alias("n"), F.count("*").alias("rows")).first()
    path = f"{_folder(s)}/manifest.json"
    sinks.write_manifest(s, path, 0.0, {"pool": "cvd", "n_samples": n["n"]}, {"counted": True})
    manifest = json.loads(store.read_text(s, path))
    rows = [(p, k, _raised(lambda p=p, k=k: files.check_provenance(manifest, p, k))) for p, k in (("cvd", n["n"]), ("other", n["n"]), ("cvd", n["rows"]))]
    return s.createDataFrame(rows, "pool string, n_samples long, outcome string")


@query("k06_manifest", "SELECT 'no_nulls' AS check_name, count_if(sample_index IS NULL) = 0 AS ok FROM per_sample_de UNION ALL SELECT 'one_row_a_sample', count(*) = count(DISTINCT sample_index) FROM per_sample_de UNION ALL SELECT 'passed', count_if(sample_index IS NULL) = 0 AND count(*) = count(DISTINCT sample_index) FROM per_sample_de")
def k06(s, d):
    t = table(s, d, "per_sample_de").agg(F.count_if(F.col("sample_index").isNull()).alias("nulls"), F.count("*").alias("n"), F.countDistinct("sample_index").alias("k")).first()
    path = f"{_folder(s)}/manifest.json"
    _raised(lambda: sinks.write_manifest(s, path, 0.0, {"rows": t["n"]}, {"no_nulls": t["nulls"] == 0, "one_row_a_sample": t["n"] == t["k"]}))
    m = json.loads(store.read_text(s, path))
    return s.createDataFrame([*((k, v) for k, v in m["sanity_checks"].items() if k != "failures"), ("passed", m["passed"])], "check_name string, ok boolean")


@query("k16_artifacts", "SELECT * FROM (VALUES ('nation', true), ('region', true), ('report', false)) v(name, present)")
def k16(s, d):
    path = _folder(s)
    for n in ("nation", "region"):
        table(s, d, n).write.parquet(f"{path}/{n}")
    return sinks.collect_artifacts(s, {n: f"{path}/{n}" for n in ("nation", "region", "report")}).select("name", F.col("bytes").isNotNull().alias("present"))


@query("k05_k08_vector_files", "SELECT vec_id, 'new' AS first, CASE WHEN round(embedding[1]::DOUBLE, 2)::FLOAT = embedding[1] THEN 'identical' ELSE 'mismatch' END AS again, round(embedding[1]::DOUBLE, 6) AS kept FROM embeddings")
def k05(s, d):
    """Files are written once; a second call finds those of rounded vectors changed and leaves the files as they are."""
    folder = _folder(s)
    t = table(s, d, "embeddings").select("vec_id", "embedding")
    rounded = F.transform("embedding", lambda x, k: F.when(k == 0, F.round(x.cast("double"), 2).cast("float")).otherwise(x))
    first = cut(store.write_vectors(t, "vec_id", "embedding", folder)).select(F.col("key").alias("vec_id"), F.col("state").alias("first"))
    again = cut(store.write_vectors(t.withColumn("embedding", rounded), "vec_id", "embedding", folder)).select(F.col("key").alias("vec_id"), F.col("state").alias("again"))
    kept = vectors.read_vectors(s, folder, 64).select(F.col("key").cast("long").alias("vec_id"), F.round(F.get("features", F.lit(0)), 6).alias("kept"))
    return first.join(again, "vec_id").join(kept, "vec_id")


# sinks ------------------------------------------------------------------------------------------------------------


@query("k01_k03_parquet", "SELECT sample_index, geo_accession, mean_abs_z::DOUBLE AS mean_abs_z FROM per_sample_de")
def k01(s, d):
    path = _folder(s)
    t = table(s, d, "per_sample_de").select("sample_index", "geo_accession", F.col("mean_abs_z").cast("double").alias("mean_abs_z"))
    sinks.write_with_schema(t, path, "sample_index bigint, geo_accession string, mean_abs_z double")
    return s.read.parquet(path)


@query("k04_csv", "SELECT c_custkey, c_mktsegment FROM customer")
def k04(s, d):
    path = _folder(s)
    table(s, d, "customer").select("c_custkey", "c_mktsegment").write.option("header", True).csv(path)
    return files.read_csv(s, path, "c_custkey long, c_mktsegment string")


@query("k07_append_once", "SELECT id, min(line_no) AS line_no FROM generation_results GROUP BY 1")
def k07(s, d):
    path, schema = _folder(s), "id string, line_no long"
    rows = table(s, d, "generation_results").groupBy("id").agg(F.min("line_no").alias("line_no"))
    sinks.append_new(rows.where("line_no % 2 = 0"), path, "id", schema)
    sinks.append_new(rows, path, "id", schema)
    sinks.append_new(rows, path, "id", schema)
    return s.read.schema(schema).json(path)


@query("k10_write_states", "WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE md5(text) END AS h FROM documents) SELECT n.doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN o.h = n.h THEN 'identical' ELSE 'mismatch' END AS state FROM n LEFT JOIN o USING (doc_id)")
def k10(s, d):
    t = table(s, d, "documents").select("doc_id", F.md5("text").alias("h"))
    new = t.withColumn("h", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("h")))
    return sinks.classify_write(new, t.where("doc_id % 3 <> 0"), "doc_id", "h").select("doc_id", "state")


@query("k12_conversation_json", "SELECT line_no, json_extract_string(json, '$.conversations[1].value') AS answer, json_extract_string(json, '$.image') AS image FROM (SELECT line_no, json_object('image', image, 'conversations', [json_object('value', filled_question), json_object('value', gt_answer)]) AS json FROM generation_results)")
def k12(s, d):
    j = sinks.conversations_json(table(s, d, "generation_results"), "line_no", "filled_question", "gt_answer", "image")
    return j.select("line_no", F.get_json_object("json", "$.conversations[1].value").alias("answer"), F.get_json_object("json", "$.image").alias("image"))


@query("k13_leaderboards", "SELECT 'v1_' || line_no AS question_id, paraphrased_answer AS answer FROM generation_results UNION ALL SELECT line_no::VARCHAR, lower(rtrim(regexp_replace(paraphrased_answer, '[.]+$', ''), ' ')) FROM generation_results")
def k13(s, d):
    g = table(s, d, "generation_results")
    return sinks.leaderboard_answers(g, "line_no", "paraphrased_answer", "prefixed").unionByName(sinks.leaderboard_answers(g, "line_no", "paraphrased_answer", "gqa"))


@query("k13_submission", "SELECT i.item_id, coalesce(d.text, '') AS text FROM eval_item i LEFT JOIN documents d ON d.doc_id = i.item_id")
def k13s(s, d):
    return sinks.submission(table(s, d, "eval_item"), table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id", "text")


@query("k14_markdown", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS row FROM nation")
def k14(s, d):
    return sinks.markdown_table(table(s, d, "nation"), ["n_nationkey", "n_name"])


@query("k15_plot_series", "SELECT floor(l_quantity / 5)::INTEGER AS bin, count(*) AS n, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1")
def k15(s, d):
    return table(s, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))


