"""Known answers of the core operators, and their edge cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sampleloom.functions import answers, conversations, labels, text
from sampleloom.operators import aggregates, filters, joins, sampling, windows
from sampleloom.qa import questions
from sampleloom.sources import files, sinks
from sampleloom.stats import auc, expression


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_quantile_ties(spark):
    ref = spark.createDataFrame([("r", k, float(k + 1)) for k in range(4)], "s string, i int, v double")
    for values, want in (([7, 7, 5, 9], [2.5, 2.5, 1, 4]), ([3, 1, 4, 2], [3, 1, 4, 2])):
        df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(values)], "s string, i int, v double")
        got = windows.quantile_normalised(df, "s", "i", "v", ref).orderBy("i").collect()
        assert [r["normalised"] for r in got] == want


def test_series_only_score_is_a_shortcut(spark):
    rows = [(f"s{g}", int(k < (18 if g < 12 else 2)), 0.9 if g < 12 else 0.1) for g in range(24) for k in range(20)]
    r = auc.shortcut_diagnostics(spark.createDataFrame(rows, "g string, y int, v double"), "y", "v", "g").first()
    assert (r["pooled_auc"], r["pair_weighted"], r["pairwise_auc"], r["centred_auc"], r["gap"]) == (0.9, 0.5, 0.5, 0.5, 0.4)


@pytest.mark.parametrize("flip, want", [(1, 1.0), (-1, 0.0)])
def test_perfect_and_inverted_scores(spark, flip, want):
    df = spark.createDataFrame([(k % 2, flip * float(k % 2)) for k in range(50)], "y int, s double")
    assert auc.roc_auc(df, "y", "s").first()["auc"] == want


def test_auc_and_ap_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(8) / 8) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc.roc_auc(df, "y", "s").first()["auc"] - pairs) < 1e-12
    ap = last = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, taken = sum(y for y, s in rows if s >= t), sum(s >= t for _, s in rows)
        ap, last = ap + (tp / len(pos) - last) * tp / taken, tp / len(pos)
    assert abs(auc.pr_auc(df, "y", "s").first()["average_precision"] - ap) < 1e-12
    assert auc.roc_auc(df.where("y = 1"), "y", "s").first()["auc"] is None and auc.roc_auc(df.limit(0), "y", "s", ["y"]).count() == 0


def test_extremes_mark_boundary_ties(spark):
    df = spark.createDataFrame([("a", g, v) for g, v in (("x", 3.0), ("y", 2.0), ("z", 2.0), ("w", 1.0))] + [("b", "x", 1.0)], "s string, g string, v double")
    got = {(r["s"], r["g"]): (r["rank"], r["boundary_tie"]) for r in windows.extremes(df, ["s"], "v", "g", 2).collect()}
    assert got == {("a", "x"): (1, True), ("a", "y"): (2, True), ("b", "x"): (1, False)}


def test_zero_variance_is_relative(spark):
    df = spark.createDataFrame([("a", 1e9), ("a", 1e9 + 1e-7), ("b", 1.0), ("b", 3.0), ("c", 5.0)], "g string, v double")
    got = sorted((r["g"], r["z"]) for r in windows.zscore(df, "v", ["g"]).collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 1.0), ("c", 0.0)]


def test_tertiles_cut_values_not_counts(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1.0] * 8 + [2.0, 3.0, None, float("nan")])], "k int, v double")
    got = [r["bucket"] for r in windows.tertiles(df, "v").orderBy("k").collect()]
    assert got == ["minimal"] * 8 + ["large", "large", "unknown", "unknown"]


@pytest.mark.parametrize("target", [0, 3, 10, 17, 20, 60])
def test_even_allocation(spark, target):
    caps = {"a": 2, "b": 5, "c": 5, "d": 30}
    df = spark.createDataFrame(list(caps.items()), "k string, n long")
    rows = sampling.even_allocation(df, "k", "n", target).collect()
    seats = {r["k"]: r["seats"] for r in rows}
    assert sum(seats.values()) == min(target, 42) and all(seats[k] <= caps[k] for k in caps) and rows[0]["unmet"] == max(0, target - 42)
    open_ = [seats[k] for k in caps if seats[k] < caps[k]]
    assert not open_ or max(open_) - min(open_) <= 1


def test_planted_confounders(spark):
    rng = random.Random(6)
    rows = []
    for k in range(200):
        depth, g = rng.gauss(0, 1), rng.randrange(4)
        rows += [(k, "d", f"s{g}", depth, 3 * depth + rng.gauss(0, 0.3)), (k, "s", f"s{g}", depth, 4.0 * g + rng.gauss(0, 0.3)), (k, "n", f"s{g}", depth, rng.gauss(0, 1)), (k, "z", f"s{g}", depth, 1.0)]
    df = spark.createDataFrame(rows, "i int, gene string, series string, depth double, v double")
    r2 = {r["gene"]: r["r2"] for r in aggregates.correlation_r2(df, "gene", "v", "depth").collect()}
    eta = {r["gene"]: r["eta2"] for r in aggregates.eta_squared(df, "gene", "series", "v").collect()}
    assert r2["d"] > 0.8 and r2["n"] < 0.1 and r2["z"] is None and eta["s"] > 0.9 and eta["n"] < 0.15 and eta["z"] is None


def test_pearson_blocks_equal_pairs(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(s, g, rng.gauss(0, 1)) for s in range(40) for g in range(11)], "sample_index int, gene int, v double")
    top = expression.pearson_top(df, 3, block=4)
    again = {(r["gene"], r["partner"]): r["r"] for r in expression.pearson_pairs(df, top.select("gene", "partner")).collect()}
    rows = top.collect()
    assert len(rows) == 33 and all(abs(r["r"] - again[r["gene"], r["partner"]]) < 1e-9 for r in rows)


def test_polarity(spark):
    cases = {
        "Yes, it is.": "pos", "No. It shows nothing.": "neg", "The profile is consistent with disease.": "pos", "There is no evidence of disease.": "neg", "The value is 5.": "undetermined", "": "undetermined", None: "undetermined",
        "The profile does not confirm cardiovascular disease.": "neg", "Cardiovascular disease could not be confirmed here.": "neg", "Disease-unconfirmed.": "neg", "Status: positive": "pos", "The sample is unconfirmed.": "neg", "Disease-positive.": "pos",
        "It confirms a shift. There was no rain.": "undetermined", "It shows a shift but is not consistent with failure.": "undetermined",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", answers.polarity(F.col("t")).alias("p")).collect()} == cases


def test_overclaims(spark):
    cases = {"This is a healthy sample.": True, "The subject is disease-free.": True, "A normal profile with no disease.": True, "No confirmed evidence of cardiovascular disease.": False, "It is definitely raised.": False, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", answers.overclaims(F.col("t")).alias("p")).collect()} == cases


def test_last_choice(spark):
    options = {"A": "heart failure", "B": "myocarditis"}
    cases = {"(A) or rather (B)": "B", "It is B": "B", "A. Because": "A", "we think it is myocarditis and then heart failure": "A", "BAD Apple": None, None: None}
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r["t"]: r["p"] for r in df.select("t", answers.last_choice(F.col("t"), options, F.col("k")).alias("p")).collect()}
    assert {t: got[t] for t, c in cases.items() if c} == {t: c for t, c in cases.items() if c} and set(got.values()) <= {"A", "B"}


def test_strict_integers(spark):
    cases = {"5": 5, " 7 ": 7, "0": None, "101": None, "2.5": None, "true": None, "five": None, "1e2": None, "99999999999": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", questions.strict_integer(F.col("t"), 1, 100).alias("n")).collect()} == cases


def test_completions(spark):
    cases = ["QUESTION: a?\nANSWER: b\nand c", "**Question**: a?\n**Answer**: b", "SKIP", "QUESTION: a?", "QUESTION: a?\nANSWER: SKIP", "", None]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = [tuple(r["p"]) for r in df.select("k", answers.parse_completion("t").alias("p")).orderBy("k").collect()]
    assert got == [("ok", "a?", "b and c", None), ("ok", "a?", "b", None), ("skip", None, None, None), ("error", "a?", None, "missing label"), ("skip", "a?", None, "skip in answer"), ("error", None, None, "empty"), ("error", None, None, "empty")]


def test_sizes_and_directions(spark):
    got = {v: one(spark, questions.size_spec(F.lit(v), F.lit(5797))) for v in ("5", "1%", "10%", "0.5", "0", "-3", "abc", "101%", "9999", None)}
    assert got == {"5": 5, "1%": 58, "10%": 580, "0.5": 2899, "0": None, "-3": None, "abc": None, "101%": None, "9999": None, None: None}
    assert [one(spark, questions.direction(F.lit(v))) for v in (" UP", "lower", "sideways", None)] == ["up", "down", None, None]


def test_refusals_name_the_first_gate(spark):
    de = spark.createDataFrame([(1, " gsm1", "ok", ["A", "B"], ["C"], [3.0, 2.0], [-1.0], "large", 7), (2, "GSM2", "insufficient_data", None, None, None, None, "unknown", None)], "sample_index long, geo_accession string, status string, top_up_genes array<string>, top_down_genes array<string>, top_up_z array<float>, top_down_z array<float>, magnitude_bucket string, n_genes_abs_z_gt2 int")
    lab = spark.createDataFrame([(1, "ischemic", True), (2, "", False)], "sample_index long, cvd_subtype string, is_cvd_disease boolean")
    edges = spark.createDataFrame([("A", "B", 0.9), ("A", "Z", 0.8), ("A", "A", 1.0), ("A", "X", 7.0), ("Q", "Z", 0.5)], "gene string, partner string, pearson_r float")
    R = "row long, category string, sample string, gene string, gene_b string, n string, direction string, threshold double"
    ask = {
        ("direct_abundance_query", "GSM1", "A"): "3.0000", ("direct_abundance_query", "GSM1", "X"): "gene_not_in_matrix", ("direct_abundance_query", "NOBODY", "A"): "unknown_sample", ("direct_abundance_query", "GSM1", None): "no_gene",
        ("threshold_query", "GSM1", None, None, None, "above", 1.5): "2 of 3: A,B", ("threshold_query", "GSM1", None, None, None, "under", 2.0): "1 of 3: C", ("threshold_query", "GSM1", None, None, None, "over", 9.0): "0 of 3: *", ("threshold_query", "GSM1", None, None, None, "over", -9.0): "3 of 3: A,B,C*",
        ("threshold_query", "GSM1", None, None, None, "over", None): "bad_threshold", ("threshold_query", "GSM1", None, None, None, "over", float("nan")): "bad_threshold", ("threshold_query", "GSM1", None, None, None, "aside", 1.0): "bad_direction", ("threshold_query", "GSM2", None, None, None, "over", 1.0): "not_in_matrix",
        ("ranking_ordering_query", "GSM1", None, None, "2", "top"): "A,B", ("ranking_ordering_query", "GSM1", None, None, "34%", "bottom"): "C,B", ("ranking_ordering_query", "GSM1", None, None, "9", "top"): "bad_size", ("ranking_ordering_query", "GSM1", None, None, None, "top"): "bad_size", ("ranking_ordering_query", "GSM1", None, None, "2", None): "bad_direction",
        ("comparative_query", "GSM1", "A", "B"): "A 1.0000 1.4427", ("comparative_query", "GSM1", "C", "B"): "B 3.0000 -4.3281", ("comparative_query", "GSM1", "A", "A"): "equal 0.0000 0.0000", ("comparative_query", "GSM1", "A", None): "second_gene_not_in_matrix", ("comparative_query", "GSM1", "Z", "A"): "gene_not_in_matrix",
        ("interaction_network_query", "GSM1", "A", None, "2"): "B=2.0000,Z=na", ("interaction_network_query", "GSM1", "A", None, None): "bad_size", ("interaction_network_query", "GSM1", "A", None, "3"): "bad_size", ("interaction_network_query", "GSM1", "A", None, "1.0"): "bad_size", ("interaction_network_query", "GSM1", "Q", None, "1"): "no_partner_in_sample", ("interaction_network_query", "GSM1", "X", None, "1"): "gene_not_in_graph",
        ("disease_subtype_classification", "GSM2"): "outside_pool", ("magnitude_reasoning", "GSM1"): "large 7", ("comparative_differential_reasoning", "GSM2", None, None, "1", "up"): "de_unavailable", ("poetry", "GSM1"): "unknown_category", (None, None): "unknown_category",
        ("gene_driver_reasoning", "GSM2", None, None, "1", "up"): "not_diseased", ("gene_driver_reasoning", "GSM1", None, None, "1", "up"): "A 3.000", ("gene_driver_reasoning", "GSM1", None, None, "2", "abs"): "A 3.000,B 2.000", ("gene_driver_reasoning", "GSM1", None, None, "5", "down"): "C -1.000",
        ("gene_driver_reasoning", "GSM1", None, None, "5", "top"): "bad_direction", ("gene_driver_reasoning", "GSM1", None, None, "0", "up"): "bad_size",
    }
    rows = [(k, *a, *[None] * (7 - len(a))) for k, a in enumerate(ask)]
    got = {r["row"]: r["answer"] if r["status"] == "ok" else r["reason"] for r in questions.answer(spark.createDataFrame(rows, R), questions.context(de, lab, edges)).collect()}
    assert {a: got[k] for k, a in enumerate(ask)} == ask


def test_text_helpers(spark):
    assert one(spark, text.name_list(F.lit(" gse1,GSE2;gse1 | gse3\t"))) == ["GSE1", "GSE2", "GSE3"] and one(spark, text.name_list(F.lit(None).cast("string"))) == []
    assert one(spark, text.clean_upper(F.lit("\t gsm1 "))) == "GSM1" and one(spark, text.clean_upper(F.lit("  "))) is None
    assert one(spark, labels.patient_id(F.lit("age: 5, Donor: D-7; sex: f"), ["donor"])) == "d-7" and one(spark, labels.patient_id(F.lit("donor: N/A"), ["donor"])) is None
    assert one(spark, labels.lenient_year(F.lit("2014/03/01"))) == 2014 and one(spark, labels.lenient_year(F.lit("soon"))) == -1
    assert one(spark, answers.two_way_softmax(F.lit(-800.0), F.lit(0.0))) == 0.0 and one(spark, answers.two_way_softmax(F.lit(800.0), F.lit(0.0))) == 1.0
    assert one(spark, answers.anls(F.lit("abcd"), F.lit("abce"))) == 0.75 and one(spark, answers.yes_no(F.lit("Not here. Yes."))) == "no"
    assert one(spark, conversations.with_image_token(F.lit("a <image> b c"))) == ["a", "-200", "b", "c"]
    assert one(spark, conversations.supervised(conversations.tokens(F.lit("q r")), conversations.tokens(F.lit("a")))) == ["-100", "-100", "a"]


def test_joins(spark):
    left, twice = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeats a key"):
        joins.left_checked(left, twice, ["k"]).collect()
    with pytest.raises(Exception, match="no partner"):
        joins.positional(left, twice.limit(1), "k").collect()
    names = spark.createDataFrame([("A", []), ("B", ["X", "c1"]), ("D", None)], "s string, a array<string>")
    got = {r["s"]: (r["match"], r["matched_via"]) for r in joins.alias_rescue(names, spark.createDataFrame([("a",), ("C1",)], "s string"), "s", "a").collect()}
    assert got == {"A": ("a", "exact"), "B": ("C1", "alias"), "D": (None, "unmatched")}


def test_every_group_gets_the_whole_axis(spark):
    axis = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "g string")
    rows = spark.createDataFrame([(1, "A", 1.0, 0), (1, "A", 2.0, 1), (1, "X", 9.0, 0), (2, "D", 4.0, 0), (2, "B", None, 0), (3, "X", 9.0, 0)], "s int, g string, v double, pos int")
    got = {(r["s"], r["g"]): (r["v"], r["missing_share"]) for r in joins.aligned(axis, rows, "g", "v", -10.0, by=["s"]).collect()}
    assert got == {
        (1, "A"): (2.0, 0.75), (1, "B"): (-10.0, 0.75), (1, "C"): (-10.0, 0.75), (1, "D"): (-10.0, 0.75),
        (2, "A"): (-10.0, 0.5), (2, "B"): (-10.0, 0.5), (2, "C"): (-10.0, 0.5), (2, "D"): (4.0, 0.5),
        (3, "A"): (-10.0, 1.0), (3, "B"): (-10.0, 1.0), (3, "C"): (-10.0, 1.0), (3, "D"): (-10.0, 1.0),
    }


def test_dense_rows_are_made_by_all_tasks(spark):
    axis = spark.range(300).select(F.concat(F.lit("g"), "id").alias("g"))
    rows = spark.range(40).select(F.col("id").alias("s"), F.concat(F.lit("g"), F.col("id") * 2).alias("g"), F.lit(1.0).alias("v"), F.lit(0).alias("pos"))
    dense = joins.aligned(axis, rows, "g", "v", -10.0, by=["s"], digits=3).withColumn("task", F.spark_partition_id()).cache()
    assert dense.select("task").distinct().count() >= 8  # more than the four shuffle partitions, which hold few bytes
    assert dense.count() == dense.select("s", "g").distinct().count() == 40 * 300 and {r["missing_share"] for r in dense.select("missing_share").distinct().collect()} == {0.997}
    assert [(r["s"], r["g"]) for r in dense.where("v = 1.0").orderBy("s").collect()] == [(k, f"g{2 * k}") for k in range(40)] and dense.where("v = -10.0").count() == 40 * 299
    assert joins.aligned(axis.limit(0), rows, "g", "v", -10.0, by=["s"]).count() == 0


def test_blocks_of_dense_groups_may_have_any_size(spark, monkeypatch):
    axis = spark.range(50).select(F.concat(F.lit("g"), "id").alias("g"))
    rows = spark.range(400).select((F.col("id") % 20).alias("s"), F.concat(F.lit("g"), F.col("id") % 70).alias("g"), F.lit(1.0).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, "g1", 5.0), (3, "g3", 4.0), (3, None, 7.0), (99, "x", 1.0)], "s long, g string, v double")).repartition(3)
    want = {(s, f"g{g}"): -10.0 for s in [*range(20), 99, None] for g in range(50)}
    want |= {(k % 20, f"g{k % 70}"): sum(j % 20 == k % 20 and j % 70 == k % 70 for j in range(400)) + 4.0 * (k % 20 == 3 and k % 70 == 3) for k in range(400) if k % 70 < 50}
    share = {s: sum(v == -10.0 for (t, _), v in want.items() if t == s) / 50 for s, _ in want}
    for most, cells in ((256, 1 << 20), (3, 1 << 20), (256, 5), (1, 1)):  # one block a task; several, by groups and by cells
        monkeypatch.setattr(joins, "BLOCK", most)
        monkeypatch.setattr(joins, "CELLS", cells)
        dense = joins.aligned(axis, rows, "g", "v", -10.0, by=["s"], digits=8, how=F.sum("v"))
        got = dense.collect()
        assert len(got) == len(want) and {(r["s"], r["g"]): (r["v"], r["missing_share"]) for r in got} == {k: (v, round(share[k[0]], 8)) for k, v in want.items()}


def test_dense_groups_are_shuffled_once_and_written_in_runs(spark, tmp_path):
    axis = spark.range(20_000).select(F.col("id").alias("g"))
    rows = spark.range(4000).select((F.col("id") % 400).alias("s"), (F.col("id") * 7).alias("g"), F.lit(1.0).alias("v"), F.lit(0).alias("pos"))
    dense = joins.aligned(axis, rows, "g", "v", -10.0, by=["s"], digits=3)
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*\bs#", plan)) == 1
    dense.write.parquet(str(tmp_path / "dense"))
    assert spark.read.parquet(str(tmp_path / "dense")).count() == 8_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "dense").glob("*.parquet")) < 8_000_000  # under a byte a row


def test_every_fold_is_nested_and_scored(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    nested = entry.queries()["m02_nested_folds"](spark, d).collect()
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert {(r["outer_fold"], r["inner_fold"]) for r in nested} == {(o, i) for o in range(3) for i in range(2)} and sum(r["n"] for r in nested) == 2 * n
    scored = entry.queries()["m06_multiclass_probe"](spark, d).collect()
    assert {r["fold"] for r in scored} == {0, 1, 2} and sum(r["n_pos"] for r in scored) == n and all(0 <= r["auc"] <= 1 for r in scored)


def test_open_windows_come_from_the_stream(spark, tmp_path):
    from sampleloom.streaming.logs import run_to_table, windowed

    for k, day in enumerate(("2024-01-02", "2024-01-01")):  # the second file is late
        spark.createDataFrame([("a", 1.0 + k), ("b", 2.0)], "g string, v double").withColumn("ts", F.to_timestamp(F.lit(day))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("g string, v double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_to_table(windowed(src, "ts", "g", "v", late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"), mode="complete")
    got = sorted((str(r["start"])[:10], r["g"], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01", "a", 1, 2.0), ("2024-01-01", "b", 1, 2.0), ("2024-01-02", "a", 1, 1.0), ("2024-01-02", "b", 1, 2.0)]


def test_the_grid_is_searched_on_inner_folds(spark):
    from sampleloom.stats import learn

    rng = random.Random(3)
    rows = [(k, k // 10, k // 10 % 2, k % 2, [(k % 2) + rng.gauss(0, 1), rng.gauss(0, 1)]) for k in range(160)]
    df = spark.createDataFrame(rows, "key int, series int, fold int, y int, v array<double>")
    got = learn.searched_probe(df, "v", "y", "series", "fold", 2, regs=[50.0, 0.01], elastics=[0.9], inner=2).collect()  # 50 leaves no coefficient
    assert sorted(r["key"] for r in got) == list(range(160)) and {r["reg"] for r in got} == {0.01}


def test_fits_of_a_search_share_their_passes(spark):
    from sampleloom.stats import learn

    rng = random.Random(3)
    rows = [(k, k // 10, k // 10 % 2, k % 2 if k > 2 else None, [3 * (k % 2) + rng.gauss(0, 1), rng.gauss(0, 1), 1.0]) for k in range(160)]
    df = spark.createDataFrame(rows, "key int, series int, fold int, y int, v array<double>")
    spark.sparkContext.setJobGroup("search", "search")
    try:
        got = learn.searched_probe(df, "v", "y", "series", "fold", 2, regs=[0.1, 0.03, 0.01, 0.003], elastics=[0.1, 0.5, 0.9], inner=2).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["key"] for r in got) == list(range(160)) and sum(r["label"] is None for r in got) == 3
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("search")) < 100  # 48 fits and 2 refits, a job a step if alone
    assert auc.roc_auc(spark.createDataFrame([r for r in got if r["label"] is not None]), "label", "score").first()["auc"] > 0.9
    assert learn.searched_probe(df.limit(0), "v", "y", "series", "fold", 2, regs=[0.1], elastics=[0.5]).count() == 0


def test_fits_in_lockstep_are_those_of_pyspark(spark, monkeypatch):
    from sampleloom.stats import elastic

    rng = random.Random(5)
    rows = []
    for k in range(400):
        y, a = k % 3 % 2, rng.gauss(0, 1)
        rows.append(([y + a, rng.gauss(a, 1), rng.gauss(5, 3), 0.1, y + rng.gauss(0, 2)], None if k == 9 else float(y), [k // 7 % 3 - (k % 50 == 0) * 3, 0 if y and k != 9 else -1]))
    one = spark.createDataFrame([(x, y, [elastic.NONE if p[0] < 0 else p[0], p[1]]) for x, y, p in rows], "x array<double>, label double, part array<int>").coalesce(1)
    sets = [(0, 0), (0, 0), (0, 2), (0, None), (1, None)]
    pairs = [(0.01, 0.5), (0.3, 0.9), (0.0, 0.0), (0.001, 0.1), (0.01, 0.5)]
    want = elastic.fitted(one, sets, elastic.scales(one, sets, 5), pairs)
    spread = one.repartition(3)
    scales = elastic.scales(spread, sets, 5)
    for name, value, digits in (("SUMS", 1, 1e-7), ("WIDE", 0, 2e-3)):  # a fit at a time, sums by a shuffle; pyspark.ml
        with monkeypatch.context() as m:
            m.setattr(elastic, name, value)
            got = elastic.fitted(spread, sets, scales, pairs)
        assert abs(got[:4] - want[:4]).max() < digits and got[4, 0] == want[4, 0] == math.inf and not got[4, 1:].any()
    assert (want[:, 4] == 0).all() and (want[1, 1:] == 0).sum() >= 3 and abs(want[1, 1:]).sum() < abs(want[0, 1:]).sum()
    with pytest.raises(Exception, match="0 or 1"):
        elastic.scales(one.withColumn("label", F.lit(2.0)), sets, 5)


def test_filters(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.6,), (None,)], "p double")
    assert filters.keep_at_most(df, "p", 0.5).count() == 2 and filters.keep_at_most(df, "p", 0.5, False).count() == 1 and filters.keep_at_most(df, "no", 0.5).count() == 4
    rare = spark.createDataFrame([("a",)] * 10 + [("b",)] * 9, "l string")
    assert filters.prune_rare(rare, "l", 10).count() == 10
    assert one(spark, filters.nameable(F.lit(" ensg1 "), F.lit("x"))) is False and one(spark, filters.nameable(F.lit("AB1"), F.lit("ab1 "))) is False


def test_sources(spark, tmp_path):
    with pytest.raises(files.MissingArtifact, match="made by: labels"):
        files.require(spark, str(tmp_path / "no.parquet"), "labels")
    with pytest.raises(ValueError, match="pool"):
        files.check_provenance({"pool": "x", "n_samples": 1, "passed": True}, "y", 1)
    with pytest.raises(ValueError, match="gaps"):
        files.embedding_array(spark.createDataFrame([(1.0, 2.0)], "e0000 double, e0002 double"))
    with pytest.raises(ValueError, match="checks failed"):
        sinks.write_manifest(spark, str(tmp_path / "m.json"), 0.0, {}, {"a": True, "b": False})
    import numpy as np

    from sampleloom.sources import vectors

    for k in range(5):
        np.save(tmp_path / f"GSM{k}.npy", np.arange(3.0) + k)
    df = vectors.read_vectors(spark, str(tmp_path), 3)
    assert {r["key"]: r["features"] for r in df.collect()}["GSM4"] == [4.0, 5.0, 6.0]
    with pytest.raises(Exception, match="wrong width"):
        vectors.read_vectors(spark, str(tmp_path), 4).collect()
    assert vectors.missing_keys(spark.createDataFrame([("GSM1",), ("GSM9",)], "k string"), df, "k").collect()[0]["k"] == "GSM9"


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k string, g string, v double, y int")
    assert windows.ranked(e, F.asc("v"), by=["g"]).count() == 0 and sampling.uniform(e, "k", 5, "s").count() == 0 and sampling.matched_classes(e, "g", "y", "k", 1, "s").count() == 0
    assert aggregates.mad(e, "v").count() in (0, 1) and joins.provenance_union("k", a=e, b=e).count() == 0
    assert math.isclose(1.0, 1.0)


def test_correlation_with_missing_cells_against_brute_force(spark):
    rng = random.Random(8)
    base = {k: rng.random() for k in range(60)}
    rows = [("a", k, base[k]) for k in range(60) if k != 3] + [("b", k, 2 * base[k] + 1) for k in range(60) if k != 7] + [("flat", k, 4.0) for k in range(60)]
    rows += [(f"g{g}", k, rng.choice([None, float("nan"), rng.random()])) for g in range(9) for k in range(60)] + [("few", 1, 0.5), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "gene string, sample_index long, v double")
    cell = {(g, k): v for g, k, v in rows if g is not None and v is not None and v == v}
    genes = sorted({g for g, _ in cell})

    def pearson(x, y):
        both = [k for k in range(60) if (x, k) in cell and (y, k) in cell]
        if len(both) < 2:
            return None
        p, q = [cell[x, k] for k in both], [cell[y, k] for k in both]
        mp, mq = sum(p) / len(p), sum(q) / len(q)
        sp, sq = sum((v - mp) ** 2 for v in p), sum((v - mq) ** 2 for v in q)
        return sum((u - mp) * (v - mq) for u, v in zip(p, q)) / (sp * sq) ** 0.5 if min(sp, sq) > 1e-12 else 0.0

    want = {g: sorted(((-round(r, 9), h) for h in genes if h != g and (r := pearson(g, h)) is not None))[:4] for g in genes}
    for block, chunk in ((512, 2048), (3, 10)):
        got = {}
        for r in expression.pearson_top(df, 4, block, chunk).collect():
            got.setdefault(r["gene"], []).append((r["rank"], -round(r["r"], 9) + 0.0, r["partner"]))
        assert {g: [x[1:] for x in sorted(v)] for g, v in got.items()} == {g: [(x[0] + 0.0, x[1]) for x in v] for g, v in want.items() if v}
    assert want["a"][0] == (-1.0, "b")
    assert expression.pearson_top(df.limit(0), 4).count() == 0


def test_pairs_are_different_and_all_if_there_are_few(spark):
    df = spark.createDataFrame([(g, f"n{k:03d}") for g, n in (("one", 1), ("two", 2), ("five", 5), ("many", 300)) for k in range(n)] + [("five", "n000"), ("five", None), (None, "x")], "g string, name string")
    got = {}
    for r in sampling.unordered_pairs(df, "g", "name", 40, "s").collect():
        got.setdefault(r["g"], []).append((r["a"], r["b"]))
    assert {g: len(v) for g, v in got.items()} == {"two": 1, "five": 10, "many": 40} and all(len(set(v)) == len(v) and all(a < b for a, b in v) for v in got.values())


@pytest.mark.parametrize("small", [0, 1 << 62])
def test_ranks_and_quantiles_over_ranges(spark, monkeypatch, small):
    from sampleloom.operators import order

    monkeypatch.setattr(order, "_estimated_bytes", lambda df: 1)
    monkeypatch.setattr(order, "SMALL", small)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), *(float(k) for k in range(20))]), k) for k in range(3000)] + [("c", 5.0, -1), ("d", None, -2)]
    df = spark.createDataFrame(rows, "g string, v double, k long")
    ranked = order.global_rank(df, F.asc("v"), F.asc("k"), out="r").orderBy("r").collect()
    key = lambda r: (r["v"] is not None, r["v"] is not None and r["v"] != r["v"], r["v"] if r["v"] == r["v"] else 0, r["k"])
    assert [r["r"] for r in ranked] == list(range(1, len(rows) + 1)) and ranked == sorted(ranked, key=key)
    got = {r["g"]: r["q"] for r in order.quantiles(df, "v", [0.0, 1 / 3, 0.5, 0.9, 1.0], ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        v = sorted(x for h, x, _ in rows if h == g and x is not None and x == x)
        for p, q in zip((0.0, 1 / 3, 0.5, 0.9, 1.0), got[g]):
            at = p * (len(v) - 1)
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert abs(q - (low + (at - math.floor(at)) * (high - low))) < 1e-9
    assert set(got) == {"a", "b", "c", None}
    assert order.quantiles(df.limit(0), "v", [0.5]).first()["q"] == [None] and order.global_rank(df.limit(0), F.asc("k")).count() == 0


def test_a_probe_with_an_estimator_of_ones_own(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    from sampleloom.stats import learn

    df = spark.createDataFrame([(k, [float(k % 2), float(k % 7)], k % 2, k % 3) for k in range(300)], "key long, x array<double>, y int, fold int")
    p = learn.probe(df, "x", "y", "fold", 3, estimator=lambda col: DecisionTreeClassifier(featuresCol=col, labelCol="label", seed=1))
    rows = p.collect()
    assert len(rows) == 300 and all((r["score"] > 0.5) == (r["label"] == 1) for r in rows)


def test_rows_beyond_the_landmarks_are_placed(spark):
    from sampleloom.stats import embedding

    rng = random.Random(12)
    df = spark.createDataFrame([(k, [10.0 * (k % 2) + rng.random(), rng.random(), 5.0 * (k % 2)]) for k in range(240)] + [(999, None)], "k long, f array<double>")
    rows = {r["k"]: (r["x"], r["y"]) for r in embedding.embedded(df, "k", "f", landmarks=80).collect()}
    assert len(rows) == 241 and rows[999] == (None, None)
    centre = [tuple(sum(rows[k][i] for k in range(240) if k % 2 == c) / 120 for i in (0, 1)) for c in (0, 1)]
    near = lambda p, c: (p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2
    assert sum(near(rows[k], centre[k % 2]) < near(rows[k], centre[1 - k % 2]) for k in range(240)) >= 230
    assert embedding.embedded(df.limit(0), "k", "f").count() == 0


def test_cuts_can_be_discarded(spark):
    from sampleloom import session
    from sampleloom.sources import store

    session.discard_all(spark)
    a, b = session.cut(spark.range(5)), session.cut(spark.range(0).selectExpr("id", "map('a', id) as m"))
    assert a.count() == 5 and b.count() == 0 and b.columns == ["id", "m"] and store.size_of(spark, a._cut_path) > 0
    session.discard(a)
    assert store.size_of(spark, a._cut_path) is None and session.discard_all(spark) == 1 and store.size_of(spark, b._cut_path) is None
