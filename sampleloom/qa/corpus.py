"""From answers to a corpus: filling, checks, routing, bundling, loader contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.functions import answers as an


def fill_requests(requests: DataFrame, answered: DataFrame, templates: DataFrame) -> DataFrame:
    """ok answers with their filled question; refused ones with their reason (excluded)."""
    t = templates.select("category", F.col("template_index").alias("t"), "text")
    n = templates.groupBy("category").agg(F.count("*").alias("n_t"))
    q = requests.join(answered.select("row", "status", "reason", "answer"), "row").join(n, "category", "left").withColumn("t", F.pmod(F.col("row"), F.coalesce("n_t", F.lit(1))).cast("int"))
    filled = an.fill(F.col("text"), {"gene": F.col("gene"), "n": F.col("n"), "direction": F.col("direction"), "sample": F.col("sample")})
    return q.join(t, ["category", "t"], "left").select("row", "category", "sample", F.when(F.col("status") == "ok", filled).alias("question"), F.col("answer"), F.col("reason").alias("excluded"))


def unresolved(text: Column) -> Column:
    """A placeholder that was not filled."""
    return F.rlike(text, F.lit(r"\{[a-z_]+\}"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def route(results: DataFrame, held_out: DataFrame) -> DataFrame:
    """line_no, category and route of each logged result: pair, skipped, error, leak, no_answer or a reject.

    skip and skipped are one status. A pair whose image is held out is a leak. A pair is rejected if it claims that
    disease is absent where its gold answer doesn't (overclaim), if its verdict is the opposite (polarity), or if it drops
    numbers of the gold answer (factual); the first of these names it.
    """
    r = results.join(held_out.select("image").distinct().withColumn("held", F.lit(True)), "image", "left")
    a, g = F.col("paraphrased_answer"), F.col("gt_answer")
    wrong = F.size(F.array_except(an.numbers(g), an.numbers(a))) > 0
    over = F.coalesce(an.overclaims(a), F.lit(False)) & ~F.coalesce(an.overclaims(g), F.lit(False))
    flipped = (an.polarity(g) != "undetermined") & (an.polarity(a) != "undetermined") & (an.polarity(g) != an.polarity(a))
    where = (
        F.when(F.col("status").isin("skip", "skipped"), "skipped").when(F.col("status") != "ok", "error").when(F.col("held"), "leak")
        .when(F.trim(F.coalesce(a, F.lit(""))) == "", "no_answer").when(over, "overclaim_reject").when(flipped, "polarity_reject").when(wrong, "factual_reject").otherwise("pair")
    )
    return r.select("line_no", "category", where.alias("route"))


def bundle_gates(results: DataFrame, routes: DataFrame) -> DataFrame:
    """Per category: lines, ids, ids without a pair, pairs, leaks, rejects, the share of distinct answers and the gates."""
    digest = F.substring(F.sha2("paraphrased_answer", 256), 1, 32)  # texts aren't shuffled
    x = results.select("line_no", "id", digest.alias("a")).join(routes, "line_no").where("category is not null")
    pair = F.col("route") == "pair"
    g = x.groupBy("category").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.countDistinct(F.when(pair, F.col("id"))).alias("k"), F.count_if(pair).alias("n_pairs"),
        F.count_if(F.col("route") == "leak").alias("n_leak"), F.count_if(F.endswith("route", F.lit("reject"))).alias("n_rejected"), F.countDistinct(F.when(pair, F.col("a"))).alias("d"),
    )
    ratio = F.col("d") / F.nullif(F.col("n_pairs"), F.lit(0))
    return g.select("category", "n", "n_ids", (F.col("n_ids") - F.col("k")).alias("n_missing"), "n_pairs", "n_leak", "n_rejected", F.round(ratio, 8).alias("distinct_ratio"), F.coalesce(ratio >= 0.9, F.lit(False)).alias("distinct_enough"), (F.col("n_rejected") <= 0.1 * F.col("n")).alias("few_rejects"))


def contract(df: DataFrame, key: str, text: str, vector: str, width: int) -> DataFrame:
    """One row: vectors of another width, keys whose rows disagree on the vector, and keys whose texts repeat."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64(vector)).alias("v"), F.countDistinct(text).alias("t"), F.count_if(F.size(vector) != width).alias("w"))
    return per.agg(F.count("*").alias("n_keys"), F.sum("w").alias("wrong_width"), F.count_if(F.col("v") > 1).alias("vector_conflicts"), F.count_if(F.col("t") < F.col("n")).alias("repeated_texts"))


def unchanged(before: DataFrame, after: DataFrame, key: str, group: str) -> DataFrame:
    """Per group: rows, how many of them differ (or are in one version only), and whether the checksums of both versions
    agree. before has columns key, group and a text, after the same under another name of the text."""
    (x,), (y,) = ([c for c in df.columns if c not in (key, group)] for df in (before, after))
    both = before.where(F.col(group).isNotNull()).join(after.where(F.col(group).isNotNull()), [key, group], "full")
    digest = lambda c: F.bit_xor(F.xxhash64(F.col(key), F.col(c)))
    return both.groupBy(group).agg(F.count("*").alias("n"), F.count_if(~F.col(x).eqNullSafe(F.col(y))).alias("n_changed"), (digest(x) == digest(y)).alias("unchanged"))
