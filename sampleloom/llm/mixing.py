"""Mixing sources to target weights with hash-threshold histograms.

T is the sum of the sizes of all documents. A source's budget in a mix is target_weight x T, or max_repeat times its size
where that is less (the mix can't be met then). It takes floor(budget / size) whole copies of each document and, for what
is left, the documents below a hash threshold: sizes are summed by source and hash bucket, the bucket in which the rest
ends is found and refined, and only documents of the boundary bucket are ranked; all others are kept or not by comparing
their bucket. No document is sorted, and thresholds of one source nest over mixes.

A null size counts 0 (such documents go with their hash like any other), a negative one too. Sources are compared in
lower case without outer blanks; documents without a source count for T only. A null weight or max_repeat counts 0.
Repeated (mix, source) targets add up their weights and take the larger max_repeat. Sources without documents have no
size and can't meet a weight above 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.functions.text import clean_lower
from sampleloom.llm.hash_budget import boundaries, fine_bucket, hash63
from sampleloom.operators.skew import join_dimension


def _documents(docs: DataFrame, doc: str, source: str, size: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), clean_lower(F.col(source)).alias("src"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("weight"))


def mix_plan(docs: DataFrame, mixes: DataFrame, doc: str = "doc_id", source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per mix and source: wanted and possible tokens, the source's tokens, whole copies, the rest, and whether it falls short."""
    rows = _documents(docs, doc, source, size)
    tokens = rows.groupBy("src").agg(F.sum("weight").alias("tokens"))
    total = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    goal = mixes.select(F.col("mix_id"), clean_lower(F.col("source")).alias("src"), F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeat", F.lit(0)).alias("r"))
    goal = goal.where("mix_id is not null and src is not null").groupBy("mix_id", "src").agg(F.sum("w").alias("weight"), F.max("r").alias("max_repeat"))
    plan = goal.join(tokens.where("src is not null"), "src", "left").crossJoin(total)  # total is one row
    plan = plan.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("wanted", F.col("weight") * F.col("total"))
    plan = plan.withColumn("most", F.col("max_repeat") * F.col("tokens")).withColumn("budget", F.least(F.col("wanted"), F.col("most").cast("double")))
    copies = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    plan = plan.withColumn("copies", copies).withColumn("rest", F.col("budget") - F.col("copies") * F.col("tokens"))
    return plan.withColumn("short", F.col("wanted") > F.col("most"))


def mix_selection(docs: DataFrame, mixes: DataFrame, doc: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: str = "mix") -> DataFrame:
    """mix_id, document, source, tokens and how often the mix uses the document (1 or more)."""
    rows = _documents(docs, doc, source, size).where("src is not null").withColumn("h", hash63("doc", seed=seed))
    plan = mix_plan(docs, mixes, doc, source, size)
    ends = boundaries(rows, plan.where("rest > 0").select("mix_id", "src", F.col("rest").alias("budget")), ["src"], ["mix_id"])
    plan = plan.select("mix_id", "src", "copies").join(ends, ["mix_id", "src"], "left").withColumn("b", F.coalesce("b", F.lit(-1)))
    used = join_dimension(rows.withColumn("bucket", fine_bucket(F.col("h"))), plan, ["src"]).where((F.col("copies") > 0) | (F.col("bucket") <= F.col("b")))
    sure = used.where("bucket <> b").select("mix_id", "doc", "src", "weight", (F.col("copies") + (F.col("bucket") < F.col("b")).cast("int")).alias("times"))
    upto = Window.partitionBy("mix_id", "src").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, 0)  # one fine bucket of a source
    edge = used.where("bucket = b").withColumn("sum", F.col("before") + F.sum("weight").over(upto))
    # a document goes in while at least half of it fits the budget
    edge = edge.select("mix_id", "doc", "src", "weight", (F.col("copies") + (F.col("sum") - F.col("weight") / 2 <= F.col("budget")).cast("int")).alias("times"))
    return sure.unionByName(edge).where("times > 0").select("mix_id", F.col("doc").alias(doc), F.col("src").alias("source"), F.col("weight").alias("tokens"), "times")


def mix_shares(docs: DataFrame, mixes: DataFrame, **names: str) -> DataFrame:
    """Per mix and source: target weight, the share reached, tokens used and whether the target is out of reach."""
    got = mix_selection(docs, mixes, **names).groupBy("mix_id", F.col("source").alias("src")).agg(F.sum(F.col("tokens") * F.col("times")).alias("used"))
    plan = mix_plan(docs, mixes, **names).join(got, ["mix_id", "src"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    whole = plan.groupBy("mix_id").agg(F.sum("used").alias("all_used"))
    return plan.join(whole, "mix_id").select("mix_id", F.col("src").alias("source"), F.round("weight", 6).alias("target_weight"), "max_repeat", "used", F.round(F.col("used") / F.when(F.col("all_used") > 0, F.col("all_used")), 6).alias("share"), "short")
