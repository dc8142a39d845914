"""Stand-ins for a cohort's tables made of the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.session import table

#: Sparse sample x gene counts: absent pairs are zeros.
EXPR = "expr AS (SELECT l_suppkey AS sample_index, l_partkey AS gene, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1, 2)"
#: Dense vectors, long.
EMB = "emb AS (SELECT vec_id AS sample_index, label, unnest(range(len(embedding)))::INTEGER AS gene, unnest(embedding)::DOUBLE AS v FROM embeddings)"
#: Distinct samples with their latest row.
DE = "de AS (SELECT * FROM per_sample_de QUALIFY row_number() OVER (PARTITION BY sample_index ORDER BY ingested_at DESC, series_id) = 1)"
#: One label row per sample.
LAB = "lab AS (SELECT DISTINCT * FROM sample_labels)"
#: Binary truth, score and group for metrics: ties come from rounding.
SCORED = "scored AS (SELECT sample_index, series_id, y, round(z, 1) AS score FROM (SELECT d.sample_index, upper(trim(d.series_id)) AS series_id, CASE WHEN l.is_cvd_disease THEN 1 ELSE 0 END AS y, d.mean_abs_z::DOUBLE AS z FROM de d JOIN lab l USING (sample_index) WHERE d.status = 'ok' AND d.mean_abs_z IS NOT NULL AND d.series_id IS NOT NULL))"


def expr(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_index"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("n"))


def emb(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("sample_index"), "label", F.posexplode("embedding").alias("gene", "v")).withColumn("v", F.col("v").cast("double"))


def de(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest row of each sample, with the given columns (all by default); only these are shuffled."""
    t = table(s, d, "per_sample_de")
    keep = columns or [c for c in t.columns if c != "sample_index"]
    return t.groupBy("sample_index").agg(F.max_by(F.struct(*keep), F.struct("ingested_at", F.negative(F.xxhash64("series_id")))).alias("r")).select("sample_index", "r.*")


def lab(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sample_labels").distinct()


def scored(s: SparkSession, d: str) -> DataFrame:
    x = de(s, d, "status", "mean_abs_z", "series_id").where("status = 'ok' and mean_abs_z is not null and series_id is not null").select("sample_index", F.upper(F.trim("series_id")).alias("series_id"), F.round(F.col("mean_abs_z").cast("double"), 1).alias("score"))
    return x.join(lab(s, d).select("sample_index", F.col("is_cvd_disease").cast("int").alias("y")), "sample_index")
