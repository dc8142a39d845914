"""Writers and merge-like updates."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.sources.store import size_of, write_text


def write_with_schema(df: DataFrame, path: str, schema: str) -> None:
    """Parquet after a checked cast to the contract's schema."""
    from pyspark.sql.types import StructType

    df.to(StructType.fromDDL(schema)).write.mode("overwrite").parquet(path)


def append_new(df: DataFrame, path: str, key: str, schema: str) -> None:
    """Append as JSON lines the rows whose key isn't in the log yet; a repeated call adds nothing."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(schema).json(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as e:  # the log doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.dropDuplicates([key]).write.mode("append").json(path)


def classify_write(new: DataFrame, existing: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, state: new, identical or mismatch; only the new ones may be written, a mismatch never overwrites."""
    old = existing.select(key, F.col(value).alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col(value), "identical").otherwise("mismatch")
    return new.join(old, key, "left").select(key, value, state.alias("state"))


def write_manifest(spark: SparkSession, path: str, started: float, parameters: dict, checks: dict[str, bool]) -> dict:
    """A JSON sidecar with times, parameters and the checks; raises after writing if one failed."""
    failures = sorted(k for k, ok in checks.items() if not ok)
    manifest = {"started": started, "finished": time.time(), **parameters, "sanity_checks": {**checks, "failures": failures}, "passed": not failures}
    write_text(spark, path, json.dumps(manifest, indent=1))
    if failures:
        raise ValueError(f"checks failed: {failures}")
    return manifest


def collect_artifacts(spark: SparkSession, wanted: dict[str, str]) -> DataFrame:
    """(name, path, bytes): the named artifacts; bytes is null for those that are missing."""
    return spark.createDataFrame([(k, p, size_of(spark, p)) for k, p in wanted.items()], "name string, path string, bytes long")


def conversations_json(df: DataFrame, key: str, question: str, answer: str, image: str | None = None) -> DataFrame:
    """(key, json): the record of a two-turn conversation, with an image mark in the first turn where there is one."""
    ask = F.concat(F.lit("<image>\n"), F.col(question)) if image else F.col(question)
    turns = F.array(F.struct(F.lit("human").alias("from"), ask.alias("value")), F.struct(F.lit("gpt").alias("from"), F.col(answer).alias("value")))
    parts = [F.col(key).cast("string").alias("id")] + ([F.col(image).alias("image")] if image else []) + [turns.alias("conversations")]
    return df.select(key, F.to_json(F.struct(*parts)).alias("json"))


def leaderboard_answers(df: DataFrame, key: str, answer: str, kind: str, prefix: str = "v1_") -> DataFrame:
    """question_id and answer as a benchmark wants them: plain, gqa (no full stop, lower case) or prefixed ids."""
    if kind == "gqa":
        return df.select(F.col(key).cast("string").alias("question_id"), F.lower(F.rtrim(F.regexp_replace(answer, r"\.+$", ""))).alias("answer"))
    if kind == "prefixed":
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("question_id"), F.col(answer).alias("answer"))
    return df.select(F.col(key).cast("string").alias("question_id"), F.col(answer).alias("answer"))


def submission(split: DataFrame, answers: DataFrame, key: str, answer: str) -> DataFrame:
    """Every question of the split with its answer, '' where there is none."""
    return split.select(key).join(answers.select(key, answer), key, "left").select(key, F.coalesce(F.col(answer), F.lit("")).alias(answer))


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row): each row as a line of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("row"))
