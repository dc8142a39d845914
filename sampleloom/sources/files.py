"""Readers of the file formats around a cohort: all are declarative scans with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.sources.store import read_text, size_of


class MissingArtifact(FileNotFoundError):
    """An input is missing; the message names the step that makes it."""


def require(spark: SparkSession, path: str, produced_by: str, least_bytes: int = 0) -> str:
    """The path, if files of at least least_bytes are there."""
    size = size_of(spark, path)
    if size is None or size < least_bytes:
        raise MissingArtifact(f"{path} is missing or too small; it is made by: {produced_by}")
    return path


def check_provenance(manifest: dict, pool: str, n_samples: int) -> None:
    """Refuse an upstream manifest of another pool or size, or one whose own checks failed."""
    problems = [f"{k}: {manifest.get(k)!r}, not {v!r}" for k, v in (("pool", pool), ("n_samples", n_samples), ("passed", True)) if manifest.get(k) != v]
    if problems:
        raise ValueError("; ".join(problems))


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or nulls where the table has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def first_present(df: DataFrame, *names: str, required: bool = False) -> Column:
    """The first of several column names that the table has; null, or an error with `required`, if it has none."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    if required:
        raise ValueError(f"none of {names} in {df.columns}")
    return F.lit(None).cast("string")


def expect_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has all the columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, comment: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV or TSV with a schema, a projection, and lines of comment left out."""
    reader = spark.read.schema(schema).option("header", header).option("sep", sep)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.select(*columns) if columns else df


def read_symbol_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines id TAB type TAB location TAB "SYM, ALIAS; description" as id, symbol, aliases; without ';' unmapped (null)."""
    raw = spark.read.schema("id string, type string, location string, names string").option("sep", "\t").csv(path)
    names = F.transform(F.split(F.substring_index("names", ";", 1), ","), lambda x: F.trim(x))
    mapped = F.when(F.contains("names", F.lit(";")), names)
    return raw.select("id", F.get(mapped, F.lit(0)).alias("symbol"), F.when(mapped.isNotNull(), F.slice(mapped, 2, 1000)).alias("aliases"))


def read_links(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Two-column TSV of links whose first column begins with the prefix."""
    return spark.read.schema("source string, target string").option("sep", "\t").csv(path).where(F.startswith("source", F.lit(prefix)))


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that spans lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines of one or several files. strict: fail on a bad line; else leave bad (cut off) lines out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    rows = spark.read.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    return rows.withColumn("_bad", F.col("_corrupt_record").isNotNull()).where("not _bad").drop("_bad", "_corrupt_record")


def _plain_yaml(text: str) -> dict[str, list[str]]:
    """The lists of texts of a YAML file that holds nothing else: "name:" lines and "- text" lines below them."""
    given: dict[str, list[str]] = {}
    for n, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- ") and given:
            item = bare[2:].strip()
            given[next(reversed(given))].append(json.loads(item) if item[:1] == '"' else item.strip("'"))
        elif line == line.lstrip() and bare.endswith(":"):
            given[bare[:-1].strip("'\"")] = []
        else:
            raise ValueError(f"line {n} is neither a name nor an item: {line!r}")
    return given


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """A small JSON or YAML dictionary category -> list of texts, as (category, template_index, text)."""
    text = read_text(spark, path)
    given = _plain_yaml(text) if path.endswith((".yaml", ".yml")) else json.loads(text)
    rows = [(c, i, t) for c, texts in given.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "category string, template_index int, text string")


def ordered_column(wanted: DataFrame, df: DataFrame, key: str, value: str, partitions: int = 16) -> DataFrame:
    """(pos, key, value): one column of df for the wanted (pos, key), read in parallel and given back in the order of pos."""
    found = wanted.join(df.select(key, value), key, "left").select("pos", key, value)
    return found.repartitionByRange(partitions, "pos").sortWithinPartitions("pos")


def embedding_array(df: DataFrame, stem: str = "e", out: str = "features") -> DataFrame:
    """Fold wide columns e0000, e0001, ... into one array; refuses gaps and near misses of the name."""
    import re

    wide = {int(m[1]): c for c in df.columns if (m := re.fullmatch(rf"{stem}(\d+)", c))}
    if not wide or sorted(wide) != list(range(len(wide))):
        raise ValueError(f"embedding columns {sorted(wide)[:3]}.. have gaps or are missing")
    keep = [c for c in df.columns if c not in wide.values()]
    return df.select(*keep, F.array(*(F.col(wide[k]) for k in sorted(wide))).alias(out))


def scrape_log(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Numbers of "'field': value" in a text log, by line."""
    lines = spark.read.text(path)
    found = lines.select(F.explode(F.regexp_extract_all("value", F.lit(rf"'{field}':\s*(-?[0-9.eE+-]+)"), F.lit(1))).alias(field))
    return found.select(F.col(field).cast("double").alias(field))


def trainer_steps(states: DataFrame, *keys: str) -> DataFrame:
    """keys, step and loss of trainers' state documents; entries without a loss are left out."""
    return states.select(*keys, F.explode("log_history").alias("h")).select(*keys, "h.step", "h.loss").where("loss is not null")


def trainer_history(spark: SparkSession, path: str) -> DataFrame:
    """(step, loss) of a trainer's state document."""
    return trainer_steps(read_json_document(spark, path, "log_history array<struct<step:bigint,loss:double>>"))
