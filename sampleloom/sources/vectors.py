"""Folders with one .npy vector per record, read from any file system through Spark's binary files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@F.pandas_udf(ArrayType(DoubleType()))
def decoded(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in contents:
        yield s.map(lambda b: np.load(io.BytesIO(b)).ravel().astype(float))


def read_vectors(spark: SparkSession, folder: str, width: int | None = None) -> DataFrame:
    """(key, features) of the .npy files of a folder; rows of another width are refused when read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content")
    df = raw.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("key"), decoded("content").alias("features"))
    if width is not None:
        fits = F.when(F.size("features") == width, F.col("features")).otherwise(F.raise_error(F.concat(F.lit("wrong width of "), "key")).cast("array<double>"))
        df = df.select("key", fits.alias("features"))
    return df


def missing_keys(wanted: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Keys without a vector."""
    return wanted.select(key).distinct().join(vectors.select(F.col("key").alias(key)), key, "left_anti")
