"""Session helpers: table access, lineage cuts and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that `cut` has written and nobody has discarded.
_WRITTEN: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sampleloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SAMPLELOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a folder of our own where it is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = sc.getCheckpointDir()
    if where is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if where is None:
        where = "file://" + tempfile.mkdtemp(prefix="sampleloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to a table of its own in the shared folder and read it from there: its lineage ends, and the loss of
    executors costs nothing. `discard` removes the table."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _WRITTEN.add(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def discard(df: DataFrame) -> None:
    """Remove the table that `cut` wrote for df, which must not be read any more."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        _remove(df.sparkSession, path)


def discard_all(spark: SparkSession) -> int:
    """Remove every table that `cut` has written in this process and that is still there, once no result is read any more."""
    paths = list(_WRITTEN)
    for path in paths:
        _remove(spark, path)
    return len(paths)


def fresh_name(stem: str, taken: list[str]) -> str:
    """A column name that clashes with none of `taken` (compared without case)."""
    low = {x.lower() for x in taken}
    name = f"_{stem}"
    while name.lower() in low:
        name = f"_{stem}_{uuid.uuid4().hex[:6]}"
    return name
