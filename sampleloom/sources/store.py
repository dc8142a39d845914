"""Small files of any file system that Spark knows: existence, size, text; and one vector file a record, written by tasks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def size_of(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or of all files of a folder; None if nothing is there."""
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else None


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small text file, written whole under another name and then renamed: readers see all of it or nothing."""
    fs, where = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"{path} can't be written")
    return path


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def write_vectors(df: DataFrame, key: str, vector: str, folder: str) -> DataFrame:
    """(key, state) after writing each record's vector as <key>.npy; a file that is there is kept: identical if its bytes
    are the same, else mismatch, which is reported and never overwritten.

    Tasks write their own files, each under another name first, so a lost or repeated task leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        store, root = files.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        store.create_dir(root)
        for batch in batches:
            states = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buffer = io.BytesIO()
                np.save(buffer, np.asarray(v, np.float32))
                name, data = f"{root}/{k}.npy", buffer.getvalue()
                if store.get_file_info(name).type == files.FileType.File:
                    with store.open_input_stream(name) as f:
                        states.append("identical" if f.read() == data else "mismatch")
                    continue
                with store.open_output_stream(f"{name}.part") as f:
                    f.write(data)
                store.move(f"{name}.part", name)
                states.append("new")
            yield pa.record_batch([batch.column(0), pa.array(states, pa.string())], names=["key", "state"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"key {kind}, state string")
