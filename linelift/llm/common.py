"""Helpers shared by the operators: tables in the shared folder, input checks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import linelift

from linelift.session import ensure_checkpoint_dir


def shared_table_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/linelift-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of executors without
    recomputing ``df``, and every later read sees the same rows.
    """
    spark = df.sparkSession
    path = shared_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/linelift-" in folder:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"input lacks the columns {missing}; it has {df.columns}")


BATCH_BYTES = "8m"
"""Bytes of rows that a Python worker is handed at a time, where the session says nothing."""


def ship_package(spark: SparkSession) -> None:
    """Prepare Python workers: let them import this package (sent once per Spark application)
    and bound their batches by bytes, since texts may be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_linelift_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(linelift.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="linelift-"), "linelift.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("linelift", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._linelift_shipped = True


def small(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, where each row becomes many Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
