"""Hand-off tables between jobs, and result tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path


def write_table(frame: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists", dotted: bool = False) -> str:
    """Write a table. Row-level tables keep their partitions; nothing is pulled into one file.

    ``dotted`` gives ``id_orig_h`` and its kin their original dotted names (text formats).
    """
    if dotted:
        frame = frame.withColumnsRenamed({c: c.replace("id_", "id.", 1) for c in frame.columns if c.startswith("id_")})
    writer = frame.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema=None) -> DataFrame:
    """Read a table back. Text needs a schema: nothing is inferred by an extra pass."""
    reader = spark.read.format(format)
    if format == "csv":
        if schema is None:
            raise ValueError("a csv table needs a schema")
        reader = reader.option("header", "true")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs no recomputation."""
    spark = frame.sparkSession
    return read_table(spark, write_table(frame, scratch_path(spark, name)), schema=frame.schema)


COMMITS, RUNS = "commits", "runs"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, whatever kind of storage it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _listed(spark: SparkSession, path: str) -> list[str]:
    files, folder = _folder(spark, path)
    return sorted(status.getPath().getName() for status in files.listStatus(folder)) if files.exists(folder) else []


def _committed(spark: SparkSession, path: str) -> dict[str, str]:
    """The published run of every batch: the last marker wins."""
    found: dict[str, str] = {}
    for marker in _listed(spark, f"{path}/{COMMITS}"):  # one small file per published batch
        if not marker.startswith("."):
            _, batch, run = marker.split("~")
            found[unquote(batch)] = run
    return found


def append_lookups(results: DataFrame, path: str, batch: str) -> str:
    """Publish one batch of lookup results; a repeated batch replaces itself.

    The rows are written to a folder of their own, aside. Only then an empty marker file, which names batch and folder, is renamed
    into place: one step of the file system. A run that stops before leaves rows that ``read_lookups`` never looks at, and
    the earlier results of the batch stay as they were.
    """
    spark = results.sparkSession
    run = uuid.uuid4().hex
    results.withColumn("batch", F.lit(batch)).write.parquet(f"{path}/{RUNS}/{run}")
    order = max((int(m.split("~")[0]) for m in _listed(spark, f"{path}/{COMMITS}") if not m.startswith(".")), default=0) + 1
    files, folder = _folder(spark, f"{path}/{COMMITS}")
    files.mkdirs(folder)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}/.{run}")
    files.create(aside, True).close()
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}/{order:012d}~{quote(batch, safe='')}~{run}")
    if not files.rename(aside, marker):
        raise OSError(f"batch {batch} could not be published below {path}")
    return path


def read_lookups(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all published batches, with ``batch``; None before the first one."""
    runs = _committed(spark, path)
    return spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{RUNS}/{run}" for run in runs.values()]) if runs else None
