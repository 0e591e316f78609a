"""Reader for Zeek logs: tab-separated text whose ``#`` header lines carry the schema.

One reader with an explicit list of missing markers covers every use: ``("-",)`` for profiles,
``("-", "(empty)")`` for modelling, ``()`` for the raw view. Words such as ``NA`` or ``null`` are data.
Only whole lines that start with ``#`` are comments, and there is no quoting: both follow the log format.
Dots in column names become underscores (``id.orig_h`` -> ``id_orig_h``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.cleaning import epoch_to_timestamp, null_markers

BLOCK = "_block"

# Log types and their column types; everything else is text.
COLUMN_TYPES = {
    "count": T.LongType(), "int": T.LongType(), "port": T.LongType(),
    "double": T.DoubleType(), "interval": T.DoubleType(),
}
# Patterns of text that stands for a value of a type, and the type it is cast to.
WHOLE, REAL = "^[+-]?[0-9]+$", "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
TYPED = {"count": ("bigint", WHOLE), "int": ("bigint", WHOLE), "port": ("bigint", WHOLE), "double": ("double", REAL), "interval": ("double", REAL),
         "time": ("double", REAL), "bool": ("boolean", "^[TF]$")}


@dataclass(frozen=True)
class LogHeader:
    path: str
    fields: tuple[str, ...]
    types: tuple[str, ...]


def discover(spark: SparkSession, root: str, log: str) -> list[str]:
    """Paths of one log over all days. Lists files only: the content column is never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    # file names, one per day and log kind
    pattern = rf"/([^/]+=)?{re.escape(log)}(/[^/]+)?$"
    paths = [r["path"] for r in listing.where(F.col("path").rlike(pattern)).orderBy("path").collect()]
    if not paths:
        raise FileNotFoundError(f"no {log} below {root}")
    return paths


def parse_header(path: str, lines: Sequence[str]) -> LogHeader:
    found = {line.split("\t", 1)[0]: tuple(line.rstrip("\r\n").split("\t")[1:]) for line in lines}
    fields, types = found.get("#fields", ()), found.get("#types", ())
    if not fields:
        raise ValueError(f"no #fields line in {path}")
    if not types:
        raise ValueError(f"no #types line in {path}")
    if len(fields) != len(types):
        raise ValueError(f"#fields and #types differ in length in {path}")
    return LogHeader(path, fields, types)


@contextmanager
def _one_file_a_task(spark: SparkSession):
    """No file is split and no two files share a task while this lasts."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for name, value in zip(names, (str(1 << 45), str(1 << 45), None)):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _heads(batches: Iterator) -> Iterator:
    """The #fields and #types lines at the head of a file; reading stops at the first line of data."""
    import pyarrow as pa

    for batch in batches:
        paths, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data = next((i for i, line in enumerate(lines) if not line.startswith("#")), len(lines))
        wanted = [i for i in range(data) if re.match("#(fields|types)\t", lines[i])]
        yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in wanted], pa.string()), pa.array([lines[i] for i in wanted], pa.string())], names=["path", "line"])
        if data < len(lines):
            return


def read_headers(spark: SparkSession, paths: Sequence[str]) -> list[LogHeader]:
    """Header of every file, by one job with a task a file that reads no further than the head. Two lines a file reach the driver."""
    with _one_file_a_task(spark):
        lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(_heads, "path string, line string").collect()
    found: dict[str, list[str]] = {}
    for r in lines:
        found.setdefault(_plain(unquote(r["path"])), []).append(r["line"])  # metadata escape characters, listings don't
    return [parse_header(path, found.get(_plain(path), [])) for path in paths]


def _plain(path: str) -> str:
    """One spelling of a path: ``file:/x`` and ``file:///x`` are the same."""
    return re.sub("^([a-z0-9+.-]+):/+", r"\1:/", path)


def header_catalogue(spark: SparkSession, root: str, logs: Sequence[str]) -> DataFrame:
    """Per requested log, header version and field: position, name, type, and how many files have that version; one 'not found' row for an absent log."""
    rows, paths = [], {}
    for log in logs:
        try:
            paths |= {path: log for path in discover(spark, root, log)}
        except FileNotFoundError:
            rows.append((log, "not found", None, None, None, None))
    versions: dict[tuple, int] = {}
    for header in read_headers(spark, list(paths)) if paths else []:
        key = (paths[header.path], header.fields, header.types)
        versions[key] = versions.get(key, 0) + 1
    for (log, fields, types), files in versions.items():
        rows += [(log, "found", i, f, k, files) for i, (f, k) in enumerate(zip(fields, types))]
    return spark.createDataFrame(rows, "log string, status string, position int, field string, type string, files int")


def safe_name(field: str) -> str:
    return field.replace(".", "_")


def capture_date(path: Column, log: str) -> Column:
    """The day folder two levels above the log, with or without a ``key=`` prefix."""
    return F.regexp_extract(path, rf"/(?:[^/=]+=)?([^/=]+)/[^/]+/(?:[^/=]+=)?{re.escape(log)}(?:/[^/]+)?$", 1)


def _read_same_schema(spark: SparkSession, paths: list[str], header: LogHeader, log: str, markers: Sequence[str],
                      typed: bool, keep_order: bool) -> DataFrame:
    names = [safe_name(f) for f in header.fields]
    kinds = [COLUMN_TYPES.get(k, T.StringType()) if typed else T.StringType() for k in header.types]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    reader = spark.read.schema(schema).options(sep="\t", comment="#", quote="", escape="", mode="PERMISSIVE")
    if markers:
        reader = reader.option("nullValue", markers[0])
    source = reader.csv(paths)
    columns = []
    for name, kind, zeek_type in zip(names, kinds, header.types):
        column = F.col(name)
        if typed and zeek_type == "time":
            column = epoch_to_timestamp(column)
        elif typed and zeek_type == "bool":
            column = F.when(column == "T", True).when(column == "F", False)
        elif isinstance(kind, T.StringType) and len(markers) > 1:
            column = null_markers(column, markers[1:])
        elif isinstance(kind, T.StringType) and not markers:
            column = F.coalesce(column, F.lit(""))
        columns.append(column.alias(name))
    path = F.col("_metadata.file_path")
    order = [F.col("_metadata.file_block_start").alias(BLOCK)] if keep_order else []
    return source.select(*columns, path.alias("source_file"), capture_date(path, log).alias("capture_date"), *order)


def _read_lines(spark: SparkSession, paths: list[str], header: LogHeader, log: str, markers: Sequence[str], typed: bool, keep_order: bool, bad: str) -> DataFrame:
    """As ``_read_same_schema``, from whole lines: every field is looked at, whatever columns are asked for later."""
    parts = F.split("value", "\t", -1)
    wrong, columns = F.size(parts) != len(header.fields), []
    for i, (field, zeek_type) in enumerate(zip(header.fields, header.types)):
        text = F.get(parts, F.lit(i))
        column = text if not markers else null_markers(text, markers)
        if typed and zeek_type in TYPED:
            kind, pattern = TYPED[zeek_type]
            wrong |= column.isNotNull() & ~F.coalesce(column.rlike(pattern) & (column.try_cast(kind).isNotNull()), F.lit(False))
            if zeek_type == "time":
                column = epoch_to_timestamp(F.when(column.rlike(pattern), column))
            else:
                column = F.when(column.rlike(pattern), column.try_cast(kind))
        columns.append(column.alias(safe_name(field)))
    path = F.col("_metadata.file_path")
    order = [F.col("_metadata.file_block_start").alias(BLOCK)] if keep_order else []
    lines = spark.read.text(paths).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(*columns, path.alias("source_file"), capture_date(path, log).alias("capture_date"), F.when(wrong, F.col("value")).alias(bad), *order)


def scan(spark: SparkSession, root: str, log: str, markers: Sequence[str] = ("-", "(empty)"), typed: bool = False,
         columns: Sequence[str] | None = None, keep_order: bool = False, bad: str | None = None) -> DataFrame:
    """All days of a log with ``source_file`` and ``capture_date``.

    Files with equal headers are one multi-path read; other headers are added by name. ``typed`` uses the log's
    own types, else every column is text. ``keep_order`` keeps what ``row_ids_by_file_order`` needs. ``bad`` names a column for
    the text of malformed lines (fewer or more fields than the header has, or a field that isn't of its type); without it
    they are rows whose unreadable fields are NULL. ``set_aside`` takes them out.
    """
    headers = read_headers(spark, discover(spark, root, log))
    groups: dict[tuple, list[LogHeader]] = {}
    for header in headers:
        groups.setdefault((header.fields, header.types), []).append(header)
    frames = [
        _read_lines(spark, [h.path for h in same], same[0], log, markers, typed, keep_order, bad) if bad
        else _read_same_schema(spark, [h.path for h in same], same[0], log, markers, typed, keep_order)
        for same in groups.values()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if columns is None:
        return stacked
    extra = ["source_file", "capture_date", *([bad] if bad else []), *([BLOCK] if keep_order else [])]
    return stacked.select(*columns, *extra)


def set_aside(rows: DataFrame, bad: str) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and malformed lines as (source_file, capture_date, line)."""
    return rows.where(F.col(bad).isNull()).drop(bad), rows.where(F.col(bad).isNotNull()).select("source_file", "capture_date", F.col(bad).alias("line"))
