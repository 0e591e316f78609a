"""Writes the flow view as day folders of log files, so that the readers can be run on data of any size.

One pass: header lines and data lines are rows of one table, sorted so that each part file starts with its headers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import scratch_path

LOG = "conn.log.labeled"
# The columns written and their log types.
FIELDS = ["ts", "uid", "proto", "service", "duration", "orig_bytes", "resp_bytes", "missed_bytes", "conn_state", "history",
          "label", "detailedlabel"]
TYPES = ["time", "string", "enum", "string", "interval", "count", "count", "count", "string", "string", "string", "string"]
HEADERS = ["#separator \\x09", "\t".join(["#fields", *FIELDS]), "\t".join(["#types", *TYPES])]


def epoch_text(ts: Column) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    whole = F.floor(micros / 1_000_000).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((micros - whole * 1_000_000).cast("string"), 6, "0"))


def write_day_folders(t, log: str = LOG, lane_rows: int = 200_000, spoil: Callable[[Column], Column] | None = None, narrow: str | None = None) -> str:
    """Returns the root of ``day=<date>/kind=zeek/log=<name>/part-*``. Days are split into lanes, so many that the busiest day's hold ``lane_rows``.

    ``spoil`` may change the text of lines. ``narrow`` is a condition on flows: days on which it holds lack the last two columns.
    """
    busiest = t.flow_v.groupBy("capture_date").count().agg(F.max("count")).first()[0] or 0
    lanes = max(4, -(-busiest // lane_rows))

    def text(name: str):
        column = F.col(name)
        if name == "ts":
            return epoch_text(column)
        if name in ("orig_bytes", "resp_bytes", "missed_bytes"):
            column = column.cast("bigint")
        return F.coalesce(column.cast("string"), F.lit("-"))

    lines = t.flow_v.select(
        F.col("capture_date").cast("string").alias("day"), F.pmod(F.xxhash64("flow_row_id"), F.lit(lanes)).alias("lane"),
        F.col("flow_row_id").alias("place"), (F.expr(narrow) if narrow else F.lit(False)).alias("narrow"), F.concat_ws("\t", *[text(f) for f in FIELDS]).alias("value"),
    )
    if spoil:
        lines = lines.withColumn("value", spoil(F.col("value")))
    short = lambda value: F.regexp_replace(value, "\t[^\t]*\t[^\t]*$", "")
    tops = lines.select("day", "lane", "narrow").distinct().select("day", "lane", "narrow", F.inline(F.array(*[
        F.struct(F.lit(i - len(HEADERS)).cast("bigint").alias("place"), F.lit(h).alias("value")) for i, h in enumerate(HEADERS)
    ])))
    root = scratch_path(t.spark, "days")
    placed = lines.unionByName(tops).withColumns({"kind": F.lit("zeek"), "log": F.lit(log), "value": F.when(F.col("narrow") & ~F.col("value").startswith("#separator"), short(F.col("value"))).otherwise(F.col("value"))})
    # two lanes of a day may share a file: their header blocks come first, then all lines in order
    block = F.when(F.col("place") < 0, F.col("lane")).otherwise(F.lit(lanes))
    spread: DataFrame = placed.repartition("day", "lane").sortWithinPartitions("day", "kind", "log", block, "place")
    spread.select("value", "day", "kind", "log").write.partitionBy("day", "kind", "log").text(root)
    return root
