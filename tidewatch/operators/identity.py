"""Row identity and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import dense_index
from tidewatch.sources.tables import stored
from tidewatch.sources.zeek import BLOCK


def row_ids_by_number(frame: DataFrame, unique_number: str, output: str = "flow_row_id") -> DataFrame:
    """0..n-1 in the order of a unique numeric column."""
    return dense_index(frame, unique_number, output)


def row_ids_by_file_order(frame: DataFrame, output: str = "flow_row_id", source: str = "source_file", broadcast_blocks: int = 100_000) -> DataFrame:
    """0..n-1 in (file, line) order for a filtered scan made with ``keep_order=True``. No row is moved, as long as
    there are at most ``broadcast_blocks`` file blocks (counted first); beyond that the offsets are joined by a shuffle.

    The scan is stored first: how files are cut into blocks depends on the cores at hand when it is planned, so two scans could
    be cut differently. Each file block was read by one task, so the surviving lines already rise inside it. Only one row per block
    (count and first line) is aggregated; running totals inside each file and over the files give its offset.
    """
    key = [source, BLOCK]
    # dense inside a block: the counter is taken after the filter
    numbered = stored(frame.withColumn("_line", F.monotonically_increasing_id()), "lines")
    blocks = numbered.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    inside = Window.partitionBy(source).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy(source).agg(F.sum("_n").alias("_file_n")).withColumn("_all", F.lit(1))
    over = Window.partitionBy("_all").orderBy(source).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select(source, F.coalesce(F.sum("_file_n").over(over), F.lit(0)).alias("_start"))
    offsets = blocks.select(*key, "_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_before")).join(starts, source)
    offsets = offsets.select(*key, "_first", (F.col("_start") + F.col("_before")).alias("_offset"))
    few = numbered.select(*key).distinct().limit(broadcast_blocks + 1).count() <= broadcast_blocks
    return (
        numbered.join(F.broadcast(offsets) if few else offsets, key)
        .withColumn(output, F.col("_offset") + F.col("_line") - F.col("_first"))
        .drop("_line", "_first", "_offset", BLOCK)
    )


def id_uniqueness(frame: DataFrame, row_id: str) -> DataFrame:
    """Rows and surplus rows per id, as one record."""
    per_id = frame.groupBy(row_id).agg(F.count("*").alias("_n"))
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("records"), F.count("*").alias("distinct_ids"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicated_ids"),
    )


def check_unique_ids(frame: DataFrame, row_id: str, name: str) -> None:
    surplus = id_uniqueness(frame, row_id).first()["duplicated_ids"]
    if surplus:
        raise ValueError(f"{name} holds {surplus} duplicated {row_id} values")


def alignment(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Row counts of two tables and how many ids only one of them has; one shuffle of ids and counts."""
    tagged = left.select(row_id, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(row_id, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_id = tagged.groupBy(row_id).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return per_id.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("left_records"), F.coalesce(F.sum("_r"), F.lit(0)).alias("right_records"),
        F.count_if(F.col("_r") == 0).alias("only_left"), F.count_if(F.col("_l") == 0).alias("only_right"),
        F.count_if((F.col("_l") > 1) | (F.col("_r") > 1)).alias("repeated_ids"),
    )


def check_alignment(left: DataFrame, right: DataFrame, row_id: str) -> None:
    found = alignment(left, right, row_id).first()
    if found["left_records"] != found["right_records"] or found["only_left"] or found["only_right"] or found["repeated_ids"]:
        raise ValueError(f"tables do not align on {row_id}: {found.asDict()}")
