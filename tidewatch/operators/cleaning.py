"""Column selection, filters and cleaning of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.cleaning import (
    UNSET_OR_EMPTY, fill_category, label_code, null_markers, tidy_domain, tidy_label, to_number,
)
from tidewatch.roles import CLASS_CODES, Roles


def keep_available(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in list order."""
    return frame.select(*[c for c in columns if c in frame.columns])


def drop_excluded(frame: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Drop leaking and identifying columns; names that are not there are ignored."""
    return frame.drop(*excluded)


def excluded_report(frame: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Per excluded name whether the table has it, and how many values it holds (one scan)."""
    present = [c for c in excluded if c in frame.columns]
    counts = frame.agg(*[F.count(c).alias(c) for c in present], F.count("*").alias("_rows"))
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(c in present).alias("present"),
            (F.col(c) if c in present else F.lit(0).cast("bigint")).alias("values"),
        ) for c in excluded
    ])))


def rename_columns(frame: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return frame.withColumnsRenamed(dict(names))


def with_text_nulls(frame: DataFrame, columns: Sequence[str], markers: Sequence[str] = UNSET_OR_EMPTY) -> DataFrame:
    return frame.withColumns({c: null_markers(F.col(c), markers) for c in columns})


def binary_rows(frame: DataFrame, target: str, codes: Mapping[str, int] = CLASS_CODES) -> DataFrame:
    """Rows of the classes in the task; the rest is held out."""
    return frame.where(F.col(target).isin(*codes))


def held_out_count(frame: DataFrame, target: str, codes: Mapping[str, int] = CLASS_CODES) -> DataFrame:
    return frame.agg(
        F.count("*").alias("records"),
        F.count_if(F.lower(F.trim(F.col(target))) == "unknown").alias("unknown_records"),
        F.count_if(~F.coalesce(F.col(target), F.lit("")).isin(*codes)).alias("held_out_records"),
    )


def populated(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(F.col(column).isNotNull() & (F.col(column) != ""))


def any_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def coerce_numbers(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return keep_checked(frame, columns).withColumns({c: to_number(F.col(c)) for c in columns})


def fill_categories(frame: DataFrame, columns: Sequence[str], filler: str = "missing") -> DataFrame:
    return keep_checked(frame, columns).withColumns({c: fill_category(F.col(c), filler) for c in columns})


def keep_checked(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = [c for c in columns if c not in frame.columns]
    if absent:
        raise ValueError(f"required columns are absent: {absent}")
    return frame


def with_clean_label(frame: DataFrame, label: str, output: str = "label_clean") -> DataFrame:
    return frame.withColumn(output, tidy_label(F.col(label)))


def with_clean_domain(frame: DataFrame, column: str, output: str = "indicator_clean") -> DataFrame:
    return frame.withColumn(output, tidy_domain(F.col(column)))


def check_labels(frame: DataFrame, target: str, allowed: Sequence) -> None:
    """Raise when a label outside the allowed set is left. The message counts them all and names the twenty most frequent."""
    odd = frame.where(F.col(target).isNull() | ~F.col(target).isin(*allowed))
    per_label = odd.groupBy(F.col(target).cast("string").alias("v")).agg(F.count("*").alias("n"))
    total = per_label.agg(F.count("*").alias("labels"), F.sum("n").alias("rows")).first()
    if total["labels"]:
        most = [(str(r["v"]), r["n"]) for r in per_label.orderBy(F.desc("n"), "v").limit(20).collect()]
        raise ValueError(f"{total['rows']} rows with {total['labels']} unexpected labels in {target}, most frequent: {most}")


def unexpected_labels(frame: DataFrame, target: str, allowed: Sequence) -> DataFrame:
    """The same guard as a count."""
    return frame.agg(
        F.count_if(F.col(target).isNull() | ~F.col(target).isin(*allowed)).alias("unexpected_labels")
    )


def modelling_table(frame: DataFrame, roles: Roles, codes: Mapping[str, int] = CLASS_CODES, beside: Sequence[str] = ()) -> DataFrame:
    """Row id, numeric features as doubles, filled categories, the 0/1 target and the columns ``beside``; filter and casts in one pass."""
    rows = binary_rows(frame, roles.target, codes)
    return rows.select(
        roles.row_id,
        *[to_number(F.col(c)).alias(c) for c in roles.numeric],
        *[fill_category(F.col(c)).alias(c) for c in roles.categorical],
        label_code(F.col(roles.target), dict(codes)).alias(roles.target),
        *beside,
    )


def metadata_table(frame: DataFrame, roles: Roles, codes: Mapping[str, int] = CLASS_CODES) -> DataFrame:
    """Traceability columns of the same rows, 1:1 on the row id."""
    return keep_available(binary_rows(frame, roles.target, codes), [roles.row_id, *roles.metadata])


def join_on_row_id(modelling: DataFrame, metadata: DataFrame, roles: Roles) -> DataFrame:
    """Modelling rows with their capture date; both sides share the id, so this is one shuffle join."""
    return modelling.join(metadata.select(roles.row_id, roles.date), roles.row_id, "left")
