"""Profiles, distributions and data-quality tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.cleaning import fill_category, is_blank, percent, tidy_detail, tidy_label

MISSING = "<MISSING>"
TOTAL = "TOTAL"


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _named(columns: Sequence[str], value) -> Column:
    """Array of (name, value) structs, to turn one wide row into one row per column."""
    return F.inline(F.array(*[F.struct(F.lit(c).alias("item"), value(c).alias("value")) for c in columns]))


def shape(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("total_rows")).withColumn("total_columns", F.lit(len(frame.columns)).cast("bigint"))


def missing_counts(frame: DataFrame) -> DataFrame:
    """NULLs per column, most first; one aggregation over the table."""
    counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in frame.columns])
    return counts.select(_named(frame.columns, F.col)).toDF("column", "missing").orderBy(F.desc("missing"), "column")


def duplicate_rows(frame: DataFrame) -> DataFrame:
    """Rows beyond the first of their kind over all columns; NULLs count as equal."""
    copies = frame.groupBy(*frame.columns).agg(F.count("*").alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def time_range(frame: DataFrame, ts: str) -> DataFrame:
    return frame.agg(F.min(ts).alias("timestamp_min"), F.max(ts).alias("timestamp_max"))


def check_time_range(frame: DataFrame, ts: str) -> None:
    if frame.agg(F.count(ts)).first()[0] == 0:
        raise ValueError(f"column {ts} holds no usable time")


def distribution(frame: DataFrame, column: str) -> DataFrame:
    """Rows per value with NULL as a value, most frequent first, ties by value."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")
    counts = frame.groupBy(value).agg(F.count("*").alias("count"))
    return counts.select(F.lit(column).alias("metric"), "value", "count").orderBy(F.desc("count"), "value")


def profile_report(frame: DataFrame, ts: str, label: str, detail: str) -> DataFrame:
    """Long report (section, item, value). All column facts come from one aggregation; distributions are small counts."""
    def text(column: Column) -> Column:
        return column.cast("string")

    columns = frame.columns
    wide = frame.agg(
        F.count("*").alias("_rows"), F.min(ts).alias("_min"), F.max(ts).alias("_max"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns],
    )
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    facts = [("dataset", "total_rows", text(F.col("_rows"))),
             ("dataset", "total_columns", F.lit(str(len(columns)))),
             ("dataset", "timestamp_min_utc", F.date_format("_min", iso)),
             ("dataset", "timestamp_max_utc", F.date_format("_max", iso))]
    facts += [("column_dtype", name, F.lit(kind)) for name, kind in frame.dtypes]
    facts += [("missing_values", c, text(F.col(f"_null_{c}"))) for c in columns]
    summary = wide.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(i).alias("item"), v.alias("value")) for s, i, v in facts
    ])))
    copies = duplicate_rows(frame).select(
        F.lit("dataset").alias("section"), F.lit("duplicate_rows").alias("item"), text(F.col("duplicate_rows")).alias("value")
    )
    # both distributions from one scan
    pairs = frame.select(F.inline(F.array(*[
        F.struct(F.lit(section).alias("section"), F.coalesce(F.col(column), F.lit(MISSING)).alias("item"))
        for section, column in (("label_distribution", label), ("detailed_label_distribution", detail))
    ])))
    counts = pairs.groupBy("section", "item").agg(F.count("*").alias("n")).select("section", "item", text(F.col("n")).alias("value"))
    return union_all([summary, copies, counts])


def missing_by_label_and_state(frame: DataFrame, columns: Sequence[str], label: str, state: str) -> DataFrame:
    """Rows per checked column, label, state and missing flag; one scan for all columns."""
    long = frame.select(label, state, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).isNull().alias("is_missing")) for c in columns
    ])))
    return (
        long.groupBy("feature", label, state, "is_missing").agg(F.count("*").alias("count"))
        .orderBy("feature", label, state, "is_missing")
    )


def samples_per_date(frame: DataFrame, date: str, label: str) -> DataFrame:
    return frame.groupBy(date, label).agg(F.count("*").alias("count")).orderBy(date, label)


def daily_label_summary(frame: DataFrame, date: str, label: str) -> DataFrame:
    """Per day: total, benign, malicious, unknown, other; plus one TOTAL row, in a single aggregation."""
    clean = tidy_label(F.col(label))
    daily = frame.select(F.col(date).alias("_day"), clean.alias("_label")).groupBy("_day").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("_label") == name).alias(name) for name in ("benign", "malicious", "unknown")],
    )
    measures = ["total", "benign", "malicious", "unknown"]
    # the roll-up works on one row per day
    both = daily.rollup("_day").agg(
        *[F.sum(m).alias(m) for m in measures], F.grouping("_day").alias("_is_total")
    )
    return both.select(
        F.when(F.col("_is_total") == 1, TOTAL).otherwise(F.col("_day").cast("string")).alias("date"),
        *measures,
        (F.col("total") - F.col("benign") - F.col("malicious") - F.col("unknown")).alias("other"),
    ).orderBy(F.col("date") == TOTAL, "date")


def daily_detail_counts(frame: DataFrame, date: str, label: str, detail: str) -> DataFrame:
    """Rows per day, label and detailed label; missing details become 'Not specified'."""
    return frame.groupBy(
        F.col(date).alias("date"), tidy_label(F.col(label)).alias("label"), tidy_detail(F.col(detail)).alias("detailedlabel")
    ).agg(F.count("*").alias("records")).where(F.col("label").isNotNull())


def attack_summary(details: DataFrame) -> DataFrame:
    """The malicious rows of ``daily_detail_counts`` by date, largest first."""
    return details.where(F.col("label") == "malicious").orderBy("date", F.desc("records"), "detailedlabel")


def attack_families(attacks: DataFrame, families: Sequence[str], other: str = "Other") -> DataFrame:
    """Per day one column per family (text match, first match wins) and the row total."""
    family = reduce(lambda chain, f: chain.when(F.col("detailedlabel").contains(f), f),
                    families[1:], F.when(F.col("detailedlabel").contains(families[0]), families[0])).otherwise(other)
    names = [*families, other]
    wide = attacks.groupBy("date").agg(*[
        F.coalesce(F.sum(F.when(family == n, F.col("records"))), F.lit(0)).alias(n) for n in names
    ])
    total = reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in names])
    return wide.withColumn("total_malicious", total)


def column_audit(frame: DataFrame, source_types: Mapping[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: source type, missing, missing percent, distinct non-missing values (markers count as missing).

    One pass turns rows into (column, value) pairs and counts values; the second aggregation sees values only.
    """
    columns = list(columns or frame.columns)
    pairs = frame.select(_named(columns, lambda c: F.when(~is_blank(F.col(c)), F.trim(F.col(c).cast("string")))))
    values = pairs.groupBy("item", "value").agg(F.count("*").alias("n"))
    audit = values.groupBy("item").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.sum("n").alias("_all"),
        F.count("value").alias("unique_non_missing"),
    )
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, source_types.get(c, "derived"))])
    return audit.select(
        F.col("item").alias("column"), F.element_at(kinds, F.col("item")).alias("type"), "missing",
        percent(F.col("missing"), F.col("_all"), 2).alias("missing_percent"), "unique_non_missing",
    )


def missing_percent_by_label(frame: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    return frame.groupBy(tidy_label(F.col(label)).alias("label")).agg(
        F.count("*").alias("records"),
        *[percent(F.count_if(is_blank(F.col(c))), F.count("*"), 2).alias(f"{c}_missing_percent") for c in columns],
    )


def missing_percent_by_feature(by_label: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """The table above turned round: one row per feature, one column per label."""
    long = by_label.select("label", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}_missing_percent").alias("share")) for c in columns
    ])))
    return long.groupBy("feature").pivot("label", list(labels)).agg(F.max("share"))


def date_label_crosstab(frame: DataFrame, date: str, label: str, labels: Sequence[str]) -> DataFrame:
    return frame.groupBy(date).agg(*[F.count_if(F.col(label) == v).alias(v) for v in labels])


def class_distribution_by_date(frame: DataFrame, date: str, target: str, codes: Mapping[str, object]) -> DataFrame:
    """One column per class (0 when absent) and the total."""
    counts = frame.groupBy(date).agg(*[F.count_if(F.col(target) == v).alias(n) for n, v in codes.items()])
    return counts.withColumn("Total", reduce(lambda a, b: a + b, [F.col(n) for n in codes]))


def class_distribution(frame: DataFrame, target: str, codes: Mapping[str, object]) -> DataFrame:
    """One row per class, 0 when the class is absent."""
    counts = frame.agg(*[F.count_if(F.col(target) == v).alias(n) for n, v in codes.items()])
    return counts.select(_named(list(codes), F.col)).toDF("label", "count")


def category_crosstab(frame: DataFrame, category: str, label: str, labels: Sequence[str], positive: str) -> DataFrame:
    """Per category: rows per label, total, share of the positive label."""
    counts = frame.groupBy(fill_category(F.col(category)).alias(category)).agg(
        *[F.count_if(F.col(label) == v).alias(v) for v in labels]
    )
    wide = counts.withColumn("total", reduce(lambda a, b: a + b, [F.col(v) for v in labels]))
    return wide.withColumn(f"{positive}_percent", percent(F.col(positive), F.col("total"), 2))


def top_categories(crosstab: DataFrame, category: str, size: int = 15) -> DataFrame:
    return crosstab.orderBy(F.desc("total"), category).limit(size)
