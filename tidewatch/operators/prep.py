"""Preprocessing fitted on training rows only: imputation, scaling and one-hot encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import quantiles
from tidewatch.roles import Roles
from tidewatch.sources.tables import stored


def medians(frame: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Exact median per (group and) numeric column."""
    return quantiles(frame, columns, [0.5], groups).select(*groups, "feature", F.col("all_q0").alias("median"))


def most_frequent(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent known value per categorical column, ties to the smallest value; from one frequency table."""
    pairs = frame.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])))
    counts = pairs.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("most_frequent"), F.max("n").alias("records"))


@dataclass(frozen=True)
class Imputation:
    """Fill values by column; plain numbers and words, so applying them is a map-only projection."""

    numeric: Mapping[str, float]
    categorical: Mapping[str, str]

    def apply(self, frame: DataFrame) -> DataFrame:
        return frame.withColumns({
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in self.numeric.items()},
            **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.categorical.items()},
        })


def fit_imputation(frame: DataFrame, roles: Roles) -> Imputation:
    """A column without any value is filled with 0 or 'missing'."""
    found = {r["feature"]: r["median"] for r in medians(frame, roles.numeric).collect()} if roles.numeric else {}
    modes = {r["feature"]: r["most_frequent"] for r in most_frequent(frame, roles.categorical).collect()} if roles.categorical else {}
    return Imputation(
        {c: 0.0 if found.get(c) is None else found[c] for c in roles.numeric},
        {c: modes.get(c) or "missing" for c in roles.categorical},
    )


def scaling(frame: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per (group and) column, in one aggregation."""
    pairs = frame.select(*groups, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])))
    return pairs.groupBy(*groups, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def standardize(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column becomes 0."""
    found = {r["feature"]: (r["mean"], r["deviation"]) for r in scaling(frame, columns).collect()}  # one row per column

    def scaled(name: str) -> Column:
        mean, deviation = found[name]
        return (F.col(name).cast("double") - F.lit(mean)) / F.lit(deviation or 1.0)

    return frame.withColumns({c: scaled(c) for c in columns if found.get(c, (None,))[0] is not None})


def fit_dictionary(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, word, place): the known words of each column, numbered from 0 by code point. Stored.

    Words are cut into ranges, counted per range and numbered inside them, so a column may have any number of categories: neither
    the driver nor one task ever holds them all.
    """
    pairs = frame.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("word")) for c in columns])))
    words = pairs.where("word is not null").distinct()
    ranged = stored(words.repartitionByRange("feature", "word").withColumn("_block", F.spark_partition_id()), "words")
    before = Window.partitionBy("feature").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("feature", "_block").agg(F.count(F.lit(1)).alias("_n")).select("feature", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("feature", "_block").orderBy("word")
    placed = ranged.withColumn("_at", F.row_number().over(inside)).join(starts, ["feature", "_block"])
    return stored(placed.select("feature", "word", (F.col("_start") + F.col("_at") - 1).alias("place")), "dictionary")


def encode(frame: DataFrame, roles: Roles, dictionary: DataFrame, output: str = "features") -> DataFrame:
    """Adds the assembled row as a sparse vector (size, indices, values): the numbers, then one place per known category.

    An unseen or missing category has no place, so all its zeros stay zero. Spark broadcasts a dictionary below its own limit and
    joins a larger one by a shuffle.
    """
    counts = {r["feature"]: r["n"] for r in dictionary.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
    width = len(roles.numeric)
    entries = [F.struct(F.lit(i).cast("long").alias("place"), F.col(c).cast("double").alias("value")) for i, c in enumerate(roles.numeric)]
    rows = frame
    for i, column in enumerate(roles.categorical):
        words = dictionary.where(F.col("feature") == column).select(F.col("word").alias(f"_word_{i}"), (F.col("place") + width).alias(f"_place_{i}"))
        rows = rows.join(words, F.col(column).cast("string") == F.col(f"_word_{i}"), "left").drop(f"_word_{i}")
        entries.append(F.struct(F.col(f"_place_{i}").alias("place"), F.lit(1.0).alias("value")))
        width += counts.get(column, 0)
    kept = F.filter(F.array(*entries), lambda e: e["place"].isNotNull())
    vector = F.struct(F.lit(width).cast("long").alias("size"), F.transform(kept, lambda e: e["place"]).alias("indices"), F.transform(kept, lambda e: e["value"]).alias("values"))
    return rows.withColumn(output, vector).drop(*[f"_place_{i}" for i in range(len(roles.categorical))])


def dense(vector: str) -> Column:
    """A sparse vector as an array of doubles."""
    known = F.map_from_arrays(F.col(f"{vector}.indices"), F.col(f"{vector}.values"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.col(f"{vector}.size") - 1), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(0.0)))


def category_codes(columns: Sequence[str]) -> list[Column]:
    """A 64-bit code per category: equality is all a detector needs, so no vocabulary is collected."""
    return [F.xxhash64(F.coalesce(F.col(c), F.lit("missing"))).alias(f"code_{c}") for c in columns]
