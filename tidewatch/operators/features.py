"""Feature summaries, relevance verdicts and the approved feature list.

The target is 0/1. Distinct counts, dominant shares, top categories and exact quantiles all come from
value-frequency tables, i.e. one shuffle of (feature, value) counts; raw rows are never sorted or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.cleaning import ratio
from tidewatch.operators.ordering import quantiles_of, value_counts
from tidewatch.operators.profile import MISSING
from tidewatch.roles import Roles

# Verdict limits.
NEAR_CONSTANT, HIGH_MISSING, WEAK_EFFECT, LOW_EFFECT = 0.995, 60.0, 0.2, 0.1
TOP_CATEGORIES, NAMED_CATEGORIES = 10, 5
CLASSES = {"overall": None, "benign": 0, "malicious": 1}


def _in_class(name: str, target: Column) -> Column:
    code = CLASSES[name]
    return F.lit(True) if code is None else target == code


def numeric_statistics(frame: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Per feature: moments, range and quartiles overall and per class, missing share, distinct, dominant share."""
    y = F.col(target)
    counted = value_counts(frame, columns, {k: _in_class(k, y).cast("int") for k in CLASSES})
    quartiles = quantiles_of(counted, list(CLASSES), [0.25, 0.5, 0.75])
    # one wide aggregation, no row is multiplied; one row per feature afterwards
    slim = frame.select(y.alias("_y"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    facts: dict[str, str] = {"missing": "count_if({v} IS NULL)"}
    for name, code in CLASSES.items():
        value = "{v}" if code is None else f"CASE WHEN _y = {code} THEN {{v}} END"
        facts |= {f"{name}_{n}": f"{f}({value})" for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))}
    wide = slim.agg(F.count("*").alias("records"), *[F.expr(f"{e.format(v=f'_v{i}')} AS _{i}_{n}") for i in range(len(columns)) for n, e in facts.items()])
    plain = wide.select("records", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"_{i}_{n}").alias(n) for n in facts]) for i, c in enumerate(columns)
    ]))).select("feature", "records", *facts)
    # one row per feature on both sides
    return plain.join(F.broadcast(quartiles), "feature", "left").withColumns({
        "unique_non_null": F.coalesce("distinct_values", F.lit(0)),
        "dominant": F.greatest("largest_count", "missing"),
    })


def standardized_gap(mean0: Column, mean1: Column, std0: Column, std1: Column) -> Column:
    """|m1 - m0| over the root mean square of the class deviations; an unknown deviation is left out."""
    v0, v1 = std0 * std0, std1 * std1
    return ratio(F.abs(mean1 - mean0), F.sqrt(F.coalesce((v0 + v1) / 2, v0, v1)))


def numeric_summary(frame: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """The 33-column table with verdict; statistics rounded to 6 digits, missing percent to 4."""
    s = numeric_statistics(frame, columns, target).withColumns({
        "effect": standardized_gap(F.col("benign_mean"), F.col("malicious_mean"), F.col("benign_std"), F.col("malicious_std")),
        "share": ratio(F.col("dominant"), F.col("records")),
        "missing_share": ratio(F.col("missing"), F.col("records")) * 100.0,
    })
    constant = F.col("unique_non_null") <= 1
    flat = (F.col("share") >= NEAR_CONSTANT) | (F.col("overall_std") == 0) | F.col("overall_std").isNull()
    sparse = (F.col("missing_share") >= HIGH_MISSING) & (F.col("effect") < WEAK_EFFECT)
    # The words of notes and verdicts.
    note = (
        F.when(constant, "constant feature").when(flat, "near-constant behaviour")
        .when(sparse, "high missingness with weak class separation")
        .when(F.col("effect") < LOW_EFFECT, "low standalone separation, but retain for multivariate modelling")
    )
    verdict = F.when(constant, "DROP").when(flat | sparse, "REVIEW").otherwise("KEEP")
    evidence = F.concat_ws("; ", F.format_string("effect_size=%.3f", "effect"),
                           F.format_string("dominant_value_ratio=%.3f", "share"), note)

    def r(column: str, name: str, digits: int = 6) -> Column:
        # the last digits of a sum depend on the order of addition: drop them first, so ties round one way
        return F.expr(f"round(round({column}, {digits + 4}), {digits}) AS {name}")

    statistics = {"mean": "mean", "median": "q1", "std": "std", "min": "min", "q25": "q0", "q50": "q1", "q75": "q2", "max": "max"}
    return s.select(
        "feature", F.lit("numerical").alias("type"), r("missing_share", "missing_percentage", 4), "unique_non_null",
        r("share", "dominant_value_ratio"),
        *[r(f"{k}_{source}", f"{k}_{shown}") for k in CLASSES for shown, source in statistics.items()],
        r("abs(malicious_mean - benign_mean)", "mean_gap"), r("effect", "standardized_mean_gap"),
        evidence.alias("relevance_evidence"), verdict.alias("recommendation"),
    )


def category_counts(frame: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Value-frequency table of categorical columns with NULL as '<MISSING>'."""
    long = frame.select(F.col(target).alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns
    ])))
    return long.groupBy("feature", "value").agg(
        F.count("*").alias("records"), F.count_if(F.col("_y") == 0).alias("benign"), F.count_if(F.col("_y") == 1).alias("malicious"),
    ).select("feature", F.coalesce("value", F.lit(MISSING)).alias("category"), F.col("value").isNull().alias("is_missing"),
             "records", "benign", "malicious")


def _totals(counts: DataFrame) -> DataFrame:
    """One row per feature."""
    return counts.groupBy("feature").agg(
        F.sum("records").alias("all_records"), F.sum(F.when(F.col("is_missing"), F.col("records")).otherwise(0)).alias("missing"),
        F.count_if(~F.col("is_missing")).alias("unique_categories"), F.max("records").alias("dominant"),
        ratio(F.sum("malicious"), F.sum(F.col("benign") + F.col("malicious"))).alias("base_rate"),
    )


def _ranked(counts: DataFrame, top: int) -> DataFrame:
    """The most frequent categories per feature; the rank limit is applied before the shuffle as well."""
    order = Window.partitionBy("feature").orderBy(F.desc("records"), "category")
    labelled = F.col("benign") + F.col("malicious")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn(
        "malicious_rate", ratio(F.col("malicious"), labelled)
    )


def top_category_table(counts: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    """Per feature the top categories with counts and class shares."""
    labelled = F.col("benign") + F.col("malicious")
    sizes = F.broadcast(_totals(counts).select("feature", "all_records"))  # one row per feature
    return _ranked(counts, top).join(sizes, "feature").select(
        "feature", "category", labelled.alias("count"),
        F.round(ratio(F.col("records"), F.col("all_records")) * 100.0, 4).alias("percentage"),
        F.col("benign").alias("benign_count"), F.col("malicious").alias("malicious_count"),
        F.round(ratio(F.col("benign") * 100.0, labelled), 4).alias("benign_percentage_within_category"),
        F.round(ratio(F.col("malicious") * 100.0, labelled), 4).alias("malicious_percentage_within_category"),
    )


def strongest_association(counts: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    """Per feature the top category whose malicious rate is farthest from the base rate; the more frequent wins ties."""
    totals = F.broadcast(_totals(counts))  # one row per feature
    gap = F.abs(F.col("malicious_rate") - F.col("base_rate"))
    named = F.array_sort(F.collect_list(F.when(F.col("rank") <= NAMED_CATEGORIES, F.struct("rank", "category"))))
    best = _ranked(counts, top).join(totals, "feature").groupBy("feature").agg(
        F.max_by(F.struct("category", "malicious_rate"), F.struct(gap, -F.col("rank"))).alias("best"),
        F.array_join(F.transform(named, lambda x: x["category"]), ", ").alias("top_categories"),
    )
    percent = F.round(F.col("best.malicious_rate") * 100.0, 4)
    return best.join(totals, "feature").select(
        "feature", "all_records", "missing", "unique_categories", "dominant", "base_rate", "top_categories",
        F.col("best.category").alias("strongest_category"), percent.alias("strongest_percent"),
        F.when(percent / 100.0 >= F.col("base_rate"), "Malicious").otherwise("Benign").alias("leaning"),
    )


def categorical_summary(counts: DataFrame) -> DataFrame:
    """Verdict per categorical feature; high missingness overrides the other rules."""
    s = strongest_association(counts).withColumns({
        "share": ratio(F.col("dominant"), F.col("all_records")),
        "missing_share": ratio(F.col("missing"), F.col("all_records")) * 100.0,
    })
    constant, flat = F.col("unique_categories") <= 1, F.col("share") >= NEAR_CONSTANT
    sparse = F.col("missing_share") >= HIGH_MISSING
    verdict = F.when(sparse | (flat & ~constant), "REVIEW").when(constant, "DROP").otherwise("KEEP")
    evidence = F.concat_ws(
        "; ",
        F.format_string("unique_categories=%d", "unique_categories"), F.format_string("dominant_value_ratio=%.3f", "share"),
        F.when(constant, "constant categorical feature").when(flat, "near-constant categorical feature"),
        F.format_string("top association: %s -> %s (%.1f%% malicious)", "strongest_category", "leaning", "strongest_percent"),
        F.when(sparse, "high missingness"),
    )
    return s.select(
        "feature", F.lit("categorical").alias("type"), F.round("missing_share", 4).alias("missing_percentage"), "unique_categories",
        F.round("share", 6).alias("dominant_value_ratio"), "top_categories", evidence.alias("relevance_evidence"),
        verdict.alias("recommendation"),
    )


def recommendations(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    columns = ["feature", "type", "missing_percentage", "relevance_evidence", "recommendation"]
    return numeric.select(*columns).unionByName(categorical.select(*columns))


def summary_with_detail(summary: DataFrame, detail: DataFrame) -> DataFrame:
    """Each summary row with its top categories (one row per feature is broadcast)."""
    return detail.join(F.broadcast(summary), "feature", "right")


def approved(recommended: DataFrame, roles: Roles) -> DataFrame:
    """Features not dropped, with their canonical position."""
    place = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(roles.features) for x in (f, i)]), F.col("feature"))
    return recommended.where(F.col("recommendation") != "DROP").select("feature", "type", place.alias("position"))


def approved_roles(recommended: DataFrame | None, roles: Roles) -> Roles:
    """The roles cut down to the approved features; all of them when there are no recommendations."""
    if recommended is None:
        return roles
    kept = {r["feature"] for r in approved(recommended, roles).collect()}  # one row per feature
    return roles.without(*[f for f in roles.features if f not in kept])
