"""Train, test and calibration splits that do not depend on how the rows are partitioned."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ordering import rank_cutoffs
from tidewatch.roles import Roles

EVERYTHING = "_everything"
EPOCH = dt.date(1970, 1, 1)


def dates_in(frame: DataFrame, date: str, dates: Sequence[str]) -> DataFrame:
    return frame.where(F.col(date).isin(*[F.lit(d).cast("date") for d in dates]))


def chronological_split(frame: DataFrame, train: Sequence[str], test: Sequence[str], date: str = "capture_date") -> DataFrame:
    """Rows of the listed dates with a ``split`` column; other dates are left out."""
    day = F.col(date)
    part = (
        F.when(day.isin(*[F.lit(d).cast("date") for d in train]), "train")
        .when(day.isin(*[F.lit(d).cast("date") for d in test]), "test")
    )
    return frame.withColumn("split", part).where(F.col("split").isNotNull())


def check_chronological_split(
    frame: DataFrame, train: Sequence[str], test: Sequence[str], roles: Roles, classes: int = 2
) -> None:
    """Raise unless both lists are given, disjoint and present, and the test part has every class."""
    if not train or not test:
        raise ValueError("train and test dates must both be given")
    shared = sorted(set(train) & set(test))
    if shared:
        raise ValueError(f"dates in both parts: {shared}")
    day = F.col(roles.date).cast("string")
    seen = frame.groupBy(day.alias("day")).agg(F.collect_set(roles.target).alias("classes")).collect()
    absent = sorted((set(train) | set(test)) - {r["day"] for r in seen})
    if absent:
        raise ValueError(f"dates without rows: {absent}")
    labels = {c for r in seen if r["day"] in set(test) for c in r["classes"]}
    if len(labels) < classes:
        raise ValueError(f"the test dates hold only these classes: {sorted(labels)}")


def date_presence(frame: DataFrame, train: DataFrame, test: DataFrame, date: str = "capture_date") -> DataFrame:
    """The same checks as a table: per listed date its part, row count, and whether it is missing or shared."""
    listed = train.select(date, F.lit(1).alias("in_train"), F.lit(0).alias("in_test")).unionByName(
        test.select(date, F.lit(0).alias("in_train"), F.lit(1).alias("in_test"))
    ).groupBy(date).agg(F.max("in_train").alias("in_train"), F.max("in_test").alias("in_test"))
    counts = frame.groupBy(date).agg(F.count("*").alias("records"))
    return (
        F.broadcast(listed).join(counts, date, "left")  # listed and counts: one row per day
        .select(
            date, "in_train", "in_test", F.coalesce("records", F.lit(0)).alias("records"),
            F.col("records").isNull().alias("absent"),
            ((F.col("in_train") == 1) & (F.col("in_test") == 1)).alias("overlap"),
        )
    )


def seeded_hash(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def random_split(
    frame: DataFrame, row_id: str, test_share: float, seed: int = 42, strata: Sequence[str] = ()
) -> DataFrame:
    """Exact-size seeded split: per stratum the ceil(share x n) rows with the smallest seeded hash are ``testing``.

    The cut-off row is found by counting hash prefixes, then one map-only pass labels the rows. Uniform hashes
    keep every counted group small, however large a stratum is.
    """
    groups = list(strata) or [EVERYTHING]
    rows = frame if strata else frame.withColumn(EVERYTHING, F.lit(0))
    hashed = rows.select(*groups, F.col(row_id).alias("_id"), seeded_hash(row_id, seed).alias("_hash"))
    quota = hashed.groupBy(*groups).agg(
        F.ceil(F.round(F.count("*") * F.lit(test_share), 6)).cast("bigint").alias("take")
    )
    cut = rank_cutoffs(
        hashed, {"_prefix": F.substring("_hash", 1, 5), "_key": F.struct("_hash", "_id")}, quota, groups
    ).select(*groups, F.col("_key").alias("_cut"))
    labelled = rows.join(F.broadcast(cut), groups, "left").withColumn(
        "split",
        F.when(F.struct(seeded_hash(row_id, seed).alias("_hash"), F.col(row_id).alias("_id")) <= F.col("_cut"), "testing")
        .otherwise("training"),
    )
    return labelled.drop("_cut", EVERYTHING)


def _micros(ts: str) -> Column:
    """Whole microseconds: exact, and free of time zones when a cut-off passes through the driver."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _time_levels(ts: str, row_id: str) -> dict[str, Column]:
    """Coarse to fine: minute, second, millisecond, exact time with a hash prefix (spreads rows that share one time), the row itself.

    Each level holds at most a few thousand values of the one before, so no task counts more.
    """
    digest = F.md5(F.col(row_id).cast("string"))
    time = _micros(ts)
    return {
        "_minute": F.floor(time / 60_000_000).cast("bigint"),
        "_second": F.floor(time / 1_000_000).cast("bigint"),
        "_milli": F.floor(time / 1_000).cast("bigint"),
        "_moment": F.struct(time.alias("_time"), F.substring(digest, 1, 5).alias("_prefix")),
        "_key": F.struct(digest.alias("_digest"), F.col(row_id).alias("_id")),
    }


def _time_key(ts: str, row_id: str) -> Column:
    return F.struct(
        _micros(ts).alias("_time"),
        F.struct(F.md5(F.col(row_id).cast("string")).alias("_digest"), F.col(row_id).alias("_id")).alias("_key"),
    )


def _later(ts: str, row_id: str, cut: Column) -> Column:
    """``_time_key`` beyond ``cut``; the id is hashed only for rows at the cut's own time, as a row meets many cuts."""
    own, key = F.struct(_micros(ts).alias("_time")), _time_key(ts, row_id)["_key"]
    at = F.struct(cut["_time"].alias("_time"))  # structs compare NULL times as the whole key does
    return (own > at) | ((own == at) & (key > cut["_key"]))


def time_split(frame: DataFrame, ts: str, row_id: str, fit_share: float = 0.8) -> DataFrame:
    """The earliest floor(share x n) rows are ``fit``, the rest ``calibrate``; equal times go by the id's hash."""
    rows = frame.withColumn(EVERYTHING, F.lit(0))
    narrow = rows.select(EVERYTHING, ts, row_id)
    quota = narrow.groupBy(EVERYTHING).agg(
        F.floor(F.round(F.count("*") * F.lit(fit_share), 6)).cast("bigint").alias("take")
    )
    cut = rank_cutoffs(narrow, _time_levels(ts, row_id), quota, [EVERYTHING]).select(
        EVERYTHING, F.struct(F.col("_moment._time").alias("_time"), "_key").alias("_cut")
    )
    return rows.join(F.broadcast(cut), EVERYTHING, "left").withColumn(
        "part", F.when(_time_key(ts, row_id) <= F.col("_cut"), "fit").otherwise("calibrate")
    ).drop("_cut", EVERYTHING)


def fold_dates(frame: DataFrame, date: str = "capture_date") -> DataFrame:
    """Every date after the first one is the test day of one fold (one row per day)."""
    days = frame.where(F.col(date).isNotNull()).groupBy(date).agg(F.lit(1).alias("_one"))
    first = Window.partitionBy("_one").orderBy(date)  # one row per day
    return days.withColumn("_n", F.row_number().over(first)).where("_n > 1").select(F.col(date).alias("test_date"))


def fold_cutoffs(
    benign: DataFrame, folds: DataFrame, ts: str, row_id: str, date: str = "capture_date", fit_share: float = 0.8
) -> DataFrame:
    """Per fold the last fit row of its expanding window: (test_date, _cut)."""
    narrow = benign.select(date, ts, row_id)
    folds = F.broadcast(folds)

    def spread(rows: DataFrame) -> DataFrame:
        return rows.join(folds, F.col(date) < F.col("test_date"))

    per_day = narrow.groupBy(date).agg(F.count("*").alias("_n"))
    quota = spread(per_day).groupBy("test_date").agg(
        F.floor(F.round(F.sum("_n") * F.lit(fit_share), 6)).cast("bigint").alias("take")
    )
    cut = rank_cutoffs(narrow, _time_levels(ts, row_id), quota, ["test_date"], spread, [date])
    return cut.select("test_date", F.struct(F.col("_moment._time").alias("_time"), "_key").alias("_cut"))


def fold_membership(
    benign: DataFrame, cutoffs: DataFrame, ts: str, row_id: str, date: str = "capture_date"
) -> DataFrame:
    """Benign rows of each fold's past with ``part`` fit / calibrate (range join with one row per fold)."""
    return (
        benign.join(F.broadcast(cutoffs), F.col(date) < F.col("test_date"))
        .withColumn("part", F.when(_later(ts, row_id, F.col("_cut")), "calibrate").otherwise("fit"))
        .drop("_cut")
    )


def fit_segments(
    benign: DataFrame, cutoffs: DataFrame, ts: str, row_id: str, date: str = "capture_date", output: str = "_segment"
) -> tuple[DataFrame, list[str]] | None:
    """Benign rows with the number of the first fold whose fit rows include them (NULL: none), and the folds in order.

    None if fit rows of some fold aren't fit rows of the next one, which takes times that run against the dates. Cuts rise with the
    folds, so the folds before a row are found by binary search; only rows at a cut's own time are held against all of them.
    """
    cuts = cutoffs.select("test_date", F.col("_cut._time").alias("t"), F.col("_cut._key._digest").alias("d"), F.col("_cut._key._id").alias("i")).orderBy("test_date").collect()  # one row per fold
    keys = [(r["t"], r["d"], r["i"]) for r in cuts]
    if any(a > b for a, b in zip(keys, keys[1:])):
        return None
    folds = cutoffs.agg(F.collect_list(F.struct("test_date", "_cut")).alias("_folds"))  # one row, one item per fold
    outside = F.size(F.filter("_folds", lambda f: (F.col(date) >= f["test_date"]) | _later(ts, row_id, f["_cut"])))
    rows, times = benign, [k[0] for k in keys]
    if cuts and None not in times and isinstance(benign.schema[date].dataType, T.DateType):
        steps, days = sorted(set(times)), [r["test_date"] for r in cuts]
        day = F.unix_date(date).cast("double")
        rows = benign.withColumns({"_time": F.coalesce(_micros(ts).cast("double"), F.lit(0.0)), "_day": F.coalesce(day, F.lit(0.0))})
        rows = Bucketizer(inputCols=["_time", "_day"], outputCols=["_passed", "_begun"], splitsArray=[
            [float("-inf"), *points, float("inf")] for points in (map(float, steps), [float((d - EPOCH).days) for d in days])]).transform(rows)
        passed = F.get(F.array(*[F.lit(sum(t < step for t in times)) for step in steps], F.lit(len(times))), F.col("_passed").cast("int"))
        plain = F.col(ts).isNotNull() & F.col(date).isNotNull() & ~F.col("_time").isin([float(t) for t in steps])
        outside = F.when(plain, F.greatest(passed, F.col("_begun").cast("int"))).otherwise(outside)
    rows = rows.join(F.broadcast(folds)).withColumn(output, F.when(outside < len(cuts), outside)).drop("_folds", "_time", "_day", "_passed", "_begun")
    return rows, [str(r["test_date"]) for r in cuts]


def fold_statistics(
    flows: DataFrame, ts: str, row_id: str, target: str, benign: str = "Benign", date: str = "capture_date",
    fit_share: float = 0.8,
) -> DataFrame:
    """Per fold: fit and calibration rows, the fit window's time range, benign and malicious test rows.

    All from day counts and the fold's cut-off: floor(share x n) is the fit size by definition.
    """
    per_day = flows.groupBy(date).agg(
        F.count_if(F.col(target) == benign).alias("_benign"), F.count_if(F.col(target) != benign).alias("_other")
    )
    normal = flows.where(F.col(target) == benign)
    folds = fold_dates(flows, date)
    past = F.broadcast(per_day).join(F.broadcast(folds), F.col(date) < F.col("test_date")).groupBy("test_date").agg(
        F.sum("_benign").alias("prior_benign")
    )
    cut = fold_cutoffs(normal, folds, ts, row_id, date, fit_share).select("test_date", F.timestamp_micros("_cut._time").alias("fit_until"))
    today = per_day.select(F.col(date).alias("test_date"), "_benign", "_other")
    fit = F.floor(F.round(F.col("prior_benign") * F.lit(fit_share), 6)).cast("bigint")
    return (
        past.join(F.broadcast(today), "test_date").join(F.broadcast(cut), "test_date", "left")
        .select(
            "test_date", fit.alias("fit_records"), (F.col("prior_benign") - fit).alias("calibration_records"),
            "fit_until", F.col("_benign").alias("benign_test_records"), F.col("_other").alias("malicious_test_records"),
        )
    )


def stratum_sample(frame: DataFrame, strata: Sequence[str], row_id: str, size: int, seed: int = 42, lanes: int = 64) -> DataFrame:
    """At most ``size`` rows per stratum: those with the smallest seeded hash.

    Exact in two steps, so that a stratum with a third of all rows never meets in one task: the best ``size``
    of each of ``lanes`` hash lanes first (limited before the shuffle as well), then the best of those.
    """
    ranked = frame.withColumn("_hash", seeded_hash(row_id, seed)).withColumn(
        "_lane", F.pmod(F.xxhash64("_hash"), F.lit(lanes))
    )
    order = [F.col("_hash"), F.col(row_id)]
    lane = Window.partitionBy(*strata, "_lane").orderBy(*order)
    best = ranked.withColumn("_rank", F.row_number().over(lane)).where(F.col("_rank") <= size)
    whole = Window.partitionBy(*strata).orderBy(*order)
    return (
        best.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= size)
        .drop("_hash", "_lane", "_rank")
    )


def representative_sample(
    flows: DataFrame, date: str, label: str, detail: str, row_id: str, size: int = 200, seed: int = 42
) -> DataFrame:
    """``size`` rows per date and label; malicious rows per date and detailed label, so rare attacks stay in."""
    stratum = F.when(F.col(label) == "malicious", F.coalesce(F.col(detail), F.lit("")))
    keyed = flows.withColumn("_stratum", F.coalesce(stratum, F.lit("")))
    return stratum_sample(keyed, [date, label, "_stratum"], row_id, size, seed).drop("_stratum")


def benign_only(frame: DataFrame, target: str, benign: int | str = 0) -> DataFrame:
    return frame.where(F.col(target) == benign)


def fit_frame_counts(frame: DataFrame, target: str, benign: int | str = 0, malicious: int | str = 1) -> DataFrame:
    """How many rows a benign-only fit keeps and how many malicious rows it leaves out."""
    return frame.agg(
        F.count("*").alias("train_records"),
        F.count_if(F.col(target) == benign).alias("benign_records"),
        F.count_if(F.col(target) == malicious).alias("malicious_excluded"),
    )
