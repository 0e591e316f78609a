"""Running totals, dense indexes and rank cut-offs without a global window.

A window without a partition key moves every row to one task. Here rows are first cut into value ranges; the
range totals (few rows) give each range its offset, and the exact work happens inside the ranges in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.sources.tables import stored

BUCKET = "_bucket"


def range_count(spark: SparkSession) -> int:
    """Number of value ranges: follows the cluster's own shuffle width."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_points(frame: DataFrame, columns: Sequence[str], parts: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles per column, in one pass with partial aggregation.

    Only ``columns x parts`` numbers reach the driver. They merely balance the ranges, so a two percent look at
    the rows is enough; every result stays exact over all rows, whatever the cuts. They are fixed numbers
    afterwards, so a recomputed task always cuts the rows the same way.
    """
    parts = parts or range_count(frame.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    row = frame.select(*columns).sample(0.02, seed=7).agg(*[
        F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, 5 * parts).alias(f"q{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(columns)}


def add_ranges(frame: DataFrame, points: Mapping[str, Sequence[float]], outputs: Sequence[str]) -> DataFrame:
    """Value-range number per column (JVM binary search); NULLs go to range 0, NaN to a last range of its own, as it sorts."""
    columns = list(points)
    doubles = [f"_as_double_{i}" for i in range(len(columns))]
    infinity = float("inf")
    wide = frame.withColumns({
        d: F.coalesce(F.col(c).cast("double"), F.lit(-infinity)) for d, c in zip(doubles, columns)
    })
    cutter = Bucketizer(
        inputCols=doubles, outputCols=list(outputs), handleInvalid="keep",
        splitsArray=[[-infinity, *points[c], infinity] if points[c] else [-infinity, 0.0, infinity] for c in columns],
    )
    cut = cutter.transform(wide)
    return cut.withColumns({o: F.col(o).cast("int") for o in outputs}).drop(*doubles)


def running_totals(
    frame: DataFrame, order: Sequence[Column], sums: Mapping[str, str], groups: Sequence[str] = (), bucket: str = BUCKET
) -> DataFrame:
    """Adds, per ``sums`` item ``{new: column}``, the total of the column up to and including the row.

    ``bucket`` must rise with ``order``. Order values should be distinct within a group (aggregate first).
    """
    keys = [*groups, bucket]
    per_range = frame.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # offsets: at most (groups x ranges) rows, so the broadcast is bounded
    # (left: an inner join would add a filter to this branch only, and the shuffle below would run twice)
    joined = frame.join(F.broadcast(offsets), keys, "left")
    totals = joined.withColumns({n: F.sum(c).over(inside) + F.col(f"_o_{n}") for n, c in sums.items()})
    return totals.drop(*[f"_o_{n}" for n in sums])


def dense_index(frame: DataFrame, unique_number: str, output: str) -> DataFrame:
    """0..n-1 by a unique numeric column."""
    points = split_points(frame, [unique_number])
    cut = add_ranges(frame, points, [BUCKET]).withColumn("_one", F.lit(1).cast("bigint"))
    counted = running_totals(cut, [F.col(unique_number)], {output: "_one"})
    return counted.withColumn(output, F.col(output) - 1).drop("_one", BUCKET)


def value_counts(
    frame: DataFrame, columns: Sequence[str], counts: Mapping[str, Column] | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """The value-frequency table of numeric columns: one row per group, feature and value (NULL is a value).

    ``counts`` names row weights (for example 1 for all, 1/0 per class); each is summed per value, as 0 for NULL.
    Distinct, dominant share and exact quantiles all come from this one shuffle.
    """
    counts = counts or {"all": F.lit(1)}
    points = split_points(frame, columns)
    slim = frame.select(*groups, *columns, *[c.cast("bigint").alias(f"_c_{n}") for n, c in counts.items()])
    ranges = [f"_range_{i}" for i in range(len(columns))]
    cut = add_ranges(slim, points, ranges)
    pairs = F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.col(r).alias(BUCKET))
        for c, r in zip(columns, ranges)
    ]))
    long = cut.select(*groups, *[f"_c_{n}" for n in counts], pairs)
    return long.groupBy(*groups, "feature", BUCKET, "value").agg(
        *[F.sum(F.when(F.col("value").isNotNull(), F.col(f"_c_{n}")).otherwise(0)).alias(f"_c_{n}") for n in counts],
    )


def quantiles_of(counted: DataFrame, names: Sequence[str], shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles (linear interpolation) from a value-frequency table, one row per group and feature.

    Ranks come from running totals over value ranges, so no task ever holds all values of a column. Gives
    ``<name>_n`` and ``<name>_q<i>`` per weight and share, and for the first weight ``distinct_values`` and
    ``largest_count``. Groups must be few (classes, days, folds). Every branch reads the same columns of
    ``counted``, so its shuffle runs once.
    """
    keys = [*groups, "feature"]
    through = running_totals(counted, [F.col("value")], {f"_u_{n}": f"_c_{n}" for n in names}, keys)
    first = F.col(f"_c_{names[0]}")
    sizes = counted.groupBy(*keys).agg(
        *[F.sum(f"_c_{n}").alias(f"{n}_n") for n in names],
        F.count(F.when(first > 0, F.col("value"))).alias("distinct_values"), F.max(first).alias("largest_count"),
    )
    ranked = through.join(F.broadcast(sizes), keys, "left")

    # text expressions: one call each to the JVM, where nested column objects would need dozens
    def value_at(name: str, rank: str, output: str) -> Column:
        through, own = f"`_u_{name}`", f"`_c_{name}`"
        return F.expr(f"max(CASE WHEN {through} > {rank} AND {through} - {own} <= {rank} THEN value END) AS `{output}`")

    picks, finals = [], []
    for name in names:
        for i, share in enumerate(shares):
            position = f"({float(share)!r}D * (`{name}_n` - 1))"
            low, high = f"_low_{name}_{i}", f"_high_{name}_{i}"
            picks += [value_at(name, f"floor({position})", low), value_at(name, f"ceil({position})", high)]
            finals.append(F.expr(f"`{low}` + (`{high}` - `{low}`) * ({position} - floor({position})) AS `{name}_q{i}`"))
    sized = [*[f"{n}_n" for n in names], "distinct_values", "largest_count"]
    return ranked.groupBy(*keys, *sized).agg(*picks).select(*keys, *sized, *finals)


SKETCH = 10_000  # ranks of the first pass are off by a share of 1 / SKETCH at most


def quantiles(
    frame: DataFrame, columns: Sequence[str], shares: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles (linear interpolation) of many columns in two passes, without a shuffle of single values.

    Mergeable sketches of the first pass give every wanted rank a bracket of values. The second counts values inside brackets one by
    one (about 4 / SKETCH of the rows per share) and all others per gap between brackets, with partial sums, and the exact ranks
    are found in those counts. A rank that fell into a gap would be seen; the columns are then counted value by value.
    Gives ``all_n`` and ``all_q<i>`` per group and feature; NULLs don't count, NaN is the largest value.
    """
    spare = 2.0 / SKETCH
    ends = [min(1.0, max(0.0, share + side)) for share in shares for side in (-spare, spare)]
    values = frame.select(*groups, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    numbers = [F.when(~F.isnan(f"_v{i}"), F.col(f"_v{i}")) for i in range(len(columns))]
    some = values.groupBy(*groups).agg(
        *[F.percentile_approx(v, ends, SKETCH).alias(f"_e{i}") for i, v in enumerate(numbers)],
        *[F.max(F.isnan(f"_v{i}")).alias(f"_nan{i}") for i in range(len(columns))])
    # brackets per group and column; with NaN among the values the last one has no upper end
    brackets = [F.array(*[F.struct(
        F.get(f"_e{i}", F.lit(2 * k)).alias("low"), F.when(F.col(f"_nan{i}"), F.lit(float("nan"))).otherwise(F.get(f"_e{i}", F.lit(2 * k + 1))).alias("high")
    ) for k in range(len(shares))]).alias(f"_b{i}") for i in range(len(columns))]
    table = stored(some.select(*groups, *brackets), "brackets")  # one row per group
    met = [values[g].eqNullSafe(table[g]) for g in groups]
    near = values.join(F.broadcast(table), reduce(lambda a, b: a & b, met)) if groups else values.join(F.broadcast(table))
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_v{i}").alias("value"), F.col(f"_b{i}").alias("_b")) for i, c in enumerate(columns)]))
    long = near.select(*[values[g] for g in groups], pairs).where(F.col("value").isNotNull())
    inside = F.coalesce(F.exists("_b", lambda x: (F.col("value") >= x["low"]) & (F.col("value") <= x["high"])), F.lit(True))
    before = F.array_max(F.transform(F.filter("_b", lambda x: x["high"] < F.col("value")), lambda x: x["high"]))
    keys = [*groups, "feature"]
    counted = long.select(*keys, F.when(inside, F.col("value")).otherwise(F.coalesce(before, F.lit(float("-inf")))).alias("value"), (~inside).alias("_gap"))
    counted = counted.groupBy(*keys, "value", "_gap").agg(F.count(F.lit(1)).alias("_c"))
    through = Window.partitionBy(*keys).orderBy("value", "_gap").rowsBetween(Window.unboundedPreceding, 0)
    ran = counted.withColumns({"_through": F.sum("_c").over(through), "all_n": F.sum("_c").over(Window.partitionBy(*keys))})
    picks, finals, gaps = [], [], []
    for i, share in enumerate(shares):
        position = f"({float(share)!r}D * (all_n - 1))"
        for name, rank in (("low", f"floor({position})"), ("high", f"ceil({position})")):
            here = f"_through > {rank} AND _through - _c <= {rank}"
            picks += [F.expr(f"max(CASE WHEN {here} THEN value END) AS _{name}_{i}"), F.expr(f"coalesce(bool_or(_gap AND {here}), false) AS _gap_{name}_{i}")]
            gaps.append(F.col(f"_gap_{name}_{i}"))
        finals.append(F.expr(f"CASE WHEN _low_{i} = _high_{i} THEN _low_{i} ELSE _low_{i} + (_high_{i} - _low_{i}) * ({position} - floor({position})) END AS all_q{i}"))
    found = stored(ran.groupBy(*keys, "all_n").agg(*picks).select(*keys, "all_n", *finals, reduce(lambda a, b: a | b, gaps).alias("_gap")), "quantiles")
    known = frame.select(*groups).distinct() if groups else frame.sparkSession.range(1).select()
    known = known.join(F.broadcast(frame.sparkSession.createDataFrame([(c,) for c in columns], "feature string")))  # a few columns
    if found.where("_gap").isEmpty():
        same = reduce(lambda a, b: a & b, [known[k].eqNullSafe(found[k]) for k in keys])
        return known.join(F.broadcast(found), same, "left").select(*[known[k] for k in keys], F.coalesce("all_n", F.lit(0)).alias("all_n"), *[f"all_q{i}" for i in range(len(shares))])
    return quantiles_of(value_counts(frame, columns, groups=groups), ["all"], shares, groups).select(*keys, "all_n", *[f"all_q{i}" for i in range(len(shares))])


def prefix_quantiles(frame: DataFrame, columns: Sequence[str], share: float, segment: str, folds: Sequence[int]) -> DataFrame:
    """(feature, fold, value): the exact quantile of each column over the rows whose ``segment`` is at most ``fold``, for every fold.

    Values are counted once, per segment. Counts of value ranges are summed up along the folds (ranges x folds rows), which tells the
    ranges that hold a fold's wanted ranks; only the values of those are joined with their folds.
    """
    counted = stored(value_counts(frame, columns, groups=[segment]).where(F.col("value").isNotNull()), "segment-values")
    steps = frame.sparkSession.createDataFrame([(f,) for f in folds], "fold int")  # one row per fold
    ranges = counted.groupBy("feature", BUCKET, segment).agg(F.sum("_c_all").alias("_n"))
    grid = ranges.select("feature", BUCKET).distinct().join(F.broadcast(steps))
    # a segment counts from the first fold at or after it
    first = ranges.join(F.broadcast(steps), F.col("fold") >= F.col(segment)).groupBy("feature", BUCKET, segment, "_n").agg(F.min("fold").alias("fold"))
    first = first.groupBy("feature", BUCKET, "fold").agg(F.sum("_n").alias("_n"))
    along = Window.partitionBy("feature", BUCKET).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    totals = grid.join(first, ["feature", BUCKET, "fold"], "left").withColumn("_n", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    keys = ["feature", "fold"]
    upto = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    ranked = totals.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*keys))}).where(F.col("_all") > 0)
    position = F.lit(float(share)) * (F.col("_all") - 1)
    ranked = ranked.withColumns({"_at": position, "_before": F.col("_upto") - F.col("_n")})
    held = (F.col("_n") > 0) & (F.col("_before") <= F.ceil("_at")) & (F.col("_upto") > F.floor("_at"))
    wanted = ranked.where(held).select(*keys, BUCKET, "_at", "_before")
    near = counted.join(wanted, ["feature", BUCKET]).where(F.col(segment) <= F.col("fold"))
    merged = near.groupBy(*keys, BUCKET, "_at", "_before", "value").agg(F.sum("_c_all").alias("_c"))
    inside = Window.partitionBy(*keys, BUCKET).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    through = merged.withColumn("_through", F.col("_before") + F.sum("_c").over(inside))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_through") > rank) & (F.col("_through") - F.col("_c") <= rank), F.col("value")))

    ends = through.groupBy(*keys, "_at").agg(at(F.floor("_at")).alias("_low"), at(F.ceil("_at")).alias("_high"))
    return ends.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias("value"))


def rank_cutoffs(
    rows: DataFrame,
    levels: Mapping[str, Column],
    quota: DataFrame,
    strata: Sequence[str],
    spread: Callable[[DataFrame], DataFrame] | None = None,
    spread_keys: Sequence[str] = (),
) -> DataFrame:
    """Per stratum, the level values of the row with rank ``quota.take`` (1-based) in lexicographic level order.

    Selection instead of sorting: each level is counted (map-side combine), the one value that contains the
    wanted rank is kept, and the next, finer level looks only at the rows of that value. No row is moved; only
    counts are shuffled. ``quota`` holds one row per stratum, so every broadcast here is that small.
    ``spread`` may join counts or rows to overlapping strata (for example every later fold); the columns it
    needs are ``spread_keys`` and are kept in the first count.
    """
    narrowed, found = rows.withColumns(dict(levels)), _as_local(quota.withColumn("_left", F.col("take")))
    names = list(levels)
    for depth, level in enumerate(names):
        fixed = names[:depth]
        if depth == 0 and spread is not None:
            counts = spread(narrowed.groupBy(*spread_keys, level).agg(F.count("*").alias("_n")))
            counts = counts.groupBy(*strata, level).agg(F.sum("_n").alias("_n"))
        else:
            source = narrowed
            if spread is not None:  # keep only the rows any stratum still asks for, then spread those few
                source = spread(source.join(F.broadcast(found.select(*fixed)), fixed, "left_semi"))
            if depth:
                source = source.join(F.broadcast(found.select(*strata, *fixed)), [*strata, *fixed], "left_semi")
            counts = source.groupBy(*strata, level).agg(F.count("*").alias("_n"))
        upto = Window.partitionBy(*strata).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("_upto", F.sum("_n").over(upto))
        hit = ranked.join(F.broadcast(found), list(strata)).where(
            (F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left"))
        )
        found = _as_local(hit.select(
            *strata, "take", *fixed, level, (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left")
        ))
    return found.select(*strata, *names)


def _as_local(small: DataFrame) -> DataFrame:
    """Run now and keep the answer (one row per stratum): the next level then plans against a literal table."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)
