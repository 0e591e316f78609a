"""Mixing sources to target weights by Pareto order sampling.

Every document gets certain whole copies first; what is then missing from a source's target is drawn by Pareto order sampling:
documents are ranked by random odds divided by inclusion odds, and the first ranks are taken until their words come closest to the
missing words. The random number is a hash of the id, so reruns agree and it does not matter how rows are partitioned.

Edge cases: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 take 0 words; rows with
equal ids share their random number and are then ordered by size; an empty table gives an empty table; other columns pass through,
and a column of the input with the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, table

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0
LEVEL = 1 << 12  # ranges per level; two levels leave a 2**-24 part of a source for the exact ranks
SPACES = "[\\x20\\x09-\\x0D]"


def n_words(text: Column) -> Column:
    inner = F.size(F.split(text, f"{SPACES}+"))
    ends = text.rlike(f"^{SPACES}").cast("int") + text.rlike(f"{SPACES}\\z").cast("int")
    return F.when(text.isNull() | (F.length(text) == 0), F.lit(0)).otherwise(inner - ends).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source: its words and its target. Shares go by weight; what lies above ``limit`` times a source is reshared by weight.

    Sources are counted first, so the windows below hold one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    every = W.partitionBy(F.lit(0))
    full = every.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.col("total") - F.coalesce(F.sum("limit").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        full.rowsBetween(0, W.unboundedFollowing))
    ranked = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * limit).withColumn("total", F.sum("source_size").over(every) * share)
    # Sources sorted by when they fill up: as long as the level reaches a source's limit it is full; the first that stays below sets the level.
    ranked = ranked.withColumn("level", level).withColumn("below", F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("level")))
    ranked = ranked.withColumn("level", F.max("below").over(every))
    return ranked.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, importance: str | None = None) -> DataFrame:
    """Input columns plus size, source_size, target, copies, taken. ``importance`` names a positive column that raises a document's
    inclusion odds within its source; without it all documents of a source have the same. Rows are read twice and never shuffled, but for
    the few at the cut."""
    given = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    weight = F.coalesce(F.col(importance).cast("double"), F.lit(0.0)) if importance else F.lit(1.0)
    draw = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    ready = docs.select(*given, n_words(F.col("text")).alias("size"), draw.alias("_u"), weight.alias("_w"))
    sized = keep(ready.select("source", "size", "_u", "_w"), "mix")
    targets = source_targets(sized, weights, share, limit)
    means = sized.groupBy("source").agg((F.sum(F.col("_w") * F.col("size")) / F.greatest(F.sum("size"), F.lit(1))).alias("_mean"))
    targets = keep(targets.alias("t").join(means.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source"))).select(
        "t.*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("double").alias("_whole"), "_mean"), "mix-targets")
    joined = _odds(sized, targets)
    coarse = _crossing(joined.where("_rest > 0"), F.floor(F.col("_v") / LEVEL), [], "1")
    fine = _crossing(_with(joined, coarse).where(F.floor(F.col("_v") / LEVEL) == F.col("_bin1")), F.col("_v") % LEVEL, ["_base1"], "2")
    cuts = keep(targets.select("source").alias("t").join(coarse.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").join(
        fine.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left").select("t.source", "_bin1", "_bin2", F.coalesce("_base2", "_base1").alias("_base")), "mix-cuts")
    ready = _with(_odds(ready, targets), cuts)
    cut = F.col("_bin1") * LEVEL + F.coalesce(F.col("_bin2"), F.lit(0))
    inside = F.col("_v") == cut
    ranks = W.partitionBy("source").orderBy("_q", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = ready.where(inside).withColumn("_before", F.col("_base") + F.coalesce(F.sum("size").over(ranks), F.lit(0)))
    edge = edge.withColumn("_more", (2 * F.col("_before") + F.col("size") <= 2 * F.col("_rest")).cast("int"))
    plain = ready.where(~F.coalesce(inside, F.lit(False))).withColumn("_more", F.when((F.col("_rest") > 0) & (cut.isNull() | (F.col("_v") < cut)), 1).otherwise(0))
    columns = [*given, "size", "source_size", "target", (F.col("_whole") + F.col("_more")).cast("int").alias("copies")]
    out = plain.select(*columns).unionByName(edge.select(*columns))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def _odds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds the source's figures, the odds ratio _q that ranks, and its range _v (0 .. LEVEL**2 - 1)."""
    joined = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", *[f"t.{c}" for c in targets.columns if c != "source"])
    joined = joined.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    odds = F.col("_rest") / F.greatest(F.col("source_size"), F.lit(1)) * F.col("_w") / F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(1.0)
    joined = joined.withColumn("_p", F.least(F.greatest(odds, F.lit(1e-12)), F.lit(1 - 1e-9)))
    joined = joined.withColumn("_q", (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p"))))
    return joined.withColumn("_v", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * float(LEVEL * LEVEL)).cast("long"), F.lit(LEVEL * LEVEL - 1)))


def _with(frame: DataFrame, cuts: DataFrame) -> DataFrame:
    return frame.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")), "left").select("d.*", *[f"c.{x}" for x in cuts.columns if x != "source"])


def _crossing(frame: DataFrame, bins: Column, base: list[str], level: str) -> DataFrame:
    """Per source the first range in which the words taken so far pass what is missing, and the words before it.

    Range sums are made on the map side; the window holds at most LEVEL rows per source.
    """
    start = F.max(base[0]) if base else F.lit(0)
    sums = frame.withColumn("_b", bins.cast("long")).groupBy("source", "_b").agg(F.sum("size").alias("_s"), F.max("_rest").alias("_r"), start.alias("_start"))
    upto = W.partitionBy("source").orderBy("_b")
    sums = sums.withColumn("_upto", F.col("_start") + F.sum("_s").over(upto))
    passed = sums.where(F.col("_upto") > F.col("_r")).groupBy("source").agg(F.min(F.struct(F.col("_b"), (F.col("_upto") - F.col("_s")).alias("_before"))).alias("x"))
    return passed.select("source", F.col("x._b").alias(f"_bin{level}"), F.col("x._before").alias(f"_base{level}"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5e0) / 281474976710656e0 AS u FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ([3e0, 1e0, 2e0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2e0 AS most,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 AS total FROM sources),
levels AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
chosen AS (SELECT max(CASE WHEN level * weight < most THEN level END) AS level FROM levels),
targets AS (SELECT source, source_size, CASE WHEN c.level IS NULL THEN most ELSE least(most, c.level * weight) END AS target FROM levels, chosen c),
parts AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
rests AS (SELECT *, target - whole * source_size AS rest,
    least(greatest((target - whole * source_size) / greatest(source_size, 1), 1e-12), 1e0 - 1e-9) AS p FROM parts),
odds AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM rests),
ranked AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM odds)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM ranked
"""
