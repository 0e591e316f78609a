"""Feature-analysis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import features
from tidewatch.plans.bindings import FLOW
from tidewatch.plans.catalog import query
from tidewatch.plans.cleaning_queries import BINARY, clean_flows
from tidewatch.functions.cleaning import label_code
from tidewatch.roles import CLASS_CODES

NULLED = "(SELECT * REPLACE (CASE WHEN service NOT IN ('-', '(empty)') THEN service END AS service) FROM flow_v)"
ROWS = f"m AS (SELECT *, CASE label WHEN 'Benign' THEN 0 ELSE 1 END AS y FROM {NULLED} q WHERE {BINARY})"
PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def numeric_sql(columns, source: str = "m") -> str:
    parts = []
    for c in columns:
        stats = []
        for name, cond in (("overall", ""), ("benign", " FILTER (y = 0)"), ("malicious", " FILTER (y = 1)")):
            stats += [f"favg({c}){cond} AS {name}_mean", f"quantile_cont({c}, 0.5){cond} AS {name}_median", f"stddev_samp({c}){cond} AS {name}_std",
                      f"min({c}){cond} AS {name}_min", f"quantile_cont({c}, 0.25){cond} AS {name}_q25", f"quantile_cont({c}, 0.5){cond} AS {name}_q50",
                      f"quantile_cont({c}, 0.75){cond} AS {name}_q75", f"max({c}){cond} AS {name}_max"]
        parts.append(f"""SELECT '{c}' AS feature, 100e0 * (count(*) - count({c})) / count(*) AS missing_share, count(DISTINCT {c}) AS unique_non_null,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY {c}) g) / CAST(count(*) AS DOUBLE) AS share, {', '.join(stats)} FROM {source}""")
    return f"""raw AS ({' UNION ALL '.join(parts)}),
eff AS (SELECT *, coalesce(abs(malicious_mean - benign_mean) / nullif(sqrt((benign_std * benign_std + malicious_std * malicious_std) / 2), 0), 0) AS effect FROM raw),
num AS (SELECT feature, 'numerical' AS type, round(missing_share, 4) AS missing_percentage, unique_non_null, round(share, 6) AS dominant_value_ratio,
  {', '.join(f'CAST(round(CAST({k}_{s} AS DECIMAL(38, 10)), 6) AS DOUBLE) AS {k}_{s}' for k in ('overall', 'benign', 'malicious') for s in ('mean', 'median', 'std', 'min', 'q25', 'q50', 'q75', 'max'))},
  round(abs(malicious_mean - benign_mean), 6) AS mean_gap, round(effect, 6) AS standardized_mean_gap,
  concat_ws('; ', printf('effect_size=%.3f', effect), printf('dominant_value_ratio=%.3f', share),
    CASE WHEN unique_non_null <= 1 THEN 'constant feature' WHEN share >= 0.995 OR overall_std = 0 OR overall_std IS NULL THEN 'near-constant behaviour'
      WHEN missing_share >= 60 AND effect < 0.2 THEN 'high missingness with weak class separation'
      WHEN effect < 0.1 THEN 'low standalone separation, but retain for multivariate modelling' END) AS relevance_evidence,
  CASE WHEN unique_non_null <= 1 THEN 'DROP' WHEN share >= 0.995 OR overall_std = 0 OR overall_std IS NULL THEN 'REVIEW'
    WHEN missing_share >= 60 AND effect < 0.2 THEN 'REVIEW' ELSE 'KEEP' END AS recommendation FROM eff)"""


LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, y FROM m" for c in FLOW.categorical)
CAT = f"""freq AS (SELECT feature, coalesce(v, '<MISSING>') AS category, v IS NULL AS is_missing, count(*) AS n,
  count(*) FILTER (y = 0) AS b, count(*) FILTER (y = 1) AS mal FROM ({LONG}) l GROUP BY 1, 2, 3),
tot AS (SELECT feature, sum(n) AS all_n, sum(CASE WHEN is_missing THEN n ELSE 0 END) AS miss, count(*) FILTER (NOT is_missing) AS uniq,
  max(n) AS dom, CAST(sum(mal) AS DOUBLE) / sum(n) AS base FROM freq GROUP BY 1),
rk AS (SELECT freq.*, row_number() OVER (PARTITION BY feature ORDER BY n DESC, category) AS r FROM freq),
top AS (SELECT rk.*, CAST(mal AS DOUBLE) / n AS rate, base, all_n FROM rk JOIN tot USING (feature) WHERE r <= 10),
det AS (SELECT feature, category, n AS count, round(100e0 * n / all_n, 4) AS percentage, b AS benign_count, mal AS malicious_count,
  round(b * 100e0 / n, 4) AS benign_percentage_within_category, round(mal * 100e0 / n, 4) AS malicious_percentage_within_category FROM top),
best AS (SELECT feature, category, round(rate * 100e0, 4) AS pct, base FROM
  (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(rate - base) DESC, r) AS k FROM top) x WHERE k = 1),
lean AS (SELECT best.*, CASE WHEN pct / 100e0 >= base THEN 'Malicious' ELSE 'Benign' END AS leaning FROM best),
cat AS (SELECT tot.feature, 'categorical' AS type, round(100e0 * miss / all_n, 4) AS missing_percentage, uniq AS unique_categories,
  round(dom / CAST(all_n AS DOUBLE), 6) AS dominant_value_ratio,
  (SELECT string_agg(category, ', ' ORDER BY r) FROM top WHERE top.feature = tot.feature AND r <= 5) AS top_categories,
  concat_ws('; ', printf('unique_categories=%d', uniq), printf('dominant_value_ratio=%.3f', dom / CAST(all_n AS DOUBLE)),
    CASE WHEN uniq <= 1 THEN 'constant categorical feature' WHEN dom / CAST(all_n AS DOUBLE) >= 0.995 THEN 'near-constant categorical feature' END,
    printf('top association: %s -> %s (%.1f%% malicious)', lean.category, leaning, pct),
    CASE WHEN 100e0 * miss / all_n >= 60 THEN 'high missingness' END) AS relevance_evidence,
  CASE WHEN 100e0 * miss / all_n >= 60 THEN 'REVIEW' WHEN uniq <= 1 THEN 'DROP' WHEN dom / CAST(all_n AS DOUBLE) >= 0.995 THEN 'REVIEW' ELSE 'KEEP' END AS recommendation
  FROM tot JOIN lean USING (feature))"""
RECOMMENDED = """rec AS (SELECT feature, type, missing_percentage, relevance_evidence, recommendation FROM num
UNION ALL SELECT feature, type, missing_percentage, relevance_evidence, recommendation FROM cat)"""


def labelled(t) -> DataFrame:
    rows = clean_flows(t).where(F.col("label").isin(*CLASS_CODES))
    return rows.withColumn("label", label_code(F.col("label"), CLASS_CODES))


def numeric(t) -> DataFrame:
    return features.numeric_summary(labelled(t), FLOW.numeric, "label")


def counts(t) -> DataFrame:
    return features.category_counts(labelled(t), FLOW.categorical, "label")


def recommended(t) -> DataFrame:
    return features.recommendations(numeric(t), features.categorical_summary(counts(t)))


@query("fea1_numeric_summary", f"WITH {ROWS}, {numeric_sql(FLOW.numeric)} SELECT * FROM num")
def _(t):
    return numeric(t)


@query("fea1_price_summary", f"""WITH m AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
{numeric_sql(PRICES)} SELECT * FROM num""")
def _(t):
    flagged = t.lineitem.select(*PRICES, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return features.numeric_summary(flagged, PRICES, "y")


@query("fea2_standardized_gap", f"WITH {ROWS}, {numeric_sql(FLOW.numeric)} SELECT feature, mean_gap, standardized_mean_gap FROM num")
def _(t):
    return numeric(t).select("feature", "mean_gap", "standardized_mean_gap")


@query("fea3_dominant_ratio", f"""WITH {ROWS}, {numeric_sql(FLOW.numeric)}, {CAT}
SELECT feature, dominant_value_ratio FROM num UNION ALL SELECT feature, dominant_value_ratio FROM cat""")
def _(t):
    columns = ["feature", "dominant_value_ratio"]
    return numeric(t).select(*columns).unionByName(features.categorical_summary(counts(t)).select(*columns))


@query("fea4_numeric_verdicts", f"WITH {ROWS}, {numeric_sql(FLOW.numeric)} SELECT feature, relevance_evidence, recommendation FROM num")
def _(t):
    return numeric(t).select("feature", "relevance_evidence", "recommendation")


@query("fea5_top_categories", f"WITH {ROWS}, {CAT} SELECT * FROM det")
def _(t):
    return features.top_category_table(counts(t))


@query("fea6_strongest_category", f"""WITH {ROWS}, {CAT} SELECT feature, category AS strongest_category, pct AS strongest_percent, leaning FROM lean""")
def _(t):
    return features.strongest_association(counts(t)).select("feature", "strongest_category", "strongest_percent", "leaning")


@query("fea7_categorical_summary", f"WITH {ROWS}, {CAT} SELECT * FROM cat")
def _(t):
    return features.categorical_summary(counts(t))


@query("fea8_recommendations", f"WITH {ROWS}, {numeric_sql(FLOW.numeric)}, {CAT}, {RECOMMENDED} SELECT * FROM rec")
def _(t):
    return recommended(t)


@query("fea9_summary_with_detail", f"WITH {ROWS}, {CAT} SELECT * FROM cat LEFT JOIN det USING (feature)")
def _(t):
    return features.summary_with_detail(features.categorical_summary(counts(t)), features.top_category_table(counts(t)))


@query("fea10_approved_features", f"""WITH {ROWS}, {numeric_sql(FLOW.numeric)}, {CAT}, {RECOMMENDED}
SELECT feature, type, CAST(list_position([{', '.join(repr(f) for f in FLOW.features)}], feature) - 1 AS INTEGER) AS position
FROM rec WHERE recommendation <> 'DROP'""")
def _(t):
    return features.approved(recommended(t), FLOW)
