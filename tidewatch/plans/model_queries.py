"""Preprocessing and model queries. Fitted models have no SQL form; their SQL-checkable consequences are separate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, evaluation, prep, rolling, splits, tree
from tidewatch.operators.forest import ForestModel, fit_forest, fit_forest_prefixes
from tidewatch.operators.oneclass import OneClassModel, fit_one_class, fit_one_class_prefixes
from tidewatch.plans import model_sql
from tidewatch.plans.bindings import FLOW, TEST_DATES, TRAIN_DATES
from tidewatch.plans.catalog import query
from tidewatch.plans.cleaning_queries import BINARY, clean_flows
from tidewatch.plans.metric_queries import RATES_LIST, conf, rounded
from tidewatch.plans.split_queries import in_dates
from tidewatch.roles import Roles

TRAIN = f"m AS (SELECT *, CASE WHEN service NOT IN ('-', '(empty)') THEN service END AS svc FROM flow_v WHERE {BINARY} AND {in_dates(TRAIN_DATES)})"
VARIANTS = {"all features": FLOW, "without history": FLOW.without("history")}


def flows(t) -> DataFrame:
    """Modelling rows with time and date (the target is 0/1), stored once: every fitting and scoring pass reads them from there.

    Both sides of the join on the row id come from the same rows, so one scan and one shuffle do; only rows that share an id are joined.
    """
    beside = ["ts", "capture_date", "detailedlabel"]
    wide = cleaning.modelling_table(clean_flows(t), FLOW, beside=beside).where("flow_row_id is not null")
    rows = rolling.keep(wide.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("flow_row_id"))), "model-input")
    several = rows.where("_same > 1").drop("_same")
    if several.isEmpty():
        return rows.drop("_same")
    joined = several.drop(*beside).join(several.select("flow_row_id", *beside), "flow_row_id")
    return rows.where("_same = 1").drop("_same").unionByName(joined)


def parts(t) -> tuple[DataFrame, DataFrame]:
    rows = flows(t)
    return splits.dates_in(rows, "capture_date", TRAIN_DATES), splits.dates_in(rows, "capture_date", TEST_DATES)


def raw_train(t) -> DataFrame:
    return splits.dates_in(cleaning.binary_rows(clean_flows(t), "label"), "capture_date", TRAIN_DATES)


def forest(rows, roles, group) -> ForestModel:
    return fit_forest(rows, roles, group=group)


def one_class(rows, roles, group) -> OneClassModel:
    return fit_one_class(rows, roles, group=group)


@query("ml1_medians", f"WITH {TRAIN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median FROM m" for c in FLOW.numeric))
def _(t):
    return rounded(prep.medians(raw_train(t), FLOW.numeric))


@query("ml1_imputed_rows", f"""WITH {TRAIN} SELECT flow_row_id, round(coalesce(duration, (SELECT quantile_cont(duration, 0.5) FROM m)), 6) AS duration FROM flow_v""")
def _(t):
    fitted = prep.fit_imputation(raw_train(t), FLOW)
    return rounded(prep.Imputation({"duration": fitted.numeric["duration"]}, {}).apply(t.flow_v).select("flow_row_id", "duration"))


@query("ml2_most_frequent", f"WITH {TRAIN} " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS feature, {v} AS most_frequent, count(*) AS records FROM m WHERE {v} IS NOT NULL GROUP BY {v} ORDER BY records DESC, {v} LIMIT 1) x"
    for c, v in zip(FLOW.categorical, ("proto", "svc", "conn_state", "history"))))
def _(t):
    return prep.most_frequent(raw_train(t), FLOW.categorical)


@query("ml3_onehot_width", f"""WITH {TRAIN} SELECT CAST(4 + count(DISTINCT proto) + count(DISTINCT coalesce(svc, 'missing')) + count(DISTINCT conn_state)
  + count(DISTINCT history) AS INTEGER) AS width, (SELECT count(*) FROM flow_v WHERE {BINARY}) AS records FROM m""")
def _(t):
    train, _ = parts(t)
    ready = prep.fit_imputation(train, FLOW).apply(train)
    encoded = prep.encode(flows(t), FLOW, prep.fit_dictionary(ready, FLOW.categorical))
    return encoded.agg(F.max("features.size").cast("int").alias("width"), F.count("*").alias("records"))


CATEGORIES = (("proto", "proto"), ("service", "coalesce(svc, 'missing')"), ("conn_state", "conn_state"), ("history", "history"))


@query("ml4_assembled_vectors", f"""WITH {TRAIN}, med AS (SELECT quantile_cont(duration, 0.5) AS d_med, quantile_cont(orig_bytes, 0.5) AS o_med, quantile_cont(resp_bytes, 0.5) AS r_med FROM m),
f AS (SELECT * FROM m, med),
words AS (SELECT {', '.join(f"list_sort(list(DISTINCT {v})) AS {c}_words" for c, v in CATEGORIES)} FROM f)
SELECT flow_row_id, list_transform([coalesce(duration, d_med), coalesce(orig_bytes, o_med), coalesce(resp_bytes, r_med), missed_bytes]
  {' '.join(f"|| list_transform({c}_words, lambda w: CASE WHEN w = {v} THEN 1e0 ELSE 0e0 END)" for c, v in CATEGORIES)}, lambda x: round(x, 6)) AS features FROM f, words""")
def _(t):
    train, _ = parts(t)
    ready = prep.fit_imputation(train, FLOW).apply(train)
    vectors = prep.encode(ready, FLOW, prep.fit_dictionary(ready, FLOW.categorical)).withColumn("whole", prep.dense("features"))
    return vectors.select("flow_row_id", F.transform("whole", lambda x: F.round(x, 6)).alias("features"))


@query("ml4_sparse_places", f"""WITH {TRAIN}, words AS ({' UNION ALL '.join(f"SELECT DISTINCT {i} AS f, {v} AS word FROM m WHERE {v} IS NOT NULL" for i, (_, v) in enumerate(CATEGORIES))}),
places AS (SELECT f, word, 4 + row_number() OVER (ORDER BY f, word) - 1 AS place FROM words),
v AS (SELECT *, CASE WHEN service NOT IN ('-', '(empty)') THEN service END AS svc FROM flow_v WHERE {BINARY} AND {in_dates(TEST_DATES)})
SELECT flow_row_id, {', '.join(f"(SELECT place FROM places WHERE f = {i} AND word = {v}) AS {c}" for i, (c, v) in enumerate(CATEGORIES))} FROM v""")
def _(t):
    # rows of later days with the dictionary of the training days: an unseen category has no place
    train, test = parts(t)
    encoded = prep.encode(test, FLOW, prep.fit_dictionary(prep.fit_imputation(train, FLOW).apply(train), FLOW.categorical))
    lows = encoded.withColumn("places", F.filter("features.indices", lambda p: p >= len(FLOW.numeric)))
    sizes = prep.fit_dictionary(train, FLOW.categorical).groupBy("feature").agg(F.count("*").alias("n")).collect()  # one row per column
    ends, at = {}, len(FLOW.numeric)
    for c in FLOW.categorical:
        ends[c] = (at, at := at + {r["feature"]: r["n"] for r in sizes}[c])
    place = lambda c: F.get(F.filter("places", lambda p: (p >= ends[c][0]) & (p < ends[c][1])), F.lit(0))
    return lows.select("flow_row_id", *[place(c).alias(c) for c in FLOW.categorical])


@query("ml5_standardized", f"""WITH m AS (SELECT flow_row_id, orig_bytes, resp_bytes FROM flow_v WHERE {BINARY})
SELECT flow_row_id, round((orig_bytes - (SELECT avg(orig_bytes) FROM m)) / (SELECT stddev_pop(orig_bytes) FROM m), 6) AS orig_bytes,
  round((resp_bytes - (SELECT avg(resp_bytes) FROM m)) / (SELECT stddev_pop(resp_bytes) FROM m), 6) AS resp_bytes FROM m""")
def _(t):
    rows = cleaning.binary_rows(t.flow_v, "label").select("flow_row_id", "orig_bytes", "resp_bytes")
    return rounded(prep.standardize(rows, ["orig_bytes", "resp_bytes"]))


def fitted_tree(t) -> tuple[tree.TreeModel, DataFrame]:
    train, test = parts(t)
    return tree.fit_tree(train, FLOW), test


GROWN = f"WITH RECURSIVE {model_sql.decision_tree()}"


@query("ml6_tree_shape", f"""{GROWN}, {model_sql.importances()} SELECT CAST(max(length(node)) - 1 AS INTEGER) AS depth, count(*) AS nodes,
  (SELECT round(sum(importance), 6) FROM imp) AS importance_sum, (SELECT count(*) FROM imp) AS encoded_features FROM grown_ends""")
def _(t):
    model, _ = fitted_tree(t)
    importances = model.importances()
    return importances.agg(F.round(F.sum("importance"), 6).alias("importance_sum"), F.count("*").alias("encoded_features")).withColumns(
        {"depth": F.lit(model.shape()["depth"]), "nodes": F.lit(model.shape()["nodes"]).cast("bigint")})


@query("ml6_tree_nodes", f"""{GROWN} SELECT CAST(length(node) - 1 AS INTEGER) AS depth, CAST(e.n - e.p AS BIGINT) AS n0, CAST(e.p AS BIGINT) AS n1, coalesce(f, -1) AS feature,
  round(coalesce(cut, 0), 6) AS cut, cat AS category FROM grown_ends e LEFT JOIN grown_cuts USING (node)""")
def _(t):
    return rounded(fitted_tree(t)[0].nodes.select("depth", "n0", "n1", "feature", "cut", "category"))


@query("ml7_tree_predictions", f"{GROWN} SELECT flow_row_id, actual, predicted, round(score, 6) AS score FROM grown_scored")
def _(t):
    model, test = fitted_tree(t)
    return rounded(model.predict(test).select("flow_row_id", "actual", "predicted", "score"))


@query("ml7_test_rows", f"""{GROWN} SELECT count(*) AS records, count(*) FILTER (actual = 1) AS malicious, count(*) FILTER (predicted = 1) AS flagged,
  round(avg(score), 6) AS mean_score FROM grown_scored""")
def _(t):
    model, test = fitted_tree(t)
    return rounded(model.predict(test).agg(F.count("*").alias("records"), F.count_if(F.col("actual") == 1).alias("malicious"),
                                           F.count_if(F.col("predicted") == 1).alias("flagged"), F.avg("score").alias("mean_score")))


# A tree of depth 1 over columns with few values has an SQL form: every cut, its Gini gain, the best one, and what it says of the test rows.
# Its target is resp_bytes >= 40 with every fifth row turned round, because a tree drops cuts whose sides say the same.
STUMP = Roles(numeric=("resp_bytes", "missed_bytes"), categorical=("proto", "conn_state"), metadata=FLOW.metadata, excluded=FLOW.excluded)
TURNED = "CAST((resp_bytes >= 40) <> (flow_row_id % 5 = 0) AS INTEGER)"
BEST_CUT = f"""{TRAIN}, t AS (SELECT resp_bytes AS v, proto, conn_state, {TURNED} AS y FROM m),
whole AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM t),
steps AS (SELECT v, lead(v) OVER (ORDER BY v) AS w, CAST(sum(count(*)) OVER (ORDER BY v) AS DOUBLE) AS nl, CAST(sum(sum(y)) OVER (ORDER BY v) AS DOUBLE) AS pl FROM t GROUP BY v),
cuts AS (SELECT 'resp_bytes' AS feature, (v + w) / 2e0 AS cut, nl, pl FROM steps WHERE w IS NOT NULL
  UNION ALL SELECT 'proto_' || proto, 0.5e0, (SELECT n FROM whole) - count(*), (SELECT p FROM whole) - sum(y) FROM t GROUP BY proto
  UNION ALL SELECT 'conn_state_' || conn_state, 0.5e0, (SELECT n FROM whole) - count(*), (SELECT p FROM whole) - sum(y) FROM t GROUP BY conn_state),
gains AS (SELECT feature, cut, pl / nl AS low, (p - pl) / (n - nl) AS high,
  2 * (p / n) * (1 - p / n) - nl / n * 2 * (pl / nl) * (1 - pl / nl) - (n - nl) / n * 2 * ((p - pl) / (n - nl)) * (1 - (p - pl) / (n - nl)) AS gain FROM cuts, whole),
best AS (SELECT * FROM gains ORDER BY gain DESC LIMIT 1)"""


def stump(t) -> tuple[tree.TreeModel, DataFrame]:
    train, test = (rows.withColumn("label", F.expr(TURNED)) for rows in parts(t))
    return tree.fit_tree(train, STUMP, max_depth=1), test


@query("ml6_stump_shape", f"WITH {BEST_CUT} SELECT CAST(1 AS INTEGER) AS depth, CAST(3 AS INTEGER) AS nodes, feature, round(cut, 6) AS cut, round(low, 6) AS low, round(high, 6) AS high FROM best")
def _(t):
    model, test = stump(t)
    shape = model.shape()
    root = model.nodes.where("depth = 0").alias("n").join(model.encoded_names().alias("e"), F.expr("n.feature = e.feature and n.category <=> e.category")).withColumn("kind", F.col("n.category"))
    low, high = F.col("b1") / (F.col("b0") + F.col("b1")), (F.col("n1") - F.col("b1")) / (F.col("n0") + F.col("n1") - F.col("b0") - F.col("b1"))
    # a cut between categories lies between 0 and 1
    return rounded(root.select(F.lit(shape["depth"]).alias("depth"), F.lit(shape["nodes"]).cast("int").alias("nodes"), F.col("e.name").alias("feature"),
                               F.when(F.col("kind").isNull(), F.col("cut")).otherwise(0.5).alias("cut"), low.alias("low"), high.alias("high")))


@query("ml7_stump_scores", f"""WITH {BEST_CUT} SELECT flow_row_id, {TURNED} AS actual,
  round(CASE WHEN CASE WHEN feature = 'resp_bytes' THEN resp_bytes <= cut ELSE feature NOT IN ('proto_' || proto, 'conn_state_' || conn_state) END THEN low ELSE high END, 6) AS score
FROM flow_v, best WHERE {BINARY} AND {in_dates(TEST_DATES)}""")
def _(t):
    model, test = stump(t)
    return rounded(model.predict(test).select("flow_row_id", "actual", "score"))


@query("ml8_stump_importances", f"WITH {BEST_CUT} SELECT DISTINCT g.feature, CASE WHEN g.feature = b.feature THEN 1e0 ELSE 0e0 END AS importance FROM (SELECT feature FROM gains UNION SELECT 'missed_bytes') g, best b")
def _(t):
    return rounded(stump(t)[0].importances().select("feature", "importance"))


IMPORTANCES = f"{GROWN}, {model_sql.importances()}"


@query("ml8_importances", f"{IMPORTANCES} SELECT feature, origin, round(importance, 6) AS importance FROM imp ORDER BY imp.importance DESC, feature LIMIT 15")
def _(t):
    return rounded(tree.top_importances(fitted_tree(t)[0].importances()))


@query("ml8_importance_by_column", f"{IMPORTANCES} SELECT origin AS feature, round(sum(importance), 6) AS importance FROM imp GROUP BY origin")
def _(t):
    return rounded(tree.importance_by_column(fitted_tree(t)[0].importances()))


@query("ml8_importance_sum", f"{IMPORTANCES} SELECT round(sum(importance), 6) AS importance_sum, count(DISTINCT origin) AS columns, round(max(importance), 6) AS largest FROM imp")
def _(t):
    importances = fitted_tree(t)[0].importances()
    return importances.agg(F.round(F.sum("importance"), 6).alias("importance_sum"), F.countDistinct("origin").alias("columns"), F.round(F.max("importance"), 6).alias("largest"))


@query("ml9_ablation", f"WITH RECURSIVE {model_sql.decision_tree()}, {model_sql.decision_tree(VARIANTS['without history'], 'less')} " + " UNION ALL ".join(
    f"SELECT '{name}' AS variant, CAST({len(roles.features)} AS INTEGER) AS features, * FROM ({model_sql.rated(source)}) r"
    for (name, roles), source in zip(VARIANTS.items(), ("grown_scored", "less_scored"))))
def _(t):
    train, test = parts(t)
    return rounded(tree.ablation(train, test, VARIANTS))


def benign_parts(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    train, test = parts(t)
    split = splits.random_split(splits.benign_only(train, "label"), "flow_row_id", 0.2)
    return split.where("split = 'training'").drop("split"), split.where("split = 'testing'").drop("split"), test, train


def calibrated(t, fit) -> dict:
    fit_rows, calibration, test, _ = benign_parts(t)
    return rolling.calibrated_detector(fit_rows, calibration, test, FLOW, fit)


ISOLATED = f"WITH RECURSIVE {model_sql.DETECTOR_ROWS}, {model_sql.forest('fit_rows', 'to_score')}"
CALIBRATED = f"{ISOLATED}, {model_sql.calibrated()}"


@query("ml10_forest_nodes", f"""{ISOLATED} SELECT model, CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, round(cut, 6) AS cut, category, path,
  CAST(sample AS INTEGER) AS sample FROM iso_nodes""")
def _(t):
    return rounded(fit_forest(benign_parts(t)[0], FLOW).nodes)


@query("ml10_forest_size", f"""{ISOLATED} SELECT CAST(tree AS INTEGER) AS tree, CAST(max(sample) AS INTEGER) AS rows_per_tree, count(*) AS nodes, count(*) FILTER (feature < 0) AS leaves,
  CAST(sum(path) AS BIGINT) AS paths FROM iso_nodes GROUP BY tree""")
def _(t):
    nodes = fit_forest(benign_parts(t)[0], FLOW).nodes
    return nodes.groupBy("tree").agg(F.max("sample").alias("rows_per_tree"), F.count("*").alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves"), F.sum("path").alias("paths"))


@query("ml11_anomaly_scores", f"{CALIBRATED} SELECT flow_row_id, actual, round(score, 6) AS score, automatic FROM flagged")
def _(t):
    return rounded(calibrated(t, forest)["test"].select("flow_row_id", "actual", "score", "automatic"))


@query("ml12_forest_calibration", f"""{CALIBRATED} SELECT round(threshold, 6) AS threshold, calibration_records,
  (SELECT count(*) FROM iso_scored s WHERE part = 'calibrate' AND s.score >= threshold) AS flagged FROM limits""")
def _(t):
    found = calibrated(t, forest)
    counted = found["calibration"].agg(F.count("*").alias("calibration_records"), F.count_if(F.col("predicted") == 1).alias("flagged"))
    return counted.withColumn("threshold", F.round(F.lit(found["threshold"]), 6))


@query("ml12_detector_report", f"""{CALIBRATED}, {model_sql.ranked('flagged')}, r AS ({model_sql.rated('flagged')}),
wide AS (SELECT r.*, ranked.*, limits.calibration_records, true_negatives + false_positives AS test_benign, false_negatives + true_positives AS test_malicious, false_positives + true_positives AS predicted_anomalies,
  round((false_positives + true_positives) / CAST(true_negatives + false_positives + false_negatives + true_positives AS DOUBLE), 6) AS predicted_anomaly_rate,
  false_positives AS benign_flagged, true_positives AS malicious_detected, round(limits.threshold, 6) AS threshold, 0.99e0 AS quantile,
  (SELECT round(count(*) FILTER (x.score >= limits.threshold) / CAST(count(*) AS DOUBLE), 6) FROM iso_scored x WHERE part = 'calibrate') AS calibration_rate,
  (SELECT count(*) FROM fit_rows) AS fit_records, (SELECT count(*) FROM benign) AS benign_records,
  (SELECT count(*) FROM flow_v WHERE {model_sql.BINARY} AND {in_dates(TRAIN_DATES)}) AS train_records,
  (SELECT count(*) FROM flow_v WHERE label = 'Malicious' AND {in_dates(TRAIN_DATES)}) AS malicious_excluded FROM r, ranked, limits)
""" + " UNION ALL ".join(f"SELECT '{metric}' AS metric, CAST({column} AS DOUBLE) AS value FROM wide" for metric, column in rolling.REPORT.items()))
def _(t):
    fit_rows, _, _, train = benign_parts(t)
    return rounded(rolling.detector_report(calibrated(t, forest), fit_rows.count(), train, "label"))


@query("ml13_one_class_scores")
def _(t):
    return calibrated(t, one_class)["test"].select("flow_row_id", "actual", "score", "predicted")


ROLLED = f"WITH RECURSIVE {model_sql.rolling_rows()}, {model_sql.forest('fit_rows', 'to_score')}, {model_sql.calibrated()}"


@query("ml14_rolling_forest", f"""{ROLLED}, {model_sql.ranked('flagged', 'model')}, r AS ({model_sql.rated('flagged', 'model')})
SELECT r.* EXCLUDE (model), CAST(model AS VARCHAR) AS test_date, roc_auc, round(threshold, 6) AS threshold, calibration_records, (SELECT count(*) FROM fit_rows f WHERE f.model = r.model) AS fit_records,
  true_negatives + false_positives AS benign_test_records, false_negatives + true_positives AS malicious_test_records FROM r LEFT JOIN ranked USING (model) LEFT JOIN limits USING (model)""")
def _(t):
    return rounded(rolling.rolling_evaluation(flows(t), FLOW, "ts", forest, prefix_fit=fit_forest_prefixes)["daily"])


@query("ml14_rolling_sizes", f"""{ROLLED}, p AS ({conf("", "flagged")}) SELECT *, {RATES_LIST} FROM p""")
def _(t):
    return rounded(rolling.rolling_evaluation(flows(t), FLOW, "ts", forest, prefix_fit=fit_forest_prefixes)["overall"])


@query("ml14_rolling_one_class")
def _(t):
    return rounded(rolling.rolling_evaluation(flows(t), FLOW, "ts", one_class, prefix_fit=fit_one_class_prefixes)["daily"])


@query("ml15_frozen_daily", f"""{GROWN}, {model_sql.ranked('grown_scored', 'capture_date')}, r AS ({model_sql.rated('grown_scored', 'capture_date')})
SELECT r.*, roc_auc FROM r LEFT JOIN ranked USING (capture_date)""")
def _(t):
    model, test = fitted_tree(t)
    return rounded(rolling.frozen_model_daily(model, test)["daily"])


@query("ml15_frozen_overall", f"""{GROWN}, {model_sql.ranked('grown_scored')}, r AS ({model_sql.rated('grown_scored')})
SELECT 'all later days' AS model, r.*, roc_auc, average_precision FROM r, ranked""")
def _(t):
    model, test = fitted_tree(t)
    return rounded(rolling.frozen_model_daily(model, test)["overall"])


@query("ml16_tree_prediction_table", f"""{GROWN} SELECT flow_row_id, actual AS true_label, predicted AS predicted_label, round(score, 6) AS predicted_probability FROM grown_scored""")
def _(t):
    model, test = fitted_tree(t)
    return rounded(rolling.prediction_table(model.predict(test), FLOW, probability=True))


@query("ml16_forest_prediction_table", f"""{CALIBRATED} SELECT flow_row_id, capture_date, actual AS true_label, predicted AS predicted_label, round(score, 6) AS anomaly_score,
  round(threshold, 6) AS calibrated_threshold FROM flagged""")
def _(t):
    result = calibrated(t, forest)
    return rounded(rolling.prediction_table(result["test"], FLOW, result["threshold"]))


DETECTORS = (("Isolation Forest - 1% calibrated", forest), ("One-Class SVM - 1% calibrated", one_class))


def side_by_side(t, detectors) -> DataFrame:
    train, test = parts(t)
    benign = splits.time_split(splits.benign_only(train, "label"), "ts", "flow_row_id")
    fit_rows, calibration = benign.where("part = 'fit'").drop("part"), benign.where("part = 'calibrate'").drop("part")
    scored = [rolling.as_model(rolling.keep(tree.fit_tree(train, FLOW).predict(test), "tree"), "Decision Tree")]
    for name, fit in detectors:
        scored.append(rolling.as_model(rolling.calibrated_detector(fit_rows, calibration, test, FLOW, fit)["test"], name))
    return rounded(rolling.common_test_comparison(scored))


@query("ml17_two_models", f"""{GROWN}, {model_sql.TIMED_ROWS}, {model_sql.forest('fit_rows', 'to_score')}, {model_sql.calibrated()},
stacked AS (SELECT 'Decision Tree' AS model, actual, predicted, score FROM grown_scored
  UNION ALL SELECT '{DETECTORS[0][0]}', actual, predicted, score FROM flagged), {model_sql.ranked('stacked', 'model')}, r AS ({model_sql.rated('stacked', 'model')})
SELECT r.*, roc_auc, average_precision FROM r JOIN ranked USING (model)""")
def _(t):
    return side_by_side(t, DETECTORS[:1])


@query("ml17_three_models")
def _(t):
    return side_by_side(t, DETECTORS)


@query("ml17_family_performance", f"""{GROWN} SELECT capture_date, coalesce(detailedlabel, 'unspecified') AS attack_family, count(*) AS malicious_records,
  count(*) FILTER (predicted = 1) AS detected, count(*) FILTER (predicted = 0) AS missed, round(count(*) FILTER (predicted = 1) / CAST(count(*) AS DOUBLE), 6) AS recall
FROM grown_scored WHERE actual = 1 GROUP BY 1, 2""")
def _(t):
    model, test = fitted_tree(t)
    attacks = rolling.keep(model.predict(test), "tree").where("actual = 1")
    return rounded(evaluation.family_performance(attacks, "detailedlabel"))
