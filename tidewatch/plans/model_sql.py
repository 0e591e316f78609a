"""Oracle SQL that grows the detectors' trees by recursion; every text is a list of common table expressions."""

from __future__ import annotations

from tidewatch.plans.bindings import FLOW, TEST_DATES, TRAIN_DATES
from tidewatch.plans.cleaning_queries import BINARY
from tidewatch.plans.metric_queries import RATES_LIST, conf
from tidewatch.plans.split_queries import in_dates
from tidewatch.roles import Roles

WORDS = {"service": "coalesce(CASE WHEN service NOT IN ('-', '(empty)') THEN service END, 'missing')"}


def word(column: str) -> str:
    return WORDS.get(column, column)


def decision_tree(roles: Roles = FLOW, grown: str = "grown", max_depth: int | None = None) -> str:
    """``<grown>``: every training row in every node of its path; ``<grown>_cuts``, ``<grown>_ends``: cuts and class counts by node;
    ``<grown>_scored``: the test rows."""
    n, kinds = len(roles.numeric), len(roles.categorical)
    xs, cs = [f"x{i}" for i in range(n)], [f"c{i}" for i in range(kinds)]
    columns = ", ".join(xs + cs)
    values = ", ".join([f"coalesce({c}, {c}_m) AS {x}" for c, x in zip(roles.numeric, xs)] + [f"{word(c)} AS {x}" for c, x in zip(roles.categorical, cs)])
    side = " ".join([f"WHEN {i} THEN {x} > b.cut" for i, x in enumerate(xs)] + [f"WHEN {n + i} THEN {x} = b.cat" for i, x in enumerate(cs)])
    deep = "" if max_depth is None else f" AND length(node) <= {max_depth}"
    g = grown
    return f"""{g}_med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}_m' for c in roles.numeric)} FROM flow_v WHERE {BINARY} AND {in_dates(TRAIN_DATES)}),
{g} AS (SELECT CAST(label = 'Malicious' AS INTEGER) AS y, {values}, '1' AS node, CAST(NULL AS INTEGER) AS f, CAST(NULL AS DOUBLE) AS cut, CAST(NULL AS VARCHAR) AS cat
    FROM flow_v, {g}_med WHERE {BINARY} AND {in_dates(TRAIN_DATES)}
  UNION ALL (WITH g AS (SELECT * FROM {g}),
    t AS (SELECT node, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM g GROUP BY node HAVING sum(y) BETWEEN 1 AND count(*) - 1{deep}),
    v AS (SELECT node, y, unnest({list(range(n + kinds))}) AS f, unnest([{', '.join(xs + ['NULL'] * kinds)}]) AS num, unnest([{', '.join(['NULL'] * n + cs)}]) AS cat
      FROM g SEMI JOIN t USING (node)),
    k AS (SELECT node, f, num, cat, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM v GROUP BY ALL),
    r AS (SELECT node, f, num, lead(num) OVER w AS nxt, sum(n) OVER w AS ln, sum(p) OVER w AS lp FROM k WHERE f < {n} WINDOW w AS (PARTITION BY node, f ORDER BY num)),
    o AS (SELECT node, f, num + (nxt - num) / 2 AS cut, CAST(NULL AS VARCHAR) AS cat, ln, lp FROM r WHERE nxt IS NOT NULL
      UNION ALL SELECT node, f, 0e0, cat, t.n - k.n, t.p - k.p FROM k JOIN t USING (node) WHERE f >= {n} AND k.n < t.n),
    c AS (SELECT o.*, (ln - lp) * lp / ln + ((n - ln) - (p - lp)) * (p - lp) / (n - ln) AS cost FROM o JOIN t USING (node)),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY cost, f, cut, cat) = 1)
    SELECT y, {columns}, node || CASE WHEN CASE b.f {side} END THEN '1' ELSE '0' END, b.f, b.cut, b.cat FROM g JOIN b USING (node))),
{g}_cuts AS (SELECT DISTINCT left(node, length(node) - 1) AS node, f, cut, cat FROM {g} WHERE f IS NOT NULL),
{g}_ends AS (SELECT node, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM {g} GROUP BY node),
{g}_walk AS (SELECT flow_row_id, capture_date, detailedlabel, CAST(label = 'Malicious' AS INTEGER) AS actual, {values}, '1' AS node
    FROM flow_v, {g}_med WHERE {BINARY} AND {in_dates(TEST_DATES)}
  UNION ALL SELECT w.* REPLACE (w.node || CASE WHEN CASE b.f {side} END THEN '1' ELSE '0' END AS node) FROM {g}_walk w JOIN {g}_cuts b USING (node)),
{g}_scored AS (SELECT flow_row_id, capture_date, detailedlabel, actual, CAST(p / n > 0.5 AS INTEGER) AS predicted, p / n AS score
  FROM {g}_walk JOIN {g}_ends USING (node) WHERE node NOT IN (SELECT node FROM {g}_cuts))"""


def importances(roles: Roles = FLOW, grown: str = "grown") -> str:
    """``imp``: the importance of every encoded column, ``origin`` beside it."""
    n, g = len(roles.numeric), grown
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(roles.features))
    encoded = [f"SELECT '{c}' AS feature, '{c}' AS origin" for c in roles.numeric]
    encoded += [f"SELECT DISTINCT '{c}_' || c{i}, '{c}' FROM {g} WHERE node = '1'" for i, c in enumerate(roles.categorical)]
    half = "(e.n - e.p) * e.p / e.n"
    return f"""gained AS (SELECT CASE f {names} END || CASE WHEN f >= {n} THEN '_' || cat ELSE '' END AS feature,
  sum((SELECT {half} FROM {g}_ends e WHERE e.node = c.node) - (SELECT sum({half}) FROM {g}_ends e WHERE e.node IN (c.node || '0', c.node || '1'))) AS gain FROM {g}_cuts c GROUP BY 1),
imp AS (SELECT feature, origin, coalesce(gain / (SELECT sum(gain) FROM gained), 0) AS importance FROM ({' UNION ALL '.join(encoded)}) n LEFT JOIN gained USING (feature))"""


def ranked(source: str, group: str = "", name: str = "ranked") -> str:
    """``<name>``: ROC-AUC and average precision (of all rows, or by group)."""
    by, keys = (f"PARTITION BY {group} ", f"{group}, ") if group else ("", "")
    tail = f" GROUP BY {group}" if group else ""
    return f"""{name}_h AS (SELECT {keys}score, count(*) FILTER (actual = 1) AS pos, count(*) FILTER (actual = 0) AS neg FROM {source} GROUP BY ALL),
{name}_c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {name}_h WINDOW w AS ({by}ORDER BY score DESC)),
{name} AS (SELECT {keys}round(CAST(sum(neg * (tp - pos / 2e0)) AS DOUBLE) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc,
  round(CAST(sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) AS DOUBLE) / nullif(sum(pos), 0), 6) AS average_precision FROM {name}_c{tail})"""


def rated(source: str, group: str = "") -> str:
    """Counts and rates as a SELECT."""
    return f"SELECT *, {RATES_LIST} FROM ({conf(group, source)}) counted"


TREES, SAMPLE, SEED = 200, 256, 42
GAMMA = 0.5772156649015329


def chance(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496e0"


def mean_path(m: str) -> str:
    return f"CASE WHEN {m} <= 1 THEN 0e0 WHEN {m} = 2 THEN 1e0 ELSE 2e0 * (ln({m} - 1e0) + {GAMMA}) - 2e0 * ({m} - 1e0) / {m} END"


def forest(fit: str, score: str, roles: Roles = FLOW, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> str:
    """From ``fit`` (model, flow_row_id, features) and ``score`` (the same and more): ``iso_nodes`` and ``iso_scored`` (``score`` with its score)."""
    n, kinds = len(roles.numeric), len(roles.categorical)
    xs, cs = [f"x{i}" for i in range(n)], [f"c{i}" for i in range(kinds)]
    columns = ", ".join(xs + cs)
    values = ", ".join([f"CAST(coalesce({c}, {c}_m) AS DOUBLE) AS {x}" for c, x in zip(roles.numeric, xs)] + [f"{word(c)} AS {x}" for c, x in zip(roles.categorical, cs)])
    side = " ".join([f"WHEN {i} THEN {x} > b.cut" for i, x in enumerate(xs)] + [f"WHEN {n + i} THEN {x} = b.cat" for i, x in enumerate(cs)])
    one = f"{trees}e0"
    return f"""iso_med AS (SELECT model, count(*) AS rows, {', '.join(f'coalesce(quantile_cont({c}, 0.5), 0) AS {c}_m' for c in roles.numeric)} FROM {fit} GROUP BY model),
iso_keys AS (SELECT flow_row_id, tree, CASE WHEN v < 1 / {one} THEN u / {one} ELSE v END AS key FROM (
  SELECT flow_row_id, tree, {chance(f"'{seed}|any|' || flow_row_id")} AS u, {chance(f"'{seed}|' || tree || '|' || flow_row_id")} AS v
  FROM (SELECT DISTINCT flow_row_id FROM {fit}) i, (SELECT unnest(range({trees})) AS tree) t) d),
iso_rows AS (SELECT model, tree, {values} FROM {fit} JOIN iso_med USING (model) JOIN iso_keys USING (flow_row_id) WHERE key < {1.5 * sample} / iso_med.rows
  QUALIFY row_number() OVER (PARTITION BY model, tree ORDER BY key, flow_row_id) <= {sample}),
iso_sizes AS (SELECT model, tree, count(*) AS n FROM iso_rows GROUP BY model, tree),
iso AS (SELECT model, tree, n, {columns}, CAST(1 AS BIGINT) AS node, 0 AS depth, CAST(NULL AS INTEGER) AS f, CAST(NULL AS DOUBLE) AS cut, CAST(NULL AS VARCHAR) AS cat
    FROM iso_rows JOIN iso_sizes USING (model, tree)
  UNION ALL (WITH g AS (SELECT * FROM iso WHERE depth < ceil(log2(greatest(n, 2)))),
    t AS (SELECT model, tree, node, {', '.join(f'min({x}) AS lo_{x}, max({x}) AS hi_{x}' for x in xs)}, {', '.join(f'count(DISTINCT {x}) AS d_{x}' for x in cs)} FROM g GROUP BY model, tree, node HAVING count(*) > 1),
    o AS ({' UNION ALL '.join([f"SELECT model, tree, node, {i} AS f, CAST(NULL AS VARCHAR) AS cat, lo_{x} AS lo, hi_{x} AS hi FROM t WHERE hi_{x} > lo_{x}" for i, x in enumerate(xs)]
                              + [f"SELECT DISTINCT model, tree, node, {n + i}, {x}, 0e0, 0e0 FROM g JOIN t USING (model, tree, node) WHERE d_{x} > 1" for i, x in enumerate(cs)])}),
    k AS (SELECT *, row_number() OVER (PARTITION BY model, tree, node ORDER BY f, cat) - 1 AS place, count(*) OVER (PARTITION BY model, tree, node) AS places FROM o),
    p AS (SELECT *, lo + {chance(f"'{seed}|' || tree || '|' || node || '|cut'")} * (hi - lo) AS spot FROM k WHERE place = floor({chance(f"'{seed}|' || tree || '|' || node || '|feature'")} * places)),
    b AS (SELECT model, tree, node, f, cat, CASE WHEN f >= {n} THEN 0e0 WHEN spot < hi THEN spot ELSE lo END AS cut FROM p)
    SELECT model, tree, n, {columns}, 2 * node + CAST(CASE b.f {side} END AS INTEGER), depth + 1, b.f, b.cut, b.cat FROM g JOIN b USING (model, tree, node))),
iso_cuts AS (SELECT DISTINCT model, tree, node // 2 AS node, f, cut, cat FROM iso WHERE f IS NOT NULL),
iso_nodes AS (SELECT e.model, tree, node, coalesce(f, -1) AS feature, coalesce(cut, 0) AS cut, cat AS category,
    CASE WHEN f IS NULL THEN CAST(round((depth + {mean_path('m')}) * 1000000) AS BIGINT) ELSE 0 END AS path, n AS sample
  FROM (SELECT model, tree, node, depth, n, count(*) AS m FROM iso GROUP BY ALL) e LEFT JOIN iso_cuts USING (model, tree, node)),
iso_walk AS (SELECT model, flow_row_id, tree, {values}, CAST(1 AS BIGINT) AS node FROM {score} JOIN iso_med USING (model), (SELECT unnest(range({trees})) AS tree) t
  UNION ALL SELECT w.* REPLACE (2 * w.node + CAST(CASE b.f {side} END AS INTEGER) AS node) FROM iso_walk w JOIN iso_cuts b USING (model, tree, node)),
iso_paths AS (SELECT w.model, flow_row_id, CAST(sum(path) AS BIGINT) AS total, max(sample) AS m FROM iso_walk w JOIN iso_nodes n USING (model, tree, node) WHERE feature < 0 GROUP BY 1, 2),
iso_scored AS (SELECT s.*, pow(2e0, -(total / ({one} * 1000000)) / (CASE WHEN m > 1 THEN {mean_path('m')} ELSE 1e0 END)) - 0.5e0 AS score
  FROM {score} s JOIN iso_paths USING (model, flow_row_id))"""


# benign training rows, four fifths to fit (part 'fit'), the rest to calibrate, and the test rows of both classes
DETECTOR_ROWS = f"""benign AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || flow_row_id), flow_row_id) AS place, count(*) OVER () AS rows
  FROM flow_v WHERE label = 'Benign' AND {in_dates(TRAIN_DATES)}),
fit_rows AS (SELECT 'all' AS model, * FROM benign WHERE place > ceil(round(rows * 0.2e0, 6))),
to_score AS (SELECT 'all' AS model, 'calibrate' AS part, * EXCLUDE (place, rows) FROM benign WHERE place <= ceil(round(rows * 0.2e0, 6))
  UNION ALL SELECT 'all', 'test', * FROM flow_v WHERE {BINARY} AND {in_dates(TEST_DATES)})"""


# the same with the earliest four fifths to fit
TIMED_ROWS = f"""benign AS (SELECT *, row_number() OVER (ORDER BY ts, md5(CAST(flow_row_id AS VARCHAR)), flow_row_id) AS place, count(*) OVER () AS rows
  FROM flow_v WHERE label = 'Benign' AND {in_dates(TRAIN_DATES)}),
fit_rows AS (SELECT 'all' AS model, * FROM benign WHERE place <= floor(round(rows * 0.8e0, 6))),
to_score AS (SELECT 'all' AS model, 'calibrate' AS part, * EXCLUDE (place, rows) FROM benign WHERE place > floor(round(rows * 0.8e0, 6))
  UNION ALL SELECT 'all', 'test', * FROM flow_v WHERE {BINARY} AND {in_dates(TEST_DATES)})"""


def calibrated(share: float = 0.99) -> str:
    """``limits`` (model, threshold, calibration_records) and ``flagged`` (test rows) from ``iso_scored`` with a ``part``."""
    return f"""ordered AS (SELECT model, list(score ORDER BY score) AS s, {share}e0 * (count(*) - 1) AS spot FROM iso_scored WHERE part = 'calibrate' GROUP BY model),
limits AS (SELECT model, len(s) AS calibration_records, s[CAST(floor(spot) AS INTEGER) + 1] + (s[CAST(ceil(spot) AS INTEGER) + 1] - s[CAST(floor(spot) AS INTEGER) + 1]) * (spot - floor(spot)) AS threshold FROM ordered),
flagged AS (SELECT s.*, CAST(s.label = 'Malicious' AS INTEGER) AS actual, CAST(s.score >= threshold AS INTEGER) AS predicted,
  CAST(s.score > 0 AS INTEGER) AS automatic, threshold FROM iso_scored s LEFT JOIN limits USING (model) WHERE part = 'test')"""


def rolling_rows(fit_share: float = 0.8) -> str:
    """Fit rows, and rows to score, of every fold of the expanding past (``model`` is the test date)."""
    return f"""folds AS (SELECT DISTINCT capture_date AS d FROM flow_v WHERE {BINARY} AND capture_date > (SELECT min(capture_date) FROM flow_v WHERE {BINARY})),
past AS (SELECT CAST(d AS VARCHAR) AS model, v.*, row_number() OVER (PARTITION BY d ORDER BY ts, md5(CAST(flow_row_id AS VARCHAR)), flow_row_id) AS place, count(*) OVER (PARTITION BY d) AS rows
  FROM folds JOIN flow_v v ON capture_date < d WHERE label = 'Benign'),
fit_rows AS (SELECT * EXCLUDE (place, rows) FROM past WHERE place <= floor(round(rows * {fit_share}e0, 6))),
to_score AS (SELECT model, 'calibrate' AS part, * EXCLUDE (model, place, rows) FROM past WHERE place > floor(round(rows * {fit_share}e0, 6))
  UNION ALL SELECT CAST(d AS VARCHAR), 'test', v.* FROM folds JOIN flow_v v ON capture_date = d WHERE {BINARY})"""
