"""Isolation forest (Liu, Ting and Zhou 2008) as Spark jobs.

Every draw is an md5 of (seed, tree, row) or (seed, tree, node), so neither partitions nor engines matter and SQL can repeat a forest.

Fitting: a row has a key between 0 and 1 for every tree, and a tree's sample is the ``sample`` rows with the smallest keys. Such samples
can be merged: those of nested sets of rows (the expanding past of a rolling evaluation) all come from one pass over the rows, in which a
row is a candidate only if its key is small enough for the smallest set it belongs to. Every tree grows in its own group of candidates.
The model is a node table: nodes are numbered from 1 at the root, node k has the children 2 k and 2 k + 1. Path lengths are kept in
whole millionths, so their sums, and equal scores, don't depend on the order of summation.

Scoring: a few models (counted) go to the tasks; with more of them, rows meet the nodes of their model by one shuffle, in as many shares
as a model has rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ordering import prefix_quantiles
from tidewatch.operators.prep import category_codes, medians
from tidewatch.roles import Roles
from tidewatch.sources.tables import stored

GROUP = "_model"
ALL = "all"
UNIT = 1_000_000  # path lengths are whole numbers of 1 / UNIT
SPARE = 1.5  # candidates per wanted row; fewer than 1 has no chance at 256 rows and is made up for
SHARE_ROWS = 1 << 18  # rows of one model that one task scores
NODES = "model string, tree int, node int, feature int, cut double, category string, path long, sample int"


def with_group(frame: DataFrame, group: str | None) -> DataFrame:
    return frame.withColumn(GROUP, F.lit(ALL) if group is None else F.col(group).cast("string"))


def with_fills(frame: DataFrame, fills: dict[str, dict[str, float]], models: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Numeric columns as doubles with NULL replaced by the row's own model's median, under new names."""
    columns = list(fills)
    table = frame.sparkSession.createDataFrame(
        [(m, *[float(fills[c].get(m, 0.0)) for c in columns]) for m in models],
        ", ".join([f"{GROUP} string", *[f"_fill_{i} double" for i in range(len(columns))]]),
    )
    joined = frame.join(F.broadcast(table), GROUP, "left")  # one row per model
    filled = joined.withColumns({
        n: F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{i}"), F.lit(0.0)) for i, (c, n) in enumerate(zip(columns, names))
    })
    return filled.drop(*[f"_fill_{i}" for i in range(len(columns))])


def draw(*parts) -> Column:
    """A number from 0 to 1 out of the first 13 hex digits of an md5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def tree_key(seed: int, trees: int, tree: Column, row_id: str) -> Column:
    """The key of a row for a tree. Keys below 1 / trees follow from one draw for all trees, so most rows of a large table need no other."""
    own = draw(F.lit(seed), tree, row_id)
    return F.when(own < 1.0 / trees, _any_key(seed, trees, row_id)).otherwise(own)


def _any_key(seed: int, trees: int, row_id: str) -> Column:
    return draw(F.lit(seed), F.lit("any"), row_id) / trees


def candidates(rows: DataFrame, group: str, row_id: str, limits: DataFrame, trees: int, seed: int) -> DataFrame:
    """(tree, _key) for every row and tree whose key lies below the ``_limit`` of the row's group (one row per group)."""
    near = rows.join(F.broadcast(limits), group).where((F.col("_limit") >= 1.0 / trees) | (_any_key(seed, trees, row_id) < F.col("_limit")))
    placed = near.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return placed.withColumn("_key", tree_key(seed, trees, F.col("tree"), row_id)).where(F.col("_key") < F.col("_limit")).drop("_limit")


def tree_samples(rows: DataFrame, row_id: str, sizes: dict[str, int], trees: int, sample: int, seed: int) -> DataFrame:
    """The ``sample`` rows with the smallest keys per (group, tree), or all rows of a group that has fewer, with ``_rank``. Stored."""
    order = Window.partitionBy(GROUP, "tree").orderBy("_key", row_id)
    spare, wanted = SPARE, {g: min(sample, n) for g, n in sizes.items()}
    while True:
        limits = rows.sparkSession.createDataFrame([(g, _limit(spare, sample, n)) for g, n in sizes.items()], f"{GROUP} string, _limit double")
        drawn = candidates(rows, GROUP, row_id, limits, trees, seed).withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= sample)
        drawn = stored(drawn, "samples")
        met = drawn.groupBy(GROUP, "tree").agg(F.max("_rank").alias("n")).groupBy(GROUP).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("trees")).collect()  # one row per model
        if spare >= 1e6 or {r[GROUP]: (r["n"], r["trees"]) for r in met} == {g: (n, trees) for g, n in wanted.items()}:
            return drawn
        spare *= 8


def _limit(spare: float, sample: int, n: int) -> float:
    return min(2.0, spare * sample / n)


def expected_path(m: int) -> float:
    if m <= 1:
        return 0.0
    return 1.0 if m == 2 else 2.0 * (math.log(m - 1.0) + 0.5772156649015329) - 2.0 * (m - 1.0) / m


def _grow(values, words, model: str, tree: int, seed: int) -> list[tuple]:
    """The nodes of one tree over its sample: numeric values and category words, a row each."""
    import hashlib

    import numpy as np

    def chance(node: int, what: str) -> float:
        return int(hashlib.md5(f"{seed}|{tree}|{node}|{what}".encode()).hexdigest()[:13], 16) / (1 << 52)

    n, numbers = len(words), values.shape[1]
    limit = math.ceil(math.log2(max(n, 2)))
    out, pending = [], [(1, np.arange(n), 0)]
    while pending:
        node, rows, depth = pending.pop()
        choices = []
        if depth < limit and len(rows) > 1:
            low, high = (values[rows].min(axis=0), values[rows].max(axis=0)) if numbers else ([], [])
            choices = [(j, None) for j in range(numbers) if high[j] > low[j]]
            for j in range(words.shape[1]):
                present = sorted(set(words[rows, j]))
                if len(present) > 1:
                    choices += [(numbers + j, w) for w in present]
        if not choices:
            out.append((model, tree, node, -1, 0.0, None, round((depth + expected_path(len(rows))) * UNIT), n))
            continue
        feature, word = choices[int(chance(node, "feature") * len(choices))]
        cut = 0.0
        if feature < numbers:
            cut = float(low[feature] + chance(node, "cut") * (high[feature] - low[feature]))
            if not cut < high[feature]:  # rounded up to the upper end, or not finite
                cut = float(low[feature])
            right = values[rows, feature] > cut
        else:
            right = words[rows, feature - numbers] == word
        out.append((model, tree, node, feature, cut, word, 0, n))
        pending += [(2 * node, rows[~right], depth + 1), (2 * node + 1, rows[right], depth + 1)]
    return out


def _grower(numeric: Sequence[str], categories: Sequence[str], seed: int, sample: int, folds: Sequence[tuple] | None = None):
    """Grows the tree of a group's sample; or of every fold (name, last segment, fill values) out of candidates with a ``_segment``."""

    def grow(key, pdf):
        import pandas as pd

        values = pdf[list(numeric)].to_numpy(dtype="float64")
        words = pdf[list(categories)].to_numpy(dtype=object).reshape(len(pdf), len(categories))
        if folds is None:
            first = pdf["_rank"].drop_duplicates().sort_values().index
            out = _grow(values[first], words[first], key[0], int(key[1]), seed)
        else:
            import numpy as np

            order = pdf.sort_values(["_key", "_id"]).drop_duplicates(["_key", "_id"]).index.to_numpy()
            segment, out = pdf["_segment"].to_numpy(), []
            for name, last, fills in folds:
                rows = order[segment[order] <= last][:sample]
                if len(rows):
                    own = values[rows]
                    out += _grow(np.where(np.isnan(own), np.array(fills), own), words[rows], name, int(key[0]), seed)
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])

    return grow


def _walk(values, kinds, m):
    """Score of a batch: from the mean path length over all trees of one model.

    Every test is one comparison with a range of the node's column: numbers above the cut, or the place of a category among the model's.
    """
    import numpy as np

    n = len(values)
    places = []
    for j, known in enumerate(m["codes"]):
        place = np.searchsorted(known, kinds[:, j])
        place[place == len(known)] = 0
        places.append(np.where(known[place] == kinds[:, j], place, -1.0) if len(known) else np.full(n, -1.0))
    inputs = np.concatenate([*values.T, *places])  # column by column
    rows = np.arange(n)
    state = np.repeat(m["roots"][:, None], n, axis=1)
    for _ in range(int(m["depth"])):
        met = inputs.take(m["column"].take(state) * n + rows)
        right = (met > m["low"].take(state)) & ~(met >= m["high"].take(state))
        state = m["below"].take(state)
        state += right  # nodes 2 k and 2 k + 1 are neighbours
    return np.exp2(-m["path"].take(state).sum(axis=0) / (len(m["roots"]) * UNIT) / m["norm"]) - 0.5


def _walk_all(values, kinds, m):
    import numpy as np

    parts = [_walk(values[s: s + 512], kinds[s: s + 512], m) for s in range(0, len(values), 512)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _scorer(model_arrays, n_numeric: int):
    def score(model, *columns):
        import numpy as np
        import pandas as pd

        arrays = model_arrays.value
        values = np.column_stack([c.to_numpy("float64") for c in columns[:n_numeric]]) if n_numeric else np.zeros((len(model), 0))
        rest = columns[n_numeric:]
        kinds = np.column_stack([c.to_numpy("int64") for c in rest]) if rest else np.zeros((len(model), 0), "int64")
        out = np.full(len(model), np.nan)
        names = model.to_numpy()
        for name in pd.unique(names):
            if name in arrays:
                where = np.flatnonzero(names == name)
                out[where] = _walk_all(values[where], kinds[where], arrays[name])
        return pd.Series(out)

    return score


def _meeting(kept: list[str], numbers: list[str], codes: list[str], output: str):
    """Rows sorted by (model, share, kind): the nodes of a model first, then its rows, which get their score."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, held, model = None, [], None
        for batch in batches:
            frame = batch.select([GROUP, "_share", "_kind"]).to_pandas()
            place = list(zip(*(frame[c] for c in frame.columns)))
            cuts = [i for i in range(len(place)) if i == 0 or place[i] != place[i - 1]] + [len(place)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(s, e - s)
                if place[s][:2] != last:
                    last, held, model = place[s][:2], [], None
                if place[s][2] == 0:
                    held.append(pa.Table.from_batches([pa.RecordBatch.from_struct_array(part.column(part.schema.get_field_index("_node")))]))
                    continue
                if model is None:
                    model = _arrays(pa.concat_tables(held).to_pandas().assign(model=last[0]), len(numbers), len(codes))[last[0]]
                columns = {c: part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in numbers + codes}
                values = np.column_stack([columns[c].astype("float64") for c in numbers]) if numbers else np.zeros((e - s, 0))
                kinds = np.column_stack([columns[c].astype("int64") for c in codes]) if codes else np.zeros((e - s, 0), "int64")
                slim = part.select(kept)
                yield pa.RecordBatch.from_arrays([*slim.columns, pa.array(_walk_all(values, kinds, model))], names=[*kept, output])
    return run


@dataclass
class ForestModel:
    """Node table plus the fitted fill values; save it by writing ``nodes``."""

    roles: Roles
    fills: dict[str, dict[str, float]]  # column -> model -> median
    nodes: DataFrame
    models: list[str]
    broadcast_models: int = 8

    def score(self, frame: DataFrame, group: str | None = None, output: str = "score") -> DataFrame:
        """Adds the anomaly score; positive is anomalous under the automatic threshold, NULL means that the row has no model."""
        keyed = with_group(frame, group)
        numbers = [f"_num_{i}" for i in range(len(self.roles.numeric))]
        known = F.coalesce(F.col(GROUP).isin(self.models), F.lit(False))
        rows = with_fills(keyed.where(known), self.fills, self.models, numbers)
        codes = [F.xxhash64(F.coalesce(F.col("category"), F.lit("missing"))).alias("code")]  # as category_codes does
        nodes = self.nodes.select("model", "tree", "node", "feature", "cut", *codes, "path", "sample")
        if len(self.models) <= self.broadcast_models:
            arrays = frame.sparkSession.sparkContext.broadcast(_arrays(nodes.toPandas(), len(numbers), len(self.roles.categorical)))  # at most trees x 2 x sample rows a model
            udf = F.pandas_udf(_scorer(arrays, len(numbers)), T.DoubleType())
            inputs = [F.col(GROUP), *[F.col(n) for n in numbers], *category_codes(self.roles.categorical)]
            scored = rows.withColumn(output, udf(*inputs)).drop(GROUP, *numbers)
        else:
            scored = self._met(rows, nodes, numbers, frame, output)
        # rows without a model stay, with a NULL score
        return scored.unionByName(keyed.where(~known).withColumn(output, F.lit(None).cast("double")).drop(GROUP))

    def _met(self, rows: DataFrame, nodes: DataFrame, numbers: list[str], frame: DataFrame, output: str) -> DataFrame:
        codes = [f"_code_{i}" for i in range(len(self.roles.categorical))]
        loads = {r[GROUP]: r["n"] for r in rows.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per model
        shares = frame.sparkSession.createDataFrame([(m, math.ceil(n / SHARE_ROWS)) for m, n in loads.items()], f"{GROUP} string, _shares int")
        coded = rows.withColumns(dict(zip(codes, category_codes(self.roles.categorical))))
        dealt = coded.join(F.broadcast(shares), GROUP).withColumn("_share", F.pmod(F.xxhash64(self.roles.row_id), F.col("_shares")).cast("int")).drop("_shares")
        sent = nodes.select(F.col("model").alias(GROUP), F.struct("tree", "node", "feature", "cut", "code", "path", "sample").alias("_node")).join(F.broadcast(shares), GROUP)
        sent = sent.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
        both = dealt.withColumn("_kind", F.lit(1)).unionByName(sent.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        place = [GROUP, "_share"]
        schema = T.StructType([*frame.schema.fields, T.StructField(output, T.DoubleType())])
        return both.repartition(*place).sortWithinPartitions(*place, "_kind").mapInArrow(_meeting(frame.columns, numbers, codes, output), schema)


def _arrays(nodes, numbers: int, kinds: int) -> dict:
    """Flat arrays per model: the lower child's position (the other one follows it), and the range of the column that goes to the other one.

    A leaf points to itself and its range is empty. A cut between numbers has no upper end, which NaN stands for.
    """
    import numpy as np

    result = {}
    for name, part in nodes.sort_values(["tree", "node"]).groupby("model"):
        tree, node, feature, code = (part[c].to_numpy("int64") for c in ("tree", "node", "feature", "code"))
        place = tree * (1 << 40) + node  # sorted
        below = np.where(feature >= 0, np.minimum(np.searchsorted(place, tree * (1 << 40) + 2 * node), len(place) - 1), np.arange(len(place)))
        low, high, codes = part["cut"].to_numpy("float64", copy=True), np.full(len(place), np.nan), []
        for j in range(kinds):
            mine = feature == numbers + j
            codes.append(np.unique(code[mine]))
            at = np.searchsorted(codes[-1], code[mine])
            low[mine], high[mine] = at - 0.5, at + 0.5
        low[feature < 0] = np.inf
        m = int(part["sample"].max())
        result[name] = {
            "roots": np.flatnonzero(node == 1), "column": np.maximum(feature, 0).astype(np.intp), "low": low, "high": high, "codes": codes,
            "below": below.astype(np.intp), "path": part["path"].to_numpy("int64"),
            "norm": expected_path(m) if m > 1 else 1.0, "depth": max(1, math.ceil(math.log2(max(m, 2)))),
        }
    return result


def _words(roles: Roles) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(f"word_{c}") for c in roles.categorical]


def fit_forest(train: DataFrame, roles: Roles, trees: int = 200, sample: int = 256, seed: int = 42, group: str | None = None) -> ForestModel:
    """One forest per group value; medians are fitted on the group's own rows. The node table is stored in the shared folder."""
    keyed = with_group(train, group).select(GROUP, roles.row_id, *roles.features)
    sizes = {r[GROUP]: r["n"] for r in keyed.groupBy(GROUP).agg(F.count("*").alias("n")).collect()}  # one row per model
    if not sizes:
        raise ValueError("no rows to fit a forest on")
    fills: dict[str, dict[str, float]] = {c: {} for c in roles.numeric}
    if roles.numeric:
        for r in medians(keyed, roles.numeric, [GROUP]).collect():
            fills[r["feature"]][r[GROUP]] = 0.0 if r["median"] is None else r["median"]
    for column in roles.numeric:
        for name in sizes:
            fills[column].setdefault(name, 0.0)
    names = [f"num_{i}" for i in range(len(roles.numeric))]
    words = _words(roles)
    ready = with_fills(keyed, fills, sorted(sizes), names).select(GROUP, roles.row_id, *names, *words)
    drawn = tree_samples(ready, roles.row_id, sizes, trees, sample, seed)
    grown = drawn.groupBy(GROUP, "tree").applyInPandas(_grower(names, [f"word_{c}" for c in roles.categorical], seed, sample), NODES)
    return ForestModel(roles, fills, stored(grown, "forest"), sorted(sizes))


def fit_forest_prefixes(
    rows: DataFrame, roles: Roles, segment: str, folds: Sequence[str], trees: int = 200, sample: int = 256, seed: int = 42
) -> ForestModel:
    """One forest per fold of an expanding past; the same forests as ``fit_forest`` on every fold's rows, from one pass over the rows.

    ``segment`` is the number of the first fold that a row belongs to (NULL: none); it belongs to all later folds. Samples and value
    counts are kept per segment and merged along the folds, so no row is repeated for later folds.
    """
    ids, words = roles.row_id, _words(roles)
    names = [f"num_{i}" for i in range(len(roles.numeric))]
    slim = rows.where(F.col(segment).isNotNull()).select(
        F.col(segment).cast("int").alias("_segment"), ids, *[F.col(c).cast("double").alias(n) for c, n in zip(roles.numeric, names)], *words)
    slim = stored(slim, "segments")  # finding a row's segment is dear, and several passes ask for it
    counts = {r["_segment"]: r["n"] for r in slim.groupBy("_segment").agg(F.count("*").alias("n")).collect()}  # one row per fold
    sizes, total = {}, 0
    for k in range(len(folds)):
        total += counts.get(k, 0)
        sizes[k] = total
    models = {folds[k]: k for k, n in sizes.items() if n}
    if not models:
        raise ValueError("no rows to fit a forest on")
    fills: dict[str, dict[str, float]] = {c: {m: 0.0 for m in models} for c in roles.numeric}
    if names:
        for r in prefix_quantiles(slim, names, 0.5, "_segment", list(models.values())).collect():  # one row per fold and column
            if r["value"] is not None:
                fills[roles.numeric[names.index(r["feature"])]][folds[r["fold"]]] = r["value"]
    plan = [(m, k, [fills[c][m] for c in roles.numeric]) for m, k in models.items()]
    spare = SPARE
    while True:
        limits = rows.sparkSession.createDataFrame([(k, _limit(spare, sample, n)) for k, n in sizes.items() if n], "_segment int, _limit double")
        drawn = stored(candidates(slim, "_segment", ids, limits, trees, seed), "candidates")
        met = {(r["tree"], r["_segment"]): r["n"] for r in drawn.groupBy("tree", "_segment").agg(F.countDistinct(ids).alias("n")).collect()} if spare < 1e6 else {}
        through = [0] * trees
        enough = True
        for k, n in sizes.items():
            through = [x + met.get((tree, k), 0) for tree, x in enumerate(through)]
            enough &= not n or min(through) >= min(sample, n)
        if enough or spare >= 1e6:
            break
        spare *= 8
    grower = _grower(names, [f"word_{c}" for c in roles.categorical], seed, sample, plan)
    grown = drawn.withColumn("_id", F.col(ids)).drop(ids).groupBy("tree").applyInPandas(grower, NODES)
    return ForestModel(roles, fills, stored(grown, "forest"), sorted(models))


def automatic_flag(score: Column) -> Column:
    return (score > 0).cast("int")
