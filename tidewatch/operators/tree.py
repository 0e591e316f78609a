"""Supervised detector: an exact classification tree with leak-free preprocessing.

Gini gain, cuts half-way between neighbouring values of the training rows, one category against the rest, no limit of depth unless one
is asked for, and no bins: the tree fits any training set in which equal rows have equal classes.

Growing. Equal training rows become one point with two class counts. Large nodes are split level by level in Spark, in two passes without a
shuffle of points: class counts per (node, feature, bucket of values) give the costs between buckets, and a bound for what lies inside each;
then the values of those buckets alone that can still hold the best cut are counted one by one. Points follow the cuts by a walk over the last
few levels and are written anew now and then. A node of at most ``local`` points is finished by one task with the same rule, so neither the limit
nor the buckets change the tree. The model is a node table in the shared folder; the driver holds only the nodes above that limit and their
ends, and no vocabulary.

Scoring. A node table of at most ``BROADCAST_NODES`` rows (counted) goes to the tasks. A larger one is cut: the top goes to the tasks,
and rows meet the nodes of their subtree by a shuffle, in as many shares as the subtree has rows.

Ties: the earlier feature (numbers first, in the order of the roles), then the smaller cut or category. Equal chances predict class 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.evaluation import add_rates, confusion
from tidewatch.operators.prep import Imputation, fit_dictionary, fit_imputation
from tidewatch.operators.profile import union_all
from tidewatch.roles import Roles
from tidewatch.session import scratch_path
from tidewatch.sources.tables import read_table, stored, write_table

LOCAL = 1 << 19  # points of a node that one task finishes
BUCKETS = 4096  # value ranges of a feature
LOOK = 1 << 17  # points looked at to cut the ranges
CHUNK = 1 << 16  # points of a block
LOT = 1 << 20  # rows of wanted buckets that one task looks through
KINDS = {"node": np.int32, "n0": np.int64, "n1": np.int64, "v": np.float64, "r": np.int16}
REWRITE = 8  # levels that points walk through before they are written anew
SLACK = 1e-9  # rounding of costs, relative
PART = 1 << 14  # points of a subtree that is sent as a whole to score rows
BROADCAST_NODES = 1 << 18
SHARE_ROWS = 1 << 16  # rows of one subtree that one task scores
# b0 and b1 are the class counts below the cut; ``top`` marks the nodes outside subtrees, and ``subtree`` their roots
NODES = ("node string, depth int, feature int, cut double, category string, below string, above string, n0 long, n1 long, b0 long, b1 long, "
         "root string, subtree boolean")


def _cost(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half the impurity of two sides, weighted by their rows; equal in every engine that follows IEEE 754."""
    a0, a1, b0, b1 = (c.cast("double") for c in (a0, a1, b0, b1))
    return a0 * a1 / (a0 + a1) + b0 * b1 / (b0 + b1)


def _points(ready: DataFrame, roles: Roles) -> DataFrame:
    """Distinct feature values with class counts."""
    numbers = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(roles.numeric)]
    kinds = [F.col(c).alias(f"c{i}") for i, c in enumerate(roles.categorical)]
    one = (F.col(roles.target) == 1).cast("long")
    rows = ready.where(F.col(roles.target).isNotNull()).select(*numbers, *kinds, (1 - one).alias("n0"), one.alias("n1"))
    names = rows.columns[:-2]
    return rows.groupBy(*names).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _encoded(points: DataFrame, numbers: int, kinds: int, count: int) -> tuple[DataFrame, DataFrame | None, list[int], list[np.ndarray]]:
    """Blocks of points ready to be counted, the words of the categories, the number of buckets of every feature, and which buckets hold several values.

    A category becomes the number of its word in their order, and every feature gets a bucket that rises with its value. A block is a row of arrays,
    so that a pass moves them as they are: ``node``, ``n0``, ``n1``, and ``v`` (value) and ``r`` (bucket) of every feature. Stored.
    """
    names, words, rows, sizes = [f"c{i}" for i in range(kinds)], None, points, {}
    looks = points.select(*[f"x{i}" for i in range(numbers)]).sample(min(1.0, LOOK / count), seed=7).toPandas() if numbers else {}  # merely balances the buckets
    cuts = []
    for i in range(numbers):
        known = np.sort(looks[f"x{i}"].to_numpy("float64"))
        known = known[~np.isnan(known)]
        cuts.append(np.unique(known[np.arange(1, BUCKETS) * len(known) // BUCKETS]) if len(known) else known)
    if kinds:
        words = fit_dictionary(points, names)
        sizes = {r["feature"]: r["n"] for r in words.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
        for i, c in enumerate(names):
            own = words.where(F.col("feature") == c).select(F.col("word").alias(c), F.col("place").cast("double").alias(f"k{i}"))
            rows = rows.join(own, c)
    widths = [len(c) + 2 for c in cuts] + [min(sizes[c], BUCKETS) for c in names]
    columns = [f"x{i}" for i in range(numbers)] + [f"k{i}" for i in range(kinds)]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // (4 * CHUNK)))
    block = _blocker(columns, cuts, [sizes[c] for c in names], BUCKETS)
    blocks = stored(rows.select(*columns, "n0", "n1").repartition(parts).mapInArrow(block, ", ".join(f"{c} binary" for c in _block_columns(len(columns)))), "points")
    several = [np.zeros(w, dtype=bool) for w in widths]
    spans = blocks.mapInArrow(_spans(len(columns)), "feature int, bucket int, least double, most double")
    for r in spans.groupBy("feature", "bucket").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("feature", "bucket").collect():
        several[r["feature"]][r["bucket"]] = True  # at most BUCKETS rows a feature
    return blocks, words, widths, several


def _block_columns(features: int) -> list[str]:
    return ["node", "n0", "n1", *[f"v{f}" for f in range(features)], *[f"r{f}" for f in range(features)]]


def _packed(arrays: dict[str, np.ndarray]):
    """One block."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a, KINDS[c[0] if c[0] in "vr" else c]).tobytes()], pa.binary()) for c, a in arrays.items()], names=list(arrays))


def _blocks(batches: Iterator) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: np.frombuffer(batch[c][i].as_buffer(), KINDS[c[0] if c[0] in "vr" else c]) for c in batch.schema.names if c != "open"}


def _blocker(columns: list[str], cuts: list[np.ndarray], sizes: list[int], buckets: int):
    """Rows to blocks."""

    def pack(batches):
        import pyarrow as pa

        chunk = pa.Table.from_batches(batches)
        values = [chunk[c].to_numpy() for c in columns]
        places = [np.where(np.isnan(v), len(c) + 1, np.searchsorted(c, v, side="right")) for v, c in zip(values, cuts)]
        places += [v if n <= buckets else v * buckets // n for v, n in zip(values[len(cuts):], sizes)]
        return _packed({"node": np.zeros(len(chunk)), "n0": chunk["n0"].to_numpy(), "n1": chunk["n1"].to_numpy(),
                        **{f"v{f}": v for f, v in enumerate(values)}, **{f"r{f}": r for f, r in enumerate(places)}})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= CHUNK:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)
    return run


def _spans(features: int):
    """The least and the largest value of every feature's buckets in a block."""

    def run(batches):
        import pyarrow as pa

        for block in _blocks(batches):
            for f in range(features):
                order = np.lexsort((block[f"v{f}"], block[f"r{f}"]))  # NaN last
                bucket, value = block[f"r{f}"][order], block[f"v{f}"][order]
                ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True])
                first = np.r_[0, ends[:-1] + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), f, np.int32)), pa.array(bucket[ends].astype(np.int32)), pa.array(value[first]), pa.array(value[ends])],
                                                 names=["feature", "bucket", "least", "most"])
    return run


def _moved(block: dict[str, np.ndarray], moves: list[tuple]) -> np.ndarray:
    """The node of every point after ``moves``, the cuts since the points were last written: (node, feature, whether numeric, cut, below, above)."""
    node = block["node"].copy()
    for parent, feature, numeric, cut, below, above in moves:
        mine = np.flatnonzero(node == parent)
        if len(mine):
            own = block[f"v{feature}"][mine]
            node[mine] = np.where((own > cut) | np.isnan(own) if numeric else own == cut, above, below)
    return node


def _places(node: np.ndarray, wanted: list[int]) -> np.ndarray:
    """Where a node stands in ``wanted``, -1 for others."""
    table = np.full(max(int(node.max()), max(wanted)) + 1, -1, dtype=np.int64)
    table[wanted] = np.arange(len(wanted))
    return table[node]


def _counter(widths: list[int], moves: list[tuple], large: list[int]):
    """Class counts by bucket of every feature and large node, one row per task, node and feature."""

    def run(batches):
        import pyarrow as pa

        points = np.zeros(len(large), dtype=np.int64)
        counts = [np.zeros((2, len(large) * w)) for w in widths]
        for block in _blocks(batches):
            at = _places(_moved(block, moves), large)
            on = np.flatnonzero(at >= 0)
            at, classes = at[on], [block[n][on].astype(np.float64) for n in ("n0", "n1")]
            points += np.bincount(at, minlength=len(large))
            for f, w in enumerate(widths):
                key = at * w + block[f"r{f}"][on]
                for i, c in enumerate(classes):
                    counts[f][i] += np.bincount(key, c, len(large) * w)  # whole numbers, exact up to 2^53
        some = np.flatnonzero(points)
        for f, w in enumerate(widths):
            if len(some):
                yield pa.RecordBatch.from_arrays([
                    pa.array([large[i] for i in some], pa.int32()), pa.array([f] * len(some), pa.int32()), pa.array(points[some]),
                    pa.array([counts[f][:, i * w:(i + 1) * w].astype(np.int64).tobytes() for i in some], pa.binary())], names=["node", "feature", "points", "counts"])
    return run


COUNTS = "node int, feature int, points long, counts binary"
OPTIONS = "node int, feature int, points long, reached double, t0 long, t1 long, bucket array<int>, next array<int>, rows array<long>, s0 array<long>, s1 array<long>, least array<double>"


def _options(numbers: int, several: list[np.ndarray]):
    """For a node and feature: a cost that some cut reaches, and the buckets that may hold a better one, with the least cost that theirs could have.

    The cost is concave in the class counts below a cut, so inside a bucket none is less than at the corners of what it may add to them.
    """

    def halves(a0, a1, t0, t1):
        with np.errstate(invalid="ignore"):
            return np.nan_to_num(a0 * a1 / (a0 + a1)) + np.nan_to_num((t0 - a0) * (t1 - a1) / (t0 + t1 - a0 - a1))

    def run(key, pdf):
        import pandas as pd

        node, feature = (int(k) for k in key)
        d0, d1 = np.sum([np.frombuffer(c, np.int64) for c in pdf["counts"]], axis=0).reshape(2, -1)
        bucket = np.flatnonzero(d0 + d1)
        d0, d1, mixed = d0[bucket].astype(np.float64), d1[bucket].astype(np.float64), several[feature][bucket]
        t0, t1 = d0.sum(), d1.sum()
        s0, s1 = (np.cumsum(d) - d if feature < numbers else np.zeros(len(d)) for d in (d0, d1))
        ends = halves(s0 + d0, s1 + d1, t0, t1)
        if feature < numbers:
            real = np.arange(len(bucket)) < len(bucket) - 1  # there is a cut after the bucket
            inner = np.minimum.reduce([halves(s0, s1, t0, t1), halves(s0 + d0, s1, t0, t1), halves(s0, s1 + d1, t0, t1)])
        else:
            real = ~mixed & (d0 + d1 < t0 + t1)
            inner = np.minimum(halves(d0, np.zeros(len(d0)), t0, t1), halves(np.zeros(len(d0)), d1, t0, t1))
        reached = float(ends[real].min()) if real.any() else np.inf
        least = np.where(mixed, np.minimum(ends, inner), np.where(real, ends, np.inf))
        kept = np.flatnonzero((least <= reached * (1 + SLACK) + SLACK) & (least < np.inf))
        after = np.r_[bucket[1:], -1]
        return pd.DataFrame({
            "node": [node], "feature": [feature], "points": [int(pdf["points"].sum())], "reached": [reached], "t0": [int(t0)], "t1": [int(t1)],
            "bucket": [bucket[kept].astype(np.int32)], "next": [after[kept].astype(np.int32)], "rows": [(d0 + d1)[kept].astype(np.int64)], "s0": [s0[kept].astype(np.int64)], "s1": [s1[kept].astype(np.int64)], "least": [least[kept]]})

    return run


def _lister(numbers: int, moves: list[tuple], large: list[int], spots: dict[str, np.ndarray], widths: list[int]):
    """The values of the wanted buckets with their class counts; of the bucket that follows, the least value without counts.

    ``spots`` are arrays, an item per wanted bucket: node, feature, bucket, next, lot, s0, s1, t0, t1.
    """

    def run(batches):
        import pyarrow as pa

        rank = {n: i for i, n in enumerate(large)}
        at_node = np.array([rank[n] for n in spots["node"].tolist()])
        tables = []
        for f, w in enumerate(widths):
            mine = np.flatnonzero(spots["feature"] == f)
            both = []
            for column in ("bucket", "next"):
                table = np.full(len(large) * w, -1, dtype=np.int64)
                use = mine[spots[column][mine] >= 0]
                table[at_node[use] * w + spots[column][use]] = use
                both.append(table)
            tables.append(both if len(mine) else None)
        for block in _blocks(batches):
            at = _places(_moved(block, moves), large)
            on = np.flatnonzero(at >= 0)
            classes = [block[n] for n in ("n0", "n1")]
            for f, w in enumerate(widths):
                if tables[f] is None:
                    continue
                key = at[on] * w + block[f"r{f}"][on]
                value = block[f"v{f}"]
                for beyond, table in enumerate(tables[f] if f < numbers else tables[f][:1]):
                    spot = table[key]
                    hit = np.flatnonzero(spot >= 0)
                    if not len(hit):
                        continue
                    spot, here = spot[hit], on[hit]
                    order = np.lexsort((value[here], spot))
                    spot, here = spot[order], here[order]
                    v = value[here]
                    fresh = spot[1:] != spot[:-1]
                    if not beyond:
                        fresh = fresh | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))
                    begin = np.flatnonzero(np.r_[True, fresh])
                    n0, n1 = (np.add.reduceat(c[here], begin) * (1 - beyond) for c in classes)
                    spot = spot[begin]
                    yield pa.RecordBatch.from_arrays([pa.array(spots["lot"][spot]), pa.array(spot.astype(np.int32)), pa.array(v[begin]), pa.array(n0), pa.array(n1)],
                                                     names=["lot", "spot", "value", "n0", "n1"])
    return run


VALUES = "lot int, spot int, value double, n0 long, n1 long"
CUTS = "node int, cost double, feature int, cut double, category double, b0 long, b1 long"


def _chooser(numbers: int, spots: dict[str, np.ndarray]):
    """The cut of least cost of every node, from the listed values of a lot of wanted buckets; ties as everywhere."""

    def run(pdf):
        import pandas as pd

        spot, value, n0, n1 = (pdf[c].to_numpy() for c in ("spot", "value", "n0", "n1"))
        order = np.lexsort((value, spot))  # NaN last
        spot, value = spot[order], value[order]
        begin = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | ((value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1])))])
        n0, n1 = (np.add.reduceat(n[order], begin) for n in (n0, n1))
        spot, value = spot[begin], value[begin]
        first = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]])
        sizes = np.diff(np.r_[first, len(spot)])
        node, feature, s0, s1, t0, t1 = (spots[c][spot] for c in ("node", "feature", "s0", "s1", "t0", "t1"))
        numeric = feature < numbers
        follows = np.r_[spot[1:] == spot[:-1], False]
        after = np.r_[value[1:], np.nan]
        l0, l1 = (np.cumsum(n) - np.repeat(np.cumsum(n)[first] - n[first], sizes) for n in (n0, n1))
        b0, b1 = np.where(numeric, s0 + l0, t0 - n0), np.where(numeric, s1 + l1, t1 - n1)
        with np.errstate(invalid="ignore", over="ignore"):
            middle = value + (after - value) / 2
            between = np.where((middle >= value) & (middle < after), middle, value)  # no number lies between, or one is not finite
        real = np.flatnonzero(np.where(numeric, follows & (n0 + n1 > 0), n0 + n1 < t0 + t1))
        node, feature, b0, b1, numeric = node[real], feature[real], b0[real], b1[real], numeric[real]
        a0, a1, c0, c1 = (v.astype(np.float64) for v in (b0, b1, t0[real] - b0, t1[real] - b1))
        cost = a0 * a1 / (a0 + a1) + c0 * c1 / (c0 + c1)
        cut, category = np.where(numeric, between[real], 0.0), np.where(numeric, np.nan, value[real])
        best = np.lexsort((np.where(numeric, 0.0, category), cut, feature, cost, node))
        best = best[np.flatnonzero(np.r_[True, node[best][1:] != node[best][:-1]])] if len(best) else best
        return pd.DataFrame({"node": node[best], "cost": cost[best], "feature": feature[best], "cut": cut[best], "category": category[best], "b0": b0[best], "b1": b1[best]})

    return run


def _best_cuts(blocks: DataFrame, numbers: int, widths: list[int], several: list[np.ndarray], moves: list[tuple], large: list[int]) -> tuple[dict[int, int], dict]:
    """Points of the large nodes, and the cut of least cost of every one that has a cut and more than one point: (cost, feature, cut, category, b0, b1).

    ``moves`` are the cuts since the blocks were written. Two passes: class counts by bucket tell which buckets can hold the best cut; only the values of those are counted one by one.
    """
    passed = {f"v{m[1]}" for m in moves}
    counted = blocks.select("node", "n0", "n1", *sorted(passed), *[f"r{f}" for f in range(len(widths))]).mapInArrow(_counter(widths, moves, large), COUNTS)
    found = counted.groupBy("node", "feature").applyInPandas(_options(numbers, several), OPTIONS).collect()  # a row per large node and feature
    reached: dict[int, float] = {}
    for r in found:
        reached[r["node"]] = min(reached.get(r["node"], np.inf), r["reached"])
    spots = [(r["node"], r["feature"], b, n, rows, s0, s1, r["t0"], r["t1"])
             for r in found for b, n, rows, s0, s1, least in zip(r["bucket"], r["next"], r["rows"], r["s0"], r["s1"], r["least"])
             if least <= reached[r["node"]] * (1 + SLACK) + SLACK]
    points = {r["node"]: r["points"] for r in found}
    if not spots:
        return points, {}
    kinds = (np.int32,) * 4 + (np.int64,) * 5
    names = ("node", "feature", "bucket", "next", "rows", "s0", "s1", "t0", "t1")
    arrays = {n: np.array(v, dtype=k) for n, k, v in zip(names, kinds, zip(*spots))}
    arrays["lot"] = (np.cumsum(arrays["rows"]) // LOT).astype(np.int32)  # a lot has few rows or is one bucket
    used = set(arrays["feature"].tolist())
    rows = blocks.select("node", "n0", "n1", *sorted(passed | {f"v{f}" for f in used}), *[f"r{f}" for f in sorted(used)])
    listed = rows.mapInArrow(_lister(numbers, moves, large, arrays, widths), VALUES)
    best: dict[int, tuple] = {}
    for r in listed.groupBy("lot").applyInPandas(_chooser(numbers, arrays), CUTS).collect():  # a row per large node and lot
        numeric = r["feature"] < numbers
        own = (r["cost"], r["feature"], r["cut"], None if numeric else r["category"], r["b0"], r["b1"])
        best[r["node"]] = min(best.get(r["node"], own), own, key=lambda b: (*b[:3], b[3] or 0.0))
    return points, best


def _written(blocks: DataFrame, moves: list[tuple], large: list[int], small: list[int]) -> tuple[DataFrame, DataFrame]:
    """The points of the large and of the small nodes with the node that they have reached, each stored once; others are done."""
    columns = blocks.columns

    def move(batches):
        import pyarrow as pa

        held: dict[int, list] = {0: [], 1: []}

        def put(kind):
            block = _packed({c: np.concatenate([h[c] for h in held[kind]]) for c in columns})
            held[kind] = []
            return block.append_column("open", pa.array([kind], pa.int32()))

        for block in _blocks(batches):
            node = _moved(block, moves)
            kinds = np.full(max([int(node.max()), *large, *small]) + 1, -1, dtype=np.int32)
            kinds[large], kinds[small] = 1, 0
            for kind in (0, 1):
                on = np.flatnonzero(kinds[node] == kind)
                if len(on):
                    held[kind].append({c: (node if c == "node" else block[c])[on] for c in columns})
                    if sum(len(h["node"]) for h in held[kind]) >= CHUNK:
                        yield put(kind)
        for kind in (0, 1):
            if held[kind]:
                yield put(kind)

    schema = T.StructType([*blocks.schema.fields, T.StructField("open", T.IntegerType())])
    path = write_table(blocks.mapInArrow(move, schema), scratch_path(blocks.sparkSession, "points"), partition_by=["open"])
    whole = read_table(blocks.sparkSession, path, schema=schema)
    return whole.where("open = 1").drop("open"), whole.where("open = 0").drop("open")


def _unpacked(numbers: int, kinds: int):
    """Blocks to rows; a category is the number of its word."""

    def run(batches):
        import pyarrow as pa

        features = [f"v{f}" for f in range(numbers + kinds)]
        for block in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(block[c]) for c in ["node", *features, "n0", "n1"]],
                                             names=["node", *[f"x{i}" for i in range(numbers)], *[f"c{i}" for i in range(kinds)], "n0", "n1"])
    return run


def _finisher(numbers: int, kinds: int, max_depth: int | None, part: int = PART):
    """Grows the subtree of one node, all its nodes of a level at once.

    Every feature is sorted once; its order of the points is kept by node and value, and dealt to the two sides of the cuts without
    another sort, so a level costs a few passes over the points of nodes that still grow.
    """

    def grow(key, pdf):
        import numpy as np
        import pandas as pd

        root, depth = key[0], len(key[0]) - 1
        n0, n1 = pdf["n0"].to_numpy("int64"), pdf["n1"].to_numpy("int64")
        values, codes, orders = [], [], []  # distinct values of a feature, their place by point, and the points by node and place
        for column in [f"x{i}" for i in range(numbers)] + [f"c{i}" for i in range(kinds)]:
            own = pdf[column]
            word, code = np.unique(own.to_numpy("float64") if column[0] == "x" else own.to_numpy(), return_inverse=True)
            values.append(word)
            codes.append(code.astype(np.int32))
            orders.append(np.argsort(codes[-1], kind="stable").astype(np.int32))
        count, number, base = np.array([len(pdf)]), np.zeros(1, np.int64), 0
        side = np.zeros(len(pdf), dtype=bool)
        home = np.full(1, None, dtype=object)  # the subtree of a node, of at most ``part`` points
        out = []

        def names(k):
            return [f"{root}.{i}" if i else root for i in k.tolist()]

        while len(count):
            starts = np.cumsum(count) - count
            t0, t1 = (np.add.reduceat(n[orders[0]], starts) for n in (n0, n1))
            split = (t0 > 0) & (t1 > 0) & (count > 1) & (max_depth is None or depth < max_depth)
            best = np.full(len(count), np.inf)
            chosen, low = np.full(len(count), -1), np.zeros(len(count), np.int64)
            beyond, low0, low1 = low.copy(), t0.copy(), t1.copy()
            of = np.repeat(np.arange(len(count)), count)
            on = split[of]
            of, orders = of[on], [o[on] for o in orders]
            s0, s1 = np.cumsum(t0 * split) - t0 * split, np.cumsum(t1 * split) - t1 * split

            def offer(feature, where, place, after, b0, b1):
                """Candidates, sorted by node and then by place."""
                if not len(where):
                    return
                l0, l1, h0, h1 = (v.astype(np.float64) for v in (b0, b1, t0[where] - b0, t1[where] - b1))
                cost = l0 * l1 / (l0 + l1) + h0 * h1 / (h0 + h1)
                begin = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
                least = np.minimum.reduceat(cost, begin)
                hits = np.flatnonzero(cost == np.repeat(least, np.diff(np.r_[begin, len(where)])))
                first = hits[np.r_[True, where[hits[1:]] != where[hits[:-1]]]]
                first = first[cost[first] < best[where[first]]]
                to = where[first]
                best[to], chosen[to], low[to], beyond[to], low0[to], low1[to] = cost[first], feature, place[first], after[first], b0[first], b1[first]

            for f, (order, code) in enumerate(zip(orders, codes)):
                k = code[order]
                ends = np.flatnonzero(np.r_[(of[1:] != of[:-1]) | (k[1:] != k[:-1]), True]) if len(of) else np.zeros(0, np.int64)  # of equal values in a node
                where, c0, c1 = of[ends], np.cumsum(n0[order])[ends], np.cumsum(n1[order])[ends]
                if f < numbers:
                    inside = np.flatnonzero(where[1:] == where[:-1])
                    here = where[inside]
                    offer(f, here, k[ends[inside]], k[ends[inside] + 1], c0[inside] - s0[here], c1[inside] - s1[here])
                else:
                    a0, a1 = np.diff(c0, prepend=0), np.diff(c1, prepend=0)
                    some = np.flatnonzero(a0 + a1 < t0[where] + t1[where])
                    here = where[some]
                    offer(f, here, k[ends[some]], k[ends[some]], t0[here] - a0[some], t1[here] - a1[some])
            grows = chosen >= 0
            child = np.full(len(count), -1)
            child[grows] = base + 1 + 2 * np.arange(int(grows.sum()))
            base += 2 * int(grows.sum())
            cut, category = np.zeros(len(count)), np.full(len(count), None, dtype=object)
            for f, known in enumerate(values):
                mine = np.flatnonzero(chosen == f)
                if f >= numbers:
                    category[mine] = known[low[mine]]
                    continue
                v, after = known[low[mine]], known[beyond[mine]]
                with np.errstate(invalid="ignore", over="ignore"):
                    middle = v + (after - v) / 2
                    good = (middle >= v) & ((middle < after) | (np.isnan(after) & ~np.isnan(middle)))
                cut[mine] = np.where(good, middle, v)
            called = np.array(names(number), dtype=object)
            fresh = np.array([h is None for h in home], dtype=bool) & (count <= part)
            home[fresh] = called[fresh]
            out.append(pd.DataFrame({
                "node": called, "depth": depth, "feature": chosen, "cut": cut, "category": category, "below": None, "above": None, "n0": t0, "n1": t1,
                "b0": low0, "b1": low1, "root": home, "subtree": fresh}))
            parents = np.flatnonzero(grows)
            for name, step in (("below", 0), ("above", 1)):
                sides = np.full(len(count), None, dtype=object)
                sides[parents] = names(child[parents] + step)
                out[-1][name] = sides
            points = orders[0]
            for f in range(numbers + kinds):
                mine = np.flatnonzero(chosen[of] == f)
                place = codes[f][points[mine]]
                side[points[mine]] = place > low[of[mine]] if f < numbers else place == low[of[mine]]
            own = count * split
            starts = np.cumsum(own) - own
            under = np.bincount(of[~side[points]], minlength=len(count))
            at = np.arange(len(of))
            for f, order in enumerate(orders):
                above = side[order]
                passed = np.cumsum(~above) - ~above  # points below their cut, before this one
                within = passed - (np.cumsum(under) - under)[of]
                dealt = np.empty_like(order)
                dealt[np.where(above, at + under[of] - within, starts[of] + within)] = order
                orders[f] = dealt
            count = np.column_stack([under, own - under])[parents].ravel()
            number = np.column_stack([child, child + 1])[parents].ravel()
            home = np.repeat(home[parents], 2)
            depth += 1
        return pd.concat(out, ignore_index=True)[[c.split()[0] for c in NODES.split(", ")]]

    return grow


def _dealt(blocks: DataFrame, numbers: int, kinds: int, full: int) -> DataFrame:
    """Points of small nodes in many more partitions than there are nodes of full size, so that few of those meet in one."""
    values = [f"x{i} double" for i in range(numbers)] + [f"c{i} double" for i in range(kinds)]
    rows = blocks.select("node", *[f"v{f}" for f in range(numbers + kinds)], "n0", "n1").mapInArrow(_unpacked(numbers, kinds), ", ".join(["node int", *values, "n0 long", "n1 long"]))
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, min(2048, 16 * full)), "node")


def grow_nodes(points: DataFrame, numbers: int, kinds: int, max_depth: int | None = None, local: int = LOCAL) -> DataFrame:
    """The node table (``NODES``) of the tree over distinct points x0.. c0.. with class counts n0 and n1, which are read several times. Stored."""
    whole = points.agg(F.count(F.lit(1)).alias("points"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    count, names = whole["points"], {0: "1"}
    top, ends = [], {0: (whole["n0"], whole["n1"])}  # nodes outside subtrees, and the class counts of open ones: about two a level for every ``local`` points
    small, moves, words = [], [], None
    if count <= local:
        small.append(points.withColumn("node", F.lit(0)))
    else:
        opened, words, widths, several = _encoded(points, numbers, kinds, count)
        large, done, asked, held = [0], [], 0, sum(ends[0])  # of the points that are read: levels since they were written, and rows

        def close(node: int, cut: tuple = (-1, 0.0, None), low: tuple | None = None, sides: tuple = (None, None)):
            (n0, n1), (b0, b1) = ends[node], low or ends[node]
            top.append((names[node], len(names[node]) - 1, *cut, *sides, n0, n1, b0, b1, None, False))

        def is_end(node: int) -> bool:
            return min(ends[node]) == 0 or max_depth is not None and len(names[node]) - 1 >= max_depth

        while True:
            for node in [n for n in large if is_end(n)]:
                close(node)
            large = [n for n in large if not is_end(n)]
            done += [n for n in large if sum(ends[n]) <= local]
            large = [n for n in large if sum(ends[n]) > local]
            rest = sum(sum(ends[n]) for n in large)
            if not large or asked >= REWRITE or 2 * rest < held:
                opened, finished = _written(opened, moves, large, done)
                small.append(finished)
                moves, done, asked, held = [], [], 0, rest
            if not large:
                break
            sizes, best = _best_cuts(opened, numbers, widths, several, moves, large)
            following = []
            for node in large:
                if sizes[node] <= local or node not in best:
                    done.append(node)
                    continue
                _, feature, cut, category, b0, b1 = best[node]
                pair = (len(names), len(names) + 1)
                for child, side, own in zip(pair, "01", ((b0, b1), (ends[node][0] - b0, ends[node][1] - b1))):
                    names[child], ends[child] = names[node] + side, own
                close(node, (feature, cut, category), (b0, b1), tuple(names[c] for c in pair))
                numeric = feature < numbers
                moves.append((node, feature, numeric, cut if numeric else category, *pair))
                following += pair
            large, asked = following, asked + 1
    grow = _finisher(numbers, kinds, max_depth, min(local, PART))
    subtree = lambda key, pdf: grow((names[int(key[0])],), pdf)
    if words is None:
        finished = union_all(small) if not top else _dealt(union_all(small), numbers, kinds, count // local)
        finished = finished.groupBy("node").applyInPandas(subtree, NODES)
        return stored(finished if not top else points.sparkSession.createDataFrame(top, NODES).unionByName(finished), "tree")
    coded = NODES.replace("category string", "category double")
    nodes = _dealt(union_all(small), numbers, kinds, count // local).groupBy("node").applyInPandas(subtree, coded)
    nodes = points.sparkSession.createDataFrame(top, coded).unionByName(nodes)
    used = words.select(F.expr(f"CAST(substring(feature, 2) AS INT) + {numbers}").alias("feature"), F.col("place").cast("double").alias("category"), "word")
    named = nodes.join(used, ["feature", "category"], "left").withColumn("category", F.col("word"))
    return stored(named.select(*[c.split()[0] for c in NODES.split(", ")]), "tree")


class _Walker:
    """Flat arrays of nodes; walks rows from a root to where they end."""

    def __init__(self, nodes, numbers: int):
        import numpy as np

        place = {n: i for i, n in enumerate(nodes["node"])}
        self.numbers, self.names = numbers, nodes["node"].to_numpy()
        self.root = int(nodes["depth"].to_numpy().argmin()) if len(nodes) else 0
        self.feature, self.cut = nodes["feature"].to_numpy("int64").copy(), nodes["cut"].to_numpy("float64")
        self.category = nodes["category"].to_numpy(dtype=object)
        known = np.array([b in place for b in nodes["below"]], dtype=bool) if len(nodes) else np.zeros(0, bool)
        self.feature[~known] = -1
        self.below, self.above = (np.array([place.get(b, i) for i, b in enumerate(nodes[side])], dtype=np.int64) for side in ("below", "above"))
        total = (nodes["n0"] + nodes["n1"]).to_numpy("float64")
        self.chance = nodes["n1"].to_numpy("float64") / np.maximum(total, 1)

    def ends(self, numbers: list, kinds: list):
        import numpy as np

        at = np.full(len((numbers + kinds)[0]), self.root, dtype=np.int64)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            node = at[live]
            feature = self.feature[node]
            above = np.zeros(len(live), dtype=bool)
            for f in np.unique(feature):
                mine = feature == f
                if f < self.numbers:
                    values = numbers[f][live[mine]]
                    above[mine] = (values > self.cut[node[mine]]) | np.isnan(values) & ~np.isnan(self.cut[node[mine]])
                else:
                    above[mine] = kinds[f - self.numbers][live[mine]] == self.category[node[mine]]
            at[live] = np.where(above, self.above[node], self.below[node])
            live = live[self.feature[at[live]] >= 0]
        return at


def _subtree_scorer(columns: list[str], names: list[str], kinds: list[str]):
    """Rows sorted by (subtree, share, kind): the nodes of a subtree first, then its rows, which get their score."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        last, held, walker = None, [], None
        for batch in batches:
            frame = batch.to_pandas()
            place = list(zip(frame["_subtree"], frame["_share"], frame["_kind"]))
            cuts = [i for i in range(len(place)) if i == 0 or place[i] != place[i - 1]] + [len(place)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if place[s][:2] != last:
                    last, held, walker = place[s][:2], [], None
                if place[s][2] == 0:
                    held.append(pd.DataFrame(list(frame["_node"][s:e])))
                    continue
                if walker is None:
                    walker = _Walker(pd.concat(held, ignore_index=True), len(names))
                part = frame.iloc[s:e]
                at = walker.ends([part[c].to_numpy("float64") for c in names], [part[c].to_numpy(dtype=object) for c in kinds])
                slim = batch.slice(s, e - s).select(columns)
                yield pa.RecordBatch.from_arrays([*slim.columns, pa.array(np.asarray(walker.chance[at]))], names=[*columns, "_chance"])
    return run


@dataclass
class TreeModel:
    roles: Roles
    imputation: Imputation
    nodes: DataFrame
    points: DataFrame  # distinct training values, for the list of encoded names
    broadcast_nodes: int = BROADCAST_NODES

    def predict(self, frame: DataFrame) -> DataFrame:
        """Row id, date, actual, predicted, score (probability of class 1); columns beyond those are kept."""
        kept = [c for c in frame.columns if c not in self.roles.features and c != self.roles.target]
        scored = self.scored(self.imputation.apply(frame))
        return scored.select(*kept, F.col(self.roles.target).cast("int").alias("actual"), (F.col("_chance") > 0.5).cast("int").alias("predicted"), F.col("_chance").alias("score"))

    def scored(self, ready: DataFrame) -> DataFrame:
        """Imputed rows with ``_chance``."""
        names, kinds = list(self.roles.numeric), list(self.roles.categorical)
        inputs = [*[F.col(c).cast("double") for c in names], *[F.col(c) for c in kinds]]
        context = ready.sparkSession.sparkContext

        def pass_over(nodes: DataFrame, answer, kind):
            shared = context.broadcast(_Walker(nodes.toPandas(), len(names)))

            def walk(*columns):
                import pandas as pd

                walker = shared.value
                at = walker.ends([c.to_numpy("float64") for c in columns[: len(names)]], [c.to_numpy(dtype=object) for c in columns[len(names):]])
                return pd.Series(answer(walker)[at])

            return F.pandas_udf(walk, kind)(*inputs)

        if self.nodes.count() <= self.broadcast_nodes:
            return ready.withColumn("_chance", pass_over(self.nodes, lambda w: w.chance, T.DoubleType()))
        # the top is about two nodes for every PART points of the training set
        top = self.nodes.where("root is null or subtree")
        placed = stored(ready.withColumn("_subtree", pass_over(top, lambda w: w.names, T.StringType())), "placed")
        roots = self.nodes.where("subtree").select(F.col("node").alias("_subtree"))
        loads = placed.groupBy("_subtree").agg(F.count(F.lit(1)).alias("_rows")).select("_subtree", F.ceil(F.col("_rows") / SHARE_ROWS).cast("int").alias("_shares"))
        leaves = self.nodes.where("root is null").select(F.col("node").alias("_subtree"), (F.col("n1") / (F.col("n0") + F.col("n1"))).alias("_chance"))
        at_top = placed.join(leaves, "_subtree").drop("_subtree")
        spread = loads.join(roots, "_subtree")
        inside = placed.join(spread, "_subtree").withColumn("_share", F.floor(F.rand(1) * F.col("_shares")).cast("int")).drop("_shares")
        inside = inside.withColumns({c: F.col(c).cast("double") for c in names})
        parts = self.nodes.where("root is not null").select(F.col("root").alias("_subtree"), F.struct("node", "depth", "feature", "cut", "category", "below", "above", "n0", "n1").alias("_node"))
        parts = parts.join(spread, "_subtree").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
        both = inside.withColumn("_kind", F.lit(1)).unionByName(parts.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        order = ["_subtree", "_share", "_kind"]
        schema = T.StructType([*[T.StructField(f.name, T.DoubleType() if f.name in names else f.dataType) for f in ready.schema.fields], T.StructField("_chance", T.DoubleType())])
        found = both.repartition("_subtree", "_share").sortWithinPartitions(*order).mapInArrow(_subtree_scorer(ready.columns, names, kinds), schema)
        return found.unionByName(at_top.withColumns({c: F.col(c).cast("double") for c in names}))

    def shape(self) -> dict[str, int]:
        row = self.nodes.agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("nodes")).first()
        return {"depth": row["depth"], "nodes": row["nodes"]}

    def encoded_names(self) -> DataFrame:
        """(feature, category, name, origin) of every encoded column; the origin is carried, not guessed from the name."""
        numbers = len(self.roles.numeric)
        rows = [(i, None, c, c) for i, c in enumerate(self.roles.numeric)]
        names = self.nodes.sparkSession.createDataFrame(rows, "feature int, category string, name string, origin string")
        if self.roles.categorical:
            pairs = F.inline(F.array(*[F.struct(F.lit(numbers + i).alias("feature"), F.col(f"c{i}").alias("category"), F.lit(c).alias("origin"))
                                       for i, c in enumerate(self.roles.categorical)]))
            words = self.points.select(pairs).distinct()
            names = names.unionByName(words.select("feature", "category", F.concat("origin", F.lit("_"), "category").alias("name"), "origin"))
        return names

    def importances(self) -> DataFrame:
        """One row per encoded feature (as many as the training set has): its share of the tree's impurity decrease."""
        before = F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1"))
        after = _cost(F.col("b0"), F.col("b1"), F.col("n0") - F.col("b0"), F.col("n1") - F.col("b1"))
        gains = self.nodes.where("feature >= 0").groupBy("feature", "category").agg(F.sum(before - after).alias("gain"))
        names = self.encoded_names()
        gained = names.join(gains, (names["feature"] == gains["feature"]) & names["category"].eqNullSafe(gains["category"]), "left").select(
            F.col("name").alias("feature"), "origin", F.coalesce("gain", F.lit(0.0)).alias("gain"))
        whole = gains.agg(F.sum("gain").alias("whole"))  # one row
        return gained.join(F.broadcast(whole)).select("feature", "origin", F.coalesce(F.col("gain") / F.when(F.col("whole") > 0, F.col("whole")), F.lit(0.0)).alias("importance"))


def fit_tree(train: DataFrame, roles: Roles, max_depth: int | None = None, local: int = LOCAL) -> TreeModel:
    """Gini tree; everything is fitted on ``train`` only. Rows without a class are left out."""
    imputation = fit_imputation(train, roles)
    points = stored(_points(imputation.apply(train), roles), "points")
    return TreeModel(roles, imputation, grow_nodes(points, len(roles.numeric), len(roles.categorical), max_depth, local), points)


def top_importances(importances: DataFrame, size: int = 15) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(size)


def importance_by_column(importances: DataFrame) -> DataFrame:
    return importances.groupBy(F.col("origin").alias("feature")).agg(F.sum("importance").alias("importance"))


def ablation(train: DataFrame, test: DataFrame, variants: Mapping[str, Roles], max_depth: int | None = None) -> DataFrame:
    """The same split, one tree per feature set; one metric row each."""
    rows = []
    for name, roles in variants.items():
        counted = add_rates(confusion(fit_tree(train, roles, max_depth).predict(test)))
        rows.append(counted.select(F.lit(name).alias("variant"), F.lit(len(roles.features)).alias("features"), "*"))
    return union_all(rows)
