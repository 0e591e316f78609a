"""Hard negatives by segment summary filtering.

1. Components become whole numbers. Every vector is cut into segments of 16, 4 and 2 components; of each segment its mean and deviation
   are stored with the vector.
2. The product of two vectors over a segment of length l is l * (mean * mean) plus or minus l * (deviation * deviation) (Cauchy-Schwarz), so
   the summaries bound every score from both sides. Bounds are refined from the longest segments to the shortest, each time only over
   rows that some anchor at hand still needs.
3. After the last refinement the PROBE best estimates of each anchor are scored exactly; what they reach raises the lower limit once
   more. Only pairs whose bounds still meet the wanted range are scored exactly.
4. Anchors are a stated query set: all of them meet all rows, in blocks. A task holds one block of at most about BLOCK rows, chosen by a
   hash of the row, and streams the anchors through it, so neither a frequent label nor a frequent vector gathers anywhere. A block
   returns the best few rows per anchor (and positive); windows over those find the best of all blocks.
5. The positives of all blocks come first; their scores give the ranges in which a second pass looks for negatives.

Scores are exact whole numbers at any size of the components; those that no long can hold count as the nearest long.

Edge cases: rows with a null vec_id, label or vector, with a null or non-finite component, or with one that is no finite double when
multiplied by 256 take no part; vectors of different lengths don't meet; repeated rows and vec_ids are rows of their own (a copy of the
anchor may be its positive); an anchor without positives or a positive without negatives gives no row; an empty table gives none;
other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, table

LENGTHS = (16, 4, 2)  # components of a segment, coarse to fine
BLOCK, CHUNK = 1 << 15, 128  # rows that a task holds; anchors that it takes at a time
PROBE = 32
SLACK = 1e-6  # of the product of the norms: more than rounding can move a bound
POSITIVES, NEGATIVES = 5, 10
RANGE = (30, 90)  # percent of the positive's score
LARGEST = (1 << 63) - 1
ROW = "rid long, vec_id long, label long, d int, x array<double>, s array<double>"


def whole(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(256 * x)


def summaries(x: np.ndarray) -> np.ndarray:
    """Per row: means, then deviations of all segments, for every length."""
    out = []
    for length in LENGTHS:
        starts = np.arange(0, x.shape[1], length)
        sizes = np.diff(np.r_[starts, x.shape[1]])
        mean = np.add.reduceat(x, starts, axis=1) / sizes if len(starts) else np.zeros((len(x), 0))
        rest = x - np.repeat(mean, sizes, axis=1)
        out += [mean, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1) / sizes) if len(starts) else mean]
    return np.concatenate(out, axis=1)


def _lists(values: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel()))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        sizes = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten().cast(pa.float64()))
        at = np.cumsum(sizes) - sizes
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            x = whole(flat[at[rows][:, None] + np.arange(d)])
            rows, x = rows[np.isfinite(x).all(axis=1)], x[np.isfinite(x).all(axis=1)]
            if len(rows):
                same = [batch.column(c).take(pa.array(rows)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(rows), d, np.int32)), _lists(x), _lists(summaries(x))],
                                                 names=["rid", "vec_id", "label", "d", "x", "s"])


class Vectors:
    """Rows of one length: ids, labels, components, norms and summaries by segment length."""

    def __init__(self, rows: pa.Table):
        self.rid, self.vec_id, self.label = (rows[c].to_numpy() for c in ("rid", "vec_id", "label"))
        n, d = len(self.rid), int(rows["d"][0].as_py()) if len(rows) else 0
        self.x, s = (np.asarray(rows[c].combine_chunks().flatten()).reshape(n, -1) if n else np.zeros((0, 0)) for c in ("x", "s"))
        self.levels, at = [], 0
        for length in LENGTHS:
            sizes = np.diff(np.r_[np.arange(0, d, length), d]) if d else np.zeros(0)
            k = len(sizes)
            root = np.sqrt(sizes)  # of both sides, so that products carry the segment's length
            self.levels.append((s[:, at: at + k] * root, s[:, at + k: at + 2 * k] * root))
            at += 2 * k
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.x * self.x).sum(axis=1))

    def take(self, rows: np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        out.rid, out.vec_id, out.label, out.x, out.norm = self.rid[rows], self.vec_id[rows], self.label[rows], self.x[rows], self.norm[rows]
        out.levels = [(m[rows], s[rows]) for m, s in self.levels]
        return out


def exact(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j) as longs; doubles are exact up to 2**53, Python's whole numbers beyond."""
    out = np.empty(len(i), dtype=np.int64)
    small = a.norm[i] * b.norm[j] < 1 << 52
    for at in np.array_split(np.flatnonzero(small), max(1, math.ceil(len(i) / 65536))):
        out[at] = np.rint(np.einsum("ij,ij->i", a.x[i[at]], b.x[j[at]])).astype(np.int64)
    for at in np.flatnonzero(~small):
        score = sum(int(p) * int(q) for p, q in zip(a.x[i[at]], b.x[j[at]]))
        out[at] = max(-LARGEST - 1, min(LARGEST, score))
    return out


def search(a: Vectors, b: Vectors, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, score) out of ``wanted`` that hold all with a score in an anchor's range, less those that ``reach`` rules out.

    ``reach(i, score)`` says from exactly scored pairs which score an anchor's rows must reach at least.
    """
    columns, alive = np.arange(len(b.rid)), wanted
    for (mean, dev), (other_mean, other_dev) in zip(a.levels, b.levels):
        estimate = mean @ other_mean[columns].T
        slack = dev @ other_dev[columns].T + SLACK * a.norm[:, None] * b.norm[columns]
        odd = ~np.isfinite(estimate + slack)  # products beyond a double tell nothing
        alive = alive & (odd | ((estimate + slack >= low[:, None]) & (estimate - slack <= high[:, None])))
        needed = alive.any(axis=0)
        columns, alive, estimate, slack, odd = columns[needed], alive[:, needed], estimate[:, needed], slack[:, needed], odd[:, needed]
    if len(columns) > 2 * PROBE and a.levels:
        best = np.argpartition(np.where(alive, np.nan_to_num(-estimate, nan=0.0), np.inf), PROBE, axis=1)[:, :PROBE]
        i = np.repeat(np.arange(len(a.rid)), PROBE)
        seen = alive[i, best.ravel()]
        i, j = i[seen], best.ravel()[seen]
        low = np.maximum(low, reach(i, exact(a, b, i, columns[j])))
        alive = alive & (odd | (estimate + slack >= low[:, None]))
    i, j = np.nonzero(alive)
    return i, columns[j], exact(a, b, i, columns[j])


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` of every group by score, then id."""
    order = np.lexsort((ids, -score, group))
    new = np.r_[True, group[order][1:] != group[order][:-1]] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[rank < count]


def nth(group: np.ndarray, score: np.ndarray, count: int, groups: int) -> np.ndarray:
    """The ``count``-th best score of every group, minus infinity if it has fewer."""
    out = np.full(groups, -np.inf)
    order = np.lexsort((-score, group))
    starts = np.searchsorted(group[order], np.arange(groups))
    has = np.searchsorted(group[order], np.arange(groups), side="right") - starts >= count
    out[has] = score[order][starts[has] + count - 1]
    return out


def limits(positive: np.ndarray, percent: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores n with percent[0] * p <= 100 * n <= percent[1] * p, as a range (empty where it ends before it starts)."""
    p = positive.astype(object)
    return np.array([-(-percent[0] * v // 100) for v in p], dtype=object), np.array([percent[1] * v // 100 for v in p], dtype=object)


def best_positives(a: Vectors, b: Vectors, count: int) -> tuple[np.ndarray, ...]:
    """(anchor, row, score): the first ``count`` rows of the anchor's own label in this block."""
    found = []
    for label in np.unique(a.label):
        i, j = np.flatnonzero(a.label == label), np.flatnonzero(b.label == label)
        if not len(j):
            continue
        x, y = a.take(i), b.take(j)
        other = x.rid[:, None] != y.rid
        p, q, score = search(x, y, other, np.full(len(i), -np.inf), np.full(len(i), np.inf), lambda g, s: nth(g, s, count, len(i)))
        top = first(p, score, y.vec_id[q], count)
        found.append((i[p[top]], j[q[top]], score[top]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def best_negatives(a: Vectors, b: Vectors, positives: list[np.ndarray], count: int, percent: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """(anchor, place of the positive, row, score): for each positive the first ``count`` rows of other labels in its range."""
    most = max((len(p) for p in positives), default=0)
    lows, highs = [], []
    for k in range(most):
        ends = [limits(p[k: k + 1], percent) if len(p) > k else ([LARGEST], [-LARGEST]) for p in positives]
        lows.append(np.array([e[0][0] for e in ends], dtype=object))
        highs.append(np.array([e[1][0] for e in ends], dtype=object))
    if not most:
        return (np.zeros(0, np.int64),) * 4

    def inside(k: int, i: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.array((score.astype(object) >= lows[k][i]) & (score.astype(object) <= highs[k][i]), dtype=bool)

    def reach(i: np.ndarray, score: np.ndarray) -> np.ndarray:
        out = np.full(len(positives), np.inf)
        for k in range(most):
            hit = inside(k, i, score)
            out = np.minimum(out, np.maximum(lows[k].astype(float), nth(i[hit], score[hit].astype(float), count, len(positives))))
        return out

    low, high = np.min([v.astype(float) for v in lows], axis=0), np.max([v.astype(float) for v in highs], axis=0)
    i, j, score = search(a, b, a.label[:, None] != b.label, low, high, reach)
    found = []
    for k in range(most):
        hit = np.flatnonzero(inside(k, i, score))
        hit = hit[first(i[hit], score[hit], b.vec_id[j[hit]], count)]
        found.append((i[hit], np.full(len(hit), k, np.int64), j[hit], score[hit]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _blocks(judge):
    """Rows sorted by (block, d, kind): the rows of a block are held, its anchors stream through ``judge(anchors, rows)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, rows = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(batch.column(c)) for c in range(3)])
            cuts = np.r_[0, np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:]):
                place, kind, part = tuple(marks[:2, s]), marks[2, s], batch.slice(s, e - s)
                if place != last:
                    last, held, rows = place, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if held:
                    rows, held = Vectors(pa.Table.from_batches(held)), []
                if rows is None:
                    continue
                for at in range(0, part.num_rows, CHUNK):
                    some = pa.Table.from_batches([part.slice(at, CHUNK)])
                    out = judge(Vectors(some), rows, some)
                    if len(next(iter(out.values()))):
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))
    return run


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, judge, schema: str) -> DataFrame:
    """Every block of rows with all anchors."""
    held = rows.withColumns({"block": F.pmod(F.xxhash64("rid"), F.lit(blocks)), "kind": F.lit(0), "p": F.lit(None).cast("array<long>")})
    sent = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")), "kind": F.lit(1)})
    order = ["block", "d", "kind"]
    columns = [*order, "rid", "vec_id", "label", "x", "s", "p"]
    both = held.select(columns).unionByName(sent.select(columns)).withColumns({"d": F.col("d").cast("long"), "kind": F.col("kind").cast("long")})
    return both.repartition("block", "d").sortWithinPartitions(*order).mapInArrow(_blocks(judge), schema)


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: tuple[int, int] = RANGE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over (vec_id, label, embedding)."""
    fit = F.coalesce(F.expr("vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"), F.lit(False))
    given = vectors.where(fit).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = keep(given.mapInArrow(_summarise, ROW), "vectors")
    n = rows.count()
    blocks = max(math.ceil(n / BLOCK), min(64, math.ceil(n / 4096)), 1)
    anchors = rows.where(is_anchor)

    def positive(a: Vectors, b: Vectors, some: pa.Table) -> dict:
        i, j, score = best_positives(a, b, positives)
        return {"rid": a.rid[i], "positive_id": b.vec_id[j], "positive_score": score}

    def negative(a: Vectors, b: Vectors, some: pa.Table) -> dict:
        scores = [np.array(p, dtype=np.int64) for p in some["p"].to_pylist()]
        i, k, j, score = best_negatives(a, b, scores, negatives, percent)
        return {"rid": a.rid[i], "place": k.astype(np.int32), "negative_id": b.vec_id[j], "negative_score": score}

    found = _meet(rows, anchors.withColumn("p", F.lit(None).cast("array<long>")), blocks, positive, "rid long, positive_id long, positive_score long")
    near = Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id")
    chosen = keep(found.withColumn("place", F.row_number().over(near) - 1).where(F.col("place") < positives), "positives")
    scores = chosen.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda r: r["positive_score"]).alias("p"))  # a few each
    asked = anchors.join(scores, "rid")
    far = _meet(rows, asked, blocks, negative, "rid long, place int, negative_id long, negative_score long")
    hard = Window.partitionBy("rid", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(hard)).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["rid", "place"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def turned(vectors: DataFrame) -> DataFrame:
    """Every seventh vec_id gets the next label of ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(turned(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


ORACLE = f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same QUALIFY place <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.rid, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.rid = p.rid AND NOT same AND {RANGE[0]} * positive_score <= 100 * score AND 100 * score <= {RANGE[1]} * positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}"""
