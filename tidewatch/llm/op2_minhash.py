"""Near-duplicate documents from bottom-k MinHash sketches of one hash function.

1. A document's set holds the 64-bit hashes of its distinct word shingles; its sketch holds the k smallest.
2. Documents with equal sets form one class; only one sketch and one row per class go on, so groups of exact copies cost nothing.
3. Inverted lists of retained values: similar classes share many of them, so of every sketch only the rarest values are listed that any
   partner must meet at least once (a prefix filter). Values of one class alone are in no list.
4. In every list the member with the most shared values is the pivot. All members are compared with their pivots: the union sketch
   estimates the similarity, and what could reach the threshold is confirmed on full sets.
5. Members of a pivot's group that are still in different components may be similar to each other without being similar to the pivot.
   Such a group is dealt as pairs of blocks of about BLOCK classes; inside a block pair sketches filter and full sets decide, and only a
   spanning tree of the found links is returned. So no group is capped, none is in one task, and no pair of a group becomes a row.
6. Connected components over confirmed links; the smallest doc_id of a component names it.

A sketch of k = 48 values misses a pair only if fewer than t*k - 6 standard deviations of the union's smallest values are shared, about
one pair in ten million at the threshold. Sets of up to t*k shingles are whole sketches: nothing is missed there.

Edge cases: a null or blank text has an empty set and links with nothing; texts shorter than a shingle count as one shingle; repeated
rows are each returned; a null doc_id is never the smallest id, and alone it has a null component and ``kept`` true; an empty table gives
an empty table; other columns pass through (``near_duplicates`` returns the key columns only).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import components, keep, mix, pieces, runs, shingles, spanning, table, word_hashes

K = 48
BLOCK = 256


def least_shared(n: int, percent: int, k: int) -> int:
    """Sketch values that a set of n shingles has in common with any partner at the threshold."""
    t = percent / 100
    if n <= math.floor(t * k):
        return math.ceil(t * n - 1e-9)  # the partner's sketch is its whole set too
    m = min(n, k)
    return max(1, math.floor(t * m - 6 * math.sqrt(m * t * (1 - t))))


def _sets(words: int, k: int, whole: bool):
    """Arrow rows: doc_id, set size, two digests of the set, and the sketch or the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            hashes, _, _, first = word_hashes(data, offsets)
            values, before = shingles(hashes, first, words)
            sizes, one, two, parts = [], [], [], []
            for i in range(rows.num_rows):
                own = np.unique(values[before[i]: before[i + 1]])
                sizes.append(len(own))
                one.append(int(mix(own).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                # flipped top bit: signed order equals the order of the hashes
                parts.append((own if whole else own[:k]) ^ np.uint64(1 << 63))
            flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n", "d1", "d2", "v"])
    return run


SET_SCHEMA = "doc_id long, n long, d1 long, d2 long, v array<long>"


def sketched(docs: DataFrame, words: int, k: int = K, whole: bool = False) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sets(words, k, whole), SET_SCHEMA)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = keep(sketched(text, words, k), "sketches")
    classes = keep(rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("v").alias("v")), "classes")
    t = percent / 100
    # |A| n of n + 1 shingles is the most that two different sets share
    smallest = math.ceil(t / (1 - t) - 1e-9)
    needed = F.lit(least_shared(10 * k, percent, k))
    floor_n = math.floor(t * k)
    needed = F.when(F.col("n") <= floor_n, F.ceil(F.col("n") * percent / 100)).when(
        F.col("n") < k, F.element_at(F.array(*[F.lit(least_shared(i, percent, k)) for i in range(1, k)]), F.col("n").cast("int"))).otherwise(needed)
    entries = classes.where(F.col("n") >= smallest).select("d1", "n", needed.cast("int").alias("m"), F.explode("v").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    listed = entries.join(shared, "value").groupBy("d1", "n", "m").agg(F.collect_list(F.struct("c", "value")).alias("x"))
    listed = listed.withColumn("s", F.size("x")).where("s >= m").withColumn("x", F.expr("slice(array_sort(x), 1, greatest(s - m + 1, 0))"))
    listed = keep(listed.select("d1", "s", F.explode(F.col("x.value")).alias("value")), "lists")
    pivots = listed.groupBy("value").agg(F.max(F.struct("s", "d1")).alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = keep(listed.join(pivots, "value").select(F.col("top.d1").alias("g"), "d1").distinct(), "groups")
    if groups.isEmpty():
        labels = None
    else:
        sets = _full_sets(text, classes, groups.select("d1").distinct(), words, k)
        links = _confirm(groups.where("g <> d1"), sets, percent, k)
        labels = keep(components(links), "labels")
        links = links.unionByName(_within_groups(groups, labels, sets, percent, k))
        labels = keep(components(links), "labels")
    if labels is None:
        named = classes.select("d1", "d2", "n", F.col("rep").alias("component_id"))
    else:
        with_label = keep(classes.join(labels, classes["d1"] == labels["node"], "left").select("d1", "d2", "n", "rep", F.coalesce("component", "d1").alias("component")), "named")
        smallest_id = with_label.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = with_label.join(smallest_id, "component").select("d1", "d2", "n", "component_id")
    # one class per document is the rule: only classes of several documents or with links need a look-up
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").alias("r").join(
        named.alias("c"), (F.col("r.d1") == F.col("c.d1")) & (F.col("r.d2") == F.col("c.d2")) & (F.col("n_shingles") == F.col("c.n")), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"))


def _full_sets(text: DataFrame, classes: DataFrame, ids: DataFrame, words: int, k: int) -> DataFrame:
    """(d1, n, v): the whole sets of the given classes, made again from one text of each."""
    chosen = classes.join(ids, "d1").select("rep").distinct()
    sets = sketched(text.join(chosen, text["doc_id"].eqNullSafe(chosen["rep"]), "left_semi"), words, k, whole=True)
    return keep(sets.join(ids, "d1", "left_semi").groupBy("d1").agg(F.first("n").alias("n"), F.first("v").alias("v")), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b) of the pairs (g, d1) whose full sets reach the threshold; the union sketch is looked at first."""
    t = percent / 100
    both = pairs.join(sets.toDF("d1", "nb", "sb"), "d1").where("nb > 0").join(sets.toDF("g", "na", "sa"), "g")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    both = both.withColumn("u", F.expr(f"slice(array_sort(array_union(slice(sa, 1, {k}), slice(sb, 1, {k}))), 1, {k})"))
    estimate = F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) / F.size("u")
    likely = both.where(estimate >= t - 6 * F.sqrt(F.lit(t * (1 - t)) / F.size("u"))).withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return keep(likely.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select(F.col("g").alias("a"), F.col("d1").alias("b")), "links")


def _within_groups(groups: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b): a spanning tree of the links between different components inside each group."""
    member = groups.join(labels, groups["d1"] == labels["node"], "left").select("g", "d1", F.coalesce("component", "d1").alias("component"))
    member = keep(member, "members")
    mixed = member.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("g", "c")
    # the pivot itself has been compared with everyone
    blocks = member.where("g <> d1").join(mixed.where("c > 2"), "g").withColumn("blocks", F.ceil(F.col("c") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("d1"), F.col("blocks")))
    blocks = blocks.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    placed = blocks.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "d1", "component")
    where = ["g", "i", "j"]
    ready = placed.join(sets, "d1").select("g", "i", "j", "block", "d1", "component", "n", "v").repartition(*where).sortWithinPartitions(*where)
    return keep(ready.mapInArrow(_judge(percent, k), "a long, b long"), "links")


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets in ``rows`` with all in ``columns``, by products of 0/1 matrices over slices of the shared values."""
    flat = np.concatenate([*rows, *columns])
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(x) for x in (*rows, *columns)])
    values, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep_ = count[code] > 1
    code, owner = shared[code[keep_]], owner[keep_]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    width = 8192
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        s, e = np.searchsorted(code, [at, at + width])
        part = np.zeros((len(rows) + len(columns), width), dtype=np.float32)
        part[owner[s:e], code[s:e] - at] = 1
        out += part[: len(rows)] @ part[len(rows):].T
    return out


def _judge(percent: int, k: int):
    t = percent / 100

    def group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        block, ids, component, n = (rows[c].to_numpy() for c in ("block", "d1", "component", "n"))
        values = rows["v"].combine_chunks()
        ends, flat = np.asarray(values.offsets), np.asarray(values.flatten())
        sets = [flat[s:e] for s, e in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (component[left][:, None] != component[right]) & (100 * np.minimum(n[left][:, None], n[right]) >= percent * np.maximum(n[left][:, None], n[right]))
        if i == j:
            near = np.triu(near, 1)
        if near.any():
            # shared values among both sketches are at most those of the union sketch in both
            m = np.minimum(k, np.minimum(n[left][:, None], n[right]))
            near &= overlaps([sets[x][:k] for x in left], [sets[x][:k] for x in right]) >= t * m - 6 * np.sqrt(m * t * (1 - t))
        a, b = np.nonzero(near)
        if not len(a):
            return ids[:0], ids[:0]
        rows_in, columns_in = np.unique(a), np.unique(b)
        exact = overlaps([sets[x] for x in left[rows_in]], [sets[x] for x in right[columns_in]])[np.searchsorted(rows_in, a), np.searchsorted(columns_in, b)].astype(np.int64)
        a, b = left[a], right[b]
        linked = exact * 100 >= (n[a] + n[b] - exact) * percent
        root = spanning(a[linked], b[linked], len(ids))
        found = np.flatnonzero(root != np.arange(len(ids)))
        return ids[found], ids[root[found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            a, b = group(rows)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
