"""Near-duplicate embeddings from randomised-rotation binary codes with correction factors.

1. Equal vectors form one class with a weight; unusable vectors (null, zero, null or non-finite components) stay outside.
2. A vector is normalised and turned by seeded random rotations. The signs are its binary code; the correction factor is the inner
   product of the turned vector with its own code vector.
3. Index: the code bits are cut into bands; vectors that agree in all bits of a band meet in a bucket. Bits per band follow the number of
   vectors, and the number of bands follows from the wanted recall at the threshold, so recall is the same at every size.
   Every vector is indexed; nothing is fitted.
4. Large buckets are dealt as pairs of blocks of about BLOCK vectors, so no task holds a whole bucket. A pair is judged only in the first
   band in which both agree.
5. Inside a block pair the code of one vector and the other vector give an unbiased estimate of their inner product, with a bound of
   about EPSILON standard errors. Only pairs whose upper bound reaches the threshold are recomputed exactly in double precision.
6. A block pair returns link counts per vector and a spanning tree of what it linked, never all pairs.

Edge cases: vectors of different lengths are never linked; repeated vec_ids are returned once per row; a null vec_id links nothing; an
empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import components, keep, runs, spanning, table

RECALL = 0.97
BLOCK = 512
EPSILON = 4.5
SEED = 7


def bands(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits per band and number of bands for n vectors: about 64 random vectors share a bucket."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(6, math.ceil(math.log2(max(n, 2) / 64)))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same ** bits))


def rotation(d: int, index: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, index]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _encode(bits: int, count: int):
    """Arrow rows of a class -> per row: id, weight, first rotation of the vector, correction factor, bucket of every band."""
    turns: dict[int, list[np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten().cast(pa.float64()))
            at = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                if d not in turns:
                    turns[d] = [rotation(int(d), i) for i in range(math.ceil(bits * count / d))]
                v = flat[at[rows][:, None] + np.arange(d)]
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                turned = [v @ t for t in turns[d]]
                signs = np.concatenate([t > 0 for t in turned], axis=1)[:, : bits * count].reshape(len(rows), count, bits)
                keys = (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
                keys = keys * 8191 + d  # lengths never meet
                factor = np.abs(turned[0]).sum(axis=1) / math.sqrt(d)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * int(d)), pa.array(turned[0].ravel())), pa.array(factor),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * count), pa.array(keys.ravel()))],
                    names=["id", "w", "x", "f", "keys"])
    return run


def _judge(threshold: float):
    """Arrow rows sorted by block pair (band, key, i, j) -> (id, partner in a spanning tree, weight of its links)."""
    columns = ["band", "key", "i", "j", "block", "id", "w", "x", "f", "keys"]

    def group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        band, i, j = rows["band"][0].as_py(), rows["i"][0].as_py(), rows["j"][0].as_py()
        ids, weight, factor, block = (rows[c].to_numpy() for c in ("id", "w", "f", "block"))
        x = np.asarray(rows["x"].combine_chunks().flatten()).reshape(len(ids), -1)
        keys = np.asarray(rows["keys"].combine_chunks().flatten()).reshape(len(ids), -1)
        left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j))
        d = x.shape[1]
        code = np.where(x[left] > 0, 1.0, -1.0).astype(np.float32)
        estimate = code @ x[right].T.astype(np.float32) / (math.sqrt(d) * factor[left, None])
        slack = EPSILON * np.sqrt(np.maximum(1 - factor[left] ** 2, 0)) / factor[left] / math.sqrt(max(d - 1, 1))
        near = estimate + slack[:, None] >= threshold if d > 8 else np.ones(estimate.shape, dtype=bool)
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        for start in range(band):  # judged in an earlier band
            fresh = keys[a, start] != keys[b, start]
            a, b = a[fresh], b[fresh]
        linked = np.concatenate([np.einsum("ij,ij->i", x[a[s: s + 65536]], x[b[s: s + 65536]]) >= threshold for s in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[linked], b[linked]
        total = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        root = spanning(a, b, len(ids))
        found = np.flatnonzero(total)
        return ids[found], ids[root[found]], total[found].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 4):
            out = group(rows)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=["a", "b", "links"])

    return columns, run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    good = F.col("embedding").isNotNull() & F.coalesce(F.expr(
        "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("embedding", F.when(good, F.col("embedding")))
    classes = keep(rows.where("embedding is not null and vec_id is not null").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w")), "classes")
    bits, count = bands(classes.count(), threshold, recall)
    coded = keep(classes.select("id", "w", "embedding").mapInArrow(_encode(bits, count), "id long, w long, x array<double>, f double, keys array<long>"), "codes")
    buckets = coded.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    placed = coded.select("*", F.posexplode("keys").alias("band", "key")).join(buckets, ["band", "key"])
    placed = placed.withColumn("blocks", F.ceil(F.col("c") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    columns, run = _judge(threshold)
    placed = placed.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "w", "x", "f", "keys")
    where = ["band", "key", "i", "j"]
    judged = placed.select(columns).repartition(*where).sortWithinPartitions(*where).mapInArrow(run, "a long, b long, links long")
    judged = keep(judged.groupBy("a", "b").agg(F.sum("links").alias("links")), "judged")
    links = judged.groupBy("a").agg(F.sum("links").alias("links"))
    names = components(judged.select("a", "b"))
    named = keep(classes.join(links, classes["id"] == links["a"], "left").join(names, classes["id"] == names["node"], "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")).where("n_links > 0"), "named")
    out = rows.alias("r").join(named.alias("n"), (F.col("r.embedding") == F.col("n.embedding")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (component.isNull() | F.coalesce(F.col("vec_id") == component, F.lit(False))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
