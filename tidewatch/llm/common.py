"""What the operators share: word hashing over Arrow text columns, stored intermediate tables, connected components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import scratch_path

PIECE = 1 << 19  # bytes of text that one numpy pass holds; longer texts go alone
BATCH_ROWS = 1024  # rows of text in an Arrow batch; the default of 10,000 long texts fills the memory beside the heap
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most BATCH_ROWS rows, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(fields, added: str) -> T.StructType:
    """The given fields and those of a schema text: what a pass over Arrow batches returns."""
    return T.StructType([*fields, *T.StructType.fromDDL(added).fields])


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, and nothing above is computed twice."""
    spark = frame.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop(frame: DataFrame) -> None:
    """Remove the files of a table that ``keep`` wrote and nothing reads any more."""
    spark = frame.sparkSession
    for file in frame.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(modulus: int, column: str = "doc_id"):
    """Remainder 0 of crc32 over the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == 0


def crc_rest(value: object, modulus: int) -> int:
    return zlib.crc32(str(value).encode() if value is not None else b"") % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 .. n, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        made = []
        for base in (BASE, INVERSE):
            p = np.full(n + 1, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * PIECE:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s], scaled by INVERSE**s, hashing data[s:e]."""
    up, _ = powers(max(len(data), PIECE))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(max(len(prefix), PIECE))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0]: offsets[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about PIECE bytes of text, as (rows, bytes, offsets)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per row the number of words before it (rows + 1 values)."""
    word = ~SPACE[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end of every lower-cased word, and words before each row."""
    starts, ends, first = word_spans(data, offsets)
    return span_hash(prefix_hash(LOWER[data]), starts, ends), starts, ends, first


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs in row order, and how many lie before each row; a row with 1 .. n - 1 words gives one of all."""
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(counts)), made)
    start = first[:-1][row] + (np.arange(before[-1]) - before[:-1][row])
    last = first[1:][row]
    out = np.zeros(len(start), dtype=np.uint64)
    for j in range(n):
        inside = start + j < last
        step = mix(out + hashes[np.minimum(start + j, len(hashes) - 1)] * np.uint64(0xA0761D6478BD642F) + np.uint64(j + 1)) if len(hashes) else out
        out = np.where(inside, step, out)
    return out, before


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` columns (integers), one table per run of equal keys; only one run is held at a time."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([np.asarray(batch.column(c)) for c in range(keys)])
        cuts = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for s, e in zip(cuts[:-1], cuts[1:]):
            mark = tuple(marks[:, s])
            if waiting and mark != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            last = mark
            waiting.append(batch.slice(s, e - s))
    if waiting:
        yield pa.Table.from_batches(waiting)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return root


FILTER_BITS = 25


def maybe_in(frame: DataFrame, members: DataFrame, keys: list[str], flag: str = "_maybe") -> DataFrame:
    """Column ``flag``: false only for rows whose keys are surely not in ``members``.

    A Bloom filter with one hash, 16 bits per member and at most 2**FILTER_BITS bits: a table of at most 2**(FILTER_BITS - 6) words, so the
    broadcast has a fixed bound whatever the data. It saves shuffling rows that a join on ``keys`` would drop; the join itself stays exact.
    """
    bits = max(12, min(FILTER_BITS, (16 * max(1, members.count())).bit_length()))
    place = F.xxhash64(F.lit(3), *keys).bitwiseAND((1 << bits) - 1)
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = members.select(place.alias("_place")).select(F.shiftright("_place", 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = frame.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.withColumn(flag, hit).drop("_word", "_place", "_bits")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b); nodes without an edge are absent.

    Alternating large-star and small-star rounds, each stored in the shared folder, until no edge changes.
    """
    current = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = keep(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        done = small.count() == current.count() and small.join(current, ["a", "b"], "left_anti").isEmpty()
        drop(current)
        drop(large)
        current = small
        if done:
            break
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
