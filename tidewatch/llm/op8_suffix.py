"""Removal of byte strings that repeat anywhere in a corpus, found by merging Burrows-Wheeler transforms.

A string of SPAN bytes is repeated if it starts at two places, in one document or two. Every byte inside a repeated string goes.

1. Routing. Each window of SPAN bytes is led by its anchor: of the KMER-byte strings inside it the one with the smallest hash, the first of
   equals. Equal windows have equal anchors, so they can be compared anchor by anchor. Neighbouring windows share anchors: a document gives
   about one segment (a run of windows with one anchor) per 85 bytes, and only hashes and positions of segments are shuffled.
2. Equal segments are counted. Segments that occur twice are repeated as a whole. Anchors with one segment have no other match.
3. For all other anchors the texts of the distinct segments are brought together by anchor. A task cuts them into shards, sorts each
   shard's suffixes once, keeps its Burrows-Wheeler transform (BWT), and merges transforms pairwise by interleave refinement: the
   interleave of two suffix orders by h symbols gives that by h + 1 symbols by dealing the BWT symbols in order. Positions where a block
   first splits give the common prefixes; blocks that are still whole at depth SPAN are the repeated intervals. Suffixes are never
   sorted again. A symbol is a string of STEP bytes (its hash), the symbol after position i starts at i + STEP: SPAN / STEP rounds suffice.
4. An anchor with more than WIDE distinct segments (a passage inside very many documents) would not fit one task. Its windows are
   counted one by one with a map-side combine instead; nothing is dropped.
5. The ranges are united per document and cut out.

Strings are compared by 64-bit hashes. Edge cases: null text is empty; texts under SPAN bytes lose nothing; equal rows (same id and text) are copies of
each other and each is returned; null ids are kept apart by text; an empty table gives an empty table; other columns pass through
``remove_repeats``. Where a cut splits a character in ``text``, its left-over bytes go too; the digest columns count exact bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import flat, keep, maybe_in, pieces, prefix_hash, span_hash, table, with_fields

SPAN, KMER, STEP = 200, 32, 40
WIDE = 2048
SHARD = 1 << 17  # bytes of a shard
SET = 1 << 20  # bytes of segments merged at a time, cut between anchors only
CHUNK = 1 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, anchor, first and last window start (positions in ``data``)."""
    width = SPAN - KMER + 1
    starts = np.arange(len(data) - KMER + 1)
    hashes = span_hash(prefix, starts, starts + KMER)
    led = []
    windows = len(data) - SPAN + 1
    for c in range(0, windows, CHUNK):
        n = min(CHUNK, windows - c)
        low = (hashes[c: c + n + width - 1] & np.uint64(~((1 << 24) - 1) & (2**64 - 1))) | np.arange(n + width - 1, dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[width - size: width - size + n])
        led.append((low & np.uint64((1 << 24) - 1)).astype(np.int64) + c)
    anchor = np.concatenate(led)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    at = np.flatnonzero(np.arange(windows) + SPAN <= offsets[1:][row])
    anchor, row = anchor[at], row[at]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return row[first], anchor[first], at[first], at[last], hashes[anchor[first]]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) -> one row per segment: anchor, segment hash, document key, first byte, windows."""
    for rows, data, offsets in pieces(batches):
        if len(data) < SPAN:
            continue
        prefix = prefix_hash(data)
        row, anchor, lo, hi, kmer = anchors(data, offsets, prefix)
        if not len(row):
            continue
        seg = span_hash(prefix, lo, hi + SPAN) ^ ((anchor - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        k1, k2 = np.asarray(rows.column(0)), np.asarray(rows.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(kmer.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(k1[row]), pa.array(k2[row]),
                                          pa.array(lo - offsets[row]), pa.array((hi - lo + 1).astype(np.int32))], names=["kmer", "seg", "k1", "k2", "lo", "n"])


def _cut(windows: bool):
    """(text, wanted segments of the document) -> the segments' bytes, or the hashes of their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, k1, k2 = batch.column(3), np.asarray(batch.column(0)), np.asarray(batch.column(1))
            want, ends = lists.flatten(), np.asarray(lists.offsets)
            kmer, lo, n, c = (np.asarray(want.field(i)) for i in range(4))
            data, offsets = flat(batch.column(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            start = offsets[row] + lo
            for s in range(0, len(row), 8192):
                part = slice(s, s + 8192)
                if windows:
                    each = np.repeat(np.arange(len(row))[part], n[part])
                    place = np.arange(len(each)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                    low = int(start[part].min())
                    prefix = prefix_hash(data[low: int((start + n)[part].max()) + SPAN - 1])
                    begin = start[each] - low + place
                    yield pa.RecordBatch.from_arrays([pa.array(span_hash(prefix, begin, begin + SPAN).view(np.int64)), pa.array(k1[row[each]]), pa.array(k2[row[each]]),
                                                      pa.array(lo[each] + place), pa.array(c[each])], names=["hash", "k1", "k2", "at", "c"])
                else:
                    texts = [data[a: a + m + SPAN - 1].tobytes() for a, m in zip(start[part], n[part])]
                    yield pa.RecordBatch.from_arrays([pa.array(kmer[part]), pa.array(k1[row[part]]), pa.array(k2[row[part]]), pa.array(lo[part]), pa.array(c[part]), pa.array(texts, pa.binary())],
                                                     names=["kmer", "k1", "k2", "lo", "c", "text"])
    return run


class Index:
    """Suffixes of a shard in the order of their first SPAN bytes, with the BWT.

    Row: ``place`` (position in the set's bytes, -1 for an empty suffix) and ``bwt`` (rank of the symbol before it, 0 at a start).
    """

    def __init__(self, place: np.ndarray, bwt: np.ndarray):
        self.place, self.bwt = place, bwt


def _build(symbol: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Index:
    """Sort one shard: ``symbol[i]`` is the rank (from 1) of the STEP bytes at i; segments are [start, end) of the set's bytes."""
    depth = SPAN // STEP
    length = ends - starts
    place = np.concatenate([np.arange(a, b - STEP + 1) for a, b in zip(starts, ends)])
    last = np.repeat(ends - STEP, np.maximum(length - STEP + 1, 0))
    keys = [np.where(place + j * STEP <= last, symbol[np.minimum(place + j * STEP, len(symbol) - 1)], 0) for j in range(depth)]
    order = np.lexsort(keys[::-1])
    first = np.repeat(starts, np.maximum(length - STEP + 1, 0))
    before = np.where(place - STEP >= first, symbol[np.maximum(place - STEP, 0)], 0)
    # empty suffixes come first: one per string, that is per segment and start modulo STEP; the symbol before is the string's last
    tail = np.concatenate([np.arange(max(a, b - 2 * STEP + 1), b - STEP + 1) for a, b in zip(starts, ends)])
    return Index(np.concatenate([np.full(len(tail), -1), place[order]]), np.concatenate([symbol[tail], before[order]]))


def merge(a: Index, b: Index) -> tuple[Index, np.ndarray]:
    """Interleave refinement. Returns the merged index and, per row, the number of symbols that it shares with the row before (at most depth)."""
    depth = SPAN // STEP
    n = len(a.bwt) + len(b.bwt)
    of_b = np.zeros(n, dtype=bool)
    of_b[len(a.bwt):] = True
    block = np.zeros(n, dtype=np.int64)
    common = np.full(n, depth, dtype=np.int8)
    common[0] = 0
    dealt = np.empty(n, dtype=np.int64)
    for h in range(depth):
        dealt[~of_b], dealt[of_b] = a.bwt, b.bwt
        order = np.argsort(dealt, kind="stable")
        dealt, of_b, block = dealt[order], of_b[order], block[order]
        split = np.zeros(n, dtype=bool)
        split[1:] = (dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1])
        common[split & (common == depth)] = h
        block = np.cumsum(split)
        dealt = np.empty(n, dtype=np.int64)
    place, bwt = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    place[~of_b], place[of_b], bwt[~of_b], bwt[of_b] = a.place, b.place, a.bwt, b.bwt
    return Index(place, bwt), common


def repeated_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of windows that occur at least twice among the segments [0, ends[0]), [ends[0], ends[1]) ...

    Shards take segments in turn, so the segments of one anchor meet in the merges.
    """
    starts = np.concatenate([[0], ends[:-1]])
    prefix = prefix_hash(data)
    at = np.arange(len(data) - STEP + 1)
    _, symbol = np.unique(span_hash(prefix, at, at + STEP), return_inverse=True)
    symbol = symbol.astype(np.int64) + 1
    shards = max(2, -(-len(data) // SHARD))
    indexes = [_build(symbol, starts[i::shards], ends[i::shards]) for i in range(min(shards, len(starts)))]
    common = None
    while len(indexes) > 1:
        merged = [merge(indexes[i], indexes[i + 1]) for i in range(0, len(indexes) - 1, 2)]
        common = merged[-1][1]
        indexes = [m[0] for m in merged] + indexes[len(indexes) - len(indexes) % 2:]
    if common is None:
        return np.zeros(0, dtype=np.int64)
    place = indexes[0].place
    if len(common) != len(place):
        raise ValueError("the last merge must cover all rows")
    same = np.zeros(len(place) + 1, dtype=bool)
    same[:-1] = common == SPAN // STEP
    inside = same[:-1] | same[1:]
    segment_end = ends[np.searchsorted(ends, np.maximum(place, 0), side="right")]
    return place[inside & (place >= 0) & (place + SPAN <= segment_end)]


def _merge_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor -> (k1, k2, start, end) of repeated ranges in segments that occur once."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def solve() -> pa.RecordBatch:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        data, offsets = flat(rows["text"])
        k1, k2, lo, once = rows["k1"].to_numpy(), rows["k2"].to_numpy(), rows["lo"].to_numpy(), rows["c"].to_numpy() == 1
        hits = np.sort(repeated_starts(data, offsets[1:]))
        row = np.searchsorted(offsets, hits, side="right") - 1
        hits, row = hits[once[row]], row[once[row]]
        fresh = np.ones(len(hits), dtype=bool)
        fresh[1:] = (hits[1:] != hits[:-1] + 1) | (row[1:] != row[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(hits)) - 1 if len(hits) else first
        row = row[first]
        begin, end = lo[row] + hits[first] - offsets[row], lo[row] + hits[last] - offsets[row] + SPAN
        return pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(begin), pa.array(end)], names=["k1", "k2", "s", "e"])

    last_kmer = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kmer = np.asarray(batch.column(0))
        cuts = np.concatenate([[0], np.flatnonzero(kmer[1:] != kmer[:-1]) + 1, [batch.num_rows]])
        lengths = np.concatenate([[0], np.cumsum(flat(batch.column(5))[1][1:])])
        begin = 0
        for s in cuts[:-1]:
            if kmer[s] != last_kmer and size + lengths[s] - lengths[begin] >= SET:
                if s > begin:
                    waiting.append(batch.slice(begin, s - begin))
                yield solve()
                waiting.clear()
                size, begin = 0, s
            last_kmer = kmer[s]
        waiting.append(batch.slice(begin))
        size += lengths[-1] - lengths[begin]
    if waiting:
        yield solve()


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(k1, k2, s, e): byte ranges of the documents (k1, k2, text) that lie in repeated strings; ranges of a document may overlap."""
    found = keep(keyed.mapInArrow(_segments, "kmer long, seg long, k1 long, k2 long, lo long, n int"), "segments")
    distinct = keep(found.groupBy("kmer", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "lo", "n")).alias("o")), "distinct")
    several = distinct.groupBy("kmer").agg(F.count(F.lit(1)).alias("segments"), F.min("c").alias("least")).where("segments > 1 and least = 1").select("kmer", "segments")
    several = keep(several, "several")
    twice = distinct.where("c > 1").select("kmer", "seg")
    whole = maybe_in(found, twice, ["kmer", "seg"]).where("_maybe").join(twice, ["kmer", "seg"]).select("k1", "k2", F.col("lo").alias("s"), (F.col("lo") + F.col("n") + SPAN - 1).alias("e"))
    open_ = keep(maybe_in(distinct, several, ["kmer"]).where("_maybe").join(several, "kmer").select("kmer", "segments", "o.*", F.least("c", F.lit(2)).alias("c")), "open")

    def wanted(rows: DataFrame, run, schema: str) -> DataFrame:
        lists = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("kmer", "lo", "n", "c")).alias("w"))
        near = maybe_in(keyed, rows.select("k1", "k2"), ["k1", "k2"]).where("_maybe")
        # equal rows send a segment more than once; it occurs more than once then, so this decides nothing
        return near.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "w").mapInArrow(run, schema)

    texts = wanted(open_.where(F.col("segments") <= WIDE), _cut(False), "kmer long, k1 long, k2 long, lo long, c long, text binary")
    narrow = texts.repartition("kmer").sortWithinPartitions("kmer").mapInArrow(_merge_sets, "k1 long, k2 long, s long, e long")
    ranges = whole.unionByName(narrow)
    wide = open_.where(F.col("segments") > WIDE)
    if not wide.isEmpty():
        windows = keep(wanted(wide, _cut(True), "hash long, k1 long, k2 long, at long, c long"), "windows")
        counted = windows.groupBy("hash").agg(F.sum("c").alias("all")).where("all > 1")
        hit = windows.where("c = 1").join(counted, "hash").select("k1", "k2", F.col("at").alias("s"), (F.col("at") + SPAN).alias("e"))
        ranges = ranges.unionByName(hit)
    return ranges


def _removed(given: list[str], where: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(where))
            lists = batch.column(batch.num_columns - 1)
            begin, end = (np.asarray(lists.flatten().field(i)) for i in range(2))
            ends = np.asarray(lists.offsets)
            size, gone, spans, digest, text = [], [], [], [], []
            for r in range(batch.num_rows):
                body, a, b = data[offsets[r]: offsets[r + 1]], begin[ends[r]: ends[r + 1]], end[ends[r]: ends[r + 1]]
                left, runs, kept = body.tobytes(), 0, None
                if len(a):
                    depth = np.zeros(len(body) + 1, dtype=np.int32)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, b, -1)
                    out = np.cumsum(depth[:-1]) > 0
                    runs = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                    left = body[~out].tobytes()
                    # characters at a cut: decode each kept run by itself
                    edge = np.flatnonzero(np.diff(np.concatenate([[True], out, [True]]).astype(np.int8)))
                    kept = "".join(bytes(body[s:e]).decode("utf-8", "ignore") for s, e in zip(edge[::2], edge[1::2]))
                size.append(len(body))
                gone.append(len(body) - len(left))
                spans.append(runs)
                digest.append(hashlib.sha256(left).hexdigest())
                text.append(left.decode("utf-8", "replace") if kept is None else kept)
            columns = [pa.array(text, pa.string()) if i == where else batch.column(i) for i in range(len(given))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)],
                                             names=[*given, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what repeats cut out of ``text``, and n_bytes, n_removed, n_spans, kept_sha256."""
    given = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "_k1", "_k2", "_r", "_near")]
    docs = docs.select(*given).withColumn("_k1", F.xxhash64("text")).withColumn("_k2", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
    keyed = docs.where(F.octet_length("text") >= SPAN).select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text")
    ranges = repeated_ranges(keyed).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("_r"))
    ranges = keep(ranges.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_r"), "ranges")
    # only documents that may have ranges are shuffled to them
    docs = maybe_in(docs, ranges, ["_k1", "_k2"], "_near")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    joined = docs.where("_near").join(ranges, ["_k1", "_k2"], "left").select(*given, F.coalesce("_r", none).alias("_r"))
    joined = joined.unionByName(docs.where("not _near").select(*given, none.alias("_r")))
    schema = with_fields([f for f in joined.schema.fields if f.name != "_r"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return joined.mapInArrow(_removed(given, given.index("text")), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
