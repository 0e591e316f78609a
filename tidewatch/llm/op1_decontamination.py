"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. Words are runs of letters and digits, lower-cased, so punctuation and case don't hide a copy.
2. Seeds: all 3-word n-grams of all test items, however often they occur, so that whole copies, parts and edited copies of an item keep
   their seeds whatever else is copied.
3. A document that contains a seed of an item is aligned with it around the seeds' diagonals: local alignment with +2 for an equal word,
   -1 for a changed, missing or extra one. The score is divided by that of a whole unedited copy; matches reach ``least``. The window
   around the diagonals is as wide as the most missing and extra words that leave a score of ``least``; a window that holds too few of the item's words
   for such a score isn't aligned. So every alignment that reaches ``least`` is found if three words in a row are equal somewhere in it.

Items are handled in blocks of bounded size: one block is sent to all tasks and all documents are read once per block, so a
benchmark of any size works and no item is left out. Documents stay where they are; nothing of them is shuffled.

Edge cases: items or documents that are null or have fewer than three words match nothing; repeated items and rows are each reported;
ties between windows of one item go to the first; an empty table on either side gives no match; other columns pass through ``mark``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, mix, pieces, prefix_hash, shingles, span_hash, table, with_fields, word_spans

N = 3
LEAST = 0.5
MATCH, EDIT = 2, 1
BLOCK_BYTES = 8 << 20
BITS = 22
ENTRIES = 1 << 20  # places of seeds in items that are held together
TOKEN = np.full(256, 32, dtype=np.uint8)
TOKEN[48:58], TOKEN[97:123], TOKEN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
TOKEN[65:91] = np.arange(97, 123)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    text = TOKEN[data]
    lead = np.flatnonzero(text[:-1] == 0xC3) + 1  # Latin-1 capitals in UTF-8
    capital = lead[(text[lead] >= 0x80) & (text[lead] <= 0x9E) & (text[lead] != 0x97)]
    text[capital] += 0x20
    starts, ends, first = word_spans(text, offsets)
    return span_hash(prefix_hash(text), starts, ends), starts, ends, first


class Items:
    """A block of test items as every task holds it."""

    def __init__(self, texts: list[str]):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.words, _, _, self.first = tokens(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        grams, before = shingles(self.words, self.first, N)
        item = np.repeat(np.arange(len(texts)), np.diff(before))
        place = np.arange(len(grams)) - before[:-1][item]
        whole = np.diff(self.first)[item] >= N
        grams, item, place = grams[whole], item[whole], place[whole]
        order = np.lexsort((place, item, grams))
        grams, self.item, self.place = grams[order], item[order], place[order]
        self.seeds, begin = np.unique(grams, return_index=True)
        self.begin = np.append(begin, len(grams))
        self.key = np.repeat(np.arange(len(self.seeds)), np.diff(self.begin)) * len(texts) + self.item
        self.bits = np.zeros(1 << BITS, dtype=bool)
        self.bits[(self.seeds >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``grams`` that hold a seed, and which seed."""
        at = np.flatnonzero(self.bits[(grams >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return at[:0], at[:0]
        seed = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        good = self.seeds[seed] == grams[at]
        return at[good], seed[good]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair, and the window word at which it ends. All pairs move through the rows of the table together."""
    height, width = max(map(len, items)), max(map(len, windows))
    a = np.zeros((len(items), height), dtype=np.uint64)
    b = np.zeros((len(items), width), dtype=np.uint64)
    real_a, real_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, windows)):
        a[k, : len(x)], real_a[k, : len(x)], b[k, : len(y)], real_b[k, : len(y)] = x, True, y, True
    ramp = EDIT * np.arange(width, dtype=np.int32)
    above = np.zeros((len(items), width + 1), dtype=np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(height):
        equal = (b == a[:, i: i + 1]) & real_b & real_a[:, i: i + 1]
        row = np.maximum(above[:, :-1] + np.where(equal, MATCH, -EDIT), above[:, 1:] - EDIT)
        row = np.maximum.accumulate(np.maximum(row, 0) + ramp, axis=1) - ramp
        row[~real_a[:, i]] = 0
        top = row.argmax(axis=1)
        score = row[np.arange(len(items)), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
        above[:, 1:] = row
    return best, end


def _spread(block: Items, row: np.ndarray, entries: np.ndarray) -> Iterator[tuple[slice, int, int]]:
    """Runs of hits of whole rows and ranges of items that together have about ENTRIES places; a row with more goes by ranges of items."""
    items = len(block.first) - 1
    total = np.concatenate([[0], np.cumsum(entries)])
    edges = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(total[edges], total[edges[at]] + ENTRIES, side="right")) - 1)
        parts = min(items, int(total[edges[to]] - total[edges[at]]) // ENTRIES + 1)
        cuts = [items * k // parts for k in range(parts + 1)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield slice(edges[at], edges[to]), low, high
        at = to


def _possible(items: list[np.ndarray], windows: list[np.ndarray], scores: np.ndarray) -> np.ndarray:
    """Whether enough of an item's words occur in the window for the score; order doesn't count, so no pair that reaches it is lost."""
    each = mix(np.arange(len(items), dtype=np.uint64))
    a, b = (np.concatenate(x) ^ np.repeat(each, [len(y) for y in x]) for x in (items, windows))
    met = np.bincount(np.repeat(np.arange(len(items)), [len(y) for y in items])[np.isin(a, b)], minlength=len(items))
    return MATCH * met >= scores


def _matches(block: Items, data: np.ndarray, offsets: np.ndarray, least: float) -> dict[int, list[tuple[int, float, int, int]]]:
    """Row -> [(item of the block, score, first byte, end byte)]."""
    words, starts, ends, first = tokens(data, offsets)
    grams, before = shingles(words, first, N)
    at, seed = block.hits(grams)
    row = np.searchsorted(before, at, side="right") - 1
    whole = np.diff(first)[row] >= N
    at, seed, row = at[whole], seed[whole], row[whole]
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    if len(at):
        word = first[:-1][row] + at - before[:-1][row]
        for part, low, high in _spread(block, row, block.begin[seed + 1] - block.begin[seed]):
            _align_hits(block, words, starts, ends, first, offsets, least, row[part], seed[part], word[part], low, high, found)
    out: dict[int, list] = {}
    for (r, i), value in sorted(found.items()):
        out.setdefault(r, []).append((i, *value))
    return out


def _align_hits(block: Items, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, offsets: np.ndarray, least: float,
                row: np.ndarray, seed: np.ndarray, word: np.ndarray, from_item: int, to_item: int, found: dict[tuple[int, int], tuple[float, int, int]]) -> None:
    """Add the matches of hits (row, seed, word) with the items of a range to ``found``."""
    items = len(block.first) - 1
    begin = np.searchsorted(block.key, seed * items + from_item)
    many = np.searchsorted(block.key, seed * items + to_item) - begin
    each = np.repeat(np.arange(len(row)), many)
    if not len(each):
        return
    entry = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    row, item, diagonal = row[each], block.item[entry], word[each] - block.place[entry]
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    length = np.diff(block.first)[item]
    slack = np.maximum(np.floor(MATCH * length * (1 - least) / EDIT), 0).astype(np.int64) + 1
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    heads = np.flatnonzero(fresh)
    low, high = diagonal[heads], diagonal[np.append(heads[1:], len(row)) - 1]
    row, item, length, slack = row[heads], item[heads], length[heads], slack[heads]
    low, high = np.maximum(low - slack, first[:-1][row]), np.minimum(high + length + slack, first[1:][row])
    order = np.argsort(length * 100_000 + (high - low), kind="stable")
    while len(order):
        area = max(1, 2_000_000 // max(1, int((high - low)[order[-1]]) * 4))
        batch, order = order[-area:], order[:-area]
        pairs = [block.words[block.first[i]: block.first[i + 1]] for i in item[batch]], [words[a:b] for a, b in zip(low[batch], high[batch])]
        good = np.flatnonzero(_possible(*pairs, least * MATCH * length[batch] - 1e-6))
        if not len(good):
            continue
        batch = batch[good]
        score, end = align(*[[x[k] for k in good] for x in pairs])
        share = score / (MATCH * length[batch])
        for k in np.flatnonzero(share >= least):
            w = batch[k]
            last = int(low[w] + end[k])
            begin = max(int(low[w]), last - int(length[w]) + 1)
            key, value = (int(row[w]), int(item[w])), (float(share[k]), int(starts[begin] - offsets[row[w]]), int(ends[last] - offsets[row[w]]))
            if key not in found or (-value[0], value[1]) < (-found[key][0], found[key][1]):
                found[key] = value


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about ``limit`` bytes; only one block at a time is on the driver."""
    items = keep(items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // limit + 1
    for b in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows]


MATCHES = "array<struct<item_id:bigint,score:double,start_byte:bigint,end_byte:bigint>>"


def mark(docs: DataFrame, items: DataFrame, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with a column ``matches``: per found item its id, score and where the copy lies in the text's bytes."""
    given = [c for c in docs.columns if c != "matches"]
    docs = docs.select(*given)
    where = given.index("text")
    schema = with_fields(docs.schema.fields, f"matches {MATCHES}")
    sc = docs.sparkSession.sparkContext
    out = docs.withColumn("matches", F.array().cast(MATCHES))
    for ids, texts in _blocks(items, block_bytes):
        block = Items(texts)
        if not len(block.seeds):
            continue
        chosen, numbers = sc.broadcast(block), list(ids)

        def scan(batches: Iterator[pa.RecordBatch], chosen=chosen, numbers=numbers) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.rename_columns([*given, "matches"])
                for rows, data, offsets in pieces(iter([batch]), given[where]):
                    found = _matches(chosen.value, data, offsets, least)
                    old = rows.column(len(given))
                    if found:
                        lists = old.to_pylist()
                        for r, hits in found.items():
                            lists[r] = (lists[r] or []) + [{"item_id": numbers[i], "score": s, "start_byte": a, "end_byte": b} for i, s, a, b in hits]
                        old = pa.array(lists, type=old.type)
                    yield pa.RecordBatch.from_arrays([*rows.columns[: len(given)], old], names=[*given, "matches"])

        out = out.mapInArrow(scan, schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.score", "m.start_byte", "m.end_byte")
