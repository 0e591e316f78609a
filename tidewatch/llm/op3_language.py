"""Language identification with bit-sliced Bloom filters over byte n-grams.

Slot s of the filter holds one bit per language (a 64-bit word, so 64 languages a slice; more languages take more slices). An n-gram is
looked up once: the AND of its slots is the set of all languages that contain it. Per language the looked-up n-grams of a text are
counted, the share of false positives of that language's filter is taken off, and the largest corrected share decides.

The filter is learnt from at most about ``per_language`` labelled documents of each language, taken by a hash of the id (documented
bound; reruns agree). An n-gram belongs to a language if it occurs at least three times in its sample and no other language uses it more
than four times as often. Counts are made by Spark; the driver gets the filter only, whose size is fixed.

Text is lower-cased (all of Unicode), everything but letters becomes one space, and n-grams are taken over UTF-8 bytes of whole texts.

Edge cases: null text or text without a letter gives ``und`` and score 0; a text in which nothing is found gets the first language by
name and score 0; ties go to the first language by name; a null language is never learnt; without any training row every
prediction is ``und``; an empty table gives an empty table; other columns pass through, those named as results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import held_out, keep, mix, pieces, table, with_fields

GRAM = 4
SLOTS = 1 << 18
HASHES = 3
PER_LANGUAGE = 2000
LETTER = np.full(256, 32, dtype=np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of every row as integers, and how many lie before each row. Rows are led and ended by a space."""
    letters = LETTER[data]
    rows = len(offsets) - 1
    room = np.full(len(data) + 2 * rows, 32, dtype=np.uint8)
    begin = offsets[:-1] + 2 * np.arange(rows)
    at = np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(rows), np.diff(offsets))
    room[at] = letters
    blank = room == 32
    kept = np.ones(len(room), dtype=bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    kept[begin] = True
    before = np.concatenate([[0], np.cumsum(kept)])
    text = room[kept].astype(np.uint64)
    edges = np.concatenate([before[begin], [len(text)]])
    if len(text) < n:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    keys = text[: len(text) - n + 1].copy()
    for j in range(1, n):
        keys = (keys << np.uint64(8)) | text[j: len(text) - n + 1 + j]
    starts = np.arange(len(keys))
    row = np.repeat(np.arange(rows), np.diff(edges))[: len(keys)]
    inside = starts + n <= edges[1:][row]
    return keys[inside], np.concatenate([[0], np.cumsum(np.bincount(row[inside], minlength=rows))])


def slots(keys: np.ndarray) -> list[np.ndarray]:
    one, two = mix(keys), mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return [((one + np.uint64(i) * two) >> np.uint64(40)).astype(np.int64) % SLOTS for i in range(HASHES)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in pieces(batches, "lowered"):
        keys, before = grams(data, offsets)
        code = np.repeat(np.asarray(rows.column(0)), np.diff(before)).astype(np.uint64)
        both, count = np.unique((code << np.uint64(8 * GRAM)) | keys, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((both >> np.uint64(8 * GRAM)).astype(np.int32)), pa.array((both & np.uint64((1 << 8 * GRAM) - 1)).astype(np.int64)),
                                          pa.array(count.astype(np.int64))], names=["code", "gram", "c"])


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, bits = np.asarray(batch.column(0)).astype(np.uint64), np.asarray(batch.column(1))
        for found in slots(keys):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(bits)], names=["slot", "bits"])


class Filter:
    """The learnt model: language names, one filter slice per 64 languages, and each language's false-positive share."""

    def __init__(self, names: list[str], slices: list[np.ndarray]):
        self.names, self.slices = names, slices
        fill = [np.mean((slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) if slices else 0.0 for i in range(len(names))]
        self.false = np.minimum(np.array(fill) ** HASHES, 0.999)

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected share of each row's n-grams in each language; rows by languages."""
        keys, before = grams(data, offsets)
        rows = len(offsets) - 1
        hits = np.zeros((rows, len(self.names)))
        places = slots(keys)
        total = np.maximum(np.diff(before), 1)
        for k, words in enumerate(self.slices):
            found = words[places[0]] & words[places[1]]
            for place in places[2:]:
                found &= words[place]
            for i in range(64 * k, min(64 * k + 64, len(self.names))):
                sums = np.concatenate([[0], np.cumsum((found >> np.uint64(i % 64)) & np.uint64(1))]).astype(np.int64)
                hits[:, i] = sums[before[1:]] - sums[before[:-1]]
        return np.maximum(hits / total[:, None] - self.false, 0) / (1 - self.false)


def learn(labelled: DataFrame, text: str = "text", label: str = "lang", id_column: str = "doc_id", per_language: int = PER_LANGUAGE) -> Filter:
    """One row per language and at most SLOTS filter words per slice reach the driver."""
    spark = labelled.sparkSession
    labelled = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    names = sorted(counts, key=lambda x: x.encode())
    if not names:
        return Filter([], [])
    known = spark.createDataFrame([(n, i, min(1.0, per_language / counts[n])) for i, n in enumerate(names)], f"{label} string, code int, share double")
    sample = labelled.join(F.broadcast(known), label).where(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    counted = sample.select("code", F.lower(text).alias("lowered")).mapInArrow(_count, "code int, gram long, c long").groupBy("code", "gram").agg(F.sum("c").alias("c"))
    counted = keep(counted, "grams")
    totals = counted.groupBy("code").agg(F.sum("c").alias("total"))
    rates = counted.where("c >= 3").join(F.broadcast(totals), "code").withColumn("rate", F.col("c") / F.col("total"))
    rates = rates.withColumn("most", F.max("rate").over(W.partitionBy("gram"))).where("rate * 4 >= most")
    slices = []
    for k in range(0, len(names), 64):
        bits = rates.where(F.col("code").between(k, k + 63)).select("gram", F.expr(f"shiftleft(1L, code - {k})").alias("bits"))
        merged = bits.mapInArrow(_slots_of, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
        words = np.zeros(SLOTS, dtype=np.uint64)
        words[merged["slot"].to_numpy()] = merged["bits"].to_numpy(dtype=np.int64).view(np.uint64)
        slices.append(words)
    return Filter(names, slices)


def predict(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """Input columns plus lang_pred and score, one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = with_fields([f for f in docs.schema.fields if f.name in given], "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        names = np.array([*filters.names, "und"], dtype=object)
        for batch in batches:
            lowered = pc.utf8_lower(pc.fill_null(batch.column(given.index(text)).cast(pa.large_string()), ""))
            batch = pa.RecordBatch.from_arrays([*batch.columns, lowered], names=[*given, "_lowered"])
            for rows, data, offsets in pieces(iter([batch]), "_lowered"):
                best, score = np.full(rows.num_rows, len(filters.names)), np.zeros(rows.num_rows)
                if filters.names:
                    shares = filters.shares(data, offsets)
                    ascii_letter = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
                    letter = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                    for i in np.flatnonzero(~letter):
                        letter[i] = any(x.isalpha() for x in bytes(data[offsets[i]: offsets[i + 1]]).decode("utf-8", "replace"))
                    best = np.where(letter, shares.argmax(axis=1), best)
                    top = np.take_along_axis(shares, np.minimum(best, len(filters.names) - 1)[:, None], axis=1)[:, 0]
                    score = np.where(letter, top * top / np.maximum(shares.sum(axis=1), 1e-12), 0.0)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(given)], pa.array(names[best], pa.string()), pa.array(score)], names=[*given, "lang_pred", "score"])

    return docs.select(*given).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(5)))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")
