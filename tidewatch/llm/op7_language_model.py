"""Scoring texts with a log-bilinear neural language model trained by noise-contrastive estimation in numpy.

Tokens are lower-cased words (``[^\\x20\\x09-\\x0D]+``) and one end per text. Counts of all training tokens are made by Spark over the
whole corpus. The model predicts classes: the TOP most frequent tokens are classes of their own, every other word belongs to one of
BUCKETS classes by its last two bytes and is drawn inside its class by smoothed corpus counts. A class is predicted from the two
classes before it: score = (R1[c1] + R2[c2]) . Q[c] + b[c].

Training: each partition of the training documents runs NCE over the tokens of its documents, from common start values; the
replicas are averaged by a Spark aggregation weighted by tokens, so scores depend a little on how the table is cut into partitions
(equal partitions give equal scores). Up to HEAVIEST equal examples of about CHUNK tokens are one example with a weight. Each of ROUNDS rounds has its share of the tokens, so every token is a target once. What is learnt from grows with the
corpus, what is kept has a fixed size. Normalisation is exact: one batched matrix product per context gives the sums over all classes,
made by Spark once per pair of context classes.

Counts of the HEAD most frequent words (a bound; the histogram of counts picks the cut) are sent to all tasks. Other words are joined by
a shuffle on the word's hash, one row per document and rare word; rare words can't be hot.

Edge cases: null and blank texts have the end token only; repeated rows are each scored; a null id counts as the empty text in the hold-out
rule; with no training row all counts are 0 and the model is uniform; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, held_out, keep, mix, pieces, table, word_hashes

TOP, BUCKETS, DIM = 1024, 64, 24
HEAD = 1 << 17
ROUNDS, BATCH, NOISE, RATE = 2, 512, 64, 0.15
CHUNK, HEAVIEST = 1 << 21, 2  # tokens whose equal examples are put together, and how many are one; more in one step would teach less
END = np.uint64(0x2545F4914F6CDD1D)
SMOOTH = 0.1


def token_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with the end of every row, the bucket of each, and tokens before each row."""
    words, starts, ends, first = word_hashes(data, offsets)
    rows = len(offsets) - 1
    before = first + np.arange(rows + 1)
    out = np.full(before[-1], END, dtype=np.uint64)
    bucket = np.zeros(before[-1], dtype=np.int64)
    at = np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(first))
    out[at] = words
    low = LOWER[data] if len(data) else data
    last = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)] if len(data) else 0, 0).astype(np.uint64) * np.uint64(256) + (low[ends - 1] if len(data) else low).astype(np.uint64)
    bucket[at] = (mix(last + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    return out, bucket, before


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in pieces(batches):
        words, bucket, _ = token_rows(data, offsets)
        seen, at, count = np.unique(words, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(bucket[at].astype(np.int32)), pa.array(count.astype(np.int64))], names=["w", "b", "c"])


class Model:
    """Corpus figures and weights: what every task needs to score a text."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, top: np.ndarray, total: int, types: int, bucket_total: np.ndarray, bucket_types: np.ndarray):
        order = np.argsort(head)
        self.head, self.counts = head[order], counts[order]
        self.total, self.types = total, types
        best = np.sort(top)
        self.top = best
        self.classes = len(best) + BUCKETS
        own = self.counts[np.searchsorted(self.head, best)] if len(best) else np.zeros(0)
        share = np.concatenate([own, bucket_total]) + 1.0
        self.unigram = share / share.sum()
        # log10 of the share that one count-0 word has of its class
        self.inside = np.log10(SMOOTH / (bucket_total + SMOOTH * (bucket_types + 1)))
        self.base0 = np.log10(SMOOTH / (total + SMOOTH * (types + 1)))
        rng = np.random.default_rng(11)
        self.r1, self.r2 = (rng.normal(0, 0.05, (self.classes + 1, DIM)).astype(np.float32) for _ in range(2))
        self.q = rng.normal(0, 0.05, (self.classes, DIM)).astype(np.float32)
        self.b = np.log(self.unigram).astype(np.float32)
        self.log_sums: np.ndarray | None = None

    def class_of(self, words: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = len(self.top) + bucket
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
            out = np.where(self.top[at] == words, at, out)
        return out

    def contexts(self, classes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.full(len(classes), self.classes), np.full(len(classes), self.classes)
        one[1:], two[2:] = classes[:-1], classes[:-2]
        one[before[:-1]] = self.classes
        two[before[:-1]] = self.classes
        second = before[:-1] + 1
        two[second[second < before[1:]]] = self.classes
        return one, two

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r1, self.r2, self.q, self.b)])

    def set_weights(self, flat: np.ndarray) -> None:
        at = 0
        for name in ("r1", "r2", "q", "b"):
            old = getattr(self, name)
            setattr(self, name, flat[at: at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size


class Trainer:
    """NCE with shared noise words and AdaGrad steps on one replica. Both context tables stand in one, ``r``."""

    def __init__(self, model: Model, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.r = np.concatenate([model.r1, model.r2])
        self.q, self.column = model.q.copy(), model.b[:, None].copy()
        self.squares = {name: np.full(getattr(self, name).shape, 1e-3, dtype=np.float32) for name in ("r", "q", "column")}
        self.log_noise = np.log(NOISE * model.unigram).astype(np.float32)
        self.cumulative = np.cumsum(model.unigram)
        self.seen = 0

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.column)])

    @property
    def r1(self) -> np.ndarray:
        return self.r[:self.model.classes + 1]

    @property
    def r2(self) -> np.ndarray:
        return self.r[self.model.classes + 1:]

    @property
    def b(self) -> np.ndarray:
        return self.column[:, 0]

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, times: np.ndarray | None = None) -> None:
        """One batch of distinct (context, context, target), each as often as ``times`` says (once without it)."""
        times = np.ones(len(one), dtype=np.float32) if times is None else times
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), self.model.classes - 1)
        two = two + np.uint16(self.model.classes + 1)
        context = self.r[one] + self.r[two]
        own_q, noise_q = self.q[target], self.q[noise]
        own = np.einsum("ij,ij->i", context, own_q) + self.column[target, 0] - self.log_noise[target]
        other = context @ noise_q.T
        other += self.column[noise, 0] - self.log_noise[noise]
        own_error = times / (1 + np.exp(np.clip(own, -30, 30)))  # 1 - sigmoid
        other_error = np.minimum(other, 30, out=other)  # worked on in place: the largest array here
        np.exp(np.negative(other_error, out=other_error), out=other_error)
        other_error += 1
        np.divide(-times[:, None], other_error, out=other_error)
        to_context = own_error[:, None] * own_q
        to_context += other_error @ noise_q
        count = times.sum()
        scale = np.float32(1 / np.sqrt(count))
        drawn = np.concatenate([target, noise.astype(np.uint16)])
        self._update("r", *_sums(np.concatenate([one, two]), np.concatenate([to_context, to_context])), scale)
        order = _order(drawn)
        self._update("q", *_sums(drawn, np.concatenate([own_error[:, None] * context, other_error.T @ context]), order), scale)
        self._update("column", *_sums(drawn, np.concatenate([own_error, np.ones(len(times), np.float32) @ other_error])[:, None], order), scale)
        self.seen += round(float(count))

    def _update(self, name: str, rows: np.ndarray, grad: np.ndarray, scale: np.float32) -> None:
        """AdaGrad on the rows that the batch touches; all others have no gradient."""
        value, squares = getattr(self, name), self.squares[name]
        grad *= scale
        square = squares[rows]
        square += grad * grad
        squares[rows] = square
        value[rows] += RATE * grad / np.sqrt(square)


def _order(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorting order of 16-bit numbers, where each run of equal ones starts, and the distinct numbers."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, starts, ordered[starts]


def _sums(at: np.ndarray, values: np.ndarray, order: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in ``at``, and the sums of their values."""
    order, starts, rows = order or _order(at)
    return rows, np.add.reduceat(values[order], starts, axis=0)


def count_corpus(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model before training, and the table of all words and counts."""
    vocabulary = keep(training.select("text").mapInArrow(_count, "w long, b int, c long").groupBy("w").agg(F.first("b").alias("b"), F.sum("c").alias("c")), "vocabulary")
    vocabulary = vocabulary.withColumn("size", F.floor(F.log2("c") * 16).cast("int"))
    steps = vocabulary.groupBy("size").agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("tokens")).orderBy(F.desc("size")).collect()
    room, least = HEAD, 1 << 30
    for row in steps:
        if row["types"] > room:
            break
        room, least = room - row["types"], row["size"]
    head = vocabulary.where(F.col("size") >= least).select("w", "b", "c").toPandas()
    words, counts, bucket = head["w"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64), head["b"].to_numpy(np.int64)
    best = np.lexsort((words, -counts))[:TOP]
    total, types = sum(r["tokens"] for r in steps), sum(r["types"] for r in steps)
    by_bucket = vocabulary.groupBy("b").agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("tokens")).collect()
    bucket_total, bucket_types = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in by_bucket:
        bucket_total[row["b"]], bucket_types[row["b"]] = row["tokens"], row["types"]
    np.subtract.at(bucket_total, bucket[best], counts[best])
    np.subtract.at(bucket_types, bucket[best], 1)
    return Model(words, counts, words[best], total, types, bucket_total, bucket_types), vocabulary.where(F.col("size") < least).select("w", "c")


def targets(words: np.ndarray, before: np.ndarray, turn: int) -> np.ndarray:
    """The tokens that a round learns to tell, by word and place in the row: each token in one round."""
    place = np.arange(len(words)) - np.repeat(before[:-1], np.diff(before))
    return np.flatnonzero(mix(words ^ mix(place.astype(np.uint64))) % np.uint64(ROUNDS) == turn)


def train(training: DataFrame, model: Model) -> Model:
    spark = training.sparkSession
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def fit(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value, 100 + turn)
            waiting: list[np.ndarray] = []
            for _, data, offsets in pieces(batches):
                words, bucket, before = token_rows(data, offsets)
                classes = shared.value.class_of(words, bucket)
                one, two = shared.value.contexts(classes, before)
                chosen = targets(words, before, turn)
                waiting.append((one[chosen] * (shared.value.classes + 1) + two[chosen]) * shared.value.classes + classes[chosen])
                if sum(map(len, waiting)) >= CHUNK:
                    _run(trainer, waiting)
            _run(trainer, waiting)
            if trainer.seen:
                flat = trainer.weights().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * trainer.seen), pa.array(np.full(len(flat), float(trainer.seen)))], names=["i", "x", "n"])

        merged = training.select("text").mapInArrow(fit, "i int, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        if len(merged):
            flat = model.weights().astype(np.float64)
            flat[merged["i"].to_numpy()] = merged["x"].to_numpy()
            model.set_weights(flat)
    return normalise(spark, model)


def _run(trainer: Trainer, waiting: list[np.ndarray]) -> None:
    """Learn from the tokens at hand. Equal (context, context, target) are one example with their number as its weight."""
    if not waiting:
        return
    every, times = np.unique(np.concatenate(waiting), return_counts=True)
    waiting.clear()
    parts = -(-times // HEAVIEST)
    every, times = np.repeat(every, parts), np.repeat((times / parts).astype(np.float32), parts)
    order = trainer.rng.permutation(len(every))
    every, times = every[order], times[order]
    contexts, target = np.divmod(every, trainer.model.classes)
    one, two = np.divmod(contexts, trainer.model.classes + 1)
    one, two, target = (x.astype(np.uint16) for x in (one, two, target))  # small numbers sort fastest; there are fewer than 2 ** 15 classes
    for s in range(0, len(every), BATCH):
        trainer.step(one[s: s + BATCH], two[s: s + BATCH], target[s: s + BATCH], times[s: s + BATCH])


def normalise(spark: SparkSession, model: Model) -> Model:
    """Log of the sum over all classes, for every pair of context classes."""
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for one in batch.column(0).to_pylist():
                scores = (m.r1[one] + m.r2) @ m.q.T + m.b
                top = scores.max(axis=1)
                row = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([row.astype(np.float32).tobytes()], pa.binary())], names=["id", "row"])

    rows = spark.range(model.classes + 1).repartition(24).mapInArrow(sums, "id long, row binary").collect()
    model.log_sums = np.stack([np.frombuffer(r["row"], dtype=np.float32) for r in sorted(rows, key=lambda r: r["id"])])
    return model


def _score(model: Model, data: np.ndarray, offsets: np.ndarray):
    words, bucket, before = token_rows(data, offsets)
    classes = model.class_of(words, bucket)
    one, two = model.contexts(classes, before)
    score = np.einsum("ij,ij->i", model.r1[one] + model.r2[two], model.q[classes]) + model.b[classes] - model.log_sums[one, two]
    score = score.astype(np.float64) / np.log(10)
    rare = classes >= len(model.top)
    score[rare] += model.inside[classes[rare] - len(model.top)]
    if len(model.head):
        at = np.minimum(np.searchsorted(model.head, words), len(model.head) - 1)
        known = model.head[at] == words
        count = np.where(known, model.counts[at], 0)
    else:
        known, count = np.zeros(len(words), bool), np.zeros(len(words))
    gain = np.log10((count + SMOOTH) / SMOOTH)
    score[rare] += gain[rare]
    base = model.base0 + gain
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    total = [np.bincount(row, x, len(offsets) - 1) for x in (known.astype(float), base, score)]
    rest = np.flatnonzero(~known)
    order = rest[np.lexsort((words[rest], row[rest]))]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    head = np.flatnonzero(fresh)
    times = np.diff(np.append(head, len(order)))
    lists = np.concatenate([[0], np.cumsum(np.bincount(row[order][head], minlength=len(offsets) - 1))]).astype(np.int32)
    return np.diff(before), total, words[order][head].view(np.int64), times, lists


def score_texts(docs: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            n, (known, base, score), words, times, lists = _score(shared.value, data, offsets)
            rare = pa.StructArray.from_arrays([pa.array(words), pa.array(times.astype(np.int64))], names=["w", "n"])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score),
                                              pa.ListArray.from_arrays(pa.array(lists), rare)], names=["uid", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    scored = keep(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "uid long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<struct<w:bigint,n:bigint>>"), "scored")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.w", "r.n").join(tail, "w")
    more = rare.groupBy("uid").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10((F.col("c") + SMOOTH) / SMOOTH)).alias("gain"))
    joined = scored.drop("rare").join(more, "uid", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base_score") + gain).alias("base_score"),
                         (F.col("score") + gain).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.where(~held_out(10))
    model, tail = count_corpus(training)
    model = train(training, model)
    scored = score_texts(docs, model, tail)
    return scored.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")
