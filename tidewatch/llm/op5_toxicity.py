"""Toxicity scores from a learnt lexicon, matched through Levenshtein automata on its trie, with context windows for quotations.

Learning uses at most about POSITIVES toxic and NEGATIVES other labelled documents, taken by a hash of the id (documented bound); of copies in
that sample one stays, by the smallest shingle hash. Terms are whole words and word beginnings of 3 to 10 letters; a term enters the
lexicon if it is at least LIFT times as common in toxic documents and that could not be chance among all terms tried (binomial test,
Bonferroni). Of nested terms the one with the largest product of toxic documents and log of its lift stays; beside a word beginning the whole words that
begin so stay for their misspelt forms. The log of the lift is its weight.

Matching: the lexicon's trie and the Levenshtein automaton of one edit are run together as one automaton whose states are sets of (trie
node, edits); states are made when first met and kept. Whole words of FUZZY letters or more match with one edit (changed, missing,
extra letter or digit), shorter words and word beginnings only exactly. A misspelt form that stands unquoted in the sample's other texts and
is less than LIFT times as common in toxic ones is an ordinary word and doesn't match; other forms of the same term do.

A match counts as quoted if a quotation mark opens within WINDOW words before it and one closes within WINDOW words after it. Four
numbers per text (plain or quoted, exact or misspelt matches, as log(1 + sum of their weights)) go into a logistic model, fitted in numpy on the same sample
with weak priors; a kind of match that the sample has nowhere gets a fixed part of the weight of plain matches (UNSEEN).

Edge cases: null and blank texts have no match and get the score of such texts; labels of unknown documents and null labels are not
learnt; without a positive label the lexicon is empty and every score is the share of positives; repeated rows are each scored; an empty
table gives an empty table; other columns pass through ``score_texts``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import held_out, keep, table, with_fields
from tidewatch.llm.op2_minhash import sketched

POSITIVES, NEGATIVES = 2000, 4000
LIFT, CHANCE = 6.0, 0.01
SHORT, LONG = 3, 10
FUZZY = 5
WINDOW = 8
WORD = re.compile(r"\w+")
FEATURES = ("_plain", "_quoted", "_misspelt", "_misspelt_quoted")
OPEN, CLOSE = "\"“„«‹‘'", "\"”“»›’'"
CACHE = 200_000
UNSEEN = (1.0, 0.25, 0.95, 0.2)  # plain, quoted, misspelt, quoted and misspelt


def terms(text: str) -> set[str]:
    """Word beginnings, and whole words with a closing mark."""
    out = set()
    for word in set(WORD.findall(text.lower())):
        out.add(word[:40] + "$")
        out.update(word[:k] for k in range(SHORT, min(len(word), LONG) + 1))
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[toxic].update(terms(text or ""))
        # a term without a toxic document can only matter beside one that has some, so both go on
        every = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][t] for t in every], pa.int64()), pa.array([seen[0][t] for t in every], pa.int64())], names=["term", "p", "n"])


class Automaton:
    """Trie of the lexicon run together with a one-edit Levenshtein automaton, made deterministic on demand."""

    def __init__(self, lexicon: dict[str, float], innocent: frozenset[str] = frozenset()):
        """``innocent``: ordinary words that are not misspelt forms of a term."""
        self.innocent = innocent
        self.lexicon = sorted(lexicon)
        self.term: dict[int, str] = {}  # node -> whole word that may be misspelt
        self.weight: list[float] = [0.0]
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]  # 1: whole word ends here, 2: word beginning ends here
        self.fuzzy: list[bool] = [False]  # below this node lies a whole word that may be misspelt
        for term in self.lexicon:
            whole = term.endswith("$")
            letters = term[:-1] if whole else term
            node, path = 0, [0]
            for letter in letters:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.end.append(0)
                    self.fuzzy.append(False)
                    self.weight.append(0.0)
                node = self.next[node][letter]
                path.append(node)
            self.end[node] |= 1 if whole else 2
            self.weight[node] = max(self.weight[node], lexicon[term])
            if whole and len(letters) >= FUZZY:
                self.term[node] = term
                for step in path:
                    self.fuzzy[step] = True
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.code: list[tuple[int, float]] = []  # (kind, weight)
        self.known: dict[str, tuple[int, float]] = {}
        self.start = self._state(frozenset({(0, 0)}))

    def _state(self, positions: frozenset) -> int:
        """Close under missing letters (a step in the trie without reading)."""
        full = set(positions)
        for node, edits in positions:
            if edits == 0:
                full.update((child, 1) for child in self.next[node].values() if self.fuzzy[child])
        key = frozenset(full)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            found = [(kind, max(w)) for kind, w in ((4, [self.weight[n] for n, e in key if e == 0 and self.end[n] & 2]),
                                                     (1, [self.weight[n] for n, e in key if e == 0 and self.end[n] & 1]),
                                                     (2, [self.weight[n] for n, _ in key if n in self.term])) if w]
            self.code.append(found[0] if found else (0, 0.0))
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            child = self.next[node].get(letter)
            if child is not None and (edits == 0 or self.fuzzy[child]):
                out.add((child, edits))
            if edits == 0 and self.fuzzy[node]:
                out.add((node, 1))  # extra letter
                out.update((c, 1) for c in self.next[node].values() if self.fuzzy[c])  # changed letter
        return self._state(frozenset(out))

    def match(self, word: str) -> tuple[int, float]:
        """0 for no match, 1 for exact or 2 for misspelt, and the term's weight."""
        found = self.known.get(word)
        if found is None:
            found = self.code[self._run(word)]
            found = (1 if found[0] == 4 else found[0], found[1])
            if found[0] == 2 and word in self.innocent:
                found = (0, 0.0)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def _run(self, word: str) -> int:
        """The state after the word, or where a word beginning or a dead end was reached."""
        state = self.start
        for letter in word:
            moves = self.moves[state]
            after = moves.get(letter)
            if after is None:
                after = moves[letter] = self._move(state, letter)
            state = after
            if self.code[state][0] == 4 or not self.sets[state]:
                break
        return state

    def misspelt(self, text: str | None) -> dict[str, bool]:
        """Misspelt forms of terms in the text, and whether one of them stands unquoted."""
        out: dict[str, bool] = {}
        lower = (text or "").lower()
        if any(self.match(w)[0] == 2 for w in set(WORD.findall(lower))):
            spans = [m.span() for m in WORD.finditer(lower)]
            for i, (s, e) in enumerate(spans):
                if self.match(lower[s:e])[0] == 2:
                    out[lower[s:e]] = out.get(lower[s:e], False) or not self._in_quotes(lower, spans, i)
        return out

    def features(self, text: str | None) -> list[float]:
        """log(1 + weights) of plain exact, quoted exact, plain misspelt, quoted misspelt matches."""
        if not text or not self.lexicon:
            return [0.0] * 4
        lower = text.lower()
        if not any(self.match(w)[0] for w in set(WORD.findall(lower))):
            return [0.0] * 4
        counts = [0.0] * 4
        spans = [m.span() for m in WORD.finditer(lower)]
        for i, (s, e) in enumerate(spans):
            kind, weight = self.match(lower[s:e])
            if kind:
                counts[2 * (kind - 1) + self._in_quotes(lower, spans, i)] += weight
        return [math.log1p(c) for c in counts]

    def _in_quotes(self, lower: str, spans: list[tuple[int, int]], i: int) -> int:
        s, e = spans[i]
        left = lower[spans[i - WINDOW - 1][1] if i > WINDOW else 0: s]
        right = lower[e: spans[i + WINDOW + 1][0] if i + WINDOW + 1 < len(spans) else len(lower)]
        return self._quoted(left, right)

    @staticmethod
    def _quoted(left: str, right: str) -> int:
        """An unclosed opening mark on the left and a closing mark on the right; an apostrophe inside a word is none."""
        depth = 0
        padded = f" {left} "
        for k in range(1, len(padded) - 1):
            if padded[k] in OPEN + CLOSE:
                if not padded[k - 1].isalnum() and padded[k] in OPEN:
                    depth = 1
                elif padded[k] in CLOSE and not (padded[k - 1].isalnum() and padded[k + 1].isalnum()):
                    depth = 0
        if not depth:
            return 0
        padded = f"x{right} "
        return int(any(padded[k] in CLOSE and not padded[k + 1].isalnum() for k in range(1, len(padded) - 1)))


class Model:
    def __init__(self, lexicon: dict[str, float], innocent: frozenset[str], weights: np.ndarray):
        self.lexicon, self.innocent, self.weights = lexicon, innocent, weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[1:] + self.weights[0], -30, 30)))


def _forms(lexicon: dict[str, float]):
    """Misspelt forms of terms with the numbers of toxic and of other texts that hold them; quoted ones of other texts don't count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon)
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(form for form, plain in automaton.misspelt(text).items() if toxic or plain)
            every = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][t] for t in every], pa.int64()), pa.array([seen[0][t] for t in every], pa.int64())], names=["form", "p", "n"])
    return run


def choose_terms(counted: list[tuple[str, int, int]], positives: int, negatives: int, tried: int) -> dict[str, float]:
    """The lexicon, term -> log of its lift, from (term, toxic documents, other documents). Of nested terms the one that explains most stays."""
    base = positives / max(positives + negatives, 1)
    sure = {}
    for term, p, n in counted:
        total = p + n
        tail = [math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(base) + (total - k) * math.log(max(1 - base, 1e-12)) for k in range(p, total + 1)]
        chance = max(tail) + math.log(sum(math.exp(t - max(tail)) for t in tail))
        if (p / positives) / ((n + 0.5) / max(negatives, 1)) >= LIFT and chance + math.log(max(tried, 1)) < math.log(CHANCE):
            sure[term] = (p, n)
    weight = {t: math.log((p + 0.5) / (positives + 1)) - math.log((n + 0.5) / (negatives + 1)) for t, (p, n) in sure.items()}
    out: dict[str, float] = {}
    inner: set[str] = set()
    for term in sorted(sure, key=lambda t: (-round(sure[t][0] * weight[t], 6), -len(t), t)):
        begins = [term[:k] for k in range(SHORT, len(term))]
        if term not in inner and not any(x in out for x in begins):
            out[term] = weight[term]
            inner.update(begins)
    # exact forms of these words match their beginning first
    out |= {t: weight[t] for t in sure if t.endswith("$") and len(t) > FUZZY and t not in out and any(t[:k] in out for k in range(SHORT, len(t)))}
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit lexicon and weights on the bounded sample; the driver gets the sure terms and four numbers per sampled document."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1):
        return Model({}, frozenset(), np.array([-6.0, 0, 0, 0, 0]))
    share = F.when(F.col("y") == 1, F.lit(min(1.0, POSITIVES / totals[1]))).otherwise(F.lit(min(1.0, NEGATIVES / max(totals.get(0, 1), 1))))
    taken = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taken), "doc_id")
    sample = keep(sample, "sample")
    one = keep(sketched(sample, 3, 1).select("doc_id", F.coalesce(F.try_element_at("v", F.lit(1)), F.col("doc_id")).alias("v")).groupBy("v").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "one")
    sample = keep(sample.join(F.broadcast(one), "doc_id").dropDuplicates(["doc_id"]), "sample-one")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = keep(sample.select("text", "y").mapInArrow(_count_terms, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "terms")
    tried = counted.where("p > 1").count()
    found = counted.where((F.col("p") > 2) & (F.col("p") / max(sizes.get(1, 0), 1) >= LIFT * (F.col("n") + 0.5) / max(sizes.get(0, 0), 1))).collect()
    lexicon = choose_terms([(r["term"], r["p"], r["n"]) for r in found], sizes.get(1, 0), sizes.get(0, 0), tried)
    forms = sample.select("text", "y").mapInArrow(_forms(lexicon), "form string, p long, n long").groupBy("form").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    ordinary = forms.where((F.col("n") > 0) & (F.col("p") / max(sizes.get(1, 0), 1) < LIFT * (F.col("n") + 0.5) / max(sizes.get(0, 0), 1))).collect()
    innocent = frozenset(r["form"] for r in ordinary)
    features = score_rows(sample.select("text", "y"), lexicon, innocent).collect()
    x = np.array([[r[n] for n in FEATURES] for r in features]).reshape(-1, 4)
    y = np.array([r["y"] for r in features], dtype=float)
    real = np.where(y == 1, totals[1] / max(y.sum(), 1), totals.get(0, 0) / max((1 - y).sum(), 1))
    return Model(lexicon, innocent, _logistic(x, y, real / real.mean()))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps on the weighted log-loss with a Gaussian prior around (-4; 3, 0.7, 2, 0.5)."""
    design = np.column_stack([np.ones(len(x)), x])
    prior, strength = np.array([-4.0, 3.0, 0.7, 2.0, 0.5]), np.array([0.01, 0.5, 0.5, 0.5, 0.5])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + strength * (w - prior)
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(strength)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    for kind, part in enumerate(UNSEEN):
        if not x[:, kind].any():
            w[kind + 1] = part * w[1]
    return w


def score_rows(frame: DataFrame, lexicon: dict[str, float], innocent: frozenset[str]) -> DataFrame:
    """Columns of ``frame`` except text, plus the four FEATURES."""
    given = [f for f in frame.schema.fields if f.name != "text"]
    where = frame.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon, innocent)
        for batch in batches:
            x = np.array([automaton.features(t) for t in batch.column(where).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != where], *[pa.array(x[:, i]) for i in range(4)]], names=[*[f.name for f in given], *FEATURES])

    return frame.mapInArrow(run, with_fields(given, ", ".join(f"{n} double" for n in FEATURES)))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of ``docs`` except text, plus score (0 to 1)."""
    given = [c for c in docs.columns if c not in ("score", *FEATURES)]
    rows = score_rows(docs.select(*given), model.lexicon, model.innocent)
    total = F.lit(float(model.weights[0]))
    for name, weight in zip(FEATURES, model.weights[1:]):
        total = total + F.col(name) * float(weight)
    return rows.withColumn("score", 1 / (1 + F.exp(-total))).drop(*FEATURES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.where(~held_out(5)), table(spark, sf_dir, "labels").where(~held_out(5)))
    return score_texts(docs, model).select("doc_id", held_out(5).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
