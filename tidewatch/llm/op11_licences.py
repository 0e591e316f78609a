"""Licence scan with a generalised suffix automaton over the words of licence notices.

1. All notices and phrases are put into one suffix automaton whose letters are words. Each state knows where its strings end in which
   notice, and which phrases end there.
2. Every text is streamed through it. The matching statistics (longest string of any notice that ends at a word) give every place of a
   phrase and all matches that can't be made longer. Words that no notice has, and neighbours that stand so in no notice, can't be
   part of a match of two words; numpy leaves them out before the automaton runs.
3. Matches of LEAST words or more are chained per notice in text and notice order, at most GAP words apart in the text. A chain is a
   covered span. It counts if it covers SHARE of the notice; notices of fewer than SHORT words must be covered whole, as one word tells
   versions apart there.
4. Of spans that overlap the one that covers more words stays (then the larger share, then the smaller label).

The score is the largest share of a notice or phrase that a chain covers; a phrase counts as a notice of its own, so it is 1 where one
stands. The automaton is as large as the notices, which are a parameter, and goes to every task.

Edge cases: a null text counts as empty: no words, no labels (empty strings), score 0, first and last word null; repeated rows and ids
each get a row; null ids stay; very long texts are streamed word by word; an empty table gives an empty table; other columns are dropped.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, pieces, prefix_hash, span_hash, table
from tidewatch.llm.licence_texts import NOTICES, PHRASES

LEAST, GAP, SHARE, SHORT = 3, 32, 0.8, 16
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
INSIDE = np.zeros(256, dtype=bool)  # bytes of words, after A-Z are lower-cased
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOUND = "doc_id long, n_words long, base array<struct<label: string, word: long>>, spans array<struct<label: string, first: long, last: long, covered: long, share: double>>, score double"


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and words before each row."""
    low = LOWER[data]
    inside = np.r_[False, INSIDE[low], False]
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[offsets] = True  # a word ends with its row
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edges))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edges))
    return span_hash(prefix_hash(low), starts, ends), np.searchsorted(starts, offsets)


class Automaton:
    """Generalised suffix automaton of word sequences: ``step``, ``link`` and ``size`` by state, the empty string is state 0."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                ends += [[] for _ in range(len(self.size) - len(ends))]
                ends[last].append((number, at))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[state] > 0:
                ends[self.link[state]] += ends[state]
        self.ends = ends  # of all strings of a state: (sequence, place of the last word)

    def _new(self, size: int, link: int, step: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.step.append(step)
        return len(self.size) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of the longest string of ``state`` followed by ``word``, cut out of a state with longer strings if need be."""
        to = self.step[state][word]
        if self.size[to] == self.size[state] + 1:
            return to
        copy = self._new(self.size[state] + 1, self.link[to], dict(self.step[to]))
        self.link[to] = copy
        while state >= 0 and self.step[state].get(word) == to:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._new(self.size[last] + 1, 0, {})
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new


class Scanner:
    """Notices and phrases, ready to be run over texts."""

    def __init__(self, notices: Sequence[tuple[str, str]], phrases: Mapping[str, str]):
        listed = [(label, words_of(text), False) for label, text in notices] + [(label, words_of(text), True) for text, label in phrases.items()]
        listed = [x for x in listed if x[1]]
        self.labels, self.phrase = [x[0] for x in listed], [x[2] for x in listed]
        vocabulary = sorted({w for _, words, _ in listed for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        sequences = [[number[w] for w in words] for _, words, _ in listed]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        a = self.automaton
        # phrases that end the strings of a state: (sequence, words)
        self.phrases = [tuple(sorted({(n, self.sizes[n]) for n, at in ends if self.phrase[n] and at + 1 == self.sizes[n] and self.sizes[n] <= size}))
                        for ends, size in zip(a.ends, a.size)]
        for state in sorted(range(1, len(a.size)), key=lambda s: a.size[s]):
            if a.link[state] > 0:
                self.phrases[state] = tuple(sorted({*self.phrases[state], *self.phrases[a.link[state]]}))
        single = [i for i, n in enumerate(self.sizes) if n == 1]
        self.single = np.array(sorted({sequences[i][0] for i in single if self.phrase[i]}), dtype=np.int64)
        data = [w.encode() for w in vocabulary]
        hashes, _ = word_hashes(np.frombuffer(b" ".join(data), np.uint8), np.array([0, len(b" ".join(data))])) if data else (np.zeros(0, np.uint64), None)
        self.order = np.argsort(hashes)
        self.known = hashes[self.order]
        self.next = np.unique([x * len(vocabulary) + y for s in sequences for x, y in zip(s, s[1:])]).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of every word, -1 for words that no notice has."""
        if not len(self.known) or not len(hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.order[at], -1)

    def islands(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words, as (start, end), outside of which no match of two words and no phrase lies."""
        n = len(numbers)
        joined = np.zeros(n + 1, dtype=bool)  # with the word before
        if n > 1:
            pair = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
            joined[pair + 1] = np.isin(numbers[pair] * len(self.known) + numbers[pair + 1], self.next)
            joined[first] = False
        used = joined[:-1] | joined[1:] | np.isin(numbers, self.single)
        return np.flatnonzero(used & ~joined[:-1]), np.flatnonzero(used & ~joined[1:]) + 1

    def stream(self, words: list[int], start: int, places: list[tuple[int, int]], matches: list[tuple[int, int, int]]) -> None:
        """Runs one island that starts at word ``start``; adds (sequence, first word) of phrases and (last word, words, state) of matches."""
        step, link, size, phrases = self.automaton.step, self.automaton.link, self.automaton.size, self.phrases
        state = length = 0
        for at, word in enumerate(words, start):
            if word not in step[state]:
                if length >= LEAST:
                    matches.append((at - 1, length, state))
                while state and word not in step[state]:
                    state = link[state]
                length = size[state]
            state = step[state].get(word, 0)
            length = length + 1 if state else 0
            for number, n in phrases[state]:
                if n <= length:
                    places.append((number, at - n + 1))
        if length >= LEAST:
            matches.append((start + len(words) - 1, length, state))

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(sequence, first word, last word, words covered): the best chain from every match that none can precede."""
        by_sequence: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in matches:
            for number, at in self.automaton.ends[state]:
                by_sequence.setdefault(number, []).append((end, at, length))
        out = []
        for number, own in by_sequence.items():
            own.sort()
            covered, root, best = [], [], {}
            for k, (end, at, length) in enumerate(own):
                gain, before = 0, -1
                for j in range(k - 1, -1, -1):
                    end_j, at_j, _ = own[j]
                    if end_j < end - length + 1 - GAP:
                        break
                    overlap = max(0, end_j - end + length, at_j - at + length)
                    if end_j < end and at_j < at and overlap < length and covered[j] - overlap > gain:
                        gain, before = covered[j] - overlap, j
                covered.append(length + gain)
                root.append(root[before] if before >= 0 else k)
                if covered[k] > best.get(root[k], (0,))[0]:
                    best[root[k]] = (covered[k], end)
            for r, (words, end) in best.items():
                out.append((number, own[r][0] - own[r][2] + 1, end, words))
        return out

    def spans(self, chains: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """The covered spans that count, without overlaps, in text order."""
        good = []
        for number, first, last, words in chains:
            size = self.sizes[number]
            if not self.phrase[number] and words >= (size if size < SHORT else SHARE * size):
                good.append((-words, -words / size, self.labels[number], first, last))
        taken: list[tuple[int, int, str, int, float]] = []
        for words, share, label, first, last in sorted(good):
            at = bisect_left(taken, (first,))
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
                insort(taken, (first, last, label, -words, -share))
        return [(label, first, last, words, share) for first, last, label, words, share in taken]

    def document(self, islands: list[tuple[list[int], int]]) -> tuple[list, list, float]:
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        for words, start in islands:
            self.stream(words, start, places, matches)
        chains = self.chains(matches)
        score = 1.0 if places else max((words / self.sizes[number] for number, _, _, words in chains), default=0.0)
        return [(self.labels[number], at) for number, at in sorted(places, key=lambda p: (p[1], p[0]))], self.spans(chains), min(1.0, score)


def _structs(rows: list[list[tuple]], names: list[str], types: list[pa.DataType]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = [x for row in rows for x in row]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate(types)], names=names))


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            hashes, first = word_hashes(data, offsets)
            numbers = scanner.numbers(hashes)
            starts, ends = scanner.islands(numbers, first)
            row = np.searchsorted(first, starts, side="right") - 1
            of: dict[int, list] = {}
            for r, s, e in zip(row.tolist(), starts.tolist(), ends.tolist()):
                of.setdefault(r, []).append((numbers[s:e].tolist(), s - int(first[r])))
            nothing = ([], [], 0.0)
            base, spans, score = zip(*[scanner.document(of[r]) if r in of else nothing for r in range(rows.num_rows)])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(first).astype(np.int64)), _structs(list(base), ["label", "word"], [pa.string(), pa.int64()]),
                 _structs(list(spans), ["label", "first", "last", "covered", "share"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]),
                 pa.array(score, pa.float64())], names=["doc_id", "n_words", "base", "spans", "score"])
    return run


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, base (label and first word of every phrase), spans (covered notices by words), score."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scan(Scanner(notices, phrases)), FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    labels, places = F.transform("base", lambda b: b["label"]), F.transform("base", lambda b: b["word"])
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.transform("spans", lambda s: s["label"]))).alias("labels"), "score")
