"""Licence scan: automaton against plain search, chains against an exhaustive one, phrases against a word-by-word search, edge cases."""

from __future__ import annotations

import random
import re

import pytest

from tidewatch.llm import op11_licences as op11
from tidewatch.llm.licence_texts import NOTICES, PHRASES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(text):
    words, out = plain_words(text), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i: i + len(p)] == p]
    return sorted(out)


def contains(hay, needle):
    return any(hay[i: i + len(needle)] == needle for i in range(len(hay) - len(needle) + 1))


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 5))]
        automaton = op11.Automaton(sequences)
        text = [rng.randrange(4) for _ in range(40)]
        state = length = 0
        for at, word in enumerate(text):
            while state and word not in automaton.step[state]:
                state = automaton.link[state]
                length = automaton.size[state]
            state = automaton.step[state].get(word, 0)
            length = length + 1 if state else 0
            longest = next((n for n in range(at + 1, 0, -1) if any(contains(s, text[at + 1 - n: at + 1]) for s in sequences)), 0)
            assert length == longest
            if length:
                match = text[at + 1 - length: at + 1]
                ends = {(n, i) for n, s in enumerate(sequences) for i in range(len(s)) if i + 1 >= length and s[i + 1 - length: i + 1] == match}
                assert set(automaton.ends[state]) == ends and len(automaton.ends[state]) == len(ends)


def best_chain(own):
    """Words of the best chain over all subsets of matches (last word, place of it, words)."""
    best = 0

    def grow(last, total):
        nonlocal best
        best = max(best, total)
        for m in own:
            if last is None:
                grow(m, m[2])
            elif last[0] < m[0] and last[1] < m[1] and m[0] - m[2] + 1 - last[0] <= op11.GAP:
                overlap = max(0, last[0] - m[0] + m[2], last[1] - m[1] + m[2])
                if overlap < m[2]:
                    grow(m, total + m[2] - overlap)
    grow(None, 0)
    return best


def test_chains_are_the_best():
    rng = random.Random(5)
    for _ in range(60):
        notice = [f"w{rng.randrange(6)}" for _ in range(14)]
        scanner = op11.Scanner([("x", " ".join(notice))], {})
        text = " ".join(rng.choice([" ".join(notice[i: i + 5]), f"w{rng.randrange(9)}"]) for i in (rng.randrange(10) for _ in range(5)))
        places, matches = [], []
        numbers = [sorted(set(notice)).index(w) if w in notice else -1 for w in text.split()]
        scanner.stream(numbers, 0, places, matches)
        own = [(end, at, length) for end, length, state in matches for _, at in scanner.automaton.ends[state]]
        if len(own) <= 9:
            assert max((c[3] for c in scanner.chains(matches)), default=0) == best_chain(own)


MIT = next(text for label, text in NOTICES if label == "mit" and len(text) > 100)
BSD2, BSD3 = (next(text for label, text in NOTICES if label == name) for name in ("bsd-2-clause", "bsd-3-clause"))
TEXTS = [
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", "by CC BY CC BY, cc-by", "MIT\nLICENSE mit license", "mitlicense mit licenses", None, "", " .,;", "É mit LICENSE é",
    "licensed under the Apache License, Version 2.0.", "licensed under the Apache License, Version 1.1", "see the GNU General Public License, version 3, or the GNU General Public License",
    f"Copyright 2020 someone. {MIT} and so on", MIT.replace("merge,", "mix or").replace("WARRANTY", "guarantee"), " ".join(plain_words(MIT)[:40]), BSD2, BSD3,
    f"{MIT} {'word ' * 50} {BSD2} {'word ' * 50} {MIT}", "word " * 300000 + " mit license", "the of and to in is the of and",
]
WANTED = {0: "cc-by,cc-by-nc-4.0", 1: "cc-by,cc-by-4.0", 2: "cc-by", 3: "mit", 4: "", 5: "", 6: "", 7: "", 8: "mit", 9: "apache,apache-2.0", 10: "apache", 11: "gpl", 12: "mit", 13: "mit",
          14: "", 15: "bsd-2-clause", 16: "bsd-3-clause", 17: "bsd-2-clause,mit", 18: "mit", 19: ""}


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "mit license", "x", 7), (0, TEXTS[0], "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int")  # the last two clash with names of the result
    return op11.scan(docs).collect()


def test_labels_and_spans(scanned):
    assert len(scanned) == len(TEXTS) + 2
    for r in scanned:
        text = "mit license" if r.doc_id is None else TEXTS[r.doc_id]
        assert r.n_words == len(plain_words(text))
        assert sorted((b.word, b.label) for b in r.base) == plain_places(text)
        labels = ",".join(sorted({b.label for b in r.base} | {s.label for s in r.spans}))
        assert labels == ("mit" if r.doc_id is None else WANTED[r.doc_id]), text
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(r.base)
    by_id = {r.doc_id: r for r in scanned}
    assert [s.label for s in by_id[17].spans] == ["mit", "bsd-2-clause", "mit"]
    span = by_id[12].spans[0]
    assert (span.first, span.last - span.first + 1, span.share) == (3, len(plain_words(MIT)), 1.0)
    assert 0.8 <= by_id[13].spans[0].share < 1 and 0.1 < by_id[14].score < 0.5


def test_query_and_empty_table(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    out = {r.doc_id: r for r in op11.query(spark, f"{tmp_path}/some").collect()}
    assert {i: r.labels for i, r in out.items()} == WANTED
    assert (out[2].n_base, out[2].first_word, out[2].last_word, out[2].base_labels) == (3, 1, 5, "cc-by")
    assert (out[5].n_words, out[5].n_base, out[5].first_word, out[5].last_word, out[5].base_labels, out[5].score) == (0, 0, None, None, "", 0.0)
    assert op11.query(spark, f"{tmp_path}/none").count() == 0
