"""Every stage of the pipeline against a brute-force version, with extra columns, nulls, repeated rows and empty tables."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_pairs import cut, shingle_set, unite

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_bytes string, matches string, size string, copy string"
EXTRA = (0.5, "b", "m", "s", "c")


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(31)
    words = {lang: ["".join(rng.choice(part, 3)) for _ in range(700)] for lang, part in (("aa", ["the", "ing", "er", "and"]), ("bb", ["sch", "ung", "ei", "ü"]))}
    make = lambda lang, n: " ".join(rng.choice(words[lang], n))
    items = [make("aa", 25), make("bb", 40)]
    shared = make("aa", 60)
    texts = [(make(lang, rng.integers(30, 200)), lang) for lang in ["aa", "bb"] * 60]
    for i in range(0, 40, 4):
        base = texts[i][0].split()
        base[3] = "changed"
        texts += [(texts[i][0], texts[i][1]), (" ".join(base), texts[i][1])]
    texts += [(make("aa", 50) + " " + shared + " " + make("aa", 30), "aa") for _ in range(5)]
    texts += [(make("bb", 30) + " " + items[i % 2] + " " + make("aa", 20), "bb") for i in range(2)]
    texts += [(None, None), ("", None), ("123 !!", None), (make("aa", 20_000), None), ("ab", "aa"), ("Xqzw vkjqx", None), ("Xqzw vkjqx " * 6, None)]
    rows = [(i, t, lang, [None, "s1", "s2", "s2"][i % 4], len(t or ""), *EXTRA) for i, (t, lang) in enumerate(texts)]
    rows += [rows[5], rows[5], (None, make("bb", 90), "bb", "s1", 7, *EXTRA), (None, texts[9][0], "bb", "s1", 7, *EXTRA)]
    return rows, items


def sf_folder(spark, tmp_path_factory, items):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus, tmp_path_factory):
    rows, items = corpus
    folder = sf_folder(spark, tmp_path_factory, items)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = docs.columns
    steps = [f for _, f in pipeline.STAGES]

    told = steps[0](spark, docs, folder)
    assert told.columns == names
    told_rows = [tuple(r) for r in told.collect()]
    assert sorted(map(repr, told_rows)) == sorted(repr(r) for r in rows if re.search(r"[^\W\d_]", r[1] or "") and "Xqzw" not in r[1])  # junk goes, short or long

    unique = steps[1](spark, spark.createDataFrame(told_rows, SCHEMA), folder)
    ids = {k: (r[0] if r[0] is not None else (1 << 62) + k) for k, r in enumerate(told_rows)}
    sets = {k: shingle_set(r[1], 5) for k, r in enumerate(told_rows)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = unite(sets, links)
    first = {}
    for k in sets:
        first[root[k]] = min(first.get(root[k], k), k, key=lambda x: (ids[x], x))
    assert unique.columns == names
    unique_rows = [tuple(r) for r in unique.collect()]
    assert sorted(map(repr, unique_rows)) == sorted(repr(told_rows[k]) for k in first.values())

    cleaned = steps[2](spark, spark.createDataFrame(unique_rows, SCHEMA), folder)
    gone = cut([r[1].encode() for r in unique_rows])
    cleaned_rows = [tuple(r) for r in cleaned.collect()]
    assert cleaned.columns == names and sum(g[2] > 0 for g in gone) >= 5
    assert sum(len(r[1].encode()) for r in cleaned_rows) <= sum(g[1] - g[2] for g in gone)
    assert {repr(r) for r, g in zip(unique_rows, gone) if g[2] == 0} <= set(map(repr, cleaned_rows))
    assert all(r[4] == len(r[1]) for r in cleaned_rows if r[0] is not None)

    safe = steps[3](spark, spark.createDataFrame(cleaned_rows, SCHEMA), folder)
    safe_rows = [tuple(r) for r in safe.collect()]
    assert safe.columns == names
    assert sorted(map(repr, safe_rows)) == sorted(repr(r) for r in cleaned_rows if not any(item in r[1] for item in items))
    assert len(safe_rows) < len(cleaned_rows)

    mixed = steps[4](spark, spark.createDataFrame(safe_rows, SCHEMA), folder).collect()
    total, taken = sum(len(r[1].split()) for r in safe_rows), sum(len(r["text"].split()) for r in mixed)
    assert {r["copies"] for r in mixed} <= {1, 2} and all(1 <= r["copy"] <= r["copies"] for r in mixed)
    largest = max(len(r[1].split()) for r in safe_rows)
    assert abs(taken - 1.5 * total) <= 3 * largest / 2 + 1 and {r["_given_copy"] for r in mixed} == {"c"}


def test_empty_tables_pass(spark, corpus, tmp_path_factory):
    folder = sf_folder(spark, tmp_path_factory, corpus[1])
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), folder).collect() == []


def test_run_reads_the_documents(spark):
    mixed = pipeline.run(spark, "/root/testdata/sf0.001")
    assert mixed.count() > 100 and mixed.select("doc_id", "copy").distinct().count() == mixed.count()
    assert mixed.where("text is null or text = ''").isEmpty()


def test_one_id_with_several_texts(spark):
    rng = np.random.default_rng(4)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(900)], 80)) for _ in range(3))
    rows = [(1, a), (2, b), (2, a + " x"), (3, c), (3, c), (3, b + " x"), (None, c + " x"), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, pipeline.near_copies(spark, docs, "").collect()), key=repr)
    texts = [t[1] for t in kept if t[1]]
    sets = [shingle_set(t, 5) for t in texts]
    assert len(texts) == 3 and not any(100 * len(x & y) >= 80 * len(x | y) for x, y in itertools.combinations(sets, 2))
    assert (1, a) in kept and sum(t[0] == 4 for t in kept) == 2
