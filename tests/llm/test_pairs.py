"""Near duplicates, repeated strings and embeddings against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pytest

from tidewatch.llm import op2_minhash, op8_suffix, op9_embedding
from tidewatch.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n_shingles string"  # the extra column clashes with a result's name


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def unite(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def texts_with_copies(seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for size in (6, 7, 8, 20, 60, 150, 400):
        for _ in range(3):
            base = list(rng.choice(words, size))
            for edits in (0, 0, 1, 1, 2, 4, 8, 16):
                copy = list(base)
                for at in rng.integers(0, size, min(edits, size // 3)):
                    copy[at] = rng.choice(words)
                out.append(" ".join(copy))
    # a large group of copies at growing distance from one text
    base = list(rng.choice(words, 120))
    for i in range(700):
        copy = list(base)
        for at in rng.integers(0, 120, i % 9):
            copy[at] = rng.choice(words)
        out.append(" ".join(copy))
    out += ["a b", "A  B", "a b", "one", "", "  \n ", "same words here now", "Same words\there now", None, None, "ä Ä", "Ä ä"]
    return out


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, n, percent):
    texts = texts_with_copies()
    docs = list(enumerate(texts))
    sets = {i: shingle_set(t, n) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = unite(sets, links)
    got = op2_minhash.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS).repartition(5), n, percent)
    rows = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    assert rows == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_near_duplicates_edges(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long, "x"), (None, long, "x"), (None, "lonely words of no one", "x"), (7, "twice the same row here", "x"), (7, "twice the same row here", "x"), (8, None, None)]
    got = sorted(map(tuple, op2_minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()), key=repr)
    assert got == sorted([(1, 59_998, 1, True), (None, 59_998, 1, False), (None, 3, None, True), (7, 3, 7, True), (7, 3, 7, True), (8, 0, 8, True)], key=repr)
    assert op2_minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_sketch_bounds():
    assert op2_minhash.least_shared(10, 85, 48) == 9  # whole sets: exact
    assert op2_minhash.least_shared(10_000, 85, 48) <= 48 * 0.85 - 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 900), (900, 7), (3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 900: 5, 7: 5}


def cut(docs):
    span, seen = op8_suffix.SPAN, {}
    for i, body in enumerate(docs):
        for p in range(len(body) - span + 1):
            seen.setdefault(body[p: p + span], []).append((i, p))
    out = []
    for i, body in enumerate(docs):
        gone = bytearray(len(body))
        for p in range(len(body) - span + 1):
            if len(seen[body[p: p + span]]) > 1:
                gone[p: p + span] = b"\x01" * span
        left = bytes(x for x, g in zip(body, gone) if not g)
        out.append((i, len(body), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def repeated_texts():
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcdefgh äé\n"), n))
    shared = [text(k) for k in (150, 201, 260, 700)]
    docs = ["", None, "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, text(5000)]
    for i in range(60):
        docs.append(text(rng.integers(0, 400)) + shared[i % 4] + text(rng.integers(0, 400)) + (shared[(i + 1) % 4][20:] if i % 3 else ""))
    docs += [docs[20], docs[20], text(300) + "é" * 150, text(250) + "é" * 150]
    return docs


@pytest.mark.parametrize("wide", [2048, 3])
def test_repeats_match_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(op8_suffix, "WIDE", wide)  # 3: the way for anchors with very many segments
    texts = repeated_texts()
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(4)
    got = op8_suffix.remove_repeats(frame)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == cut([(t or "").encode() for t in texts])
    kept = {r["doc_id"]: r["text"] for r in got.collect()}
    assert kept[2] == "short" and kept[5] == "" and kept[1] == ""


def test_repeats_edges(spark):
    schema = "doc_id long, text string"
    body = "".join(chr(97 + i * i % 26) + str(i) for i in range(120))
    rows = [(None, body), (None, body), (3, "unlike"), (3, "unlike")]
    got = sorted((r["n_bytes"], r["n_removed"]) for r in op8_suffix.remove_repeats(spark.createDataFrame(rows, schema)).collect())
    assert got == [(6, 0), (6, 0), (len(body), len(body)), (len(body), len(body))]
    assert op8_suffix.remove_repeats(spark.createDataFrame([], schema)).collect() == []


def test_merge_interleaves_like_a_full_sort():
    rng = np.random.default_rng(9)
    parts = [rng.integers(97, 99, rng.integers(210, 330)).astype(np.uint8) for _ in range(9)]
    parts += [parts[0][5:], parts[3].copy(), np.concatenate([parts[1], parts[2]])]
    data, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    windows = {}
    for s, e in zip(np.concatenate([[0], ends[:-1]]), ends):
        for p in range(s, e - op8_suffix.SPAN + 1):
            windows.setdefault(data[p: p + op8_suffix.SPAN].tobytes(), []).append(p)
    assert sorted(op8_suffix.repeated_starts(data, ends)) == sorted(p for w in windows.values() if len(w) > 1 for p in w)


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((250, 32))
    near = base[rng.integers(0, 40, 400)] + rng.standard_normal((400, 32)) * rng.choice([0.02, 0.2, 0.3, 0.4], (400, 1))
    hot = base[0] + rng.standard_normal((900, 32)) * 0.25
    every = np.concatenate([base, near, hot, base[:20], base[20:30] * 3]).astype(np.float32)
    rows = [(i, [float(x) for x in v], "a") for i, v in enumerate(every)]
    odd = [(10_000, None, "a"), (10_001, [0.0] * 32, "a"), (10_002, [float("nan")] + [1.0] * 31, "a"), (10_003, [None] + [1.0] * 31, "a"), (10_004, [], "a"), (10_005, [1.0], "a"), (10_006, [2.0], "a")]
    got = {r["vec_id"]: tuple(r)[1:] for r in op9_embedding.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links string").repartition(6)).collect()}
    unit = every.astype(np.float64) / np.linalg.norm(every.astype(np.float64), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    wanted, found = linked.sum(), sum(got[i][0] for i in range(len(every)))
    assert found >= 0.95 * wanted and all(got[i][0] <= linked[i].sum() for i in range(len(every)))
    root = unite(range(len(every)), np.argwhere(linked).tolist())
    assert sum(got[i][1] != root[i] for i in range(len(every))) <= 0.02 * len(every)
    assert [got[i][0] for i in range(10_000, 10_007)] == [0, 0, 0, 0, 0, 1, 1]
    assert op9_embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bands_reach_the_recall():
    for n in (10, 10_000, 10**9):
        bits, count = op9_embedding.bands(n, 0.9)
        same = 1 - np.arccos(0.9) / np.pi
        assert 1 - (1 - same**bits) ** count >= op9_embedding.RECALL
