"""Decontamination, language, html, toxicity, mixing, language model and tool calls: small fixtures with known answers."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.compare import connect, difference
from tidewatch.llm import op1_decontamination as op1
from tidewatch.llm import op3_language as op3
from tidewatch.llm import op4_html as op4
from tidewatch.llm import op5_toxicity as op5
from tidewatch.llm import op6_mixing as op6
from tidewatch.llm import op7_language_model as op7
from tidewatch.llm import op10_tool_calls as op10

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(17)
VOCABULARY = ["".join(RNG.choice(list("bcdfglmnprst")) + RNG.choice(list("aeiou")) for _ in range(RNG.integers(1, 4))) for _ in range(800)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


# -- 1


def test_alignment_scores():
    word = lambda s: np.array([ord(c) for c in s], dtype=np.uint64)

    def plain(a, b):
        best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(0, table[i][j] + (2 if x == y else -1), table[i][j + 1] - 1, table[i + 1][j] - 1)
                best = max(best, table[i + 1][j + 1])
        return best

    rng = np.random.default_rng(2)
    pairs = [("".join(rng.choice(list("abcd"), rng.integers(1, 14))), "".join(rng.choice(list("abcd"), rng.integers(1, 20)))) for _ in range(60)]
    score, _ = op1.align([word(a) for a, _ in pairs], [word(b) for _, b in pairs])
    assert score.tolist() == [plain(a, b) for a, b in pairs]


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_leaks_are_found_and_clean_documents_left(spark, block_bytes):
    items = [prose(n) for n in (12, 20, 35, 50)]
    edited = items[2].split()
    edited[5], edited[17] = "changed", "altered"
    del edited[25]
    docs = [prose(100), prose(60) + " " + items[0].upper() + "! " + prose(40), items[1].replace(" ", ",\n"), prose(30) + " " + " ".join(edited) + " " + prose(9), None, "", prose(40_000),
            prose(50) + " " + " ".join([items[3]] * 3) + " " + items[0], " ".join(items[3].split()[:12]) + " " + prose(80)]
    docs += [f"{items[1]} {prose(20)}" for _ in range(60)]  # an item copied so often that its n-grams are not rare
    frame = spark.createDataFrame([(i, d, "old") for i, d in enumerate(docs)], "doc_id long, text string, matches string").repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "too short"), (92, "")], "item_id long, text string")
    found = {r["doc_id"]: {m["item_id"]: m for m in r["matches"]} for r in op1.mark(frame, bench, block_bytes=block_bytes).collect()}
    wanted = {1: {0}, 2: {1}, 3: {2}, 7: {0, 3}} | {i: {1} for i in range(9, 69)}
    assert {i: set(m) for i, m in found.items() if m} == wanted
    assert found[1][0]["score"] == 1.0 and 0.7 < found[3][2]["score"] < 1.0
    at = found[1][0]
    assert docs[1].encode()[at["start_byte"]: at["end_byte"]].decode() == items[0].upper()
    assert op1.mark(spark.createDataFrame([], "doc_id long, text string"), bench).collect() == []
    assert all(not r["matches"] for r in op1.mark(frame, bench.limit(0)).collect())


def test_all_kinds_of_copies_of_a_very_frequent_item_are_found(spark, monkeypatch):
    rng = np.random.default_rng(31)
    item = prose(60, rng).split()
    edited = list(item)
    edited[1:28:3] = ["changed"] * 9
    kinds = {"whole": item, "no beginning": item[10:], "first half": item[:31], "second half": item[29:], "edited": edited,
             "parted": item[:27] + prose(36, rng).split() + item[33:], "third": item[:20]}
    docs = [f"{prose(int(rng.integers(5, 40)), rng)} {' '.join(copy)} {prose(9, rng)}" for copy in kinds.values() for _ in range(220)]
    items = [" ".join(item), prose(40, rng), " ".join(item[40:] + item[:15])]

    def words(text):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return op1.tokens(raw, np.array([0, len(raw)]))[0]

    scores = np.stack([op1.align([words(i)] * len(docs), [words(d) for d in docs])[0] / (2 * len(i.split())) for i in items], axis=1)
    wanted = {(d, i): scores[d, i] for d, i in zip(*np.nonzero(scores >= op1.LEAST))}
    assert {d // 220 for d, i in wanted if i == 0} == set(range(6))
    frame, bench = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], m["item_id"]): m["score"] for r in op1.mark(frame, bench).collect() for m in r["matches"]} == wanted
    # places of seeds beyond the bound are dealt by rows, then by items
    monkeypatch.setattr(op1, "ENTRIES", 40)
    block, data = op1.Items(items), np.frombuffer("".join(docs).encode(), dtype=np.uint8)
    found = op1._matches(block, data, np.concatenate([[0], np.cumsum([len(d.encode()) for d in docs])]), op1.LEAST)
    assert {(r, m[0]): m[1] for r, hits in found.items() for m in hits} == wanted


# -- 3


def test_language(spark):
    rng = np.random.default_rng(4)
    syllables = {"aa": ["the", "and", "ing", "er"], "bb": ["sch", "ung", "ei", "ü"], "cc": ["ção", "lh", "ar", "os"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(n))
    train = [(i, make(lang, 80), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)] + [(900, "no label here", None), (901, None, "aa")]
    model = op3.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.names == ["aa", "bb", "cc"] and max(model.false) < 0.01
    rows = [(i, make(lang, 30).upper(), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    odd = [(100, None, None), (101, "", None), (102, "12 + 34 !!", None), (103, make("bb", 30_000), "bb"), (104, "漢字", "x")]
    got = {r["doc_id"]: r for r in op3.predict(spark.createDataFrame(rows + odd, "doc_id long, text string, score string"), model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1 for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "bb"]
    assert got[104]["lang_pred"] in model.names and got[104]["score"] == 0
    nothing = op3.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert op3.predict(spark.createDataFrame([(1, "words")], "doc_id long, text string"), nothing).first()["lang_pred"] == "und"


def test_grams_stay_inside_rows():
    data = np.frombuffer("ab  cdx".encode(), dtype=np.uint8)
    keys, before = op3.grams(data, np.array([0, 3, 3, 7]), 3)
    text = [int(k).to_bytes(3, "big").decode() for k in keys]
    assert [text[a:b] for a, b in zip(before[:-1], before[1:])] == [[" ab", "ab "], [], [" cd", "cdx", "dx "]]


def test_language_held_out_accuracy(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op3.query(spark, SF).collect()
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) >= 0.95


# -- 4


PAGE = """<!DOCTYPE html><html><head><title>Never</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a><li><a>About</a></ul></nav>
<div class="ad">Buy this now</div>%s<div class="comments"><p>First! Nice post.</p></div><aside>Side</aside><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("html,text", [
    (PAGE % "<article><h1>Ti&amp;tle</h1><p>One <b>tw</b>o\n\n three&nbsp;four<br>five<script>var x='</p>'</script></p><!-- c --><ul><li>six<li>seven</ul></article>", "Ti&tle One two three four five six seven"),
    (PAGE % "<div id='content'><p>Real text &lt;here&gt; it is.</p><div class='cookie-notice'>We use cookies</div><form><button>Go</button></form><p>More.</p></div>", "Real text <here> it is. More."),
    (PAGE % "<article><p>Unclosed <b>first.<br><p>Then more", "Unclosed first. Then more"),
    (None, ""), ("", ""), ("just words", "just words"), ("<p>a <", "a <"), ("<nav>only a menu</nav>", ""), ("<article><p>" + "w " * 50_000, ("w " * 50_000).strip()),
])
def test_page_text(html, text):
    assert op4.Weights({}, frozenset()).text(html) == text


def test_pages_table(spark):
    pages = [(i, f"u{i}", PAGE % f"<article><p>Article number {i} has these words in it.</p></article>") for i in range(20)] + [(None, None, None), (3, "u3", PAGE % "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    weights = op4.learn(frame)
    assert weights.weight["nav"] < -2 and weights.weight["p"] > 0
    got = {(r["page_id"], r["text"]): r["n_chars"] for r in op4.extract(frame, weights).collect()}
    assert got[(5, "Article number 5 has these words in it.")] == len("Article number 5 has these words in it.") and got[(None, "")] == 0 and (3, "") in got
    empty = frame.limit(0)
    assert op4.extract(empty, op4.learn(empty)).collect() == []


BODY = "".join(f"<p>Paragraph {i} of the text says some things that a reader wants.</p>" for i in range(5))
LINES = " ".join(f"Paragraph {i} of the text says some things that a reader wants." for i in range(5))


@pytest.mark.parametrize("html,text", [
    (f"<html class='has-search'><body class='single no-sidebar'><nav>Menu</nav><div class='entry-content'>{BODY}</div></body></html>", LINES),
    (f"<body class='sidebar'><div class='layout with-sidebar'><div class='entry-content'>{BODY}</div><div class='sidebar'>Side</div></div></body>", LINES),
    (f"<main><div class='sidebar-layout'><div class='entry-content'>{BODY}<div class='comments'><div class='content'>Mine</div></div></div></div></main>", LINES),
    (f"<form id='aspnetForm'><div id='content'>{BODY}</div></form>", LINES),
    (f"<article>{BODY}<div class='related-posts'><div class='post'>Another post</div></div></article><div class='related'><div class='post'>More of it</div></div>", LINES),
    (f"<article>{BODY}<h2 id='related-work'>Related work</h2><section id='search-algorithms'><p>Trees.</p></section></article>", LINES + " Related work Trees."),
    (f"<article>{BODY}<p class='overflow-hidden'>See <a href='/hidden-gems?id=search'>gems</a>.</p><p hidden>No</p><p class='a hidden'>No</p><p style='display: none'>No</p><p aria-hidden=true>No</p></article>",
     LINES + " See gems ."),
])
def test_names_of_wrappers_drop_no_article(html, text):
    assert op4.Weights({}, frozenset()).text(html).replace("gems.", "gems .") == text


def test_classes_around_articles_are_not_learnt_as_side_text(spark):
    page = "<body class='blog'><div id='page'><div class='promobox'>%s</div>%s</div></body>"
    side = "Words that stand beside the article on every page"
    pages = [(i, f"u{i}", page % (side, f"<article>{BODY}</article>")) for i in range(20)]
    weights = op4.learn(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert weights.never == {"class=promobox"}
    assert weights.text(page % (side, f"<div class='entry-content'>{BODY}</div>")) == LINES


def test_region_is_the_best_contiguous_sum():
    rng = np.random.default_rng(8)
    for _ in range(200):
        scores = rng.integers(-5, 6, rng.integers(0, 12)).tolist()
        a, b = op4.region(scores)
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)], default=0)
        assert sum(scores[a:b]) == max(best, 0)


# -- 5


def edit_distance_within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    return any(a[:i] + a[i + 1:] in (b, b[:i] + b[i + 1:]) for i in range(len(a))) or any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_automaton_matches_edit_distance():
    terms = ["idiot", "moron", "abcde", "abxde", "scum"]
    automaton = op5.Automaton({t + "$": 1.0 + i for i, t in enumerate(terms)} | {"veq": 9.0})
    rng = np.random.default_rng(6)
    letters = list("abcdeimnorstuvqx")
    for _ in range(4000):
        word = list(terms[rng.integers(0, 5)])
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(word) + 1)
            word[at: at + rng.integers(0, 2)] = list(rng.choice(letters, rng.integers(0, 2)))
        word = "".join(word)
        exact = word in terms or word.startswith("veq")
        near = any(len(t) >= op5.FUZZY and edit_distance_within_one(word, t) for t in terms)
        assert automaton.match(word)[0] == (1 if exact else 2 if near else 0), word


def test_quotation_window():
    automaton = op5.Automaton({"idiot$": 1.0})
    one = math.log1p(1.0)
    assert automaton.features('she said "what an idiot" and left') == [0, one, 0, 0]
    assert automaton.features("what an idiot, don't you think it's so") == [one, 0, 0, 0]
    assert automaton.features("„Idoit idioot“ he wrote") == [0, 0, 0, one]
    assert automaton.features(None) == automaton.features("") == automaton.features("clean words") == [0.0] * 4


def test_toxicity(spark):
    rng = np.random.default_rng(12)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = prose(40, rng).split()
        if toxic:
            for bad in rng.choice(["wretchid", "scumbag", "qlowzz" + prose(1, rng)], 2):
                words.insert(rng.integers(0, 40), bad)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = op5.learn(frame, spark.createDataFrame([*labels, (5_000, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    assert set(model.lexicon) >= {"wretchid$", "scumbag$"}
    probe = [(1, "you " + prose(20, rng) + " scumbag"), (2, prose(30, rng)), (3, None), (4, ""), (5, "such a wretchidd " + prose(9, rng)), (6, prose(30_000, rng) + " scumbag"), (2, prose(5, rng))]
    got = [(r["doc_id"], r["score"] >= 0.5) for r in op5.score_texts(spark.createDataFrame(probe, "doc_id long, text string").selectExpr("*", "'k' AS score"), model).collect()]
    assert sorted(got) == [(1, True), (2, False), (2, False), (3, False), (4, False), (5, True), (6, True)]
    none = op5.learn(frame, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert op5.score_texts(frame.limit(2), none).where("score < 0.5").count() == 2


def test_an_ordinary_word_beside_a_term_leaves_its_other_misspellings(spark):
    rng = np.random.default_rng(14)
    docs, labels = [], []
    for i in range(600):
        words = prose(40, rng).split()
        if i % 5 == 0:
            words[i % 40] = "wretchid" if i % 2 else "wretchad"
            words[i % 37] = "scumbags" if i % 3 else "scumbagger"
        elif i % 5 == 1:
            words[i % 40] = "wretched"  # an ordinary word one edit away from both
        elif i % 5 == 2:
            words[3:6] = ['"the', "wrretchid", 'said"']
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    model = op5.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    automaton = op5.Automaton(model.lexicon, model.innocent)
    assert "wretched" in model.innocent and "wrretchid" not in model.innocent
    assert [automaton.match(w)[0] for w in ("wretchid", "wretched", "wretchidd", "wrretchid", "scumbags", "scubmbags")] == [1, 0, 2, 2, 1, 2]
    assert any(not t.endswith("$") and "scumbags".startswith(t) for t in model.lexicon)
    texts = ["you wretchidd " + prose(9, rng), prose(9, rng) + " a wretched day", prose(5, rng) + ' "the wrretchid said" ' + prose(5, rng), "you scubmbags " + prose(9, rng)]
    rows = op5.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert [r["score"] >= 0.5 for r in sorted(rows)] == [True, False, False, True]


# -- 6


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a b\t\nc ", "a b c", "\x0b\x0cx\ry"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(op6.n_words(__import__("pyspark").sql.functions.col("text"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def filled(sizes, weights, share=1.5, limit=2.0):
    """Targets by repeated resharing of what lies above the limits."""
    targets, left, free = {}, sum(sizes.values()) * share, set(sizes)
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] >= sizes[s] * limit}
        if not over:
            return targets | {s: level * weights[s] for s in free}
        targets |= {s: sizes[s] * limit for s in over}
        left, free = left - sum(sizes[s] * limit for s in over), free - over
    return targets


def test_mixture(spark):
    rng = np.random.default_rng(21)
    sources = ["b", "a", None, "ä", "Z", "zero"]
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), sources[int(rng.integers(0, 5)) if i % 3 else 0], 7) for i in range(3000)]
    rows += [(4000, "", "zero", 7), (4001, None, "zero", 7), (None, "w w", "a", 7), (5, "w w w", "b", 7), (5, "w w w", "b", 7), (4002, "w " * 3000, "b", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    got = op6.mix_sources(frame).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled(dict(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["copies"] <= 2 and r["taken"] == r["size"] * r["copies"]
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, op6.mix_sources(frame.repartition(9)).collect()))  # reruns agree
    assert op6.mix_sources(frame.limit(0)).collect() == []


def test_importance_raises_inclusion(spark):
    rows = [(i, "w w w", "only", 4.0 if i % 2 else 1.0) for i in range(4000)]
    got = op6.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, weight double"), share=0.3, importance="weight").collect()
    odd, even = (sum(r["copies"] for r in got if r["doc_id"] % 2 == k) for k in (1, 0))
    assert 3 < odd / even < 5.5


@pytest.mark.parametrize("module", [op6, op10])
def test_matches_sql(spark, module):
    assert difference(module.query(spark, SF), connect(SF), module.ORACLE) is None


# -- 7


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(3)
    words = np.arange(1, 41, dtype=np.uint64) * np.uint64(977)
    model = op7.Model(words, np.full(40, 50), words[:30], 2000, 40, np.zeros(op7.BUCKETS), np.zeros(op7.BUCKETS))
    trainer = op7.Trainer(model, 1)
    follow = rng.permutation(30)  # each class is followed by one other
    for _ in range(400):
        one = rng.integers(0, 30, 256)
        trainer.step(one, rng.integers(0, 30, 256), follow[one])
    scores = (trainer.r1[:30] + trainer.r2[3]) @ trainer.q.T + trainer.b
    chance = np.exp(scores - np.log(np.exp(scores).sum(axis=1, keepdims=True)))
    assert np.allclose(chance.sum(axis=1), 1, atol=1e-4) and np.mean(chance[np.arange(30), follow]) > 0.5


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(op7, "HEAD", 1500)  # most words take the joined way
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold)) + [None] for i, t in rows.items()}
    counts = Counter()
    for i, words in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(words)
    total, types = sum(counts.values()), len(counts)
    base = score = n = 0
    for r in op7.query(spark, SF).collect():
        words = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in words), rel_tol=1e-9)
        if r["held_out"]:
            base, score, n = base + r["base_score"], score + r["score"], n + 1
    assert n and score > base  # better than single words on held-out texts


def test_every_token_is_a_target_once():
    raw = [prose(n, np.random.default_rng(n)).encode() for n in (400, 0, 1, 700)]
    words, _, before = op7.token_rows(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    rounds = [op7.targets(words, before, turn) for turn in range(op7.ROUNDS)]
    assert np.sort(np.concatenate(rounds)).tolist() == list(range(len(words))) and all(len(r) > 400 for r in rounds)


def test_score_edges(spark):
    frame = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "a b", 3), (2, "", 3)], "doc_id long, text string, score int")
    model, tail = op7.count_corpus(frame.limit(0))
    model = op7.train(frame.limit(0), model)
    got = sorted(map(tuple, op7.score_texts(frame, model, tail).select("doc_id", "n_tokens", "n_known").collect()), key=repr)
    assert got == [(1, 1, 0), (2, 1, 0), (2, 1, 0), (None, 3, 0)]
    assert op7.score_texts(frame.limit(0), model, tail).collect() == []


# -- 10


def test_tool_calls(spark):
    calls = [(1, "a", 1, "t", '{"x":1,"s":"q"}', ["b"]), (1, "b", 2, "t", '{"x":1.5}', []), (1, "c", 0, "t", "[1]", ["a"]), (1, "d", 5, "u", '{"z":null,"a":{"k":1,"b":2}}', ["e", "zz"]),
             (1, "e", 4, "t", "{", ["d"]), (2, "a", 1, "t", '{"x":1,"s":"q"}', None), (2, None, 1, "t", '{"x":1,"s":"q"}', None), (3, "p", 1, "t", '{"x":true,"s":"q","y":0}', ["p"]),
             (3, "q", 1, "t", '{"s":"q","x":2}', ["r"]), (3, "r", 1, "t", '{"s":"q","x":2}', ["s"]), (3, "s", 9, None, None, []), (4, "w", 1, "t", None, None), (4, "w", 1, "t", None, None)]
    results = [(1, "a", 2, "late"), (1, "a", 1, "first"), (9, "n", 1, "lost"), (2, "a", 3, None), (3, "q", 2, "é\n")]
    tools = [("t", "x", "number", True), ("t", "s", "string", True), ("u", "z", "null", False), ("u", "a", "object", True)]
    frames = spark.createDataFrame(calls, op10.CALLS), spark.createDataFrame(results, op10.RESULTS), spark.createDataFrame(tools, "name string, parameter string, type string, required boolean")
    rows = op10.link(*frames).collect()
    got = {(r["conv_id"], r["call_id"]): (r["order_turn"], r["order_depth"], r["errors"]) for r in rows}
    lacks = ["arguments are no object", "missing parameter s", "missing parameter x"]
    assert got[1, "a"] == (2, 1, ["several results"]) and got[1, "b"] == (2, 0, ["no result", "missing parameter s"])
    assert got[1, "c"] == (2, 2, ["no result", *lacks])
    assert "cycle" in got[1, "d"][2] and "unknown dependency zz" in got[1, "d"][2] and "cycle" in got[1, "e"][2]
    assert got[2, "a"] == (1, 0, []) and got[2, None][2] == ["no identifier", "no result"]
    assert got[3, "p"][2] == ["no result", "cycle", "unknown parameter y", "wrong type x"]
    assert got[3, "q"] == (9, 2, []) and got[3, "r"] == (9, 1, ["no result"]) and got[3, "s"] == (9, 0, ["no result", "unknown tool", "arguments are no object"])
    assert got[4, "w"][2] == ["repeated identifier", "no result", *lacks] and len(rows) == len(calls) + 1
    assert got[9, "n"] == (1, 0, ["result without a call"])
    record = {(r["conv_id"], r["call_id"]): r["record"] for r in rows}
    assert record[1, "d"].startswith('{"arguments":{"a":{"b":2,"k":1},"z":null},"call_id":"d","conv_id":1,"depends_on":["e","zz"],"errors":[')
    assert record[3, "q"].endswith('"order":[9,2],"result":"é\\n"}')
    nothing = op10.link(frames[0].limit(0), frames[1].limit(0), frames[2].limit(0))
    assert nothing.collect() == []


def test_every_call_of_a_cycle_is_reported(spark):
    rng = np.random.default_rng(6)
    calls = [(1, f"a{i}", i, "t", "{}", [f"a{(i + 1) % 5}"]) for i in range(5)]  # a ring
    calls += [(1, "x", 9, "t", "{}", ["a0", "y"]), (1, "y", 3, "t", "{}", ["z"]), (1, "z", 20, "t", "{}", [])]  # behind the ring, on none
    calls += [(2, "m", 5, "t", "{}", ["n", "o"]), (2, "n", 7, "t", "{}", ["m"]), (2, "o", 1, "t", "{}", ["p"]), (2, "p", 8, "t", "{}", ["m"])]  # two rings that share a call
    calls += [(None, "s", 1, "t", "{}", ["u"]), (None, "u", 1, "t", "{}", ["s"])]
    for conv in range(3, 15):
        calls += [(conv, f"c{i}", int(rng.integers(6)), "t", "{}", [f"c{j}" for j in rng.choice(9, rng.integers(0, 3), replace=False)]) for i in range(9)]
    needs = {(c, i): [(c, d) for d in deps] for c, i, _, _, _, deps in calls}

    def reach(start):
        seen, todo = set(), list(needs[start])
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += needs[at]
        return seen

    wanted = {key for key in needs if key in reach(key)}
    found = op10.order_keys(spark.createDataFrame(calls, op10.CALLS)).where("cycle").collect()
    assert {(r["conv_id"], r["call_id"]) for r in found} == wanted and len(found) == len(wanted)
    assert {(1, f"a{i}") for i in range(5)} | {(2, k) for k in "mnop"} | {(None, "s"), (None, "u")} <= wanted and not {(1, "x"), (1, "y")} & wanted


def test_long_conversation_needs_no_rounds(spark):
    calls = spark.range(3000).selectExpr("1L AS conv_id", "concat('c', id) AS call_id", "id AS turn", "'t' AS name", "'{}' AS arguments", "array(concat('c', id - 1)) AS depends_on")
    assert op10.order_keys(calls).isEmpty()


def test_calls_out_of_messages(spark):
    said = [(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"t","arguments":{"x":1,"s":"é"},"depends_on":["b"]}]}'), (1, 1, "tool", '{"tool_call_id":"a","content":"42"}'), (1, 2, "assistant", "plain {text"), (1, 3, None, None)]
    calls, results = op10.from_messages(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    assert list(map(tuple, calls.collect())) == [(1, "a", 0, "t", '{"s":"é","x":1}', ["b"])] and list(map(tuple, results.collect())) == [(1, "a", 1, "42")]
