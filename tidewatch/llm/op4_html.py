"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is cut into tokens. A word scores by the elements it stands in, a tag scores below zero (little before words that surely are text); the contiguous run of tokens with
the largest sum, found in one linear scan, is the content region. Inside it, blocks of elements that never hold article text (menus, forms,
adverts, reader comments ...) are left out.

Weights come from labelled pages: pages with exactly one ``article`` or ``main`` element say themselves which words are content. Of at most about
PAGES of them (documented bound, taken by a hash of the id) Spark counts words inside and outside for every element name, class and id;
the log of the ratio is the weight; elements around an article count for its words too. A class or id that stands outside only (CLEAR words or more) and
on at most half of its pages around the article is learnt as one that never holds article text.

Names of classes and ids say what an element is, but also what stands beside it ("with-sidebar"). So html and body are never left out, nor are elements
for words after one of BESIDE, nor headings and sections of an article for their ids. A content element inside an element with such a name
is judged by score: it is text if its words outweigh all the page's other text, so a list of related posts goes and a wrapper's article stays.

Blocks: text between block-level tags or ``br``. Character references are decoded, white space becomes one space, blocks are trimmed and
joined by one space in page order. Inline tags don't part words. Elements named as content (``article``, ``main``, or such a class, id or role) score as text. An ``article`` or ``main`` start resets what outer elements say, so an unclosed
advert before it does no harm.

Edge cases: null or empty html gives empty text; broken tags, unclosed quotes, comments and scripts end at the end of the page; ties
between regions go to the first, then the longer one; repeated rows are each returned; without labelled pages the fixed lists decide; an empty table
gives an empty table; other columns pass through ``extract``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table, with_fields

PAGES = 2000
CLEAR = 50
TAG_SCORE, TEXT_TAG_SCORE = -1.0, -0.1  # of a tag before a word, and before a word that surely is text
SURE = 0.8
# Element names of HTML and what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("head title nav footer aside form button fieldset dialog menu header".split()) | RAW
WORDS = frozenset("""ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dropdown footer
form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond search share
sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget mainmenu topnav sitenav adbox adsense commentlist alert gdpr disclaimer copyright trending recommended""".split())
CONTENT = frozenset("article content main post entry story".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,400}+)>", re.S)
BESIDE = frozenset("no not with without has have".split())
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NONE = re.compile(r"display\s*:\s*none")
COUNTS = ("i", "o", "around", "pages", "wraps")
PART = re.compile(r"[a-z]+|[0-9]+")
HEADING = frozenset(f"h{i}" for i in range(1, 7))


def hidden(key: str, value: str) -> bool:
    return key == "hidden" or (key == "aria-hidden" and value.strip() == "true") or (key == "style" and bool(NONE.search(value))) or (key == "class" and "hidden" in value.split())


def named_aside(value: str) -> bool:
    """Whether a class or id names what never holds article text."""
    for word in value.split():
        for part in PART.findall(word):
            if part in BESIDE:
                break
            if part in WORDS:
                return True
    return False


class Element:
    __slots__ = ("name", "features", "outer", "hard", "aside", "wrapped", "final", "never", "article")

    def __init__(self, name: str, attributes: str, parent: Element | None, learnt: frozenset[str]):
        own = [name]
        hard = name in NEVER and name != "form"
        aside = name == "form"  # by its name; may be a wrapper
        starts = name in ("article", "main")
        page = name in ("html", "body")
        inside = parent is not None and (parent.article or parent.wrapped)
        anchor = inside and (name in HEADING or name == "section")
        if attributes and attributes.strip():
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), next((v for v in values if v), "").lower()
                hard |= hidden(key, value)
                if key not in ("class", "id", "role", "itemprop"):
                    continue
                features = [f"{key}={v}" for v in value.split()]
                own += features
                starts |= value == {"role": "main", "itemprop": "articlebody"}.get(key)
                if key == "role":
                    hard |= value in ROLES
                elif key != "itemprop":
                    starts |= name in ("div", "section", "td") and any(p in CONTENT for p in PART.findall(value))
                    if not (anchor and key == "id"):
                        aside |= named_aside(value)
                if not (anchor and key == "id"):
                    aside |= any(f in learnt for f in features)
        if page:
            hard = aside = False
        self.name = name
        starts &= not (hard or aside)  # "post-comments" holds comments
        if name == "header" and inside and not starts and not attributes.strip():
            hard = False  # an article's own heading
        reset = name in ("article", "main")
        outer = None if reset else parent
        self.hard = hard or (outer is not None and outer.hard)
        self.aside = aside or (outer is not None and outer.aside)
        # content inside an element that is named as none, and what is named so inside of that
        self.final = outer is not None and (outer.final or (aside and outer.wrapped))
        self.wrapped = outer is not None and not aside and not self.final and (outer.wrapped or (starts and outer.aside))
        self.never = self.hard or self.aside
        self.article = (starts and not self.aside) or (parent.article if parent else False)
        self.features = (frozenset(own) if reset or parent is None else parent.features | frozenset(own))
        self.outer = frozenset() if parent is None else parent.outer | parent.features if reset else parent.outer


def blocks(html: str, learnt: frozenset[str] = frozenset()) -> list[tuple[str, Element, int]]:
    """(text, element, tags since the last block) in page order; a last entry with empty text holds the closing tags."""
    out: list[tuple[str, Element, int]] = []
    root = Element("#", "", None, learnt)
    stack, text, tags, at, owner = [root], [], 0, 0, root

    def close() -> None:
        nonlocal tags
        joined = " ".join(unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append((joined, owner, tags))
            tags = 0

    while at < len(html):
        found = TOKEN.search(html, at)
        piece = html[at: found.start()] if found else html[at:]
        if piece:
            if not text:
                owner = stack[-1]
            text.append(piece)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        tags += 1
        if name not in INLINE:
            tag = tags
            tags = tag - 1
            close()
            tags += 1
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in ("article", "main", "body") and name in INLINE:
                    break
            continue
        if name not in INLINE:
            # what a new block ends by itself
            while len(stack) > 1 and (stack[-1].name in INLINE or stack[-1].name == "p" or (name == stack[-1].name and name in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                stack.pop()
        if name in RAW and not found[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name not in VOID and not found[3].rstrip().endswith("/"):
            stack.append(Element(name, found[3], stack[-1], learnt))
    close()
    out.append(("", root, tags))
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """First and end index of the contiguous run with the largest sum; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best or (total == best and span[0] == start and span[1] > 0):
            best, span = total, (start, i + 1)
    return span


class Weights:
    def __init__(self, weight: dict[str, float], never: frozenset[str]):
        self.weight, self.never = weight, never

    def word(self, element: Element) -> float:
        """Score of a word, -1 to 1: a word counts for the text unless its elements speak against it."""
        if element.never:
            return -0.05 if element.article else -1.0  # an advert inside an article doesn't end it
        if element.article:
            return 1.0
        return max(-1.0, min(1.0, 0.5 + sum(self.weight.get(f, 0.0) for f in element.features) / 8))

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        found = blocks(html, self.never)
        counts = [words.count(" ") + 1 if words else 0 for words, _, _ in found]
        wrapped = [element.wrapped and not element.hard for _, element, _ in found]
        if any(wrapped):
            other = sum(max(self.word(element), 0.0) * n for (_, element, _), n, w in zip(found, counts, wrapped) if not w)
            if sum(n for n, w in zip(counts, wrapped) if w) <= other:
                wrapped = [False] * len(found)
        scores: list[float] = []
        for (words, element, tags), n, inner in zip(found, counts, wrapped):
            score = 1.0 if inner else self.word(element)
            scores += [(TEXT_TAG_SCORE if words and (score >= SURE or element.article) else TAG_SCORE) * tags, score * n]
        first, end = region(scores)
        return " ".join(words for i, (words, element, _) in enumerate(found) if first <= 2 * i + 1 < end and words and (wrapped[i] or not element.never))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inside, outside, around, pages, wraps = (Counter() for _ in range(5))
        for html in batch.column(0).to_pylist():
            on, outer = set(), set()
            for words, element, _ in blocks(html):
                if words:
                    n = words.count(" ") + 1
                    features = (element.features - {"article", "main"}) | {"*"}
                    (inside if element.article else outside).update(dict.fromkeys(features, n))
                    on |= features
                    if element.article:
                        around.update(dict.fromkeys(element.outer - features, n))
                        outer |= element.outer
            pages.update(on | outer)
            wraps.update(outer)
        every = sorted(pages)
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([c[f] for f in every], pa.int64()) for c in (inside, outside, around, pages, wraps)]], names=["feature", *COUNTS])


def learn(pages: DataFrame) -> Weights:
    """Weights from the labelled pages of a bounded sample; one row per element name, class and id of the sample reaches the driver."""
    labelled = pages.where(F.regexp_count("html", F.lit("(?i)<(article|main)[\\s>]")) == 1).select("page_id", "url", "html")
    total = labelled.count()
    if not total:
        return Weights({}, frozenset())
    sample = labelled.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(min(1.0, PAGES / total) * (1 << 30)))
    rows = sample.select("html").mapInArrow(_count, f"feature string, {', '.join(f'{c} long' for c in COUNTS)}").groupBy("feature").agg(*[F.sum(c).alias(c) for c in COUNTS]).collect()
    words_in, words_out = (max([r[c] for r in rows if r["feature"] == "*"], default=1) + 1 for c in ("i", "o"))
    weight = {r["feature"]: max(-4.0, min(4.0, math.log((r["i"] + r["around"] + 1) / words_in) - math.log((r["o"] + 1) / words_out))) for r in rows if r["feature"] not in ("#", "*", "html", "body")}
    weight |= {"article": 4.0, "main": 4.0}
    never = frozenset(r["feature"] for r in rows if "=" in r["feature"] and r["o"] >= CLEAR and r["i"] == 0 and 2 * r["wraps"] <= r["pages"])
    return Weights(weight, never)


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """Input columns except html, plus text and n_chars."""
    given = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    pages = pages.select(*[f.name for f in given], "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [weights.text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=[*[f.name for f in given], "text", "n_chars"])

    return pages.mapInArrow(run, with_fields(given, "text string, n_chars long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages)).select("page_id", "url", "text", "n_chars")
