"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of blocks (text between the tags of block elements or line breaks) and of the tags before them.
Each word of a block scores the log odds that it is content, each tag a cost; one linear scan finds the contiguous run
of blocks with the largest sum. That run is the text, but for blocks inside it that stand in an element whose names
speak against content (an advert between paragraphs). Paragraphs, headings and list items next to the run (or to
such a block next to it) and in the element that holds it join it, so that a short last one is not lost.

The log odds of a word are a sum over features: the kind of its block (paragraph, heading, list, link, other), and the
tags and the words in class, id and role of all elements that it stands in; an element against content isn't helped by
what surrounds it. They are the weights of a logistic regression on labelled pages: those that mark their own content by
``<article>`` or ``<main>``; at most ``sample`` of them, picked by a hash of the id. Their prior means (``PRIORS``) stand
in for labels where there are none; labels may move any weight to any value. Costs of tags come from the same
regression, and are never positive.

Elements against content count as neutral where they hold the article or most of the page's words, as a form around the
whole page does. What a browser doesn't show (``HIDDEN``) is left out. All of it is linear in the size of the page.

Defined cases: null or empty html, or no words: an empty text. Unclosed tags, comments and scripts end as HTML says;
block elements end an open ``select`` or ``svg``. Equal rows give equal texts; an empty table stays empty; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.runtime import ship, table

SAMPLE = 2000
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^>"'])*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold text only, up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that a browser shows no text of, or that hold controls.
HIDDEN = frozenset("svg template noscript select object canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: These end an open svg, as in HTML.
BREAKS_OUT = CLOSES_P | frozenset("b big body br code dd dt em embed head i img li meta ruby s small span strong strike sub sup tt u var".split())
#: A start tag ends an open element of these names, up to the given borders.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("html body table td th caption button".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Prior means of the weights. A name alone in its attribute's value ("=notice") says more than as one of several words.
PRIORS: dict[str, float] = {"#p": 2.2, "#heading": 0.9, "#li": 0.2, "#other": 0.3, "#link": -1.7}
PRIORS |= dict.fromkeys("<nav <footer <aside <form <button <dialog <menu <head <header".split(), -4.0) | {"<header in": 0.5, "<article": 3.0, "<main": 3.0}
STRONG = (
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar rail footer masthead topbar cookie cookies consent gdpr "
    "newsletter subscribe signup comment comments disqus respond replies toolbar pagination pager copyright widget modal popup contentinfo complementary"
).split()
WEAK = "header banner notice notices alert overlay subscription login search share sharing social related recommended trending reply promotion buttons links posts articles stories".split()
CONTENT = "article main content post entry story body text".split()
PRIORS |= {f".{n}": -4.0 for n in STRONG} | {f".{n}": -1.5 for n in WEAK} | {f".{n}": 1.0 for n in CONTENT}
PRIORS |= {f"={n}": -2.5 for n in WEAK} | {f"={n}": 1.5 for n in CONTENT}
#: How far labels have to pull a weight from its prior, in blocks; passes over the labelled blocks.
PULL, PASSES = 20.0, 150
#: Prior mean of the cost of a tag.
TAG = -0.5


def names(attributes: str) -> list[str]:
    """The words in class, id and role, and the values of one word alone."""
    out: dict[str, None] = {}
    for groups in _NAMED.findall(attributes):
        for value in "".join(groups).lower().split():
            found = re.findall(r"[a-z]+", value)
            out.update(dict.fromkeys(f".{w}" for w in found))
            if len(found) == 1:
                out[f"={found[0]}"] = None
    return list(out)


class Page:
    """Elements (name, parent, last descendant, features) and blocks (element, text, words, words in links, tags before)."""

    def __init__(self, source: str):
        self.name, self.parent, self.last, self.features = ["#"], [-1], [0], [[]]
        self.blocks: list[tuple[int, str, int, int, list[str]]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, text, linked, tags, at, n = [0], [], 0, [], 0, len(source)
        opened: Counter[str] = Counter()
        paragraphs = [0]  # open ones in each open scope
        hidden = 0

        def pop(k: int) -> None:
            """Close the elements from place k of the stack on."""
            nonlocal hidden
            for e in reversed(stack[k:]):
                name = self.name[e]
                self.last[e] = len(self.name) - 1
                opened[name] -= 1
                hidden -= name in HIDDEN
                if name in SCOPE:
                    paragraphs.pop()
                if name == "p":
                    paragraphs[-1] -= 1
            del stack[k:]

        def pop_to(wanted, borders=()) -> None:
            if any(opened[w] for w in wanted):
                for k in range(len(stack) - 1, 0, -1):
                    name = self.name[stack[k]]
                    if name in wanted:
                        return pop(k)
                    if name in borders:
                        return None

        def words(raw: str) -> None:
            nonlocal linked
            if not hidden:
                text.append(raw)
                if opened["a"]:
                    linked += len(raw.split())

        def flush() -> None:
            nonlocal linked, text, tags
            own = " ".join(entities.unescape("".join(text)).split())
            if own:
                holder = stack[-1]
                while self.name[holder] in INLINE:
                    holder = self.parent[holder]
                self.blocks.append((holder, own, own.count(" ") + 1, linked, tags))
                tags = []
            text, linked = [], 0

        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                words(source[at:])
                break
            if m.start() > at:
                words(source[at : m.start()])
            at = m.end()
            name = (m[1] or m[3] or "").lower()
            if not name:
                continue
            closing = source[m.start() + 1] == "/"
            foreign = opened["svg"] > 0
            if foreign and not closing and name in BREAKS_OUT and not opened["foreignobject"]:
                pop_to({"svg"})
                foreign = False
            if opened["select"] and not closing and name in CLOSES_P and name != "hr":
                pop_to({"select"})
            if name == "br" or name not in INLINE:
                flush()
                tags.append("/" + name if closing else name)
            if closing:
                if name != "br":
                    pop_to({name})
                continue
            attributes = m[2] or m[4] or ""
            if name in RAW and not foreign:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if name in VOID or foreign and attributes.endswith("/"):
                continue
            if name in CLOSES_P and paragraphs[-1]:
                pop_to({"p"}, SCOPE)
            if name in IMPLIED:
                pop_to(*IMPLIED[name])
            inside = opened["article"] or opened["main"]
            self.name.append(name)
            self.parent.append(stack[-1])
            self.last.append(-1)
            own = [] if name in INLINE else ["<header in" if name == "header" and inside else "<" + name]
            self.features.append(own + names(attributes) if attributes and name not in INLINE and name not in ("html", "body") else own)
            stack.append(len(self.name) - 1)
            opened[name] += 1
            hidden += name in HIDDEN
            if name in SCOPE:
                paragraphs.append(0)
            elif name == "p":
                paragraphs[-1] += 1
        flush()
        pop(1)
        self.last[0] = len(self.name) - 1

    def upwards(self, own: list[float]) -> list[float]:
        """Sums over all descendants."""
        out = list(own)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def downwards(self, own: list[float]) -> list[float]:
        """Sums over all ancestors. Below 0, an element takes no more than 0 from those around it."""
        out = list(own)
        for e in range(1, len(out)):
            around = out[self.parent[e]]
            out[e] += around if own[e] >= 0 else min(around, 0.0)
        return out

    def words(self) -> list[float]:
        held = [0.0] * len(self.name)
        for e, _, n, _, _ in self.blocks:
            held[e] += n
        return self.upwards(held)

    def neutral(self) -> list[bool]:
        """Elements whose names can't speak against them: those that hold an article or most of the page's words."""
        held = self.words()
        articles = self.upwards([float(x in ("article", "main")) for x in self.name])
        return [x not in ("nav", "footer", "aside") and (a > (x in ("article", "main")) or 2 * h > held[0]) for x, a, h in zip(self.name, articles, held)]

    def kinds(self) -> list[str]:
        out = []
        for e, _, n, linked, _ in self.blocks:
            name = self.name[e]
            out.append("#link" if 2 * linked > n else "#heading" if name in HEADING else "#p" if name in ("p", "blockquote", "pre") else "#li" if name in ("li", "dd", "dt", "td", "th") else "#other")
        return out


class Weights:
    def __init__(self, words: dict[str, float], tags: dict[str, float]):
        self.words, self.tags = words, tags

    @staticmethod
    def learn(labelled: Iterable[str], pull: float = PULL, passes: int = PASSES) -> "Weights":
        """From pages whose <article> or <main> is their content, but for what stands in it under a name that the priors
        are sure about."""
        number: dict[str, int] = {k: i for i, k in enumerate(PRIORS)}
        feature, block, label = [], [], []
        for source in labelled:
            page = Page(source)
            inside = page.downwards([float(x in ("article", "main")) for x in page.name])
            free = page.neutral()
            against = page.downwards([0.0 if skip else float(any(PRIORS.get(f, 0) <= -4 for f in own)) for own, skip in zip(page.features, free)])
            chains: dict[int, tuple[int, ...]] = {}
            for (e, _, _, _, tags), kind in zip(page.blocks, page.kinds()):
                if e not in chains:
                    own: dict[int, None] = {}
                    x = e
                    while x > 0 and len(own) < 64:  # features of a label, not of a text: the nearest will do
                        if not free[x] or PRIORS.get("<" + page.name[x], 0) > 0:
                            own.update(dict.fromkeys(number.setdefault(f, len(number)) for f in page.features[x]))
                        x = page.parent[x]
                    chains[e] = tuple(own)
                good = inside[e] > 0 and not against[e]
                before = [number.setdefault("^" + t, len(number)) for t in tags]
                feature += [number[kind], *chains[e], *before]
                block += [len(label)] * (1 + len(chains[e]) + len(before))
                label.append(good)
        prior = np.array([PRIORS.get(k, TAG if k[0] == "^" else 0.0) for k in number])
        w = prior.copy()
        if label:
            f, b, y = np.array(feature), np.array(block), np.array(label, float)
            # Newton steps on the diagonal, damped by the largest number of features of a block.
            many = np.bincount(b).max()
            for _ in range(passes):
                p = 1 / (1 + np.exp(-np.clip(np.bincount(b, w[f], len(y)), -30, 30)))
                slope = np.bincount(f, (y - p)[b], len(w)) - pull * (w - prior)
                w += slope / (many * np.bincount(f, (p * (1 - p))[b], len(w)) + pull)
        learned = dict(zip(number, w.tolist()))
        return Weights({k: v for k, v in learned.items() if k[0] != "^"}, {k[1:]: min(0.0, v) for k, v in learned.items() if k[0] == "^"})

    def names(self, page: Page) -> list[float]:
        """The sum of the weights of all names around each block."""
        own = [sum(self.words.get(f, 0.0) for f in x) for x in page.features]
        total = page.downwards([max(o, 0.0) if skip else o for o, skip in zip(own, page.neutral())])
        return [total[b[0]] for b in page.blocks]

    def scores(self, page: Page, around: list[float]) -> tuple[list[float], list[float]]:
        """Of each block: the log odds of a word, and the sum over its words and the tags before it."""
        odds = [self.words[kind] + a for kind, a in zip(page.kinds(), around)]
        return odds, [b[2] * o + sum(self.tags.get(t, TAG) for t in b[4]) for b, o in zip(page.blocks, odds)]


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last index of the contiguous run with the largest sum, the first and shortest of equals."""
    best, found, total, begin = -math.inf, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i)
    return found


def extract(source: str | None, weights: Weights) -> str:
    page = Page(source or "")
    if not page.blocks:
        return ""
    around = weights.names(page)
    odds, scores = weights.scores(page, around)
    against = [a < 0 and o < 0 for a, o in zip(around, odds)]
    if all(against):
        return ""
    first, last = best_run(scores)
    if all(against[first : last + 1]):
        first = last = max(range(len(scores)), key=lambda i: (not against[i], scores[i], -i))
    # The smallest element with all of the run.
    low, high = min(b[0] for b in page.blocks[first : last + 1]), max(b[0] for b in page.blocks[first : last + 1])
    holder = page.parent[low] if page.name[low] not in ("article", "main") and low > 0 else low
    while not holder <= low <= high <= page.last[holder]:
        holder = page.parent[holder]
    kinds, held = page.kinds(), {b[0] for b in page.blocks[first : last + 1]}

    def joins(i: int) -> bool:
        e = page.blocks[i][0]
        return odds[i] > 0 and (e in held or kinds[i] in ("#p", "#heading", "#li") and holder <= e <= page.last[holder])

    def widened(at: int, step: int) -> int:
        """The end of the run, moved on over what joins it; past adverts and the like if an element holds the run."""
        i = at + step
        while 0 <= i < len(scores):
            if joins(i) and not against[i]:
                at = i
            elif not against[i] or page.name[holder] in ("#", "html", "body"):
                break
            i += step
        return at

    first, last = widened(first, -1), widened(last, 1)
    return "\n".join(page.blocks[i][1] for i in range(first, last + 1) if not against[i])


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    pages = pages.select("page_id", "html")
    marked = F.lower("html").rlike("<(article|main)[ >]")
    ids = pages.where(marked & F.col("page_id").isNotNull()).select(F.col("page_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = pages.join(F.broadcast(ids), F.col("page_id") == F.col("_id")).where(marked).select("html")  # at most ``sample`` ids
    return Weights.learn(r["html"] for r in islice(rows.toLocalIterator(), sample))


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, learn(pages))
