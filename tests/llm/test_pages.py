"""Main text of pages: the run against brute force, names as features, HTML's own rules, hostile pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foldwise.llm import mainhtml


def brute_run(scores):
    sums = {(i, j): sum(scores[i : j + 1]) for i in range(len(scores)) for j in range(i, len(scores))}
    return min(sums, key=lambda r: (-sums[r], r[1], -r[0]))


def test_best_run_equals_all_runs():
    rnd = random.Random(3)
    for _ in range(300):
        scores = [rnd.randint(-9, 9) for _ in range(rnd.randint(1, 12))]
        i, j = mainhtml.best_run(scores)
        a, b = brute_run(scores)
        assert sum(scores[i : j + 1]) == sum(scores[a : b + 1]) and j == b


@pytest.fixture(scope="module")
def learned():
    body = "".join(f"<p>Some words of paragraph {i} that go on for a while.</p>" for i in range(6))
    page = f"<body><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><div class=ad>Buy this</div><article><h1>Head</h1>{body}</article><footer>Foot</footer>"
    return [mainhtml.Weights.learn([]), mainhtml.Weights.learn([page] * 300)]


CASES = {
    "<p>a b c d</p><select><option>x<p>rest of the page is here</p>": "a b c d\nrest of the page is here",
    "<p>one two three</p><svg><svg></svg>leak<title>t</title></svg><p>four five</p>": "one two three\nfour five",
    "<p>one two three</p><svg><g><p>four five</p>": "one two three\nfour five",
    "<div class='share-text'><p>A b c d e</p></div><div class='story-related'><p>more of it</p></div><div class=social-history><p>deep down</p></div>": "A b c d e\nmore of it\ndeep down",
    "<div><p>one two three four</p><div class=ad><p>Buy now you all</p></div><p>five six seven</p></div>": "one two three four\nfive six seven",
    "<form><div class=main-col><h1>T t</h1><p>words and words of it</p></div><div class=comments-area><p>hey you</p></div></form><div class=notice>notice this</div>": "T t\nwords and words of it",
    "<body class='sidebar-layout'><div class='with-sidebar'><p>all the words are in here</p></div><div class=sidebar><p>not these</p></div>": "all the words are in here",
    "<div class=entry>text one<br>text two<br>text three</div><div class='related-posts'><p>see this</p></div><div id=footer><p>me</p></div>": "text one\ntext two\ntext three",
    "<p>we say 1 &lt; 2 &amp;&amp; &#x41;  b<textarea><p>no</textarea><p>next one": "we say 1 < 2 && A b\nnext one",
    "<noscript><p>switch it on please</p></noscript><p>the real words here</p>": "the real words here",
    "<script>x": "", "": "",
}


@pytest.mark.parametrize("source", CASES)
def test_cases(source, learned):
    for weights in learned:
        assert mainhtml.extract(source, weights) == CASES[source]


def test_labels_can_turn_a_weight():
    """A name that the priors hold against content is content if the labelled pages say so."""
    page = "<div class=x><p>out words here</p></div><article><p>words</p><p class='promo-a'>in here too</p></article>" * 3
    weights = mainhtml.Weights.learn([page.replace("<div class=x>", "<div class=teaser>")] * 400)
    assert weights.words[".teaser"] + weights.words["=teaser"] < -1 and weights.words["<article"] > mainhtml.PRIORS["<article"]
    turned = mainhtml.Weights.learn(["<section class=share><p>a b c</p></section><main class=share><p>d e f</p></main><div class=odd><p>g h</p></div>"] * 400)
    assert turned.words[".odd"] < 0 < turned.words["<main"] and turned.words[".share"] > mainhtml.PRIORS[".share"]


@pytest.mark.parametrize("source", ["<div>" * 20_000 + "<p>deep text here</p>", "<p>" + "<b>" * 20_000 + "deep text here", "<div><p>x y z</p>" * 20_000, "<li><ul>" * 10_000 + "<p>deep text here", "</i>" * 50_000 + "<p>deep text here"])
def test_hostile_pages_in_time(source, learned):
    began = time.process_time()
    assert mainhtml.extract(source, learned[0])
    assert time.process_time() - began < 3


def test_repeated_rows_and_clashing_columns(spark):
    html = "<body><nav><a href=x>Home</a></nav><article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "u", html), (1, "u", html), (None, None, None), (2, "v", "<p>a b c</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "_id": F.lit(7)})
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in mainhtml.extract_pages(pages, mainhtml.learn(pages)).collect())
    assert got == [(0, 0), (1, 999_999), (1, 999_999), (2, 5)]
