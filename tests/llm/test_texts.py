"""Rules, classifier, chat, pages, language model and sharding."""

import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from foldwise.llm import chat, knquality, mainhtml, mixing, queries, rules, sharding

SF = "/root/testdata/sf0.001"


def prose(rnd, n):
    return " ".join(rnd.choice("the of and to".split()) if rnd.random() < 0.4 else "".join(rnd.choice(["an", "er", "ti", "on", "re", "st"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)) + "."


def brute_counts(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in (x or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), dup, len(covered)


def test_rules(spark):
    rnd = random.Random(1)
    line = prose(rnd, 12)
    noise = "".join(chr(rnd.randrange(33, 127)) for _ in range(9000))
    texts = [None, "", "a b", prose(rnd, 40), "\n".join([line] * 9), prose(rnd, 900), "é # | ü\n\n é # | ü", " ".join(noise[i : i + 9] for i in range(0, 9000, 9)), " ".join(w for x in prose(rnd, 60).split() for w in [x] * 30), "x" * 9000]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, ratio double")
    got = {r["doc_id"]: r for r in rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert [i for i in got if got[i]["kept"]] == [3, 5]
    assert not got[7]["base_failed"] and not got[8]["kept"]  # incompressible; repetitive
    kept = rules.keep(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5]
    assert rules.judge(df.where("false")).count() == 0


def brute_kn(train, text):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    unit = lambda t: ["\x02"] * 3 + list(re.sub(r"\d", "0", re.sub(r"[\x00-\x20]+", " ", t))) + ["\x03"]
    counts = [None] * 5
    counts[4] = Counter(tuple(u[i - 3 : i + 1]) for u in map(unit, train) for i in range(3, len(u)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k in range(1, 5):
        n = Counter(counts[k].values())
        n1, n2, n3, n4 = (n[i] for i in range(1, 5))
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
            discounts[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
        else:
            discounts[k] = [0.5, 0.75, 0.9]
    by_context = {}
    for k in range(1, 5):
        for g, c in counts[k].items():
            by_context.setdefault(g[:-1], []).append(c)

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        own = by_context.get(g[:-1])
        if not own:
            return lower
        d = lambda c: discounts[k][min(c, 3) - 1]
        c = counts[k].get(g, 0)
        return ((c - d(c) if c else 0) + sum(map(d, own)) * lower) / sum(own)

    u = unit(text)
    return sum(math.log2(p(tuple(u[i - 3 : i + 1]))) for i in range(3, len(u))), len(u) - 3


def test_kneser_ney_equals_its_definition(spark):
    rnd = random.Random(2)
    train = [prose(rnd, 40) for _ in range(30)] + ["", "12 ab\n\n34"]
    texts = [prose(rnd, 30), "", "zzz 999", "é\U0001f600 x", train[0]]
    df = spark.createDataFrame([(t,) for t in train], "text string")
    counts = df.mapInArrow(knquality._counts, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    from foldwise.runtime import ship

    ship(spark)
    scores = knquality.gram_scores(docs.select("text").mapInArrow(knquality._distinct, "g bigint").distinct(), counts)
    for way in (10**6, 0):
        for r in knquality.score(docs, scores, way, 3).collect():
            text = texts[r["doc_id"]].replace("\U0001f600", "\ud83d\ude00")
            logp, n = brute_kn(train, text)
            assert r["_n"] == n and r["_logp"] == pytest.approx(logp)


def test_classifier_keeps_clean_text(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = prose(rnd, 60) if good else " ".join(w + rnd.choice(["###", "$$$", "|"]) for w in prose(rnd, 60).upper().split())
        rows.append((i, text, "en" if i % 2 else None, "s", 5))
        if i % 8 < 6:
            labels.append((i, int(good)))
    rows += [(1000, None, "xx", None, None), (None, prose(rnd, 60), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _n int")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in knquality.keep(docs, lab, min_language=20).collect()}
    good = {i for i in range(400) if i % 4}
    assert len(kept & good) >= 0.98 * len(good) and not kept & (set(range(400)) - good) and None in kept
    assert knquality.keep(docs.where("false"), lab).count() == 0
    kept_all = knquality.keep(docs, lab.where("false"))
    assert kept_all.count() == len(rows) and kept_all.columns == docs.columns


def test_chat_round_trip(spark):
    said = ["plain", chat.EXTRA, "a\\b <| \\<|im_end|>\n\\n", None, "", "<", "|x", "\\" * 7]
    rows = []
    for tree in range(3):
        for i, t in enumerate(said):
            rows.append((tree, i + 1, i if i else None, ["user", "assistant", "odd\nrole<|\\n"][(i + tree) % 3], t, 1.0))
    rows += [(9, 1, None, "user", "root", 1.0), (9, 2, 1, "assistant", "short", 5.0), (9, 3, 1, "assistant", "long", 1.0), (9, 4, 3, "user", "longer", 1.0), (None, 1, 77, None, "orphan", None)]
    df = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    got = {r["tree"]: r for r in chat.format_chats(df).withColumn("read", chat.read_back(F.col("formatted"), F.col("turns"))).collect()}
    for tree in range(3):
        want = [(r[3], r[4] or "") for r in rows if r[0] == tree]
        assert [(t["role"], t["text"]) for t in got[tree]["read"]] == want
        assert [t["loss"] for t in got[tree]["read"]] == [x if role == "assistant" else None for role, x in want]
        text = got[tree]["formatted"]
        for span, (role, x) in zip(got[tree]["turns"], want):
            assert text[span["start"] : span["start"] + span["length"]].replace("<\\|", "<|").replace("\\\\", "\\") == x or "\\" in x
        assert text.count(chat.START) == len(want)
    assert [t["text"] for t in got[9]["read"]] == ["root", "short"]  # the branch with the larger score
    assert got[None]["n_turns"] == 1 and got[None]["read"][0]["role"] == ""
    both = chat.format_chats(df.where("tree = 9"), branches=5).collect()
    assert sorted((r["branch"], r["n_turns"]) for r in both) == [(1, 2), (2, 3)]
    assert chat.format_chats(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        chat.format_chats(spark.createDataFrame([(1, 1, 2, "u", "a", 1.0), (1, 2, 1, "u", "b", 1.0)], df.schema)).count()


def test_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"m{i}", 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    r = chat.format_chats(df).first()
    assert r["n_turns"] == 300 and [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["turns"]] == [f"m{i}" for i in range(300)]


def test_pages(spark):
    body = "<p>First para with several words here, really.</p><p>Short.</p><div class='ad'>Buy now!</div><p>Third &eacute;&nbsp;para <b>has</b>\n words.</p><ul><li>one thing</li></ul>"
    text = "Title of it\nFirst para with several words here, really.\nShort.\nThird é para has words.\none thing"
    layouts = [
        f"<html><head><title>t</title><script>var a='<p>';</script></head><body><header>Site</header><nav><a href=x>Home</a></nav><article><h1>Title of it</h1>{body}</article><aside>side</aside><section id=comments><p>I like it</p></section><footer>c</footer></body></html>",
        f"<body><div id='menu'><a href=x>Home</a></div><div class=content><h1>Title of it</h1>{body}</div><div class='sidebar'><p>Side words many many.</p></div><form>name</form></body>",
        f"<div class='cookie-notice'>We use cookies</div><main><h1>Title of it</h1>{body}</main><div class='comments'><p>me too</p></div>",
    ]
    rows = [(i, "u", h) for i, h in enumerate([*layouts, None, "", "<script>x", "<p>open <b>bold<p>next"])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in mainhtml.extract_pages(pages, mainhtml.learn(pages)).collect()}
    assert [got[i]["text"] for i in range(3)] == [text] * 3
    assert [got[i]["text"] for i in range(3, 7)] == ["", "", "", "open bold\nnext"] and got[0]["n_chars"] == len(text)
    assert mainhtml.best_run([-1, 2, -1, 3, -5, 4]) == (1, 3)
    assert mainhtml.extract_pages(pages.where("false"), mainhtml.learn(pages.where("false"))).count() == 0


def test_language_model(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, 80), "en", 1) for i in range(120)] + [(200, None, "en", 1), (201, "", None, 1), (None, "word", "en", 1), (202, "y" * 5000 + " z", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, chunk int")
    got = mixing.score(docs).collect()
    assert len(got) == len(rows)
    low = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"] for i, t, _, _ in rows}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in low}
    c = Counter(w for i, ws in low.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = low[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0 and math.isfinite(r["score"])
    out = [r for r in got if r["held_out"]]
    assert out and sum(r["score"] for r in out) / sum(r["n_tokens"] for r in out) > -4
    assert mixing.score(docs.where("false")).count() == 0


def test_bits_make_a_distribution():
    """The probabilities of all bytes after a context sum to 1."""
    import numpy as np

    model = mixing.Model(mixing.packed(np.random.default_rng(0).integers(0, 60, (mixing.SLOTS, 2))), np.zeros((65536, 1)), np.full((mixing.GATE**2, mixing.INPUTS), 0.2), np.random.default_rng(1).uniform(0.1, 0.9, (256, mixing.STEPS)))
    one = mixing.Words(np.arange(256, dtype=np.uint64), np.array([b for x in range(256) for b in (97, x)], np.uint8), np.full(256, 2))
    symbols, word, begin = one.spelled()
    second = np.flatnonzero(np.arange(len(symbols)) - begin == 1)
    total = np.zeros(len(symbols))
    for _, bit, before, slots in mixing.bits_of(symbols, mixing.contexts(symbols, begin, np.ones(len(symbols), np.int64))):
        x, gate = mixing.inputs(model.counts, slots, None)
        p = model.refined(model.mixed(x, gate), before)
        total += np.log(np.where(bit, p, 1 - p))
    assert np.exp(total[second]).sum() == pytest.approx(1, rel=1e-4)


def test_sharding(spark):
    shards = ["a", "b", "c"]
    t = sharding.lookup_table(shards, 101)
    assert max(Counter(t).values()) - min(Counter(t).values()) <= 1 and min(t) == 0
    # Brute force: one claim at a time.
    free, want, nxt = set(range(101)), [None] * 101, [0] * 3
    while free:
        for i, s in enumerate(shards):
            o, k = sharding.preferences(s, 101)
            while free and (slot := (o + nxt[i] * k) % 101) not in free:
                nxt[i] += 1
            if free:
                want[slot] = i
                free.discard(slot)
    assert t == want
    fewer = sharding.lookup_table(shards[:2], 101)
    assert sum(x != y for x, y in zip(t, fewer) if x < 2) < 30
    heavy = Counter(sharding.lookup_table(shards, 101, {"a": 3}))
    assert heavy[0] > 55
    df = spark.createDataFrame([(None, "x", 1), (5, "y", 2), (5, "y", 3)], "doc_id bigint, shard string, n int")
    got = sharding.place(df, "doc_id").collect()
    assert len(got) == 3 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert sharding.place(df.where("false"), "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).itertuples(index=False)))
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.sql(queries.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline(spark):
    import corpus_pipeline
    from foldwise.llm import bpe, decontam, neardup
    from foldwise.runtime import table

    docs = table(spark, SF, "documents")
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    clean = {r["doc_id"] for r in knquality.keep(docs, table(spark, SF, "labels")).collect()}
    judged = {r["doc_id"] for r in rules.judge(docs).where("kept").collect()}
    leaks = {r["doc_id"] for r in decontam.contaminated(docs, table(spark, SF, "benchmark")).collect()}
    group = {r["doc_id"]: r["group_id"] for r in neardup.groups(docs).collect()}
    left = clean & judged
    first = {}
    for i in sorted(left):
        first.setdefault(group[i], i)
    assert out == set(first.values()) - leaks
    assert len(corpus_pipeline.STAGES) == 5 and bpe


def test_chunks_follow_the_bytes_of_text(spark, monkeypatch):
    size = 30 * 10**9
    assert size / knquality.chunk_count(size, 64) <= knquality.CHUNK_BYTES and knquality.chunk_count(0, 100) == 100
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, "".join(rnd.choice("abc é") for _ in range(60))) for i in range(150)] + [(150, None)], "doc_id bigint, text string")
    grams = docs.select("text").mapInArrow(knquality._distinct, "g bigint").distinct()
    scores = grams.select("g", (-F.pmod("g", F.lit(97)) / 7.0).alias("logp"))
    asked = []
    count = knquality.chunk_count
    monkeypatch.setattr(knquality, "CHUNK_BYTES", 100)
    monkeypatch.setattr(knquality, "chunk_count", lambda *a: asked.append(count(*a)) or asked[-1])
    got = [sorted((r["doc_id"], r["_n"], round(r["_logp"], 6)) for r in knquality.score(docs, scores, n).collect()) for n in (10**9, 0)]
    assert got[0] == got[1] and len(got[0]) == 151
    assert len(asked) == 1 and asked[0] >= 90
