"""Near duplicates, decontamination and their helpers against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwise.llm import bytescan, decontam, neardup

WORDS = [f"{a}{b}{c}" for a in "kltmr" for b in ("ana", "obi", "ure", "esti") for c in ("ton", "vel", "", "mar")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(rnd, text, share):
    w = text.split()
    for i in rnd.sample(range(len(w)), max(1, int(len(w) * share))):
        w[i] = rnd.choice(WORDS) + "x"
    return " ".join(w)


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def one_slice(texts):
    return next(bytescan.slices(pa.array(texts, pa.string()), 1 << 30))


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_words_and_hashes(limit):
    texts = ["a bb  ccc", None, "", "\tbb\n", "ccc dd", "  ", "dd", "é bb\x0bA"]
    got = []
    for s in bytescan.slices(pa.array(texts, pa.string()), limit):
        start, end, owner = s.words()
        h = s.hashes(start, end)
        got += [(s.first + o, s.data[a:b].tobytes().decode(), int(x)) for a, b, o, x in zip(start, end, owner, h)]
    assert [(o, w) for o, w, _ in got] == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    by_word = {}
    for _, w, h in got:
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_probability_jaccard_and_its_estimate():
    rnd = random.Random(1)
    a = prose(rnd, 300)
    texts = [a, edited(rnd, a, 0.03), edited(rnd, a, 0.2), prose(rnd, 300), a + " " + a]
    s = one_slice(texts)
    own, keys, weights, _, _ = neardup.shingles(s)
    sig = neardup.prob_min_hash(own, keys, weights, s.n)
    sets = [(keys[own == i], weights[own == i]) for i in range(s.n)]
    for i in range(s.n):
        for j in range(s.n):
            x, y = dict(zip(*sets[i])), dict(zip(*sets[j]))
            union = set(x) | set(y)
            true = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in union) for d in set(x) & set(y))
            assert neardup.probability_jaccard(*sets[i], *sets[j]) == pytest.approx(true)
            assert abs((sig[i] == sig[j]).mean() - true) < 0.2
            assert neardup.plain_jaccard(sets[i][0], sets[j][0]) == pytest.approx(jaccard(texts[i], texts[j]))


def groups_of(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, keys string, band int")
    return {r["doc_id"]: r for r in neardup.groups(df, **settings).collect()}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(7)
    texts = []
    for n in (30, 80, 200):
        base = prose(rnd, n)
        texts += [base, base, base.upper()] + [edited(rnd, base, s) for s in (0.005, 0.01, 0.02, 0.04, 0.1)]
    passage = prose(rnd, 60)
    texts += [passage + " " + prose(rnd, 25) for _ in range(12)] + [prose(rnd, 100) for _ in range(8)] + ["", "", None, "one two", "one two", "?!"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    for all_pairs in (64, 2):
        got = groups_of(spark, rows, all_pairs=all_pairs)
        assert len(got) == len(texts)
        parent = list(range(len(texts)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(texts)):
            for j in range(i):
                a, b = texts[i] or "", texts[j] or ""
                if (a.lower() == b.lower()) or (len(a) > 4 and len(b) > 4 and jaccard(a, b) >= 0.8):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
        for i in range(len(texts)):
            assert got[i]["group_id"] == find(i), (i, texts[i])


def test_near_duplicates_edges(spark):
    a = prose(random.Random(3), 50)
    rows = [(1, a), (1, a), (None, a), (2, a + " more"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"_gone": F.lit(1), "id": F.lit(2), "_group": F.lit("x")})
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["group_id"] or 0) for r in neardup.groups(df).collect())
    assert got == [(False, 0, 0), (True, 1, 1), (True, 1, 1), (True, 2, 1), (True, 3, 3)]
    kept = sorted(((r["doc_id"] or 0) for r in neardup.keep(df).collect()))
    assert kept == [0, 1, 3]
    assert neardup.groups(df.where("false")).count() == 0


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_brute_force():
    rnd = random.Random(5)
    pairs = [([rnd.randrange(6) for _ in range(rnd.randint(1, 12))], [rnd.randrange(6) for _ in range(rnd.randint(1, 25))]) for _ in range(60)]
    got, _, _ = decontam.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert got.tolist() == [smith_waterman(a, b) for a, b in pairs]


def test_contamination(spark):
    rnd = random.Random(11)
    items = [prose(rnd, n) for n in (40, 25, 60)] + ["two words", None]
    half = " ".join(items[2].split()[:40])
    docs = [prose(rnd, 50) + " " + items[0].upper() + ". " + prose(rnd, 80), prose(rnd, 20) + "\n" + edited(rnd, items[1], 0.16), "é! " + half + " " + prose(rnd, 30), prose(rnd, 400), None, "", "two words"]
    docs += [items[0]] * 30  # an item that leaked often keeps its seeds
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for block_bytes in (1 << 20, 100):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b, block_bytes=block_bytes).collect()}
        assert set(got) == {(0, 0), (1, 1), (2, 2), *((i, 0) for i in range(7, 37))}
    r = got[0, 0]
    assert r["score"] == 1 and docs[0][r["start_char"] : r["end_char"]] == items[0].upper()
    assert docs[2][got[2, 2]["start_char"] :].startswith(half[:20])
    assert sorted(r["doc_id"] for r in decontam.keep(d, b).collect()) == [3, 4, 5, 6]
    assert decontam.keep(d, b).columns == d.columns
    assert decontam.contaminated(d.where("false"), b).count() == 0 and decontam.contaminated(d, b.where("false")).count() == 0


def test_every_edited_or_partial_copy_is_found():
    """Also where the item leaks verbatim elsewhere, and its broken grams are in no document."""
    rnd = random.Random(29)
    items, docs, due = [], [], set()
    for i in range(60):
        items.append(prose(rnd, rnd.choice((20, 40, 80))))
        w = items[i].split()
        for copy in (edited(rnd, items[i], 0.25), edited(rnd, items[i], 0.33), " ".join(w[: len(w) * 45 // 100])):
            passage = decontam_share(w, copy.split())
            if passage >= decontam.THRESHOLD and any(w[k : k + 3] == copy.split()[j : j + 3] for k in range(len(w) - 2) for j in range(len(copy.split()) - 2)):
                due.add((len(docs), i))
            docs.append("front " * 3 + copy + " back" * 3)
    docs += items
    due |= {(180 + i, i) for i in range(60)}
    got = {r[:2]: r[2] for r in decontam.search(one_slice(docs), decontam.Items(list(range(60)), items), decontam.THRESHOLD)}
    assert len(due) > 200 and due <= set(got)
    assert all(got[d, i] == pytest.approx(decontam_share(items[i].split(), docs[d].split())) for d, i in due)


def decontam_share(item, passage):
    return smith_waterman(item, passage) / (2 * len(item))


def test_edited_copies_beside_verbatim_ones(spark):
    rnd = random.Random(31)
    items = [prose(rnd, n) for n in (20, 40, 80) * 4]
    w = [i.split() for i in items]
    docs = [prose(rnd, 30) + " " + e + " " + prose(rnd, 30) for i, x in zip(items, w) for e in (edited(rnd, i, 0.25), " ".join(x[-(-len(x) * 45 // 100) :]), " ".join(x[: -(-len(x) * 45 // 100)]), i)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()}
    assert {(k, k // 4) for k in range(48)} <= got


def brute_force_groups(texts, alike):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_links_inside_a_hot_template(spark):
    """Most pairs are just below the threshold, so leaders join little and buckets stay large and mixed."""
    rnd = random.Random(41)
    base = prose(rnd, 200).split()

    def changed(words, n):
        out = list(words)
        for i in rnd.sample(range(len(out)), n):
            out[i] = f"new{rnd.randrange(10**9)}"
        return out

    ones = [changed(base, 3) for _ in range(100)]
    texts = [" ".join(w) for w in ones + [changed(w, 3) for w in ones]]
    due = brute_force_groups(texts, lambda a, b: jaccard(a, b) >= 0.8)
    assert len(set(due)) > 40
    for all_pairs in (64, 2):
        got = groups_of(spark, [(i, t, "x", 1) for i, t in enumerate(texts)], all_pairs=all_pairs)
        assert [got[i]["group_id"] for i in range(len(texts))] == due


def test_plain_links_of_texts_with_repeated_lines(spark):
    """Plain Jaccard of 0.8 or more, far less by weight: what differs is a line that one text repeats."""
    rnd = random.Random(43)
    texts = []
    for _ in range(40):
        base, line = prose(rnd, 116), prose(rnd, 18)
        texts += [base + " " + prose(rnd, 4), base + " " + " ".join([line] * 200)]
    alike = [jaccard(a, b) for a, b in zip(texts[::2], texts[1::2])]
    assert min(alike) >= 0.8
    got = groups_of(spark, [(i, t, "x", 1) for i, t in enumerate(texts)])
    assert [got[i]["group_id"] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_a_large_group_that_holds_several_clusters(spark):
    """2,000 near copies of one template in clusters; small blocks, so that they meet in many cells."""
    rnd = random.Random(47)
    base = prose(rnd, 60).split()

    def changed(words, n):
        out = list(words)
        for i in rnd.sample(range(len(out)), n):
            out[i] = f"new{rnd.randrange(10**9)}"
        return out

    centres = [changed(base, 2) for _ in range(20)]
    texts = [" ".join(changed(rnd.choice(centres), rnd.randint(0, 1))) for _ in range(2000)]
    sets = [shingle_set(t) for t in texts]
    where = {}
    for i, x in enumerate(sets):
        for g in x:
            where.setdefault(g, []).append(i)
    index = {g: k for k, g in enumerate(where)}
    has = np.zeros((len(texts), len(index)), np.float32)
    for g, rows in where.items():
        has[rows, index[g]] = 1
    common = has @ has.T
    size = has.sum(1)
    alike = common >= 0.8 * (size[:, None] + size[None, :] - common) - 1e-3
    due = brute_force_components(alike)
    for settings in ({}, {"all_pairs": 20}):
        got = groups_of(spark, [(i, t, "x", 1) for i, t in enumerate(texts)], **settings)
        mine = np.array([got[i]["group_id"] for i in range(len(texts))])
        assert (mine == due).mean() >= 0.95
        linked = np.argwhere(np.triu(alike, 1))
        assert (mine[linked[:, 0]] == mine[linked[:, 1]]).mean() >= 0.999


def brute_force_components(alike):
    label = np.arange(len(alike))
    while True:
        low = np.where(alike, label[None, :], len(alike)).min(1)
        low = np.minimum(low, label)
        if (low == label).all():
            return label
        label = low


def test_long_texts_and_several_texts_under_one_id(spark):
    rnd = random.Random(53)
    long = prose(rnd, 60_000)
    rows = [(1, long), (2, long + " and more"), (3, prose(rnd, 40)), (3, prose(rnd, 40)), (3, None), (None, long), (None, None), (4, "!"), (4, "?"), (4, "!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"_words": F.lit(1), "class": F.lit("x"), "leader": F.lit(2)})
    got = {r["doc_id"]: r for r in neardup.groups(df).collect() if r["doc_id"]}
    assert got[2]["group_id"] == got[1]["group_id"] == 1 and got[3]["group_id"] == 3
    kept = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in neardup.keep(df).collect())
    assert kept == sorted([(0, len(long)), (0, 0), (1, len(long)), (3, len(rows[2][1])), (3, len(rows[3][1])), (3, 0), (4, 1), (4, 1)])
    assert neardup.keep(df).columns == df.columns


def test_short_items_and_scripts_without_spaces(spark):
    rnd = random.Random(59)
    kanji = "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(30))
    items = ["one two three four five", "alpha beta gamma", "no proof", kanji, kanji[:4]]
    docs = ["so: One, two three FOUR five!", "one two three four and five", "x alpha beta gamma y", "alpha beta", "no proof", "前" + kanji[:20] + "後", kanji[:3] + "x", "a" + kanji[:4] + "b"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b).collect()}
    assert set(got) == {(0, 0), (2, 1), (5, 3), (5, 4), (7, 4)}
    r = got[5, 3]
    assert docs[5][r["start_char"] : r["end_char"]] == kanji[:20] and r["score"] == pytest.approx(20 / 30)


def test_repeated_items_and_very_long_documents(spark):
    rnd = random.Random(61)
    item = prose(rnd, 30)
    docs = [prose(rnd, 150_000) + " " + item + " " + prose(rnd, 10), (item + " ") * 2000, prose(rnd, 50)]
    d = spark.createDataFrame([*enumerate(docs), (None, item), (2, docs[2])], "doc_id bigint, text string").withColumns({"score": F.lit("x"), "item_id": F.lit(3), "copies": F.lit(0)})
    b = spark.createDataFrame([(7, item), (7, item), (None, item), (8, item)], "item_id bigint, text string").withColumn("doc_id", F.lit("y"))
    for block_bytes in (1 << 20, 50):
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["item_id"] or 0) for r in decontam.contaminated(d, b, block_bytes=block_bytes).collect())
        assert got == sorted((i, k) for i in (-1, 0, 1) for k in (0, 7, 7, 8))
    assert sorted(r["doc_id"] for r in decontam.keep(d, b).collect()) == [2, 2]


def test_words_of_scripts_without_spaces():
    texts = ["ab漢字cd", "漢", "漢字", "a漢 字b", "é漢é", "", "かな x"]
    s = one_slice(texts)
    start, end, owner = s.words(bytescan.NOT_ALNUM, bytescan.UNSPACED)
    got = [(int(o), s.data[a:b].tobytes().decode()) for a, b, o in zip(start, end, owner)]
    assert got == [(0, "ab"), (0, "漢"), (0, "字"), (0, "cd"), (1, "漢"), (2, "漢"), (2, "字"), (3, "a"), (3, "漢"), (3, "字"), (3, "b"), (4, "é"), (4, "漢"), (4, "é"), (6, "か"), (6, "な"), (6, "x")]
