"""The language model against its definition, spelled out with dictionaries and loops."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string"


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))] + [b"\n"]


def spelled(word):
    return word if word == b"\n" else word + b" "


def language_states(words, pairs):
    seen, out = [0.0] * pairs.shape[1], []
    for k, w in enumerate(words):
        out.append(0 if k == 0 else 1 + int(np.argmax(seen)))
        for lang in range(pairs.shape[1]):
            seen[lang] += sum(pairs[(w[i - 1] if i else 0) * 256 + w[i], lang] for i in range(len(w)))
    return out


def level(n):
    return float(mixing.LEVELS[min(round(8 * math.log2(1 + n)), 255)])


def decisions(word, state):
    """(bit, bits before, the context of each predictor) of each decision."""
    s = spelled(word)
    for i, byte in enumerate(s):
        before = 1
        for k in range(8):
            bit = byte >> (7 - k) & 1
            yield bit, before, [(j, s[max(0, i - n) : i], state if stated else None, before) for j, (n, stated, _) in enumerate(mixing.PREDICTORS)]
            before = before * 2 + bit


def brute_scores(rows, model):
    """Scores of all rows, given the model's languages, weights and tables of fixed size."""
    counts = defaultdict(lambda: [0, 0])
    texts = {i: words_of(t) for i, t, _ in rows}
    states = {i: language_states(w, model.pairs) for i, w in texts.items()}
    for i, words in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w, state in zip(words, states[i]):
                for bit, _, ctx in decisions(w, state):
                    for c in ctx:
                        counts[c][bit] += 1
    known = {}

    def spell(word, state):
        if (word, state) not in known:
            total = 0.0
            for bit, before, ctx in decisions(word, state):
                x, gate = [], 0
                for j, c in enumerate(ctx):
                    n0, n1 = map(level, counts[c] if c in counts else (0, 0))
                    n = n0 + n1
                    x.append(math.log((n1 + 0.05) / (n0 + 0.05)) * (n / (n + 0.4)))
                    if j in mixing.GATED:
                        gate = gate * mixing.GATE + min(int(math.log2(n + 1)) // 2 + (n > 0), mixing.GATE - 1)
                mixed = min(max(sum(w * v for w, v in zip(model.weights[gate], x + [0.3])), -11.5), 11.5)
                place = min(max((mixed + 8) * (mixing.STEPS - 1) / 16, 0), mixing.STEPS - 1.001)
                low = int(place)
                curve = model.refine[before]
                p = (1 / (1 + math.exp(-mixed)) + curve[low] * (1 - (place - low)) + curve[low + 1] * (place - low)) / 2
                p = min(max(p, 1e-6), 1 - 1e-6)
                total += math.log10(p if bit else 1 - p)
            known[word, state] = total
        return known[word, state]

    return {i: brute_text(words, states[i], spell, set(zip(words, states[i])), model) for i, words in texts.items()}


def brute_text(words, state, spell, there, model):
    """Token by token; weights are updated after each ``STRIDE`` decisions."""
    total, last = 0.0, {}
    by_word, by_length = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    w, waiting = model.recall_weights.copy(), []
    for t, word in enumerate(words):
        own = spell(word, state[t])
        seen = last.get(words[t - 1]) if t else None
        if seen is not None:
            foreseen, length = words[seen], 1
            while length < mixing.LONGEST and seen > length and words[seen - 1 - length] == words[t - 1 - length]:
                length += 1
            cell = ((length - 1) * mixing.STATES + state[t]) * mixing.WIDTHS + min(len(foreseen), mixing.WIDTHS) - 1
            gate = (length - 1) * 4 + min(sum(by_word[words[t - 1]]), 3)
            x = [math.log((yes + 0.2) / (no + 0.8)) * ((no + yes) / (no + yes + 0.5)) for no, yes in (by_word[words[t - 1]], by_length[length], model.recall[cell])] + [0.3]
            p = 1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(w[gate], x)), -8), 8)))
            hit = word == foreseen
            if hit:
                own = math.log10(p)
            else:
                own += math.log10(1 - p)
                if (foreseen, state[t]) in there:
                    own -= math.log10(1 - 10 ** min(spell(foreseen, state[t]), -1e-6))
            by_word[words[t - 1]][hit] += 1
            by_length[length][hit] += 1
            waiting.append((gate, [(hit - p) * v for v in x]))
            if len(waiting) == mixing.STRIDE:
                for g in {g for g, _ in waiting}:
                    steps = [s for h, s in waiting if h == g]
                    w[g] += 0.3 * np.sum(steps, 0) / (len(steps) + 8)
                waiting = []
        if t:
            last[words[t - 1]] = t
        total += own
    return total


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("aeit") for _ in range(rnd.randint(1, 7))) for _ in range(14)] + ["Ab", "é"]
    phrase = " ".join(rnd.choice(vocabulary) for _ in range(9))
    return [(i, " ".join([rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))] + [phrase] * (i % 4)), "en" if i % 3 else "fr") for i in range(40)] + [(50, None, None), (51, "", "en"), (52, "zzz " * 40 + "new", "fr")]


def test_scores_equal_the_definition(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    with_flag = df.select("text", "lang", mixing.held_out(F.col("doc_id")).alias("held_out")).fillna("", ["text"])
    model, words = mixing.learn(with_flag, shard_words=5)
    assert model.recall.sum() > 0 and (model.weights != 0.3).any() and (model.recall_weights != 0.4).any()
    due = brute_scores(rows, model)
    own = scored_with(spark, df, model)
    monkeypatch.setattr(mixing, "learn", lambda *a: (model, words))
    got = {r["doc_id"]: r["score"] for r in mixing.score(df).collect()}
    # Slots that meet by chance are all that the definition doesn't have.
    for found in (own, got):
        assert set(found) == set(due)
        off = sorted(abs(found[i] - due[i]) / max(1, abs(due[i])) for i in due)
        assert off[len(off) // 2] < 1e-3 and off[-1] < 0.02, off


def scored_with(spark, df, model):
    """The operator's own functions with that model."""
    import pyarrow as pa

    from foldwise.llm import bytescan

    data = sorted((r["doc_id"], r["text"] or "") for r in df.collect())
    s = next(bytescan.slices(pa.array([t for _, t in data])))
    words, tokens, texts = mixing.Words.of(s)
    state = mixing.states(words, tokens, texts, model.pairs)
    both, back = np.unique(tokens * mixing.STATES + state, return_inverse=True)
    train = np.array([zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in data])
    c = np.bincount(back, train[texts], len(both))
    own = words.some(both // mixing.STATES)
    logp = model.log10(own, both % mixing.STATES, c)
    out = mixing.along(model, words, tokens, texts, state, both, logp, logp[back])
    return {i: x for (i, _), x in zip(data, np.bincount(texts, out, s.n))}


def test_order_and_repetition_count(spark):
    """Words in another order cost more where phrases repeat, and a repeated passage costs little."""
    rnd = random.Random(13)
    vocabulary = ["".join(rnd.choice("aeitrsnl") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(80)), "en") for i in range(60)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    mixed = passage * 4
    rnd.shuffle(mixed)
    free = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows += [(free[0], " ".join(passage * 4), "en"), (free[1], " ".join(mixed), "en"), (free[2], " ".join(passage), "en")]
    rows += [(i, " ".join((p := [rnd.choice(vocabulary) for _ in range(20)]) + p), "en") for i in range(60, 90)]
    got = {r["doc_id"]: r["score"] for r in mixing.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[free[0]] > 0.75 * got[free[1]] and got[free[0]] - got[free[2]] > 0.5 * (got[free[1]] - got[free[2]])


def test_repeated_rows_ties_and_languages(spark, rows):
    df = spark.createDataFrame([*rows, rows[3], rows[3], (None, "a b", None), (None, "a b", None), (7, "x" * 70_000, "en")], SCHEMA).withColumns({"chunk": F.lit("x"), "state": F.lit(1), "shard": F.lit(2), "recall": F.lit("y")})
    got = mixing.score(df, languages=1).collect()
    assert len(got) == len(rows) + 5
    same = [(r["score"], r["base_score"], r["n_tokens"]) for r in got if r["doc_id"] == rows[3][0]]
    assert len(same) == 3 and len(set(same)) == 1
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    low = {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in mixing.score(df, languages=0).collect()}
    assert low == {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in got}


def test_shards_count_deep_contexts_exactly():
    """A shard's own table holds what counting with a dictionary gives, but for slots that meet by chance."""
    rnd = random.Random(14)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 12))) for _ in range(200)]
    import pyarrow as pa

    from foldwise.llm import bytescan

    words, _, _ = mixing.Words.of(next(bytescan.slices(pa.array([" ".join(texts)]))))
    state, c = np.arange(len(words.size)) % 3, np.arange(len(words.size)) % 4.0
    table = mixing.Table(np.zeros(mixing.SLOTS, np.uint16)).of(words, state, c)
    due = Counter()
    stop = np.cumsum(words.size)
    raw = [words.data[a:b].tobytes() for a, b in zip(stop - words.size, stop)]
    for w, st, n in zip(raw, state, c):
        for i in range(mixing.DEEP, len(spelled(w))):
            for k in range(8):
                due[spelled(w)[:i], st, k, spelled(w)[i] >> (8 - k)] += n
    symbols, word, begin = words.spelled()
    deep = mixing.Deep(symbols, begin, mixing.deep_symbols(words))
    right = total = 0
    for k, bit, before, slots in mixing.bits_of(symbols, mixing.contexts(symbols, begin, state[word]), deep):
        for at in deep.where:
            w = spelled(raw[word[at]])
            i = at - begin[at]
            n = due[w[:i], state[word[at]], k, w[i] >> (8 - k)]
            x = table[slots[3][at]]
            got = mixing.LEVELS[x >> 8] + mixing.LEVELS[x & 255]
            total += 1
            right += abs(got - n) < 0.1 * n + 0.5
    assert total > 1000 and right > 0.8 * total


def test_shared_beginnings_are_asked_once(monkeypatch):
    """Words of one state that begin alike share their decisions; scores and what is learned are those of each word alone."""
    from types import SimpleNamespace

    import pyarrow as pa

    from foldwise.llm import bytescan

    rnd = random.Random(15)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(400)] + ["ab" * 14 + x for x in ("", "a", "bb")]
    words, _, _ = mixing.Words.of(next(bytescan.slices(pa.array([" ".join(texts)]))))
    n = len(words.size)
    state, c = np.arange(n) % 3, np.arange(n) % 4.0
    counts = mixing.packed(np.random.default_rng(0).integers(0, 60, (mixing.SLOTS, 2)))
    model = mixing.Model(counts, None, np.full((mixing.GATE**2, mixing.INPUTS), 0.2), np.random.default_rng(1).uniform(0.1, 0.9, (256, mixing.STEPS)))
    stop = np.cumsum(words.size)
    raw = [words.data[a:b].tobytes() for a, b in zip(stop - words.size, stop)]

    asked, bits_of = [], mixing.bits_of
    monkeypatch.setattr(mixing, "bits_of", lambda symbols, *a: asked.append(len(symbols)) or bits_of(symbols, *a))
    got = model.log10(words, state, c)
    column = [pa.array(np.zeros(n, np.int64)), pa.array(words.hash.view(np.int64)), pa.array(raw, pa.binary()), pa.array(state.astype(np.int32)), pa.array(c.astype(np.int64))]
    batch = pa.RecordBatch.from_arrays(column, ["shard", "h", "word", "state", "c"])
    learned = pa.Table.from_batches(mixing._learn(SimpleNamespace(value=counts))(iter([batch]))).to_pydict()
    slots = list(mixing._slot_counts(iter([batch.select(["h", "word", "state", "c"])])))

    def beginnings(which, length):  # and past that length the last bytes, for words of up to 24 bytes as they are
        return len({(state[k], spelled(raw[k])[max(0, i - length) : i + 1], min(i, length)) for k in which for i in range(len(spelled(raw[k])))})

    trained = [k for k in range(n) if c[k] > 0]
    assert asked == [beginnings(range(n), 24), *[beginnings(trained, 24)] * 2, beginnings(range(n), mixing.DEEP)]
    assert asked[0] < 0.6 * sum(len(spelled(w)) for w in raw)
    total = {}
    for b in slots:  # all masses, at the end of each part's bytes
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(b["counts"][0].as_py())
        total[b["part"][0].as_py()] = np.frombuffer(body, "<f4", len(body) // 8, len(body) // 2).sum()
    assert sum(total.values()) == 8 * sum(m * (len(s) * 3 + min(len(s), mixing.DEEP) * 2) for m, s in zip(c, map(spelled, raw)))

    symbols, word, begin = words.spelled()
    table = mixing.Table(counts).of(words, state, c)
    due = np.zeros(len(symbols))
    for _, bit, before, at in bits_of(symbols, mixing.contexts(symbols, begin, state[word]), mixing.Deep(symbols, begin, mixing.deep_symbols(words))):
        p = model.refined(model.mixed(*mixing.inputs(table, at, None)), before)
        due += np.log10(np.where(bit, p, 1 - p))
    assert np.allclose(got, np.bincount(word, due, n), rtol=1e-9)

    monkeypatch.setattr(mixing, "KEPT", 0)  # as in very large shards
    assert (model.log10(words, state, c) == got).all()
    again = pa.Table.from_batches(mixing._learn(SimpleNamespace(value=counts))(iter([batch]))).to_pydict()
    assert again == learned


def test_frequent_words_skip_the_join(spark, rows):
    """A table of all words, of a few, of some that meet in its slots, or none: the scores stay; only the rest is joined."""
    from types import SimpleNamespace

    import pyarrow as pa

    df = spark.createDataFrame(rows, SCHEMA)
    whole, none, few = ({r["doc_id"]: tuple(r) for r in mixing.score(df, **x).collect()} for x in ({}, {"most_frequent": 0}, {"most_frequent": 20, "slots": 8}))
    assert whole == none == few and len(whole) == len(rows)

    t = pa.table({"h": pa.array(range(40), pa.int64()), "state": pa.array([1] * 40, pa.int32()), "own": [1, 2] * 20, "c": range(40), "logp": [-x / 7 for x in range(40)]})
    often = mixing.Frequent.of(t, 16)
    key = mixing._key(np.arange(40, dtype=np.uint64), np.ones(40, np.int64))
    at = often.slot(key)
    there = np.flatnonzero(often.key[at] == key)
    assert len(there) == len(set(at)) and (often.c[at[there]] == there).all() and (often.logp[at[there]] == -there / 7).all()
    assert all(max((1, 2)[i % 2] for i in np.flatnonzero(at == at[k])) == (1, 2)[k % 2] for k in there)
    free = np.setdiff1d(np.arange(16), at)
    assert (often.slot(often.key[free]) != free).all()

    df = spark.createDataFrame([(i, 1, n, n, -1.0) for i, n in enumerate([0, 1, 1, 1, 5, 9, 9, 40])], "h bigint, state int, own bigint, c bigint, logp double")
    assert [mixing.frequent(df, n).num_rows for n in (0, 1, 2, 3, 4, 6, 7, 99)] == [0, 1, 1, 3, 4, 4, 7, 7]

    words, _, _ = mixing.Words.of(next(mixing.bytescan.slices(pa.array(["a b c a"]))))
    batch = pa.RecordBatch.from_arrays([pa.array([3]), pa.array([1]), pa.array([False]), pa.array(["a b c a"])], ["chunk", "doc_id", "held_out", "text"])
    held = pa.table({"h": pa.array(words.hash[1:3].view(np.int64)), "state": pa.array([0, 1], pa.int32()), "own": [1, 1], "c": [1, 1], "logp": [-1.0, -1.0]})
    model = mixing.Model(None, np.zeros((65536, 1)), None, None)
    got = {(h, s) for b in mixing._chunk_words(SimpleNamespace(value=(model, mixing.Frequent.of(held, 1024))))(iter([batch])) for h, s in zip(b["h"].to_pylist(), b["state"].to_pylist())}
    signed = words.hash.view(np.int64).tolist()
    assert got == {(signed[3], 1), (signed[1], 1), (signed[0], 1)}  # c, the second a, and the end
