"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower case; in scripts without spaces, characters. All 3-word grams of a benchmark item are its seeds: an edited or
partial copy is found by whichever of them it still has. A pair whose passage has too few of the item's words to reach
the threshold, however they are ordered, is left out before the alignment; that drops nothing that could be reported.
A passage that shares a seed with an item is aligned with it: local alignment of words, match 2, mismatch -1, gap -1,
over the item's length with some slack around the seeds' diagonals. A document is contaminated by an item if the best
score is at least ``THRESHOLD`` of the item's own (a copy scores 1, one with a fifth of its words replaced about 0.7).

Benchmarks are taken in blocks of at most about ``BLOCK_BYTES`` of text, so what is sent to all tasks is bounded; each
block meets all documents. Results don't depend on the blocks. Documents are looked at in one pass with no shuffle.

Defined cases: null texts: empty. Items under ``MIN_WORDS`` words count only whole and word for word; those under three
words are no evidence and match nothing. Null item_id: kept as such. Repeated items: each reported, searched for once. Repeated documents: each reported. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.llm import bytescan
from foldwise.runtime import materialise, ship, table

GRAM, MIN_WORDS, THRESHOLD, BLOCK_BYTES = 3, 6, 0.4, 32 << 20
#: Aligned together: at most so many pairs, and so many cells of a row over all of them (or one pair).
PAIRS, CELLS = 256, 1 << 18
MATCH, MISMATCH, GAP = 2, 1, 1
SCHEMA = "doc_id bigint, item_id bigint, score double, start_char bigint, end_char bigint"


class Items:
    """Word hashes of a block of items, how often each is repeated, and its seeds: hash, item and word position."""

    def __init__(self, ids: list, texts: list[str], copies: list[int] | None = None):
        words, self.ids, self.copies = [], ids, copies or [1] * len(ids)
        for s in bytescan.slices(pa.array(texts, pa.string()), lower=True):
            start, end, owner = s.words(bytescan.NOT_ALNUM, bytescan.UNSPACED)
            h = s.hashes(start, end)
            cut = np.searchsorted(owner, np.arange(s.n + 1))
            words += [h[cut[i] : cut[i + 1]] for i in range(s.n)]
        self.words = words
        lens = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(words)), lens)
        keys, at = bytescan.window_hashes(flat, owner, GRAM)
        item = owner[at]
        order = np.argsort(keys, kind="stable")
        self.seed, self.item, self.place = keys[order], item[order], (at - (np.cumsum(lens) - lens)[item])[order]
        self.distinct, self.first = np.unique(self.seed, return_index=True)
        bits = max(10, int(64 * max(1, len(self.distinct)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.distinct >> self.shift).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a key is a seed, and the number of that seed."""
        if not len(self.distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.filter[(keys >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.distinct, keys[maybe]), len(self.distinct) - 1)
        hit = self.distinct[at] == keys[maybe]
        return maybe[hit], at[hit]


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair (item words, passage words): score, and the ends (exclusive) in a and b."""
    rows, cols, n = max(map(len, a)), max(map(len, b)), len(a)
    x, y = np.zeros((n, rows), np.uint64), np.ones((n, cols), np.uint64)
    inside_a, inside_b = np.zeros((n, rows), bool), np.zeros((n, cols), bool)
    for i, (p, q) in enumerate(zip(a, b)):
        x[i, : len(p)], y[i, : len(q)] = p, q
        inside_a[i, : len(p)], inside_b[i, : len(q)] = True, True
    step = GAP * np.arange(cols + 1, dtype=np.int32)
    h = np.zeros((n, cols + 1), np.int32)
    best, end_a, end_b = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in range(rows):
        same = (x[:, r, None] == y) & inside_b & inside_a[:, r, None]
        new = np.zeros_like(h)
        np.maximum(h[:, :-1] + np.where(same, MATCH, -MISMATCH).astype(np.int32), h[:, 1:] - GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + step, axis=1) - step  # gaps along the passage
        top = h.argmax(1)
        value = h[np.arange(n), top]
        better = (value > best) & inside_a[:, r]
        best[better], end_a[better], end_b[better] = value[better], r + 1, top[better]
    return best, end_a, end_b


def within_reach(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair, how many words of a are anywhere in b: no alignment of the pair has more matches."""
    salt = bytescan.mix(np.arange(1, len(a) + 1, dtype=np.uint64))
    of_a = np.repeat(np.arange(len(a)), list(map(len, a)))
    there = np.isin(np.concatenate(a) ^ salt[of_a], np.concatenate(b) ^ np.repeat(salt, list(map(len, b))))
    return np.bincount(of_a, there, len(a))


def search(s: bytescan.Slice, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first and last character (exclusive)) of each contaminated text of the slice."""
    start, end, owner = s.words(bytescan.NOT_ALNUM, bytescan.UNSPACED)
    h = s.hashes(start, end)
    keys, at = bytescan.window_hashes(h, owner, GRAM)
    where, seed = items.find(keys)
    if not len(where):
        return []
    # Each hit for every place of its seed.
    last = np.append(items.first[1:], len(items.seed))
    copies = last[seed] - items.first[seed]
    hit = np.repeat(np.arange(len(where)), copies)
    entry = np.repeat(items.first[seed], copies) + np.arange(len(hit)) - np.repeat(np.cumsum(copies) - copies, copies)
    word, item = at[where[hit]], items.item[entry]
    text, diagonal = owner[word], word - items.place[entry]
    size = np.array([len(w) for w in items.words])
    needed = np.where(size < MIN_WORDS, 1.0, threshold)
    slack = size // 4 + 4
    order = np.lexsort((diagonal, item, text))
    text, item, diagonal = text[order], item[order], diagonal[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[item[1:]])
    lead = np.flatnonzero(new)
    stop = np.append(lead[1:], len(order)) - 1
    t, m = text[lead], item[lead]
    n_words = np.bincount(owner, minlength=s.n)
    base = np.cumsum(n_words) - n_words
    lo = np.maximum(diagonal[lead] - slack[m], base[t])
    hi = np.minimum(diagonal[stop] + size[m] + slack[m], base[t] + n_words[t])
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    by_size = np.lexsort((hi - lo, size[m]))
    at = 0
    while at < len(by_size):
        group = by_size[at : at + PAIRS]
        cells = np.maximum.accumulate(hi[group] - lo[group]) * np.arange(1, len(group) + 1)
        group = group[: max(1, int(np.searchsorted(cells, CELLS, "right")))]
        at += len(group)
        reach = within_reach([items.words[m[k]] for k in group], [h[lo[k] : hi[k]] for k in group])
        group = group[reach >= needed[m[group]] * size[m[group]]]
        if not len(group):
            continue
        a, b = [items.words[m[k]] for k in group], [h[lo[k] : hi[k]] for k in group]
        best, end_a, end_b = align(a, b)
        share = best / (MATCH * size[m[group]])
        good = np.flatnonzero(share >= needed[m[group]])
        if not len(good):
            continue
        _, _, back = align([a[g][: end_a[g]][::-1] for g in good], [b[g][: end_b[g]][::-1] for g in good])
        for g, reach in zip(good, back):
            k = group[g]
            stop_word, first_word = lo[k] + end_b[g], lo[k] + end_b[g] - reach
            key, value = (int(t[k]), int(m[k])), (float(share[g]), int(first_word), int(stop_word))
            if key not in found or value[0] > found[key][0]:
                found[key] = value
    if not found:
        return []
    chars = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
    zero = chars[s.off[:-1]]
    return [(i, m, score, int(chars[start[a]] - zero[i]), int(chars[end[b - 1]] - zero[i])) for (i, m), (score, a, b) in sorted(found.items())]


def blocks(benchmark: DataFrame, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark as broadcast blocks of Items, one after the other."""
    spark = docs.sparkSession
    ship(spark)
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(rows.groupBy("item_id", "text").agg(F.count("*").alias("copies")), "items")  # each text of an id once
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()  # about block_bytes
        yield spark.sparkContext.broadcast(Items([r[0] for r in own], [r[1] for r in own], [r[2] for r in own]))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start_char, end_char): the best place of each item in each document that it contaminates."""

    def finder(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                ids = batch.column(0)
                for s in bytescan.slices(batch.column(1), lower=True):
                    rows = [r for r in search(s, items, threshold) for _ in range(items.copies[r[1]])]
                    if rows:
                        i, m, score, a, b = zip(*rows)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([s.first + x for x in i])), pa.array([items.ids[x] for x in m], pa.int64()), pa.array(score), pa.array(a, pa.int64()), pa.array(b, pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])

        return run

    out = None
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    for sent in blocks(benchmark, docs, block_bytes):
        part = rows.mapInArrow(finder(sent), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def keep(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, as they are."""
    where = docs.columns.index("text")

    def cleaner(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for s in bytescan.slices(batch.column(where), lower=True):
                    clean[[s.first + r[0] for r in search(s, sent.value, threshold)]] = False
                yield batch.filter(pa.array(clean))

        return run

    out = docs
    for sent in blocks(benchmark, docs, block_bytes):
        out = out.mapInArrow(cleaner(sent), docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
