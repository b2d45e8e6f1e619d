"""BPE encoding and decoding: speculate, verify, and merge only where that fails.

A sequence of tokens is what merging yields exactly if each token comes out of merging its own bytes and each adjacent
pair stays apart when its joined bytes are merged. So greedy longest match proposes tokens for each new piece of a word;
all adjacent pairs of all proposals are tested at once by walking down the merge trees of both tokens (ids ascend with
merge rank); words with a failing pair are merged exactly.

Defined cases: null or empty text: no tokens and an empty decoded text; all else as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.llm import bytescan, wordbpe
from foldwise.runtime import ship, table

#: Stands for the end of a word inside this module; bytes are the characters below it.
STOP = "\u0100"
#: Words of up to so many characters are merged together, longer ones one by one.
SHORT = 64


def byte_characters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


class Speculative(wordbpe.WordBpe):
    def __init__(self, path: str):
        super().__init__(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.back = back = {ord(c): chr(b) for b, c in enumerate(chars)}

        def inner(token: str) -> str:
            return token[: -len(suffix)].translate(back) + STOP if suffix and token.endswith(suffix) else token.translate(back)

        self.suffix = STOP if suffix else ""
        self.shown = [""] * (1 + max([*model["vocab"].values(), *self.specials.values()]))
        for token, i in self.specials.items():
            self.shown[i] = token
        self.vocab: dict[str, int] = {}
        for token, i in model["vocab"].items():
            self.shown[i] = token
            self.vocab[inner(token)] = i
        self.longest = max(map(len, self.vocab))
        n = len(self.shown)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            whole = self.vocab[inner(a + b)]
            x, y = self.vocab[inner(a)], self.vocab[inner(b)]
            self.left[whole], self.right[whole] = x, y
            self.merged[x, y] = whole
        made = np.array(list(self.merged.values()))
        if (np.diff(made) <= 0).any() or (self.left[made] >= made).any() or (self.right[made] >= made).any():
            raise ValueError("the vocabulary's ids don't ascend with merge rank")
        keys = np.array([x * n + y for x, y in self.merged], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_whole = keys[order], made[order]
        # A token that merging its own characters does not yield must not be proposed.
        sound = self.left == np.arange(n)
        whole = np.sort(made)
        stays = dict(zip(whole.tolist(), self.apart(self.left[whole], self.right[whole], whole).tolist()))
        for w in whole.tolist():
            sound[w] = stays[w] and sound[self.left[w]] and sound[self.right[w]]
        self.proposable = {t: i for t, i in self.vocab.items() if sound[i]}

    def units(self, text: str) -> list[int]:
        """The tokens of single bytes; the last one holds the end of the word."""
        vocab = self.vocab
        if not text.endswith(STOP):
            return [vocab[c] for c in text]
        return [vocab[c] for c in text[:-2]] + [vocab[text[-2:]]]

    def merge(self, text: str) -> tuple[int, ...]:
        """Exact merging: the lowest-ranked adjacent pair first, the leftmost of equals. A heap of pairs over a linked
        list, so n log n in the length of the word."""
        ids, get = self.units(text), self.merged.get
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(w, i, ids[i], ids[i + 1]) for i in range(n - 1) if (w := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            whole, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # one side has been merged since
            ids[i], ids[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (w := get((whole, ids[k]))) is not None:
                    heapq.heappush(heap, (w, i, whole, ids[k]))
            if (p := before[i]) >= 0 and (w := get((ids[p], whole))) is not None:
                heapq.heappush(heap, (w, p, ids[p], whole))
        return tuple(i for i in ids if i >= 0)

    def merge_all(self, words: list[str]) -> list[list[int] | tuple[int, ...]]:
        """As ``merge`` of each word; all short words together, one merge of each word a round."""
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.merge(w)
        lists = [self.units(words[k]) for k in short]
        if not lists:
            return out
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for x in lists for i in x), np.int64, int(size.sum()))
        who = np.arange(len(lists))  # the words that go on, in order
        none = np.int64(1 << 60)

        def whole_of(x, y):
            key = x * len(self.shown) + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            return np.where(self.pair_keys[at] == key, self.pair_whole[at], none)

        last = np.cumsum(size) - 1
        rank = np.append(whole_of(ids[:-1], ids[1:]), none)
        rank[last] = none
        while len(who):
            first = last - size + 1
            best = np.minimum.reduceat(rank, first)
            over = best == none
            if over.any():
                for k, a, n in zip(who[over].tolist(), first[over].tolist(), size[over].tolist()):
                    out[short[k]] = ids[a : a + n].tolist()
                go = np.repeat(~over, size)
                ids, rank, who, size, best = ids[go], rank[go], who[~over], size[~over], best[~over]
                last = np.cumsum(size) - 1
                if not len(who):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            owner = np.searchsorted(last, hit)
            hit = hit[np.unique(owner, return_index=True)[1]]  # the leftmost of each word
            ids[hit] = best
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            place = hit - np.arange(len(hit))  # one element less for each word before
            ids, rank = ids[stay], rank[stay]
            size = size - 1
            last = np.cumsum(size) - 1
            is_last = place == last
            right = np.minimum(place + 1, len(ids) - 1)
            rank[place] = np.where(is_last, none, whole_of(ids[place], ids[right]))
            lead = place == last - size + 1
            left = place[~lead]
            rank[left - 1] = whole_of(ids[left - 1], ids[left])
        return out

    def apart(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | int = 1 << 40) -> np.ndarray:
        """Whether each pair stays apart when its joined bytes are merged, by merges of ranks under ``below`` only."""
        n = len(self.shown)
        ok = np.zeros(len(a), bool)
        a, b, row = a.copy(), b.copy(), np.arange(len(a))
        limit = np.broadcast_to(below, len(a)).copy()
        while len(row):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = (self.pair_keys[at] == key) & (self.pair_whole[at] < limit)
            a, b, row, limit = a[~joins], b[~joins], row[~joins], limit[~joins]
            # Undo the merge that came last; its token bounds what may merge across from now on.
            undo_a = a > b
            limit = np.where(undo_a, a, b + 1)
            na, nb = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            stuck_a, stuck_b = undo_a & (na == a), ~undo_a & (nb == b)
            na2 = np.where(stuck_b, self.right[a], na)
            nb2 = np.where(stuck_a, self.left[b], nb)
            limit = np.where(stuck_a, b + 1, np.where(stuck_b, a, limit))
            done = (stuck_a & (nb2 == b)) | (stuck_b & (na2 == a))
            ok[row[done]] = True
            go = ~done
            a, b, row, limit = na2[go], nb2[go], row[go], limit[go]
        return ok

    def decode(self, ids: list[int]) -> str:
        """The library's decoding without a decoder: the tokens as they stand in the vocabulary, joined by spaces."""
        return " ".join(map(self.shown.__getitem__, ids))

    def propose(self, text: str) -> list[int]:
        out, i, n, get = [], 0, len(text), self.proposable.get
        never = n - 1 if self.suffix else -1  # the end of a word is part of its last token
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if j != never and (t := get(text[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
        return out

    def words(self, piece: str) -> list[str]:
        """The words of one piece in this module's characters."""
        if wordbpe._UNUSUAL.search(piece):
            return [w.translate(self.back) + self.suffix for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
        return [w.encode().decode("latin-1") + self.suffix for w in self.cut.findall(piece)]

    def encode_new(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        mark = wordbpe.SPECIAL
        cut = [[] if p.startswith(mark) else self.words(p.decode()) for p in new]
        distinct = list(dict.fromkeys(w for x in cut for w in x))
        got = dict(zip(distinct, self.encode_words(distinct)))
        lists = [[int(p[len(mark) :])] if p.startswith(mark) else [i for w in x for i in got[w]] for p, x in zip(new, cut)]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, int(lens.sum())), lens

    def encode_words(self, words: list[str]) -> list[list[int] | tuple[int, ...]]:
        found: list = [self.propose(w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(found)), size)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        if len(pair):
            keys, back = np.unique(flat[pair] * len(self.shown) + flat[pair + 1], return_inverse=True)
            ok = self.apart(keys // len(self.shown), keys % len(self.shown))[back]
            failing = np.unique(owner[pair[~ok]]).tolist()
            for k, ids in zip(failing, self.merge_all([words[k] for k in failing])):
                found[k] = ids
        return found


_loaded: dict[str, tuple[Speculative, wordbpe.PieceTable]] = {}


def load(path: str) -> tuple[Speculative, wordbpe.PieceTable]:
    if path not in _loaded:
        bpe = Speculative(path)
        _loaded[path] = bpe, wordbpe.PieceTable(bpe.encode_new)
    return _loaded[path]


def _runs(path: str, batches: Iterator[pa.RecordBatch]):
    """The keys, all ids and the number of them of each text, and the coder, for runs of texts."""
    bpe, pieces = load(path)
    for batch in batches:
        keys, at = batch.column(0), 0
        for run in wordbpe.runs(batch.column(1)):
            flat, size = wordbpe.encoded(bpe, pieces, run)
            yield keys.slice(at, len(run)), flat, size, bpe
            at += len(run)


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, flat, size, bpe in _runs(path, batches):
            stops = np.concatenate([[0], np.cumsum(size)])
            column = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat.astype(np.int32)))
            texts = [bpe.decode(flat[a:b].tolist()) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
            yield pa.RecordBatch.from_arrays([keys, column, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids array<int> and decoded of each row of (doc_id, text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(bytescan.tidy(_coder(tokenizer or wordbpe.default_path())), "doc_id bigint, ids array<int>, decoded string")


def _digester(path: str):
    """As _coder, with digests in place of the lists and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        numeral: list[str] = []
        for keys, flat, size, bpe in _runs(path, batches):
            numeral = numeral or list(map(str, range(len(bpe.shown))))
            stops = np.concatenate([[0], np.cumsum(size)]).tolist()
            lists = [flat[a:b].tolist() for a, b in zip(stops, stops[1:])]
            a = [sha(" ".join(map(numeral.__getitem__, x))) for x in lists]
            b = [sha(bpe.decode(x)) for x in lists]
            yield pa.RecordBatch.from_arrays([keys, pa.array(map(len, lists), pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of (doc_id, text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(bytescan.tidy(_digester(tokenizer or wordbpe.default_path())), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
