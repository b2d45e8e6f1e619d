"""Language-model scoring by online logistic context mixing, in two stages.

Words. A text is its words (lower case for A-Z, cut at white space) and one end. A word is spelled byte by byte with a
closing space, the end is one line feed, and each byte is eight binary decisions. Five hashed-context predictors give
each bit a probability from counts of training text: the word so far with and without the language state, its last four
bytes, and its last two and three with the state. A mixer adds their stretched probabilities with weights from a gate
(how often the two deepest contexts were seen); a last stage refines the sum by what actually followed such sums after
the same first bits of the byte. The language state of a token is the language that explains the tokens before it best,
by byte pairs.

Texts. Along each text one more decision a token crosses words: is it the one that followed when the word before stood
in this text last? Its predictors count, online, how often that came true after this word in this text, and after
matches of this length in this text, and how often in training, by length of the match, language state and length of
the word. A gated mixer adds them; its weights start from training and are updated along the text, every ``STRIDE``
decisions. Hits cost that decision; else the word stage pays, over the words that are left. So repeated phrases and
passages become cheap, and the order of words counts.

Training is over all rows that are not held out. Words are counted by state in Spark. Counts of short contexts (up to
``DEEP`` bytes of a word, whose number saturates) go to tables of fixed size, sent to all tasks; they are summed by
parts, of which tasks send what isn't 0. Counts of longer beginnings of words grow with the corpus: words are dealt into
shards by their first ``DEEP`` bytes, so that all words that share such a context are in one shard, and a shard counts
them in a table sized by its own words. A word's own occurrence is taken off the counts while the mixer learns, so it
learns what unseen words look like. The mixers learn online, in each task over its share; tasks' weights are averaged by
mass.

For scoring, the words of all documents are spelled once for each state that they stand in. Documents are dealt into
chunks by a hash of their id; the distinct words of a chunk meet the global counts and log probabilities in a join, and
come back to the chunk. What the most frequent words would get there is in a table of fixed size, sent to all tasks; no
other table of words is broadcast or collected.

Defined cases: null or empty text: one end. Null doc_id: its crc32 is that of the empty text (training). Repeated rows:
each is counted and scored. No training tokens: counts are 0 and every bit has probability 1/2; base_score is null. An
empty table stays empty. Where a word that was foreseen has no probability in the state at hand, the others don't share
it out, so a score is never too high.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.llm import bytescan
from foldwise.runtime import materialise, ship, table

PARTS, LANGUAGES, GATE, STEPS = 256, 7, 6, 33
#: The predictors: how many bytes of the word before, whether the language state counts, and bits of slots.
PREDICTORS = ((24, False, 20), (2, True, 19), (4, False, 22), (24, True, 21), (3, True, 21))
DEEP = 4  #: Longer beginnings of words are counted in their shard.
FIRST = np.concatenate([[0], np.cumsum([1 << b for _, _, b in PREDICTORS])]).tolist()
GATED = (2, 3)  # the predictors whose counts make the gate
WHOLE, LAST = 3, 2  # the predictors whose context (and state) fixes those of all others, and those up to DEEP bytes
SLOTS = FIRST[-1]
INPUTS = len(PREDICTORS) + 1  # and a constant
CLOSE, END = 0x20, 0x0A
CHUNK_BYTES, TEXT_BYTES = 8 << 20, 2 << 20
SHARD_WORDS = 2048
#: Symbols that are spelled at once, for the shared slots, and of the largest shard that is kept spelled.
RUN, SHORT_RUN, KEPT = 20_000, 60_000, 1_000_000
#: Most frequent words by state that skip the join, at most, and the slots of their table.
FREQUENT, FREQUENT_SLOTS = 1 << 18, 1 << 19
#: Rows that the language states are fitted on, at most.
LABELLED = 20_000
#: Of the stage over texts: longest match, states and word lengths of its table, gates, inputs, decisions between updates.
LONGEST, STATES, WIDTHS, RECALL_GATES, RECALL_INPUTS, STRIDE = 3, 16, 8, 12, 4, 32
RECALL_CELLS = LONGEST * STATES * WIDTHS
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: For each state of the bits of a byte, what it adds to the hash of a context.
_BEFORE = np.arange(256, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) * _STEP


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


#: Counts are sent in a byte each, in eighths of powers of two; small ones are exact to a few percent.
LEVELS = (2.0 ** (np.arange(256) / 8) - 1).astype(np.float32)


def packed(counts: np.ndarray) -> np.ndarray:
    """(n, 2) counts as one number a slot."""
    level = np.minimum(np.rint(8 * np.log2(1 + counts)), 255).astype(np.uint16)
    return level[:, 0] * np.uint16(256) + level[:, 1]


def _responses() -> tuple[np.ndarray, np.ndarray]:
    """For each packed pair of counts, as it is (row 0) and with one 0 or one 1 taken off (rows 1 and 2): the stretched
    prediction, and how often the slot was seen, in GATE steps."""
    n0, n1 = np.repeat(LEVELS.astype(np.float64), 256), np.tile(LEVELS.astype(np.float64), 256)
    x, seen = [], []
    for a, b in ((n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))):
        total = a + b
        x.append(np.log((b + 0.05) / (a + 0.05)) * (total / (total + 0.4)))
        seen.append(np.minimum(np.log2(total + 1).astype(np.int64) // 2 + (total > 0), GATE - 1))
    return np.concatenate(x).astype(np.float32), np.concatenate(seen).astype(np.int8)


RESPONSE, SEEN = _responses()


@dataclass
class Words:
    """Distinct words: hash, and their bytes one after the other."""

    hash: np.ndarray
    data: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(s: bytescan.Slice) -> tuple["Words", np.ndarray, np.ndarray]:
        """The distinct words of a slice (the end first), the number of each token's word, and its text; ends included."""
        start, end, owner = s.words()
        h = s.hashes(start, end, bytescan.LOWER)
        back, u = pd.factorize(h)  # in order of first appearance
        first = np.zeros(len(u), np.int64)
        first[back[::-1]] = np.arange(len(h))[::-1]
        size = (end - start)[first]
        at = np.repeat(start[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        data = np.concatenate([np.array([END], np.uint8), bytescan.LOWER[s.data[at]]])
        tokens, texts = np.concatenate([back + 1, np.zeros(s.n, np.int64)]), np.concatenate([owner, np.arange(s.n)])
        order = np.argsort(texts, kind="stable")  # the end comes after the words
        return Words(np.concatenate([[np.uint64(0)], u]), data, np.concatenate([[1], size])), tokens[order], texts[order]

    def some(self, which: np.ndarray) -> "Words":
        first, size = (np.cumsum(self.size) - self.size)[which], self.size[which]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Words(self.hash[which], self.data[at], size)

    def runs(self, symbols: int) -> Iterator[tuple[int, int, "Words"]]:
        """Runs of words of about so many symbols, or one word: from, to and the words."""
        stop = np.cumsum(self.size)
        a = 0
        while a < len(self.size):
            before = stop[a] - self.size[a]
            b = max(a + 1, int(np.searchsorted(stop + np.arange(1, len(stop) + 1) - a, before + symbols, "right")))
            yield a, b, Words(self.hash[a:b], self.data[before : stop[b - 1]], self.size[a:b])
            a = b

    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols, the number of each one's word, and where that word starts."""
        stop = np.cumsum(self.size)
        close = np.ones(len(self.size), np.int64)
        is_end = (self.size == 1) & (self.data[stop - 1] == END)
        close[is_end] = 0
        symbols = np.full(int(self.size.sum() + close.sum()), CLOSE, np.uint8)
        begin = np.cumsum(self.size + close) - (self.size + close)
        symbols[np.repeat(begin - (stop - self.size), self.size) + np.arange(len(self.data))] = self.data
        word = np.repeat(np.arange(len(self.size)), self.size + close)
        return symbols, word, begin[word]


def contexts(symbols: np.ndarray, begin: np.ndarray, state: np.ndarray, some: np.ndarray | None = None, which=range(len(PREDICTORS))) -> list[np.ndarray]:
    """For each of those predictors the hash of its context of each symbol, or of some."""
    s = bytescan.Slice(symbols, np.array([0, len(symbols)]), 0)
    at = np.arange(len(symbols)) if some is None else some
    begin = begin if some is None else begin[some]
    out = []
    with np.errstate(over="ignore"):
        other = state.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for k in which:
            length, stated, _ = PREDICTORS[k]
            h = s.hashes(np.maximum(begin, at - length), at)
            out.append(bytescan.mix((bytescan.mix(h) ^ other if stated else h) + np.uint64(k + 1) * _STEP))
    return out


class Deep:
    """The symbols of a shard that come after ``DEEP`` bytes or more of their word, and where predictors that see all of
    the word find their counts: in a part of the shard's own after the shared slots, with four slots a bit (one in shards of
    very many symbols)."""

    def __init__(self, symbols: np.ndarray, begin: np.ndarray, room: int, some: np.ndarray | None = None):
        self.where = np.flatnonzero(np.arange(len(symbols)) - begin >= DEEP if some is None else some - begin[some] >= DEEP)
        self.bits = max(16, int((32 if room < 50_000 else 8) * max(1, room) - 1).bit_length())
        whole = [i for i, (length, _, _) in enumerate(PREDICTORS) if length > DEEP]
        self.first = {i: SLOTS + (k << self.bits) for k, i in enumerate(whole)}
        self.size = len(whole) << self.bits


class Spelled:
    """The symbols of some words, each once for all words of one state that begin alike up to it: predictions of a symbol
    depend on no more. By ``LAST``, once for all that agree in the last ``DEEP`` bytes before it. ``back``: for each symbol
    of the words, the distinct one that stands for it."""

    def __init__(self, words: Words, state: np.ndarray, room: int, by: int = WHOLE):
        symbols, self.word, begin = words.spelled()
        own = state[self.word]
        before = contexts(symbols, begin, own, which=[by])[0]
        self.back, key = pd.factorize(before + bytescan.mix(own * 256 + symbols))  # in order of first appearance
        first = np.zeros(len(key), np.int64)
        first[self.back[::-1]] = np.arange(len(symbols))[::-1]
        self.symbols = symbols[first]
        self.ctx = contexts(symbols, begin, own[first], first)
        self.deep = Deep(symbols, begin, room, first)

    def summed(self, x: np.ndarray) -> np.ndarray:
        """For each distinct symbol the sum of what its words have."""
        return np.bincount(self.back, x[self.word], len(self.symbols))

    def per_word(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.word, x[self.back], n)


class Shard:
    """The words of a shard, spelled in runs: from, to and what is spelled. Large ones are spelled anew each time."""

    def __init__(self, words: Words, state: np.ndarray):
        self.words, self.state, self.room = words, state, deep_symbols(words)
        self.kept = list(self.spell()) if words.size.sum() <= KEPT else None

    def spell(self) -> Iterator[tuple[int, int, Spelled]]:
        for a, b, own in self.words.runs(RUN):  # small arrays
            yield a, b, Spelled(own, self.state[a:b], self.room)

    def __iter__(self) -> Iterator[tuple[int, int, Spelled]]:
        return self.spell() if self.kept is None else iter(self.kept)


def bits_of(symbols: np.ndarray, ctx: list[np.ndarray], deep: Deep | None = None):
    """For each of the eight bits: its number, the bit, what came before it in the byte, and the slots of the predictors."""
    before, ctx = np.ones(len(symbols), np.int64), [c * _STEP for c in ctx]
    for k in range(8):
        bit = (symbols >> (7 - k)) & 1
        step = _BEFORE.take(before)
        at = [c + step for c in ctx]
        slots = [(x >> np.uint64(64 - PREDICTORS[i][2])).astype(np.int32) + np.int32(FIRST[i]) for i, x in enumerate(at)]
        if deep is not None:
            for i, first in deep.first.items():
                slots[i][deep.where] = (at[i][deep.where] >> np.uint64(64 - deep.bits)).astype(np.int32) + np.int32(first)
        yield k, bit, before, slots
        before = before * 2 + bit


def inputs(counts: np.ndarray, slots: list[np.ndarray], bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions (INPUTS, n) and the gate. With ``bit``, one occurrence of it is taken off."""
    x = np.full((INPUTS, len(slots[0])), 0.3, np.float32)
    gate = np.zeros(len(slots[0]), np.int8)
    row = 0 if bit is None else (1 + bit.astype(np.int32)) * 65536
    for i, slot in enumerate(slots):
        at = counts.take(slot).astype(np.int32) + row
        RESPONSE.take(at, out=x[i], mode="clip")
        if i in GATED:
            gate = gate * GATE + SEEN.take(at)
    return x, gate.astype(np.int64)


def dot(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1], np.float32)
    for i in range(INPUTS):
        out += weights[:, i].astype(np.float32).take(gate) * x[i]
    return np.clip(out, -11.5, 11.5, out=out)


@dataclass
class Model:
    """Everything that scoring needs; its size doesn't depend on the data."""

    counts: np.ndarray  # (SLOTS,), packed
    pairs: np.ndarray  # (65536, languages) log likelihoods
    weights: np.ndarray  # (GATE * GATE, INPUTS)
    refine: np.ndarray  # (256, STEPS) probabilities
    recall: np.ndarray | None = None  # (RECALL_CELLS, 2) counts of the stage over texts
    recall_weights: np.ndarray | None = None  # (RECALL_GATES, RECALL_INPUTS)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return dot(self.weights, x, gate)

    def refined(self, mixed: np.ndarray, before: np.ndarray) -> np.ndarray:
        place = np.clip((mixed + 8) * np.float32((STEPS - 1) / 16), 0, np.float32(STEPS - 1.001))
        low = place.astype(np.int32)
        part = place - low
        at = before.astype(np.int32) * STEPS + low
        flat = self.refine.ravel()
        return np.clip((squash(mixed) + flat.take(at) * (1 - part) + flat.take(at + 1) * part) / 2, 1e-6, 1 - 1e-6)

    def log10(self, words: Words, state: np.ndarray, c: np.ndarray | None = None, table: Table | None = None) -> np.ndarray:
        """Log probability of each word of a shard, in its language state; c: how often each is in training."""
        out = np.zeros(len(words.size))
        table = Table(self.counts) if table is None else table
        shard = Shard(words, state)
        slots_of = table.of(words, state, np.zeros(len(out)) if c is None else c, shard)
        for a, b, own in shard:
            total = np.zeros(len(own.symbols))
            for _, bit, before, slots in bits_of(own.symbols, own.ctx, own.deep):
                x, gate = inputs(slots_of, slots, None)
                p = self.refined(self.mixed(x, gate), before)
                total += np.log10(np.where(bit, p, 1 - p))
            out[a:b] = own.per_word(total, b - a)
        return out


def deep_symbols(words: Words) -> int:
    return int(np.maximum(words.size + 1 - DEEP, 0).sum())


class Table:
    """The packed counts of the shared slots, and after them those of one shard after the other."""

    def __init__(self, counts: np.ndarray):
        self.slots = np.concatenate([counts, np.zeros(1 << 16, np.uint16)])

    def of(self, words: Words, state: np.ndarray, c: np.ndarray, shard: Shard | None = None) -> np.ndarray:
        """With the counts of that shard."""
        own = np.zeros(0, np.float32)
        for a, b, part in Shard(words, state) if shard is None else shard:
            deep = part.deep
            if not len(own):
                own = np.zeros(2 * deep.size, np.float32)
            mass = part.summed(c[a:b])[deep.where].astype(np.float32)
            some, mass = deep.where[mass > 0], mass[mass > 0]
            if not len(some):
                continue
            ctx, symbols = [part.ctx[i][some] * _STEP for i in deep.first], part.symbols[some]
            before = np.ones(len(some), np.int64)
            for k in range(8):
                bit = (symbols >> (7 - k)) & 1
                step = _BEFORE.take(before)
                for h, first in zip(ctx, deep.first.values()):
                    slot = ((h + step) >> np.uint64(64 - deep.bits)).astype(np.int64) + (first - SLOTS)
                    np.add.at(own, 2 * slot + bit, mass)
                before = before * 2 + bit
        n = len(own) // 2
        if len(self.slots) < SLOTS + n:
            self.slots = np.concatenate([self.slots[:SLOTS], np.zeros(n, np.uint16)])
        here = self.slots[SLOTS : SLOTS + n]
        here[:] = 0
        seen = np.flatnonzero(own.view(np.uint64))  # slots with either count
        here[seen] = packed(own.reshape(-1, 2)[seen])
        return self.slots


def pairs_of(tokens: np.ndarray, state: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of word and state as numbers, ascending, and the place of each token's pair among them."""
    key = tokens * STATES + state
    there = np.bincount(key, minlength=n_words * STATES) > 0
    both = np.flatnonzero(there)
    place = np.zeros(len(there), np.int32)
    place[both] = np.arange(len(both))
    return both, place[key]


def pair_index(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of the words (each opened by a 0), and their words."""
    first = np.cumsum(words.size) - words.size
    left = np.concatenate([[0], words.data[:-1]]).astype(np.int64)
    left[first] = 0
    return left * 256 + words.data, np.repeat(np.arange(len(words.size)), words.size)


def states(words: Words, tokens: np.ndarray, texts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of each token: 0 for the first of a text, else 1 + the language that explains those before it best."""
    index, _ = pair_index(words)
    first = np.cumsum(words.size) - words.size
    new = np.ones(len(texts), bool)
    new[1:] = texts[1:] != texts[:-1]
    lead = np.flatnonzero(new)
    size = np.diff(np.append(lead, len(texts)))
    out, best = np.ones(len(texts), np.int64), None
    for k in range(pairs.shape[1]):
        own = np.add.reduceat(np.ascontiguousarray(pairs[:, k]).take(index), first).take(tokens)
        total = np.concatenate([[0.0], np.cumsum(own)[:-1]])
        total -= np.repeat(total[lead], size)
        if best is None:
            best = total
        else:
            more = total > best
            out[more] = k + 1
            np.maximum(best, total, out=best)
    out[lead] = 0
    return out


def held_out(doc_id) -> "F.Column":
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str | None, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for s in bytescan.slices(batch.column(1)):
            own = np.array([langs[s.first + i] or "" for i in range(s.n)], object)
            words, tokens, texts = Words.of(s)
            index, owner = pair_index(words)
            for lang in set(own.tolist()):
                n = np.bincount(tokens[(own == lang)[texts]], minlength=len(words.size))
                c = np.bincount(index, n[owner], 65536)
                total[lang] = total.get(lang, 0) + c
                if len(total) > 64:  # keep memory bounded; Spark sums the rest
                    yield from _emit_pairs(total)
                    total.clear()
    yield from _emit_pairs(total)


def _emit_pairs(total: dict) -> Iterator[pa.RecordBatch]:
    for lang, c in total.items():
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(c[some].astype(np.int64))], ["lang", "pair", "c"])


def learn_languages(train: DataFrame, languages: int, most: int = LABELLED) -> np.ndarray:
    """(65536, k) log likelihoods of byte pairs for the k largest languages (15 at most), from all rows with a language,
    or about ``most`` of them, picked by a hash of the text."""
    languages = min(languages, STATES - 1)
    labelled = train.where("lang IS NOT NULL")
    n = labelled.count()
    if n > most:  # that share of all hashes
        train = labelled.where(F.shiftrightunsigned(F.xxhash64("text", F.lit(29)), 1) < F.lit(int(most / n * (1 << 63))))
    counts = materialise(train.select("lang", "text").mapInArrow(_pair_counts, "lang string, pair int, c bigint").groupBy("lang", "pair").agg(F.sum("c").alias("c")), "pairs")
    largest = [r["lang"] for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]
    out = np.full((65536, len(largest)), 0.1)
    for r in counts.where(F.col("lang").isin(largest)).collect():  # at most 65,536 a language
        out[r["pair"], largest.index(r["lang"])] += r["c"]
    return np.log(out / out.sum(0))


WORDS_OUT = "h bigint, word binary, state int, c bigint, recall binary"


def _state_words(sent):
    """(held_out, text) -> the words of each slice by state; and, at the end of a task, what its texts taught the second
    stage, in ``recall`` of a row without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sent.value
        cells, w, mass = np.zeros((RECALL_CELLS, 2)), np.full((RECALL_GATES, RECALL_INPUTS), 0.4), np.zeros(RECALL_GATES)
        for batch in batches:
            train = ~batch.column(0).to_numpy(zero_copy_only=False)
            for s in bytescan.slices(batch.column(1), TEXT_BYTES):
                words, tokens, texts = Words.of(s)
                state = states(words, tokens, texts, pairs)
                both, back = pairs_of(tokens, state, len(words.size))
                n = np.bincount(back, train[s.first + texts], len(both))
                word = both // STATES
                stop = np.concatenate([[0], np.cumsum(words.size)])
                column = pa.BinaryArray.from_buffers(pa.binary(), len(words.size), [None, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(words.data)]).take(pa.array(word))
                none = pa.nulls(len(both), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(words.hash[word].view(np.int64)), column, pa.array((both % STATES).astype(np.int32)), pa.array(n.astype(np.int64)), none], [c.split()[0] for c in WORDS_OUT.split(", ")])
                r = Recall.of(tokens, texts, state, words.size)
                kept = train[s.first + texts[r.at]]
                if kept.any():
                    r.learn(kept, cells, w, mass)
        body = np.concatenate([cells.ravel(), (w * mass[:, None]).ravel(), mass]).tobytes()
        if mass.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([b""], pa.binary()), pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([body], pa.binary())], [c.split()[0] for c in WORDS_OUT.split(", ")])

    return bytescan.tidy(run)


def _since(group_first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of x before each place, from the start of its group on."""
    total = np.concatenate([[0.0], np.cumsum(x)])[:-1]
    return total - total[group_first]


@dataclass
class Recall:
    """The decisions of the second stage over some texts, in order."""

    at: np.ndarray  # the token that each is about
    foreseen: np.ndarray  # where the foreseen token stood
    hit: np.ndarray
    text: np.ndarray
    gate: np.ndarray
    cell: np.ndarray
    own: np.ndarray  # (2, 2, n): no and yes so far in this text, after this word and after matches of this length

    @staticmethod
    def of(tokens: np.ndarray, texts: np.ndarray, state: np.ndarray, size: np.ndarray) -> "Recall":
        n = len(tokens)
        t = np.arange(1, n)
        t = t[texts[1:] == texts[:-1]]
        key = texts[t].astype(np.int64) * len(size) + tokens[t - 1]
        order = np.argsort(key, kind="stable")
        t, key = t[order], key[order]
        again = np.zeros(len(t), bool)
        again[1:] = key[1:] == key[:-1]
        place = np.flatnonzero(again)
        at, seen = t[place], t[place - 1] if len(place) else t[:0]
        hit = tokens[at] == tokens[seen]
        # So far after this word: places of one key stand together, in order of time.
        lead = np.ones(len(place), bool)
        lead[1:] = np.diff(place) > 1
        first = np.maximum.accumulate(np.where(lead, np.arange(len(place)), 0))
        by_word = np.array([_since(first, ~hit), _since(first, hit)])
        order = np.argsort(at, kind="stable")
        at, seen, hit, by_word = at[order], seen[order], hit[order], by_word[:, order]
        length = np.ones(len(at), np.int64)
        for back in range(2, LONGEST + 1):
            a, b = np.maximum(at - back, 0), np.maximum(seen - back, 0)
            length += (length == back - 1) & (seen >= back) & (texts[b] == texts[at]) & (tokens[a] == tokens[b])
        text = texts[at]
        by_length = np.zeros((2, len(at)))
        for k in range(1, LONGEST + 1):
            some = np.flatnonzero(length == k)
            new = np.ones(len(some), bool)
            new[1:] = text[some[1:]] != text[some[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))
            by_length[0, some], by_length[1, some] = _since(first, ~hit[some]), _since(first, hit[some])
        gate = (length - 1) * 4 + np.minimum(by_word.sum(0), 3).astype(np.int64)
        width = np.minimum(size[tokens[seen]], WIDTHS) - 1
        return Recall(at, seen, hit, text, gate, ((length - 1) * STATES + state[at]) * WIDTHS + width, np.array([by_word, by_length]))

    def inputs(self, cells: np.ndarray) -> np.ndarray:
        """(n, RECALL_INPUTS) stretched predictions."""
        x = np.full((len(self.at), RECALL_INPUTS), 0.3)
        for k, (no, yes) in enumerate((self.own[0], self.own[1], cells[self.cell].T)):
            x[:, k] = np.log((yes + 0.2) / (no + 0.8)) * ((no + yes) / (no + yes + 0.5))
        return x

    def learn(self, which: np.ndarray, cells: np.ndarray, w: np.ndarray, mass: np.ndarray) -> None:
        """Count and learn online, in runs of decisions, from those that count."""
        x, which = None, np.flatnonzero(which)
        for a in range(0, len(which), 4096):
            some = which[a : a + 4096]
            part = Recall(self.at[some], self.foreseen[some], self.hit[some], self.text[some], self.gate[some], self.cell[some], self.own[:, :, some])
            x = part.inputs(cells)
            error = part.hit - squash(np.clip((x * w[part.gate]).sum(1), -8, 8))
            here = np.bincount(part.gate, minlength=RECALL_GATES)
            seen = here > 0
            for i in range(RECALL_INPUTS):
                w[seen, i] += 0.2 * np.bincount(part.gate, error * x[:, i], RECALL_GATES)[seen] / here[seen]
            mass += here
            cells += np.bincount(part.cell * 2 + part.hit, minlength=2 * RECALL_CELLS).reshape(-1, 2)

    def probabilities(self, cells: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of a hit, for each decision; weights go on from ``start`` along each text, in steps of ``STRIDE`` decisions."""
        n = len(self.at)
        out = np.zeros(n)
        if not n:
            return out
        x = self.inputs(cells)
        new = np.ones(n, bool)
        new[1:] = self.text[1:] != self.text[:-1]
        number = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        w = np.repeat(start[None], len(first), 0).reshape(-1, RECALL_INPUTS)  # a row for each text and gate
        by_size = np.argsort(-size, kind="stable")
        nth = np.empty(len(first), np.int64)
        nth[by_size] = np.arange(len(first))
        for a in range(0, int(size.max()), STRIDE):
            live = by_size[: int(np.searchsorted(-size[by_size], -a, "left"))]  # texts with more than a decisions
            count = np.minimum(size[live] - a, STRIDE)
            rows = np.repeat(first[live] + a - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            cell = number[rows] * RECALL_GATES + self.gate[rows]
            p = squash(np.clip((x[rows] * w[cell]).sum(1), -8, 8))
            out[rows] = p
            error = self.hit[rows] - p
            local, back = np.unique(cell, return_inverse=True)
            here = np.bincount(back)
            step = np.stack([np.bincount(back, error * x[rows, i]) for i in range(RECALL_INPUTS)], 1)
            w[local] += 0.3 * step / (here[:, None] + 8)
        return out


def _vocabulary(batches: Iterator[pa.RecordBatch], size: int):
    """Runs of about ``size`` words of (h, word, state, c)."""
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            part = batch.slice(a, size)
            column = part.column(1).cast(pa.large_binary())
            off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
            yield Words(part.column(0).to_numpy().view(np.uint64), data, np.diff(off)), part.column(2).to_numpy().astype(np.int64), part.column(3).to_numpy().astype(np.float64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, counts): the counts of shared slots that aren't 0, as differences of places and values, compressed."""
    import zstandard

    counts = np.zeros(2 * SLOTS, np.float32)
    for words, state, c in _vocabulary(batches, 20_000):
        for a, b, part in words.runs(SHORT_RUN):
            own = Spelled(part, state[a:b], 1, LAST)
            mass = own.summed(c[a:b]).astype(np.float32)
            shallow = np.delete(np.arange(len(mass)), own.deep.where)
            for _, bit, _, slots in bits_of(own.symbols, own.ctx):
                for (length, _, _), slot in zip(PREDICTORS, slots):
                    if length > DEEP:
                        np.add.at(counts, 2 * slot[shallow].astype(np.int64) + bit[shallow], mass[shallow])
                    else:
                        np.add.at(counts, 2 * slot.astype(np.int64) + bit, mass)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for part, x in enumerate(counts.reshape(PARTS, -1)):
        some = np.flatnonzero(x)
        if len(some):
            body = squeeze(np.diff(some, prepend=0).astype("<u4").tobytes() + x[some].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([body], pa.binary())], ["part", "counts"])


def _sum_parts(t: pa.Table) -> pa.Table:
    import zstandard

    total = np.zeros(2 * SLOTS // PARTS)
    for x in t["counts"]:
        body = zstandard.ZstdDecompressor().decompress(x.as_py())
        n = len(body) // 8
        total[np.cumsum(np.frombuffer(body, "<u4", n))] += np.frombuffer(body, "<f4", n, 4 * n)
    return pa.table({"part": t["part"].slice(0, 1), "counts": pa.array([packed(total.reshape(-1, 2)).tobytes()], pa.binary())})


def _shards(batches: Iterator[pa.RecordBatch]):
    """The whole shards of (shard, h, word, state, c) in order of shard: words, states and counts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if held and a < b and held[-1].column(0)[0].as_py() != int(shard[a]):
                yield from _one(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield from _one(held)


def _one(held: list[pa.RecordBatch]):
    whole = pa.Table.from_batches(held).combine_chunks().select([1, 2, 3, 4])
    for batch in whole.to_batches():  # one
        yield from _vocabulary(iter([batch]), batch.num_rows)


LEARNED = "kind int, at int, a double, b double"


def _learn(sent):
    """The mixer's weights and the refinement, online over the words of the task's shards, as sums to be added up. Words
    of the first shard are seen twice, at first without refinement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(sent.value)
        w, mass = np.full((GATE * GATE, INPUTS), 0.3), np.zeros(GATE * GATE)
        n = np.zeros((256 * STEPS, 2))

        def seen(shard, counted, c, refining):
            for a, b, own in shard:
                trained = own.summed(c[a:b])
                if not trained.any():
                    continue
                for _, bit, before, slots in bits_of(own.symbols, own.ctx, own.deep):
                    x, gate = inputs(counted, slots, bit)
                    mixed = dot(w, x, gate)
                    error = trained * (bit - squash(mixed))
                    here = np.bincount(gate, trained, GATE * GATE)
                    some = here > 0
                    rate = 0.3 / np.sqrt(1 + mass[some] / 50_000) + 0.02
                    for i in range(INPUTS):
                        w[some, i] += rate * np.bincount(gate, error * x[i], GATE * GATE)[some] / here[some]
                    mass[:] += here
                    if refining:
                        place = np.clip((mixed + 8) * (STEPS - 1) / 16 + 0.5, 0, STEPS - 1).astype(np.int64)
                        n[:] += np.bincount((before.astype(np.int64) * STEPS + place) * 2 + bit, trained, 512 * STEPS).reshape(-1, 2)

        for k, (words, state, c) in enumerate(_shards(batches)):
            some = np.flatnonzero(c > 0)
            if len(some):
                words, state, c = words.some(some), state[some], c[some]
                shard = Shard(words, state)
                counted = table.of(words, state, c, shard)
                if not mass.any():
                    seen(shard, counted, c, False)
                seen(shard, counted, c, True)
        cells = np.flatnonzero(n.sum(1))
        kind = np.repeat([0, 1], [w.size, len(cells)]).astype(np.int32)
        at = np.concatenate([np.arange(w.size), cells]).astype(np.int32)
        one, two = np.concatenate([(w * mass[:, None]).ravel(), n[cells, 0]]), np.concatenate([np.repeat(mass, INPUTS), n[cells, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(one), pa.array(two)], ["kind", "at", "a", "b"])

    return bytescan.tidy(run)


def in_shards(every_word: DataFrame) -> DataFrame:
    """Each shard in one task, one after the other, about 64 a task at most."""
    shards = (every_word.agg(F.max("shard")).first()[0] or 0) + 1
    tasks = min(shards, max(int(every_word.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 64)))
    return every_word.repartition(tasks, "shard").sortWithinPartitions("shard", "h", "state")


def learn(rows: DataFrame, languages: int = LANGUAGES, shard_words: int = SHARD_WORDS) -> tuple[Model, DataFrame]:
    """The model of those rows of (held_out, text, lang) that are not held out, and the words of all rows by state with
    their counts in training (shard, h, word, state, c)."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    pairs = learn_languages(rows.where("NOT held_out"), languages)
    found = materialise(rows.select("held_out", "text").mapInArrow(_state_words(sc.broadcast(pairs)), WORDS_OUT).groupBy("h", "word", "state", "recall").agg(F.sum("c").alias("c")), "found")
    taught = np.zeros(2 * RECALL_CELLS + RECALL_GATES * RECALL_INPUTS + RECALL_GATES)
    for r in found.where("state < 0").select("recall").toLocalIterator():  # a row of fixed size for each task, added up one by one
        taught += np.frombuffer(r["recall"], np.float64)
    recall, summed, mass = np.split(taught, [2 * RECALL_CELLS, len(taught) - RECALL_GATES])
    recall_weights = np.where(mass[:, None] > 0, summed.reshape(RECALL_GATES, -1) / np.maximum(mass, 1)[:, None], 0.4)
    words = found.where("state >= 0").drop("recall")
    shards = max(1, -(-words.count() // shard_words))
    dealt = words.withColumn("shard", F.pmod(F.xxhash64(F.substring("word", 1, DEEP)), F.lit(shards))).select("shard", "h", "word", "state", "c")
    every_word = dealt
    vocabulary = every_word.where("c > 0").select("h", "word", "state", "c")
    parts = vocabulary.mapInArrow(bytescan.tidy(_slot_counts), "part int, counts binary").groupBy("part").applyInArrow(_sum_parts, "part int, counts binary")
    counts = np.zeros((PARTS, SLOTS // PARTS), np.uint16)
    for r in parts.toLocalIterator():  # PARTS rows of fixed size
        counts[r["part"]] = np.frombuffer(r["counts"], np.uint16)
    counts = counts.ravel()
    weights, n = np.full((GATE * GATE, INPUTS), 0.3), np.zeros((256 * STEPS, 2))
    learned = in_shards(every_word).mapInArrow(_learn(sc.broadcast(counts)), LEARNED).groupBy("kind", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    for r in learned.collect():  # of fixed size
        if r["kind"]:
            n[r["at"]] = r["a"], r["b"]
        elif r["b"] > 0:
            weights.flat[r["at"]] = r["a"] / r["b"]
    centres, prior = squash((np.arange(STEPS) * 16 / (STEPS - 1)) - 8), 20.0
    refine = (n[:, 1].reshape(256, STEPS) + prior * centres) / (n.sum(1).reshape(256, STEPS) + prior)
    return Model(counts, pairs, weights, refine, recall.reshape(-1, 2), recall_weights), every_word


def _score_words(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(sent.value.counts)
        for words, state, c in _shards(batches):
            yield pa.RecordBatch.from_arrays([pa.array(words.hash.view(np.int64)), pa.array(state.astype(np.int32)), pa.array(c.astype(np.int64)), pa.array(sent.value.log10(words, state, c, table))], ["h", "state", "own", "logp"])

    return bytescan.tidy(run)


@dataclass
class Frequent:
    """What the join gives for the most frequent words by state; of those that meet in a slot, for the most frequent."""

    key: np.ndarray  # in a free slot one that belongs to another
    c: np.ndarray
    logp: np.ndarray

    @staticmethod
    def of(t: pa.Table, slots: int) -> "Frequent":
        """From (h, state, own, c, logp); slots: a power of two."""
        t = t.sort_by([("own", "ascending"), ("h", "ascending"), ("state", "ascending")])
        out = Frequent(~(np.arange(slots, dtype=np.uint64) << np.uint64(65 - slots.bit_length())), np.zeros(slots), np.zeros(slots))
        key = _key(t["h"].to_numpy().view(np.uint64), t["state"].to_numpy())
        at = out.slot(key)
        last = len(at) - 1 - np.unique(at[::-1], return_index=True)[1]
        at = at[last]
        out.key[at], out.c[at], out.logp[at] = key[last], t["c"].to_numpy()[last], t["logp"].to_numpy()[last]
        return out

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(65 - len(self.key).bit_length())).astype(np.int64)


def frequent(known: DataFrame, most: int) -> pa.Table:
    """At most so many rows of (h, state, own, c, logp), those with the largest ``own``."""
    level = F.floor(F.log2("own") * 16)
    total, least = 0, None
    for r in known.where("own > 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # about 1,000 at most
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return known.where("own > 0" if least is not None else "false").where(level >= F.lit(least or 0)).select("h", "state", "own", "c", "logp").toArrow()


def _chunk_words(sent):
    """(chunk, ..., text) -> (chunk, word hash, state) of words that are not in the table of frequent ones, each at least
    once; a table of what was seen last keeps most repetitions back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (model, often) = np.zeros(1 << 20, np.uint64), sent.value
        for batch in batches:
            chunks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for s in bytescan.slices(batch.column(3), TEXT_BYTES):
                words, tokens, texts = Words.of(s)
                own, local = np.unique(chunks[s.first : s.first + s.n], return_inverse=True)
                key = np.unique((local[texts] * len(words.size) + tokens) * STATES + states(words, tokens, texts, model.pairs))
                both = _key(words.hash[key // STATES % len(words.size)], key % STATES)
                key = key[often.key[often.slot(both)] != both]
                word, chunk, state = key // STATES % len(words.size), own[key // STATES // len(words.size)], key % STATES
                with np.errstate(over="ignore"):
                    mark = _key(words.hash[word] + bytescan.mix(chunk.astype(np.uint64) + np.uint64(1)), state)
                slot = (mark >> np.uint64(44)).astype(np.int64)
                new = seen[slot] != mark
                seen[slot[new]] = mark[new]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[new]), pa.array(words.hash[word[new]].view(np.int64)), pa.array(state[new].astype(np.int32))], ["chunk", "h", "state"])

    return run


def _key(h: np.ndarray, state: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return bytescan.mix(h + state.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint"


def _score_chunk(sent, n_train: int, n_words: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        model, often = sent.value
        key = _key(known["h"].to_numpy().view(np.uint64), known["state"].to_numpy())
        order = np.argsort(key)
        key, known_c, known_logp = key[order], known["c"].to_numpy()[order], known["logp"].to_numpy()[order]
        rows = {k: [] for k in ("n_tokens", "n_known", "base", "score", "n_bytes")}
        for s in bytescan.slices(docs["text"].combine_chunks() if docs.num_rows else pa.array([], pa.string()), TEXT_BYTES):
            words, tokens, texts = Words.of(s)
            state = states(words, tokens, texts, model.pairs)
            both, back = pairs_of(tokens, state, len(words.size))
            own = _key(words.hash[both // STATES], both % STATES)
            at = often.slot(own)
            rest = np.flatnonzero(often.key[at] != own)
            c, logp = often.c[at], often.logp[at]
            at = np.searchsorted(key, own[rest])  # every one is there
            c[rest], logp[rest] = known_c[at], known_logp[at]
            base = np.log10(c + 1.0) - math.log10(n_train + n_words + 1)
            rows["n_tokens"].append(np.bincount(texts, minlength=s.n))
            rows["n_known"].append(np.bincount(texts, (c > 0)[back], s.n).astype(np.int64))
            rows["base"].append(np.bincount(texts, base[back], s.n))
            rows["score"].append(np.bincount(texts, along(model, words, tokens, texts, state, both, logp, logp[back]), s.n))
            rows["n_bytes"].append(np.diff(s.off))
        got = {k: pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64() if k in ("base", "score") else pa.int64()) for k, v in rows.items()}
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], **got})

    return run


def along(model: Model, words: Words, tokens: np.ndarray, texts: np.ndarray, state: np.ndarray, both: np.ndarray, by_pair: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log probability of each token in its text: ``logp`` by the word stage, and the decisions of the second one.
    ``by_pair``: log probabilities of the pairs of word and state in ``both``, ascending."""
    r = Recall.of(tokens, texts, state, words.size)
    if not len(r.at):
        return logp
    out = logp.copy()
    p = r.probabilities(model.recall, model.recall_weights)
    # Without the foreseen word the others share its probability, where that is known.
    pair = tokens[r.foreseen] * STATES + state[r.at]
    where = np.minimum(np.searchsorted(both, pair), len(both) - 1)
    left = np.where(both[where] == pair, 1 - 10.0 ** np.minimum(by_pair[where], -1e-6), 1.0)
    out[r.at] = np.where(r.hit, np.log10(p), np.log10(1 - p) + logp[r.at] - np.log10(left))
    return out


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, languages: int = LANGUAGES, most_frequent: int = FREQUENT, slots: int = FREQUENT_SLOTS) -> DataFrame:
    """Train on the rows of (doc_id, text, lang) that are not held out, and score all."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model, every_word = learn(rows, languages)
    sent = spark.sparkContext.broadcast(model)
    # Each word is spelled once for each state, wherever it stands.
    scored = in_shards(every_word).mapInArrow(_score_words(sent), "h bigint, state int, own bigint, logp double")
    counts = every_word.groupBy("h").agg(F.sum("c").alias("c"))
    known = materialise(scored.join(counts, "h"), "scored")
    total = known.where("c > 0").select("h", "c").distinct().agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train, n_words = total["n"] or 0, total["v"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
    # Rows of one id are dealt by their text, too.
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "held_out", "text").repartition(chunks, "chunk")
    scoring = Model(np.zeros(0, np.uint16), model.pairs, model.weights, model.refine, model.recall, model.recall_weights)
    light = spark.sparkContext.broadcast((scoring, Frequent.of(frequent(known, most_frequent), slots)))
    used = dealt.mapInArrow(bytescan.tidy(_chunk_words(light)), "chunk bigint, h bigint, state int").join(known.drop("own"), ["h", "state"])
    run = _score_chunk(light, n_train, n_words)
    out = dealt.groupBy("chunk").cogroup(used.select("chunk", "h", "state", "c", "logp").groupBy("chunk")).applyInArrow(run, SCORED)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), F.when(F.lit(n_train > 0), F.col("base")).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
