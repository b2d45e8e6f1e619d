"""Word-level access to the public word BPE: cutting texts into space-separated pieces that can be encoded one by one.

The tokenizer normalises (NFC, white space to one space, lower case), cuts words by a pattern that never crosses
white space, and merges inside words only. So the ids of a text are the ids of its space-separated pieces in order, and
a piece needs encoding once. Texts within a set of characters on which Python's ``lower`` and ``split`` provably agree
with that are cut here; all others are normalised by the library first. The strings of special tokens are matched
in the raw text, as the library does, and only there: one that appears by lower case is plain text.

Pieces are looked up by two hashes of their bytes in arrays of bounded size, so a worker holds the same memory whatever
it has read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foldwise.llm import bytescan

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TOKENIZER = "word_bpe_49k.json"
#: Characters that NFC leaves alone, and whose lower case and white space Python and the library see alike.
_UNUSUAL = re.compile(r"[^\t-\r -~\xa0-įı-ɏ‐-‧‰-⁞₠-₿]")
#: A piece of this byte (never part of UTF-8) and a number is a special token.
SPECIAL = b"\xff"
#: Longer pieces are hashed by a cryptographic digest.
LONG = 512
_loaded: dict[str, "WordBpe"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@dataclass
class Pieces:
    """The pieces of some texts: bytes, start and end of each piece, and the number of its text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    n: int

    def some(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        s = bytescan.Slice(self.data, np.zeros(1, np.int64), 0)
        one, two = s.hashes(self.start, self.end), s.hashes(self.start, self.end, code=bytescan.OTHER_CODE)
        long = np.flatnonzero(self.end - self.start > LONG)
        for i, piece in zip(long.tolist(), self.some(long) if len(long) else ()):
            one[i], two[i] = np.frombuffer(hashlib.blake2b(piece, digest_size=16).digest(), np.uint64)
        return one, two


class WordBpe:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True  # those of the raw text are taken out before
        # Pieces are normal already.
        self.of_pieces = Tokenizer.from_str(json.dumps(json.loads(self.tokenizer.to_str()) | {"normalizer": None}))
        self.of_pieces.encode_special_tokens = True
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._mark = {t: SPECIAL + str(i).encode() for t, i in self.specials.items()}
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self._ends: np.ndarray | None = None

    def _plain(self, text: str) -> bytes:
        if not _UNUSUAL.search(text):
            return text.lower().replace("\xa0", " ").encode()
        return self.tokenizer.normalizer.normalize_str(text).encode()

    def _bytes(self, text: str) -> bytes:
        if self._special and "<|" in text and self._special.search(text):
            return b" ".join(self._mark.get(part) or self._plain(part) for part in self._special.split(text))
        return self._plain(text)

    def pieces(self, texts: list[str]) -> Pieces:
        """The pieces of the texts in order; a special token's string is a piece of its own."""
        own = [self._bytes(t) for t in texts]
        off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))]).astype(np.int64)
        s = bytescan.Slice(np.frombuffer(b"".join(own), np.uint8), off, 0)
        return Pieces(s.data, *s.words(), s.n)

    def word_count(self, piece: str) -> int:
        """How many words the tokenizer's pattern cuts from a piece."""
        if piece.isascii():
            return 1 if piece.isalpha() else len(self.cut.findall(piece))
        if _UNUSUAL.search(piece):
            return len(self.tokenizer.pre_tokenizer.pre_tokenize_str(piece))
        return 1 if piece.isalpha() else len(self.cut.findall(piece))

    def encode_new(self, new: list[bytes], together: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has. The library encodes runs of pieces joined by spaces; the last
        token of each word shows by the suffix of its entry, so the runs can be cut again."""
        encode = getattr(self.of_pieces, "encode_batch_fast", self.of_pieces.encode_batch)
        if self._ends is None:
            vocab = self.tokenizer.get_vocab()
            self._ends = np.zeros(1 + max(vocab.values()), np.int64)
            self._ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = 1
        lens = np.zeros(len(new), np.int64)
        flat: list[np.ndarray] = []
        for a in range(0, len(new), together):
            run = new[a : a + together]
            joined = b" ".join(run)
            if SPECIAL not in joined and b"</w" not in joined:  # what could be mistaken for a suffix is encoded alone
                joined = joined.decode()
                whole = np.array(encode([joined], add_special_tokens=False)[0].ids, np.uint32)
                stops = np.flatnonzero(self._ends[whole]) + 1
                words = np.cumsum(np.fromiter(map(self.word_count, joined.split(" ")), np.int64, len(run)))
                if len(stops) == words[-1]:
                    lens[a : a + len(run)] = np.diff(stops[words - 1], prepend=0)
                    flat.append(whole)
                    continue
            for k, p in enumerate(run):
                own = [int(p[len(SPECIAL) :])] if p.startswith(SPECIAL) else encode([p.decode()], add_special_tokens=False)[0].ids
                lens[a + k] = len(own)
                flat.append(np.array(own, np.uint32))
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), lens


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


class PieceTable:
    """Numbers pieces; ``encode_new`` maps new ones to their ids in bulk. An open hash table in arrays: 16 bytes a slot,
    twice as many slots as pieces, and the ids. Forgotten as a whole beyond ``limit`` pieces or ``most_ids`` ids (about
    70 MB), whatever the length of pieces."""

    def __init__(self, encode_new, limit: int = 1_000_000, most_ids: int = 6_000_000):
        self.encode_new, self.limit, self.most_ids = encode_new, limit, most_ids
        self.clear()

    def clear(self) -> None:
        self._size(14)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.one, self.two = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint32)
        self.n = self.n_ids = 0

    def _size(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.full(1 << bits, -1, np.int32)

    def _slot(self, one: np.ndarray) -> np.ndarray:
        return (one >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        got = np.full(len(one), -1, np.int64)
        todo, at, mask = np.arange(len(one)), self._slot(one), (1 << self.bits) - 1
        while len(todo):
            here = self.slots[at]
            same = (here >= 0) & (self.one[here] == one[todo]) & (self.two[here] == two[todo])
            got[todo[same]] = here[same]
            go = (here >= 0) & ~same
            todo, at = todo[go], (at[go] + 1) & mask
        return got

    def _place(self, numbers: np.ndarray) -> None:
        at, mask = self._slot(self.one[numbers]), (1 << self.bits) - 1
        while len(numbers):
            free = np.flatnonzero(self.slots[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            self.slots[slots] = numbers[free[first]]
            rest = np.ones(len(numbers), bool)
            rest[free[first]] = False
            numbers, at = numbers[rest], at[rest]
            taken = self.slots[at] >= 0
            at = np.where(taken, (at + 1) & mask, at)

    def numbers(self, pieces: Pieces) -> np.ndarray:
        """The number of each piece; pieces not seen before are encoded first."""
        if self.n > self.limit or self.n_ids > self.most_ids:
            self.clear()
        one, two = pieces.hashes()
        two = (two >> np.uint64(32)).astype(np.uint32)
        got = self._find(one, two)
        while len(new := np.flatnonzero(got < 0)):
            _, first = np.unique(one[new], return_index=True)
            self._add(pieces.some(new[first]), one[new[first]], two[new[first]])
            got[new] = self._find(one[new], two[new])
        return got

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        return x if len(x) >= n else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])

    def _add(self, fresh: list[bytes], one: np.ndarray, two: np.ndarray) -> None:
        flat, lens = self.encode_new(fresh)
        first, n = self.n, self.n + len(fresh)
        self.ids = self._grown(self.ids, self.n_ids + len(flat))
        self.at = self._grown(self.at, n + 1)
        self.one, self.two = self._grown(self.one, n), self._grown(self.two, n)
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.at[first : n + 1] = self.n_ids + np.concatenate([[0], np.cumsum(lens)])
        self.one[first:n], self.two[first:n] = one, two
        self.n, self.n_ids = n, self.n_ids + len(flat)
        if 2 * n > 1 << self.bits:
            self._size(int(4 * n - 1).bit_length())
            self._place(np.arange(n))
        else:
            self._place(np.arange(first, n))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered pieces, in order, and how many each has."""
        start = self.at[numbers]
        size = self.at[numbers + 1] - start
        first = np.cumsum(size) - size
        return self.ids[np.arange(int(size.sum())) + np.repeat(start - first, size)], size


def encoded(bpe: WordBpe, table: PieceTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and how many each text has."""
    pieces = bpe.pieces(texts)
    flat, size = table.gather(table.numbers(pieces))
    return flat, np.bincount(pieces.owner, size, pieces.n).astype(np.int64)


def runs(column: pa.Array, limit: int = 1 << 20):
    """The texts (nulls as empty ones) in runs of about ``limit`` bytes, or one text."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield [t or "" for t in column.slice(a, b - a).to_pylist()]
        a = b
