"""Quality rules with compression bands.

Zstandard ratios (bytes of text to bytes of frame) of the whole text and of fixed chunks are held against limits that
depend on the text's length: a ratio above its band means repetition, one below means incompressible noise. Long texts
compress better at equal quality, so the upper limit of the whole text grows with its length; chunks have one size and
one band. A text fails if its whole ratio is outside its band, or if more than ``chunk_share`` of its chunks are outside theirs.

Base rules: a text fails with under 20 words, or if more than 30 % of its words stand in 8-word windows found twice or
more in it. Words are ``[^\\x20\\x09-\\x0D]+``.

Defined cases: null text: no words, so it fails the base rules. Texts under ``MIN_BYTES`` have no ratio verdict. Equal
rows get equal verdicts. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.llm import bytescan
from foldwise.runtime import ship, table

WINDOW = 8
SYMBOLS = bytescan.table_of(*b"[#*$%&|<>]"[1:-1])
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, ratio double, chunk_low double, chunk_high double, bad_chunks bigint"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by bytes of text: rows of (bytes up to, lowest, highest)."""

    whole: tuple[tuple[float, float, float], ...] = ((512, 1.05, 3.2), (2048, 1.35, 4.0), (8192, 1.6, 5.0), (65536, 1.7, 6.5), (float("inf"), 1.7, 8.0))
    chunk: int = 4096
    chunk_low: float = 1.35
    chunk_high: float = 6.5
    chunk_share: float = 0.3
    level: int = 3


MIN_BYTES = 128


def count_words(s: bytescan.Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of the slice."""
    start, end, owner = s.words()
    n = s.n
    lead = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
    sign = np.concatenate([[0], np.cumsum(SYMBOLS[s.data])])
    h = s.hashes(start, end)
    keys, at = bytescan.window_hashes(h, owner, WINDOW)
    own = owner[at]
    order = np.lexsort((keys, own))
    k, o = keys[order], own[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h) + 1, np.int64)
    first = at[order[twice]]
    np.add.at(cover, first, 1)
    np.add.at(cover, first + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    # Lines: cut at line feeds and at the ends of texts; each that has a word is hashed.
    breaks = np.flatnonzero(s.data == 10)
    ls = np.sort(np.concatenate([s.off[:-1], breaks + 1]))
    le = np.sort(np.concatenate([s.off[1:], breaks]))
    words_before = np.concatenate([[0], np.cumsum(~bytescan.SPACE[s.data])])
    full = words_before[le] > words_before[ls]
    ls, le = ls[full], le[full]
    lo, lh = np.searchsorted(s.off, ls, "right") - 1, s.hashes(ls, le)
    order = np.lexsort((lh, lo))
    again = (lh[order][1:] == lh[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    return {
        "n_words": bytescan.per_text(owner, n), "word_chars": bytescan.per_text(owner, n, (lead[end] - lead[start]).astype(float)), "n_symbols": sign[s.off[1:]] - sign[s.off[:-1]],
        "n_dup_lines": bytescan.per_text(lo[order][1:][again], n), "n_repeat_words": bytescan.per_text(owner[covered], n),
    }


def ratios(text: bytes, bands: Bands, compressor) -> tuple[float | None, float | None, float | None, int, int]:
    """Whole ratio, lowest and highest chunk ratio, chunks outside their band, chunks."""
    if len(text) < MIN_BYTES:
        return None, None, None, 0, 0
    whole = len(text) / len(compressor.compress(text))
    size = bands.chunk
    # The last chunk is whole: it ends where the text ends.
    starts = [*range(0, len(text) - size, size), len(text) - size] if len(text) >= size else []
    own = [size / len(compressor.compress(text[a : a + size])) for a in starts]
    bad = sum(not bands.chunk_low <= r <= bands.chunk_high for r in own)
    return whole, min(own, default=None), max(own, default=None), bad, len(own)


def band(n_bytes: int, bands: Bands) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands.whole if n_bytes <= most)


def _judge(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for s in bytescan.slices(batch.column(1)):
                x = count_words(s)
                failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
                rows = [ratios(t := s.text(i), bands, compressor) + (band(len(t), bands),) for i in range(s.n)]
                kept = [not f and (r[0] is None or r[5][0] <= r[0] <= r[5][1] and r[3] <= bands.chunk_share * r[4]) for f, r in zip(failed.tolist(), rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, s.n), *(pa.array(v, pa.int64()) for v in x.values()), pa.array(failed), pa.array(kept, pa.bool_()),
                        *(pa.array([r[k] for r in rows], pa.float64()) for k in range(3)), pa.array([r[3] for r in rows], pa.int64()),
                    ],
                    [f.split()[0] for f in SCHEMA.split(", ")],
                )

    return run


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The counts and verdicts of each row of (doc_id, text)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_judge(bands), SCHEMA)


def keep(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass, as they are. The verdict is made in the same pass over the rows, with no join."""
    ship(docs.sparkSession)
    inner = _judge(bands)
    names = docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(range(batch.num_rows), pa.int64())
            got = [v["kept"] for v in inner(iter([pa.RecordBatch.from_arrays([n, batch.column(where)], ["doc_id", "text"])]))]
            yield batch.filter(pa.concat_arrays(got)) if got else batch

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
