"""Token-ID output as patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id, one file a range, so that file order and order inside files together are the
ascending order of doc_id. A file is a run of segments. A segment is: the magic ``PFR2``; the number of its file's range,
counts of documents, tokens, blocks and payload bytes (5 x uint32); doc_ids (int64; the last bit array marks null ids) and lengths (uint32); the
index with the start of each block (uint32); the blocks; CRC32 of all of it (uint32). One separator byte follows.

A block holds up to 128 ids: minimum (uint32), bit width (uint8), number of exceptions (uint8), the differences to the
minimum packed at that width, then the exceptions' places (uint8) and whole differences (uint32). The width is the one
that holds 90 % of the block's differences; larger ones are exceptions and packed as 0.

Files are written by Spark's own writer, on any file system that Spark knows, under its commit protocol: a lost
executor's task is run again and leaves no half-written file.

Defined cases: null or empty text: the end id alone. Null doc_id: before all others. Equal doc_ids: next to each other,
by text. An empty table: no files, no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from foldwise.llm import bytescan, wordbpe
from foldwise.runtime import materialise, shared_dir, ship, table

BLOCK, SHARE, END_ID = 128, 0.9, 1
SEGMENT_TOKENS = 1 << 20
MAGIC = b"PFR2"


def _width(x: np.ndarray) -> np.ndarray:
    """Bits of each non-negative integer below 2**32."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks' bytes and the start of each block."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.uint32)
    count = -(-n // BLOCK)
    padded = np.concatenate([ids, np.full(count * BLOCK - n, ids[-1], ids.dtype)]).astype(np.int64).reshape(count, BLOCK)
    low = padded.min(1)
    diff = padded - low[:, None]
    at = int(SHARE * BLOCK) - 1
    width = _width(np.partition(diff, at, 1)[:, at])
    out = diff >= (np.int64(1) << width)[:, None]
    n_out = out.sum(1)
    size = 6 + BLOCK * width // 8 + 5 * n_out
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        body[start + k] = (low >> (8 * k)) & 255
    body[start + 4], body[start + 5] = width, n_out
    kept = np.where(out, 0, diff).astype(np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = (kept[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1
            packed = np.packbits(bits.reshape(len(rows), -1).astype(np.uint8), axis=1, bitorder="little")
            body[(start[rows] + 6)[:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(out)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
    at = start[row] + 6 + BLOCK * width[row] // 8
    body[at + nth] = place
    for k in range(4):
        body[at + n_out[row] + 4 * nth + k] = (diff[row, place] >> (8 * k)) & 255
    return body.tobytes(), start.astype(np.uint32)


def unpack_blocks(body: bytes, start: np.ndarray, n: int) -> np.ndarray:
    """The ids of whole blocks, found by the index."""
    count = len(start)
    if not count:
        return np.zeros(0, np.uint32)
    data = np.frombuffer(body, np.uint8)
    at = start.astype(np.int64)
    low = sum(data[at + k].astype(np.int64) << (8 * k) for k in range(4))
    width, n_out = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    values = np.zeros((count, BLOCK), np.int64)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            size = BLOCK * int(w) // 8
            bits = np.unpackbits(data[(at[rows] + 6)[:, None] + np.arange(size)], axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            values[rows] = bits @ (np.int64(1) << np.arange(int(w), dtype=np.int64))
    row = np.repeat(np.arange(count), n_out)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
    places = at[row] + 6 + BLOCK * width[row] // 8 + nth
    first = at[row] + 6 + BLOCK * width[row] // 8 + n_out[row] + 4 * nth
    values[row, data[places]] = sum(data[first + k].astype(np.int64) << (8 * k) for k in range(4))
    return (values + low[:, None]).reshape(-1)[:n].astype(np.uint32)


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, number: int = 0) -> bytes:
    body, start = pack_blocks(ids)
    head = np.array([number, len(doc_ids), len(ids), len(start), len(body)], "<u4").tobytes()
    known = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    nulls = np.packbits(np.array([d is None for d in doc_ids], np.uint8)).tobytes()
    whole = MAGIC + head + known + nulls + lengths.astype("<u4").tobytes() + start.astype("<u4").tobytes() + body
    return whole + np.array([zlib.crc32(whole)], "<u4").tobytes()


def read_segments(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, lengths and ids of each segment of a file; ValueError if it is damaged."""
    view, at = memoryview(content), 0
    while at < len(view):
        if view[at : at + 4] != MAGIC:
            raise ValueError("no segment starts here")
        n_docs, n_ids, n_blocks, size = (int(x) for x in np.frombuffer(view, "<u4", 4, at + 8))
        p = at + 24
        docs = np.frombuffer(view, "<i8", n_docs, p)
        p += 8 * n_docs
        nulls = np.unpackbits(np.frombuffer(view, np.uint8, -(-n_docs // 8), p))[:n_docs]
        p += -(-n_docs // 8)
        lengths = np.frombuffer(view, "<u4", n_docs, p).astype(np.int64)
        p += 4 * n_docs
        start = np.frombuffer(view, "<u4", n_blocks, p)
        p += 4 * n_blocks
        ids = unpack_blocks(view[p : p + size], start, n_ids)
        p += size
        if zlib.crc32(view[at:p]) != int(np.frombuffer(view, "<u4", 1, p)[0]):
            raise ValueError("a segment's checksum is wrong")
        yield [None if x else int(d) for d, x in zip(docs, nulls)], lengths, ids
        at = p + 5


_tables: dict[str, wordbpe.PieceTable] = {}


def library_table(path: str) -> tuple[wordbpe.WordBpe, wordbpe.PieceTable]:
    """The tokenizer, and a table of pieces that the library encodes when they are new."""
    bpe = wordbpe.load(path)
    if path not in _tables:
        _tables[path] = wordbpe.PieceTable(bpe.encode_new)
    return bpe, _tables[path]


def _encoder(path: str):
    """(number of the range, doc_id, text) -> segments."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = library_table(path)
        docs: list = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = number = 0

        def segment():
            out = write_segment(docs, np.concatenate(lengths), np.concatenate(held), number)
            docs.clear(), lengths.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0)[0].as_py()
            ids, i = batch.column(1).to_pylist(), 0
            for run in wordbpe.runs(batch.column(2)):
                flat, own = wordbpe.encoded(bpe, pieces, run)
                own = own + 1
                whole = np.full(len(flat) + len(run), END_ID, np.uint32)
                whole[np.arange(len(flat)) + np.repeat(np.arange(len(run)), own - 1)] = flat
                docs += ids[i : i + len(run)]
                i += len(run)
                lengths.append(own)
                held.append(whole)
                size += len(whole)
                if size >= SEGMENT_TOKENS:
                    yield segment()
                    size = 0
        if docs:
            yield segment()

    return bytescan.tidy(encode)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, n_files: int | None = None, file_bytes: int = 128 << 20) -> None:
    """Encode (doc_id, text) and write the files. Their number follows the input's size, or the session's shuffle partitions if more."""
    spark = docs.sparkSession
    ship(spark)
    if n_files is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes) if size < 1 << 60 else 1)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Rows of one id may meet in several files: the start of the text tells them apart.
    dealt = rows.repartitionByRange(n_files, F.asc("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    # Spark's text writer puts a string's bytes out as they are.
    dealt.select(F.spark_partition_id().alias("number"), "doc_id", "text").mapInArrow(_encoder(tokenizer or wordbpe.default_path()), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("number", "doc_id", "local", "n_tokens", "ids_crc32")
    for batch in batches:
        for content in batch.column(0):
            rows: dict[str, list] = {k: [] for k in names}
            first, data = 0, content.as_buffer()
            for docs, lengths, ids in read_segments(data):
                stops = np.cumsum(lengths)
                rows["number"] += [int.from_bytes(data[4:8].to_pybytes(), "little")] * len(docs)
                rows["doc_id"] += docs
                rows["local"] += (first + stops - lengths).tolist()
                rows["n_tokens"] += lengths.tolist()
                body = memoryview(ids.astype("<u4").tobytes())
                rows["ids_crc32"] += [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip((stops - lengths).tolist(), stops.tolist())]
                first += len(ids)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([(k, pa.int64()) for k in names]))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone, whatever their names."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    read = materialise(files.mapInArrow(_decode, "number bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"), "index")
    sizes = read.groupBy("number").agg(F.sum("n_tokens").alias("size"))
    # One row a file; the numbers of ranges ascend with doc_id.
    before = sizes.select("number", (F.sum("size").over(Window.orderBy("number")) - F.col("size")).alias("before"))
    return read.join(before, "number").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_index(spark, path)
