"""Quality classifier: an interpolated modified Kneser-Ney model of 4-grams of characters, trained on trusted text.

Trusted are all labelled rows of quality 1. Four fifths of them, by a hash of the id, train the model, the other fifth
sets the thresholds: per language a quantile of their perplexity, with a margin. A document is kept if its perplexity is
at most its language's threshold. For this, ``PRIOR`` characters of its language's median are added to each text, so that
a few characters alone say little.

Trusted texts meet their ids in a shuffled join, whatever their number. A bitmap of hashed ids of fixed size goes to all
tasks first, so that nearly only trusted texts are moved. Quantiles are exact, read from running counts in order.

All counting is relational. Grams of trusted text are counted per slice and summed by key; continuation counts,
contexts' totals and the counts of counts for the discounts follow by grouping. The distinct grams of the whole corpus
then meet these sharded counts in one join an order, which gives each gram's log probability. Documents are scored
against that table of grams: broadcast if it has at most ``broadcast_grams`` rows, else by joining each chunk of
documents with the part of the table that it uses. Both ways give the same sums.

Characters are UTF-16 code units; white space is one space, digits are ``0``; four fit a 64-bit key exactly.

Defined cases: null text: empty, one gram (the end); null or unknown language, or under ``min_language`` calibration
rows: the threshold over all languages; no trusted rows at all: every document is kept, with a null threshold. Equal rows
get equal scores. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldwise.llm import bytescan
from foldwise.operators.scan import ordered_scan
from foldwise.runtime import materialise, ship, table

N = 4
START, STOP = 2, 3
QUANTILE, MARGIN, MIN_LANGUAGE, PRIOR = 0.99, 0.25, 40, 30
BROADCAST_GRAMS, CHUNK_BYTES = 4_000_000, 8 << 20
#: Words of 64 bits in the bitmap of ids.
ID_WORDS = 1 << 20

_CLASS = np.arange(1 << 16, dtype=np.uint16)
_CLASS[[*range(0x21), 0x7F, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = 0x20
_CLASS[48:58] = 48


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of the texts in order as 64-bit keys, and the number of grams of each text (its characters and the end)."""
    pads = np.array([START] * (N - 1), np.uint16)
    parts: list[np.ndarray] = []
    for t in texts:
        parts += [pads, _CLASS[np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16)], np.array([STOP], np.uint16)]
    x = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)
    x = x[keep].astype(np.uint64)
    stop = np.flatnonzero(x == STOP)
    end = np.zeros(len(x), bool)
    end[stop] = True
    # A gram ends at each character after the three that open its text.
    opening = x == START
    at = np.flatnonzero(~opening)
    g = (x[at - 3] << np.uint64(48)) | (x[at - 2] << np.uint64(32)) | (x[at - 1] << np.uint64(16)) | x[at]
    ends = np.flatnonzero(end[at])
    return g, np.diff(np.concatenate([[-1], ends]))


class GramScores:
    """A hash table from gram to value, in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values, used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits), np.zeros(1 << bits, bool)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = ~used[at]
            winner = np.full(len(used), -1) if len(left) > len(used) // 8 else {}
            if isinstance(winner, dict):
                for i, a in zip(left[free].tolist(), at[free].tolist()):
                    winner[a] = i
                slots, who = np.array(list(winner), np.int64), np.array(list(winner.values()), np.int64)
            else:
                winner[at[free]] = left[free]
                slots = np.flatnonzero(winner >= 0)
                who = winner[slots]
            used[slots], self.keys[slots], self.values[slots] = True, keys[who], values[who]
            rest = ~np.isin(left, who)
            left, at = left[rest], (at[rest] + 1) & self.mask
        self.longest = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all in the table."""
        at = self._slot(keys)
        miss = np.flatnonzero(self.keys[at] != keys)
        while len(miss):
            at[miss] = (at[miss] + 1) & self.mask
            miss = miss[self.keys[at[miss]] != keys[miss]]
        return self.values[at]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of each slice."""
    for s in bytescan.slices(column):
        yield s.first, [s.text(i).decode("utf-8", "replace") for i in range(s.n)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _texts(batch.column(0)):
            keys, n = np.unique(grams(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "c"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each gram at least once; a small table of what was seen last keeps most repetitions back."""
    seen = np.zeros(1 << 20, np.uint64)
    for batch in batches:
        for _, texts in _texts(batch.column(0)):
            g = grams(texts)[0]
            slot = ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            new = seen[slot] != g
            seen[slot[new]] = g[new]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(g[new]).view(np.int64))], ["g"])


def _tail(g: Column, k: int) -> Column:
    """The last k characters of a gram."""
    return g.bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < N else g


def _orders(counts: DataFrame) -> list[DataFrame]:
    """Counts of each order, highest first: (g, c). Lower orders count the distinct characters before, as Kneser-Ney does."""
    out = [counts]
    for k in range(N - 1, 0, -1):
        out.append(out[-1].groupBy(_tail(F.col("g"), k).alias("g")).agg(F.count("*").alias("c")))
    return out


def _discounts(order: DataFrame) -> tuple[float, float, float]:
    n = {r["c"]: r["n"] for r in order.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))  # type: ignore[return-value]


def gram_scores(corpus: DataFrame, counts: DataFrame) -> DataFrame:
    """corpus: distinct grams (g). counts: trusted grams (g, c). Returns (g, logp): log2 of the model's probability of
    the gram's last character after its first three. One sharded join an order for the count, one for the context."""
    orders = [materialise(o, "order") for o in _orders(counts)]
    alphabet = orders[-1].count() + 1
    out = corpus.withColumn("p", F.lit(1.0 / alphabet))
    for k in range(1, N + 1):
        order = orders[N - k]
        d1, d2, d3 = _discounts(order)
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.shiftrightunsigned("g", 16)
        stats = order.groupBy(context.alias("h")).agg(F.sum("c").alias("total"), F.sum(off).alias("freed"))
        own = order.select(F.col("g").alias("w"), (F.col("c") - off).alias("left"))
        key = _tail(F.col("g"), k)
        out = out.withColumn("w", key).withColumn("h", F.shiftrightunsigned(key, 16)).join(own, "w", "left").join(stats, "h", "left")
        out = out.select("g", F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce("left", F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("total")).alias("p"))
    return out.select("g", F.log2("p").alias("logp"))


def _score_with(keys_values, where: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = keys_values.value
        scores = GramScores(keys, values)
        for batch in batches:
            for first, texts in _texts(batch.column(where)):
                g, n = grams(texts)
                total = np.add.reduceat(scores.get(g), np.cumsum(n) - n)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(total)], [*part.schema.names, "_n", "_logp"])

    return run


def _score_chunk(docs: pa.Table, scores: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return pa.table({"_row": pa.array([], pa.string()), "_n": pa.array([], pa.int64()), "_logp": pa.array([], pa.float64())})
    found = GramScores(scores["g"].to_numpy().view(np.uint64), scores["logp"].to_numpy())
    n_all, logp_all = [], []
    for _, texts in _texts(docs["_text"].combine_chunks()):
        g, n = grams(texts)
        n_all.append(n)
        logp_all.append(np.add.reduceat(found.get(g), np.cumsum(n) - n))
    return pa.table({"_row": docs["_row"], "_n": pa.array(np.concatenate(n_all), pa.int64()), "_logp": pa.array(np.concatenate(logp_all))})


def _chunk_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in _texts(batch.column(1)):
            g, n = grams(texts)
            chunk = np.repeat(batch.column(0).slice(first, len(texts)).to_numpy(zero_copy_only=False).astype(np.uint64), n)
            pairs = np.unique(np.stack([chunk, g]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int64)), pa.array(pairs[1].view(np.int64))], ["chunk", "g"])


def chunk_count(text_bytes: int, partitions: int) -> int:
    """Chunks of about ``CHUNK_BYTES`` of text, each scored whole in a task."""
    return max(64, partitions, -(-text_bytes // CHUNK_BYTES))


def score(docs: DataFrame, scores: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, chunks: int | None = None) -> DataFrame:
    """``docs`` with ``_n`` (grams) and ``_logp`` (sum of log2 probabilities) of the column text."""
    spark = docs.sparkSession
    if scores.count() <= broadcast_grams:
        t = scores.toArrow()
        sent = spark.sparkContext.broadcast((t["g"].to_numpy().view(np.uint64), t["logp"].to_numpy()))
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, _n bigint, _logp double"
        return docs.mapInArrow(_score_with(sent, docs.columns.index("text")), schema)
    if not chunks:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        chunks = chunk_count(size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("text"), F.lit(""))), 256)
    keyed = docs.select(row.alias("_row"), F.col("text").alias("_text")).dropDuplicates(["_row"]).withColumn("chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks)))
    used = keyed.select("chunk", "_text").mapInArrow(_chunk_grams, "chunk bigint, g bigint").distinct().join(scores, "g")
    summed = keyed.groupBy("chunk").cogroup(used.groupBy("chunk")).applyInArrow(lambda a, b: _score_chunk(a, b), "_row string, _n bigint, _logp double")
    return docs.withColumn("_row", row).join(summed, "_row").drop("_row")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(_id, train): the ids of all trusted rows; four fifths train."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("_id")).distinct()
    return ids.select("_id", (F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)) != 0).alias("train"))


def trusted_rows(docs: DataFrame, ids: DataFrame, words: int = ID_WORDS) -> DataFrame:
    """(_id, text, lang, train) of all rows of ``docs`` whose id is among ``ids``."""
    bit = F.pmod(F.xxhash64("_id", F.lit(31)), F.lit(64 * words))
    placed = lambda df: df.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    bitmap = placed(ids).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")).alias("_set"))  # at most ``words`` rows
    rows = placed(docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text", "lang")).join(F.broadcast(bitmap), "_word")
    likely = rows.where("shiftrightunsigned(_set, CAST(_bit & 63 AS INT)) & 1 = 1").select("_id", "text", "lang")
    return likely.join(ids.hint("shuffle_hash"), "_id")


def quantiles(values: DataFrame, by: list[str], column: str, shares: dict[str, float], parallel: bool | None = None) -> DataFrame:
    """One row for each key of ``by`` (not null): its rows n and the exact quantiles of ``column``, interpolated between neighbours."""
    ties = values.groupBy(*by, column).agg(F.count("*").alias("_m"))
    seen = ordered_scan(ties, [column], {"_upto": ("sum", F.col("_m"))}, parallel, by)
    seen = seen.join(values.groupBy(*by).agg(F.count("*").alias("n")), by)
    at = {name: (F.col("n") - 1) * F.lit(share) for name, share in shares.items()}
    value = lambda i: F.max(F.when((F.col("_upto") - F.col("_m") <= i) & (i < F.col("_upto")), F.col(column)))
    ends = [value(f(x)).alias(f"_{name}_{k}") for name, x in at.items() for k, f in enumerate((F.floor, F.ceil))]
    out = seen.groupBy(*by, "n").agg(*ends)
    return out.select(*by, "n", *[(F.col(f"_{name}_0") + (F.col(f"_{name}_1") - F.col(f"_{name}_0")) * (x - F.floor(x))).alias(name) for name, x in at.items()])


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, min_language: int = MIN_LANGUAGE, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """docs (doc_id, text, lang and any others) with _n, _perplexity, _threshold and _kept."""
    spark = docs.sparkSession
    ship(spark)
    ids = materialise(trusted_ids(labels), "trusted")
    trusted = materialise(trusted_rows(docs, ids), "trusted_rows")
    counts = materialise(trusted.where("train").select("text").mapInArrow(_counts, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c")), "counts")
    corpus = docs.select("text").mapInArrow(_distinct, "g bigint").distinct()
    scores = materialise(gram_scores(corpus, counts), "scores")
    held = materialise(score(trusted.where("NOT train").drop("train"), scores, broadcast_grams).select("lang", (-F.col("_logp") / F.col("_n")).alias("bits")), "held")
    # One row a language and one for all; the margin widens the distance from the median to the quantile.
    both = held.where("lang IS NOT NULL").select(F.lit(False).alias("whole"), "lang", "bits").union(held.select(F.lit(True), F.lit(""), "bits"))
    limit = F.col("high") + F.lit(margin) * (F.col("high") - F.col("mid")) + F.lit(0.1)
    limits = materialise(quantiles(both, ["whole", "lang"], "bits", {"mid": 0.5, "high": quantile}).withColumn("limit", limit), "thresholds")
    by_language = limits.where(~F.col("whole") & (F.col("n") >= min_language)).select(F.col("lang").alias("_lang"), F.col("mid").alias("_own_mid"), F.col("limit").alias("_own"))
    overall = limits.where("whole").first() or {"limit": None, "mid": None}
    out = score(docs, scores, broadcast_grams)
    out = out.join(by_language, out["lang"] == by_language["_lang"], "left")
    most, mid = F.coalesce("_own", F.lit(overall["limit"]).cast("double")), F.coalesce("_own_mid", F.lit(overall["mid"]).cast("double"))
    perplexity = F.pow(F.lit(2.0), (F.lit(PRIOR) * F.coalesce(mid, F.lit(0.0)) - F.col("_logp")) / (F.lit(PRIOR) + F.col("_n")))
    out = out.withColumn("_perplexity", perplexity).withColumn("_threshold", F.pow(F.lit(2.0), most))
    return out.withColumn("_kept", F.col("_threshold").isNull() | (F.col("_perplexity") <= F.col("_threshold"))).drop("_lang", "_own", "_own_mid", "_logp")


def keep(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns, whatever their names."""
    used = {"doc_id", "text", "lang"}
    inner = [c if c in used else f"c{i}" for i, c in enumerate(docs.columns)]
    return classify(docs.toDF(*inner), labels, **settings).where("_kept").select(*inner).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.col("_n").alias("n_grams"), F.col("_perplexity").alias("perplexity"), F.col("_threshold").alias("threshold"), F.col("_kept").alias("kept"))
