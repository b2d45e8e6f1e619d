"""Near duplicates by ProbMinHash, banding and verification.

Texts are sets of 5-word shingles (words: runs of letters and digits, lower case) weighted by
1 + ln(count) / 4, so a repeated passage weighs a little more than once.
ProbMinHash: each shingle is a Poisson process whose rate is its weight; its arrivals fall on random registers, a
register keeps the earliest, and a process ends once it is later than every register of its text. Two texts agree on a
register with the probability Jaccard similarity of their weighted sets. ``BANDS`` bands of ``ROWS`` registers each
make the candidates; a pair at similarity 0.8 is missed by all bands with a chance under 1e-4.
A link may also be one of plain Jaccard similarity, which can lie far above the weighted one where lines repeat. So
each text has a second signature of the same hashes with weights of 1; it is the first one if no shingle repeats.
Its bands make candidates too, and a pair is screened by the signature that agrees more.

1. Exact copies (equal word sequences) become one class with its smallest id. Only classes go on.
2. In each bucket (band and key) all members are compared with one leader, so a bucket of n makes n - 1 pairs.
   Signatures sort out, then the exact similarity of the texts decides: the larger of probability Jaccard and
   plain Jaccard is at least ``THRESHOLD``.
3. Links make components by label propagation with pointer jumping.
4. Links that a leader can't show: buckets that still hold several components go on in rounds, with the shingles of
   their members beside them. The member nearest to the bucket's consensus leads; all members of other components
   that pass the screen are compared with it, exactly and in place, and those that link join its component before the
   next one leads. So a bucket costs its members times the clusters in it, and no pair becomes a row. A pair is left
   to the first band that it shares; no pair of components that shares a band is left out. Buckets of more than
   ``BLOCK`` times ``ALL_PAIRS`` members or ``BLOCK_BYTES`` of shingles are dealt into blocks: those of the largest
   component and those of all others; the latter meet all blocks, each in a group of its own. New links join the
   components.

Defined cases: null text: empty. Texts without words are alike only if equal byte for byte; under five words, all words
are one shingle. Null doc_id: alone, with a null class and group. Rows of equal doc_id are one document: its groups are
joined, and ``keep`` leaves one row of each of its texts. Repeated rows: all listed by ``groups``, one stays in ``keep``. Ties of leaders: by hash, then id. An empty
table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.llm import bytescan
from foldwise.runtime import materialise, ship, table

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
REGISTERS = BANDS * ROWS
#: Pairs whose signatures agree on less than this share of registers are over 4.5 standard deviations below the threshold.
LEAST_AGREEMENT = 0.63
ALL_PAIRS, BLOCK, BLOCK_BYTES = 64, 16, 16 << 20
#: Parts that rows of one class are dealt to.
SALTS = 16


def shingles(s: bytescan.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash and weight, ordered by both; each text's fingerprint (two numbers)."""
    start, end, owner = s.words(bytescan.NOT_ALNUM)
    h = s.hashes(start, end)
    keys, at = bytescan.window_hashes(h, owner, SHINGLE)
    own = owner[at]
    n = np.bincount(owner, minlength=s.n)
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        weight = bytescan.mix((np.arange(len(h)) - first[owner] + 1).astype(np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * (weight | np.uint64(1)), dtype=np.uint64)])
        total2 = np.concatenate([[np.uint64(0)], np.cumsum(bytescan.mix(h) * (bytescan.mix(weight) | np.uint64(1)), dtype=np.uint64)])
    one = bytescan.mix(total[first + n] - total[first] + n.astype(np.uint64))
    two = bytescan.mix(total2[first + n] - total2[first])
    bare = np.flatnonzero(n == 0)  # no words: the bytes count
    if len(bare):
        raw = s.hashes(s.off[:-1][bare], s.off[1:][bare])
        one[bare], two[bare] = raw, bytescan.mix(raw ^ np.uint64(0x5BD1E995))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        keys, own = np.concatenate([keys, one[short]]), np.concatenate([own, short])
    order = np.lexsort((keys, own))
    keys, own = keys[order], own[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(keys)]]))
    return own[at], keys[at], 1.0 + np.log(counts) / 4, one, two


def prob_min_hash(own: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n, REGISTERS) of 64-bit hashes; rows of texts without shingles are 0."""
    first = np.full(n * REGISTERS, np.inf)
    sig = np.zeros(n * REGISTERS, np.uint64)
    own, keys, weights = own.copy(), keys.copy(), weights.copy()
    t = np.zeros(len(keys))
    k = 0
    with np.errstate(over="ignore"):
        while len(keys):
            k += 1
            r = bytescan.mix(keys + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
            t += -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
            at = own * REGISTERS + (bytescan.mix(r ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(first, at, t)
            won = first[at] == t
            sig[at[won]] = keys[won]
            last = first.reshape(n, REGISTERS).max(1)
            go = t < last[own]  # later arrivals come later still
            own, keys, weights, t = own[go], keys[go], weights[go], t[go]
    return sig.reshape(n, REGISTERS)


def probability_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Exactly, by one sort: for a common element d, 1 / sum over e of max(x_e / x_d, y_e / y_d)."""
    if not len(ka) or not len(kb):
        return 0.0
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, "right")
    sx, sy = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    return float((1 / ((only_a + sx[upto]) / x + (only_b + sy[-1] - sy[upto]) / y)).sum())


def plain_jaccard(ka: np.ndarray, kb: np.ndarray) -> float:
    common = len(np.intersect1d(ka, kb, assume_unique=True))
    return common / max(1, len(ka) + len(kb) - common)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in bytescan.slices(batch.column(1), lower=True):
            own, keys, weights, one, two = shingles(s)
            sig = prob_min_hash(own, keys, weights, s.n)
            filled = np.bincount(own, minlength=s.n) > 0
            # Without repeated shingles both signatures are the same.
            plain = sig.copy()
            repeats = np.bincount(own, weights > 1, s.n) > 0
            some = repeats[own]
            number = np.cumsum(repeats) - 1
            if some.any():
                plain[repeats] = prob_min_hash(number[own[some]], keys[some], np.ones(int(some.sum())), int(repeats.sum()))
            both = np.concatenate([_bands(sig), _bands(plain)], 1)
            flat = np.where(filled, 2 * BANDS, 0)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat)]), pa.int32()), pa.array(both[filled].ravel().view(np.int64)))
            small = (np.concatenate([sig, plain], 1) & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s.first, s.n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), column, pa.array([r.tobytes() for r in small], pa.binary())],
                ["id", "f1", "f2", "keys", "sig"],
            )


def _bands(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    bands = np.zeros((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            bands = bands * np.uint64(0xD6E8FEB86659FD93) + sig[:, r::ROWS]
        return bytescan.mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64))


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal registers of (n, 2 * REGISTERS) and one or n others: by weights or plain, whichever is more."""
    same = x == y
    return np.maximum(same[:, :REGISTERS].mean(1), same[:, REGISTERS:].mean(1))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, 2 * REGISTERS)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) -> (a, b) whose signatures agree enough."""
    for batch in batches:
        if batch.num_rows:
            good = pa.array(_agreement(_signatures(batch.column(2)), _signatures(batch.column(3))) >= LEAST_AGREEMENT)
            yield batch.select(["a", "b"]).filter(good)


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, fingerprint, distinct shingles and their weights as bytes."""
    for batch in batches:
        for s in bytescan.slices(batch.column(1), lower=True):
            own, keys, weights, one, two = shingles(s)
            cut = np.searchsorted(own, np.arange(s.n + 1)).tolist()
            pairs = list(zip(cut, cut[1:]))
            items = [keys[a:b].astype("<u8").tobytes() for a, b in pairs]
            heavy = [weights[a:b].astype("<f8").tobytes() if (weights[a:b] > 1).any() else b"" for a, b in pairs]  # nothing: all are 1
            parts = items, heavy
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(pa.array(x, pa.binary()) for x in parts)], ["id", "f1", "f2", "items", "weights"])


def _rounds(key: int, t: pa.Table, threshold: float) -> tuple[list, list, list]:
    """Links between members of a bucket (or two blocks of it) that join different components."""
    ids, comp, block = (t[c].to_numpy() for c in ("id", "comp", "block"))
    keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    sig, items, weights = _signatures(t["sig"]), t["items"], t["weights"]
    band = np.argwhere(keys == key)[0, 1] % BANDS
    keys, plain = keys[:, :BANDS], keys[:, BANDS:]
    comp = np.unique(comp, return_inverse=True)[1]
    one_side = block.min() == block.max()
    # The consensus: the value in the middle of each register once they are sorted, which is what most have if most agree.
    near = (sig == np.sort(sig, axis=0)[len(sig) // 2]).sum(1)
    order = np.lexsort((ids, -near))
    sets: dict[int, tuple] = {}

    def of(i: int) -> tuple:
        if i not in sets:
            own, heavy = np.frombuffer(items[i].as_py(), "<u8"), np.frombuffer(weights[i].as_py(), "<f8")
            sets[i] = own, heavy if len(heavy) else None
        return sets[i]

    out: tuple[list, list, list] = [], [], []
    for k, i in enumerate(order):
        hit = order[k + 1 :]
        hit = hit[comp[hit] != comp[i]]
        if not one_side:
            hit = hit[block[hit] != block[i]]
        if not len(hit):
            continue
        share = _agreement(sig[hit], sig[i])
        hit, share = hit[share >= LEAST_AGREEMENT], share[share >= LEAST_AGREEMENT]
        shared = (keys[hit] == keys[i]) | (plain[hit] == plain[i]) | (keys[hit] == plain[i]) | (plain[hit] == keys[i])
        first = shared.argmax(1) == band if len(hit) else np.zeros(0, bool)
        for j in hit[first][np.argsort(-share[first], kind="stable")]:
            if comp[j] == comp[i]:
                continue
            (ka, wa), (kb, wb) = of(i), of(j)
            alike = plain_jaccard(ka, kb)
            if alike < threshold and not (wa is None and wb is None):  # with weights of 1 both similarities are one
                alike = max(alike, probability_jaccard(ka, np.ones(len(ka)) if wa is None else wa, kb, np.ones(len(kb)) if wb is None else wb))
            if alike >= threshold:
                comp[comp == comp[j]] = comp[i]
                out[0].append(int(min(ids[i], ids[j])))
                out[1].append(int(max(ids[i], ids[j])))
                out[2].append(alike)
    return out


def _cells(threshold: float):
    """A cell of whole buckets, or of two blocks of one: links."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending"), ("id", "ascending")])
        names = [t[c].to_numpy() for c in ("key", "low", "high")]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in names])
        found: tuple[list, list, list] = [], [], []
        at = np.append(np.flatnonzero(new), t.num_rows).tolist()
        for a, b in zip(at, at[1:]):
            for x, y in zip(found, _rounds(names[0][a], t.slice(a, b - a), threshold)):
                x += y
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["a", "b", "similarity"])

    return run


def cross_links(mixed: DataFrame, payload: DataFrame, threshold: float, all_pairs: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, similarity) of links inside buckets (key, id, comp) with several components. payload: id, sig, keys, items,
    weights. Members of a bucket's largest component aren't compared with each other, so in a large bucket they are dealt
    into blocks that meet the blocks of all others; those also meet each other."""
    most = BLOCK * all_pairs
    size = F.octet_length("items") + F.octet_length("weights") + F.octet_length("sig") + 8 * F.size("keys")
    own = payload.groupBy("id").agg(F.sum(size).alias("bytes"))
    rows = materialise(mixed.join(own, "id").select("key", "id", "comp", "bytes"), "sized")
    by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    largest = F.max(F.struct("bytes", "n", "comp"))
    buckets = by_comp.groupBy("key").agg(largest.alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(n / most), F.ceil(size / block_bytes), F.lit(1)).cast("bigint")
    whole = (F.col("n") <= most) & (F.col("bytes") <= block_bytes)
    others = blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))
    buckets = buckets.select("key", "bytes", whole.alias("whole"), F.col("top.comp").alias("top"), others.alias("m"), blocks(F.col("top.n"), F.col("top.bytes")).alias("d"))
    buckets = materialise(buckets, "mixed_buckets")
    cells = -(-(buckets.where("whole").agg(F.sum("bytes")).first()[0] or 0) // max(1, block_bytes // 4)) + 1
    in_top, h = F.col("comp") == F.col("top"), F.xxhash64("id", "key")
    zero = F.lit(0).cast("bigint")
    block = F.when(F.col("whole"), zero).when(in_top, F.col("m") + F.pmod(h, F.col("d"))).otherwise(F.pmod(h, F.col("m")))
    last = F.when(F.col("whole"), zero).when(in_top, F.col("m") - 1).otherwise(F.col("m") + F.col("d") - 1)
    rows = rows.drop("bytes").join(buckets, "key").withColumn("block", block).withColumn("_with", F.explode(F.sequence(zero, last)))
    rows = rows.withColumn("low", F.least("block", "_with")).withColumn("high", F.greatest("block", "_with"))
    cell = F.when(F.col("whole"), F.pmod(F.xxhash64("key"), F.lit(cells))).otherwise(F.xxhash64("key", "low", "high"))
    full = rows.select(cell.alias("cell"), "key", "low", "high", "block", "id", "comp").join(payload, "id").where("array_contains(keys, key)")
    full = full.select("cell", "key", "low", "high", "block", "id", "comp", "sig", "keys", "items", "weights")
    return full.groupBy("cell").applyInArrow(_cells(threshold), "a bigint, b bigint, similarity double")


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column):
            for s in bytescan.slices(column, lower=True):
                own, keys, weights, _, _ = shingles(s)
                cut = np.searchsorted(own, np.arange(s.n + 1))
                for i in range(s.n):
                    yield keys[cut[i] : cut[i + 1]], weights[cut[i] : cut[i + 1]]

        for batch in batches:
            same = [max(probability_jaccard(*x, *y), plain_jaccard(x[0], y[0])) for x, y in zip(sets(batch.column(2)), sets(batch.column(3)))]
            same = np.array(same) if same else np.zeros(0)
            good = same >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good)), pa.array(same[good])], ["a", "b", "similarity"])

    return run


def screened(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose signatures agree enough."""
    sig = signed.select("id", "sig")
    rows = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return rows.select("a", "b", "sa", "sb").mapInArrow(_alike, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of those screened pairs (a, b) that are at least as similar as the threshold."""
    pairs = materialise(pairs, "pairs")
    needed = materialise(texts.join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "left_semi"), "texts")
    rows = pairs.join(needed.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(needed.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return materialise(rows.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), "a bigint, b bigint, similarity double"), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of all ids in links (a, b); comp is the smallest id of the component."""
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        lower = labels.join(near, "id").select("id", "comp", F.least("comp", "m").alias("low"))
        ahead = labels.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        moved = materialise(lower.join(ahead, "low").select("id", "comp", F.least("low", "far").alias("next")), "labels")
        labels = moved.select("id", F.col("next").alias("comp"))
        if not moved.where("next <> comp").limit(1).count():
            return labels


def groups(docs: DataFrame, threshold: float = THRESHOLD, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """doc_id, class_id (smallest id of the same words), group_id (smallest id of the component) and n_links (verified
    pairs of its class) of each row of (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("id IS NOT NULL")
    signed_all = materialise(known.mapInArrow(bytescan.tidy(_sign), "id bigint, f1 bigint, f2 bigint, keys array<bigint>, sig binary"), "signed")
    prints = signed_all.groupBy("f1", "f2").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    # Only classes of several rows meet their rows; a class may hold a third of all, so its rows are dealt by a salt.
    many = prints.where("n > 1").select("f1", "f2", "class", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = signed_all.select("id", "f1", "f2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    member = materialise(salted.join(many, ["f1", "f2", "salt"], "left").select("id", F.coalesce("class", "id").alias("class")), "classes")
    # One row a class. Where an id stands for several texts, each of them is compared.
    signed = materialise(signed_all.join(prints, (F.col("id") == F.col("class")) & (signed_all.f1 == prints.f1) & (signed_all.f2 == prints.f2), "left_semi").dropDuplicates(["id", "f1", "f2"]), "reps")
    texts = known.join(signed.select("id"), "id", "left_semi")

    keyed = signed.select("id", F.explode(F.array_distinct("keys")).alias("key"))  # keys of different bands differ
    order = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))
    buckets = keyed.groupBy("key").agg(F.min(order)["id"].alias("leader"), F.count("*").alias("n")).where("n > 1")
    buckets = materialise(buckets, "buckets")
    members = materialise(keyed.join(buckets, "key"), "members")
    star = members.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    links = verified(screened(star, signed), texts, threshold)
    # An id with several classes holds them together.
    several = member.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b")).join(signed.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", F.lit(1.0).alias("similarity"))
    links = links.unionByName(several)
    comp = components(links)

    named = members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = named.groupBy("key").agg((F.min("comp") < F.max("comp")).alias("mixed")).where("mixed").select("key")
    mixed_rows = materialise(named.join(mixed, "key").select("key", "id", "comp").distinct(), "mixed")
    inside = texts.join(mixed_rows.select("id").distinct(), "id", "left_semi").select("id", "text")
    sets = materialise(inside.mapInArrow(bytescan.tidy(_packed_sets), "id bigint, f1 bigint, f2 bigint, items binary, weights binary").dropDuplicates(["id", "f1", "f2"]), "sets")
    payload = materialise(signed.select("id", "f1", "f2", "sig", "keys").join(sets, ["id", "f1", "f2"]).drop("f1", "f2"), "payload")
    more = cross_links(mixed_rows, payload, threshold, all_pairs)
    links = materialise(links.unionByName(more).dropDuplicates(["a", "b"]), "links")
    comp = components(links)

    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    of_class = comp.join(degree, "id", "left").select(F.col("id").alias("class"), "comp", "n_links")
    out = member.join(of_class, "class", "left").select(
        F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.coalesce("comp", "class").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return out.unionByName(rows.where("id IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links")))


def keep(docs: DataFrame, **settings) -> DataFrame:
    """One document of each group (its smallest id), with all columns of ``docs``."""
    found = materialise(groups(docs, **settings).where("doc_id IS NOT NULL"), "groups")
    per_id = found.groupBy("doc_id").agg(F.min("group_id").alias("_group"), F.count("*").alias("_rows"))
    gone = per_id.where("doc_id <> _group").select(F.col("doc_id").alias("_gone"))
    kept = docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
    if per_id.where("_rows > 1").limit(1).count():
        # Rows repeat an id: one of each of its texts stays. Words decide, or bytes where there are none.
        words = F.trim(F.regexp_replace(F.lower("text"), r"[\x00-\x7F&&[^a-z0-9]]+", " "))
        null = kept.where("doc_id IS NULL")
        own = "_words" + "_" * max(map(len, docs.columns))  # no column of that name
        named = kept.where("doc_id IS NOT NULL").withColumn(own, F.when(words != "", words).otherwise(F.coalesce("text", F.lit(""))))
        kept = named.dropDuplicates(["doc_id", own]).select(*(F.col(f"`{c}`") for c in kept.columns)).unionByName(null)
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
