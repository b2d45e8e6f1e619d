"""BPE and token files against the library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from foldwise.llm import bpe, tokenfile, wordbpe  # noqa: E402

ALPHABET = "abcdefghijklmnopqrstuvwxyz    \n\t'’“”éÉßİıΣςσ中文\u0301\u200b\xa0\x1c\x85\x00\u2028'st'll0123456789!!!<|>/w&#%_ǅﬁ\u212a\u2126"


def texts():
    rnd = random.Random(2)
    fuzz = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return fuzz + ["", None, "a<|endoftext|>b <|startoftext|>", "</w> <</w>>", "x'sure it's I'LL", "ΑΣ ΑΣ.", "Ω Å é", "hello " * 5000, "q" * 3000, "<|endoftext|>" * 3]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(wordbpe.default_path())


def test_every_vocabulary_token_is_sound():
    coder = bpe.Speculative(wordbpe.default_path())
    some = random.Random(1).sample(sorted(coder.vocab), 2000)
    assert all((coder.merge(t) == (coder.vocab[t],)) == (t in coder.proposable) for t in some)
    pairs = np.array([[coder.vocab[random.Random(i).choice(some)] for i in (k, -k - 1)] for k in range(300)])
    inner = {i: t for t, i in coder.vocab.items()}
    for (a, b), apart in zip(pairs, coder.apart(pairs[:, 0], pairs[:, 1])):
        if not inner[a].endswith(bpe.STOP):
            assert apart == (coder.merge(inner[a] + inner[b]) == (a, b))


def test_encode_and_decode_equal_the_library(spark, library):
    rows = list(enumerate(texts()))
    want = {i: e.ids for (i, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False))}
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, ids string")
    for r in bpe.encode_decode(df).collect():
        assert r["ids"] == want[r["doc_id"]]
        assert r["decoded"] == library.decode(want[r["doc_id"]], skip_special_tokens=False)
    for r in bpe.digests(df).collect():
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 1 << 32, n), rng.integers(300, 900, n)).astype(np.uint32)
    body, start = tokenfile.pack_blocks(ids)
    assert len(start) == -(-n // 128) and (tokenfile.unpack_blocks(body, start, n) == ids).all()
    segment = tokenfile.write_segment([5, None], np.array([1, n]), np.append(ids, np.uint32(1))) + b"\n"
    docs, lengths, back = next(tokenfile.read_segments(segment))
    assert docs == [5, None] and lengths.tolist() == [1, n] and (back == np.append(ids, 1)).all()
    broken = bytearray(segment)
    broken[-8] ^= 1
    with pytest.raises(ValueError):
        list(tokenfile.read_segments(bytes(broken)))


def test_token_files(spark, library, tmp_path, monkeypatch):
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts())] + [(None, "no id"), (6, "twice"), (6, "again")]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    path = str(tmp_path / "files")
    tokenfile.write_tokens(df, path, n_files=5)
    got = sorted(tokenfile.read_index(spark, path).collect(), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [e.ids + [1] for e in library.encode_batch([t or "" for _, t in want], add_special_tokens=False)]
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [r["n_tokens"] for r in got] == list(map(len, ids))
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    empty = str(tmp_path / "empty")
    tokenfile.write_tokens(df.where("false"), empty)
    assert tokenfile.read_index(spark, empty).count() == 0


def test_a_very_long_word_is_merged_in_time(library):
    import time

    rnd = random.Random(8)
    coder = bpe.Speculative(wordbpe.default_path())
    words = ["".join(rnd.choice("etaoinshr") for _ in range(n)) for n in (65, 300, 1 << 20)] + ["ab" * 5000, "a" * 9999]
    began = time.process_time()
    got = [coder.encode_new([w.encode()])[0].tolist() for w in words]
    assert time.process_time() - began < 60
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_short_words_merged_together():
    rnd = random.Random(9)
    coder = bpe.Speculative(wordbpe.default_path())
    words = ["".join(rnd.choice("etaoinshr#") for _ in range(rnd.randint(1, 70))) + coder.suffix for _ in range(500)] + ["e" * n + coder.suffix for n in range(1, 30)]
    assert [tuple(x) for x in coder.merge_all(words)] == [coder.merge(w) for w in words]


@pytest.mark.parametrize("limits", [(1_000_000, 6_000_000), (40, 6_000_000), (1_000_000, 60)])
def test_forgetting_and_marks_change_nothing(library, limits):
    """Strings of special tokens count in the raw text only; a table that forgets gives the same ids."""
    rows = [t or "" for t in texts()] + ["<|ENDOFTEXT|> <|endoftext|>", "x<|endoftext|>", "a\xa0b", "ab" * 600 + " c", "A</W> </w"]
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    for coder in (bpe.Speculative(wordbpe.default_path()), wordbpe.load(wordbpe.default_path())):
        table = wordbpe.PieceTable(coder.encode_new, *limits)
        for _ in range(2):
            got = []
            for k in range(0, len(rows), 50):
                flat, size = wordbpe.encoded(coder, table, rows[k : k + 50])
                got += [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])]
            assert got == want


def test_file_names_do_not_matter(spark, tmp_path):
    """Ranges are ordered by the number in their files, as names stop to ascend at 100,000 files; equal ids over ranges."""
    rows = [(i // 3 if i < 60 else 77, f"text {i % 7} of {i}") for i in range(90)] + [(None, None), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"number": F.lit("x"), "start": F.lit(1.5)})
    path = tmp_path / "files"
    tokenfile.write_tokens(df, str(path), n_files=6)
    read = lambda: sorted((r["start"], r["doc_id"], r["ids_crc32"]) for r in tokenfile.read_index(spark, str(path)).collect())
    before = read()
    files = sorted(path.glob("part-*"))
    assert len(files) > 4
    for k, f in enumerate(files):
        f.rename(path / f"part-{99_999 - k:05d}{f.name[10:]}")
    assert read() == before and [r[1] is None for r in before] == [True] * 2 + [False] * 90


def test_very_long_texts_and_repeated_rows(spark, library):
    long = "word " * 300_000
    rows = [(1, long), (1, long), (2, "x"), (2, "x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_tokens": F.lit(0), "ids": F.lit("y"), "decoded": F.lit(2)})
    n = {len(long): len(library.encode(long, add_special_tokens=False).ids), 1: 1}
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.digests(df).collect())
    assert got == [(0, 0), (1, n[len(long)]), (1, n[len(long)]), (2, 1), (2, 1)]
