"""Vector codes, whitening and byte-level BPE against brute force and exact round trips."""

import base64
import random

import numpy as np
import pytest
from docengine.llm import bpe, vectorcodes, whitening
from pyspark.sql import functions as F

VEC = "vec_id long, embedding array<float>, label int"


def vectors(n, dims, seed=1, label=3):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dims)) * rng.uniform(0.1, 1.0, dims)).astype(np.float32)
    return [(i, v.tolist(), int(i % label)) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def odd():
    """Copies, ties, nulls, bad components, an odd length, null and repeated ids and labels."""
    rows = vectors(90, 16)
    rows += [(200 + i, rows[4][1], None) for i in range(40)]
    rows += [(300, None, 1), (301, [], 1), (302, [float("nan")] * 16, 1), (303, [1.0, None] * 8, 1), (304, [float("inf")] * 16, 1), (305, [0.5] * 8, 1)]
    rows += [(None, [0.25] * 16, None), (7, [0.0] * 16, 2), (7, rows[7][1], 2)]
    random.Random(5).shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark, odd):
    return spark.createDataFrame(odd, VEC).withColumns({"code": F.lit("c"), "error": F.lit("e"), "x": F.lit(0), "whitened": F.lit(1), "deviation": F.lit("d")}).repartition(3)


def kept(rows, dims):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(e is not None and np.isfinite(e) for e in r[1])]


# ---- codes ----


@pytest.mark.parametrize(("n", "dims", "spread"), [(1, 3, 5), (2, 2, 1), (16, 8, 3), (16, 8, 4000), (256, 8, 50), (100, 1, 20)])
def test_tree_finds_the_lowest_nearest_entry(n, dims, spread):
    rng = np.random.default_rng(n * dims + spread)
    entries = rng.integers(-spread, spread + 1, (n, dims))
    entries[n // 2 :: 7] = entries[0]  # equal entries
    queries = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (500, dims)), entries])
    index, best = vectorcodes.EntryTree(entries).nearest(queries)
    far = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (best == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()


def test_tree_keeps_ties_of_very_large_integers():
    entries = np.array([[0, 0], [1 << 28, 0], [0, 1 << 28], [(1 << 28) + 1, 1]])
    queries = np.array([[1 << 27, 1 << 27], [1 << 27, 0], [(1 << 28) + 1, 0]])
    index, best = vectorcodes.EntryTree(entries, leaf=1).nearest(queries)
    far = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (best == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()


def test_tree_prunes():
    rng = np.random.default_rng(2)
    tree = vectorcodes.EntryTree(rng.integers(-1000, 1000, (256, 2)))
    tree.nearest(rng.integers(-1000, 1000, (2000, 2)))
    assert tree.taken < 0.25 * 2000 * 256


def brute_codes(rows, parts, entries, rounds, scale):
    rows = sorted(((r[0] is None, r[0] or 0), [int(np.floor(scale * float(e))) for e in r[1]], r) for r in rows)
    x = np.array([r[1] for r in rows], dtype=object).reshape(len(rows), parts, -1)
    books = [[list(x[i, p]) for i in range(min(entries, len(rows)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [x[i, p] for i in range(len(x)) if found[i][p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    return [(r[2][0], [j for _, j in f], sum(d for d, _ in f)) for r, f in zip(rows, assign())], books


def test_codes_equal_brute_force(spark, odd, table):
    found = vectorcodes.compress(table, parts=4, entries=8, rounds=3, scale=256)
    want, books = brute_codes(kept(odd, 16), 4, 8, 3, 256)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.code, r.error) for r in found.rows.collect()), key=order) == sorted(want, key=order)
    assert found.codebooks.tolist() == books
    back = {(r.vec_id, tuple(r.embedding)) for r in found.restored(256).collect()}
    assert back == {(i, tuple(c / 256 for p, j in enumerate(code) for c in books[p][j])) for i, code, _ in want}


def test_codes_of_few_rows_and_none(spark):
    few = spark.createDataFrame(vectors(3, 8), VEC)
    found = vectorcodes.compress(few, parts=2, entries=16)
    assert {tuple(r.code) for r in found.rows.collect()} == {(0, 0), (1, 1), (2, 2)} and found.rows.agg(F.sum("error")).first()[0] == 0
    for nothing in (few.limit(0), spark.createDataFrame([(1, None, 1), (2, [], 1)], VEC)):
        assert vectorcodes.compress(nothing).rows.collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vectorcodes.compress(few, parts=3)
    with pytest.raises(ValueError, match="62 bits"):
        vectorcodes.compress(spark.createDataFrame([(1, [1e8] * 8, 1)], VEC), parts=2)


# ---- whitening ----


@pytest.mark.parametrize(("dims", "k", "values"), [(6, 16, None), (40, 5, None), (300, 8, "close"), (300, 4, "equal"), (30, 3, "rank")])
def test_lobpcg_finds_leading_pairs(dims, k, values):
    rng = np.random.default_rng(dims)
    falling = np.sort(rng.uniform(0.1, 5, dims))[::-1]
    if values == "close":
        falling[:10] = 6 - np.arange(10) * 1e-3
    elif values == "equal":
        falling[:3] = 7.0
    elif values == "rank":
        falling[2:] = 0
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    v = (q * falling) @ q.T
    calls = []
    e, x, rest = whitening.lobpcg(lambda b: calls.append(b.shape[1]) or v @ b, dims, k)
    k = min(k, dims)
    assert np.allclose(e, falling[:k], rtol=1e-11, atol=1e-11) and np.allclose(x.T @ x, np.eye(k), atol=1e-12)
    assert (np.linalg.norm(v @ x - x * e, axis=0) <= 2e-10 * max(falling[0], 1)).all() and rest.max() <= 1e-10
    if values is None:
        assert np.allclose(np.abs((q[:, :k] * x).sum(axis=0)), 1, atol=1e-12)


def test_whitening_equals_brute_force(spark, odd, table):
    rows, model = whitening.whiten(table, k=5, scale=64, offset=1_000_000)
    given = kept(odd, 16)
    x = np.array([[int(np.floor(64 * float(e))) + 1_000_000 for e in r[1]] for r in given], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - 1_000_000 - (s - n * 1_000_000) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:5], q[:, ::-1][:, :5]
    assert model.n == n and model.sums == s.tolist() and model.identity_error <= 1e-10
    assert np.allclose(model.eigenvalues, e, rtol=1e-12) and np.allclose(model.explained, e / np.trace(v), rtol=1e-12)
    got = rows.collect()
    sign = np.sign((model.components * q).sum(axis=0))
    want = sorted((r[0] is None, r[0] or 0, int(((n * a - s) ** 2).sum()), *np.round(((a - 1_000_000 - (s - n * 1_000_000) / n) @ q) / np.sqrt(e) * sign, 8).tolist()) for r, a in zip(given, x))
    assert len(got) == len(want)
    for a, b in zip(sorted((r.vec_id is None, r.vec_id or 0, r.deviation, *np.round(r.whitened, 8).tolist()) for r in got), want):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], atol=1e-7)


def test_whitening_of_few_rows_and_none(spark):
    two = spark.createDataFrame(vectors(3, 8), VEC)
    rows, model = whitening.whiten(two)
    assert model.components.shape == (8, 2) and all(len(r.whitened) == 2 for r in rows.collect())
    assert abs(model.explained.sum() - 1) < 1e-12
    for none in (two.limit(0), two.limit(1), two.filter("vec_id = 0").union(two.filter("vec_id = 0"))):
        rows, model = whitening.whiten(none)
        assert model is None and rows.collect() == [] and rows.columns == ["vec_id", "deviation", "whitened"]


def test_deviations_beyond_a_long_are_null():
    a = np.array([[1, 2], [1 << 31, 0]])
    n, s = 1 << 20, np.array([5, 7], dtype=object)
    assert whitening._deviations(a, n, s, 7) == [(n - 5) ** 2 + (2 * n - 7) ** 2, None]


# ---- byte-level BPE ----


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


ODD = ["", " ", "a", "don't  we'll\n\n\tit's 12 345.6 <|endoftext|> é中文😀", "\x1c \x1d x\x1e\n\x1f y \x85 z  　w", "a ​ b﻿", "'s 's's  's", "\r\n \r\n x", " " * 10 + "\n" + " " * 10 + "x", "ẞ ÀÉ ﬁ ½ ² ①", "\u0000\u0001", "🇩🇪👩‍👩‍👧"]


def back(ranks, ids):
    return b"".join(map(bpe.pieces(ranks).__getitem__, ids))


def test_ids_are_the_librarys(plain, ranks):
    rng = random.Random(4)
    alphabet = ["a", "word", " ", "  ", "\n", "\t", "'s", "9", "é", "中", "!", "\x1c", "\x85", " ", " ", "😀"]
    texts = ODD + ["".join(rng.choices(alphabet, k=400)) for _ in range(60)] + ["".join(rng.choices(alphabet, k=60_000)) for _ in range(2)]
    one = bpe.codec(ranks)
    for t in texts:
        for size in (10, 1000, bpe.CHUNK):
            parts = list(bpe.chunks(t, size))
            assert "".join(parts) == t
            assert [i for p in parts for i in plain.encode_ordinary(p)] == plain.encode_ordinary(t), (t[:80], size)
        assert list(one.encode(t)) == plain.encode_ordinary(t)
        assert back(ranks, one.encode(t)) == t.encode()


@pytest.mark.parametrize("blank", [" ", "\n", "　", " \t\n"])
@pytest.mark.parametrize(("before", "after"), [("", ""), ("x", ""), ("", "y"), ("word.", "next one"), ("a\x1c", "\x1cb")])
def test_long_runs_of_blanks_are_one_piece(plain, ranks, blank, before, after):
    t = before + blank * 6000 + after + " tail" + blank * 5000 + after
    assert list(bpe.codec(ranks).encode(t)) == plain.encode_ordinary(t)


def test_texts_on_which_the_library_gives_up(ranks):
    one = bpe.codec(ranks)
    for t in ("x" + " " * 1_200_000 + "y", "\n" * 1_200_000, "a" * 300_000, "é " * 300_000):
        assert back(ranks, one.encode(t)) == t.encode()


def test_columns_round_trip(spark, plain, ranks):
    rows = [(i, t, "old") for i, t in enumerate([*ODD, None, "again", "again", "long text. " * 30_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    lists = bpe.encode(docs, ranks=ranks)
    assert lists.columns == ["doc_id", "text", "ids"] and dict(lists.dtypes)["ids"] == "array<int>"
    got = {r.doc_id: r for r in bpe.decode(lists, ranks=ranks).collect()}
    for i, t, _ in rows:
        assert got[i].ids == plain.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode() and got[i].text == t
    packed = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, ranks=ranks, packed=True), ranks=ranks).collect()}
    for i, t, _ in rows:
        assert np.frombuffer(packed[i].ids, dtype="<u4").tolist() == got[i].ids and packed[i].decoded == got[i].decoded
    half = spark.createDataFrame([(1, plain.encode_ordinary("中")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(half, ranks=ranks).orderBy("doc_id").collect()][1] == b""
    assert bpe.decode(bpe.encode(docs.limit(0), ranks=ranks), ranks=ranks).collect() == []
    broken = docs.limit(1).select("doc_id", F.expr("cast(x'61ff62' as string)").alias("text"))
    assert [bytes(r.decoded) for r in bpe.decode(bpe.encode(broken, ranks=ranks), ranks=ranks).collect()] == ["a�b".encode()]
