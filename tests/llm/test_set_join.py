"""near_dedup leaves no pair out: groups equal those of all pairs, near the threshold too, in crowded cells and with common shingles."""

import math
import random

import numpy as np
import pytest
from docengine.llm import setjoin, simhash
from pyspark.sql import functions as F

from test_operators import shingles, wide_groups


def kept(spark, rows, **options):
    return sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect())


def test_no_pair_at_the_threshold_is_left_out(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near = [], 0
    for i in range(500):
        w = [word() for _ in range(104)]
        v = list(w)
        for k in rng.sample(range(4, 100, 6), 2):  # 10 of 100 shingles changed on either side: 90 of 110
            v[k] = word()
        a, b = shingles(" ".join(w)), shingles(" ".join(v))
        near += 0.8 <= len(a & b) / len(a | b) < 0.83
        rows += [(i, " ".join(w)), (1000 + i, " ".join(v))]
    assert near > 400
    assert kept(spark, rows) == sorted(set(wide_groups(dict(rows)).values()))


@pytest.mark.parametrize(("crowd", "sample"), [(4000, 16), (7, 1)])
def test_groups_of_near_copies_and_common_words(spark, crowd, sample):
    """Near copies of a few texts, chains of them, short texts and texts of two words only, among texts with a common passage."""
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(400)]
    passage = rng.sample(pool, 30)
    rows = []
    for g in range(3):
        w = [rng.choice(pool) for _ in range(90)]
        for _ in range(60):
            for k in rng.sample(range(90), rng.choice([0, 1, 1, 2])):
                w[k] = rng.choice(pool)
            rows.append(" ".join(w))
    rows += [" ".join(passage + [rng.choice(pool) for _ in range(rng.randrange(5, 60))]) for _ in range(80)]
    rows += [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + [None, "", " \n"]
    texts = dict(enumerate(rows))
    assert kept(spark, list(texts.items()), crowd=crowd, sample=sample) == sorted(set(wide_groups(texts).values()))


def test_prefixes_meet_in_any_order():
    rng = np.random.default_rng(4)
    common = np.sort(rng.choice(200, 40, replace=False)).astype(np.uint64)
    rank = rng.permutation(40).astype(np.int64)
    for n in range(1, 60):
        x = np.sort(rng.choice(200, n, replace=False)).astype(np.uint64)
        gone = rng.choice(n, n // 5, replace=False)  # 0.8 of x is in y, and y is in x
        y = np.delete(x, gone)
        assert np.intersect1d(setjoin.prefix(x, common, rank, 0.8), setjoin.prefix(y, common, rank, 0.8)).size
    assert [setjoin.prefix_length(n, 0.8) for n in (0, 1, 4, 5, 10, 300)] == [0, 1, 1, 2, 3, 61]


def test_sketches_tell_no_more_bits_than_elements(spark):
    """Sketches of all lengths, one twice as long as the other too: a pair of the similarity is never dropped, far ones mostly are."""
    rng = np.random.default_rng(5)
    rows, far = [], []
    for n in (1, 3, 40, 63, 70, 127, 250, 515, 1300):
        for _ in range(12):
            pool = rng.integers(0, 2**64, 3 * n, dtype=np.uint64)
            skip = int(rng.uniform(0, 0.5) * n)
            x, y = pool[:n], pool[skip : skip + max(round(n * rng.uniform(0.8, 1.25)), math.ceil(0.8 * n))]
            if not 0.8 <= len(x) / len(y) <= 1.25:
                continue
            both = len(np.intersect1d(x, y))
            told = [(len(v), setjoin.sketch(np.sort(v)).view(np.int64).tolist()) for v in (x, y)]
            rows.append((*told, both / (len(x) + len(y) - both)))
    one = "struct<size: int, sketch: array<bigint>>"
    found = spark.createDataFrame(rows, f"x {one}, y {one}, similarity double").withColumn("unlike", setjoin.unlike(F.col("x"), F.col("y"), 0.8)).collect()
    assert {len(r.x.sketch) / len(r.y.sketch) for r in found} >= {0.5, 1, 2}
    assert not [r for r in found if r.similarity >= 0.8 and r.unlike]
    far = [r.unlike for r in found if r.similarity < 0.6]
    assert sum(far) > 0.8 * len(far) > 10


def test_texts_with_a_passage_in_common_are_not_read_again(spark, monkeypatch):
    """Their prefixes meet, their sketches differ: whole sets, the heavy part on the disk, are made for near copies alone."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(60)])) for i in range(40)]
    rows.append((100, rows[0][1].rsplit(" ", 3)[0]))
    read, written = [], simhash.written

    def counted(df, **options):
        out = written(df, **options)
        if df.columns == ["fp", "shingles"]:
            read.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    assert kept(spark, rows, sample=1 << 30) == list(range(40))  # none is known to be common
    assert sum(read) == 2
