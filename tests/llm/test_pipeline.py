"""The pipeline's stages, each on its own input, against brute force."""

import collections
import random

import pytest
from docengine.llm import quality
from pyspark.sql import functions as F

import corpus_pipeline as P
from test_operators import DOC, WORD, wide_groups


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))
    rows = []
    for i in range(80):
        t = text(rng.randrange(5, 20))
        if i % 2:
            t += "\nRead more stories like this one."
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(100 + k, rows[3][1], "en", "s0", 0) for k in range(5)]
    rows += [(200, "Home | About | News | More | Login\n" * 30, "en", "s1", 0), (201, "BUY NOW!! GO GET IT!! " * 30, "en", "s1", 0), (202, None, None, None, None), (203, "", "en", None, 0), (204, text(8), None, None, None)]
    return rows


def test_stages(spark, raw):
    docs = spark.createDataFrame(raw, DOC)
    one = {r.doc_id: r.text for r in P.quality_rules(spark, docs, "").collect()}
    assert set(one) == {r[0] for r in raw if r[0] not in (200, 201, 202, 203)}
    assert all(one[r[0]] == quality.judge(r[1], min_words=50, most_repeat=0.5, most_lost=0.5)[4] for r in raw if r[0] in one)

    two_df = P.line_dedup(spark, spark.createDataFrame([(k, v, "en", raw[0][3], 0) for k, v in one.items()], DOC), "")
    assert two_df.columns == P.COLUMNS
    two = {r.doc_id: r.text for r in two_df.collect()}
    df = collections.Counter(k for t in one.values() for k in {x.strip().lower() for x in t.split("\n")})
    assert two == {i: "\n".join(x for x in t.split("\n") if df[x.strip().lower()] < 10) for i, t in one.items()}
    assert "Read more stories like this one." not in two[1]

    source = {r[0]: r[3] for r in raw}
    three_df = P.near_dedup(spark, spark.createDataFrame([(k, v, "en", source[k], len(v)) for k, v in two.items()], DOC), "")
    three = {r.doc_id: r.text for r in three_df.collect()}
    groups = wide_groups(two)
    assert three == {i: two[i] for i in set(groups.values())}
    assert 3 in three and not set(range(100, 105)) & set(three)

    four = collections.Counter(r.doc_id for r in P.mix_sources(spark, three_df, "").collect())
    assert set(four) <= set(three) and max(four.values()) <= 2
    size = lambda t: len(WORD.findall(t))
    total = sum(map(size, three.values()))
    assert abs(sum(n * size(three[i]) for i, n in four.items()) - 1.5 * total) <= 4 * max(map(size, three.values()))

    four_df = spark.createDataFrame([(i, three[i], "en", source[i], 0) for i, n in four.items() for _ in range(n)], DOC)
    pieces = P.pack(spark, four_df, "").collect()
    starts = collections.Counter(r.doc_id for r in pieces if r.start == 0)
    assert starts == four
    assert all(len(r.ids) == r.length for r in pieces)


def test_run_and_empty_tables(spark, sf):
    assert P.run(spark, sf).count() > 0
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack"]
    empty = spark.createDataFrame([], DOC)
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0


LONG = " ".join(f"word{i % 977} tells{i % 331} more{i % 53}" for i in range(9_000)) + "."
CLEAN = [f"This is sentence number {i} about the {w}, and it ends well. It has some more words to say about {w}s." for i, w in enumerate(["river", "harbour", "garden", "street", "mountain"])]


def odd_rows():
    """Null and empty texts, null ids and sources, repeated ids, repeated rows, a very long text."""
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate(CLEAN)]
    rows += [(10, None, None, None, None), (11, "", "en", "s0", 0), (12, " \n\t ", "en", None, 0), (None, CLEAN[0] + " And one more.", None, "s1", None), (None, "Another clean text that nobody has said before, all on its own. It goes on for a while.", "en", None, 0)]
    rows += [(3, "A text under an id that stands on another one as well, which is fine with us.", "en", "s1", 0), rows[1], rows[1], (20, LONG, "en", "s0", len(LONG))]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC).repartition(3).withColumn("line_kept", F.lit("clash")).withColumn("q_kept", F.lit(0)).withColumn("mix_copies", F.lit("x")).withColumn("fp", F.lit("f"))


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_every_stage_takes_odd_rows(spark, odd, name):
    rows, stage = odd_rows(), dict(P.STAGES)[name]
    df = stage(spark, odd, "")
    got = [tuple(r) for r in df.collect()]
    texts = collections.Counter((r[0], r[1] or "") for r in rows)
    if name == "pack":
        assert {r.doc_id for r in df.collect()} == {r[0] for r in rows}
        assert sum(r.start == 0 for r in df.collect()) == len(rows)
        return
    assert df.columns == P.COLUMNS
    have = collections.Counter((r[0], r[1] or "") for r in got)
    if name == "quality_rules":
        assert have == collections.Counter({k: n for k, n in texts.items() if k[1].strip()})
    elif name == "line_dedup":
        assert have == texts
    elif name == "near_dedup":
        groups = wide_groups({i: t for i, (_, t) in enumerate(sorted(texts, key=lambda k: (k[0] is None, k[0] or 0)))})
        assert max(have.values()) == 1 and len(have) == len(set(groups.values()))
        assert (1, CLEAN[1]) in have and (20, LONG) in have and (0, CLEAN[0]) in have
    else:
        assert set(have) <= set(texts) and max(have[k] / texts[k] for k in have) <= 2
        assert have[(20, LONG)] in (1, 2)
