"""Each operator against a brute-force version on small fixtures with nulls, empty, repeated, tied and long rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from docengine.llm import common, components, linededup, lm, mixing, packing, pii, quality, sharding, simhash, vectors, warc
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, pool=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(120):
        body = [" ".join(words(rng.randrange(3, 14), i * 100 + k)).capitalize() + "." for k in range(rng.randrange(1, 9))]
        if i % 3 == 0:
            body.append("Shared line here.")
        if i % 4 == 0:
            body.insert(0, "  SHARED LINE here.\t")
        out.append((i, "\n".join(body), "en", None if i % 17 == 0 else f"s{i % 4}", 0))
    near = " ".join(words(400, 77))
    out += [(200 + k, near + (f" tail{k}" if k else ""), "en", "s0", 0) for k in range(6)]
    out += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t ", "en", "s1", 0), (303, "word " * 30_000, "en", "s2", 0), (304, "x" * 50_000, "en", "s2", 0), (305, "é Éa ÉA\nß", "de", "é", 0)]
    out += [out[5], out[5]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = spark.createDataFrame(rows, DOC).repartition(3)
    return clash.withColumns({"shard": F.lit("x"), "slot": F.lit(1.5), "size": F.lit(1), "key": F.lit("k"), "spans": F.lit("s"), "component_id": F.lit(0), "line_kept": F.lit("l"), "q_kept": F.lit(1), "pii_text": F.lit("p"), "mix_size": F.lit("m"), "fp": F.lit("f"), "base": F.lit("b")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_meets_targets_and_reruns(docs, rows, none):
    run = lambda: docs.transform(lambda d: mixing.mix(d, weights=[5.0, 2.0, 1.0], share=1.5)).collect()
    got = run()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    cap = {s: 2.0 * n for s, n in sizes.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if cap[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    taken, biggest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.mix_size == len(WORD.findall(r.text or "")) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(target[r.source])
        assert r.mix_copies <= 2
        taken[r.source] += r.mix_copies * r.mix_size
        biggest[r.source] = max(biggest[r.source], r.mix_size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= biggest[s]
    assert sorted((r.doc_id, r.mix_copies) for r in got) == sorted((r.doc_id, r.mix_copies) for r in run())
    assert mixing.mix(none, weights=[1.0], share=1.0).count() == 0
    mixed = docs.transform(lambda d: mixing.mix(d, weights=[5.0, 2.0, 1.0], share=1.5))
    assert mixing.repeated(mixed, ["doc_id"]).count() == sum(r.mix_copies for r in got)


def test_mix_refines_cuts_like_a_full_sort(spark):
    rng = random.Random(8)
    rows = [(f"s{i % 2}", rng.randrange(0, 50), rng.expovariate(1.0)) for i in range(3000)]
    slim = spark.createDataFrame(rows, "source string, size long, key double")
    size = {s: sum(r[1] for r in rows if r[0] == s) for s in ("s0", "s1")}
    plan = spark.createDataFrame([(s, size[s], 0.4 * size[s], 0, 0.4 * size[s]) for s in size], "source string, source_size long, target double, epochs long, rest double")
    for r in mixing.cuts(slim, plan, rows_a_cut=20).collect():
        before, last = 0, None
        for _, n, key in sorted((r0 for r0 in rows if r0[0] == r.source), key=lambda x: x[2]):
            if before + n / 2 >= r.rest:
                break
            before, last = before + n, key
        # no cut: the refined range alone decides, and ends where the sorted sample does
        taken = {key for s, _, key in rows if s == r.source and (r.cut is not None and key <= r.cut or spark.range(1).select(mixing._rank(F.lit(key))).first()[0] < r.lo)} if r.cut is None else None
        assert r.cut == last or taken == {key for s, _, key in rows if s == r.source and key <= last}


@pytest.mark.parametrize("how", ["doc_id is null", "doc_id % 3 = 0", "repeated"])
def test_mix_without_unique_ids(spark, sf, how):
    """Ids that are null or repeat, and rows that repeat whole: every source ends within half a document of its target."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if how == "repeated":
        docs = docs.unionByName(docs.filter("source = 'src1'")).unionByName(docs.filter("doc_id = 3").withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("__n"))
    else:
        docs = docs.withColumn("doc_id", F.when(~F.expr(how.replace("doc_id is null", "true")), F.col("doc_id")))
    slim = mixing.slim_table(docs, 17)
    run = lambda: mixing.mix_slim(slim, weights=[5.0, 2.0, 1.0], share=1.5)
    by = run().groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert len(by) > 5 and all(abs(r.taken - r.target) <= r.largest / 2 + 1 for r in by)
    key = lambda rows: collections.Counter((r.source, r["size"], r.key, r.copies) for r in rows)
    assert key(run().collect()) == key(run().collect())
    if how != "repeated":
        mixed = mixing.mix(docs, weights=[5.0, 2.0, 1.0], share=1.5)
        both = mixed.groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.first("mix_target").alias("target"), F.max("mix_size").alias("largest")).collect()
        assert all(abs(r.taken - r.target) <= r.largest for r in both)


def test_mix_breaks_ties_by_size(spark):
    """Equal keys: whatever the order of the rows, the same are taken."""
    rows = [("s", n, 1.0) for n in (5, 1, 9, 3)] + [("s", 4, 2.0), ("s", 6, 0.5)]
    plan = [("s", 28, 9.0, 0, 9.0)]
    cuts = set()
    for k in range(4):
        slim = spark.createDataFrame(rows[k:] + rows[:k], "source string, size long, key double")
        cuts.add(mixing.cuts(slim, spark.createDataFrame(plan, "source string, source_size long, target double, epochs long, rest double")).first().cut)
    assert cuts == {1.0}


@pytest.mark.parametrize(("bound", "min_chars"), [(20_000, 1), (0, 1), (20_000, 18), (0, 18)])
def test_lines(docs, rows, none, spark, bound, min_chars, monkeypatch):
    real = common.fetch
    monkeypatch.setattr(linededup, "fetch", lambda big, small, key: real(big, small, key, 7))
    got = docs.transform(lambda d: linededup.dedup_lines(d, min_docs=10, bound=bound, min_chars=min_chars)).collect()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    df = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if len(k) >= min_chars)
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if df[key(x)] < 10]
        want.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted((r.doc_id, r.line_kept, r.line_n, r.line_dropped) for r in got) == sorted(want)
    assert linededup.dedup_lines(none, bound=bound).count() == 0


def test_line_keys_fold_the_case_of_a_to_z_only(spark):
    lines = ["Été", "été", "ÉTÉ", "éTé", "Straße", "straSSe", "ÿ", "Ÿ", "ж", "Ж", "a\u0301", "A\u0301", "ä", "Ä", "\u00c3\u00a9", "é", "\ue3a9\u0080x", "×", "÷", "İ", "i̇", "ß", "ẞ", "日本A", "日本a", "😀A", "😀a", "\xa0A", "A"]
    got = [r.k[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(linededup.line_keys(F.col("t"), 1).alias("k")).collect()]
    fold = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in lines]
    for i in range(len(lines)):
        for j in range(i):
            assert (got[i] == got[j]) == (fold[i] == fold[j]), (lines[i], lines[j])


def test_line_runs_compact_and_increment(spark):
    runs = linededup.LineRuns(spark, fan_in=2)
    make = lambda i: spark.createDataFrame([(i * 10 + k, f"same\nown {i}-{k}") for k in range(2)], "doc_id long, text string")
    first = linededup.dedup_increment(runs, make(0)).collect()
    assert all(r.line_dropped == 0 for r in first)
    for i in (1, 2, 3):
        out = linededup.dedup_increment(runs, make(i)).collect()
        assert {r.line_kept for r in out} == {f"own {i}-0", f"own {i}-1"}
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    # the shared line was known after the first batch, so later batches' runs left it out
    assert runs.seen(1).count() == 9 and runs.seen(2).count() == 1 and runs.seen(3).count() == 0


def test_line_runs_add_up_over_batches(spark, tmp_path):
    """A line that no batch holds often enough by itself, in tables of several files."""
    keyed = [spark.range(4000).repartition(4).select(linededup.line_keys(F.concat(F.lit("line "), (F.col("id") % 1000).cast("string"), F.lit(f"\nown {i} "), F.col("id").cast("string")), 1).alias("keys")) for i in range(4)]
    runs = linededup.LineRuns(spark, fan_in=4)
    for k in keyed:
        runs.add(k, 10)
    assert [len(x) for x in runs.levels] == [0, 1] and runs.seen(10).count() == 1000 and runs.runs()[0].count() == 1000 + 4 * 4000


def test_line_runs_are_joined_without_a_shuffle_of_their_own(spark):
    runs = linededup.LineRuns(spark, fan_in=9)
    keyed = spark.createDataFrame([(f"l{i}\nsame",) for i in range(50)], "text string").select(linededup.line_keys(F.col("text"), 1).alias("keys"))
    runs.add(keyed, 2)
    run = runs.runs()[0]
    new = keyed.select(F.explode("keys").alias("k")).groupBy("k.a", "k.b").count().join(run.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan, plan


def test_shards_are_exact_and_gapless(docs, rows, none):
    got = sharding.shard(docs, 24, rows_a_partition=20).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert {len(v) for v in by.values()} <= {len(rows) // 24, len(rows) // 24 + 1}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(none, 3).count() == 0


@pytest.mark.parametrize("copies", [0, 150])
def test_shards_against_brute_force(spark, rows, copies):
    """Shard and slot of every row, from the same hashes by plain Python; with many equal rows, exact sizes still."""
    given = [(r[0], r[1]) for r in rows] + [(None, "a"), (None, "b"), (None, None)] + [(7000, "copy")] * copies
    df = common.written(spark.createDataFrame(given, "doc_id long, text string").repartition(2))
    got = sharding.shard(df, 5, rows_a_partition=20, seed=3).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(given)
    if copies:
        sizes = collections.Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
        return
    ids = [F.col("doc_id"), F.col("text")]
    n_parts = max(5, math.ceil(len(given) / 20))
    keyed = df.select(*ids, F.pmod(sharding._mixed(3, "part", ids), F.lit(n_parts)).alias("p"), sharding._mixed(3, "first", ids).alias("f"), sharding._mixed(3, "second", ids).alias("s")).collect()
    parts = [sorted((r for r in keyed if r.p == p), key=lambda r: r.f) for p in range(n_parts)]
    shards = collections.defaultdict(list)
    for part, row in zip(parts, sharding.matrix([len(x) for x in parts], 5, 3)):
        at = 0
        for s, n in enumerate(row):
            shards[s] += part[at : at + n]
            at += n
    want = [(r.doc_id, r.text, s, i) for s, held in shards.items() for i, r in enumerate(sorted(held, key=lambda r: r.s))]
    assert collections.Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == collections.Counter(want)


def test_matrix_and_hypergeometric():
    m = sharding.matrix([10, 0, 33, 7], 6, 1)
    assert [sum(r) for r in m] == [10, 0, 33, 7] and sorted(map(sum, zip(*m))) == [8, 8, 8, 8, 9, 9]
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    assert 0 <= sharding.hypergeometric(rng, 10**9, 10**10, 10**8) <= 10**8


def plain_fingerprint(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_groups(fps, distance=2):
    """doc -> smallest doc reachable; fps: doc -> fingerprint."""
    up = {d: d for d in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance and root(a) != root(b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_simhash(docs, rows, none):
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = plain_groups(fps)
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got} == {(d, fps[d], want[d]) for d in fps}
    assert simhash.near_groups(none).count() == 0
    groups = wide_groups({r[0]: r[1] for r in rows})
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(groups.values()))


def shingles(text, width=5):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def wide_groups(texts, similarity=0.8):
    """doc -> smallest doc reachable by pairs with that share of five-word shingles in common."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and both >= similarity * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {d: find(d) for d in texts}


def test_wide_fingerprint_is_a_majority_of_five_word_shingles():
    w = words(300, 5)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(296)]
    hi, lo = simhash.wide_fingerprint(" ".join(w), 5)
    assert hi == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 296)
    assert hi != lo and simhash.wide_fingerprint(None, 5) == (0, 0)


@pytest.mark.parametrize("crowd", [2, 7, 4000])
def test_wide_links_join_what_is_close(spark, crowd):
    """Clusters, chains and single prints: components equal those of all pairs, whatever counts as a crowd."""
    rng = random.Random(5)
    prints = {rng.getrandbits(128) for _ in range(30)}
    for k in range(4):
        x = rng.getrandbits(128)
        for _ in range(25):
            y = x
            for _ in range(rng.randrange(1, 4)):
                y ^= 1 << rng.randrange(128)
            prints.add(y)
        for _ in range(6):  # a chain away from the cluster
            for b in rng.sample(range(128), 9):
                x ^= 1 << b
            prints.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(signed(x >> 64), signed(x & ((1 << 64) - 1))) for x in prints]
    edges = simhash.wide_links(spark.createDataFrame(rows, "hi long, lo long"), distance=10, tables=24, crowd=crowd)
    got = {r.node: r.component for r in components.components(edges).collect()}
    as_node = lambda x: int(simhash.node(np.array([x >> 64], dtype=np.uint64), np.array([x & ((1 << 64) - 1)], dtype=np.uint64))[0])
    want = collections.defaultdict(set)
    for x, c in plain_groups({x: x for x in prints}, 10).items():
        want[c].add(as_node(x))
    have = collections.defaultdict(set)
    for x in prints:
        have[got.get(as_node(x), as_node(x))].add(as_node(x))
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_keep_one_finds_similar_texts(spark):
    """Copies at 5-word similarity 0.85 go, texts that share little stay."""
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows, copies = [], set()
    for i in range(60):
        w = [rng.choice(pool) for _ in range(300)]
        rows.append((i, " ".join(w)))
        v = list(w)
        for k in rng.sample(range(0, 300, 8), 5):  # 25 of 296 shingles changed on either side: 0.844
            v[k] = rng.choice(pool)
        rows.append((1000 + i, " ".join(v)))
        copies.add(1000 + i)
        rows.append((2000 + i, " ".join(w[:100] + [rng.choice(pool) for _ in range(200)])))  # a third shared
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows} - copies <= kept and len(copies & kept) <= 6


def test_keep_one_without_unique_ids(spark):
    """Every group keeps one row, whether ids are null or stand on other texts too."""
    text = lambda k: " ".join(words(60, 9000 + k, 5000))
    rows = [(None, text(k)) for k in range(20)] + [(None, text(0)), (None, text(30)), (5, text(30))]
    rows += [(7, text(40)), (7, text(41)), (8, text(41)), (6, text(42)), (7, text(42)), (9, text(43)), (9, text(43)), (9, text(44))]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(None, text(k)) for k in range(20)] + [(5, text(30)), (7, text(40)), (7, text(41)), (6, text(42)), (9, text(43)), (9, text(44))]
    assert collections.Counter(got) == collections.Counter(want)


@pytest.mark.parametrize("crowd", [5, 4000])
def test_keep_one_by_similarity(spark, crowd):
    """Of pairs at each step of similarity: nine in ten or more found from 0.8 on, none below, crowded cells or not."""
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows, bands = [], {}
    for i in range(400):
        w = [rng.choice(pool) for _ in range(rng.choice([120, 200, 400]))]
        v = [rng.choice(pool) if rng.random() < rng.choice([0.01, 0.02, 0.025, 0.03, 0.04]) else x for x in w]
        a, b = shingles(" ".join(w)), shingles(" ".join(v))
        bands[i] = len(a & b) / len(a | b)
        rows += [(i, " ".join(w)), (1000 + i, " ".join(v))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()}
    assert set(range(400)) <= kept
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        some = [i for i, s in bands.items() if low <= s < high]
        assert len(some) > 20 and sum(1000 + i not in kept for i in some) >= 0.9 * len(some), (low, len(some))
    assert all(1000 + i in kept for i, s in bands.items() if s < 0.8) and sum(s < 0.8 for s in bands.values()) > 50


def test_spanning_forests_are_least():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    hi = np.array([base[rng.integers(6)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 7)).astype(np.uint64), initial=np.uint64(0)) for _ in range(80)], dtype=np.uint64)
    lo = np.zeros(80, dtype=np.uint64)
    far = lambda x, y: int(hi[x] ^ hi[y]).bit_count()
    pairs = simhash._spanning(hi, lo, 9)
    forest, least = components.Forest(), 0
    for d, x, y in sorted((far(x, y), x, y) for x in range(80) for y in range(x)):
        if d <= 9 and forest.root(x) != forest.root(y):
            forest.link(x, y)
            least += d
    assert sum(far(x, y) for x, y in pairs) == least and len(pairs) == len(forest.edges()[0])


@pytest.mark.parametrize("crowd", [3, 10_000])
def test_links_find_every_close_pair(spark, crowd):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(0, 8)):
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=crowd)
    got = {r.node: r.component for r in components.components(edges).collect()}
    want = plain_groups({s: u for s, u in signed.items()})
    assert {s: got.get(s, s) for s in signed} == want


def test_golay_anchors_cover():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    at, anchor, home = simhash.anchors(x, 2)
    assert home.sum() == 500  # a perfect code: one anchor within the radius
    homes = dict(zip(at[home], anchor[home]))
    own = collections.defaultdict(set)
    y = x ^ (np.uint64(1) << np.uint64(5)) ^ (np.uint64(1) << np.uint64(40))
    at2, anchor2, _ = simhash.anchors(y, 2)
    for i, a in zip(at2, anchor2):
        own[i].add(a)
    assert all(homes[i] in own[i] for i in range(500))


def test_quality(docs, rows, none):
    got = {r.doc_id: r for r in quality.clean(docs).collect()}
    for r in rows:
        text, g = r[1] or "", got[r[0]]
        w = WORD.findall(text)
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        assert (g.q_n_words, g.q_word_chars, g.q_n_symbols, g.q_n_dup_lines, g.q_n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))
        assert g.q_base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert quality.clean(none).count() == 0


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("Home page > About this company > Contact the office", "navigation"),
        ("BUY!! NOW!! CHEAP!! OFFER!! TODAY!!", "shouting"),
        ("spam spam spam spam spam spam spam spam spam spam spam", "repetition"),
        ("All rights reserved.", "boilerplate"),
        ("wor###d oth*** thi%%% fou&&&", "symbols"),
        ("one two three four five six seven eight nine ten eleven", "punctuation"),
        ("A plain sentence, with a comma and 3 - 4 words more, ends here.", None),
        ("École où l'été finit. Über alles.", None),
    ],
)
def test_line_rules(line, rule):
    assert quality.line_fails(line, line.encode(), line.encode().split()) == rule


def lm_tokens(t):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(t or "")] + [""]


class PlainModel:
    """The same model from plain counters."""

    def __init__(self, texts):
        tokens = [lm_tokens(t) for t in texts]
        self.c = collections.Counter(w for t in tokens for w in t)
        self.pairs = collections.Counter(p for t in tokens for p in zip(["\n", *t], t))
        self.triples = collections.Counter(p for t in tokens for p in zip(["\n", *t], t, t[1:]))
        self.starts, self.total, self.kinds = len(tokens), sum(self.c.values()), len(self.c)
        once, twice = (sum(v == k for v in self.c.values()) for k in (1, 2))
        self.d = (once + 0.5) / (once + 2 * twice + 1)
        self.m2 = self.mass(list(self.c.values()), sum(v == 1 for v in self.pairs.values()))
        self.m3 = self.mass([n for (_, w), n in self.pairs.items() if w], sum(v == 1 for v in self.triples.values()))

    @staticmethod
    def mass(contexts, single):
        lo, hi = 1e-3, 1e9
        while hi / lo > 1 + 1e-13:
            m = math.sqrt(lo * hi)
            lo, hi = (m, hi) if sum(c * m / (c - 1 + m) for c in contexts) < single else (lo, m)
        return math.sqrt(lo * hi)

    def p(self, u, v, w):
        p1 = ((self.c[w] - self.d) if self.c[w] else self.d * self.kinds) / self.total
        r1 = self.starts if v == "\n" else self.c[v]
        p2 = (self.pairs[v, w] + self.m2 * p1) / (r1 + self.m2)
        r2 = self.pairs[u, v] if u is not None else 0
        return (self.triples[u, v, w] + self.m3 * p2) / (r2 + self.m3)

    def score(self, text):
        t = lm_tokens(text)
        return sum(math.log10(self.p(u, v, w)) for u, v, w in zip([None, "\n", *t], ["\n", *t], t))


def lm_held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1


@pytest.mark.parametrize("block_bytes", [4000, 16_000_000])
def test_lm(docs, rows, none, spark, block_bytes):
    given = [*rows, (None, rows[4][1], None, None, None), (None, "unseen words", None, None, None)]
    m = PlainModel([r[1] for r in given if not lm_held(r[0])])
    more = spark.createDataFrame(given[-2:], DOC)
    got = lm.score(docs.unionByName(more, allowMissingColumns=True), block_bytes=block_bytes).collect()
    want = []
    for r in given:
        t = lm_tokens(r[1])
        base = sum(math.log10((m.c[w] + 0.5) / (m.total + 0.5 * (m.kinds + 1))) for w in t)
        want.append((r[0] is None, r[0] or 0, lm_held(r[0]), len(t), sum(m.c[w] > 0 for w in t), m.total, base, m.score(r[1])))
    got = sorted((g.doc_id is None, g.doc_id or 0, g.held_out, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:6] == w[:6] and g[6:] == pytest.approx(w[6:], rel=1e-6), g
    for u, v in list(m.pairs)[:10]:  # a state's probabilities sum to one, the unknown word's included
        if v:
            assert sum(m.p(u, v, w) for w in [*m.c, "never seen"]) == pytest.approx(1)
    assert lm.score(none).count() == 0
    all_held = [r for r in rows if lm_held(r[0])]
    assert {g.score for g in lm.score(spark.createDataFrame(all_held, DOC)).collect()} == {0.0}


def test_lm_walks_few_and_many_alike():
    rng = np.random.default_rng(3)
    lengths = np.r_[rng.integers(1, 40, 60), 700, 900]
    starts, n = np.cumsum(lengths) - lengths, int(lengths.sum())
    has = [np.ones(n, dtype=bool), rng.random(n) < 0.7, rng.random(n) < 0.4]
    weight, fails, into = [rng.random(n) for _ in range(3)], [np.zeros(n), rng.random(n), rng.random(n)], rng.integers(0, 3, n).astype(np.int8)
    got = lm.walk(starts, lengths, list(zip(has, weight)), fails, into)
    for d, (lo, size) in enumerate(zip(starts, lengths)):
        state, total = 1, 0.0
        for i in range(lo, lo + size):
            k = state
            while not has[k][i]:
                total, k = total + fails[k][i], k - 1
            total, state = total + weight[k][i], into[i]
        assert got[d] == pytest.approx(total)


def test_lm_squeezes_losslessly():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (np.cumsum(lm.unsqueeze(lm.squeeze(np.r_[x[:1], np.diff(x)]), 1000), dtype=np.uint64) == x).all()


def test_lm_knows_what_it_has_read(spark, sf):
    """Texts of the training set and held-out texts score above the unigram base, by far most of them."""
    scored = lm.score(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("held_out").agg(F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("above")).collect()
    assert all(r.above > 0.9 for r in scored), scored


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ranks():
    from docengine.llm.queries import ranks

    return ranks()


def test_ids_are_the_tokenizers_own(tokenizer, rows, spark, sf):
    enc = packing.Encoder(ranks())
    odd = [" lead", "trail ", "", " ", "a  b", "x \n y", "a\tb c", "don't 's re", "a\x1c b c", "é  è", "日本 語", "a b c", "\n\nq r\n", "1 22 333  4"]
    some = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text in [*odd, *[r[1] or "" for r in rows if len(r[1] or "") < 20_000], *some]:
        assert enc.encode(text)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("text", ["end <|endoftext|> of", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>\n", "  <|endoftext|>  x", "no. <|endoftext|>\nNo <|endoftext|", "<|endoftext|> a  b", "One. Two.<|endoftext|> <|EndOfText|>"])
def test_added_tokens_have_their_own_ids(tokenizer, text):
    assert packing.Encoder(ranks()).encode(text)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(docs, rows, none, tokenizer):
    for chunk in (3000, 1_500_000):
        got = packing.pack(docs, ranks=ranks(), with_ids=True, chunk=chunk).collect()
        seqs = collections.defaultdict(list)
        for r in got:
            seqs[r.sequence_id].append(r)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
        for s in seqs.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
        by = collections.defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
        for d in {r[0]: r[1] for r in rows if r[0] != 5}.items():
            ids = [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 1]
            pieces = sorted(by[d[0]], key=lambda r: r.start)
            assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1])
            assert [i for r in pieces for i in r.ids] == ids and {r.doc_tokens for r in pieces} == {len(ids)}
        assert sum(r.length for r in got) == 3 * by[5][0].doc_tokens + sum(p.length for k, v in by.items() if k != 5 for p in v)
    padding = 1 - sum(r.length for r in got) / (2048 * len(seqs))
    assert padding < 0.1  # three short partitions
    assert packing.pack(none, ranks=ranks()).count() == 0


def test_best_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(30):
        points = np.cumsum([rng.randrange(1, 6) for _ in range(25)])
        costs = np.array([rng.choice([0.0, 1.0, 3.0]) for _ in points])
        f, back = packing.best_cuts(points, costs, 10)
        best = [0.0]
        for j, p in enumerate(points):
            best.append(min(best[i + 1] + 10 - (p - (points[i] if i >= 0 else 0)) + costs[j] for i in range(-1, j) if p - (points[i] if i >= 0 else 0) <= 10))
        assert f == pytest.approx(best[1:])


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = [*base, *[b + 0.12 * rng.standard_normal(16) for b in base for _ in range(3)], *[base[0]] * 5]
    rows = [(i, [float(np.float32(k)) for k in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [1.0, None] * 8), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (905, []), (906, [1.0] * 3)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.999999, block=7, bucket=4).collect()}
    floats = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=0.999999, block=7, bucket=4).collect()}
    assert got == floats
    m = np.array([r[1] for r in rows if r[0] < 900])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.9) & ~np.eye(len(m), dtype=bool)
    comp = list(range(len(m)))
    for _ in comp:
        comp = [min([comp[i], *[comp[j] for j in np.flatnonzero(close[i])]]) for i in range(len(m))]
    for i in range(len(m)):
        assert (got[i].n_links, got[i].component_id) == (close[i].sum(), comp[i])
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(900, 907))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_on_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)} | {2000: 2000, 2001: 2000}


KIND = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KIND.items()):
        for m in re.finditer(pattern, text or ""):
            v, d = m[0], re.sub(r"[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


PII_TEXTS = ["mail a.b+c@d.ef_g@h.ij and x@y", "é😀 1.2.3.4.5.6.7.8 999.1.1.1 000256.1.1.1 00255.01.1.1", "4111 1111 1111 1111 4111111111111112 1-2 378282246310005", "+1 (555) 123-4567 +12 +44.20.7946.0958.. +1+2 345 678 9012", "a" * 60_000 + "@", "x@" + "a." * 20_000 + "b", "1" * 50_000, "+" + "1 " * 20_000, "", None, "@@ a@b.c@d.e .@-.-", "%@1.1.1.1 5@6.7.8.9"]


def test_pii_base_spans(spark, sf):
    rows = [(i, t) for i, t in enumerate(PII_TEXTS)] + [(50, PII_TEXTS[0]), (50, PII_TEXTS[0])]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.told(F.col("base")).alias("base")).collect()
    assert sorted((r.doc_id, r.base) for r in got) == sorted((i, plain_spans(t)) for i, t in rows)


TERM = re.compile(r"(?<![^\W\d_])[^\W\d_]{3,}")


def plain_secrets(bare, least):
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", bare):
        v = m[0]
        turns = len(re.findall(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", v))
        if turns >= 6 and sum(n * math.log2(len(v) / n) for n in collections.Counter(v).values()) >= least:
            out.append((m.start(), m.end()))
    return out


def plain_pii(rows, min_texts=3, min_share=0.5, min_bits=4.0, reach=80, secret_bits=80.0):
    """(id, spans) of every row, by the definitions."""
    parsed = {}
    for text in {r[1] or "" for r in rows}:
        base = [x.rsplit(":", 2) for x in plain_spans(text).split(",") if x]
        bare = list(text)
        for k, s, e in base:
            if k == "email":
                bare[int(s) : int(e)] = "\x01" * (int(e) - int(s))
        bare = "".join(bare)
        secrets = plain_secrets(bare, secret_bits)
        masked = list(bare)
        for s, e in secrets:
            masked[s:e] = "\x01" * (e - s)
        parsed[text] = ([(int(s), pii.KINDS.index(k), k, int(e)) for k, s, e in base] + [(s, 4, "secret", e) for s, e in secrets], "".join(masked))
    by, entities, holds = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for text, (spans, masked) in parsed.items():
        for t in TERM.findall(masked):
            holds[t].add(text)
        for s, _, k, e in spans:
            lo = max(0, s - reach)
            left, right = masked[lo:s], masked[e : e + reach]
            left = re.sub(r"^[^\W\d_]+", "", left) if lo else left
            right = re.sub(r"[^\W\d_]+$", "", right) if len(right) == reach else right
            for entity in (k, f"{k}:{text[s:e]}"):
                entities[entity].add(text)
                for t in TERM.findall(left + " " + right):
                    by[t, entity].add(text)
    n = len(parsed)
    terms = {t for (t, x), held in by.items() if len(held) >= min_texts and len(held) >= min_share * len(holds[t]) and math.log2(len(held) / len(holds[t]) * n / len(entities[x])) >= min_bits}
    out = []
    for d, text in rows:
        spans, masked = parsed[text or ""]
        found = [(m.start(), 5, "term", m.end()) for m in TERM.finditer(masked) if m[0] in terms]
        out.append((d, ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted([*spans, *found]))))
    return out


def disclosing_rows():
    fill = lambda i: " ".join(words(20, i))
    rows = [(i, f"{fill(i)}. Quentin Marsh may be reached at qmarsh@corp.example, he said {i}. {fill(i + 50)}") for i in range(6)]
    rows += [(20 + i, f"{fill(i)} plain text said again and again by others {i}, reached at last, may be.") for i in range(40)]
    rows += [(70 + i, f"{fill(i)} passwort = {hashlib.sha1(str(i).encode()).hexdigest()} {fill(i + 9)} été{i}") for i in range(4)]
    rows += [(80 + i, f"{fill(i)} Ünïtoken@x.example Marsh{i} Marsh +1 (555) 123-456{i} " + "Quentin " * i) for i in range(5)]
    return [*rows, (90, "Quentin alone."), (91, None), (92, ""), (None, "Quentin by null"), (None, None), (90, "Quentin alone."), (90, "Quentin twice. Quentin.")]


@pytest.mark.parametrize(("bound", "most", "bits"), [(200_000, 200_000, 1.0), (0, 0, 1.0), (200_000, 200_000, 4.0)])
def test_pii_terms_that_disclose(spark, monkeypatch, bound, most, bits):
    rows = disclosing_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"terms": F.lit(1), "around": F.lit(2), "__same": F.lit(3)})
    real = pii._among
    monkeypatch.setattr(pii, "_among", lambda a, b, k: real(a, b, k, most, 3))
    plain = pii.disclosing
    monkeypatch.setattr(pii, "disclosing", lambda *a, **k: plain(*a, **k, in_plan=min(most, 10_000)))
    got = pii.find(df, min_bits=bits, bound=bound).select("doc_id", pii.told(F.col("spans")).alias("spans")).collect()
    want = plain_pii(rows, min_bits=bits)
    assert collections.Counter((r.doc_id, r.spans) for r in got) == collections.Counter(want)
    if bits == 1.0:
        assert ("term:0:7" in dict(want)[90]) and dict(want)[25] == ""
        text = {r.doc_id: r.pii_text for r in pii.sanitise(df.filter("doc_id < 90"), min_bits=bits).collect()}
        assert "[TERM] [TERM]" in text[0] and "Quentin" not in text[0] and "[EMAIL]" in text[0] and "[SECRET]" in text[70] and text[25] == dict(rows)[25]
    assert pii.find(spark.createDataFrame([], DOC)).count() == 0


def test_pii_against_brute_force_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), min_texts=2, min_bits=2.0).select("doc_id", pii.told(F.col("spans")).alias("spans")).collect()
    assert collections.Counter((r.doc_id, r.spans) for r in got) == collections.Counter(plain_pii(rows, min_texts=2, min_bits=2.0))


def test_pii_finds_terms_and_secrets_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kinds = [s.kind for r in pii.find(docs).select("spans").collect() for s in r.spans]
    assert kinds.count("secret") > 3 and kinds.count("term") > 3


def test_pii_is_not_quadratic_in_matches(spark):
    many = " ".join(f"a{i}@b.cd" for i in range(50_000))
    r = pii.find(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()
    at = [m.span() for m in re.finditer(r"\S+", many)]
    assert [(s.start, s.end) for s in r.base] == at


def test_pii_counts_texts_exactly(spark):
    """A term stands or falls by the number of different texts, to the last one."""
    rows = [(i, f"number {i} of many") for i in range(2997)] + [(3000 + i, f"Zebulon wrote from zeb@example.org, {i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits = math.log2(3000 / 3)
    for least, n in ((bits - 1e-6, True), (bits + 1e-6, False)):
        spans = [s.kind for r in pii.find(docs, min_bits=least).collect() for s in r.spans]
        assert ("term" in spans) == n, least


REC = "record_id long, url string, at long, kind string, etag string, last_modified string, headers map<string,string>, payload string"


def test_warc(spark):
    rows = [(1, "http://www.A.org:80/x?b=1&a=2#f", 10, "response", '"e1"', "d1", {"ETag": '"e1"', "content-type": "t", "Age": "0", "x-hop": "1"}, "one"), (2, "https://a.org/x?a=2&b=1", 20, "response", '"e2"', "d2", {"age": "0"}, "two")]
    rows += [(3, "https://a.org/x?a=2&b=1", 15, "revisit", 'W/"e1"', None, {"age": "5", "Content-Length": "0", "Connection": "close, X-Hop", "X-Hop": "2"}, None), (4, "https://a.org/x?a=2&b=1", 200_000, "revisit", None, "d2", {}, None), (5, "https://a.org/x?a=2&b=1", 200_001, "revisit", '"zz"', "d2", None, None), (6, "https://a.org/x?a=2&b=1", 5, "revisit", '"e1"', None, {}, None), (7, None, 5, "revisit", None, None, None, None), (8, "https://a.org/x?a=2&b=1", 20, "revisit", None, None, None, None)]
    df = spark.createDataFrame(rows, REC).withColumns({"bucket": F.lit("b"), "point": F.lit(1), "canonical": F.lit("c"), "key": F.lit("k")})
    out = warc.resolve(df, bucket_seconds=7, carry=("headers",))
    assert {r.record_id: (r.response_id, r.verdict) for r in out.collect()} == {3: (1, "resolved"), 4: (2, "resolved"), 5: (2, "mismatch"), 6: (None, "orphan"), 7: (None, "orphan"), 8: (2, "unchecked")}
    full = {r.record_id: r for r in warc.materialise(df, warc.written(out)).collect()}
    assert set(full) == {3, 4}
    assert full[3].payload == "one" and full[3].headers == {"etag": '"e1"', "content-type": "t", "age": "5", "x-hop": "1"}
    assert full[4].payload == "two" and full[4].headers == {"age": "0"}
    empty = spark.createDataFrame([], REC)
    assert warc.materialise(empty, warc.resolve(empty, carry=("headers",))).count() == 0


@pytest.mark.parametrize("most", [10_000, 3])
def test_warc_against_brute_force(spark, monkeypatch, most):
    """Repeated records, null ids and times, ties, a hot URL and a hot response: a row a revisit, with the right response."""
    real = common.fetch
    monkeypatch.setattr(warc, "fetch", lambda big, small, key: real(big, small, key, most))
    rng = random.Random(12)
    rows = []
    for i in range(150):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        rows.append((None if i % 29 == 0 else i // 2, rng.choice(["http://a.org/", "https://www.A.org", None, "b.org/?y&x"]), None if i % 31 == 0 else rng.randrange(40), kind, rng.choice([None, '"e"', 'W/"f"']), rng.choice([None, "d"]), {"n": str(i)}, f"p{i}" if kind == "response" else None))
    rows += [rows[k] for k in (3, 3, 10, 11, 12, 12)]
    name = {"http://a.org/": "a.org/", "https://www.A.org": "a.org/", "b.org/?y&x": "b.org/?x&y", None: None}
    first = lambda x: (x is not None, x)  # noqa: E731  nulls before all
    df = spark.createDataFrame(rows, REC)
    keys = {(r.record_id, r.payload): r.k for r in df.withColumn("k", warc._capture(df)).collect()}
    want = []
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [s for s in rows if s[3] == "response" and r[1] is not None and name[s[1]] == name[r[1]] and first(s[2]) <= first(r[2])]
        s = max(earlier, key=lambda s: (first(s[2]), first(s[0]), keys[s[0], s[7]]), default=None)
        if s is None:
            verdict = "orphan"
        else:
            pair = (r[4], s[4]) if r[4] and s[4] else (r[5], s[5])
            verdict = "unchecked" if None in pair else "resolved" if pair[0].removeprefix("W/") == pair[1].removeprefix("W/") else "mismatch"
        want.append((r[0], name[r[1]], s and s[0], verdict, r[6]["n"] if verdict == "resolved" else None, s[7] if verdict == "resolved" else None))
    got = warc.materialise(df, warc.written(warc.resolve(df, bucket_seconds=9, carry=("headers",))), unresolved=True).collect()
    got = [(r.record_id, r.canonical, r.response_id, r.verdict, r.headers and r.headers["n"], r.payload) for r in got]
    assert collections.Counter(got) == collections.Counter(want)


def test_warc_files(spark):
    """Written, read, resolved and materialised; broken files keep what comes before the break."""
    made = [("urn:1", "http://a.org/", 1_700_000_000, "response", {"ETag": '"e"', "Content-Type": "text/html"}, b"body\r\n\r\nmore \xff"), ("urn:2", "http://a.org/", 1_700_000_100, "revisit", {"ETag": 'W/"e"', "Age": "7"}, None)]
    whole = b"".join(warc.write_record(*r) for r in made)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nsoft\r\n\r\n"
    files = spark.createDataFrame([("w.gz", bytearray(whole)), ("cut.gz", bytearray(whole[:-9])), ("plain", bytearray(info * 2)), ("junk", bytearray(b"nothing")), ("empty", bytearray(b"")), ("null", None)], "path string, content binary")
    got = collections.defaultdict(list)
    for r in warc.read_warc(files).collect():
        got[r.path].append(r)
    assert [(r.record_id, r.url, r.at, r.kind, r.headers, bytes(r.payload)) for r in got["w.gz"]] == [(*r[:5], r[5] or b"") for r in made]
    assert [r.error is None for r in got["cut.gz"]] == [True, False] and [bytes(r.payload) for r in got["plain"]] == [b"soft"] * 2
    assert len(got["junk"]) == 1 and got["junk"][0].error and "empty" not in got and "null" not in got
    records = common.written(warc.read_warc(files.filter("path = 'w.gz'")))
    (full,) = warc.materialise(records, common.written(warc.resolve(records, carry=("headers",)))).collect()
    assert full.record_id == "urn:2" and full.response_id == "urn:1" and bytes(full.payload) == made[0][5] and full.headers == {"etag": 'W/"e"', "content-type": "text/html", "age": "7"}


def test_warc_copies_stay_as_many(spark):
    full, again = (1, "a.org/", 1, "response", '"e"', None, {"h": "1"}, "body"), (2, "a.org/", 2, "revisit", '"e"', None, {"h": "2"}, None)
    df = spark.createDataFrame([full] * 3 + [again] * 3, REC)
    got = warc.materialise(df, warc.written(warc.resolve(df, carry=("headers",)))).collect()
    assert [(r.record_id, r.headers, r.payload) for r in got] == [(2, {"h": "2"}, "body")] * 3


def test_null_and_repeated_ids(spark):
    """What an operator says of a text doesn't hang on its id: null, repeated or its own."""
    texts = [" ".join(words(60, k)).capitalize() + f".\nSame line {k % 2}.\nmail a{k}@b.example" for k in range(24)] + [None, ""]
    given = {"own": [(k, t) for k, t in enumerate(texts)], "null": [(None, t) for t in texts], "same": [(5, t) for t in texts]}
    frames = {k: spark.createDataFrame(v, "doc_id long, text string").withColumn("source", F.lit("s")) for k, v in given.items()}

    def alike(run) -> None:
        found = {k: collections.Counter(tuple(map(str, r)) for r in run(df).collect()) for k, df in frames.items()}
        assert found["own"] == found["null"] == found["same"], found
        assert sum(found["own"].values()) == len(texts)

    alike(lambda d: quality.clean(d).select("text", "q_text", "q_kept", "q_lost_words"))
    alike(lambda d: linededup.dedup_lines(d).select("text", "line_kept", "line_dropped"))
    alike(lambda d: pii.sanitise(d).select("text", "pii_text"))
    alike(lambda d: simhash.near_groups(d).select("fp"))
    alike(lambda d: simhash.keep_one(d).select(F.coalesce("text", F.lit("")).alias("text")).unionByName(spark.createDataFrame([("",)], "text string")))  # null and "" are one
    for name, df in frames.items():
        mixed = mixing.mix(df, weights=[1.0], share=1.5).collect()
        assert len(mixed) == len(texts) and {r.mix_copies for r in mixed} <= {1, 2}
        shards = sharding.shard(df, 4).collect()
        assert len(shards) == len(texts) and collections.Counter(r.shard for r in shards) == {0: 7, 1: 7, 2: 6, 3: 6}
        scored = lm.score(df).collect()
        assert len(scored) == len(texts) and all(r.held_out == lm_held(r.doc_id) for r in scored), name
        pieces = packing.pack(df, ranks=ranks()).collect()
        assert sum(r.start == 0 for r in pieces) == len(texts)
    near = vectors.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [1.0, 0.01]), (3, [0.5, 0.5]), (None, None)], "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in near) == [("3", 0, "3"), ("3", 1, "3"), ("None", 0, "None"), ("None", 0, "None"), ("None", 1, "3")]
