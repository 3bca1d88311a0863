"""SimHash near-dedup: fingerprints linked at few differing bits through the anchors of a covering code.

Fingerprint: 64 bits, each set if more than half of the shingles' XXH64 (seed 42) have it. Equal fingerprints are collapsed
first, so a group of copies is one row from there on.

Anchors: two blocks of 23 bits are covered by the perfect binary Golay code (23, 12): every 23-bit word is within its
covering radius 3 of exactly one codeword. (The last 18 bits are left to the comparison.) An anchor is a pair of
codewords. If x has anchor (a, b) within radius (3, 3) and y differs from x in at most t bits, i of them in the first
block and j in the second, then y is within 3 + i and 3 + j of it. So a fingerprint goes to every anchor with excess i + j
<= t, where excess is the distance beyond the radius: 61 anchors on average for t = 2, out of 2^24. Both of a pair meet at
either's home anchor (excess 0), where whole fingerprints are compared; only the pair's smaller one at its home reports it.

An anchor with more than `crowd` fingerprints isn't compared pairwise: its members (t <= 2) are linked through the points
at most one bit away from them, which two fingerprints share exactly if they differ in 2 bits or fewer. That is 65 rows
a fingerprint, not the square of the crowd.

Wide fingerprints (`wide_links`) serve a similarity instead of a few bits: five words a shingle, 128 bits. Each of `tables` tables takes 46 of
the bits and sends a fingerprint to every anchor with excess <= 1 (9.6 on average); two that share an anchor in any table and differ in at most `distance`
bits are linked. Of the pairs of a cell only a least spanning forest by bits goes on, so a group of n copies gives n - 1 pairs a cell and not n squared.
At a similarity of 0.8, 0.85 and 0.9 a pair meets with a chance of 0.95, 0.99 and 1.00 in 18 tables.
A wide anchor with more than `crowd` fingerprints is cut into blocks; each block is linked, components are linked again through one
fingerprint each, and what is then outside an anchor's largest component meets every block of those inside it, and outsiders meet in blocks of
their own: no pair of components is lost and no block's square is taken twice.

`keep_one` leaves nothing to chance: texts are linked if their sets of shingles (64 bits each) have `similarity` or more of their union in common, and
`setjoin` finds all such pairs that tell components apart.

Null and empty texts have no shingles: fingerprint zero. Fewer words than a shingle: one shingle of all words. Repeated
rows share a fingerprint. A null doc_id gets a row, and counts for a component only if nothing else is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm import setjoin
from docengine.llm.common import attach, drop_written, fetch, few, written
from docengine.llm.components import Forest, components

SEED = 42
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GOLAY = 0b101011100011
BITS = 23


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """A row of 8 bytes a shingle, big-endian."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros((0, 8), dtype=np.uint8)
    if len(words) <= width:
        digests = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        whole = b" ".join(words)
        digest = xxhash.xxh64_digest
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[:-1]]]
        digests = b"".join([digest(whole[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])])
    return np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)


def majority(rows: np.ndarray) -> int:
    """64 bits, each set if over half of the rows have it."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(rows), 8192):
        counts += np.unpackbits(rows[i : i + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def fingerprint(text: str | None, width: int) -> int:
    """The text's fingerprint, unsigned."""
    return majority(shingle_hashes(text, width))


def wide_fingerprint(text: str | None, width: int) -> tuple[int, int]:
    """128 bits as two words: the second from the same hashes, mixed."""
    rows = shingle_hashes(text, width)
    again = rows.view(">u8").astype(np.uint64).ravel()
    again = (again ^ (again >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    again = (again ^ (again >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return majority(rows), majority((again ^ (again >> np.uint64(32))).astype(">u8").view(np.uint8).reshape(-1, 8))


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial: zero for codewords."""
    x = x.astype(np.int64).copy()
    for bit in range(BITS - 1, 10, -1):
        x ^= np.where((x >> bit) & 1, GOLAY << (bit - 11), 0)
    return x


def cosets(t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight <= 3 + t by syndrome: patterns, their excess, and where each syndrome's begin."""
    near = np.array([sum(1 << b for b in c) for w in range(4 + t) for c in combinations(range(BITS), w)], dtype=np.int64)
    excess = np.maximum(np.bitwise_count(near).astype(np.int64) - 3, 0)
    s = _syndrome(near)
    order = np.lexsort((excess, s))
    return near[order], excess[order], np.searchsorted(s[order], np.arange((1 << 11) + 1))


_COSETS: dict[int, tuple] = {}


def anchors(fps: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, home) of every anchor that each fingerprint goes to."""
    if t not in _COSETS:
        _COSETS[t] = cosets(t)
    patterns, excess, begin = _COSETS[t]
    mask = (1 << BITS) - 1
    blocks = [(fps & np.uint64(mask)).astype(np.int64), ((fps >> np.uint64(BITS)) & np.uint64(mask)).astype(np.int64)]

    def spread(index: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = _syndrome(block[index])
        n = begin[s + 1] - begin[s]
        rows = np.repeat(np.arange(len(index)), n)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + begin[s][rows]
        return rows, block[index][rows] ^ patterns[at], excess[at]

    rows, first, e1 = spread(np.arange(len(fps)), blocks[0])
    rows2, second, e2 = spread(rows, blocks[1])
    keep = e1[rows2] + e2 <= t
    rows2, second, e2 = rows2[keep], second[keep], e2[keep]
    return rows[rows2], (first[rows2] << BITS) | second, (e1[rows2] + e2) == 0


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        *others, texts = b.columns
        fps = np.fromiter((fingerprint(x.as_py(), width) for x in texts), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([*others, pa.array(fps.view(np.int64))], names=[*b.schema.names[:-1], "fp"])


def _spread(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 2000):
            part = fps[i : i + 2000]
            at, anchor, home = anchors(part, t)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[at].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def _compare(batches: Iterator[pa.RecordBatch], t: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor. Gives (kind, a, b): links between members, or members of a crowd for the other way."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(np.asarray(a, dtype=np.int64)), pa.array(np.asarray(b, dtype=np.int64))], names=["kind", "a", "b"])

    def linked(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        forest, lag = Forest(), 1
        live = np.arange(len(fp) - 1) if len(fp) else np.arange(0)
        while len(live):
            live = live[live + lag < len(fp)]
            live = live[anchor[live] == anchor[live + lag]]
            x, y = fp[live], fp[live + lag]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= t
            smaller_home = np.where(x < y, home[live], home[live + lag])
            for a, b in zip(x[near & smaller_home].tolist(), y[near & smaller_home].tolist()):
                forest.link(a, b)
            lag += 1
        return out(0, *forest.edges())

    held: list[tuple[np.ndarray, ...]] = []
    crowded: int | None = None
    for b in batches:
        cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(cols[0]):
            continue
        if held:
            cols = tuple(np.concatenate([p, c]) for p, c in zip(held[0], cols, strict=True))
            held = []
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        sizes = np.diff(np.r_[starts, len(cols[0])])
        size = np.repeat(sizes, sizes)
        big = (size > crowd) | (cols[0] == crowded if crowded is not None else False)
        if big.any():
            yield out(1, cols[1][big], cols[1][big])
        last = cols[0][-1]
        crowded = int(last) if big[-1] else None
        rest = ~big & (cols[0] != last)
        if rest.any():
            yield linked(*[c[rest] for c in cols])
        if crowded is None:
            tail = cols[0] == last
            held = [tuple(c[tail] for c in cols)]
    if held:
        yield linked(*held[0])


def links(distinct: DataFrame, t: int = 2, crowd: int = 1500) -> DataFrame:
    """distinct (fp), no repeats -> edges (a, b) that join exactly the fingerprints linked at t or fewer bits, transitively."""
    if t != 2:
        raise ValueError("crowds are linked through points one bit away, which two share at 2 differing bits or fewer")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row becomes 61, so rows are spread over all tasks first
    spread = distinct.select("fp").repartition(n).mapInArrow(lambda it: _spread(it, t), "anchor long, fp long, home boolean")
    dealt = spread.repartition(n, "anchor").sortWithinPartitions("anchor")
    found = written(dealt.mapInArrow(lambda it: _compare(it, t, crowd), "kind int, a long, b long"))
    direct = found.filter("kind = 0").select("a", "b")
    members = found.filter("kind = 1").select("a").distinct()
    flips = [0, *[1 << i for i in range(63)], -(1 << 63)]
    points = members.select(F.col("a"), F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("f")).select("a", F.col("a").bitwiseXOR(F.col("f")).alias("point"))
    least = points.groupBy("point").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("point").alias("q"), "b")
    around = points.join(least, F.col("point") == F.col("q")).filter("a <> b").select("a", "b").distinct()
    return direct.unionByName(around)


def wide_anchors(hi: np.ndarray, lo: np.ndarray, table: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(index, cell): the anchors of excess <= 1 in the table's 46 bits."""
    chosen = np.random.default_rng([seed, table]).permutation(128)[: 2 * BITS]
    bits = np.zeros(len(hi), dtype=np.uint64)
    for place, b in enumerate(chosen.tolist()):
        word = hi if b < 64 else lo
        bits |= ((word >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(place)
    at, anchor, _ = anchors(bits, 1)
    return at, anchor | (table << (2 * BITS))


def node(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """One number for a wide fingerprint."""
    x = hi ^ ((lo ^ (lo >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))).view(np.int64)


def _wide_prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        *others, texts = b.columns
        found = np.array([wide_fingerprint(x.as_py(), width) for x in texts], dtype=np.uint64).reshape(-1, 2)
        hi, lo = np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])
        yield pa.RecordBatch.from_arrays([*others, pa.array(node(hi, lo)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=[*b.schema.names[:-1], "fp", "hi", "lo"])
    pa.default_memory_pool().release_unused()


def _wide_spread(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hi, lo = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        for i in range(0, len(hi), 4000):
            for table in range(tables):
                at, cell = wide_anchors(hi[i : i + 4000], lo[i : i + 4000], table)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(hi[i + at].view(np.int64)), pa.array(lo[i + at].view(np.int64))], names=["cell", "hi", "lo"])


def _far(hi: np.ndarray, lo: np.ndarray, x: np.ndarray | int, y: np.ndarray | int) -> np.ndarray:
    return np.bitwise_count(hi[x] ^ hi[y]).astype(np.int16) + np.bitwise_count(lo[x] ^ lo[y])


def _link_many(hi: np.ndarray, lo: np.ndarray, group: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs that join all groups within the distance: a member meets only what is outside its group, and takes the nearest of each group."""
    group, out = np.unique(group, return_inverse=True)[1], []
    for x in range(len(hi)):
        others = np.flatnonzero(group != group[x])
        if not len(others):
            break
        far = _far(hi, lo, x, others)
        near = others[far <= distance]
        near = near[np.argsort(far[far <= distance], kind="stable")]
        for y in near[np.unique(group[near], return_index=True)[1]].tolist():
            out.append((x, y))
            group[group == group[y]] = group[x]
    return out


def _spanning(hi: np.ndarray, lo: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs of a least spanning forest of all pairs within the distance (Prim)."""
    rest, out = np.arange(1, len(hi)), []
    best, via = _far(hi, lo, 0, rest), np.zeros(len(rest), dtype=np.int64)
    while len(rest):
        k = int(best.argmin())
        x = int(rest[k])
        if best[k] <= distance:
            out.append((int(via[k]), x))
        keep = np.arange(len(rest)) != k
        rest, best, via = rest[keep], best[keep], via[keep]
        far = _far(hi, lo, x, rest)
        nearer = far < best
        best, via = np.where(nearer, far, best), np.where(nearer, x, via)
    return out


def _wide_compare(batches: Iterator[pa.RecordBatch], distance: int, crowd: int, seeded: bool) -> Iterator[pa.RecordBatch]:
    """Rows (cell, hi, lo and, if seeded, group) come sorted by cell. Gives (kind, cell, a, b): 0 pairs (nodes) of forests, 1 members
    of a cell of more than crowd (hi, lo)."""
    handful = 24

    def out(kind: int, cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(cell), pa.array(a), pa.array(b)], names=["kind", "cell", "a", "b"])

    def linked(cell: np.ndarray, hi: np.ndarray, lo: np.ndarray, group: np.ndarray | None) -> pa.RecordBatch:
        ids = node(hi, lo)
        found: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        small = np.repeat(sizes <= handful, sizes) if group is None else np.zeros(len(cell), dtype=bool)
        live, lag = np.flatnonzero(small), 1
        close: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            live = live[live + lag < len(cell)]
            live = live[cell[live] == cell[live + lag]]
            far = _far(hi, lo, live, live + lag)
            near = far <= distance
            close.append((far[near], ids[live[near]], ids[live[near] + lag]))
            lag += 1
        if close:
            far, left, right = (np.concatenate(c) for c in zip(*close))
            order, forest = np.argsort(far, kind="stable"), Forest()
            for x, y in zip(left[order].tolist(), right[order].tolist()):  # Kruskal: near pairs first
                if forest.root(x) != forest.root(y):
                    forest.link(x, y)
                    found.append((x, y))
        more = np.flatnonzero((sizes > 1) & ~small[starts])
        for s, n in zip(starts[more].tolist(), sizes[more].tolist()):
            part = slice(s, s + n)
            own = ids[part].tolist()
            alone = group is None or len(np.unique(group[part])) == n
            pairs = _spanning(hi[part], lo[part], distance) if alone else _link_many(hi[part], lo[part], group[part], distance)
            found += [(own[x], own[y]) for x, y in pairs]
        a, b = (np.array(c, dtype=np.int64) for c in (zip(*found) if found else ((), ())))
        return out(0, np.zeros(len(a), dtype=np.int64), a, b)

    held: tuple | None = None
    crowded: int | None = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4 if seeded else 3)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols, held = [np.concatenate([p, c]) for p, c in zip(held, cols, strict=True)], None
        cell = cols[0]
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)])
        big = np.zeros(len(cell), dtype=bool) if seeded else (np.repeat(sizes, sizes) > crowd) | ((cell == crowded) if crowded is not None else False)
        if big.any():
            yield out(1, cell[big], cols[1][big], cols[2][big])
        last = cell[-1]
        crowded = int(last) if big[-1] else None
        rest = ~big & (cell != last)
        view = lambda keep, cols=cols: (cols[0][keep], cols[1][keep].view(np.uint64), cols[2][keep].view(np.uint64), cols[3][keep] if seeded else None)
        if rest.any():
            yield linked(*view(rest))
        if crowded is None:
            held = tuple(c[cell == last] for c in cols)
    if held is not None:
        yield linked(held[0], held[1].view(np.uint64), held[2].view(np.uint64), held[3] if seeded else None)
    pa.default_memory_pool().release_unused()


_LINKS = "kind int, cell long, a long, b long"


def _seeded(rows: DataFrame, distance: int) -> DataFrame:
    """Links among rows (cell, block, hi, lo, group) of a block, those of one group excepted."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.xxhash64("cell", "block").alias("key"), "hi", "lo", "group")
    found = keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda it: _wide_compare(it, distance, 0, True), _LINKS)
    return written(found.select("a", "b"))


def _crowd_links(members: DataFrame, distance: int, crowd: int) -> DataFrame:
    """members (cell, hi, lo, id) of crowded cells -> edges that join all that are linked in a cell. See the module's text."""

    def blocked(rows: DataFrame) -> DataFrame:
        blocks = written(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("blocks")))
        return attach(rows, blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def grouped(edges: DataFrame) -> DataFrame:
        return written(members.join(components(edges), F.col("id") == F.col("node"), "left").select("cell", "hi", "lo", "id", F.coalesce("component", "id").alias("group")))

    own = members.withColumn("group", F.col("id"))
    edges = _seeded(blocked(own), distance)
    named, before = grouped(edges), None
    while True:
        one = written(named.groupBy("cell", "group").agg(F.min(F.struct("id", "hi", "lo")).alias("m")).select("cell", "m.hi", "m.lo", "m.id", "group"))
        most = one.groupBy("cell").count().agg(F.max("count")).first()[0]
        edges = edges.unionByName(_seeded(blocked(one), distance))
        named = grouped(edges)
        if most <= crowd or before is not None and most >= before:
            break
        before = most
    largest = named.groupBy("cell", "group").count().groupBy("cell").agg(F.max_by("group", F.struct("count", "group")).alias("main"))
    placed = written(attach(blocked(named), largest, "cell"))
    # outsiders meet the insiders' blocks, and one another, as blocks against blocks: a task never holds more than two blocks
    outside = placed.filter(F.col("group") != F.col("main"))
    rooms = written(outside.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("rooms")))
    guests = attach(outside, rooms, "cell").withColumn("room", F.pmod(F.xxhash64(F.lit("room"), "id"), F.col("rooms")).cast("int"))
    columns = ["cell", "meeting", "hi", "lo", "group"]
    meeting = lambda kind, x, y: F.xxhash64(F.lit(kind), x, y)
    visits = guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("meeting", meeting("in", "room", "block"))
    hosts = attach(placed.filter(F.col("group") == F.col("main")), rooms, "cell").filter("rooms is not null").withColumn("room", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1))).withColumn("meeting", meeting("in", "room", "block"))
    among = guests.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1))).withColumn("meeting", meeting("out", F.least("room", "other"), F.greatest("room", "other")))
    every = visits.select(*columns).unionByName(hosts.select(*columns)).unionByName(among.select(*columns)).withColumnRenamed("meeting", "block")
    return edges.unionByName(_seeded(every, distance))


def wide_links(distinct: DataFrame, distance: int = 32, tables: int = 18, crowd: int = 4000) -> DataFrame:
    """distinct (hi, lo), no repeats -> pairs (a, b) of nodes within the distance that join all that meet, near ones first."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("hi", "lo").repartition(n).mapInArrow(lambda it: _wide_spread(it, tables), "cell long, hi long, lo long")
    dealt = spread.repartition(n, "cell").sortWithinPartitions("cell")
    found = written(dealt.mapInArrow(lambda it: _wide_compare(it, distance, crowd, False), _LINKS))
    edges = found.filter("kind = 0").select("a", "b")
    crowds = found.filter("kind = 1")
    if not crowds.limit(1).count():
        return edges
    members = crowds.select("cell", F.col("a").alias("hi"), F.col("b").alias("lo")).mapInArrow(_with_node, "cell long, hi long, lo long, id long")
    return edges.unionByName(_crowd_links(written(members), distance, crowd))


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hi, lo = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (1, 2))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node(hi, lo))], names=[*b.schema.names, "id"])


def _grouped(prints: DataFrame, least: Column, link) -> DataFrame:
    """prints (fp, ...) with `first`: the least over all rows reachable by links."""
    of_print = [c for c in ("size", "sketch", "prefix") if c in prints.columns]
    classes = written(prints.groupBy("fp").agg(F.min(least).alias("least"), *[F.first(c).alias(c) for c in of_print]))
    if of_print:  # once classes have them, they needn't lie on the disk twice
        whole, prints = prints, written(prints.drop(*of_print))
        drop_written(whole)
    comps = components(link(classes))
    rooted = written(classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    roots = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = fetch(rooted, roots, "root").select("fp", "first")
    return fetch(prints, named, "fp")


def near_groups(docs: DataFrame, *, width: int = 3, bits: int = 2, crowd: int = 1500, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id), one row a row of docs; component_id is the smallest doc_id reachable by links."""
    prints = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long"))
    return _grouped(prints, F.col("doc_id"), lambda c: links(c, bits, crowd)).select("doc_id", "fp", F.col("first").alias("component_id"))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    return np.unique(shingle_hashes(text, width).view(">u8").ravel().astype(np.uint64))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(fp, shingles): each different shingle's hash, sorted."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_set(t.as_py(), width) for t in part.column(1)])], names=["fp", "shingles"])
    pa.default_memory_pool().release_unused()  # workers live on, and so would what they hold


def _tokens(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(token), a row for each different shingle of a text."""
    for b in batches:
        for t in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), width).view(np.int64))], names=["token"])


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, similarity: float, common: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns but the text, with fp (of the set of shingles), its size, its sketch and its prefix."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            *others, texts = b.slice(i, 256).columns
            found = [shingle_set(t.as_py(), width) for t in texts]
            fps = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], dtype=np.uint64).view(np.int64)
            told = [pa.array(fps), pa.array(np.array([len(x) for x in found], dtype=np.int32)), _lists([setjoin.sketch(x) for x in found]), _lists([setjoin.prefix(x, common, rank, similarity) for x in found])]
            yield pa.RecordBatch.from_arrays([*others, *told], names=[*b.schema.names[:-1], "fp", "size", "sketch", "prefix"])
    pa.default_memory_pool().release_unused()


def similar(pairs: DataFrame, classes: DataFrame, given: DataFrame, *, width: int, similarity: float, bound: int, text: str = "text") -> DataFrame:
    """The pairs (a, b) of fingerprints whose texts' sets of shingles have that similarity: the exact check.

    classes: fp, its size and sketch, and least, (is null, __id, __key) of a row with it; given: rows with __id, __key and the text. Only texts
    that are in a pair whose sketches allow the similarity are read again; their rows are told by a broadcast of up to `bound` keys, beyond it by a join.
    """
    met = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    of = lambda end: classes.select(F.col("fp").alias(end), F.struct("size", "sketch").alias(f"of_{end}"))
    half = written(fetch(met, of("a"), "a"))
    pairs = written(fetch(half, of("b"), "b").filter(~setjoin.unlike(F.col("of_a"), F.col("of_b"), similarity)).select("a", "b"))
    drop_written(half)
    drop_written(met)
    nodes = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    need = written(classes.join(nodes, F.col("fp") == F.col("a")).select(F.col("fp").alias("__fp"), F.col("least.__id").alias("__i"), F.col("least.__key").alias("__k")))
    told = F.broadcast(need) if few(need, bound) else need
    rows = given.select("__id", "__key", F.col(text).cast("string").alias("__text")).join(told, (F.col("__key") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i"))).select("__fp", "__text")
    sets = written(rows.mapInArrow(lambda it: _sets(it, width), "fp long, shingles array<long>"))
    if sets.count() > need.count():  # rows that repeat id and text
        repeated, sets = sets, written(sets.dropDuplicates(["fp"]))
        drop_written(repeated)
    one = written(fetch(pairs, sets.withColumnsRenamed({"fp": "a", "shingles": "one"}), "a"))
    two = fetch(one, sets.withColumnsRenamed({"fp": "b", "shingles": "two"}), "b")
    both = F.size(F.array_intersect("one", "two"))
    found = written(two.filter(both >= F.lit(similarity) * (F.size("one") + F.size("two") - both) - 1e-9).select("a", "b"))
    for done in (one, sets, need, pairs):
        drop_written(done)
    return found


def keep_one(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, crowd: int = 4000, sample: int = 16, bound: int = 300_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of texts that are linked by pairs of that similarity: the one with the smallest doc_id, null ids last; where the id stands
    on several texts, the one with the least hash of id and text. Of rows with the same id and text, one. Texts with equal sets of shingles are copies.
    Shingles that are common in one of `sample` texts come last in the order of the join."""
    given = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__key": F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))})
    texts = docs.select(F.col(text).cast("string").alias("text"))
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).dropDuplicates(["text"]).mapInArrow(lambda it: _tokens(it, width), "token long")
    common, rank = setjoin.frequent(some)
    prints = written(given.select("__id", "__key", F.col(text).cast("string").alias("text")).mapInArrow(lambda it: _prefixes(it, width, similarity, common, rank), "__id long, __key long, fp long, size int, sketch array<long>, prefix array<long>"))
    order = F.struct(F.col("__id").isNull(), "__id", "__key")
    # rows with the same id and text share a fingerprint, so they stay or go together
    link = lambda c: setjoin.links(c, lambda p: similar(p, c, given, width=width, similarity=similarity, bound=bound, text=text), similarity=similarity, crowd=crowd)
    rows = written(_grouped(prints, order, link).groupBy("__id", "__key").agg(F.bool_or(order.eqNullSafe(F.col("first"))).alias("stays"), F.count(F.lit(1)).alias("n")))
    # what goes is less than what stays: counted first, it is broadcast up to `bound` rows, and texts aren't dealt again
    gone = rows.filter(~F.col("stays")).select(F.col("__id").alias("gone_id"), F.col("__key").alias("gone_key"))
    scarce = few(gone, bound)
    left = given.join(F.broadcast(gone) if scarce else gone, (F.col("__key") == F.col("gone_key")) & F.col("__id").eqNullSafe(F.col("gone_id")), "left_anti")
    # rows aren't repeated as a rule; only where they are, whole rows are dealt again to keep one of each
    one = left.dropDuplicates(["__id", "__key"]) if rows.filter("stays and n > 1").limit(1).count() else left
    return one.drop("__id", "__key")
