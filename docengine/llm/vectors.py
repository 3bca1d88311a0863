"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, distributed components.

Equal vectors are collapsed first, with their number. Each of `tables` tables hashes a vector to the signs of `bits` random
projections; the number of tables follows from the wanted recall at the threshold: a pair at angle a collides in a table with
probability (1 - a/pi)^bits. Vectors that share a bucket are compared by their exact double-precision cosine, a block at
a time; a pair counts in the first table where it meets, so n_links is right though pairs are never written out: each block
gives a count for each vector and a spanning forest of its links.

A bucket of more than `block` vectors is cut into blocks by a hash, and every two blocks meet in a task of their own: nothing
is capped, and no task holds more than two blocks.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own component;
so do vectors of different length. Rows that repeat a vec_id count as further vectors with that id; a null vec_id gets a row and
names a component only if nothing else is in it. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import fetch, written
from docengine.llm.components import Forest, components


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """Tables needed so that a pair right at the threshold is found with probability `recall`."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def bits_for(n: int, bucket: int) -> int:
    """Bits that leave about `bucket` of n spread vectors in a bucket."""
    return min(30, max(4, round(math.log2(max(1, n) / bucket)) if n > bucket else 4))


def codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(rows, tables) bucket numbers."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column.to_numpy(zero_copy_only=False)])


def _hash(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        dims = np.array([len(v) for v in b.column(1).to_numpy(zero_copy_only=False)])
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            part = b.take(pa.array(at))
            c = codes(_matrix(part.column(1)), bits, tables, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, tables, dtype=np.int32)), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(len(at), d, dtype=np.int32)), lists], names=["v", "x", "n", "dim", "codes"])


def _within(cell: tuple[int, int, int, int], ids: np.ndarray, x: np.ndarray, n: np.ndarray, c: np.ndarray, block: np.ndarray, threshold: float, counts: dict[int, int], forest: Forest) -> None:
    table, left, right = cell[0], cell[2], cell[3]
    a = np.flatnonzero(block == left)
    b = a if left == right else np.flatnonzero(block == right)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far, label, own = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), ids.tolist()
    for i in range(0, len(a), 512):
        rows = a[i : i + 512]
        p, q = np.nonzero(unit[rows] @ unit[b].T >= threshold - 1e-9)
        p, q = rows[p], b[q]
        keep = p < q if left == right else np.ones(len(p), dtype=bool)
        p, q = p[keep], q[keep]
        if table and len(p):
            first = ~(c[p, :table] == c[q, :table]).any(axis=1)
            p, q = p[first], q[first]
        # the exact check: the cosine as defined, in double precision
        exact = (x[p] * x[q]).sum(axis=1) / np.sqrt((x[p] ** 2).sum(axis=1) * (x[q] ** 2).sum(axis=1)) >= threshold
        p, q = p[exact], q[exact]
        np.add.at(far, p, n[q])
        np.add.at(far, q, n[p])
        while len(p):  # every member takes the least label that it is linked to, until none moves
            before = label.copy()
            np.minimum.at(label, p, label[q])
            np.minimum.at(label, q, label[p])
            label = label[label]
            if (label == before).all():
                break
    for i in np.flatnonzero(far).tolist():
        counts[own[i]] = counts.get(own[i], 0) + int(far[i])
        forest.link(own[i], own[label[i]])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell (table, bucket, dim, left, right). Gives (kind, a, b): 0 a link of the forest, 1 a count."""

    def out(counts: dict[int, int], forest: Forest) -> pa.RecordBatch:
        a, b = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array([0] * len(a) + [1] * len(counts), pa.int32()), pa.array(a + list(counts), pa.int64()), pa.array(b + list(counts.values()), pa.int64())], names=["kind", "a", "b"])

    def done(rows: pa.Table, counts: dict[int, int], forest: Forest) -> None:
        if len(rows) < 2:
            return
        cells = np.stack([rows.column(k).to_numpy() for k in ("table", "bucket", "dim", "left", "right")], axis=1)
        starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)])
        for s, e in zip(starts, np.r_[starts[1:], len(cells)]):
            if e - s > 1:
                part = rows.slice(s, e - s).combine_chunks()
                t, _, _, left, right = cells[s]
                _within((t, 0, left, right), part["v"].to_numpy(), _matrix(part["x"].combine_chunks()), part["n"].to_numpy(), np.stack([np.asarray(k) for k in part["codes"].to_numpy()]), part["block"].to_numpy(), threshold, counts, forest)

    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        now = now if held is None else pa.concat_tables([held, now])
        same = np.ones(len(now), dtype=bool)
        for k in ("table", "bucket", "dim", "left", "right"):
            col = now.column(k).to_numpy()
            same &= col == col[-1]
        cut = len(now) - int(same.sum())
        counts: dict[int, int] = {}
        forest = Forest()
        done(now.slice(0, cut), counts, forest)
        yield out(counts, forest)
        held = now.slice(cut)
    if held is not None:
        counts, forest = {}, Forest()
        done(held, counts, forest)
        yield out(counts, forest)


def near_vectors(vectors: DataFrame, *, threshold: float = 0.9, recall: float = 0.9995, bucket: int = 64, block: int = 1500, seed: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id), one row a row of vectors."""
    spark = vectors.sparkSession
    x = F.col("x")
    # floats travel as floats; cosines are taken in double precision of the same values
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("x"))
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0), F.lit(False))
    given = given.withColumn("fine", fine).withColumn("k1", F.when(fine, F.xxhash64("x"))).withColumn("k2", F.when(fine, F.xxhash64(F.lit("v"), "x")))
    given = written(given.withColumn("v", F.col("k1").bitwiseXOR(F.shiftleft("k2", 1))))
    # one row for equal vectors: first() of equal values
    classes = written(given.filter("fine").groupBy("k1", "k2").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v")))
    bits = bits_for(classes.count(), bucket)
    tables = tables_for(bits, threshold, recall)
    hashed = written(classes.select("v", "x", "n").mapInArrow(lambda it: _hash(it, bits, tables, seed), f"v long, x {kind}, n long, dim int, codes array<int>"))
    flat = hashed.select("v", "dim", F.posexplode("codes").alias("table", "bucket"))
    crowded = flat.groupBy("table", "bucket", "dim").count().filter(F.col("count") > block).select(F.col("table").alias("t"), F.col("bucket").alias("k"), F.col("dim").alias("d"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = hashed.select("v", "x", "n", "dim", "codes", F.posexplode("codes").alias("table", "bucket"))
    crowded = written(crowded)
    many = crowded.limit(50_001).count()
    if many:  # few: broadcast, so the rows aren't dealt for a join that changes next to none of them
        side = F.broadcast(crowded) if many <= 50_000 else crowded
        rows = rows.join(side, (F.col("table") == F.col("t")) & (F.col("bucket") == F.col("k")) & (F.col("dim") == F.col("d")), "left").drop("t", "k", "d")
    else:
        rows = rows.withColumn("blocks", F.lit(1))
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "v"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("v", "x", "n", "dim", "codes", "table", "bucket", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    cell = ["table", "bucket", "dim", "left", "right"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(rows.repartition(parts, *cell).sortWithinPartitions(*cell).mapInArrow(lambda it: _compare(it, threshold), "kind int, a long, b long"))
    counts = found.filter("kind = 1").groupBy(F.col("a").alias("cv")).agg(F.sum("b").alias("far"))
    comps = components(found.filter("kind = 0").select("a", "b"))
    named = classes.join(comps, F.col("v") == F.col("node"), "left").join(counts, F.col("v") == F.col("cv"), "left").select("v", "least", F.coalesce("component", "v").alias("root"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    # a component's classes meet its root, a vector's copies their class: hot ones are dealt out, invalid vectors have no key and are spread
    named = written(named)
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = fetch(named, roots, "root").select("v", "n_links", "component_id")
    out = fetch(given.select("vec_id", "v"), answer, "v")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
