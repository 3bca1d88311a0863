"""Vector code compression: a vector is cut into equal parts, each part is told by the nearest entry of its position's codebook.

Vectors are integers, floor(scale * x), so distances, sums and new entries are exact and alike on every run and layout of the rows.

Nearest entries are found in a vantage-point tree over the entries of each part position. A node holds one entry and two children;
of each child it knows the least and the largest distance from its entry to the child's, rounded down and up. By the triangle
inequality no entry of a child is nearer to a query than the distance to the node's entry less the child's largest, or the child's
least less that distance. A child is visited unless that bound, taken down by more than rounding can be, is over the best distance so far; equal ones are visited, so that ties
end at the lower index. What decides between entries are the integers alone. Queries go down the tree as whole blocks of an Arrow batch.

A round of training is one pass: a task sums the parts of each entry over all its rows, and what meets in the shuffle is one row an
entry a task. Codebooks are as large as the parameters say, whatever the corpus.

Rows whose vector is null or empty, holds null or non-finite components, or has another length than most (of two that tie, the longer)
are dropped. Rows that repeat an id or a vector are rows like others; null ids come last in the order, equal ids by their vectors. With fewer
rows than entries codebooks are as small as the rows. Codebook entries that tie go to the lower index; unused ones stay. An empty table
gives no rows. Components so large that squared distances leave 62 bits are an error. Columns other than the three named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import finite_vectors, usual_length, written


@dataclass
class _Node:
    entry: int
    children: list[tuple[float, float, "_Node | np.ndarray"]]  # (least distance from entry, largest, child)


class EntryTree:
    """Exact nearest entries, lowest index first, of a codebook (entries, dimensions) of integers."""

    #: Over the relative error of two roots and a sum in double precision.
    SLACK = 1e-14

    def __init__(self, entries: np.ndarray, leaf: int = 3):
        self.entries, self.leaf = entries.astype(np.int64), leaf
        self.root = self._built(np.arange(len(entries)))
        #: Distances taken, for tests of what the tree saves.
        self.taken = 0

    def _built(self, members: np.ndarray) -> _Node | np.ndarray:
        if len(members) <= self.leaf:
            return members
        spread = ((self.entries[members] - self.entries[members].sum(axis=0) // len(members)) ** 2).sum(axis=1)
        v = int(members[spread.argmax()])  # an entry at the rim parts the others best
        rest = members[members != v]
        far = ((self.entries[rest] - self.entries[v]) ** 2).sum(axis=1)
        order = np.argsort(far, kind="stable")
        children = []
        for half in np.array_split(order, 2):
            if len(half):
                least, most = np.sqrt(float(far[half].min())), np.sqrt(float(far[half].max()))
                children.append((float(np.nextafter(least, -np.inf)), float(np.nextafter(most, np.inf)), self._built(rest[half])))
        return _Node(v, children)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row of queries."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries), dtype=np.int64)
        self._visit(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _measured(self, entry: int, queries: np.ndarray, at: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        gap = (queries if len(at) == len(queries) else queries[at]) - self.entries[entry]
        found = np.einsum("ij,ij->i", gap, gap)
        self.taken += len(at)
        held = best[at]
        better = (found < held) | ((found == held) & (entry < index[at]))
        best[at[better]] = found[better]
        index[at[better]] = entry
        return found

    def _visit(self, node: _Node | np.ndarray, queries: np.ndarray, at: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            for e in node.tolist():
                self._measured(e, queries, at, best, index)
            return
        away = np.sqrt(self._measured(node.entry, queries, at, best, index).astype(np.float64))

        def open_(child: tuple, among: np.ndarray) -> np.ndarray:
            least, most, _ = child
            d = away[among]
            bound = np.maximum(d - most, least - d) - (d + most) * self.SLACK
            return at[among[bound <= np.sqrt(best[at[among]].astype(np.float64)) * (1 + self.SLACK)]]

        if len(node.children) == 1:
            self._visit(node.children[0][2], queries, open_(node.children[0], np.arange(len(at))), best, index)
            return
        inner, outer = node.children
        near = away <= (inner[1] + outer[0]) / 2
        within, beyond = np.flatnonzero(near), np.flatnonzero(~near)
        for child, among in ((inner, within), (outer, beyond), (outer, within), (inner, beyond)):  # the likelier child first
            self._visit(child[2], queries, open_(child, among), best, index)


def _matrix(lists: pa.Array, length: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)]


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, s_0, s_1, ...): what a task's parts add to each entry."""
    parts, entries, width = books.shape
    trees = [EntryTree(b) for b in books]
    sums, n = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
    for b in batches:
        for p, x in enumerate(_cut(_matrix(b.column(0), parts * width), parts)):
            index, _ = trees[p].nearest(x)
            n[p] += np.bincount(index, minlength=entries)
            np.add.at(sums[p], index, x)
    part, entry = np.nonzero(n)
    columns = [part.astype(np.int32), entry.astype(np.int32), n[part, entry], *sums[part, entry].T]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *[f"s_{i}" for i in range(width)]])


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    trees = [EntryTree(b) for b in books]
    for b in batches:
        found = [t.nearest(x) for t, x in zip(trees, _cut(_matrix(b.column(2), parts * width), parts), strict=True)]
        code = np.stack([i for i, _ in found], axis=1).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts, dtype=np.int32)), pa.array(code.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])


@dataclass
class Compressed:
    """rows (vec_id, label, code array<int>, error long) and codebooks (part, entry, position within the part)."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' components as decimal integers, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def restored(self, scale: int) -> DataFrame:
        """(vec_id, label, embedding array<double>): what the codes stand for, at the lower corner of the integer's cell."""
        parts, _, width = self.codebooks.shape
        books = self.codebooks.astype(np.float64) / scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                code = _matrix(b.column(2), parts)
                x = np.concatenate([books[p][code[:, p]] for p in range(parts)], axis=1) if len(code) else np.zeros((0, parts * width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, parts * width, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["vec_id", "label", "embedding"])

        label = self.rows.schema["label"].dataType.simpleString()
        return self.rows.select("vec_id", "label", "code").mapInArrow(run, f"vec_id long, label {label}, embedding array<double>")


def compress(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> Compressed:
    """Trains the codebooks on all rows and encodes all of them."""
    kind = vectors.schema[label].dataType.simpleString()
    whole = F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    given = finite_vectors(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("x")), "x")
    table = written(given.withColumn("x", whole))
    length = usual_length(table, "x") or parts
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    table = table.filter(F.size("x") == length)
    largest = table.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0] or 0
    if length * (2 * largest + 1) ** 2 >= 1 << 62:
        raise ValueError(f"components reach {largest} in integers, so squared distances leave 62 bits: take a smaller scale")
    first = [r["x"] for r in table.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()]
    width = length // parts
    books = np.array(first, dtype=np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    columns = [f"s_{i}" for i in range(width)]
    schema = ", ".join(["part int", "entry int", "n long", *[f"{c} long" for c in columns]])
    for _ in range(rounds if len(first) else 0):
        partial = table.select("x").mapInArrow(lambda it, books=books: _sums(it, books), schema)
        total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in columns])
        books = books.copy()
        for r in total.collect():  # one row an entry
            books[r["part"], r["entry"]] = [int(r[c]) // r["n"] for c in columns]
    coded = table.select("vec_id", "label", "x").mapInArrow(lambda it: _assigned(it, books), f"vec_id long, label {kind}, code array<int>, error long")
    return Compressed(coded, books)
