"""Order-preserving packing: window cuts by dynamic programming over document and sentence boundaries.

A partition's documents, in order, are one stream of tokens (each document's ids, then an end id). Cut candidates are document
ends and sentence ends (the token after which a text's sentence mark and white space follow); only in a stretch longer than a
window, where there's none to choose, every `step` tokens. The cost of a window is its padding; a cut at a sentence end costs `sentence_cost` more, one elsewhere inside
a document `inner_cost`. f(j) = min over i in [j - window, j) of f(i) + window - (j - i) + cost(j): f(i) + i over a sliding
range, so a monotone queue gives every minimum in constant time.

The stream is solved a chunk at a time: windows before the last cheap cut are given out, the rest is carried on, so memory is
bounded and only a partition's last window is short. Nothing is shuffled. Texts are never cut to a prefix; null texts are empty
(the end id alone). Repeated rows are packed as often as they come, null ids like others. An empty table gives no pieces. Of the
input only doc_id and text are read; other columns don't come through.

Ids are those of the byte-level BPE vocabulary given as ranks, and of the added tokens that the tokenizer's JSON beside it lists:
texts are split at those first, as `tokenizers` does. What is between them goes through `bpe`'s codec, the tiktoken library over a text at
a time. `tests/llm` holds it to the `tokenizers` library's ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm import bpe


def added_tokens(ranks: str) -> dict[str, int]:
    """Strings that have ids of their own, of the JSON that goes with the ranks; a vocabulary of ranks alone has none."""
    if not os.path.exists(path := f"{os.path.splitext(ranks)[0]}.json"):
        return {}
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError("added tokens that look at their surroundings")
    return {a["content"]: a["id"] for a in added}


class Encoder:
    """text -> ids, as a numpy array, and the counts of ids before each cut after a sentence."""

    def __init__(self, ranks: str):
        table = bpe.read_ranks(ranks)
        self.codec = bpe.codec(ranks)
        self.added = added_tokens(ranks)
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.closes = np.zeros(max([*table.values(), *self.added.values()]) + 1, dtype=bool)
        self.opens = np.zeros(len(self.closes), dtype=bool)
        for token, i in table.items():
            self.closes[i] = token[-1:] in (b".", b"!", b"?") or b"\n" in token
            self.opens[i] = token[:1] in (b" ", b"\n")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces, at = [], 0
        for m in self.at_added.finditer(text):
            pieces += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        ids = np.frombuffer(b"".join([*pieces, self._plain(text[at:] if at else text)]), dtype="<u4")
        ends = np.flatnonzero(self.closes[ids[:-1]] & self.opens[ids[1:]]) + 1 if len(ids) > 1 else np.zeros(0, dtype=np.int64)
        return ids, ends

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        return self.codec.encode(text).tobytes()


@lru_cache(maxsize=2)
def encoder(ranks: str) -> Encoder:
    return Encoder(ranks)


def cut_points(lengths: list[int], ends: list[np.ndarray], window: int, step: int, sentence_cost: float, inner_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted candidates (tokens before the cut, from 1) and their costs, for documents one after another."""
    points, costs, base = [], [], 0
    for n, e in zip(lengths, ends, strict=True):
        inner = e[(e > 0) & (e < n)]
        marks = np.r_[0, inner, n]
        gaps = np.diff(marks)
        if (gaps > window).any():
            far = np.concatenate([np.arange(a + step, b, step) for a, b, g in zip(marks[:-1], marks[1:], gaps) if g > window])
            at = np.r_[inner, far, n]
            cost = np.r_[np.full(len(inner), sentence_cost), np.full(len(far), inner_cost), 0.0]
            order = np.argsort(at, kind="stable")
            at, cost = at[order], cost[order]
        else:
            at, cost = np.r_[inner, n], np.r_[np.full(len(inner), sentence_cost), 0.0]
        points.append(at + base)
        costs.append(cost)
        base += n
    return np.concatenate(points), np.concatenate(costs)


def best_cuts(points: np.ndarray, costs: np.ndarray, window: int) -> tuple[list[float], list[int]]:
    """f and the previous cut of each candidate (-1: the start). Gaps between candidates are at most `window`."""
    f, back = [], []
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])
    pop, push = queue.pop, queue.append
    for j, (p, c) in enumerate(zip(points.tolist(), costs.tolist())):
        low = p - window
        while queue[0][1] < low:
            queue.popleft()
        head = queue[0]
        value = head[0] + window - p + c
        f.append(value)
        back.append(head[2])
        key = value + p
        while queue and queue[-1][0] >= key:
            pop()
        push((key, p, j))
    return f, back


def _windows(points: np.ndarray, costs: np.ndarray, window: int, last: bool) -> list[int]:
    """Ends of the windows to give out."""
    f, back = best_cuts(points, costs, window)
    if last:
        j = len(points) - 1
    else:
        total = int(points[-1])
        lo = int(np.searchsorted(points, total - window))
        j = min(range(lo, len(points)), key=f.__getitem__)  # of the cuts near the end, the one that has cost least
    out = []
    while j >= 0:
        out.append(int(points[j]))
        j = back[j]
    return out[::-1]


class Packer:
    """Takes documents in order, gives pieces: (document, start, length, crc, tokens, sequence, offset, ids)."""

    def __init__(self, window: int, first_sequence: int, step: int, sentence_cost: float, inner_cost: float, chunk: int):
        self.window, self.sequence, self.chunk = window, first_sequence, chunk
        self.costs = (step, sentence_cost, inner_cost)
        self.docs: list[tuple[object, int, int, np.ndarray, np.ndarray]] = []  # document, start, all its tokens, rest of its ids, sentence ends in them
        self.size = 0

    def add(self, doc: object, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc, 0, len(ids), ids, ends))
        self.size += len(ids)
        if self.size >= self.chunk:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        points, costs = cut_points([len(d[3]) for d in self.docs], [d[4] for d in self.docs], self.window, *self.costs)
        base = at = 0  # tokens before the current document; documents done
        for end in _windows(points, costs, self.window, last):
            begin = self._begin
            while begin < end:
                doc, start, total, ids, _ = self.docs[at]
                lo = begin - base
                hi = min(len(ids), end - base)
                piece = ids[lo:hi]
                yield doc, start + lo, len(piece), zlib.crc32(piece.tobytes()), total, self.sequence, begin - self._begin, piece
                begin = base + hi
                if hi == len(ids):
                    base += hi
                    at += 1
            self.sequence += 1
            self._begin = end
        rest = self.docs[at:]
        if rest and self._begin > base:
            doc, start, total, ids, ends = rest[0]
            k = self._begin - base
            rest[0] = (doc, start + k, total, ids[k:], ends[ends > k] - k)
        self.docs, self.size, self._begin = rest, sum(len(d[3]) for d in rest), 0

    _begin = 0


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, ranks: str, window: int = 2048, end_id: int = 1, step: int = 32, sentence_cost: float = 4.0, inner_cost: float = 12.0, chunk: int = 1_500_000, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids)."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(PIECE).fields] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    if window <= step:
        raise ValueError("candidates every `step` tokens must be closer than a window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(ranks)
        packer = Packer(window, TaskContext.get().partitionId() << 32, step, sentence_cost, inner_cost, chunk)
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], kind)] + [pa.array(cols[i], pa.int64()) for i in range(1, 7)]
            if with_ids:
                offsets = np.r_[0, np.cumsum([len(x) for x in cols[7]])].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cols[7]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

        rows: list[tuple] = []
        for b in batches:
            kind = b.column(0).type
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids, ends = enc.encode(t.as_py() or "")
                for piece in packer.add(d, np.append(ids, np.uint32(end_id)).astype("<u4"), ends):
                    rows.append(piece)
                if len(rows) >= 2000:
                    yield out(rows)
                    rows = []
        rows.extend(packer.flush(True))
        if rows:
            yield out(rows)

    return docs.select(F.col(doc_id), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
