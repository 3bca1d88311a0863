"""Byte-level BPE: texts to ids and back with the tiktoken library, over a local file of ranks.

Both ways go over Arrow batches, a few megabytes of text or ids at a time; nothing is shuffled and other columns pass as they are. The
file of ranks is a path that every executor can open; each Python worker loads it once, and one that only decodes loads the ids' raw
bytes alone.

A long text is encoded a chunk at a time. It is cut only where the pre-tokenizer splits whatever surrounds the place: between a
non-blank and the space or newline after it, as no alternative of the pattern goes from a non-blank on to a blank and none looks back.
A run of blanks of `BLANK_RUN` characters or more, on which the library's matcher runs out of stack, is taken out of its chunk: all
of it but the last blank (all, at the end of a text) is one piece to the pattern, and is encoded as one.

Null texts count as empty: no ids, decoded to nothing. Bytes that are no UTF-8 count as U+FFFD. Repeated rows are encoded as often as
they come; strings that look like special tokens are ordinary text; an empty table stays empty. A column that has the name of the
result is replaced, all others come through. Ids that the ranks don't know fail the job: such rows come from another vocabulary.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's \s has the blanks of the pattern's \s and four separators more: its \S is never a blank of the pattern.
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
BLANK_RUN = 4096
BLANKS = re.compile(r"[^\S\x1c-\x1f]{%d,}" % BLANK_RUN)
CHUNK = 100_000


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of `size` characters or more, cut at safe places only."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """A vocabulary's encoder."""

    def __init__(self, ranks: str, pattern: str | None):
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})

    def encode(self, text: str) -> array:
        out = array("I")
        for part in chunks(text) if len(text) > CHUNK else (text,):
            at = 0
            for run in BLANKS.finditer(part) if len(part) >= BLANK_RUN else ():
                cut = run.end() - (run.end() < len(part))
                out.extend(self._encoding.encode_ordinary(part[at : run.start()]))
                out.extend(self._encoding._encode_single_piece(part[run.start() : cut]))
                at = cut
            out.extend(self._encoding.encode_ordinary(part[at:] if at else part))
        return out


@lru_cache(maxsize=4)
def codec(ranks: str, pattern: str | None = None) -> Codec:
    return Codec(ranks, pattern)


@lru_cache(maxsize=4)
def pieces(ranks: str) -> dict[int, bytes]:
    """id -> its raw bytes: all that decoding needs."""
    return {i: b for b, i in read_ranks(ranks).items()}


def _slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of a column of bytes, a row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(b) // 4 for b in packed])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def _through(docs: DataFrame, given: Column, columns: list[str] | None, out: str, kind: str, make) -> DataFrame:
    """docs' columns and `out`, which make(worker's rows of bytes) gives for the bytes of `given`."""
    kept = [c for c in (docs.columns if columns is None else columns) if c != out]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.StructType.fromDDL(f"x {kind}")[0].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, len(kept)):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], make(part.column(len(kept)))], names=schema.fieldNames())

    return docs.select(*kept, F.coalesce(given, F.lit(b"")).alias("__bytes")).mapInArrow(run, schema)


def encode(docs: DataFrame, *, ranks: str, pattern: str | None = None, text: str = "text", ids: str = "ids", packed: bool = False, columns: list[str] | None = None) -> DataFrame:
    """docs (all columns or those named) with the ids of their texts: an array of integers, or packed bytes, unsigned 32-bit and little-endian,
    for writers of training files."""

    def make(texts: pa.Array) -> pa.Array:
        one = codec(ranks, pattern).encode
        found = [one(t.as_py().decode("utf-8", "replace")).tobytes() for t in texts]
        return pa.array(found, pa.binary()) if packed else _lists(found)

    return _through(docs, F.col(text).cast("binary"), columns, ids, "binary" if packed else "array<int>", make)


def decode(docs: DataFrame, *, ranks: str, ids: str = "ids", out: str = "decoded", columns: list[str] | None = None) -> DataFrame:
    """docs with the bytes that their ids stand for; ids as arrays or packed. Null ids count as none. The bytes need not be UTF-8: ids may be cut
    anywhere."""

    def make(packed: pa.Array) -> pa.Array:
        known = pieces(ranks).__getitem__
        return pa.array([b"".join(map(known, np.frombuffer(b.as_py(), dtype="<u4").tolist())) for b in packed], pa.binary())

    given = F.col(ids) if docs.schema[ids].dataType.simpleString() == "binary" else _packed(F.col(ids))
    return _through(docs, given, columns, out, "binary", make)


def _packed(ids: Column) -> Column:
    @F.arrow_udf("binary")
    def packed(lists: pa.Array) -> pa.Array:
        return pa.array([np.asarray(x.as_py() or [], dtype="<u4").tobytes() for x in lists], pa.binary())

    return packed(ids)
