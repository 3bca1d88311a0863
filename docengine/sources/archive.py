"""ZIP containers as rows: one row an entry, its bytes on demand, and the safety checks over them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = "path string, modificationTime timestamp, length long, content binary"
ENTRY = "doc_id string, pos int, part string, size long, packed long, crc long, encrypted boolean, directory boolean, data binary, error string"


def landed(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """Files that landed in a folder, oversize ones left unread by the length filter."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).filter(F.col("length") <= most_bytes)


#: Many small files' rows travel together: a batch ends with the file that reaches this many rows, or bytes read.
ROWS, BYTES = 1024, 4 * 1024 * 1024


def _batch(rows: list[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """By column: no row of its own is built for Arrow."""
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def per_file(files: DataFrame, parse: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that parse(path, bytes) gives for each file. The last column takes the error of a file that can't be read."""
    fields = T.StructType.fromDDL(schema)
    arrow = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                name, data = path.as_py(), content.as_py()
                try:
                    rows = list(parse(name, data))
                except Exception as e:  # noqa: BLE001  one bad file is a row, not a lost job
                    rows = [(name, *[None] * (len(fields) - 2), f"{type(e).__name__}: {e}")]
                held += rows
                size += len(data or b"")
                if len(held) >= ROWS or size >= BYTES:
                    yield from _batch(held, arrow)
                    held, size = [], 0
        yield from _batch(held, arrow)

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, fields)


def arrow_schema(fields: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in fields])


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in t])
    if isinstance(t, T.MapType):
        return pa.map_(_arrow(t.keyType), _arrow(t.valueType))
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}[t.simpleString()]


def entries(files: DataFrame, with_data: bool = False, most_entry: int = 256 * 1024 * 1024) -> DataFrame:
    """The directory of every archive, with the entries' bytes if asked; an entry that is too large to read says so."""

    def parse(name: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i, e in enumerate(z.infolist()):
                locked = bool(e.flag_bits & 1)
                large = with_data and not locked and e.file_size > most_entry
                data = z.read(e) if with_data and not locked and not large else None
                yield name, i, e.filename, e.file_size, e.compress_size, e.CRC, locked, e.is_dir(), data, f"entry is larger than {most_entry} bytes" if large else None

    return per_file(files, parse, ENTRY)


def unsafe(entries_: DataFrame, most_entries: int = 5000, most_ratio: float = 200.0, most_total: int = 2 * 1024**3) -> DataFrame:
    """I8: (doc_id, reason) of archives that reach out of their folder, hold too much, expand too much or are locked."""
    out_of = F.col("part").startswith("/") | F.col("part").rlike(r"(^|[/\\])\.\.([/\\]|$)") | F.col("part").rlike(r"^[A-Za-z]:|\\")
    per = entries_.filter(F.col("error").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("packed").alias("packed"), F.bool_or(out_of).alias("outside"), F.bool_or("encrypted").alias("locked"))
    reasons = F.filter(F.array(F.when(F.col("outside"), "traversal"), F.when(F.col("locked"), "encrypted"), F.when(F.col("n") > most_entries, "entries"), F.when(F.col("size") > most_total, "size"), F.when(F.col("size") > most_ratio * F.greatest("packed", F.lit(1)), "ratio")), lambda r: r.isNotNull())
    return per.select("doc_id", F.explode(reasons).alias("reason"))


def preview(entries_: DataFrame, most: int = 40) -> DataFrame:
    """The first entries of every archive, with the count of all."""
    per = entries_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entry_count"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "part", "size"))), 1, most).alias("shown"))
    return per.select("doc_id", "entry_count", F.explode("shown").alias("e")).select("doc_id", "entry_count", "e.*")


def contained(path: Column, root: str) -> Column:
    """A normalised path below root."""
    return F.coalesce(path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))
