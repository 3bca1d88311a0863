"""Line dedup by levelled sorted runs of line hashes, in DataFrame operations only.

LineRuns keeps, for every line key seen, the number of documents that held it, in runs bucketed and sorted by the key's hash. A
batch's keys are counted once, merge-anti-joined with the runs, which takes out the keys that a run already knows to be
frequent enough (bucketed alike, the runs aren't shuffled for that), and what is left is added as a run of its own at level 0.
`fan_in` runs of a level are compacted into one of the next, so a key is in O(log n) runs.

Dropping: frequent keys are few by nature. Up to `bound` of them, by count, they travel as one set of hashes in the plan, so every
document drops its lines where it is read and no text crosses a shuffle. Beyond that, lines are joined with the keys by their
hashes, keys of many lines dealt out over several tasks, and documents with what they lose.

A key is the line, ASCII white space stripped at both ends, A-Z lower-cased; it's known by 128 bits of hash (in the set by 64).
Keys shorter than `min_chars` are never dropped. A null or empty text is one empty line. A row counts as
one document, so repeated rows count each; a key repeated within a document counts once. Nulls in doc_id are ids of their own.
An empty table gives no rows. Other columns pass through; input columns named as the results give way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import BLANKS, bucketed, drop_written, fetch, few, row_key, written


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def byte_lower(text: Column) -> Column:
    """A string that is equal for texts equal but for the case of A-Z, and only for those.

    Pure ASCII is lower-cased. Else the bytes of UTF-8 stand as Latin-1 letters, of which lower() shifts A-Z and the first bytes of
    two-byte characters to those of longer ones; the number of bytes that follow still tells them apart.
    """
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_, F.lower(text)).otherwise(F.lower(F.decode(text.cast("binary"), "ISO-8859-1")))


def line_keys(text: Column, min_chars: int) -> Column:
    """Per line its key's hash (a, b), null for keys of fewer than min_chars code points."""
    # bytes that begin a character
    size = F.length if min_chars <= 1 else lambda k: F.length(F.regexp_replace(k, "[\x80-\xbf]", ""))

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(BLANKS))
        return F.when(size(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("line"), k).alias("b")))

    return F.transform(lines_of(byte_lower(text)), key)


class LineRuns:
    """The store: runs of (a, b, n), each bucketed and sorted by (a, b)."""

    def __init__(self, spark: SparkSession, fan_in: int = 4):
        self.spark, self.fan_in, self.levels = spark, fan_in, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keyed: DataFrame, min_docs: int) -> None:
        """keyed has `keys` (line_keys of each document). Keys that a run knows from min_docs documents need no more counting."""
        new = keyed.select(F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k")).groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            new = new.join(run.filter(F.col("n") >= min_docs).select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        self.levels[0].append(bucketed(new, self.buckets, "a", "b", sort=True))
        self._compact()

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fan_in:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(bucketed(self._merged(runs), self.buckets, "a", "b", sort=True))
                self.levels[level] = []
                for run in runs:
                    drop_written(run)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The runs' keys with their sums. The files are read as such: a union of bucketed tables passes for dealt by their keys, though
        the buckets of one key stand apart in it."""
        files = [self.spark.read.schema(run.schema).parquet(run._written_path) for run in runs]
        return reduce(DataFrame.unionByName, files).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def seen(self, min_docs: int) -> DataFrame:
        """Keys (a, b) that at least min_docs documents of all batches held."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "a long, b long")
        total = runs[0] if len(runs) == 1 else self._merged(runs)
        return total.filter(F.col("n") >= min_docs).select("a", "b")


def drop_lines(docs: DataFrame, seen: DataFrame, *, min_chars: int = 1, bound: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with line_kept (the text without the lines whose key is in seen), line_n and line_dropped."""
    docs = docs.drop("line_kept", "line_n", "line_dropped")  # input columns of these names give way
    columns = docs.columns
    seen = written(seen)
    lines = lines_of(F.col(text))
    keys = line_keys(F.col(text), min_chars)
    if few(seen, bound):
        known = ", ".join(f"bigint('{r['b']}')" if r['b'] == -(1 << 63) else f"{r['b']}L" for r in seen.select("b").collect())
        gone = F.expr(f"transform(__keys, k -> coalesce(k.b IN ({known}), false))") if known else F.lit(None).cast("array<boolean>")
        out = docs.withColumn("__keys", keys).withColumn("__gone", gone)
    else:
        rows = docs.withColumn("__row", row_key(doc_id, text))
        flat = rows.select(F.col(doc_id).alias("__id"), "__row", F.posexplode(keys).alias("pos", "k")).filter("k is not null")
        hits = fetch(flat, seen.select(F.struct("a", "b").alias("k"), F.lit(True).alias("hit")), "k").filter("hit")
        per_row = hits.groupBy("__id", "__row").agg(F.collect_set("pos").alias("__at")).withColumnsRenamed({"__id": "__fid", "__row": "__frow"})
        both = rows.join(per_row, (rows["__row"] == per_row["__frow"]) & rows[doc_id].eqNullSafe(per_row["__fid"]), "left")
        marks = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.array_contains("__at", i))
        out = both.withColumn("__gone", F.when(F.col("__at").isNotNull(), marks))
    out = out.withColumn("__kept", F.when(F.coalesce(F.exists("__gone", lambda g: g), F.lit(False)), F.filter(lines, lambda x, i: ~F.get("__gone", i))).otherwise(lines))
    return out.select(*[F.col(c) for c in columns], F.array_join("__kept", "\n").alias("line_kept"), F.size(lines).cast("long").alias("line_n"), (F.size(lines) - F.size("__kept")).cast("long").alias("line_dropped"))


def keyed_rows(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """The documents' line keys, written: batches are cut from them without hashing lines again."""
    return written(docs.select(line_keys(F.col(text), min_chars).alias("keys")))


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fan_in: int = 4, bound: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Corpus-wide: every batch goes into the runs first, then every document loses the lines seen in min_docs documents."""
    keyed = keyed_rows(docs, text, min_chars)
    runs = LineRuns(docs.sparkSession, fan_in)
    for i in range(batches):
        runs.add(keyed.filter(F.pmod(F.xxhash64("keys"), F.lit(batches)) == i), min_docs)
    return drop_lines(docs, runs.seen(min_docs), min_chars=min_chars, bound=bound, doc_id=doc_id, text=text)


def dedup_increment(runs: LineRuns, batch: DataFrame, *, min_docs: int = 1, min_chars: int = 1, bound: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Streaming use: a new batch loses the lines that min_docs documents of earlier batches held, then joins the runs."""
    out = written(drop_lines(batch, runs.seen(min_docs), min_chars=min_chars, bound=bound, doc_id=doc_id, text=text))
    runs.add(keyed_rows(batch, text, min_chars), min_docs)
    return out
