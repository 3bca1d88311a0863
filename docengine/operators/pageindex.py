"""Listings by page over a sorted, counted index (T5, T6, F24, S4): a page reads the ranges that hold it, not what comes before.

Rows are dealt once into ranges of the order, sorted within, a folder a range; rows of each range are counted. Page N is in the ranges whose
running counts it falls into; a cursor continues after a row's key in the range that holds the key; a first match is looked for range by range and stops
where it is found. The counts are at most `most_ranges` numbers, however many rows there are.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.operators.lineage import noted, shared_dir

RANGE = "__range"


def _sort(order: list[str]) -> list[Column]:
    """Names, led by - where they fall; nulls last."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]


@dataclass
class PageIndex:
    spark: SparkSession
    path: str
    schema: T.StructType
    order: list[str]
    counts: list[int]

    @classmethod
    def build(cls, rows: DataFrame, order: list[str], rows_a_range: int = 100_000, most_ranges: int = 10_000) -> "PageIndex":
        """order should tell all rows apart; rows that it doesn't may change places between pages."""
        spark = rows.sparkSession
        total = rows.count()
        n = max(1, min(most_ranges, -(-total // rows_a_range)))
        path = noted(f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}")
        dealt = rows.repartitionByRange(n, *_sort(order)).sortWithinPartitions(*_sort(order)) if n > 1 else rows.repartition(1).sortWithinPartitions(*_sort(order))
        dealt.withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(path)
        schema = T.StructType([*rows.schema.fields, T.StructField(RANGE, T.IntegerType())])
        found = {r[RANGE]: r["n"] for r in spark.read.schema(schema).parquet(path).groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect()} if total else {}
        return cls(spark, path, rows.schema, order, [found.get(i, 0) for i in range(n)])

    @property
    def total(self) -> int:
        return sum(self.counts)

    def _read(self, first: int, last: int) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(RANGE, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path).filter(F.col(RANGE).between(first, last))

    def ranges_of(self, start: int, end: int) -> tuple[int, int, int]:
        """(first range, last range, rows before the first) that hold rows start up to but without end."""
        ends = list(accumulate(self.counts))
        first = bisect_right(ends, start)
        last = min(bisect_right(ends, max(start, end - 1)), len(self.counts) - 1)
        return first, last, (ends[first - 1] if first else 0)

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of page `number` (from 1) with rn, their place in the whole, and total_rows."""
        start = (number - 1) * size
        if start >= self.total:
            return self._read(0, -1).select(*self.schema.names, F.lit(0).cast("long").alias("rn"), F.lit(self.total).cast("long").alias("total_rows"))
        first, last, before = self.ranges_of(start, start + size)
        rows = self._read(first, last).withColumn("rn", F.row_number().over(Window.orderBy(F.col(RANGE), *_sort(self.order))).cast("long") + before)
        return rows.filter((F.col("rn") > start) & (F.col("rn") <= start + size)).withColumn("total_rows", F.lit(self.total).cast("long")).drop(RANGE)

    def _after(self, key: tuple) -> Column:
        """Rows that come later in the order than a row with these values."""
        later, same = F.lit(False), F.lit(True)
        for c, v in zip(self.order, key, strict=True):
            name, falls = c.lstrip("-"), c.startswith("-")
            beyond = F.lit(False) if v is None else (F.col(name) < v if falls else F.col(name) > v) | F.col(name).isNull()
            later |= same & beyond
            same &= F.col(name).eqNullSafe(F.lit(v))
        return F.coalesce(later, F.lit(False))

    def after(self, key: tuple, size: int) -> DataFrame:
        """The `size` rows after a row's key, for cursors: reads on from the first range with such a row until there are enough."""
        where, got, first = self._after(key), 0, None
        for i in range(len(self.counts)):
            if first is None and not self._read(i, i).filter(where).limit(1).count():
                continue
            first = i if first is None else first
            got += self._read(i, i).filter(where).limit(size - got).count()
            if got >= size:
                break
        last = len(self.counts) - 1 if first is None else i
        return self._read(first if first is not None else 0, last if first is not None else -1).filter(where).orderBy(*_sort(self.order)).limit(size).drop(RANGE)

    def first(self, where: Column) -> DataFrame:
        """The first row in order for which `where` holds; ranges are read in order, four times as many each time, until there is one."""
        i, step = 0, 1
        while i < len(self.counts):
            some = self._read(i, i + step - 1).filter(where)
            if some.limit(1).count():
                return some.orderBy(F.col(RANGE), *_sort(self.order)).limit(1).drop(RANGE)
            i, step = i + step, step * 4
        return self._read(0, -1).drop(RANGE)
