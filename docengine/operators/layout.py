"""Order-dependent work: pages, sections, islands, chunks, allotments, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.operators.lineage import written


def sections(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos", heading: str = "level", title: str = "text", top: int = 2) -> DataFrame:
    """blocks with the section they belong to (a heading of level 1..top opens one) and its title carried forward."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col(heading).between(1, top)
    return blocks.withColumn("section", F.count_if(opens).over(w)).withColumn("section_title", F.last(F.when(opens, F.col(title)), ignorenulls=True).over(w))


def budget_pages(blocks: DataFrame, most: int, doc: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(doc, page, pos, piece): running character budget; a block that doesn't fit is cut, and no character is lost."""
    w = Window.partitionBy(doc).orderBy(pos)
    before = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = blocks.withColumn("__from", before).filter(F.length(text) > 0).withColumn("__to", F.col("__from") + F.length(text))
    b = b.withColumn("page", F.explode(F.sequence(F.floor(F.col("__from") / most), F.floor((F.col("__to") - 1) / most))))
    lo = F.greatest(F.col("page") * most, F.col("__from"))
    hi = F.least((F.col("page") + 1) * most, F.col("__to"))
    return b.select(doc, F.col("page").cast("long").alias("page"), pos, F.substring(F.col(text), (lo - F.col("__from") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))


def _dealt(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows dealt into ranges of (key, order), written, with the range's number in __range: a key of any size is many tasks, and ranges are in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *key, *order).withColumn("__range", F.spark_partition_id()))


def _carried(dealt: DataFrame, key: list[str], of_range: Column, over_before) -> DataFrame:
    """dealt with __before: what over_before(column) makes of the ranges of the key before a row's; of_range sums a range up. One row a key and range is sorted."""
    by = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*key, "__range").agg(of_range.alias("__of")).select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col("__range").alias("__r"), over_before(F.col("__of")).over(by).alias("__before"))
    same = (F.col("__range") == F.col("__r")) & reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key])
    return dealt.join(ranges, same)


def ranked(rows: DataFrame, key: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) within the key, by order. A key may hold any share of the rows: they are ranked inside ranges, and each
    range starts where the counts of those before it end."""
    inside = F.row_number().over(Window.partitionBy(*key, "__range").orderBy(*order))
    dealt = _carried(_dealt(rows, key, order).withColumn("__inside", inside), key, F.count(F.lit(1)), F.sum)
    return dealt.select(*rows.columns, (F.coalesce("__before", F.lit(0)) + F.col("__inside")).cast("long").alias(name))


def chunks(lines: DataFrame, k: int, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """lines with chunk: every k of a document's lines."""
    w = Window.partitionBy(doc).orderBy(pos)
    return lines.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / k).cast("long"))


def islands(rows: DataFrame, key: list[str], order: str, continues: Column) -> DataFrame:
    """rows with island: a row that doesn't continue its predecessor opens one."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(F.when(continues, 0).otherwise(1)).over(w).cast("long"))


def banded_islands(rows: DataFrame, key: list[str], order: str, value: str, band: int = 4096) -> DataFrame:
    """rows with island: a new one opens where value differs from the row before (by `order`, a whole number) or is null.

    A key may hold any share of the rows: windows run inside bands of `band` order values; what a band leaves open is carried
    over from one row a band.
    """
    b = rows.withColumn("__band", F.floor(F.col(order) / band))
    w = Window.partitionBy(*key, "__band").orderBy(order)
    b = b.withColumn("__opens", F.when(F.row_number().over(w) > 1, F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)))
    ends = b.groupBy(*key, "__band").agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.sum(F.coalesce("__opens", F.lit(0))).alias("inside"))
    over = Window.partitionBy(*key).orderBy("__band")
    ends = ends.withColumn("head", F.when(F.col("first") == F.lag("last").over(over), 0).otherwise(1))
    upto = F.sum(F.col("head") + F.col("inside")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside")
    base = ends.select(*key, "__band", upto.alias("__base"))
    within = F.sum(F.coalesce("__opens", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("__within", within).join(base, [*key, "__band"]).select(*rows.columns, (F.col("__base") + F.col("__within")).cast("long").alias("island"))


def raised_heights(heights: Column, need: Column) -> Column:
    """Heights raised to sum to need, in equal parts, the remainder to the first rows."""
    n = F.greatest(F.size(heights), F.lit(1))
    lack = F.greatest(need - F.aggregate(heights, F.lit(0).cast("long"), lambda s, h: s + h), F.lit(0))
    return F.transform(heights, lambda h, i: h + F.floor(lack / n) + F.when(i < lack % n, 1).otherwise(0))


def allotted(rows: DataFrame, key: list[str], order: list[str], weight: str, total: int) -> DataFrame:
    """rows with share: whole numbers in proportion to weight that sum to total, by cumulative rounding."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = F.sum(weight).over(Window.partitionBy(*key))
    upto = F.sum(weight).over(w)
    cut = lambda x: F.floor(F.lit(total) * x / every)
    return rows.withColumn("share", (cut(upto) - cut(upto - F.col(weight))).cast("long"))


def pages(rows: DataFrame, size: int, number: int, *order: Column) -> DataFrame:
    """Page `number` (from 1) with the count of all rows; a whole-table order, so for listings."""
    w = Window.orderBy(*order)
    total = rows.count()
    cut = rows.orderBy(*order).limit(size * number)
    return cut.withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") > size * (number - 1)).withColumn("total_rows", F.lit(total).cast("long"))


def dense_grid(cells: DataFrame, columns: list[int], key: list[str], row: str = "row", col: str = "col", value: str = "value", group: int = 60) -> list[DataFrame]:
    """A sparse sheet as wide tables of `group` columns each; max() decides between repeated cells."""
    out = []
    for i in range(0, len(columns), group):
        some = columns[i : i + group]
        out.append(cells.filter(F.col(col).isin(some)).groupBy(*key, row).pivot(col, some).agg(F.max(value)))
    return out


def merge_pages(heights: list[int], merges: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Row ranges of pages of at most `most` rows that never cut a merge (top, height); an oversize merge is a page of its own."""
    n = len(heights)
    joined = [False] * n  # row i can't be cut from row i - 1
    for top, height in merges:
        for r in range(top + 1, min(n, top + height)):
            joined[r] = True
    out, start = [], 0
    while start < n:
        end = min(start + most, n)
        cut = end
        while cut > start and cut < n and joined[cut]:
            cut -= 1
        if cut == start:
            cut = end
            while cut < n and joined[cut]:
                cut += 1
        out.append((start, cut))
        start = cut
    return out


def spread_deficit(heights: list[int], need: int) -> list[int]:
    """Heights raised to sum to need: equal parts, the remainder to the first rows."""
    lack = max(0, need - sum(heights))
    if not heights:
        return []
    each, rest = divmod(lack, len(heights))
    return [h + each + (i < rest) for i, h in enumerate(heights)]


def monotone(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """events with progress: the largest value so far; late, smaller values don't move it back. A key may hold any share of the events."""
    inside = F.max(value).over(Window.partitionBy(key, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    dealt = _carried(_dealt(events, [key], order).withColumn("__inside", inside), [key], F.max(value), F.max)
    return dealt.select(*events.columns, F.greatest("__before", "__inside").alias("progress"))
