"""Pages, cursors and first matches of a sorted index against sorting the whole."""

import random

import pytest
from docengine.operators.pageindex import PageIndex
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(i, rng.choice([None, 1, 2, 2, 2, 5, 9]), f"x{i % 3}") for i in range(500)]


@pytest.fixture(scope="module")
def index(spark, rows):
    return PageIndex.build(spark.createDataFrame(rows, "id long, n int, s string").repartition(5), ["-n", "id"], rows_a_range=40)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))


def test_pages(index, rows):
    want = ordered(rows)
    assert index.total == 500 and len(index.counts) == 13
    for number, size in [(1, 20), (25, 20), (13, 20), (3, 170), (1, 1000), (26, 20), (500, 1)]:
        got = sorted(map(tuple, index.page(number, size).select("rn", "id", "n", "s", "total_rows").collect()))
        assert got == [(i + 1, *want[i], 500) for i in range((number - 1) * size, min(500, number * size))]


def test_a_deep_page_reads_few_ranges(spark):
    deep = PageIndex.build(spark.range(30_000).select(F.col("id"), (F.col("id") * 7919 % 30_000).alias("n")), ["n"], rows_a_range=500)
    first, last, before = deep.ranges_of(999 * 20, 1000 * 20)
    assert last - first <= 1 and sum(deep.counts[first : last + 1]) <= 3000 and before <= 999 * 20
    page = deep.page(1000, 20)
    assert [r.n for r in page.orderBy("rn").collect()] == list(range(999 * 20, 1000 * 20))
    scan = [line for line in page._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PartitionFilters" in line]
    assert scan and "__range" in scan[0]


def test_cursor_and_first_match(index, rows):
    want, key, got = ordered(rows), None, []
    page = index.page(1, 90).orderBy("rn").collect()
    while page:
        got += [r.id for r in page]
        key = (page[-1].n, page[-1].id)
        page = index.after(key, 90).collect()
    assert got == [r[0] for r in want]
    assert index.first(F.col("s") == "x1").first().id == next(r[0] for r in want if r[2] == "x1")
    assert index.first(F.col("n").isNull()).first().id == next(r[0] for r in want if r[1] is None)
    assert index.first(F.col("s") == "none").collect() == []


def test_an_empty_listing(spark):
    none = PageIndex.build(spark.createDataFrame([], "id long"), ["id"])
    assert none.total == 0 and none.page(1, 10).collect() == [] and none.after((3,), 5).collect() == [] and none.first(F.lit(True)).collect() == []
