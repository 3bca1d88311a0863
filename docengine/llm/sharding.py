"""Sharding by a hypergeometric communication matrix, in DataFrame operations only: a uniform shuffle, exact shard sizes.

1. Rows fall into virtual partitions by a hash of (doc_id, text), so a lost task deals its rows again alike. Their row counts go
   to the driver: one number a partition, `rows_a_partition` rows each.
2. The driver draws the matrix partition x shard: row p is multivariate hypergeometric from what the shards still need,
   so rows sum to the partitions and columns to the shard sizes (at most one apart).
3. Rows are permuted within their partition (order of a keyed hash) and dealt to shards by their row of the matrix.
4. Rows are permuted again within the shard: the slot. Shards are cut into hash ranges with counted offsets, so no task
   ever sorts a whole shard.

Null ids and texts are values like others. Rows equal in id and text are interchangeable and share a partition, unless there are
so many that the partition would be several times too large: then rows are told apart by their place in a written table. An empty
table gives no rows. Other columns pass through; input columns named shard or slot give way.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import written


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` drawn without return are good: inversion outwards from the mode, with probabilities in double precision."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, up, down, p_up, p_down = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def matrix(partitions: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Row p: how many rows of partition p go to each shard."""
    rng, total = random.Random(seed), sum(partitions)
    need = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = []
    for size in partitions:
        row, left, pool = [], size, sum(need)
        for s in range(n_shards):
            pool -= need[s]
            got = hypergeometric(rng, need[s], pool, left)
            row.append(got)
            left -= got
        need = [a - b for a, b in zip(need, row, strict=True)]
        out.append(row)
    return out


def _mixed(seed: int, round_: str, cols: list[Column]) -> Column:
    return F.xxhash64(F.lit(f"{seed}:{round_}"), *cols)


def shard(docs: DataFrame, n_shards: int, *, seed: int = 11, rows_a_partition: int = 200_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in each shard); input columns of these names
    give way."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    ids = [F.col(doc_id), F.col(text)]
    rows = docs.count()
    n_parts = max(n_shards, math.ceil(rows / rows_a_partition))

    def dealt_by(ids: list[Column]) -> DataFrame:
        return docs.withColumns({"__p": F.pmod(_mixed(seed, "part", ids), F.lit(n_parts)).cast("int"), "__first": _mixed(seed, "first", ids), "__second": _mixed(seed, "second", ids)})

    def counted(keyed: DataFrame) -> dict[int, int]:
        return {r["__p"]: r["n"] for r in keyed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each rows_a_partition rows

    keyed = dealt_by(ids)
    counts = counted(keyed)
    if max(counts.values(), default=0) > 4 * rows_a_partition:  # a group of equal rows
        keyed = written(dealt_by([*ids, F.monotonically_increasing_id()]))
        counts = counted(keyed)
    ends = []
    for p, row in enumerate(matrix([counts.get(p, 0) for p in range(n_parts)], n_shards, seed)):
        upto = 0
        ends.append((p, [upto := upto + k for k in row]))
    # one short row a partition; not broadcast by hint: the rows are dealt by __p for the window already
    table = spark.createDataFrame(ends, "__q int, __ends array<long>")
    at = F.row_number().over(Window.partitionBy("__p").orderBy("__first")) - 1
    local = keyed.withColumn("__at", at.cast("long"))
    dealt = local.join(table, local["__p"] == table["__q"]).withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__at"))).cast("int"))
    dealt = written(dealt.select(*docs.columns, "shard", "__second"))
    ranges = max(1, math.ceil(rows / n_shards / rows_a_partition * 2))
    width = (1 << 64) // ranges + 1
    dealt = dealt.withColumn("__range", F.floor((F.col("__second").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("long"))
    per = dealt.groupBy("shard", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(F.col("shard").alias("__s"), F.col("__range").alias("__r"), before.alias("__before"))
    placed = dealt.withColumn("__in", F.row_number().over(Window.partitionBy("shard", "__range").orderBy("__second")) - 1)
    out = placed.join(offsets, (placed["shard"] == offsets["__s"]) & (placed["__range"] == offsets["__r"]))
    return out.select(*docs.columns, "shard", (F.col("__before") + F.col("__in")).cast("long").alias("slot"))
