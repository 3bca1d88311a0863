"""Joins, sets and DML of the workbench's tables as plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.nulls import first_given
from docengine.operators.lineage import written


def spread(keys: DataFrame) -> DataFrame:
    """Keys dealt out before files are made of them, so that a small table's files are many tasks' work."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def named(items: DataFrame, files: DataFrame, key: str = "file_id", name: str = "file_name") -> DataFrame:
    """items with the file's name; the id itself where there's no such file. The planner picks the strategy by size."""
    f = files.select(F.col(key).alias("__k"), F.col(name).alias("__n"))
    return items.join(f, items[key] == f["__k"], "left").withColumn(name, F.coalesce("__n", items[key].cast("string"))).drop("__k", "__n")


def overlaid(items: DataFrame, notes: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """items with the annotation's fields where they're given (not null, not empty), else the item's own."""
    n = notes.select(F.col(on).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = items.join(n, items[on] == n["__k"], "left")
    return out.withColumns({f: first_given(f"__{f}", f) for f in fields}).drop("__k", *[f"__{f}" for f in fields])


def not_covered(have: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """have, and of wanted what isn't in it."""
    return have.unionByName(wanted.join(have.select(*on), on, "left_anti"), allowMissingColumns=True)


def compared(before: DataFrame, after: DataFrame, label: str, value: str) -> DataFrame:
    """(label, before, after, delta) over the union of labels; missing is 0."""
    a = before.select(label, F.col(value).alias("before"))
    b = after.select(label, F.col(value).alias("after"))
    both = a.join(b, label, "full").select(label, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("delta", F.col("after") - F.col("before"))


def within_regions(cells: DataFrame, regions: DataFrame, group: list[str], row: str = "row", column: str = "col") -> DataFrame:
    """cells with the first region that holds them (region: id, top, left, bottom, right), or null.

    A range join as an equi-join: regions are cut into row bands of `band` rows and gathered by band; a cell meets the one row of
    its band, so equal cells stay as many as they are.
    """
    band = 64
    r = regions.withColumn("__band", F.explode(F.sequence(F.floor(F.col("top") / band), F.floor(F.col("bottom") / band))))
    bands = r.groupBy(*group, "__band").agg(F.collect_list(F.struct("id", "top", "left", "bottom", "right")).alias("__regions"))
    c = cells.withColumn("__band", F.floor(F.col(row) / band)).join(bands, [*group, "__band"], "left")
    holds = F.filter("__regions", lambda x: F.col(row).between(x["top"], x["bottom"]) & F.col(column).between(x["left"], x["right"]))
    return c.select(*cells.columns, F.array_min(F.transform(holds, lambda x: x["id"])).alias("region"))


def matched_flag(left: DataFrame, right: DataFrame, on: str, flag: str) -> DataFrame:
    """left with whether right has its key: lets a semi-join stand beside other conditions in an OR."""
    keys = right.select(on).distinct().withColumn(flag, F.lit(True))
    return left.join(keys, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_first: list[str] = ()) -> DataFrame:
    """new over old by key; columns of keep_first keep old's value where there was one."""
    kept = old.join(new.select(*key), key, "left_anti")
    if keep_first:
        before = old.select(*key, *[F.col(c).alias(f"__{c}") for c in keep_first])
        new = new.join(before, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep_first}).select(*new.columns)
    return kept.unionByName(new)


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def deleted(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows whose foreign key is gone, and (table_name, removed) counts."""
    keys = gone.select(key).distinct()
    kept, counts = {}, []
    for name, (df, fk) in tables.items():
        k = keys.withColumnRenamed(key, fk)
        kept[name] = df.join(k, fk, "left_anti")
        counts.append(df.join(k, fk, "left_semi").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("removed")))
    return kept, reduce(DataFrame.unionByName, counts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unpivoted(row: DataFrame, entries: list[tuple[str, str, Column]], keys: list[str] = ()) -> DataFrame:
    """One row an entry (id, label, value) from one wide row: a check table from one aggregation pass."""
    items = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), v.cast("long").alias("metric")) for i, label, v in entries])
    return row.select(*keys, F.explode(items).alias("e")).select(*keys, "e.*")


def ordered_merge(user: DataFrame, recommended: DataFrame, key: str) -> DataFrame:
    """Recommended items in the user's order first, then the rest in their own. Both have `pos`."""
    u = user.select(F.col(key), F.col("pos").alias("__u"))
    return recommended.join(u, key, "left").orderBy(F.coalesce("__u", F.lit(1_000_000_000)), "pos").drop("__u")


def ancestors(nodes: DataFrame, most: int = 1 << 40) -> DataFrame:
    """(id, root, depth) of a forest (id, parent_id), by pointer doubling: log2(depth) joins, no recursion limit.

    Each round is written, so the plan doesn't double with it, and the walk ends when every pointer stands on a root.

    A parent that doesn't exist ends the walk as its own root's absence: root is null. A cycle raises.
    """
    nodes = written(nodes.select("id", "parent_id"))
    now = nodes.select("id", F.coalesce("parent_id", "id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    moving = -1
    for _ in range(most.bit_length()):
        jump = now.select(F.col("id").alias("k"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        now = now.join(jump, F.col("up") == F.col("k"), "left").select("id", F.when(F.col("k").isNotNull(), F.col("up2")).alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
        now = written(now)
        still = now.filter(F.col("up").isNotNull()).join(nodes.filter("parent_id is null").select(F.col("id").alias("up")), "up", "left_anti").count()
        if still in (0, moving):  # none left, or only cycles, which are as many in every round
            break
        moving = still
    roots = nodes.filter("parent_id is null").select(F.col("id").alias("r"))
    checked = now.join(roots, F.col("up") == F.col("r"), "left")
    cycle = F.when(F.col("up").isNotNull() & F.col("r").isNull(), F.raise_error(F.concat(F.lit("cycle at "), F.col("id").cast("string"))).cast("string"))
    return checked.select("id", F.when(cycle.isNull(), F.col("up")).alias("root"), "depth")


def inherited(nodes: DataFrame, props: str = "props", most: int = 1 << 20) -> DataFrame:
    """J14, AR4: (id, props): maps of a forest (id, parent_id) with what they inherit; the nearest one's value wins.

    Pointer doubling: every round a node takes in as many more ancestors as it has. Nodes that have reached their root leave the join, so a root
    that all end on isn't joined by all. A parent that doesn't exist ends the chain; a cycle raises.
    """
    now = written(nodes.select("id", F.col("parent_id").alias("up"), F.col(props).alias("own")))
    done = []
    for _ in range(most.bit_length() + 1):
        moving = now.filter(F.col("up").isNotNull())
        done.append(now.filter(F.col("up").isNull()).select("id", "own"))
        if not moving.limit(1).count():
            return union_all(done).withColumnRenamed("own", props)
        known = union_all([now.select(F.col("id").alias("k"), F.col("up").alias("up2"), F.col("own").alias("far")), *[d.select(F.col("id").alias("k"), F.lit(None).cast(now.schema["up"].dataType).alias("up2"), F.col("own").alias("far")) for d in done[:-1]]])
        far = F.coalesce("far", F.create_map().cast(now.schema["own"].dataType))
        kept = F.map_filter(far, lambda k, _: ~F.map_contains_key(F.col("own"), k))
        now = written(moving.join(known, F.col("up") == F.col("k"), "left").select("id", F.col("up2").alias("up"), F.map_concat("own", kept).alias("own")))
    raise ValueError("a cycle of parents")
