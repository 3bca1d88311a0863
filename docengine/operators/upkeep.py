"""Derived counters kept up to date from what was added and removed, instead of being built anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.sources.store import Store

#: Name of the rows' count in every report.
COUNT = "n"


def rollup(rows: DataFrame, key: list[str], sums: dict[str, Column], least: dict[str, Column], most: dict[str, Column]) -> DataFrame:
    """(key, n, sums, least and most values), from scratch."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias(COUNT), *[F.sum(c).alias(k) for k, c in sums.items()], *[F.min(c).alias(k) for k, c in least.items()], *[F.max(c).alias(k) for k, c in most.items()])


def adjusted(report: DataFrame, added: DataFrame, removed: DataFrame, current: DataFrame, key: list[str], sums: dict[str, Column], least: dict[str, Column], most: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows of the report that change, keys that go). Keys are not null.

    Counts and sums take what was added and give back what was removed. A least or most value that only gained rows takes the new ones; where a removed
    row held it, it can't be subtracted, and that group alone is read again from the current rows.
    """
    plus, minus = (rollup(df, key, sums, least, most).withColumnsRenamed({k: f"{side}{k}" for k in (COUNT, *sums, *least, *most)}) for df, side in ((added, "in_"), (removed, "out_")))
    touched = plus.join(minus, key, "full")
    both = touched.join(report.select(*key, *[F.col(k).alias(f"was_{k}") for k in (COUNT, *sums, *least, *most)]), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    moved = {k: zero(f"was_{k}") + zero(f"in_{k}") - zero(f"out_{k}") for k in (COUNT, *sums)}
    lost = [F.coalesce(F.col(f"out_{k}") <= F.col(f"was_{k}"), F.lit(False)) for k in least] + [F.coalesce(F.col(f"out_{k}") >= F.col(f"was_{k}"), F.lit(False)) for k in most]
    both = both.select(*key, *[v.alias(k) for k, v in moved.items()], *[F.least(f"was_{k}", f"in_{k}").alias(k) for k in least], *[F.greatest(f"was_{k}", f"in_{k}").alias(k) for k in most], reduce(lambda a, b: a | b, lost, F.lit(False)).alias("__again"))
    gone = both.filter(F.col(COUNT) == 0).select(*key)
    kept = both.filter(F.col(COUNT) > 0)
    if not least and not most:
        return kept.drop("__again"), gone
    again = kept.filter("__again").select(*key)
    fresh = current.join(again, key, "left_semi").groupBy(*key).agg(*[F.min(c).alias(f"now_{k}") for k, c in least.items()], *[F.max(c).alias(f"now_{k}") for k, c in most.items()])
    out = kept.join(fresh, key, "left").withColumns({k: F.when(F.col("__again"), F.col(f"now_{k}")).otherwise(F.col(k)) for k in (*least, *most)})
    return out.select(*key, COUNT, *sums, *least, *most), gone


class Report:
    """A stored table of counters over a stored table of rows (C8): built once, then rewritten in place where rows have changed."""

    def __init__(self, store: Store, name: str, source: str, key: list[str], sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, most: dict[str, Column] | None = None):
        self.store, self.name, self.source, self.key = store, name, source, key
        self.measures = (sums or {}, least or {}, most or {})

    def _mark(self) -> str:
        return f"{self.name} follows {self.source}"

    def build(self) -> None:
        with self.store.begin() as tx:
            tx.put("write", self.name, self.store.stage(self.name, rollup(tx.read(self.source), self.key, *self.measures)))
            tx.note(self._mark(), tx.snapshot)

    def refresh(self) -> int:
        """Follows the source to the newest commit; how many groups changed. Report and mark are one commit, so a repeated refresh adds nothing twice,
        and of two at once one fails with Conflict or writes the same."""
        with self.store.begin() as tx:
            since = self.store.notes(tx.snapshot).get(self._mark())
            if since is None:
                raise ValueError(f"{self.name} hasn't been built")
            added, removed = self.store.changes(self.source, since, tx.snapshot)
            changed, gone = adjusted(tx.read(self.name), added, removed, tx.read(self.source), self.key, *self.measures)
            tx.save(self.name, changed, self.key)
            tx.delete(self.name, gone, self.key)
            tx.note(self._mark(), tx.snapshot)
            return sum(s["rows"] for _, _, s in tx.changed)
