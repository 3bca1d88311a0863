"""Periodic retention over a store (M6): a table a day, so that whole days go from the manifest alone and only the day of the cut is rewritten."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.operators.relational import union_all
from docengine.sources.store import Store, Transaction

DAY = "%Y-%m-%d"


class DayTable:
    """Rows with a time, kept as one stored table a UTC day. A batch is written once, by day; its days come to the driver, a few by nature."""

    def __init__(self, store: Store, name: str, at: str = "created_at"):
        self.store, self.name, self.at = store, name, at

    def _days(self, tables: dict) -> dict[datetime.date, str]:
        prefix = f"{self.name}@"
        return {datetime.datetime.strptime(t.removeprefix(prefix), DAY).date(): t for t in sorted(tables) if t.startswith(prefix)}

    def append(self, rows: DataFrame) -> None:
        """Rows without a time are refused: no day holds them, and no cut would ever take them."""
        if rows.filter(F.col(self.at).isNull()).limit(1).count():
            raise ValueError(f"rows without {self.at}")
        staged = self.store.stage_each(self.name, rows.withColumn("day", F.date_format(self.at, "yyyy-MM-dd")), "day")
        with self.store.begin() as tx:
            for day, segment in sorted(staged.items()):
                tx.lay(f"{self.name}@{day}", segment)

    def read(self, since: datetime.date | None = None, until: datetime.date | None = None) -> DataFrame:
        """Days from since to until; other days aren't opened."""
        tables = self.store.current()
        some = [self.store.table(tables[t]) for d, t in self._days(tables).items() if (since is None or d >= since) and (until is None or d <= until)]
        if not some:
            raise ValueError(f"{self.name} has no such days")
        return union_all(some)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes days' files that the last `keep` commits don't name."""
        store = self.store
        named = {x["path"] for n in store.manifests()[-keep:] for segments in (store.manifest(n) or {"tables": {}})["tables"].values() for x in segments}
        for v in store.versions(self.name):
            for day in store._names(f"{self.name}/{v}"):
                path = f"{self.name}/{v}/{day}"
                if day.startswith("day=") and path not in named:
                    fs, p = store._fs(f"{store.root}/{path}")
                    fs.delete(p, True)

    def _cut(self, tx: Transaction, cutoff: datetime.datetime) -> dict[str, int]:
        dropped = {"days_dropped": 0, "days_rewritten": 0, "rows_deleted": 0}
        for day, table in self._days(tx.tables).items():
            if day < cutoff.date():
                dropped["rows_deleted"] += self.store.table(tx.tables[table]).count()
                tx.drop(table)
                dropped["days_dropped"] += 1
            elif day == cutoff.date():
                now = tx.read(table)
                kept = now.filter(F.col(self.at) > F.lit(cutoff))
                gone = now.count() - kept.count()
                if gone:
                    tx.put("write", table, self.store.stage(table, kept))
                    dropped["days_rewritten"] += 1
                    dropped["rows_deleted"] += gone
        return dropped

    def retain(self, now: datetime.datetime, keep_days: int, interval_days: int = 1) -> dict[str, int] | None:
        """Deletes what is as old as `keep_days` or older, if the last clean-up is `interval_days` ago; None if it isn't yet time. The
        clean-up and its time are one commit. Times are UTC."""
        mark = f"{self.name} lastCleanupAt"
        with self.store.begin() as tx:
            last = self.store.notes(tx.snapshot).get(mark)
            if last is not None and now < datetime.datetime.fromisoformat(last) + datetime.timedelta(days=interval_days):
                return None
            dropped = self._cut(tx, now - datetime.timedelta(days=max(0, keep_days)))
            tx.note(mark, now.isoformat(timespec="seconds"))
        return dropped
