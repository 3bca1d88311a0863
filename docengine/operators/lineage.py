"""Cutting lineage by tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders of tables that this process has written and not deleted, in order.
_made: list[str] = []


def noted(path: str) -> str:
    """Remembers a folder for sweep()."""
    _made.append(path)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error else."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all its executors share")
        found = tempfile.mkdtemp(prefix="docengine-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = noted(f"{shared_dir(spark)}/docengine-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    path = getattr(df, "_written_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    name = path.rsplit("/", 1)[-1]
    if name.replace("_", "").isalnum() and spark.catalog.tableExists(name):  # bucketed ones are in the catalog
        spark.sql(f"DROP TABLE {name}")
    if path in _made:
        _made.remove(path)


def sweep(spark: SparkSession, *, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables that this process has written (since the mark), but those to keep. Frames that read them are dead after that:
    for when results are stored or collected."""
    held = {getattr(df, "_written_path", None) for df in keep}
    for path in [p for p in _made[since:] if p not in held]:
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside go at the end, but those appended to the list."""
    mark, keep = len(_made), []
    yield keep
    sweep(spark, since=mark, keep=tuple(keep))
