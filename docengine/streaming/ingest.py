"""Files that land in a folder, followed as a stream into a registry of contents (S16, P1, P3): each content once, whatever it's called and however
often a batch is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.sources.store import Store

LANDED = "path string, modificationTime timestamp, length long, content binary"
FILES, ARRIVALS, CONTENTS = "files", "arrivals", "contents"


def landed(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = 500 << 20, files_a_batch: int = 1000) -> DataFrame:
    """The stream of files no larger than `most_bytes`; larger ones never reach a task's memory. Files of no bytes don't come: Spark's file
    sources pass them over."""
    stream = spark.readStream.format("binaryFile").schema(LANDED).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return stream.filter(F.col("length") <= most_bytes)


def register(store: Store, batch: DataFrame, number: int, typed: Callable[[DataFrame], DataFrame], mark: str) -> bool:
    """One batch, as one commit: new contents' files and bytes, and every arrival. A batch that is already in adds nothing.

    typed: makes rows with sha256 and file_path of (path, content). Of several new files with one content the first path names it.
    """
    if store.notes().get(mark, -1) >= number:
        return False
    files = typed(batch.select("path", "content")).persist()
    try:
        with store.begin() as tx:
            first = files.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in files.columns if c != "sha256"]), "file_path").alias("f"))
            new = first.select("sha256", "f.*").withColumn("batch", F.lit(number).cast("long"))
            if FILES in tx.tables:
                new = new.join(tx.read(FILES).select("sha256"), "sha256", "left_anti")
            bytes_ = batch.select(F.col("path").alias("file_path"), "content").join(new.select("file_path", "sha256"), "file_path").select("sha256", "content")
            tx.append(CONTENTS, bytes_)
            tx.append(FILES, new)
            tx.append(ARRIVALS, files.select("file_path", "sha256", F.lit(number).cast("long").alias("batch")))
            tx.note(mark, number)
    finally:
        files.unpersist()
    return True


def follow(stream: DataFrame, store: Store, checkpoint: str, typed: Callable[[DataFrame], DataFrame]):
    """Takes in all that has landed, then stops. The checkpoint knows which files were seen, the store which batches are in."""
    mark = f"batches of {checkpoint}"
    return stream.writeStream.foreachBatch(lambda batch, number: register(store, batch, number, typed, mark) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
