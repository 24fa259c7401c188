"""A graph that follows a stream of file versions.

Rows (file_path, language, content, hash) arrive as a stream, with a
``version`` that orders the versions of a file if they have one; a null content
means that the file is gone.  Every micro-batch parses what changed, resolves
all names against the whole graph and saves a new snapshot, so readers see
whole states only, and each equals a scan of the files as they are then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symgrove.plans.iterate import cut
from symgrove.sources.files import apply_changes
from symgrove.sources.store import Store


def apply_batch(store: Store, batch: DataFrame) -> None:
    """Replace the symbols of the batch's files.

    Of several versions of a file in a batch the one with the greatest
    ``version`` counts; of equal ones, or where there is no such column, a
    deletion, then the greatest hash.  Batches apply in the order of the stream.
    """
    version = F.col("version") if "version" in batch.columns else F.lit(0)
    last = Window.partitionBy("file_path").orderBy(version.desc_nulls_last(), F.col("content").isNull().desc(), F.desc("hash"))
    batch = cut(batch.withColumn("n", F.row_number().over(last)).filter("n = 1").select("file_path", "language", "content", "hash"))
    known = store.load_file_hashes()
    new = batch.filter("content IS NOT NULL").join(known.select("file_path", "hash"), ["file_path", "hash"], "left_anti")
    gone = batch.filter("content IS NULL").join(known, "file_path", "left_semi")
    if new.isEmpty() and gone.isEmpty():
        return
    apply_changes(store, new.select("file_path", "language", "content", "hash"), gone)


def follow(files: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream; ``trigger`` is as for DataStreamWriter.trigger."""
    writer = files.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
