"""New snapshots as a stream: files that arrive are read once and their own rows replaced.

The batch engine has no stream of its own; this lets a folder of exported trees (repository_id,
snapshot_id, path, content as Parquet) feed the same tables.  Each micro-batch is idempotent: it
replaces the rows of the files (snapshot and path) it holds, so a repeated batch changes nothing and a
snapshot may arrive over several batches.  A file that comes twice in a batch is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..extract import frames
from ..sources.store import Store

SCHEMA = "repository_id long, snapshot_id long, commit_sha string, path string, content string"


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start reading ``folder``; with ``once`` what is there now, then stop."""
    keys = ["repository_id", "snapshot_id"]

    def take(batch: DataFrame, _: int) -> None:
        read = frames.read(batch.dropDuplicates(["snapshot_id", "path"])).cache()
        files = read.select("snapshot_id", F.col("path").alias("file_path"))
        store.replace_keys("test_observations", frames.identified(frames.observations(read, keys)), files)
        store.replace_keys("parse_failures", frames.failures(read, [*keys, "commit_sha"]), files)
        read.unpersist()

    writer = spark.readStream.schema(SCHEMA).parquet(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
