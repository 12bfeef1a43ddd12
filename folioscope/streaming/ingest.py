"""Shards taken in as they arrive: the stream's checkpoint stands in for completion markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.functions import text
from folioscope.schema import PAPER


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of canonical records from NDJSON files that appear below a folder."""
    return spark.readStream.schema(PAPER).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").json(folder)


def identified(records: DataFrame) -> DataFrame:
    """With record_id and the time of arrival."""
    sig = text.signature(F.col("title"), F.col("year"), F.col("journal_raw"))
    return records.withColumns({"record_id": text.record_id(F.col("doi"), F.col("pmid"), sig), "arrived_at": F.coalesce(F.try_to_timestamp("harvest_ts"), F.current_timestamp())})


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """Takes in what is there and stops; the next call goes on from there. A record is written once, however late it comes.

    Each batch is compared with what is written already, by record_id and source. A batch has a folder of its own below
    `out`, which a repeated batch replaces; it is named by the checkpoint's id, so another checkpoint replaces nothing.
    A folder that the file sink of earlier versions wrote can't be `out` again, nor its checkpoint. `late` bounds nothing any more; it stays for callers that pass it.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = batch.dropDuplicates(["record_id", "source"])
        session = batch.sparkSession
        name = f"batch={session.read.json(f'{checkpoint}/metadata').first()['id']}_{number}"
        root = session._jvm.org.apache.hadoop.fs.Path(out)
        files = root.getFileSystem(session._jsc.hadoopConfiguration())
        if files.exists(root):
            # without the batch's own folder: a run that broke off may have left it
            there = [s.getPath() for s in files.listStatus(root) if s.getPath().getName() != name]
            folders = [p.toString() for p in there if not p.getName().startswith(("_", "."))]
            if folders:
                written = session.read.schema("record_id string, source string").parquet(*folders)
                own = own.join(written.withColumnRenamed("record_id", "_id").withColumnRenamed("source", "_source"), (F.col("record_id") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")), "left_anti")
        own.write.mode("overwrite").parquet(f"{out}/{name}")

    return identified(arriving(spark, folder)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_by_window(records: DataFrame, window: str = "1 hour", late: str = "2 hours", time: str = "arrived_at", source: str = "source") -> DataFrame:
    """(window_start, source, n): counts of a stream or a table by tumbling windows; later records than `late` are left out of a stream."""
    return records.withWatermark(time, late).groupBy(F.window(time, window), source).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), source, "n")
