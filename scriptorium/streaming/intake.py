"""Incremental intake: a stream of documents against a store of accepted ones, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.operators.dedupe import acceptance

ARRIVAL = ("doc_id", "created_at", "content_hash", "document_type", "title", "relevant")


def take_in(batch: DataFrame, number: int, store: str, statuses: str) -> None:
    """One micro-batch: statuses against the store, then the accepted rows are added to it.

    Both are written under the batch's number, so a batch that runs again after a failure overwrites its own rows and the
    result is the same: the store that it reads holds only earlier batches.
    """
    spark = batch.sparkSession
    known = None
    if number:
        known = spark.read.schema(batch.schema).parquet(*[f"{store}/batch={i}" for i in range(number)])
    found = acceptance(batch, known).withColumn("batch", F.lit(number))
    found.write.mode("overwrite").parquet(f"{statuses}/batch={number}")
    accepted = spark.read.parquet(f"{statuses}/batch={number}").where("status = 'inserted'").select("doc_id")
    batch.join(accepted, "doc_id", "left_semi").select(*batch.columns).write.mode("overwrite").parquet(f"{store}/batch={number}")


def run(spark: SparkSession, folder: str, schema: StructType, home: str, files_per_batch: int = 1_000_000) -> DataFrame:
    """doc_id, status, batch of all documents that have come into the folder so far; those new since the last run under `home` are taken in, then the stream ends.

    The schedule is the caller's. A micro-batch holds at most files_per_batch files, in order of file time.
    """
    store, statuses = f"{home}/store", f"{home}/statuses"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = stream.writeStream.foreachBatch(lambda df, n: take_in(df, n, store, statuses)).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(statuses).select("doc_id", "status", "batch")
