"""Weekly posting counts as a stream: an extension beside the batch reports.

Late rows are taken until the watermark passes their week; redelivered postings within it count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: 1970-01-05 was a Monday: windows of seven days begin there.
MONDAY = "4 days"


def weekly_counts(postings: DataFrame, date: str = "collection_date", late: str = "60 days") -> DataFrame:
    """``week_start, postings`` of a stream of postings (or of a batch)."""
    rows = postings.filter(F.col(date).isNotNull()).withColumn("at", F.to_timestamp(date))
    if postings.isStreaming:
        rows = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id"])
    else:
        rows = rows.dropDuplicates(["job_id"])
    return rows.groupBy(F.window("at", "7 days", startTime=MONDAY).alias("w")).agg(F.count(F.lit(1)).alias("postings")).select(F.to_date("w.start").alias("week_start"), "postings")


def stream_postings(spark: SparkSession, folder: str, name: str = "jobs") -> DataFrame:
    """A file stream over the table: its folder, or the single file by name."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(counts: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Run the stream over what is there, into a memory table of that name."""
    q = counts.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
