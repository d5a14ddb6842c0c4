"""A stream of path changes into a table of current files: the last change of a path wins.

The state is dealt to buckets by a hash of the path. A micro-batch rewrites the buckets that its
changes touch and no others; a manifest of each batch says which batch holds the current rows of each
bucket. What the manifests of the last two batches do not name is removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new state; a table keeps the number it began with.
BUCKETS = 64


def coalesced(changes: DataFrame) -> DataFrame:
    """The last change of each path: (path, op, ts, seq)."""
    last = changes.groupBy("path").agg(F.max(F.struct("ts", "seq", "op")).alias("c"))
    return last.select("path", "c.op", "c.ts", "c.seq")


def from_events(events: DataFrame) -> DataFrame:
    """events as a change log: one file a user, errors delete it."""
    return events.select(
        F.concat(F.lit("/lib/user"), "user_id", F.lit(".txt")).alias("path"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def apply_batch(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state (path, op, ts, seq) after a micro-batch. Deletions stay in it, so that an older change that comes late
    does not bring a file back; ``alive`` leaves them out."""
    return coalesced(changes.select("path", "op", "ts", "seq").unionByName(state.select("path", "op", "ts", "seq")))


def alive(state: DataFrame) -> DataFrame:
    """(path, ts, seq) of the files that exist."""
    return state.where("op = 'upsert'").select("path", "ts", "seq")


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def manifests(spark: SparkSession, table_path: str) -> dict[int, dict[int, int]]:
    """For each batch that is kept, the batch that holds each bucket; a row a bucket and batch."""
    try:
        rows = spark.read.schema("bucket int, held long, epoch long").parquet(f"{table_path}/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["epoch"], {})[r["bucket"]] = r["held"]
    return out


def _part(table_path: str, bucket: int, held: int) -> str:
    return f"{table_path}/data/epoch={held}/bucket={bucket}"


def current(spark: SparkSession, table_path: str) -> DataFrame:
    """The state (path, op, ts, seq) after the last batch."""
    known = manifests(spark, table_path)
    held = known[max(known)] if known else {}
    if not held:
        return spark.createDataFrame([], "path string, op string, ts timestamp_ntz, seq long")
    return spark.read.parquet(*[_part(table_path, b, e) for b, e in sorted(held.items())]).select("path", "op", "ts", "seq")


def _remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def take_batch(batch: DataFrame, epoch: int, table_path: str, buckets: int = BUCKETS) -> None:
    """Take up a micro-batch; a batch that is run again overwrites what its first run wrote."""
    spark = batch.sparkSession
    known = {e: m for e, m in manifests(spark, table_path).items() if e < epoch}
    before = known[max(known)] if known else {}
    news = coalesced(batch).withColumn("bucket", bucket_of(F.col("path"), buckets)).persist()
    try:
        touched = sorted(r["bucket"] for r in news.select("bucket").distinct().collect())
        if not touched:
            return
        old = [spark.read.schema(batch.select("path", "op", "ts", "seq").schema).parquet(_part(table_path, b, before[b])).withColumn("bucket", F.lit(b)) for b in touched if b in before]
        # dealt by bucket once: the same exchange serves the last changes and the files to write
        both = reduce(DataFrame.unionByName, old, news).repartition("bucket")
        last = both.groupBy("bucket", "path").agg(F.max(F.struct("ts", "seq", "op")).alias("c"))
        last.select("bucket", "path", "c.op", "c.ts", "c.seq").write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/data/epoch={epoch}")
    finally:
        news.unpersist()
    now = before | {b: epoch for b in touched}
    rows = spark.createDataFrame([(b, e) for b, e in now.items()], "bucket int, held long").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{table_path}/manifest/epoch={epoch}")
    for past in sorted(known)[:-1]:
        for b, e in known[past].items():
            if before.get(b) != e and now[b] != e:
                _remove(spark, _part(table_path, b, e))
        _remove(spark, f"{table_path}/manifest/epoch={past}")


def maintain(stream: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS):
    """Start a query that keeps the state below ``table_path`` (``current`` reads it).

    ``trigger`` is the pace, as in ``DataStreamWriter.trigger``: {"processingTime": "2 seconds"} takes up together what comes within
    two seconds; by default what is there is taken up and the query ends. The source's options (as maxFilesPerTrigger) bound a batch.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: take_batch(batch, epoch, table_path, buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
