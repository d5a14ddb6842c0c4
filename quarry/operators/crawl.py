"""A crawl into the stored index: list, compare, read and extract what changed, update."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.categories import category_of
from quarry.operators.sync import changed, deleted
from quarry.plans.index import open_index, update_index, write_index
from quarry.sources.decode import extract
from quarry.sources.folders import SCHEMA, Folders, bytes_of
from quarry.sources.formats import BY_EXTENSION, classified, extension, most_bytes

FILES = (
    "file_id long, ext string, parent string, name string, path string, dir_text string, content string, mtime long, size long, "
    "status string, failure string, category string"
)


def listing(spark: SparkSession, root: str, **options) -> DataFrame:
    """All files and folders below a root, without their bytes."""
    spark.dataSource.register(Folders)
    return spark.read.format("folders").schema(SCHEMA).options(path=root, **options).load()


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("failure", T.StringType()), T.StructField("barred", T.BooleanType())]))
def read_text(path: pd.Series, size: pd.Series) -> pd.DataFrame:
    """Text of files of known kinds and sizes within their kind's limit; others have their name only."""
    out = []
    for p, n in zip(path, size):
        ext = extension(p.rsplit("/", 1)[-1])
        kind = BY_EXTENSION.get(ext)
        if kind is None or n > most_bytes(kind):
            out.append((None, None, False))
            continue
        data, status = bytes_of(p, most_bytes(kind))
        out.append((None, None, True) if status else (*extract(ext, data), False))
    return pd.DataFrame(out, columns=["text", "failure", "barred"])


def file_rows(found: DataFrame, root: str, known: DataFrame) -> DataFrame:
    """Rows of the index's files for listed ones: a path that is ``known`` keeps its id, others get ids above all known.

    A file that can't be read at the moment is left out, so that its indexed row stays.
    """
    rows = found.where("NOT is_dir AND status IS NULL").select("path", "parent", "name", "mtime", "size").join(known.select("path", "file_id"), "path", "left")
    first = known.agg(F.coalesce(F.max("file_id"), F.lit(-1)) + 1).first()[0]
    ext = F.lower(F.regexp_extract("name", r"^.+\.([^.]*)$", 1))
    rows = rows.withColumn("_x", read_text("path", "size")).where("NOT _x.barred").withColumn("ext", ext)
    return rows.select(
        F.coalesce("file_id", F.lit(first) + F.monotonically_increasing_id()).alias("file_id"),
        "ext",
        "parent",
        "name",
        "path",
        F.regexp_replace(F.substr("parent", F.lit(len(root.rstrip("/").rpartition("/")[0]) + 2)), "/", " / ").alias("dir_text"),
        F.col("_x.text").alias("content"),
        "mtime",
        "size",
        F.when(F.col("_x.failure").isNotNull(), "failed").alias("status"),
        F.col("_x.failure").alias("failure"),
        category_of(F.col("ext")).alias("category"),
    )


def crawl(spark: SparkSession, root: str, path: str, chunk: int | None = None, stop: Callable[[], bool] | None = None, progress: Callable[[int, int], None] | None = None, **options) -> bool:
    """Bring the index at ``path`` to the state of the folder ``root``; only new and changed files are read.

    A root that is not there may be offline: the index stays as it is. With ``chunk``, about so many files make an update
    of their own, and ``progress`` hears (files done, files to do) after each. ``stop`` is asked before each: if it says yes, what
    was committed stays and deletions wait for the next crawl. True if the crawl came to its end.
    """
    now = listing(spark, root, **options)
    if now.where(F.col("path") == (root.rstrip("/") or "/")).isEmpty():
        return True
    try:
        index = open_index(spark, path).files
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        write_index(spark.createDataFrame([], FILES), path)
        index = open_index(spark, path).files
    new = changed(now, index.select("path", "mtime", "size"))
    gone = deleted(now.where("NOT is_dir OR status IS NOT NULL"), index)
    stop = stop or (lambda: False)
    if chunk is None and progress is None:
        if stop():
            return False
        update_index(spark, path, file_rows(new, root, index), gone)
        return True
    todo = new.where("NOT is_dir AND status IS NULL").count()
    parts, done = max(-(-todo // (chunk or max(todo, 1))), 1), 0
    for i in range(parts):
        if stop():
            return False
        # the last part takes the deletions along; later parts see the ids that earlier ones gave
        some = new.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == i)
        update_index(spark, path, file_rows(some, root, open_index(spark, path).files), gone if i == parts - 1 else None)
        if progress:
            done = todo if i == parts - 1 else done + some.where("NOT is_dir AND status IS NULL").count()
            progress(done, todo)
    return True


def watch(spark: SparkSession, root: str, path: str, checkpoint: str, trigger: dict | None = None, rescan: float = 1800, chunk: int | None = None, stop: Callable[[], bool] | None = None, **options):
    """Keep the index at ``path`` up to date with ``root``: a streaming query that polls the folder.

    ``trigger`` sets the pace (by default every two seconds): all changes of an interval are taken up together. A
    batch tells that something changed; the crawl it starts compares listing and index, so a repeated or late batch does no harm.
    After ``rescan`` seconds without one, a crawl looks for what polls can't show. ``chunk`` and ``stop`` are those of ``crawl``;
    a crawl that was stopped is taken up again by the next batch.
    """
    spark.dataSource.register(Folders)
    polls = spark.readStream.format("folders").schema(SCHEMA).options(path=root, **options).load()
    due = [time.monotonic() + rescan]

    def step(batch: DataFrame, epoch: int) -> None:
        if time.monotonic() >= due[0] or not batch.isEmpty():
            ended = crawl(batch.sparkSession, root, path, chunk, stop, **options)
            due[0] = time.monotonic() + (rescan if ended else 0)

    writer = polls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


@F.pandas_udf(T.StructType([T.StructField("chars", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("failed", T.BooleanType())]))
def timed_text(path: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """Characters of a file's text, and what it took to read and extract it."""
    out = []
    for p, k in zip(path, kind):
        began = time.perf_counter()
        data, status = bytes_of(p, most_bytes(k))
        text, failure = (None, status) if status else extract(extension(p.rsplit("/", 1)[-1]), data)
        out.append((len(text or ""), time.perf_counter() - began, failure is not None))
    return pd.DataFrame(out, columns=["chars", "seconds", "failed"])


def extraction_stats(spark: SparkSession, root: str, **options) -> DataFrame:
    """For each kind of file below a root: files, failed, seconds in all and a file, bytes, characters of text. Nothing is indexed."""
    known = classified(listing(spark, root, **options).where("NOT is_dir AND status IS NULL")).where("kind IS NOT NULL")
    rows = known.select("kind", "size", timed_text("path", "kind").alias("x"))
    sums = [F.count("*").alias("files"), F.count_if("x.failed").alias("failed"), F.sum("x.seconds").alias("seconds"), F.avg("x.seconds").alias("seconds_a_file")]
    return rows.groupBy("kind").agg(*sums, F.sum("size").alias("bytes"), F.sum("x.chars").alias("chars"))
