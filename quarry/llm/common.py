"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the whitespace contracts: space and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: A word of those contracts, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"

#: Bounds of one Arrow batch that a Python worker receives.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, a local session (tests) gets one of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` for a function from a batch to a batch; batches are bounded."""
    bound_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(each, schema)


def words_array(text: Column) -> Column:
    """The words of a text; an empty array for null and for texts without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_pair(text: Column) -> tuple[Column, Column]:
    """A 128-bit identity of a whole text, as two numbers; null and empty texts share one."""
    value = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(7), value), F.xxhash64(F.lit(1 << 40), value)


def text_node(docs: DataFrame, text: Column) -> Column:
    """A number for each distinct text of ``docs``: its first 64 bits, or where two texts share these, a hash of all 128.

    Of n texts about n^2 / 2^65 share them (some hundreds of 10^11), so the driver gets few.
    """
    one, two = text_pair(text)
    marks = docs.select(one.alias("one"), two.alias("two")).groupBy("one").agg(F.min("two").alias("low"), F.max("two").alias("high"))
    shared = [r["one"] for r in marks.where("low <> high").select("one").collect()]
    return F.when(one.isin(*shared), F.xxhash64(F.lit(3), one, two)).otherwise(one) if shared else one
