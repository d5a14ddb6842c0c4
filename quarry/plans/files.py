"""The files table: one row a path, derived here from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.categories import category_of
from quarry.functions.text import MAX_TOKEN_BYTES, fold, tokenize

#: Extensions dealt to documents in turn; the last four of NAME_ONLY hold no text.
EXTS = "txt md html pdf docx csv pptx jpg mp3 zip py bin".split()
NAME_ONLY = ("jpg", "mp3", "zip", "bin")
FAILURES = ("encrypted", "timed-out", "crashed", "unreadable")
EPOCH = 1704067200


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_id, ext, parent, name, path, dir_text, content, mtime, size, status, failure, category."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % 12 + 1).cast("int"))
    failed = (F.col("doc_id") % 37 == 0) & ~F.col("ext").isin(*NAME_ONLY)
    # the first term; the rest of the text is analysed only where the first piece is too long for one
    first = F.regexp_extract("text", r"[\p{IsAlphabetic}\p{N}]+", 0)
    word = F.when(F.octet_length(first) < MAX_TOKEN_BYTES, F.nullif(fold(first), F.lit(""))).otherwise(F.get(tokenize(F.col("text")), 0))
    out = d.select(F.col("doc_id").alias("file_id"), "doc_id", "text", "source", "lang", ext.alias("ext"))
    out = out.withColumn("parent", F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang"))
    out = out.withColumn("name", F.concat(F.coalesce(word, F.lit("empty")), F.lit("-"), "doc_id", F.lit("."), "ext"))
    out = out.withColumn("status", F.when(failed, "failed"))
    why = F.element_at(F.array(*map(F.lit, FAILURES)), (F.expr("doc_id div 37") % 4 + 1).cast("int"))
    return out.select(
        "file_id",
        "ext",
        "parent",
        "name",
        F.concat("parent", F.lit("/"), "name").alias("path"),
        F.concat(F.lit("lib "), "source", F.lit("/"), "lang").alias("dir_text"),
        F.when(~F.col("ext").isin(*NAME_ONLY) & F.col("status").isNull(), F.col("text")).alias("content"),
        (F.lit(EPOCH) + F.col("doc_id") * 3600).cast("long").alias("mtime"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"),
        "status",
        F.when(F.col("status").isNotNull(), why).alias("failure"),
        category_of(F.col("ext")).alias("category"),
    )
