"""Snapshot comparison: what a crawl changes in the index, and how the index takes it up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import above, under


def changed(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """Listed files that are new or differ in (mtime, size)."""
    known = indexed.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    same = F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))
    out = listing.join(known, "path", "left").where(~same)
    return out.withColumn("change", F.when(F.col("_mtime").isNull(), "new").otherwise("changed")).drop("_mtime", "_size")


def unreadable(listing: DataFrame) -> DataFrame:
    """(barred): files and folders of a listing that could not be read."""
    return listing.where(F.col("status").isNotNull()).select(F.col("path").alias("barred")).distinct()


def kept_back(gone: DataFrame, barred: DataFrame) -> DataFrame:
    """``gone`` without what could not be read and what lies below it."""
    held = gone.select("path", F.explode(F.concat(above(F.col("path")), F.array("path"))).alias("barred")).join(barred, "barred", "left_semi")
    return gone.join(held.select("path").distinct(), "path", "left_anti")


def deleted(listing: DataFrame, indexed: DataFrame, offline_roots: tuple[str, ...] = ()) -> DataFrame:
    """Indexed files that are no longer listed; those below roots that can't be reached stay, and what a listing with ``status`` could not read."""
    out = indexed
    for root in offline_roots:
        out = out.where(~under(F.col("path"), root))
    out = out.join(listing.select("path"), "path", "left_anti")
    return kept_back(out, unreadable(listing)) if "status" in listing.columns else out


def first_root(paths: DataFrame, roots: list[tuple[str, bool]]) -> DataFrame:
    """``paths`` with the first root, in library order, that covers each; null if none does."""
    out = None
    for root, deep in roots:
        inside = under(F.col("path"), root) if deep else (F.regexp_extract("path", r"^(.*)/[^/]*$", 1) == root.rstrip("/"))
        out = F.when(inside, F.lit(root)) if out is None else out.when(inside, F.lit(root))
    return paths.withColumn("root", F.lit(None).cast("string") if out is None else out)


def folder_counts(files: DataFrame, roots: list[tuple[str, bool]]) -> DataFrame:
    """Files below each root; a file below several roots counts in each."""
    counts = [F.count_if(under(F.col("path"), r) if deep else F.col("parent") == r.rstrip("/")).alias(f"c{i}") for i, (r, deep) in enumerate(roots)]
    rows = F.array(*[F.struct(F.lit(r).alias("root"), F.col(f"c{i}").alias("files")) for i, (r, _) in enumerate(roots)])
    return files.agg(*counts).select(F.explode(rows).alias("r")).select("r.root", "r.files")


def total_files(files: DataFrame, roots: list[tuple[str, bool]]) -> DataFrame:
    """(files): the sum over all roots; a file below several roots counts in each."""
    return folder_counts(files, roots).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def upsert(indexed: DataFrame, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index after ``rows`` replace those of equal path and the paths in ``gone`` leave."""
    out = indexed.join(rows.select("path"), "path", "left_anti")
    if gone is not None:
        out = out.join(gone.select("path"), "path", "left_anti")
    return out.unionByName(rows, allowMissingColumns=True)


def delete_under(indexed: DataFrame, folder: str) -> DataFrame:
    return indexed.where(~under(F.col("path"), folder))
