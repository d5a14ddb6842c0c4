"""Sharding by rendezvous hashing of stable record keys. Native: no Python workers.

Every shard draws a uniform number for a key from a hash of the two, and the
key goes to the shard with the highest ``-weight / ln(u)``. A shard's draw does
not depend on the other shards, so a new shard only takes keys and none move
among the old ones, and a shard gets keys in proportion to its weight.

Results for odd input: null keys are one key; a null text has no bytes, size 1
and the checksum of no bytes, 0; rows with equal keys go to the same shard and
keep separate slots; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_SHARDS = 16
#: Slices of a shard, by key hash, that slots are numbered in before they are joined up.
SLICES = 1024


def draw(key: Column, shard: int, weight: float, seed: int = 11) -> Column:
    """The shard's bid for a key. ``u`` is one of 2^52 points strictly inside (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(-float(weight)) / F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest bid; the lower number wins a tie."""
    if not weights or min(weights) <= 0:
        raise ValueError("a shard needs a positive weight")
    bids = [F.struct(draw(key, i, w).alias("bid"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return (-(F.greatest(*bids)["i"] if len(bids) > 1 else bids[0]["i"])).cast("int")


def assign(
    docs: DataFrame,
    *,
    key_col: str = "doc_id",
    text_col: str = "text",
    weights: Sequence[float] = (1.0,) * N_SHARDS,
    grown: Sequence[float] | None = None,
    carry: list[Column] | None = None,
) -> DataFrame:
    """Shard, slot and checksum of each record; ``grown`` are the weights with one shard more.

    Slots count from 0 without gaps in each shard, in the order of the key's
    hash. They are numbered in slices, so no task holds a whole shard.
    """
    key, raw = F.col(key_col), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, grown if grown is not None else [*weights, 1.0]).alias("grown_shard"),
        F.xxhash64(key, F.lit(3)).alias("_h"),
        *(carry or []),
    ).withColumn("_slice", F.pmod("_h", F.lit(SLICES)).cast("int"))
    slices = rows.groupBy("shard", "_slice").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = slices.select(F.col("shard").alias("_s"), F.col("_slice").alias("_l"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_slice").orderBy("_h", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1)
    return rows.join(base, (F.col("shard") == F.col("_s")) & (F.col("_slice") == F.col("_l"))).withColumn(
        "slot", (F.col("_base") + F.col("_at")).cast("long")
    ).drop("_s", "_l", "_base", "_at", "_h", "_slice")


def write_shards(docs: DataFrame, path: str, *, key_col: str = "doc_id", weights: Sequence[float] = (1.0,) * N_SHARDS, files: int = 8) -> None:
    """Write ``docs`` as Parquet below ``path/_shard=N``, about ``files`` files a shard."""
    salt = F.pmod(F.xxhash64(F.col(key_col), F.lit(3)), F.lit(files))
    df = docs.withColumn("_shard", shard_of(F.col(key_col), weights))
    df.repartition(len(weights) * files, "_shard", salt).write.partitionBy("_shard").parquet(path)


def op3_rendezvous_sharding(docs: DataFrame) -> DataFrame:
    out = assign(docs)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
