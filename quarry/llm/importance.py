r"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-grams models share one hashed feature space: the raw model counts
the unigrams and bigrams of all documents, the target model those of labelled
good documents (quality 1, not toxic). A document's log weight is the sum over its
n-grams of log p_target - log p_raw. Gumbel noise, a function of the row and a
seed, is added, and the k highest keys are the sample: a draw without
replacement by importance. k is a share of the corpus, by default the share of
quality 1 among the labels.

The raw counts, weights and the k-th key cover every row. The target model is
fitted on at most ``max_labelled`` labelled rows, chosen by a hash. The driver
gets bucket counts (``buckets`` rows) and digit counts of keys (65,536 rows) only.

Results for odd input: null and empty texts weigh 0; labels that are null or of no
document are ignored; with no usable labels the target is the raw model, all weights
are 0, and all rows are kept; rows with equal keys (repeated rows) are kept or left
together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, keep, map_arrow, text_pair
from quarry.llm.dartminhash import WORDS, mix64

BUCKETS = 10_000
MAX_LABELLED = 20_000
SMOOTHING = 1.0


def grams(text: bytes, buckets: int) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams."""
    words = text.split()
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    both = np.concatenate([mix64(h), mix64(h[:-1] * np.uint64(3) ^ mix64(h[1:]))]) if len(h) else h
    return (both % np.uint64(buckets)).astype(np.int64)


def _bytes(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, buckets: int, max_labelled: int) -> tuple[np.ndarray, float]:
    """log p_target - log p_raw for each bucket, and the share of quality 1 among the labels."""
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))
    chosen = (
        usable.where(good).select(F.col("doc_id").alias("_label")).distinct().orderBy(F.xxhash64("_label"), "_label").limit(max_labelled)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_label"), "left").select("text", F.col("_label").isNotNull().alias("target"))

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
                n = np.bincount(grams(_bytes(text), buckets), minlength=buckets)
                raw += n
                if good:
                    target += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in sums.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    share = usable.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    if not target.sum():
        return np.zeros(buckets), 1.0
    p = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * buckets))
    return p(target) - p(raw), 1.0 if share is None else share


def gumbel(seed: int, *cols: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def _code(x: float) -> int:
    """A 64-bit number that orders as the double does."""
    bits = struct.unpack(">q", struct.pack(">d", x + 0.0))[0]
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def kth_largest(scored: DataFrame, code: str, k: int) -> int | None:
    """The k-th largest value of a long column, by four counts of 16-bit digits."""
    left, prefix = k, None
    for level in range(4):
        shift = 48 - 16 * level
        within = scored if prefix is None else scored.where(F.shiftright(code, shift + 16) == prefix)
        counts = within.groupBy(F.shiftright(code, shift).alias("p")).agg(F.count("*").alias("n")).collect()
        for p, n in sorted(((r["p"], r["n"]) for r in counts), reverse=True):
            if n >= left:
                prefix = p
                break
            left -= n
        else:
            return None
    return prefix


def select(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_share: float | None = None,
    buckets: int = BUCKETS,
    max_labelled: int = MAX_LABELLED,
    seed: int = 13,
) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept) of every row."""
    ratio, share = fit(docs, labels, id_col=id_col, text_col=text_col, buckets=buckets, max_labelled=max_labelled)
    share = share if keep_share is None else keep_share

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grams(_bytes(t), buckets) for t in batch.column(1)]
        weights = np.array([float(ratio[g].sum()) for g in found])
        codes = [_code(w + z) for w, z in zip(weights, batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(weights), pa.array(weights + batch.column(2).to_numpy()), pa.array(codes, pa.int64())],
            names=["doc_id", "n_grams", "log_weight", "key", "code"],
        )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), gumbel(seed, F.col(id_col), *text_pair(F.col(text_col))).alias("noise"))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = keep(map_arrow(rows, work, f"doc_id {kind}, n_grams long, log_weight double, key double, code long"))
    k = round(share * scored.count())
    least = kth_largest(scored, "code", k) if k else None
    verdict = F.lit(False) if least is None else F.col("code") >= least
    return scored.select("doc_id", "n_grams", "log_weight", "key", verdict.alias("kept"))


def op9_importance_resampling(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return select(docs, labels)
