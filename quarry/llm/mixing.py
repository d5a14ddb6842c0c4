r"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue that holds its documents in shuffled order, ``epochs``
times over. A document's virtual finish time is the words queued up to its end,
divided by the source's weight. All entries of all queues are range-sorted by
finish time, the sizes of the ranges are summed up, and the mix ends where the
running total reaches the budget. So that a long document cannot carry its source
past the others, the end is set word by word: entries that may straddle it are opened
into packets, which are range-sorted and summed in their turn, and those near the end
into words. A queue that runs dry leaves its pace to the others, so each source gives
its water-filled target but for a word.

The target of a source, a column of the result, is computed apart from that by
water-filling; it decides no document.

Documents are shuffled by a hash of id and text and numbered in slices of a
source, so neither a hot source nor repeated or null ids meet in one task; what
has one row a source (sizes, targets) or a range (running totals) is summed in one.

Results for odd input: a null source is a source of its own and the last one;
null and empty texts have size 0, get no words and never enter the mix; very long
texts are cut like others, at a word; rows with equal id and text are
told apart only by their place in the queue, so either of them may be the one cut;
an empty table gives an empty mix; other columns, whatever their names, are ignored
by ``op1_wfq_mixing`` and passed on by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import count_words, keep

#: Queues are split into this many slices by the leading bits of the shuffle key,
#: so that no task holds a whole source.
SLICES = 4096
EPOCHS = 2
BUDGET_SHARE = 1.5
#: Weights dealt to the sources in order, over and over.
WEIGHTS = (5, 2, 1)
#: Words of the packets that entries near the end of the mix are opened into, level by level.
PACKETS = (256, 1)
#: Least number of ranges of finish time.
RANGES = 64


def _sources(slices: DataFrame, weights: tuple[int, ...], budget_share: float, epochs: int) -> DataFrame:
    """One row a source: size, weight and target by water-filling."""
    sizes = slices.groupBy("_src").agg(F.sum("_sum").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("_src").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick).withColumn("_cap", F.col("source_size") * float(epochs))
    ranked = ranked.withColumn("_dry", F.col("_cap") / F.col("weight"))
    by_dry = Window.orderBy("_dry", F.col("_src").asc_nulls_last())
    before, after = by_dry.rowsBetween(Window.unboundedPreceding, -1), by_dry.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * budget_share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    ranked = ranked.withColumn("_level", level)
    # the water stands at the first level that its own source does not run dry under
    level = F.min(F.when(F.col("_level") <= F.col("_dry"), F.struct("_dry", "_level"))).over(everything)["_level"]
    ranked = ranked.withColumn("_cutoff", F.coalesce(level, F.max("_dry").over(everything), F.lit(0.0)))
    return ranked.select("_src", "source_size", "weight", F.least("_cap", F.col("_cutoff") * F.col("weight")).alias("target"))


def measured(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, size: Column | None, seed: str, carry: list[Column]) -> DataFrame:
    """(doc_id, _src, size, _key, _slice) and ``carry`` of every row."""
    text = F.col(text_col)
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("_src"),
        (count_words(text) if size is None else size).cast("long").alias("size"),
        F.md5(name).alias("_key"),
        *carry,
    )
    return rows.withColumn("_slice", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")).withColumn("_key", F.unhex("_key"))


def queue_plan(rows: DataFrame, weights: tuple[int, ...], budget_share: float, epochs: int) -> DataFrame:
    """One row a slice of a source: the words queued before it, and the source's size, weight and target."""
    slices = rows.groupBy("_src", "_slice").agg(F.sum("size").alias("_sum"))
    sources = _sources(slices, weights, budget_share, epochs)
    along = Window.partitionBy("_src").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0))).select("_src", "_slice", "_before")
    plan = offsets.join(sources, offsets["_src"].eqNullSafe(sources["_src"])).drop(sources["_src"])
    return plan.withColumnRenamed("_src", "_psrc").withColumnRenamed("_slice", "_pslice")


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's columns and ``ahead``, the words queued before each in its source."""
    inside = Window.partitionBy("_src", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
    out = out.join(plan, out["_src"].eqNullSafe(plan["_psrc"]) & (out["_slice"] == plan["_pslice"])).drop("_psrc", "_pslice")
    return out.withColumn("ahead", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_slice")


@dataclass(frozen=True)
class End:
    """The last word of the mix, by finish time and source."""

    finish: float
    source: str | None

    def holds(self, finish: Column, src: Column) -> Column:
        """Whether the mix holds a word."""
        if self.source is None:
            return finish <= self.finish
        return (finish < self.finish) | ((finish == self.finish) & F.coalesce(src <= self.source, F.lit(False)))


def ranged(pieces: DataFrame) -> tuple[DataFrame, list]:
    """``pieces`` in ranges of finish time, and each range's number, words and last finish time, in order."""
    n = max(RANGES, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = keep(pieces.repartitionByRange(n, "finish", "_src").withColumn("_range", F.spark_partition_id()))
    totals = out.groupBy("_range").agg(F.sum("words").alias("words"), F.max("finish").alias("last"))
    return out, sorted(totals.collect(), key=lambda r: r["_range"])


def find_end(queued: DataFrame, budget: int, epochs: int) -> End | None:
    """Where the range-sorted entries of ``queued`` (see ``placed``) reach the budget; None for an empty mix.

    ``after`` and ``upto`` bound a piece in its source's queue, in words.
    """
    if budget < 1:
        return None
    ahead = F.col("epoch") * F.col("source_size") + F.col("ahead")
    turns = queued.where("size > 0").withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    pieces = turns.select("_src", "weight", ahead.alias("after"), (ahead + F.col("size")).alias("upto"))
    for packet in (*PACKETS, 0):
        timed = pieces.withColumn("finish", F.col("upto") / F.col("weight")).withColumn("words", F.col("upto") - F.col("after"))
        pieces, totals = ranged(timed)
        if not packet:
            break
        # at any time each source has at most one piece under way: whole pieces and these bound what has passed
        under_way = pieces.groupBy("_src").agg(F.max("words").alias("m")).agg(F.sum("m")).first()[0]
        done, passed, low, high = 0, 0, -1, float("inf")
        for r in totals:
            done += r["words"]
            if done + under_way <= budget:
                passed, low = done, r["_range"]
            if done >= budget:
                high = r["last"]
                break
        budget -= passed
        near = pieces.where((F.col("_range") > low) & (F.col("after") / F.col("weight") < high))
        start = F.explode(F.sequence("after", F.col("upto") - 1, F.lit(packet).cast("long")))
        near = near.select("_src", "weight", "upto", start.alias("after"))
        pieces = near.withColumn("upto", F.least(F.col("after") + packet, F.col("upto")))
    for r in totals:
        if budget <= r["words"]:
            order = Window.orderBy("finish", F.col("_src").asc_nulls_last())
            last = pieces.where(F.col("_range") == r["_range"]).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == budget).first()
            return End(last["finish"], last["_src"])
        budget -= r["words"]
    raise AssertionError("the budget exceeds the queues")


def taken(end: End | None, epoch: Column) -> Column:
    """Words that the mix takes of a queued row in an epoch."""
    if end is None:
        return F.lit(0).cast("long")
    ahead = epoch * F.col("source_size") + F.col("ahead")
    finish = lambda words: (ahead + words) / F.col("weight")
    # near the end by division; its neighbours are tried too, as divisions are rounded
    about = F.floor(F.lit(end.finish) * F.col("weight") - ahead).cast("long")
    tried = [F.greatest(F.lit(0), F.least(about + i, F.col("size"))) for i in (-1, 0, 1, 2)]
    straddling = F.greatest(F.lit(0).cast("long"), *[F.when(end.holds(finish(n), F.col("_src")), n) for n in tried])
    return F.when(end.holds(finish(F.col("size")), F.col("_src")), F.col("size")).otherwise(straddling).cast("long")


def allocate(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    epochs: int = EPOCHS,
    seed: str = "mix",
    carry: list[Column] | None = None,
) -> tuple[DataFrame, End | None]:
    """Queued rows (doc_id, _src, size, source_size, weight, target, ahead and ``carry``) and the end of the mix.

    The documents are measured once, without ``carry``; with it they are read once more.
    """
    options = {"id_col": id_col, "text_col": text_col, "source_col": source_col, "size": size, "seed": seed}
    rows = keep(measured(docs, carry=[], **options))
    plan = keep(queue_plan(rows, weights, budget_share, epochs))
    queued = keep(placed(rows, plan))
    total = rows.agg(F.sum("size")).first()[0] or 0
    end = find_end(queued, min(int(total * budget_share), total * epochs), epochs)
    return (placed(measured(docs, carry=carry, **options), plan) if carry else queued), end


def mix(docs: DataFrame, *, text_col: str = "text", epochs: int = EPOCHS, **options) -> DataFrame:
    """The documents of the mix in mix order, with the columns of ``docs``.

    A document of a second epoch appears again; the text of a document that
    straddles the end of the mix ends after its last word inside it.
    """
    names = docs.columns
    carry = [F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")]
    queued, end = allocate(docs, text_col=text_col, epochs=epochs, carry=carry, **options)
    turns = queued.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs))))).withColumn("take", taken(end, F.col("epoch"))).where("take > 0")
    turns = turns.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("ahead") + F.col("size")) / F.col("weight"))
    out = turns.repartitionByRange(F.col("finish"), F.col("_key")).sortWithinPartitions("finish", "_key", "epoch")
    text = F.col("_row")[text_col]
    # pieces that each begin with a word; the blanks before the first word are a piece of their own
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.rtrim(F.concat_ws("", F.slice(pieces, 1, (F.col("take") + lead).cast("int"))))
    text = F.when(F.col("take") < F.col("size"), cut).otherwise(text)
    return out.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names])


def op1_wfq_mixing(docs: DataFrame) -> DataFrame:
    """The digest of the mix: words taken of each document, repeats counted; 0 for those it leaves out."""
    queued, end = allocate(docs)
    words = sum((taken(end, F.lit(e)) for e in range(1, EPOCHS)), taken(end, F.lit(0)))
    return queued.select("doc_id", "size", "source_size", "target", words.alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS dry FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
   - coalesce(sum(cap) OVER (ORDER BY dry, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY dry, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
s4 AS (SELECT source, source_size, weight, least(cap, weight * (SELECT arg_min(lvl, dry) FROM s3 WHERE lvl <= dry)) AS target FROM s3),
q AS (SELECT d.*, source_size, weight, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
   ROWS UNBOUNDED PRECEDING) - size AS ahead FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
e AS (SELECT r, source, weight, size, ahead + epoch * source_size AS ahead FROM q, (VALUES (0), (1)) AS t(epoch) WHERE size > 0),
p0 AS (SELECT *, unnest(range(1, size + 1)) AS j FROM e),
p AS (SELECT r, row_number() OVER (ORDER BY (ahead + j)::DOUBLE / weight, source NULLS LAST) AS nth FROM p0),
t AS (SELECT r, count(*) AS taken FROM p WHERE nth <= (SELECT floor(sum(size) * 1.5::DOUBLE) FROM d) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN t USING (r)
"""
