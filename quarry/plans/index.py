"""The inverted index as ordinary tables: postings, dictionary and field statistics.

A stored index is a base and, for every update since, a change: the files that came, with
their postings, the ids of those that left, and what both add to the dictionary and the
statistics. An update reads the texts of the files it touches only. Readers put the tables
together; ``compact`` writes them as a new base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.text import tokenize

FIELDS = {"name": "name", "dir": "dir_text", "content": "content"}
VERSION = "4"
#: Terms that are grouped at a time, unless one text has more; postings in a batch to Spark.
CHUNK, BATCH = 1 << 20, 1 << 16
#: Order of stored postings.
ORDER = ("term", "field", "file_id")


def _texts(files: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, file_id, terms): a row a field of a file, with its terms in order."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(FIELDS[f]).alias("text")) for f in fields])
    return files.select("file_id", F.explode(each).alias("f")).select("f.field", "file_id", tokenize(F.col("f.text")).alias("terms"))


def tokens(files: DataFrame, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """(field, file_id, len, pos, term): every term of every field; len is the field's number of terms."""
    return _texts(files, fields).withColumn("len", F.size("terms")).select("field", "file_id", "len", F.posexplode("terms").alias("pos", "term"))


def _grouped(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
            yield batch.slice(at, to - at), np.diff(ends[at:to] - before, prepend=0)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lens in (c for batch in batches for c in chunks(batch)):
            known = rows.column("terms").flatten().dictionary_encode()
            if not len(known):
                continue
            row = np.repeat(np.arange(len(lens)), lens)
            key = row * len(known.dictionary) + known.indices.to_numpy()
            # stable: the places of a term stay in order
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            row, code = np.divmod(key[starts], len(known.dictionary))
            tf = np.diff(starts, append=len(key))
            places = (order - np.repeat((np.cumsum(lens) - lens)[row], tf)).astype("int32")
            for a in range(0, len(starts), BATCH):
                b = min(a + BATCH, len(starts))
                own, cuts = pa.array(row[a:b]), np.append(starts[a:b], starts[b] if b < len(starts) else len(key))
                out = {
                    "field": rows.column("field").take(own),
                    "term": known.dictionary.take(pa.array(code[a:b])),
                    "file_id": rows.column("file_id").take(own),
                    "tf": pa.array(tf[a:b].astype("int32")),
                    "len": pa.array(lens[row[a:b]].astype("int32")),
                }
                if "positions" in schema.names:
                    out["positions"] = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype("int32")), pa.array(places[cuts[0] : cuts[-1]]))
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def posted(files: DataFrame, fields: tuple[str, ...] = tuple(FIELDS), positions: bool = True) -> DataFrame:
    """(field, term, file_id, tf, len, positions): the terms of each field of each row, grouped where the row is read: no shuffle."""
    rows = _texts(files, fields)
    kinds = [("field", T.StringType()), ("term", T.StringType()), ("file_id", rows.schema["file_id"].dataType), ("tf", T.IntegerType()), ("len", T.IntegerType())]
    schema = T.StructType([T.StructField(*k) for k in kinds + [("positions", T.ArrayType(T.IntegerType()))] * positions])
    return rows.mapInArrow(_grouped(to_arrow_schema(schema)), schema)


@dataclass
class Index:
    """Lazily derived tables of ``files``, or stored ones (``open_index``)."""

    files: DataFrame
    stored: DataFrame | None = None
    #: (field, term, df) in the order of terms, and (field, n, total) of a stored index.
    stored_dictionary: DataFrame | None = None
    stored_stats: DataFrame | None = None

    @cached_property
    def postings(self) -> DataFrame:
        """(field, term, file_id, tf, len, positions); a group is one term of one file, so it is bounded by a file.

        The field's length stands in each posting, so that a search joins no table of lengths.
        """
        if self.stored is not None:
            return self.stored
        return self._merged(posted(self.files), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))

    def counts(self, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
        """(field, term, file_id, tf, len) without positions."""
        if self.stored is not None:
            return self.stored.where(F.col("field").isin(*fields)).select("field", "term", "file_id", "tf", "len")
        return self._merged(posted(self.files, fields, positions=False))

    @cached_property
    def repeated(self) -> bool:
        """Whether several rows of the files have one id; only then a posting's parts meet in a shuffle."""
        return not self.files.groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def _merged(self, rows: DataFrame, *more: Column) -> DataFrame:
        if not self.repeated:
            return rows
        return rows.groupBy("field", "term", "file_id").agg(F.sum("tf").cast("int").alias("tf"), F.max("len").alias("len"), *more)

    @cached_property
    def dictionary(self) -> DataFrame:
        return self.frequencies(tuple(FIELDS))

    def frequencies(self, fields: tuple[str, ...], terms: set[str] | None = None) -> DataFrame:
        """(field, term, df) of some fields, and of some terms only."""
        wanted = F.lit(True) if terms is None else F.col("term").isin(*terms)
        if self.stored_dictionary is not None:
            return self.stored_dictionary.where(F.col("field").isin(*fields) & wanted)
        return self.counts(fields).where(wanted).groupBy("field", "term").agg(F.count("*").alias("df"))

    @cached_property
    def lengths(self) -> DataFrame:
        """(file_id, field, len), from the files themselves: no shuffle."""
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokenize(F.col(c))).alias("len")) for f, c in FIELDS.items()])
        return self.files.select("file_id", F.explode(each).alias("f")).select("file_id", "f.field", F.col("f.len").cast("long").alias("len"))

    @cached_property
    def stats(self) -> tuple[int, dict[str, int]]:
        """Number of files and terms in each field."""
        found = self.stored_stats
        if found is None:
            found = self.lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("total"))
        rows = found.collect()
        return max((r["n"] for r in rows), default=0), {r["field"]: r["total"] for r in rows}


def _sorted(df: DataFrame, keys: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """Ranged and sorted, so that Parquet skips row groups."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def _totals(spark: SparkSession, n: int, sums: DataFrame) -> DataFrame:
    """(field, n, total) of all fields, from (field, total) of some."""
    fields = spark.range(1).select(F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    return fields.join(F.broadcast(sums), "field", "left").select("field", F.lit(n).cast("long").alias("n"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def _write_segments(index: Index, path: str, partitions: int | None = None) -> None:
    """The postings of an index of files, each task's in the order of terms; ranged over all tasks if their number is given."""
    rows = index.postings
    rows = _sorted(rows, ORDER, partitions) if partitions else rows.sortWithinPartitions(*ORDER)
    rows.write.mode("overwrite").parquet(path)


def _summed(spark: SparkSession, path: str) -> None:
    """Dictionary, statistics and version of a new base, from its written files and postings: texts are analysed once."""
    written = spark.read.parquet(f"{path}/postings")
    # postings are read once: ranges are drawn, and the dictionary and the statistics made, from the sums
    written.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).write.parquet(f"{path}/moved")
    moved = spark.read.parquet(f"{path}/moved")
    _sorted(moved.select("field", "term", "df"), ("field", "term")).write.parquet(f"{path}/dictionary")
    sums = moved.groupBy("field").agg(F.sum("total").alias("total"))
    _totals(spark, spark.read.parquet(f"{path}/files").count(), sums).write.parquet(f"{path}/stats")
    spark.createDataFrame([(VERSION,)], "version string").write.parquet(f"{path}/version")


def write_index(files: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store files and postings as a new index."""
    spark = files.sparkSession
    files.write.parquet(f"{path}/files")
    _write_segments(Index(spark.read.parquet(f"{path}/files")), f"{path}/postings", partitions)
    _summed(spark, path)


def changes(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed changes of a stored index, in order."""
    try:
        return sorted(r["change"] for r in spark.read.schema("change int").parquet(f"{path}/committed").collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def update_index(spark: SparkSession, path: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
    """Put ``rows`` (as in the index's files) in place of the indexed files of equal path, and take out the paths in ``gone``.

    One writer at a time. The change counts once it is committed by its last write.
    """
    known = changes(spark, path)
    number = max(known, default=0) + 1
    base = f"{path}/changes/{number}"
    now = open_index(spark, path).files
    rows.select(*now.columns).dropDuplicates(["path"]).write.mode("overwrite").parquet(f"{base}/files")
    new = spark.read.parquet(f"{base}/files")
    paths = new.select("path") if gone is None else new.select("path").union(gone.select("path")).distinct()
    now.join(paths, "path", "left_semi").write.mode("overwrite").parquet(f"{base}/dead")
    dead = spark.read.parquet(f"{base}/dead")
    _write_segments(Index(new), f"{base}/postings")
    came = spark.read.parquet(f"{base}/postings").select("field", "term", "tf", F.lit(1).alias("sign"))
    left = Index(dead).counts().select("field", "term", "tf", F.lit(-1).alias("sign"))
    both = came.unionByName(left)
    moved = both.groupBy("field", "term").agg(F.sum("sign").alias("df"), F.sum(F.col("sign") * F.col("tf")).alias("total"))
    moved.write.mode("overwrite").parquet(f"{base}/moved")
    moved = spark.read.parquet(f"{base}/moved")
    _sorted(moved.where("df <> 0").select("field", "term", "df"), ("field", "term")).write.mode("overwrite").parquet(f"{base}/dictionary")
    _totals(spark, new.count() - dead.count(), moved.groupBy("field").agg(F.sum("total").alias("total"))).write.mode("overwrite").parquet(f"{base}/stats")
    spark.createDataFrame([(number,)], "change int").coalesce(1).write.mode("append").parquet(f"{path}/committed")


def compact(spark: SparkSession, path: str, target: str, partitions: int | None = None) -> None:
    """Write an index with its changes as a new base in another folder; no text is analysed again."""
    index = open_index(spark, path)
    index.files.write.parquet(f"{target}/files")
    _sorted(index.postings, ORDER, partitions).write.parquet(f"{target}/postings")
    _summed(spark, target)


def move_index(spark: SparkSession, path: str, target: str) -> None:
    """Write an index to another folder, its changes merged, and compare the two; the old one is left to the caller to remove."""
    compact(spark, path, target)
    old, new = open_index(spark, path), open_index(spark, target)
    mark = lambda i: (i.stats, i.files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "mtime", "size"))).first(), i.dictionary.agg(F.sum("df")).first())
    if mark(old) != mark(new):
        raise OSError(f"the index written to {target} differs from that at {path}")


def index_size(spark: SparkSession, path: str) -> int:
    """Bytes of a stored index, changes included."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def file_at(index: Index, path: str) -> DataFrame:
    """The row of an indexed file, if there is one."""
    return index.files.where(F.col("path") == path)


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index with its changes; one of another version must be built anew."""
    found = spark.read.parquet(f"{path}/version").first()["version"]
    if found != VERSION:
        raise ValueError(f"the index has version {found}; build it anew for version {VERSION}")
    numbers = changes(spark, path)
    parts = [(0, path), *((n, f"{path}/changes/{n}") for n in numbers)]
    read = lambda table: [spark.read.parquet(f"{p}/{table}").withColumn("_change", F.lit(n)) for n, p in parts if n or table != "dead"]
    together = lambda tables: reduce(DataFrame.unionByName, tables)
    if not numbers:
        return Index(*[t.drop("_change") for name in ("files", "postings", "dictionary", "stats") for t in read(name)])
    # a file's rows end with the last change that took it out
    dead = together(read("dead")).groupBy("file_id").agg(F.max("_change").alias("_ended"))

    def live(table: str) -> DataFrame:
        rows = together(read(table)).join(dead, "file_id", "left")
        return rows.where(F.col("_ended").isNull() | (F.col("_change") >= F.col("_ended"))).drop("_change", "_ended")

    dictionary = together(read("dictionary")).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
    stats = together(read("stats")).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return Index(live("files"), live("postings"), dictionary, stats)
