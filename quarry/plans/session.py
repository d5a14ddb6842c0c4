"""The index that the searches of one session share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.files import files
from quarry.plans.index import Index, open_index, write_index

#: (application, input folder, state of the input) to the folder of its index.
_BUILT: dict[tuple[str, str, str], str] = {}


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew only where a plain scan has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def state(spark: SparkSession, path: str) -> str:
    """Changes with the names, sizes and times of the input's files; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = F.xxhash64("path", "length", "modificationTime")
    found = listed.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.bit_xor(own).alias("mark")).first()
    return f"{found['files']}-{found['bytes']}-{found['mark']}"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share. Where none is set, a local session gets one of its own; a cluster must name one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/quarry/{spark.sparkContext.applicationId}"


def session_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of ``documents`` as files: written by the first search over them in their
    present state, opened by later ones. It lies in the shared folder and goes with it."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        write_index(spread(files(spark, sf_dir)), path)
        _BUILT[key] = path
    return open_index(spark, _BUILT[key])
