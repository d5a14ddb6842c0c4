import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.plans import index as module
from quarry.plans.index import Index, compact, open_index, posted, tokens, update_index, write_index

FILES = "file_id long, name string, dir_text string, content string"


def plain(files):
    """Postings as grouped by Spark, from a row a term."""
    grouped = tokens(files).groupBy("field", "term", "file_id")
    return grouped.agg(F.count("*").cast("int").alias("tf"), F.max("len").alias("len"), F.sort_array(F.collect_list("pos")).alias("positions"))


def texts(spark, ids):
    draw = random.Random(7)
    words = [None, "", "Ünder under UNDER", "tick tick tock", "日本語、テスト", *(" ".join(draw.choices(["a", "b", "Straße", "ab-ab"], k=40)) for _ in range(20))]
    return spark.createDataFrame([(i, f"n{i}.txt", "lib src/en", words[k % len(words)]) for k, i in enumerate(ids)], FILES)


def rows(df):
    return sorted(map(tuple, df.select("field", "term", "file_id", "tf", "len", "positions").collect()), key=repr)


@pytest.mark.parametrize("ids", [range(60), [1, 2, 2, 2, None, None, 3]])
def test_postings_equal_plain_grouping(spark, ids):
    df = texts(spark, list(ids)).repartition(3)
    index = Index(df)
    assert rows(index.postings) == rows(plain(df))
    assert sorted(map(tuple, index.dictionary.collect())) == sorted(map(tuple, plain(df).groupBy("field", "term").count().collect()))


def test_postings_are_grouped_without_a_shuffle(spark, tmp_path):
    index = Index(texts(spark, range(60)))
    for made in (index.postings, index.counts()):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    write_index(index.files, str(tmp_path / "i"))
    stored = open_index(spark, str(tmp_path / "i"))
    assert rows(stored.postings) == rows(index.postings)
    for file in stored.postings.inputFiles():
        kept = [(r["term"], r["field"], r["file_id"]) for r in spark.read.parquet(file).coalesce(1).collect()]
        assert kept == sorted(kept)


def test_postings_of_many_chunks(spark, monkeypatch):
    df = texts(spark, range(60))
    schema = module.to_arrow_schema(posted(df).schema)
    data = module._texts(df, ("name", "dir", "content")).toArrow().combine_chunks().to_batches()
    whole = pa.Table.from_batches(module._grouped(schema)(iter(data))).to_pylist()
    monkeypatch.setattr(module, "CHUNK", 50)
    monkeypatch.setattr(module, "BATCH", 3)
    parts = list(module._grouped(schema)(iter([b.slice(1) for b in data] + [b.slice(0, 1) for b in data])))
    key = lambda r: repr(sorted(r.items()))
    assert sorted(pa.Table.from_batches(parts).to_pylist(), key=key) == sorted(whole, key=key) and max(len(p) for p in parts) == 3


def test_sums_of_a_base_are_made_in_one_pass(spark, tmp_path):
    old, new = (texts(spark, ids).withColumn("path", F.col("name")) for ids in (range(60), range(30, 70)))
    write_index(old, str(tmp_path / "i"))
    update_index(spark, str(tmp_path / "i"), new.where("file_id >= 45"), old.where("file_id < 10").select("path"))
    compact(spark, str(tmp_path / "i"), str(tmp_path / "c"))
    for base in ("i", "c"):
        found, files = open_index(spark, str(tmp_path / base)), old.where("file_id BETWEEN 10 AND 44").unionByName(new.where("file_id >= 45"))
        assert rows(found.postings) == rows(plain(files)) and found.stats == Index(files).stats
        assert sorted(map(tuple, found.dictionary.collect())) == sorted(map(tuple, plain(files).groupBy("field", "term").count().collect()))
        assert spark.read.parquet(str(tmp_path / base / "moved")).columns == ["field", "term", "df", "total"]
