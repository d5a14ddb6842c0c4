import os
import time

import pytest

from quarry.sources.folders import SCHEMA, Folders, take_up


@pytest.fixture
def tree(spark, tmp_path):
    for name in ("a.txt", "sub/b.md", "sub/deep/c.py", ".hidden/x.txt", "_kept/y.txt", "node_modules/z.js", "cache/CACHEDIR.TAG", "cache/q.txt", "no/n.txt", "no2/m.txt"):
        path = tmp_path / "t" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    os.symlink(tmp_path / "t/a.txt", tmp_path / "t/link.txt")
    spark.dataSource.register(Folders)
    return str(tmp_path / "t")


def listed(spark, tree, **options):
    rows = spark.read.format("folders").options(path=tree, partitions="3", **options).load()
    return {os.path.relpath(r["path"], tree) for r in rows.where("NOT is_dir").collect()}


def test_walk(spark, tree):
    rules = {"exclude": "NODE_*\n*.bak", "excluded_folders": f"{tree}/no"}
    assert listed(spark, tree, **rules) == {"a.txt", "sub/b.md", "sub/deep/c.py", "_kept/y.txt", "no2/m.txt"}
    assert listed(spark, tree, include_subfolders="false") == {"a.txt"}
    assert ".hidden/x.txt" in listed(spark, tree, hidden_files="true")
    # the rules on names hold below the root only
    assert listed(spark, f"{tree}/.hidden") == {"x.txt"} and listed(spark, f"{tree}/cache") == {"CACHEDIR.TAG", "q.txt"}
    assert listed(spark, f"{tree}/no", **rules) == set() and listed(spark, f"{tree}/none") == set()
    data = spark.read.format("folders").options(path=f"{tree}/sub", content="true").load()
    assert {r["name"]: bytes(r["data"]) for r in data.where("data IS NOT NULL").collect()} == {"b.md": b"sub/b.md", "c.py": b"sub/deep/c.py"}


def test_stream_of_changes(spark, tree, tmp_path):
    def poll():
        out = str(tmp_path / f"out{time.time_ns()}")
        stream = spark.readStream.format("folders").schema(SCHEMA).options(path=tree).load()
        query = stream.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c"))
        assert query.trigger(once=True).start().awaitTermination(60)
        return spark.read.parquet(out)

    now = lambda: spark.read.format("folders").options(path=tree).load()
    state = take_up(spark.createDataFrame([], "path string, mtime long, size long"), poll(), now())
    before = {r["path"] for r in state.collect()}
    assert f"{tree}/sub/b.md" in before and f"{tree}/a.txt" in before
    os.remove(f"{tree}/a.txt")
    os.rename(f"{tree}/sub", f"{tree}/moved")
    state = spark.createDataFrame(state.collect(), state.schema)
    after = {r["path"] for r in take_up(state, poll(), now()).collect()}
    assert after == before - {f"{tree}/a.txt", f"{tree}/sub/b.md", f"{tree}/sub/deep/c.py"} | {f"{tree}/moved/b.md", f"{tree}/moved/deep/c.py"}
