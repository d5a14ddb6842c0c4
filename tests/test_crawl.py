import os

from quarry.operators.crawl import crawl, extraction_stats, watch
from quarry.operators.search import Request, search
from quarry.plans.index import Index, compact, file_at, index_size, move_index, open_index


def put(root, **files):
    for name, text in files.items():
        (root / f"{name}.txt").parent.mkdir(parents=True, exist_ok=True)
        (root / f"{name}.txt").write_text(text)


def state(index):
    rows = index.postings.join(index.files.select("file_id", "path"), "file_id").select("path", "field", "term", "tf", "len").collect()
    words = {(r["field"], r["term"]): r["df"] for r in index.dictionary.collect()}
    return sorted(map(tuple, rows)), words, index.stats


def test_an_updated_index_equals_one_built_anew(spark, tmp_path):
    root, path = tmp_path / "home" / "notes", str(tmp_path / "i")
    put(root, a="red apples and pears", b="blue plums", c="green")
    (root / "d.bin").write_bytes(b"\0")
    crawl(spark, str(root), path)
    ids = {r["path"]: r["file_id"] for r in open_index(spark, path).files.collect()}
    assert len(ids) == 4
    put(root, b="blue plums and cherries, ripe", e="quinces")
    os.utime(root / "b.txt", (10**9, 10**9))
    os.remove(root / "c.txt")
    crawl(spark, str(root), path)
    index = open_index(spark, path)
    assert state(index) == state(Index(index.files))
    assert {r["path"]: r["file_id"] for r in index.files.collect()}[f"{root}/b.txt"] == ids[f"{root}/b.txt"]
    found = lambda q, i=index: sorted(r["name"] for r in search(i, Request(q)).collect())
    assert found("cherries ") == ["b.txt"] and found("green ") == [] and found("and ") == ["a.txt", "b.txt"] and found("in:notes") == ["a.txt", "b.txt", "d.bin", "e.txt"]
    put(root, c="green again")
    crawl(spark, str(root), path)
    compact(spark, path, str(tmp_path / "j"))
    again = open_index(spark, str(tmp_path / "j"))
    assert state(again) == state(open_index(spark, path)) and found("green ", again) == ["c.txt"]


def test_what_cannot_be_read_stays_indexed(spark, tmp_path, monkeypatch):
    from quarry.operators.sync import deleted

    cols = "path string, mtime long, size long, is_dir boolean, status string"
    now = spark.createDataFrame([("/r/a", 1, 1, False, None), ("/r/b", None, None, False, "unreadable"), ("/r/shut", 1, 1, True, "unreadable")], cols)
    indexed = spark.createDataFrame([(p, 1, 1) for p in ("/r/a", "/r/b", "/r/gone", "/r/shut/x", "/r/shut/y/z", "/r/shutter")], "path string, mtime long, size long")
    assert {r["path"] for r in deleted(now, indexed).collect()} == {"/r/gone", "/r/shutter"}


def test_watch_move_and_size(spark, tmp_path):
    root, path, check = tmp_path / "w", str(tmp_path / "i"), str(tmp_path / "c")
    put(root, a="plain oats", b="barley")

    def poll():
        assert watch(spark, str(root), path, check, {"once": True}).awaitTermination(120)
        return {r["name"] for r in open_index(spark, path).files.collect()}

    assert poll() == {"a.txt", "b.txt"}
    os.remove(root / "a.txt")
    put(root, **{"deep/c": "rye"})
    assert poll() == {"b.txt", "c.txt"}
    move_index(spark, path, str(tmp_path / "j"))
    assert file_at(open_index(spark, str(tmp_path / "j")), f"{root}/deep/c.txt").first()["content"] == "rye"
    assert 0 < index_size(spark, str(tmp_path / "j")) < index_size(spark, path)
    os.rename(root, tmp_path / "elsewhere")
    crawl(spark, str(root), path)
    assert open_index(spark, path).files.count() == 2


def test_chunks_progress_and_stop(spark, tmp_path):
    root, path = tmp_path / "w", str(tmp_path / "i")
    put(root, **{f"f{i}": f"word{i} oats" for i in range(9)})
    heard, asked = [], iter([False, False, True])
    assert not crawl(spark, str(root), path, chunk=3, stop=lambda: next(asked), progress=lambda *x: heard.append(x))
    some = open_index(spark, path).files.count()
    assert 0 < some < 9 and heard[-1] == (some, 9) and len(heard) == 2
    os.remove(root / "f0.txt")
    assert crawl(spark, str(root), path, chunk=4, progress=lambda *x: heard.append(x))
    index = open_index(spark, path)
    assert {r["name"] for r in index.files.collect()} == {f"f{i}.txt" for i in range(1, 9)} and heard[-1][0] == heard[-1][1]
    assert index.files.select("file_id").distinct().count() == 8 and state(index) == state(Index(index.files))


def test_rescan_and_stats_of_kinds(spark, tmp_path):
    root, path = tmp_path / "w", str(tmp_path / "i")
    put(root, a="plain oats")
    (root / "b.pdf").write_bytes(b"no pdf")
    (root / "c.jpg").write_bytes(b"x")
    found = {r["kind"]: (r["files"], r["failed"], r["bytes"], r["chars"]) for r in extraction_stats(spark, str(root)).collect()}
    assert found == {"text": (1, 0, 10, 10), "pdf": (1, 1, 6, 0)}
    assert watch(spark, str(root), path, str(tmp_path / "c"), {"once": True}).awaitTermination(120)
    assert open_index(spark, path).files.count() == 3
    # a file that came with an old time shows in no poll; a crawl that is due finds it
    asked = []
    assert watch(spark, str(root), path, str(tmp_path / "c"), {"once": True}, rescan=0, stop=lambda: bool(asked.append(1))).awaitTermination(120)
    assert asked
