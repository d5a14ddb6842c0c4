import pytest

from quarry.functions.categories import type_filter
from quarry.functions.paths import glob_regex
from quarry.functions.query import parse
from quarry.functions.text import osa_distance, tokenize, tokenize_py
from quarry.operators.library import Library
from quarry.sources.decode import cp1252, decode_text, extract, parse_delimited, xml_to_text


def test_query_syntax():
    q = parse('budget "net total" -draft type:pdf in:reports name:sheet 10:30')
    assert (q.words, q.phrases, q.excluded) == (["budget", "10:30"], ["net total"], ["draft"])
    assert (q.types, q.folders, q.names) == ([("category", "pdf")], ["reports"], ["sheet"])


def test_typing_state():
    assert parse("marma").typing_last and not parse("marma ").typing_last
    assert not parse("budg type:pdf").typing_last and not parse('budget "q1').typing_last
    assert parse("-").words == ["-"] and parse('"-x"').excluded == ["x"] and parse("type:").types == []


def test_type_words():
    assert type_filter("Imágenes") == ("category", "image")
    assert type_filter("py") == ("ext", "py") and type_filter("a b") is None


@pytest.mark.parametrize("text,terms", [("ZÜRICH straße", ["zurich", "strasse"]), ("a_b.c-d", ["a", "b", "c", "d"]), ("x" * 48, []), ("", [])])
def test_tokenize(spark, text, terms):
    assert tokenize_py(text) == terms
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokenize(df.t).alias("w")).first()["w"] == terms


def test_distance():
    assert osa_distance("copyrigth", "copyright") == 1 and osa_distance("ca", "abc") == 3


@pytest.mark.parametrize("pattern,text,ok", [("*.TMP", "a.tmp", True), ("a?c", "abc", True), ("a?c", "ac", False), ("a.c", "abc", False), ("*", "", True)])
def test_globs(spark, pattern, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(df.t.rlike(glob_regex(pattern)).alias("m")).first()["m"] is ok


def test_library(tmp_path):
    lib = Library()
    assert lib.add("/a/b") == ("added", 0) and lib.add("/a/b/c") == ("already-included", 0)
    assert lib.add("/a") == ("merged", 1) and lib.folders == {"/a": True}
    lib.save(str(tmp_path / "x.json"))
    assert Library.load(str(tmp_path / "x.json")).folders == lib.folders
    (tmp_path / "old.json").write_text('{"folders": ["/q"]}')
    assert Library.load(str(tmp_path / "old.json")).folders == {"/q": True}
    assert Library.load(str(tmp_path / "none.json")).folders == {}


def test_decode():
    assert decode_text("é".encode()) == "é" and decode_text(b"\xe9\x81") == "é\x81" and cp1252(b"\x80") == "€"
    assert decode_text(b"\xff\xfeh\0i\0") == "hi"
    assert extract("txt", b"a\0b") == (None, "unreadable")
    assert xml_to_text(b"<w:p>One<w:del>x</w:del></w:p><w:p>A&amp;B</w:p>") == "One\nA&B\n"


def test_delimited():
    assert parse_delimited('a,"b ""c"", d",\r\n"x\ny",2\n') == [["a", 'b "c", d', ""], ["x\ny", "2"]]
