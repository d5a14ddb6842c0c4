from quarry.functions.snippets import highlight_ranges, snippet, snippet_column


def test_byte_offsets():
    assert highlight_ranges("é Zürich x", frozenset({"zurich"})) == [(3, 10)]


def test_window():
    text = "lead " * 80 + "alpha beta " + "tail " * 80
    out = snippet(text, frozenset({"alpha", "beta"}))
    assert out[0] == ("…", False) and out[-1] == ("…", False)
    assert [s for s, h in out if h] == ["alpha", "beta"]
    assert sum(len(s) for s, _ in out[1:-1]) <= 220
    assert snippet("no match here", frozenset({"zz"})) == [("no match here", False)]
    assert snippet(None, frozenset({"zz"})) == [] and snippet("a\n\n b", frozenset({"b"})) == [("a ", False), ("b", True)]


def test_column(spark):
    df = spark.createDataFrame([("the alpha",), (None,)], "t string")
    rows = df.select(snippet_column(df.t, ["alpha"]).alias("s")).collect()
    assert [(x["text"], x["highlighted"]) for x in rows[0]["s"]] == [("the ", False), ("alpha", True)] and rows[1]["s"] == []
