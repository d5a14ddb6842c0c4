import re

from pyspark.sql import functions as F

from quarry.functions.snippets import find
from quarry.functions.text import tokenize, tokenize_py, word_class


def test_index_and_query_split_all_of_unicode_alike(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    # each character between two letters, in lines of a few thousand
    lines = ["  ".join(f"a{chr(c)}b" for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, text string")
    for r in df.select("n", tokenize(F.col("text")).alias("terms")).collect():
        assert r["terms"] == tokenize_py(lines[r["n"]])


def test_words_of_other_scripts(spark):
    for text, words in {"हिन्दी भाषा": 3, "தமிழ் மொழி": 2, "ภาษาไทย ๑๒": 2, "Ünder_Größe": 2, "日本語、テスト": 2, "ΣΊΣΥΦΟΣ": 1}.items():
        got = tokenize_py(text)
        assert len(got) == words
        assert spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t")).alias("x")).first()["x"] == got
        assert [w for *_, w in find(text, frozenset(got))] == got


def test_class_fits_the_pattern():
    assert re.match(f"[{word_class()}]+$", "aZ9éभाषा")
