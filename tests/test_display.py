from datetime import UTC, datetime

from pyspark.sql import functions as F

from quarry.functions import display as d
from quarry.functions.markdown import plain, render


def test_markdown():
    source = "# Title\n\nSome **bold *and* text**\nnext `code`\n\n- one\n  - [x] in\n- [link](u)\n\n3. third\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n> said\n\n```\nx = 1\n```"
    assert plain(source) == "Title\n\nSome bold and text next code\n\n•  one\n    •  ☑ in\n•  link\n\n3. third\n\na\tb\t\n1\t2\t\n\n──────────\n\nsaid\n\nx = 1\n\n\n"
    styles = dict(render(source))
    assert (styles["Title"], styles["and"], styles["code"], styles["x = 1\n"]) == ("h1", "bold italic", "code", "code") and plain("") == ""


def test_shown_values(spark):
    now = F.lit("2024-03-05 10:00:00").cast("timestamp")
    one = spark.range(1).select(
        F.array(*[d.format_date(F.lit(t), now) for t in (1709629500, 1704067200, 1672531200)]).alias("dates"),
        F.array(*[d.format_count(F.lit(1234567), x) for x in ("en", "es")]).alias("counts"),
        F.array(*[d.display_path(F.lit(p), "/home/a/") for p in ("/home/a", "/home/a/x", "/home/ab")]).alias("paths"),
        F.array(*[d.display_name(F.lit(p)) for p in ("/x/y.txt", "/x/", "/")]).alias("names"),
        F.array(*[d.failure_text(F.lit(p).cast("string")) for p in ("encrypted", "?", None)]).alias("failures"),
        d.markup(F.expr("array(named_struct('text', 'a<b ', 'highlighted', false), named_struct('text', 'c', 'highlighted', true))")).alias("markup"),
        F.array(d.description(F.lit(" "), F.lit("/p")), d.description(F.lit("s"), F.lit("/p"))).alias("described"),
        F.array(d.next_match(F.lit(0), -1, F.lit(3)), d.next_match(F.lit(2), 1, F.lit(3)), d.next_match(F.lit(0), 1, F.lit(0))).alias("next"),
    ).first()
    assert one["dates"] == ["09:05", "1 Jan", "1 Jan 2023"] and one["counts"] == ["1,234,567", "1.234.567"]
    assert one["paths"] == ["~", "~/x", "/home/ab"] and one["names"] == ["y.txt", "x", "/"]
    assert one["failures"] == ["Password protected", "Damaged or unsupported", None] and one["markup"] == "a&lt;b <b>c</b>"
    assert one["described"] == ["/p", "s"] and one["next"] == [2, 0, None]


def test_ranges_chips_and_previews(spark):
    now = datetime(2024, 3, 5, 10, tzinfo=UTC)
    assert d.since("any", now) is None and d.since("today", now) == 1709596800 and d.since("week", now) == 1709632800 - 7 * 86400
    assert d.categories_of(["media", "pdf"]) == ("audio", "video", "pdf")
    rows = spark.createDataFrame([([["ab", "c"], [" ", ""], ["d"]],), ([],)], "r array<array<string>>")
    found = rows.select(d.preview_rows(F.col("r")).alias("r"), d.column_widths(F.col("r")).alias("w")).collect()
    cells = spark.createDataFrame([([["Oats, rye", "c"], ["\t\u00a0", ""], ["RYE", "x"]],), ([],)], "r array<array<string>>")
    shown = cells.select(F.size(d.preview_rows(F.col("r"))).alias("n"), d.matching_cells(F.col("r"), ["rye", "y"]).alias("m"), d.matching_cells(F.col("r"), []).alias("z"))
    assert [tuple(r) for r in shown.collect()] == [(2, 2, 0), (0, 0, 0)]
    assert d.progress(50, 1200, 2) == "50 of 1,200" and d.progress(1100, 1200, 10) == "1,100 of 1,200 · less than a minute left" and d.progress(200, 12000, 10, 100) == "200 of 12,000 · about 20 minutes left"
    assert found[0]["r"] == [["ab", "c"], ["d"]] and found[0]["w"] == [2, 1] and found[1]["w"] == []
