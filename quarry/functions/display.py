"""How results are shown: dates, counts, paths, marked text, failures, date ranges, filter chips, table previews."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import tokenize

# Fixed values.
FAILURES = {"encrypted": "Password protected", "timed-out": "Took too long to read", "crashed": "Couldn't be read safely", "unreadable": "Damaged or unsupported"}
DATE_RANGES = {"week": 7, "month": 30, "year": 365}
CHIPS = {
    "document": ("document",), "pdf": ("pdf",), "spreadsheet": ("spreadsheet",), "presentation": ("presentation",),
    "text": ("text",), "image": ("image",), "media": ("audio", "video"), "other": ("archive", "other"),
}
MAX_ROWS, MAX_COLUMNS = 500, 40


def format_date(mtime: Column, now: Column) -> Column:
    """Time of today, day and month of this year, else the year too; ``mtime`` in seconds, ``now`` a timestamp."""
    at = F.timestamp_seconds(mtime)
    same_day, same_year = F.to_date(at) == F.to_date(now), F.year(at) == F.year(now)
    return F.when(same_day, F.date_format(at, "HH:mm")).when(same_year, F.date_format(at, "d MMM")).otherwise(F.date_format(at, "d MMM yyyy"))


def format_count(n: Column, language: str = "en") -> Column:
    """Thousands apart by a comma in English, by a point in other languages."""
    out = F.format_number(n, 0)
    return out if language == "en" else F.translate(out, ",", ".")


def display_path(path: Column, home: str) -> Column:
    """The home folder as ``~``."""
    home = home.rstrip("/")
    return F.when(path == home, "~").when(path.startswith(home + "/"), F.concat(F.lit("~"), F.substr(path, F.lit(len(home) + 1)))).otherwise(path)


def display_name(path: Column) -> Column:
    name = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    return F.when(name == "", path).otherwise(name)


def failure_text(failure: Column) -> Column:
    """Unknown failures read as unreadable; null stays null."""
    out = F.when(failure.isNull(), None)
    for name, text in FAILURES.items():
        out = out.when(failure == name, text)
    return out.otherwise(FAILURES["unreadable"])


def escape_markup(text: Column) -> Column:
    out = text
    for plain, safe in {"&": "&amp;", "<": "&lt;", ">": "&gt;", "'": "&apos;", '"': "&quot;"}.items():
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def markup(segments: Column, opening: str = "<b>", closing: str = "</b>", dim_plain: bool = False) -> Column:
    """Snippet segments as one string of markup."""

    def one(s: Column) -> Column:
        text = escape_markup(s["text"])
        dim = F.concat(F.lit('<span alpha="70%">'), text, F.lit("</span>")) if dim_plain else text
        return F.when(s["highlighted"], F.concat(F.lit(opening), text, F.lit(closing))).otherwise(dim)

    return F.array_join(F.transform(segments, one), "")


def description(snippet: Column, parent: Column) -> Column:
    """The snippet, or the folder where there is none."""
    return F.when(F.trim(F.coalesce(snippet, F.lit(""))) == "", parent).otherwise(snippet)


def since(name: str, now: datetime) -> int | None:
    """Start of a date range in seconds: any, today (midnight of ``now``'s zone), week, month, year."""
    if name == "any":
        return None
    if name == "today":
        return int(now.replace(hour=0, minute=0, second=0, microsecond=0).timestamp())
    return max(int((now - timedelta(days=DATE_RANGES[name])).timestamp()), 0)


def categories_of(chips: list[str]) -> tuple[str, ...]:
    """The categories that chosen chips stand for."""
    return tuple(c for chip in chips for c in CHIPS[chip])


def next_match(at: Column, step: int, n: Column) -> Column:
    """The match before or after, around the ends; null if there is none."""
    return F.when(n > 0, F.pmod(at + step, n))


def preview_rows(rows: Column) -> Column:
    """Rows of a table with some cell that is not blank, up to the limits of a preview."""
    some = F.filter(F.slice(rows, 1, MAX_ROWS), lambda r: F.exists(r, lambda c: c.rlike(r"(?U)\S")))
    return F.transform(some, lambda r: F.slice(r, 1, MAX_COLUMNS))


def matching_cells(rows: Column, terms: list[str]) -> Column:
    """Cells of the rows that a preview shows in which one of the terms stands."""
    if not terms:
        return F.lit(0)
    wanted = F.array(*map(F.lit, terms))
    return F.size(F.filter(F.flatten(rows), lambda c: F.arrays_overlap(tokenize(c), wanted)))


def progress(done: int, total: int, seconds: float, done_before: int = 0) -> str:
    """How far an update is, and about how long it will take; no estimate in the first three seconds."""
    counts = f"{done:,} of {total:,}"
    rate = (done - done_before) / max(seconds, 0.001)
    if seconds < 3 or rate <= 0:
        return counts
    minutes = math.ceil((total - done) / rate / 60)
    return f"{counts} · " + ("less than a minute left" if minutes <= 1 else f"about {minutes} minutes left")


def column_widths(rows: Column) -> Column:
    """Characters of the longest cell of each column."""
    n = F.least(F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)), F.lit(MAX_COLUMNS))
    width = lambda i: F.array_max(F.transform(rows, lambda r: F.coalesce(F.length(F.get(r, i - 1)), F.lit(0))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), width)).otherwise(F.array().cast("array<int>"))
