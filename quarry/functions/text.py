"""Analysis of text into terms: letters and digits, short enough, lower case, folded to ASCII."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Tokens of so many UTF-8 bytes or more are left out.
MAX_TOKEN_BYTES = 48
#: A character of words, as Spark's patterns know it; all else separates.
WORD_CHAR = r"[\p{IsAlphabetic}\p{N}]"
_ASCII = re.compile("[0-9A-Za-z]+")
#: Folded to two letters. Fixed values.
PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "ĳ": "ij", "þ": "th"}


@lru_cache(maxsize=1)
def fold_map() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, b) for c, b in pairs if c not in PAIRS and c == c.lower() and b != c and "a" <= b <= "z"]
    pairs += [("ø", "o"), ("đ", "d"), ("ł", "l"), ("ħ", "h"), ("ı", "i"), ("ŧ", "t")]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def fold(col: Column) -> Column:
    """Lower case, folded to ASCII."""
    source, target = fold_map()
    out = F.translate(F.lower(col), source, target)
    for one, two in PAIRS.items():
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def tokenize(col: Column) -> Column:
    """Terms of a text in order; null and empty texts have none."""
    pieces = F.split(F.coalesce(col, F.lit("")), f"[^{WORD_CHAR}]+")
    kept = F.filter(pieces, lambda x: (x != "") & (F.octet_length(x) < MAX_TOKEN_BYTES))
    # folded as one string: compiled code, where a lambda for each term would be interpreted
    joined = fold(F.array_join(kept, " "))
    return F.filter(F.split(joined, " "), lambda x: x != "")


def _ranges(points: list[int]) -> str:
    starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
    ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


@lru_cache(maxsize=2)
def _class_of(asked: bool) -> str:
    if asked:
        points = SparkSession.active().range(1, 0x110000, 1, 8).where("id NOT BETWEEN 55296 AND 57343")
        text = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        return _ranges(sorted(r["id"] for r in points.where(text.rlike(f"^{WORD_CHAR}$")).select("id").collect()))
    import regex

    return _ranges([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and regex.match(r"[\p{Alphabetic}\p{N}]", chr(c))])


def word_class() -> str:
    """``WORD_CHAR`` as ranges of characters, for engines that know another version of Unicode.

    Spark is asked once; without a session, this machine's tables must do.
    """
    return _class_of(SparkSession.getActiveSession() is not None)


def word_pattern(text: str, of: str | None = None) -> re.Pattern:
    """Runs of word characters of a text, by ``of`` or the ``word_class`` of this session."""
    return _ASCII if text.isascii() else re.compile(f"[{of or word_class()}]+")


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    source, target = fold_map()
    return str.maketrans({**dict(zip(source, target)), **PAIRS})


def tokenize_py(text: str, of: str | None = None) -> list[str]:
    """The same analysis of a query on the driver, or of a text in a worker that was given the ``word_class``."""
    words = word_pattern(text, of).findall(text)
    return [w.lower().translate(_fold_table()) for w in words if len(w.encode()) < MAX_TOKEN_BYTES]


def osa_distance(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours counts once (restricted)."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def natural_key(name: Column) -> tuple[Column, Column]:
    """Sort keys by which slide2 comes before slide10: the part before the last number, and the number."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.regexp_extract(stem, r"^(.*?)([0-9]*)$", 1), F.coalesce(
        F.try_to_number(F.nullif(F.regexp_extract(stem, r"([0-9]+)$", 1), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0)
    )
