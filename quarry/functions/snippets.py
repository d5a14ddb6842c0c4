"""Highlighting: where terms occur in a text, and the passage of it that shows most of them."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import tokenize_py, word_class, word_pattern

#: Characters of a passage, bytes of context before it, matches that are looked at.
LENGTH, CONTEXT, MOST_MATCHES, MOST_STARTS = 220, 60, 2000, 300
SEGMENTS = "array<struct<text: string, highlighted: boolean>>"


def find(text: str, terms: frozenset[str], of: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, term) in characters of the tokens that analyse to one of ``terms``."""
    out = []
    for m in word_pattern(text, of).finditer(text):
        word = tokenize_py(m[0], of)
        if len(word) == 1 and word[0] in terms:
            out.append((m.start(), m.end(), word[0]))
            if len(out) == MOST_MATCHES:
                break
    return out


def highlight_ranges(text: str, terms: frozenset[str]) -> list[tuple[int, int]]:
    """UTF-8 byte offsets of the matches."""
    size = lambda i: len(text[:i].encode())
    return [(size(a), size(b)) for a, b, _ in find(text, terms)]


def cut(text: str, low: int, high: int, found: list[tuple[int, int, str]], squeeze: bool = True) -> list[tuple[str, bool]]:
    """Segments of ``text[low:high]``; runs of blanks outside of matches become one."""
    plain = (lambda s: re.sub(r"[\s\x00-\x1f\x7f-\x9f]+", " ", s)) if squeeze else str
    out, at = [], low
    for a, b, _ in found:
        if a >= low and b <= high:
            out += [(plain(text[at:a]), False), (text[a:b], True)]
            at = b
    out.append((plain(text[at:high]), False))
    if out and not out[0][1]:
        out[0] = (out[0][0].lstrip(), False)
    return [s for s in out if s[0]]


def best_start(text: str, found: list[tuple[int, int, str]], length: int) -> int:
    """The first match of the window with the most distinct terms, then the most matches; two pointers over the matches."""
    at = [len(text[:a].encode()) for a, _, _ in found]
    ends = [len(text[:b].encode()) for _, b, _ in found]
    inside: Counter = Counter()
    best, first, j = (0, 0), 0, 0
    for i in range(min(len(found), MOST_STARTS)):
        while j < len(found) and ends[j] <= at[i] + 2 * length:
            inside[found[j][2]] += 1
            j += 1
        if (score := (len(inside), sum(inside.values()))) > best:
            best, first = score, i
        if j > i:
            inside[found[i][2]] -= 1
            inside += Counter()
        else:
            j = i + 1
    return found[first][0] if found else 0


def snippet(text: str | None, terms: frozenset[str], length: int = LENGTH, of: str | None = None) -> list[tuple[str, bool]]:
    """Segments of the best passage, with an ellipsis where text is left out; its start where nothing matches."""
    text = text or ""
    found = find(text, terms, of)
    low = best_start(text, found, length)
    if low:
        # context of so many bytes before the first match, from the start of a word on
        near = text[max(0, low - CONTEXT) : low].encode()[-CONTEXT:].decode("utf-8", "ignore")
        whole = len(near) == low
        first_blank = None if whole else re.search(r"\s", near)
        low -= len(near) - (first_blank.end() if first_blank else 0)
    rest = text[low : low + length]
    if low + len(rest) < len(text):
        rest = rest[: rest.rindex(m[0])] if (m := re.search(r"\s(?=\S*$)", rest)) and m.start() else rest
    out = cut(text, low, low + len(rest), found)
    return [("…", False)] * (low > 0) + out + [("…", False)] * (low + len(rest) < len(text) and bool(out))


def snippet_column(text: Column, terms: list[str], length: int = LENGTH) -> Column:
    """Snippets of a few rows: apply it to a top k, never to all files."""
    wanted, of = frozenset(terms), word_class()

    @F.pandas_udf(SEGMENTS)
    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": s, "highlighted": h} for s, h in snippet(t, wanted, length, of)])

    return work(text)
