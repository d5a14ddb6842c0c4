"""Bytes to text: byte order marks, UTF-8, then Windows-1252; dispatch by extension; delimited text."""

from __future__ import annotations

import codecs
from contextlib import nullcontext

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.formats import BY_EXTENSION, cp1252, html_to_text, rtf_to_text, xml_to_text
from quarry.sources.limits import LIMITED, TookTooLong, limited
from quarry.sources.packages import MAX_TEXT, WANTED, package_text, pdf_text, spreadsheet_text, word_text


def decode_text(data: bytes) -> str:
    if data.startswith(codecs.BOM_UTF8):
        return data[3:].decode("utf-8", "replace")
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return data.decode("utf-16", "replace")
    if b"\0" in data[: 8 << 10]:
        raise ValueError("binary file")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return cp1252(data)


def text_of(ext: str, data: bytes) -> str:
    """The text of a file of a known kind; raises where there is none."""
    kind = BY_EXTENSION.get(ext)
    if kind is None:
        raise ValueError("no kind of document")
    if kind == "text":
        return decode_text(data)
    if kind == "html":
        return html_to_text(decode_text(data))
    if kind == "rtf":
        return rtf_to_text(data.decode("utf-8", "replace"))
    if ext == "fodt":
        return xml_to_text(data)
    if kind in WANTED:
        return package_text(kind, data)
    return {"spreadsheet": spreadsheet_text, "doc": word_text, "pdf": pdf_text}[kind](data)


def extract(ext: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, failure). Kinds whose readers may run away are read within limits of time and memory."""
    try:
        with limited() if BY_EXTENSION.get(ext) in LIMITED else nullcontext():
            return text_of(ext, data).encode("utf-8", "replace")[:MAX_TEXT].decode("utf-8", "ignore"), None
    except TookTooLong:
        return None, "timed-out"
    except (MemoryError, RecursionError):
        return None, "crashed"
    except Exception as e:  # any defect of a file is data, not an error of the job
        said = str(e).lower()
        return None, "encrypted" if "encrypt" in said or "password" in said else "unreadable"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("failure", T.StringType())]))
def extract_udf(ext: pd.Series, data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(e or "", d or b"") for e, d in zip(ext, data)], columns=["text", "failure"])


@F.pandas_udf(T.StringType())
def html_text_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda h: html_to_text(h or ""))


def parse_delimited(text: str, separator: str = ",", max_rows: int = 500) -> list[list[str]]:
    """Rows of cells; a quote opens only an empty cell, a doubled quote inside is one."""
    rows, row, cell, quoted, i = [], [], [], False, 0
    while i < len(text) and len(rows) < max_rows:
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            elif c == '"':
                quoted = False
            else:
                cell.append(c)
        elif c == '"' and not cell:
            quoted = True
        elif c == separator:
            row.append("".join(cell))
            cell = []
        elif c == "\n":
            row.append("".join(cell).rstrip("\r"))
            rows.append(row)
            row, cell = [], []
        else:
            cell.append(c)
        i += 1
    if (cell or row) and len(rows) < max_rows:
        rows.append([*row, "".join(cell).rstrip("\r")])
    return rows
