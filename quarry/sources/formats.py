"""Kinds of files by extension, how large they may be, and the text of each kind."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.categories import EXTENSIONS

MIB = 1 << 20
# Extensions that hold text, by kind. Fixed values.
KINDS = {
    "pdf": "pdf",
    "odf": "odt ott odp otp odg fodt",
    "docx": "docx docm dotx",
    "spreadsheet": "xlsx xlsm xlsb xls ods ots",
    "pptx": "pptx pptm",
    "epub": "epub",
    "doc": "doc dot",
    "rtf": "rtf",
    "html": "html htm xhtml",
    "text": " ".join(e for e in EXTENSIONS["text"].split() if e not in ("html", "htm", "xhtml")),
}
BY_EXTENSION = {e: k for k, es in KINDS.items() for e in es.split()}
#: Largest file that is read, inclusive.
PLAIN, PLAIN_BYTES, OTHER_BYTES = ("text", "html", "rtf"), 32 * MIB, 256 * MIB


def extension(name: str) -> str:
    """Lower-case extension; a name that only begins with a dot has none."""
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def kind_of(ext: Column) -> Column:
    """Kind of a lower-case extension; null for files of which only the name counts."""
    return F.create_map(*map(F.lit, chain.from_iterable(BY_EXTENSION.items())))[ext]


def most_bytes(kind: str) -> int:
    return PLAIN_BYTES if kind in PLAIN else OTHER_BYTES


def classified(listing, file_names: bool = True):
    """A listing (name, size, ...) with ext and kind; too large files have no kind, and leave with other nameless ones without ``file_names``."""
    ext = F.lower(F.regexp_extract("name", r"(?s)^.+\.([^.]*)$", 1))
    kind = kind_of(F.col("ext"))
    fits = F.col("size") <= F.when(kind.isin(*PLAIN), PLAIN_BYTES).otherwise(OTHER_BYTES)
    out = listing.withColumn("ext", ext).withColumn("kind", F.when(fits, kind))
    return out if file_names else out.where(F.col("kind").isNotNull())


# ---- bytes and entities -------------------------------------------------------------

def cp1252(data: bytes) -> str:
    """Windows-1252, its five undefined bytes passed through."""
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)


#: Named entities that are decoded; all others stay as they are. Fixed values.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = re.compile(r"&([^;&]{0,10});")


def _entity(m: re.Match) -> str:
    name = m[1]
    if name in ENTITIES:
        return ENTITIES[name]
    number = re.fullmatch(r"#(?:[xX]([0-9a-fA-F]+)|([0-9]+))", name)
    code = int(number[1], 16) if number and number[1] else int(number[2]) if number else -1
    return chr(code) if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def decode_entities(text: str) -> str:
    return _ENTITY.sub(_entity, text) if "&" in text else text


# ---- HTML -------------------------------------------------------------------

#: Elements that are dropped with their content, those that end a paragraph, and those that end a line. Fixed values.
HTML_DROPPED = frozenset("script style head noscript svg template".split())
HTML_BLOCKS = frozenset("p div section article header footer nav main aside table blockquote figure form dl title".split())
HTML_LINES = frozenset("li tr dt dd".split())
_HTML = re.compile(r"<!--(?P<comment>.*?(?:-->|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z0-9]*)[^>]*>", re.S)


# Marks in the text of a page: the end of a line that holds something, the same with a blank line after it, the end of
# any line, a blank that stays, and a new cell.
_END, _GAP, _BREAK, _BLANK, _CELL = "\x01", "\x02", "\x03", "\x04", "\x05"
#: What elements put in the text where they start and where they end.
_OPEN = dict.fromkeys(HTML_BLOCKS, _GAP) | dict.fromkeys(HTML_LINES, _END) | {"td": _CELL, "th": _CELL, "br": _BREAK, "hr": f"{_GAP}---{_GAP}", "pre": f"{_GAP}```{_END}"}
_OPEN |= {f"h{n}": _GAP + "#" * n + _BLANK for n in range(1, 7)}
_CLOSE = dict.fromkeys(HTML_BLOCKS, _GAP) | dict.fromkeys(HTML_LINES, _END) | {f"h{n}": _GAP for n in range(1, 7)} | {"br": _BREAK, "hr": f"{_GAP}---{_GAP}", "pre": f"{_END}```{_GAP}"}


def _marked(html: str) -> Iterator[str]:
    """The text of a page with marks; inside lists blocks end lines only."""
    at, depth, kept = 0, 0, False
    plain = str.maketrans(dict.fromkeys(_END + _GAP + _BREAK + _BLANK + _CELL))
    stays = str.maketrans({"\n": _BREAK, " ": _BLANK})

    def text(piece: str) -> str:
        piece = decode_entities(piece).translate(plain)
        return piece.translate(stays) if kept else re.sub(r"\s+", " ", piece)

    while m := _HTML.search(html, at):
        yield text(html[at : m.start()])
        at, name = m.end(), (m["name"] or "").lower()
        if name in HTML_DROPPED and not m["close"]:
            end = re.compile(f"</{name}[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name in ("ul", "ol"):
            depth = max(0, depth - 1) if m["close"] else depth + 1
            yield _END if depth else _GAP
        elif name == "li" and not m["close"]:
            yield _END + _BLANK * (2 * depth - 2) + "-" + _BLANK
        else:
            mark = (_CLOSE if m["close"] else _OPEN).get(name, "")
            kept = not m["close"] if name == "pre" else kept
            yield mark.replace(_GAP, _END) if depth and name in HTML_BLOCKS else mark
    yield text(html[at:])


def html_to_text(html: str) -> str:
    """Markdown-like text: ``#`` headings, ``-`` items, blank lines between paragraphs, blanks collapsed.

    A ``<`` that nothing closes is text, with all that follows it.
    """
    marked = re.sub(f"({_BLANK}) +", r"\1", re.sub(" +", " ", "".join(_marked(html))))
    lines: list[str] = []
    for m in re.finditer(f"([^{_END}{_GAP}{_BREAK}]*)([{_END}{_GAP}{_BREAK}]?)", marked):
        cells = m[1].strip(" ").removeprefix(_CELL).replace(_BLANK, " ")
        line = re.sub(f" ?{_CELL} ?", " · ", cells).rstrip()
        if line or m[2] == _BREAK:
            lines.append(line)
        if m[2] == _GAP and lines and lines[-1]:
            lines.append("")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


# ---- office XML ---------------------------------------------------------------

# What elements of office XML leave in the text where they end, and where they are empty; whose content is dropped. Fixed values.
XML_END = dict.fromkeys("p h si tr list-item title".split(), "\n") | dict.fromkeys("tc table-cell c".split(), "\t")
XML_EMPTY = {"tab": "\t", "br": "\n", "line-break": "\n", "cr": "\n", "s": " ", "p": "\n", "h": "\n"}
XML_DROPPED = frozenset("binData instrText del delText".split())
_XML = re.compile(
    r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?:[\w.-]+:)?(?P<name>[\w.-]+)(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?P<empty>/?)>", re.S
)


def xml_to_text(data: bytes) -> str:
    """Text of office XML; what comes before a defect is kept."""
    source, out, at, dropped = data.decode("utf-8", "replace"), [], 0, 0
    for m in _XML.finditer(source):
        if not dropped:
            out.append(decode_entities(source[at : m.start()]) + (m["cdata"] or ""))
        at, name = m.end(), m["name"]
        if not name:
            continue
        if dropped or (name in XML_DROPPED and not m["close"]):
            dropped += 0 if m["empty"] else -1 if m["close"] else 1
        elif m["empty"] or m["close"]:
            out.append((XML_EMPTY if m["empty"] else XML_END).get(name, ""))
    out += [] if dropped else [decode_entities(source[at:].partition("<")[0])]
    return "".join(out)


# ---- RTF ----------------------------------------------------------------------

#: Groups that hold no text of the document, and what control words leave in it. Fixed values.
RTF_DROPPED = frozenset(
    "fonttbl colortbl stylesheet info pict object header footer listtable listoverridetable rsidtbl generator xmlnstbl themedata"
    " colorschememapping latentstyles datastore fldinst".split()
)
RTF_WORDS = dict.fromkeys("par line row sect page".split(), "\n") | dict.fromkeys("tab cell".split(), "\t")
_RTF = re.compile(
    r"(?P<open>\{)|(?P<shut>\})|\\'(?P<hex>[0-9a-fA-F]{2})|\\(?P<word>[a-zA-Z]+)(?P<number>-?[0-9]+)? ?|\\(?P<escaped>[\\{}])"
    r"|\\(?P<star>\*)|\\(?P<end>[\r\n])|\\.?|[\r\n]+|(?P<plain>[^\\{}\r\n]+)",
    re.S,
)


def rtf_to_text(rtf: str) -> str:
    """Plain text of RTF: escapes decoded, tables and other non-text groups dropped."""
    out: list[str] = []
    groups, skip = [False], 0
    for m in _RTF.finditer(rtf):
        kind, value = m.lastgroup, m[m.lastgroup] if m.lastgroup else ""
        if m["word"]:
            kind, value = "word", m["word"]
        if kind == "open":
            groups.append(groups[-1])
        elif kind == "shut":
            del groups[max(len(groups) - 1, 1) :]
        elif kind == "star" or (kind == "word" and value in RTF_DROPPED):
            groups[-1] = True
        elif groups[-1]:
            continue
        elif kind == "hex":
            # the stand-in that follows a Unicode escape is left out
            out.append("" if skip else cp1252(bytes.fromhex(value)))
            skip = 0
        elif kind == "word" and value == "u" and m["number"]:
            code = int(m["number"]) % 65536
            out.append("�" if 0xD800 <= code < 0xE000 else chr(code))
            skip = 1
        elif kind == "word":
            out.append(RTF_WORDS.get(value, ""))
        elif kind == "plain":
            out.append(value[skip:])
            skip = 0
        elif kind in ("escaped", "end"):
            out.append("\n" if kind == "end" else value)
    return "".join(out)
