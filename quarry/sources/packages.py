"""Text of packaged and binary documents: zip members, spreadsheets, legacy Word, PDF."""

from __future__ import annotations

import math
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from io import BytesIO
from xml.etree import ElementTree

from quarry.sources.formats import MIB, cp1252, html_to_text, xml_to_text

MAX_TEXT, MAX_MEMBER = 8 * MIB, 64 * MIB


class Encrypted(ValueError):
    """The document is protected by a password."""


def natural(name: str) -> tuple[str, int]:
    """Sort key by the last number in a name: slide2 before slide10."""
    m = re.search(r"^(.*?)([0-9]+)[^0-9]*$", name, re.S)
    return (m[1], int(m[2])) if m else (name, 0)


def members(data: bytes, wanted: Callable[[str], bool]) -> Iterator[bytes]:
    """Wanted members of a zip file in natural order, each up to its cap."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        for name in sorted(filter(wanted, z.namelist()), key=natural):
            with z.open(name) as f:
                yield f.read(MAX_MEMBER)


def capped(parts: Iterator[str]) -> str:
    out, size = [], 0
    for part in parts:
        out.append(part)
        size += len(part)
        if size > MAX_TEXT:
            break
    return "\n".join(out)


#: Members of office packages that hold text. Fixed values.
WANTED = {
    "docx": r"word/(document\.xml|header.*|footer.*|footnotes\.xml)",
    "pptx": r"ppt/(slides/slide.*|notesSlides/.*)\.xml",
    "odf": r"content\.xml",
    "epub": r"(?i).*\.(xhtml|html?)",
}


def package_text(kind: str, data: bytes) -> str:
    read = members(data, lambda n: re.fullmatch(WANTED[kind], n, re.S) is not None)
    if kind == "epub":
        return capped(html_to_text(m.decode("utf-8", "replace")) for m in read)
    return capped(xml_to_text(m) for m in read)


# ---- spreadsheets ---------------------------------------------------------------


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attribute(node, name: str, default: str = "") -> str:
    return next((v for k, v in node.attrib.items() if local(k) == name), default)


def _below(node, name: str) -> Iterator:
    return (n for n in node.iter() if local(n.tag) == name)


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple[str, Iterator[list[str]]]]:
    parse = lambda name: ElementTree.fromstring(z.open(name).read(MAX_MEMBER))
    names = set(z.namelist())
    shared = ["".join(t.text or "" for t in _below(si, "t")) for si in _below(parse("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target", "") for r in parse("xl/_rels/workbook.xml.rels")}

    def rows(path: str) -> Iterator[list[str]]:
        for row in _below(parse(path), "row"):
            cells: dict[int, str] = {}
            for c in _below(row, "c"):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = len(cells)
                if letters:
                    at = 0
                    for letter in letters:
                        at = at * 26 + ord(letter) - 64
                    at -= 1
                kind, value = c.get("t"), next(_below(c, "v"), None)
                text = (value.text or "") if value is not None else "".join(t.text or "" for t in _below(c, "t"))
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "b":
                    text = {"1": "true", "0": "false"}.get(text, text)
                elif kind in (None, "n") and text:
                    text = plain_number(text)
                cells[at] = text
            yield [cells.get(i, "") for i in range(min(max(cells, default=-1) + 1, 16384))]

    for sheet in _below(parse("xl/workbook.xml"), "sheet"):
        target = targets.get(attribute(sheet, "id"), "")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path in names:
            yield sheet.get("name", ""), rows(path)


def _ods_value(cell) -> str:
    """What a cell stores: a number, a truth value, a date or a time in ISO form, or else its text."""
    stored = {local(k): v for k, v in cell.attrib.items()}
    if "value" in stored:
        return plain_number(stored["value"])
    for name in ("string-value", "date-value", "time-value", "boolean-value"):
        if name in stored:
            return stored[name]
    return "\n".join("".join(p.itertext()) for p in _below(cell, "p"))


def _ods(z: zipfile.ZipFile) -> Iterator[tuple[str, Iterator[list[str]]]]:
    def rows(table) -> Iterator[list[str]]:
        for row in _below(table, "table-row"):
            cells: list[str] = []
            for c in row:
                if local(c.tag) in ("table-cell", "covered-table-cell"):
                    text = _ods_value(c)
                    # long repetitions are the empty rest of a row
                    again = int(attribute(c, "number-columns-repeated", "1"))
                    cells += [text] * (again if text else min(again, 1024))
            again = int(attribute(row, "number-rows-repeated", "1"))
            yield from [cells] * (again if any(cells) else 0 if again > 1024 else again)

    for table in _below(ElementTree.fromstring(z.open("content.xml").read(MAX_MEMBER)), "table"):
        yield attribute(table, "name"), rows(table)


def number(value: float) -> str:
    """A number in plain digits, without a point if it is whole."""
    if not math.isfinite(value):
        return str(value)
    return str(int(value)) if value == int(value) else format(Decimal(repr(value)), "f")


def plain_number(text: str) -> str:
    """A number as ``number`` writes it; other texts stay as they are."""
    try:
        return number(float(text))
    except ValueError:
        return text


#: What cells with errors show. Fixed values.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, parts) of the records of an old workbook's stream; parts beyond the first continue the record."""
    kind, parts = -1, []
    while at + 4 <= len(stream):
        found, size = struct.unpack_from("<HH", stream, at)
        body, at = stream[at + 4 : at + 4 + size], at + 4 + size
        if found == 0x3C:
            parts.append(body)
            continue
        if kind >= 0:
            yield kind, parts
        kind, parts = found, [body]
    if kind >= 0:
        yield kind, parts


class _Strings:
    """Unicode strings of a record that may go on in others: there, characters begin with a new mark of their width."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.part < len(self.parts):
            got = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n > 0:
                self.part, self.at = self.part + 1, 0
        if n > 0:
            raise ValueError("a record ends within a string")
        return out

    def characters(self, n: int, wide: int) -> str:
        out = []
        while n > 0:
            left = len(self.parts[self.part]) - self.at
            if left <= 0:
                self.part, self.at = self.part + 1, 0
                wide = self.take(1)[0] & 1
                continue
            count = min(n, max(left >> wide, 1))
            out.append(self.take(count << wide).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= count
        return "".join(out)

    def text(self, size: str = "<H") -> str:
        n, flags = struct.unpack(size, self.take(struct.calcsize(size)))[0], self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = self.characters(n, flags & 1)
        self.take(4 * runs + extra)
        return out


def _packed_number(rk: int) -> float:
    """A number in 30 bits: whole or the high bits of a double, perhaps a hundredfold."""
    value = float(struct.unpack("<i", struct.pack("<I", rk))[0] >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return value / 100 if rk & 1 else value


def _xls_rows(stream: bytes, at: int, shared: list[str], unicode: bool) -> list[list[str]]:
    """Rows of the sheet that begins at a place of the stream, from the first to the last row in use."""
    cells: dict[int, dict[int, str]] = {}
    waiting: tuple[int, int] | None = None
    text = lambda parts, skip: _Strings([parts[0][skip:], *parts[1:]]).text() if unicode else cp1252(parts[0][skip + 2 :][: struct.unpack_from("<H", parts[0], skip)[0]])
    depth = 0
    for kind, parts in _records(stream, at):
        body = parts[0]
        if kind == 0x0809:
            depth += 1
        elif kind == 0x000A:
            depth -= 1
            if depth == 0:
                break
        elif depth != 1:
            continue  # a chart within the sheet
        elif kind == 0x0207 and waiting:
            cells.setdefault(waiting[0], {})[waiting[1]] = text(parts, 0)
        elif kind == 0x00BD:
            row, first = struct.unpack_from("<HH", body)
            for i in range((len(body) - 6) // 6):
                cells.setdefault(row, {})[first + i] = number(_packed_number(struct.unpack_from("<I", body, 6 + 6 * i)[0]))
        elif kind in (0x00FD, 0x0204, 0x00D6, 0x0203, 0x027E, 0x0205, 0x0006):
            row, column = struct.unpack_from("<HH", body)
            value = ""
            if kind == 0x00FD:
                place = struct.unpack_from("<I", body, 6)[0]
                value = shared[place] if place < len(shared) else ""
            elif kind in (0x0204, 0x00D6):
                value = text(parts, 6)
            elif kind == 0x027E:
                value = number(_packed_number(struct.unpack_from("<I", body, 6)[0]))
            elif kind == 0x0203 or body[12:14] != b"\xff\xff" and kind == 0x0006:
                value = number(struct.unpack_from("<d", body, 6)[0])
            else:
                what, content = (body[7] + 1, body[6]) if kind == 0x0205 else (body[6], body[8])
                value = {1: "true" if content else "false", 2: ERRORS.get(content, "")}.get(what, "")
                waiting = (row, column) if kind == 0x0006 and what == 0 else None
            cells.setdefault(row, {})[column] = value
    used = {r: c for r, c in cells.items() if any(c.values())}
    left = min((min(k for k, v in c.items() if v) for c in used.values()), default=0)
    wide = lambda c: [c.get(i, "") for i in range(left, max(c, default=-1) + 1)]
    return [wide(cells.get(r, {})) for r in range(min(used, default=0), max(used, default=-1) + 1)]


def _xls(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Sheets of an Excel 5 to 2003 workbook."""
    file = Compound(data)
    if "EncryptedPackage" in file.entries:
        raise Encrypted("encrypted workbook")
    stream = file.stream("Workbook" if "Workbook" in file.entries else "Book")
    shared, sheets, unicode = [], [], True
    for kind, parts in _records(stream):
        body = parts[0]
        if kind == 0x0809 and not sheets:
            unicode = struct.unpack_from("<H", body)[0] >= 0x0600
        elif kind == 0x002F:
            raise Encrypted("encrypted workbook")
        elif kind == 0x0085 and body[5] == 0:  # a sheet of cells
            name = _Strings([body[6:]]).text("<B") if unicode else cp1252(body[7 : 7 + body[6]])
            sheets.append((name, struct.unpack_from("<I", body)[0]))
        elif kind == 0x00FC:
            strings = _Strings(parts)
            n = struct.unpack_from("<II", strings.take(8))[1]
            shared = [strings.text() for _ in range(n)]
        elif kind == 0x000A:
            break
    return [(name, _xls_rows(stream, at, shared, unicode)) for name, at in sheets]


def spreadsheet_text(data: bytes) -> str:
    """A line a row, tabs between cells; with several sheets each begins with its name."""
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        return _lines(_xls(data))
    with zipfile.ZipFile(BytesIO(data)) as z:
        return _lines(list((_ods if "content.xml" in z.namelist() else _xlsx)(z)))


def _lines(sheets: list[tuple[str, Iterable[list[str]]]]) -> str:
    out, size = [], 0
    for name, rows in sheets:
        out += [name] if len(sheets) > 1 else []
        for row in rows:
            out.append("\t".join(re.sub(r"[\t\r\n]", " ", c) for c in row).rstrip("\t"))
            size += len(out[-1]) + 1
            if size > MAX_TEXT:
                return "\n".join(out)
        out.append("")
    return "\n".join([*out, ""])


# ---- legacy Word ------------------------------------------------------------------


class Compound:
    """Streams of a compound (OLE) file."""

    END = 0xFFFFFFFA

    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
            raise ValueError("not a compound file")
        self.data, self.sector, self.mini = data, 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, _, self.cutoff, first_mini, _, at, _ = struct.unpack_from("<7I", data, 48)
        fat = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while at < self.END and at not in seen:
            seen.add(at)
            *more, at = struct.unpack(f"<{self.sector // 4}I", self._block(at))
            fat += more
        self.fat = self._ints(b"".join(self._block(s) for s in fat if s < self.END))
        self.mini_fat = self._ints(self._chain(first_mini, self.fat, self._block))
        self.entries = {}
        table = self._chain(first_dir, self.fat, self._block)
        for i in range(0, len(table) - 127, 128):
            length = struct.unpack_from("<H", table, i + 64)[0]
            name = table[i : i + max(length - 2, 0)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<II", table, i + 116)
            self.entries.setdefault("/" if table[i + 66] == 5 else name, (start, size))
        self.small = self._chain(self.entries["/"][0], self.fat, self._block)

    @staticmethod
    def _ints(data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])

    def _block(self, i: int) -> bytes:
        return self.data[(i + 1) * self.sector : (i + 2) * self.sector]

    def _chain(self, at: int, links: tuple[int, ...], block: Callable[[int], bytes]) -> bytes:
        out, left = [], len(links)
        while at < len(links) and left:
            out.append(block(at))
            at, left = links[at], left - 1
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        start, size = self.entries[name]
        if size < self.cutoff:
            return self._chain(start, self.mini_fat, lambda i: self.small[i * self.mini : (i + 1) * self.mini])[:size]
        return self._chain(start, self.fat, self._block)[:size]


# Control characters of Word text, and what stands for them; others have no text. Fixed values.
WORD_MARKS = {c: None for c in range(32)} | {ord(c): "\n" for c in "\r\n\x0b\x0c\x0e"} | {7: "\t", 9: "\t", 0x1E: "-"}
# A field is its instruction between the marks 13 and 14 and its result up to the mark 15.
_FIELD = re.compile("\x13[^\x13-\x15]*(?:\x14([^\x13-\x15]*))?\x15")
_FIELD_IN_INSTRUCTION = re.compile("(\x13[^\x13-\x15]*)\x13[^\x13-\x15]*(?:\x14([^\x13-\x15]*))?\x15")


def clean_word(raw: str) -> str:
    """Text without field instructions, with control characters replaced; of a field in an instruction the result stays."""
    n = 1
    while n:
        raw, inner = _FIELD_IN_INSTRUCTION.subn(lambda m: (m[2] or "") + m[1], raw)
        raw, outer = (raw, 0) if inner else _FIELD.subn(lambda m: m[1] or "", raw)
        n = inner + outer
    return re.sub("\x13[^\x13-\x15]*", "", raw).translate(WORD_MARKS)


def word_text(data: bytes) -> str:
    """Text of a Word 97-2003 file, by its piece table."""
    file = Compound(data)
    head = file.stream("WordDocument")
    magic, flags = struct.unpack_from("<H8xH", head)
    if magic != 0xA5EC:
        raise ValueError("not a Word document")
    if flags & 0x100:
        raise Encrypted("encrypted document")
    at, size = struct.unpack_from("<II", head, 0x1A2)
    table = file.stream("1Table" if flags & 0x200 else "0Table")[at : at + size]
    while table[:1] == b"\x01":
        table = table[3 + struct.unpack_from("<H", table, 1)[0] :]
    if table[:1] != b"\x02":
        raise ValueError("missing piece table")
    n = (struct.unpack_from("<I", table, 1)[0] - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", table, 5)
    out = []
    for i, (low, high) in enumerate(zip(ends, ends[1:])):
        place = struct.unpack_from("<I", table, 5 + 4 * (n + 1) + 8 * i + 2)[0]
        count = max(high - low, 0)
        if place & 0x40000000:
            begin = (place & 0x3FFFFFFF) // 2
            out.append(cp1252(head[begin : begin + count]))
        else:
            out.append(head[place : place + 2 * count].decode("utf-16-le", "replace"))
    return clean_word("".join(out))


# ---- PDF -----------------------------------------------------------------------


class Pdf:
    """Objects of a PDF file by number, found by their headers; enough for text of ordinary files."""

    def __init__(self, data: bytes) -> None:
        if b"%PDF" not in data[:1024]:
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s*(\d+\s+\d+\s+R|<<)", data):
            raise Encrypted("encrypted document")
        self.objects: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            self.objects[int(m[1])] = m[2].strip()
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body[:400]):
                self._unpack(body)
        if not self.objects:
            raise ValueError("no objects")

    def _unpack(self, body: bytes) -> None:
        inner, first = self.content(body), int(re.search(rb"/First\s+(\d+)", body)[1])
        numbers = [int(x) for x in inner[:first].split()]
        places = [*numbers[1::2], len(inner) - first]
        for number, low, high in zip(numbers[::2], places, places[1:]):
            self.objects.setdefault(number, inner[first + low : first + high].strip())

    @staticmethod
    def content(body: bytes) -> bytes:
        """The bytes of a stream object; those of filters other than Flate are left out."""
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        head = body[: m.start()]
        if b"/FlateDecode" in head or b"/Fl " in head:
            return zlib.decompressobj().decompress(m[1], 64 * MIB)
        return b"" if b"/Filter" in head else m[1]

    def value(self, body: bytes, key: str) -> bytes:
        """The value after a key: a referenced object, a dictionary, an array, or a word."""
        m = re.search(rb"/" + key.encode() + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := re.match(rb"(\d+)\s+\d+\s+R", rest):
            return self.objects.get(int(ref[1]), b"")
        if rest.startswith(b"["):
            return rest[: rest.find(b"]") + 1]
        if rest.startswith(b"<<"):
            depth = 0
            for t in re.finditer(rb"<<|>>", rest):
                depth += 1 if t[0] == b"<<" else -1
                if not depth:
                    return rest[: t.end()]
        return re.match(rb"[^\s/>]*", rest)[0]

    def pages(self) -> Iterator[bytes]:
        """Page objects in the order of the page tree; in that of the file where there is none."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        todo, seen = [(self.value(root, "Pages"), b"")], 0
        while todo and seen <= len(self.objects):
            node, inherited = todo.pop()
            seen += 1
            fonts = self.value(self.value(node, "Resources"), "Font") or inherited
            kids = self.value(node, "Kids")
            if kids:
                todo += [(self.objects.get(int(k), b""), fonts) for k in reversed(re.findall(rb"(\d+)\s+\d+\s+R", kids))]
            elif node:
                yield fonts, node

    def characters(self, font: bytes) -> tuple[int, dict[int, str]]:
        """(bytes a code, code to text) of a font."""
        source = self.content(self.value(font, "ToUnicode"))
        wide = 2 if re.search(rb"/Subtype\s*/Type0", font) else 1
        out: dict[int, str] = {}
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", source, re.S):
            out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", source, re.S):
            for a, b, many, one in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:\[(.*?)\]|<([0-9A-Fa-f]+)>)", block, re.S):
                low, high = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
                if one:
                    start = text(one)
                    out |= {low + i: start[:-1] + chr(min(ord(start[-1:] or "\0") + i, 0x10FFFF)) for i in range(high - low + 1)}
                else:
                    out |= {low + i: text(h) for i, h in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many))}
        return wide, out


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OPERATION = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]+|-?[0-9.]+|[A-Za-z'\"*]+|[\[\]]", re.S)


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    undo = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r\n") else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"(?s)\\([0-7]{1,3}|\r\n|.)", undo, token[1:-1])


def pdf_text(data: bytes) -> str:
    """Text of the pages in order: shown strings, with line breaks where the position moves to another line."""
    pdf, out = Pdf(data), []
    known: dict[bytes, tuple[int, dict[int, str]]] = {}
    for fonts, page in pdf.pages():
        contents = pdf.value(page, "Contents")
        parts = [pdf.objects.get(int(r), b"") for r in re.findall(rb"(\d+)\s+\d+\s+R", contents)] if contents.startswith(b"[") else [contents]
        wide, codes = 1, {}
        stack: list[bytes] = []
        for m in _OPERATION.finditer(b"\n".join(map(pdf.content, parts))):
            token = m[0]
            if token[:1] in b"(</[]-.0123456789":
                stack.append(token)
                continue
            if token == b"Tf" and len(stack) > 1:
                font = pdf.value(fonts, stack[-2][1:].decode("latin-1"))
                if font not in known:
                    known[font] = pdf.characters(font)
                wide, codes = known[font]
            elif token in (b"T*", b"'", b'"', b"ET") or (token in (b"Td", b"TD") and stack and stack[-1].strip(b"-0.") != b""):
                out.append("\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                for t in stack:
                    if t[:1] in b"(<":
                        raw = _string(t)
                        each = [int.from_bytes(raw[i : i + wide]) for i in range(0, len(raw), wide)]
                        out.append("".join(codes.get(c, "" if wide > 1 else cp1252(bytes([c]))) for c in each))
                    elif t[:1] in b"-" and token == b"TJ" and len(t) > 3 and float(t) < -180:
                        out.append(" ")
            stack = []
        out.append("\n")
    return re.sub(r"\n{3,}", "\n\n", "".join(out).replace("\f", "\n")).strip("\n")
