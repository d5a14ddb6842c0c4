import io
import struct
import zipfile
import zlib

import pytest

from quarry.sources.decode import extract, extract_udf
from quarry.sources.formats import classified, extension, html_to_text, rtf_to_text, xml_to_text
from quarry.sources.packages import clean_word, natural


def packed(**files: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def word_file(text: str, flags: int = 0) -> bytes:
    """A compound file with one UTF-16 piece and one Windows-1252 piece."""
    head = bytearray(8192)
    struct.pack_into("<H", head, 0, 0xA5EC)
    struct.pack_into("<H", head, 10, flags)
    head[2048 : 2048 + 2 * len(text)] = text.encode("utf-16-le")
    head[6000:6003] = b"\xe9!\r"
    n = len(text)
    pieces = struct.pack("<3I", 0, n, n + 3) + struct.pack("<HIH", 0, 2048, 0) + struct.pack("<HIH", 0, 0x40000000 | 12000, 0)
    table = b"\x01\x02\x00ab\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", head, 0x1A2, 0, len(table))
    return compound(WordDocument=bytes(head), **{"0Table": table})


def compound(**streams: bytes) -> bytes:
    """A compound file of some streams."""
    streams = {k: v.ljust(max(4096, -(-len(v) // 512) * 512), b"\0") for k, v in streams.items()}
    fat, body, entries = [0xFFFFFFFD, 0xFFFFFFFE], b"", [("Root Entry", 5, 0xFFFFFFFE, 0)]
    for name, data in streams.items():
        first, count = len(fat), len(data) // 512
        fat += [first + i + 1 for i in range(count - 1)] + [0xFFFFFFFE]
        body += data
        entries.append((name, 2, first, len(data)))
    directory = b"".join(name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB49xIII", 2 * len(name) + 2, kind, at, size, 0) for name, kind, at, size in entries)
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1".ljust(24, b"\0") + struct.pack("<HHHHH10xI7I", 62, 3, 0xFFFE, 9, 6, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    header += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return header + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + directory.ljust(512, b"\0") + body


def xls_file(*extra: bytes) -> bytes:
    """An old workbook of two sheets; its second shared string goes on in another record, there in wide characters."""
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    bof = rec(0x0809, struct.pack("<HH", 0x0600, 5).ljust(16, b"\0"))
    sst = rec(0x00FC, struct.pack("<II", 3, 3) + struct.pack("<HB", 4, 0) + b"oats" + struct.pack("<HBH", 6, 8, 1) + b"rye")
    sst += rec(0x003C, b"\x01" + " €!".encode("utf-16-le") + bytes(4) + struct.pack("<HB", 1, 1) + "ж".encode("utf-16-le"))
    cell = lambda kind, row, column, body: rec(kind, struct.pack("<HHH", row, column, 0) + body)
    one = bof + cell(0x00FD, 2, 1, struct.pack("<I", 0)) + cell(0x00FD, 2, 2, struct.pack("<I", 1)) + cell(0x0203, 3, 1, struct.pack("<d", 0.1))
    one += cell(0x027E, 3, 2, struct.pack("<i", (1250 << 2) | 3)) + rec(0x00BD, struct.pack("<HHHIHIH", 3, 3, 0, (7 << 2) | 2, 0, (8 << 2) | 2, 4))
    one += cell(0x0006, 5, 1, bytes(6) + b"\xff\xff") + rec(0x0207, struct.pack("<HB", 3, 0) + b"a\tb") + cell(0x0205, 5, 2, b"\x01\x00") + cell(0x0205, 5, 3, b"\x07\x01")
    one += cell(0x0006, 5, 4, struct.pack("<d", 1e21)) + rec(0x000A, b"")
    two = bof + cell(0x00FD, 0, 0, struct.pack("<I", 2)) + rec(0x000A, b"")
    sheet = lambda at, name: rec(0x0085, struct.pack("<IBBBB", at, 0, 0, len(name), 0) + name)
    build = lambda a, b: bof + b"".join(extra) + sheet(a, b"One") + sheet(b, b"Two") + sst + rec(0x000A, b"")
    size = len(build(0, 0))
    return compound(Workbook=build(size, size + len(one)) + one + two)


def pdf_file(extra: bytes = b"") -> bytes:
    shown = zlib.compress(rb"BT /F1 12 Tf 1 0 0 1 0 0 Tm (Hello \(big\)) Tj 0 -14 Td [(wor) -20 (ld) -400 (ag\351in)] TJ ET BT /F2 9 Tf <00010002> Tj ET")
    cmap = b"1 beginbfchar <0001> <006F> endbfchar 1 beginbfrange <0002> <0003> <006B> endbfrange"
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Kids [3 0 R] /Count 1 >> endobj\n"
        b"3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >> endobj\n"
        b"4 0 obj << /Filter /FlateDecode >> stream\n" + shown + b"\nendstream endobj\n5 0 obj << /Subtype /Type1 >> endobj\n"
        b"6 0 obj << /Subtype /Type0 /ToUnicode 7 0 R >> endobj\n7 0 obj << >> stream\n" + cmap + b"\nendstream endobj\n" + extra
    )


SHEET = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1200</v></c></row><row/></sheetData></worksheet>'
XLSX = {
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
    "xl/worksheets/sheet1.xml": SHEET,
    "xl/sharedStrings.xml": "<sst><si><t>Kilimanjaro</t></si></sst>",
}
ODS_VALUES = (
    '<d xmlns:t="t" xmlns:o="o"><t:table t:name="A"><t:table-row><t:table-cell o:value-type="float" o:value="1200.50"><p>1,200.50</p></t:table-cell><t:table-cell o:value-type="date" o:date-value="2024-03-05"><p>5 March</p></t:table-cell>'
    '<t:table-cell o:value-type="boolean" o:boolean-value="true"><p>WAHR</p></t:table-cell><t:table-cell o:value-type="string"><p>as shown</p></t:table-cell></t:table-row></t:table></d>'
)
ODS = '<d xmlns:t="t"><t:table t:name="A"><t:table-row><t:table-cell><p>a</p></t:table-cell><t:table-cell t:number-columns-repeated="9999"/></t:table-row></t:table><t:table t:name="B"/></d>'


@pytest.mark.parametrize(
    "ext,data,text",
    [
        ("docx", packed(**{"word/document.xml": "<w:p>Ferry<w:tab/>dusk &lt; dawn</w:p>", "word/header1.xml": "<w:p>Harbour</w:p>", "x.xml": "no"}), "Ferry\tdusk < dawn\n\nHarbour\n"),
        ("pptx", packed(**{f"ppt/slides/slide{i}.xml": f"<a:p>{i}</a:p>" for i in (10, 2)}), "2\n\n10\n"),
        ("odt", packed(**{"content.xml": "<h>T</h><p>x<s/>y</p>"}), "T\nx y\n"),
        ("fodt", b"<p>flat</p>", "flat\n"),
        ("epub", packed(**{"c10.xhtml": "<p>ten</p>", "c2.XHTML": "<h1>two</h1>"}), "# two\nten"),
        ("xlsx", packed(**XLSX), "Kilimanjaro\t\t1200\n\n\n"),
        ("ods", packed(**{"content.xml": ODS}), "A\na\n\nB\n\n"),
        ("doc", word_file("Caf\x13 HYPERLINK \x14é\x15 €\r"), "Café €\né!\n"),
        ("xls", xls_file(), "One\noats\trye €!\n0.1\t12.5\t7\t8\n\na b\ttrue\t#DIV/0!\t1000000000000000000000\n\nTwo\nж\n\n"),
        ("ods", packed(**{"content.xml": ODS_VALUES}), "1200.5\t2024-03-05\ttrue\tas shown\n\n"),
        ("pdf", pdf_file(), "Hello (big)\nworld agéin\nok"),
        ("rtf", rb"{\rtf1{\fonttbl{\f1 Times;}}\f1 Slow \i river\i0\par Se\'f1or \%s?{\*\y out}}" % b"u8364", "Slow river\nSeñor €"),
        ("html", b"<p>a<script>x</script>", "a"),
    ],
)
def test_every_kind(ext, data, text):
    assert extract(ext, data) == (text, None)


@pytest.mark.parametrize("ext,data,failure", [("pdf", b"%PDF-1.4 broken", "unreadable"), ("pdf", pdf_file(b"trailer << /Encrypt 9 0 R >>"), "encrypted"), ("doc", word_file("x", 0x100), "encrypted"), ("docx", b"PK", "unreadable"), ("xls", b"", "unreadable"), ("xls", xls_file(b"\x2f\x00\x02\x00ab"), "encrypted"), ("xls", compound(EncryptedPackage=b"x"), "encrypted"), ("xls", xls_file()[:1100], "unreadable"), ("png", b"x", "unreadable")])
def test_failures_are_data(ext, data, failure):
    assert extract(ext, data) == (None, failure)


def test_html_layout():
    page = "<title>Tides</title><h2>Morning</h2>\n <p>Low&nbsp;<i>water</i>\n &lt; high</p><ol>\n<li>north<ul><li>pier</ul><li>south</ol>done"
    assert html_to_text(page) == "Tides\n\n## Morning\n\nLow water < high\n\n- north\n  - pier\n- south\n\ndone"
    assert html_to_text("<table><tr><td>x<td>y</tr><tr><th>z</table>w<hr>&hellip;&#8364;<!-- off") == "x · y\nz\n\nw\n\n---\n\n&hellip;€"
    assert html_to_text("<pre>one\n   two</pre>three < four") == "```\none\n   two\n```\n\nthree < four" and html_to_text("") == ""


def test_word_fields():
    assert clean_word("see \x13 REF a \x14page \x13 PAGE \x147\x15.\x15 on") == "see page 7. on"
    assert clean_word("a\x13 IF \x13 X \x14b\x15 = 1 \x14c\x15d\x13 open") == "abcd" and clean_word("\x15x\x14y\x13 n \x15z") == "xyz"


def test_partial_xml_and_marks():
    assert xml_to_text(b"<p>One</p><del>no<x>no</x></del><p>Two <") == "One\nTwo "
    assert rtf_to_text("") == "" and clean_word("a\x07\x1e\x1f\x01b") == "a\t-b"
    assert sorted(["s10.xml", "s2.xml", "t"], key=natural) == ["s2.xml", "s10.xml", "t"]
    assert [extension(n) for n in ("a.TAR.GZ", ".bashrc", "x", "b.Txt")] == ["gz", "", "", "txt"]


def test_classified(spark):
    rows = [("a.txt", 32 << 20), ("b.txt", (32 << 20) + 1), ("c.pdf", 256 << 20), ("d.png", 1), (".txt", 1)]
    found = classified(spark.createDataFrame(rows, "name string, size long"))
    assert [r["kind"] for r in found.collect()] == ["text", None, "pdf", None, None]
    assert classified(spark.createDataFrame(rows, "name string, size long"), False).count() == 2


def test_extraction_as_a_column(spark):
    df = spark.createDataFrame([("txt", b"caf\xe9"), ("pdf", b""), (None, None)], "ext string, data binary")
    assert [tuple(r["x"]) for r in df.select(extract_udf("ext", "data").alias("x")).collect()] == [("café", None), (None, "unreadable"), (None, "unreadable")]


def test_limits(monkeypatch):
    from quarry.sources import decode, limits

    def forever(data):
        while True:
            try:
                sum(range(1000))
            except Exception:
                pass

    quick = limits.limited
    monkeypatch.setattr(decode, "pdf_text", forever)
    monkeypatch.setattr(decode, "limited", lambda: quick(cpu=0.2))
    assert extract("pdf", b"") == (None, "timed-out")
    monkeypatch.setattr(decode, "pdf_text", lambda data: str(bytearray(3 << 30)))
    assert extract("pdf", b"") == (None, "crashed")
    with pytest.raises(limits.TookTooLong), quick(wall=0.1):
        import time

        time.sleep(5)
    monkeypatch.setattr(decode, "pdf_text", lambda data: "fine")
    assert extract("pdf", b"") == ("fine", None)
