"""Markdown as styled text: (text, style) runs of a preview, by blocks of lines and then spans within them."""

from __future__ import annotations

import re

# Fixed values of the display.
BULLET, RULE, DONE, OPEN, INDENT = "•  ", "──────────", "☑ ", "☐ ", "    "
_SPAN = re.compile(
    r"`(?P<code>[^`]+)`|\*\*(?P<bold>.+?)\*\*|__(?P<bold2>.+?)__|~~(?P<strike>.+?)~~|\*(?P<italic>[^*\s][^*]*)\*"
    r"|(?<!\w)_(?P<italic2>[^_]+)_(?!\w)|!?\[(?P<link>[^\]]*)\]\([^)]*\)|\\(?P<plain>[^\w\s])"
)
_ITEM = re.compile(r"^(?P<indent>\s*)(?:[-*+]|(?P<number>\d{1,9})[.)])\s+(?:\[(?P<box>[ xX])\]\s+)?(?P<rest>.*)$")
_HEADING, _FENCE, _RULE_LINE, _TABLE_LINE = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*$"), re.compile(r"^ {0,3}(```+|~~~+)"), re.compile(r"^ {0,3}([-*_])(\s*\1){2,}\s*$"), re.compile(r"^\s*\|?[\s:|-]*-[\s:|-]*\|[\s:|-]*$")
Run = tuple[str, str]


def spans(text: str, style: str = "") -> list[Run]:
    """Runs of a line; styles inside others are joined by blanks."""
    out, at = [], 0
    for m in _SPAN.finditer(text):
        out.append((text[at : m.start()], style))
        name, at = m.lastgroup.rstrip("2"), m.end()
        inner = f"{style} {name}".strip() if name != "plain" else style
        out += [(m[m.lastgroup], inner)] if name in ("code", "plain") else spans(m[m.lastgroup], inner)
    return [r for r in [*out, (text[at:], style)] if r[0]]


def render(source: str) -> list[Run]:
    """Runs of text with their styles: h1 to h3, bold, italic, strike, code, quote, link, item."""
    out: list[Run] = []
    lines, i, paragraph, in_list = source.splitlines(), 0, [], False

    def flush() -> None:
        if paragraph:
            out.extend([*spans(" ".join(paragraph)), ("\n\n", "")])
            paragraph.clear()

    while i < len(lines):
        line, i = lines[i], i + 1
        item = _ITEM.match(line)
        if in_list and not item:
            out.append(("\n", ""))
            in_list = False
        if fence := _FENCE.match(line):
            flush()
            end = next((k for k in range(i, len(lines)) if lines[k].strip().startswith(fence[1])), len(lines))
            out += [("".join(f"{x}\n" for x in lines[i:end]), "code"), ("\n\n", "")]
            i = end + 1
        elif heading := _HEADING.match(line):
            flush()
            out += [*spans(heading[2], f"h{min(len(heading[1]), 3)}"), ("\n\n", "")]
        elif _RULE_LINE.match(line):
            flush()
            out.append((f"{RULE}\n\n", ""))
        elif item:
            flush()
            in_list = True
            marker = f"{item['number']}. " if item["number"] else BULLET
            box = "" if item["box"] is None else OPEN if item["box"] == " " else DONE
            out += [(INDENT * (len(item["indent"]) // 2) + marker, "item"), *([(box, "item")] if box else []), *spans(item["rest"], "item"), ("\n", "")]
        elif line.lstrip().startswith(">"):
            flush()
            out += [*spans(line.lstrip()[1:].strip(), "quote"), ("\n\n", "")]
        elif i < len(lines) and "|" in line and _TABLE_LINE.match(lines[i]):
            flush()
            table = [line]
            for row in lines[i + 1 :]:
                if "|" not in row:
                    break
                table.append(row)
            i += len(table)
            for row in table:
                for cell in row.strip().strip("|").split("|"):
                    out += [*spans(cell.strip()), ("\t", "")]
                out.append(("\n", ""))
            out.append(("\n", ""))
        elif line.strip():
            paragraph.append(line.strip())
        else:
            flush()
    flush()
    return out


def plain(source: str) -> str:
    return "".join(text for text, _ in render(source))
