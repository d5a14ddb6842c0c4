"""The query language: words, "phrases", -exclusions, type:, name: and in:."""

from __future__ import annotations

from dataclasses import dataclass, field

from quarry.functions.categories import type_filter


@dataclass
class ParsedQuery:
    words: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    types: list[tuple[str, str]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    #: The last word is still being typed, so it also stands for what it begins.
    typing_last: bool = False

    @property
    def has_terms(self) -> bool:
        return bool(self.words or self.phrases or self.names or self.folders)


def lex(text: str) -> list[tuple[str, bool]]:
    """(token, was quoted): blanks split outside of quotes; an open quote runs to the end."""
    out, now, quoted, inside = [], [], False, False
    for c in text:
        if c == '"':
            inside, quoted = not inside, True
        elif c.isspace() and not inside:
            if now or quoted:
                out.append(("".join(now), quoted))
            now, quoted = [], False
        else:
            now.append(c)
    if now or quoted:
        out.append(("".join(now), quoted))
    return out


#: Keys in English and Spanish. Fixed values.
KEYS = {"type": "type", "tipo": "type", "ext": "type", "in": "in", "en": "in", "name": "name", "nombre": "name"}


def parse(text: str) -> ParsedQuery:
    q, loose = ParsedQuery(), False
    for token, quoted in lex(text):
        token, loose = token.strip(), False
        if not token:
            continue
        if token.startswith("-") and len(token) > 1:
            q.excluded.append(token[1:])
            continue
        key, colon, value = token.partition(":")
        kind = KEYS.get(key.lower()) if colon else None
        value = value.strip()
        if kind == "type":
            q.types += [t for t in [type_filter(value)] if t]
        elif kind == "in":
            q.folders += [value] * bool(value)
        elif kind == "name":
            q.names += [value] * bool(value)
        elif quoted:
            q.phrases.append(token)
        else:
            q.words.append(token)
            loose = True
    q.typing_last = loose and not text[-1:].isspace()
    return q
