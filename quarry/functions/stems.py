"""Snowball stems of English and Spanish words, after the published descriptions of both algorithms.

Each language is data: ordered rules of endings, the region they must lie in,
and what replaces them. ``Word`` holds a word with the starts of its regions.
"""

from __future__ import annotations

import re
from functools import lru_cache

EN_VOWELS, ES_VOWELS = "aeiouy", "aeiouáéíóúü"

# English. Fixed values of the published algorithm.
EN_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
EN_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

# Spanish. Fixed values of the published algorithm.
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ES_AGENT = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
ES_GU = "en es éis emos".split()
ES_VERB = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos
eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese
aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras
ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos
iésemos ásemos""".split()
ACUTE = str.maketrans("áéíóú", "aeiou")


def region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def longest(word: str, endings) -> str:
    """The longest of ``endings`` that the word has; '' if none."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


_SHORT = re.compile(r"(?:(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]|[aeiouy][^aeiouy])$", re.S)


@lru_cache(maxsize=1 << 16)
def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in EN_WHOLE:
        return EN_WHOLE[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else region(w, EN_VOWELS)
    r2 = region(w, EN_VOWELS, r1)
    vowel = lambda s: any(c in EN_VOWELS for c in s)
    within = lambda s, e, r: len(s) - len(e) >= r

    end = longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and vowel(w[:-2]):
        w = w[:-1]
    if w in EN_AFTER_1A:
        return w

    end = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: len(w) - len(end)] + "ee" if within(w, end, r1) else w
    elif end and vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.match(w):
            w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in EN_VOWELS:
        w = w[:-1] + "i"

    end = longest(w, EN_STEP2)
    before = w[-len(end) - 1 : -len(end)] if end else ""
    if end and within(w, end, r1) and not (end == "ogi" and before != "l") and not (end == "li" and before not in [*"cdeghkmnrt"]):
        w = w[: -len(end)] + EN_STEP2[end]

    end = longest(w, EN_STEP3)
    if end and within(w, end, r2 if end == "ative" else r1):
        w = w[: -len(end)] + EN_STEP3[end]

    end = longest(w, EN_STEP4)
    if end and within(w, end, r2) and not (end == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(end)]

    if w.endswith("e") and (within(w, "e", r2) or (within(w, "e", r1) and not _SHORT.match(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and within(w, "l", r2):
        w = w[:-1]
    return w.replace("Y", "y")


def _spanish_rv(w: str) -> int:
    if len(w) < 3:
        return len(w)
    first, second = w[0] in ES_VOWELS, w[1] in ES_VOWELS
    if first != second and second:
        return 3
    wanted = (lambda c: c not in ES_VOWELS) if second else (lambda c: c in ES_VOWELS)
    return next((i + 1 for i in range(2, len(w)) if wanted(w[i])), len(w))


def _spanish_suffix(w: str, r1: int, r2: int) -> str | None:
    """The word without its noun, adjective or adverb ending; None if it has none in its region."""

    def also(s: str, *endings: str) -> str:
        e = longest(s, endings)
        return s[: len(s) - len(e)] if e and len(s) - len(e) >= r2 else s

    groups = {
        **{e: "plain" for e in ES_PLAIN}, **{e: "agent" for e in ES_AGENT}, "logía": "log", "logías": "log", "ución": "u", "uciones": "u",
        "encia": "ente", "encias": "ente", "amente": "amente", "mente": "mente", "idad": "idad", "idades": "idad",
        "iva": "ivo", "ivo": "ivo", "ivas": "ivo", "ivos": "ivo",
    }
    end = longest(w, groups)
    kind, stem = groups.get(end), w[: len(w) - len(end)]
    if not end or len(stem) < (r1 if kind == "amente" else r2):
        return None
    if kind in ("log", "u", "ente"):
        return stem + kind
    if kind == "agent":
        return also(stem, "ic")
    if kind == "amente":
        shorter = also(stem, "iv")
        return also(shorter, "at") if shorter != stem else also(stem, "os", "ic", "ad")
    if kind == "mente":
        return also(stem, "ante", "able", "ible")
    if kind == "idad":
        return also(stem, "abil", "ic", "iv")
    return also(stem, "at") if kind == "ivo" else stem


@lru_cache(maxsize=1 << 16)
def spanish(word: str) -> str:
    w = word
    rv, r1 = _spanish_rv(w), region(w, ES_VOWELS)
    r2 = region(w, ES_VOWELS, r1)

    pronoun = longest(w, ES_PRONOUNS)
    if pronoun and len(w) - len(pronoun) >= rv:
        stem = w[: -len(pronoun)]
        form = longest(stem, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if form and len(stem) - len(form) >= rv and (form != "yendo" or stem.endswith("uyendo")):
            w = stem[: -len(form)] + form.translate(ACUTE)

    shorter = _spanish_suffix(w, r1, r2)
    if shorter is None:
        verb = w[rv:]
        end = longest(verb, ES_Y)
        if end and w[: -len(end)].endswith("u"):
            shorter = w[: -len(end)]
        elif end := longest(verb, [*ES_GU, *ES_VERB]):
            shorter = w[: -len(end)]
            if end in ES_GU and shorter.endswith("gu"):
                shorter = shorter[:-1]
    w = w if shorter is None else shorter

    end = longest(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if end:
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(ACUTE)


STEMMERS = (english, spanish)
#: Shortest word with forms, shortest common start of word and stem.
MIN_WORD, MIN_SHARED = 4, 3


def stems(word: str) -> list[tuple[str, str]]:
    """(stem, what word and stem share at the start) by language; those that share too little are left out."""
    if len(word) < MIN_WORD or word.isdigit():
        return []
    out = []
    for stem in dict.fromkeys(s(word) for s in STEMMERS):
        shared = next((i for i, (a, b) in enumerate(zip(word, stem)) if a != b), min(len(word), len(stem)))
        if shared >= MIN_SHARED:
            out.append((stem, word[:shared]))
    return out
