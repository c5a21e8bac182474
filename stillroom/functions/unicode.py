"""Characters that look alike or can't be seen, and the plain form of a text.

Plain Python, meant to be called inside Arrow-batched functions; pure ASCII texts return at once.
"""

from __future__ import annotations

import unicodedata

# Letters of other scripts that look like a Latin letter, each with that letter.
CYRILLIC = dict(zip("аеіјорсухѕԁһӏԛԝАВЕЅІЈКМНОРСТУХԌԚԜ", "aeijopcyxsdhlqwABESIJKMHOPCTYXGQW", strict=True))
GREEK = dict(zip("αικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aikvopuxABEZHIKMNOPTYX", strict=True))
ARMENIAN = dict(zip("օսհցզ", "ouhgq", strict=True))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN
# Signs that stand in for the hyphen or the apostrophe.
HYPHENS = "‐‑−˗﹣⁃"
APOSTROPHES = "’‘ʼʹ′´ˈꞌ‛"
SIGNS = dict.fromkeys(HYPHENS, "-") | dict.fromkeys(APOSTROPHES, "'")
# Blank or unseen characters that aren't in category Cf.
UNSEEN = frozenset("͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠎" + "".join(map(chr, range(0xFE00, 0xFE10))))


def kind_of(c: str) -> str:
    """What is wrong with a character taken alone: '', 'invisible', 'space', 'form', 'mark', 'sign' or 'letter' (a look-alike of a Latin letter)."""
    o = ord(c)
    if 0x20 <= o < 0x7F:
        return ""
    if c in LOOKALIKE:
        return "letter"
    if c in SIGNS:
        return "sign"
    category = unicodedata.category(c)
    if category == "Cf" or c in UNSEEN:
        return "invisible"
    if category in ("Zs", "Zl", "Zp", "Cc"):
        return "space"
    if category in ("Mn", "Me"):
        return "mark"
    if 0xFF01 <= o <= 0xFF5E or 0xFB00 <= o <= 0xFB06 or 0x1C4 <= o <= 0x1CC or 0x1F1 <= o <= 0x1F3 or o in (0x132, 0x133) or 0x1D400 <= o <= 0x1D7FF or 0x2160 <= o <= 0x217F:
        return "form"
    return ""


def simple_plain(text: str) -> str:
    """Every form folded, accents joined, unseen characters dropped, every blank a plain space and every look-alike letter Latin unless its
    word holds a letter that only its own script has."""
    if text.isascii():
        return text
    out = []
    for c in text:
        k = kind_of(c)
        if k == "invisible":
            continue
        out.append(" " if k == "space" else unicodedata.normalize("NFKC", c) if k == "form" else SIGNS[c] if k == "sign" else c)
    joined = unicodedata.normalize("NFC", "".join(out))
    if joined.isascii():
        return joined
    words, word = [], []
    for c in joined + "\0":
        if c.isalpha():
            word.append(c)
            continue
        if word:
            words.append(latin_if_alike("".join(word)))
            word = []
        words.append(c)
    return "".join(words)[:-1]


def is_latin(c: str) -> bool:
    return c.isascii() or unicodedata.name(c, "").startswith("LATIN")


def latin_if_alike(word: str) -> str:
    """The word in Latin letters if each of its letters is Latin or a look-alike of one, else the word."""
    if word.isascii():
        return word
    return "".join(LOOKALIKE.get(c, c) for c in word) if all(c in LOOKALIKE or is_latin(c) for c in word) else word


def unaccented(text: str) -> str:
    """Lower case without accents."""
    low = text.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c)).replace("đ", "d").replace("ß", "ss")
