"""Units of measure: strings segmented by dynamic programming over tries, and quantities read from free text."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from stillroom.functions.unicode import simple_plain

# Prefixes with their power of ten. Short ones go with short roots, long ones with long roots.
PREFIXES = {"m": -3, "c": -2, "d": -1, "h": 2, "k": 3, "milli": -3, "mili": -3, "centi": -2, "deci": -1, "hecto": 2, "hekto": 2, "kilo": 3}
# Roots as (dimension, size in the dimension's base unit, takes prefixes). Base units: ml, EUR cent (and lipa), g, mm, minute, percent.
ROOTS = {
    "l": ("volume", "1000", True), "lt": ("volume", "1000", False), "ltr": ("volume", "1000", False), "lit": ("volume", "1000", False),
    "liter": ("volume", "1000", True), "litre": ("volume", "1000", True), "litra": ("volume", "1000", True), "litara": ("volume", "1000", True), "litar": ("volume", "1000", True),
    "liters": ("volume", "1000", True), "litres": ("volume", "1000", True), "litri": ("volume", "1000", True), "litru": ("volume", "1000", True),
    "oz": ("volume", "29.5735", False), "floz": ("volume", "29.5735", False), "usfloz": ("volume", "29.5735", False), "usoz": ("volume", "29.5735", False), "ounce": ("volume", "29.5735", False), "fluidounce": ("volume", "29.5735", False), "fluidounces": ("volume", "29.5735", False),
    "ccm": ("volume", "1", False), "cc": ("volume", "1", False), "pint": ("volume", "473.176", False), "pints": ("volume", "473.176", False), "quart": ("volume", "946.352", False), "quarts": ("volume", "946.352", False), "gal": ("volume", "3785.408", False), "gallon": ("volume", "3785.408", False), "gallons": ("volume", "3785.408", False),
    "eur": ("eur", "100", False), "euro": ("eur", "100", False), "eura": ("eur", "100", False), "euros": ("eur", "100", False), "€": ("eur", "100", False),
    "c": ("eur", "1", False), "ct": ("eur", "1", False), "cent": ("eur", "1", False), "cents": ("eur", "1", False), "centi": ("eur", "1", False), "centa": ("eur", "1", False), "¢": ("eur", "1", False),
    "hrk": ("hrk", "100", False), "kn": ("hrk", "100", False), "kuna": ("hrk", "100", False), "kune": ("hrk", "100", False),
    "lp": ("hrk", "1", False), "lipa": ("hrk", "1", False), "lipe": ("hrk", "1", False),
    "g": ("mass", "1", True), "gram": ("mass", "1", True), "t": ("mass", "1000000", True), "m": ("length", "1000", True), "meter": ("length", "1000", True), "metre": ("length", "1000", True),
    "h": ("time", "60", False), "min": ("time", "1", False), "%": ("share", "1", False),
}
EXPONENTS = {"2": 2, "3": 3, "²": 2, "³": 3, "^2": 2, "^3": 3}
# Field-dimension priors, as log weights: what a field is likely to state.
PRIORS = {"volume": {"volume": 0.0, "mass": -3.0, "length": -4.0, "time": -4.0, "eur": -6.0, "hrk": -6.0, "share": -5.0}, "price": {"eur": 0.0, "hrk": -0.1, "volume": -6.0, "mass": -7.0, "length": -8.0, "time": -8.0, "share": -5.0}}
HRK_PER_EUR = Fraction("7.53450")


def trie(words) -> dict:
    top: dict = {}
    for w in words:
        node = top
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return top


PREFIX_TRIE, ROOT_TRIE, EXPONENT_TRIE = trie(PREFIXES), trie(ROOTS), trie(EXPONENTS)
#: No reading is longer.
LONGEST = sum(max(map(len, words)) for words in (PREFIXES, ROOTS, EXPONENTS))


def ends(node: dict, text: str, start: int):
    """(end, word) of each word of the trie that starts at ``start``."""
    for i in range(start, len(text)):
        node = node.get(text[i])
        if node is None:
            return
        if "" in node:
            yield i + 1, node[""]


def segment(unit: str, field: str) -> tuple[str, Fraction] | None:
    """The best reading of a unit string as prefix, root and exponent: (dimension, size in base units), or None if there is none.

    Dynamic programming over (position, parts read): each state keeps the best score of a reading up to it. The score is the field's prior of the
    dimension, less a cost for each part, for a prefix and root of unequal style and for leaving a whole-word root unread.
    """
    text = re.sub(r"[\s.]+", "", unit.lower())
    if not text or len(text) > LONGEST:
        return None
    best: dict[tuple[int, int], tuple[float, str, str, str]] = {(0, 0): (0.0, "", "", "")}

    def offer(at: tuple[int, int], score: float, *parts: str) -> None:
        if at not in best or best[at][0] < score:
            best[at] = (score, *parts)

    for end, p in ends(PREFIX_TRIE, text, 0):
        offer((end, 1), -0.5, p, "", "")
    finals: list[tuple[float, str, str, str]] = []
    for (pos, stage), (score, p, _, _) in list(best.items()):
        for end, root in ends(ROOT_TRIE, text, pos):
            dimension, _, takes = ROOTS[root]
            if stage and not takes:
                continue
            s = score + PRIORS[field][dimension] - 0.2 - (1.0 if p and (len(p) > 1) != (len(root) > 1) else 0.0)
            if end == len(text):
                finals.append((s, p, root, ""))
            elif dimension == "length":
                for last, e in ends(EXPONENT_TRIE, text, end):
                    if last == len(text):  # a cube of a length is a volume
                        finals.append((score + PRIORS[field]["volume" if EXPONENTS[e] == 3 else "length"] - 0.7, p, root, e))
    if not finals:
        return None
    _, p, root, e = max(finals)
    dimension, size, _ = ROOTS[root]
    value = Fraction(size) * Fraction(10) ** PREFIXES.get(p, 0)
    if e:
        return ("volume", value**3 / 1000) if EXPONENTS[e] == 3 else ("area", value**2)
    return dimension, value


# Numbers: a fraction, digits grouped by dots or blanks, or plain digits; each with a decimal part after a comma or dot.
NUMBER = r"\d{1,3}(?:[. ]\d{3})+,\d+|\d+\s?/\s?\d+|\d+(?:[.,]\d+)?"
# Words for a part of a unit.
PART_WORDS = {"pola": Fraction(1, 2), "pol": Fraction(1, 2), "half": Fraction(1, 2), "halbe": Fraction(1, 2), "četvrt": Fraction(1, 4), "cetvrt": Fraction(1, 4), "quarter": Fraction(1, 4)}
# Words after the number of pieces of a pack.
PIECE = r"(?:kom(?:ada|\.)?|pcs|pieces|st(?:k|ück|uck)\.?|boca|bottles|cans|limenki|pack|pak(?:iranje)?)(?![^\W\d_])"
WORD = r"[^\W\d_]+\.?"
CUBE = r"(?:(?<=m)\^?[23²³](?!\w))?"
QUANTITY = re.compile(rf"(?<![\d.,/])(?P<n>{NUMBER})\s*(?P<u>(?:{WORD})(?:\s{WORD}){{0,2}}{CUBE})|(?<!\w)(?P<w>{'|'.join(PART_WORDS)})\s+(?P<v>{WORD})", re.I)
# Of these the ones that a year never stands before.
COUNTED = r"(?:kom(?:ada|\.)?|pcs|pieces|st(?:k|ück|uck)\.?|cans|limenki)(?![^\W\d_])"
# A number of pieces has any number of digits; a bare year in brackets or before a bottle or pack is none.
COUNT, NO_YEAR = r"(?:\d{1,3}(?:\.\d{3})+|\d+)", r"(?!(?:19|20)\d\d(?!\d))"
BEFORE = re.compile(rf"(?<![\d.,])(?:({COUNT})\s*(?:[x×*]|/\s?1(?=\s|x|×)\s*[x×]?|{PIECE}\s*[x×àa])|({COUNT})\s*{COUNTED}|{NO_YEAR}({COUNT})\s*{PIECE})\s*$", re.I)
AFTER = re.compile(rf"^\s*(?:[x×*]\s*({COUNT})(?![\d.,]*\d)(?!\s?/)|[(\[]?\s*({COUNT})\s*{COUNTED}\s*[)\]]?|[(\[]?\s*{NO_YEAR}({COUNT})\s*{PIECE}\s*[)\]]?|[(\[]\s*(?:[x×]\s*({COUNT})|{NO_YEAR}({COUNT})|({COUNT})\s*(?:/\s?1|[x×]))\s*(?:/\s?1|[x×])?\s*[)\]])", re.I)
# Packs of packs.
OUTER, FURTHER = re.compile(rf"(?<![\d.,])({COUNT})\s*[x×*]\s*$"), re.compile(rf"^\s*[x×*]\s*({COUNT})(?![\d.,]*\d)(?!\s?/)")
# Digits grouped by thousands, as only a number of small units has them.
GROUPED = re.compile(r"[1-9]\d{0,2}(?:[.,]\d{3})+")


def count(found: re.Match) -> int:
    """The number of a pack pattern's one group that matched."""
    return int(next(g for g in found.groups() if g).replace(".", ""))


def number(text: str) -> Fraction:
    if "/" in text:
        a, b = text.split("/")
        return Fraction(int(a), int(b)) if int(b) else Fraction(0)
    t = text.replace(" ", "")
    if "," in t:
        t = t.replace(".", "").replace(",", ".")
    return Fraction(t)


def half_up(x: Fraction) -> int:
    return int((Decimal(x.numerator) / Decimal(x.denominator)).quantize(Decimal(1), ROUND_HALF_UP)) if x.denominator > 1 else x.numerator


def contents(text: str, cache: dict) -> list[tuple[int, int, int, int]]:
    """(start, end, ml of a piece, pieces) of every content that a plain text states."""
    out, at = [], 0
    while m := QUANTITY.search(text, at):
        at = m.start("v") if m["w"] else m.start("u")  # words that are no unit may begin another quantity
        if m["w"]:
            value, words, first = PART_WORDS[m["w"].lower()], [m["v"]], m.start("v")
        else:
            value, words, first = number(m["n"]), None, m.start("u")
        end, size = 0, None
        spans = list(re.finditer(rf"{WORD}{CUBE}", text[first : m.end()])) if words is None else [re.match(rf"{WORD}", text[first : m.end()])]
        for k in range(len(spans), 0, -1):
            unit = text[first : first + spans[k - 1].end()]
            if unit not in cache:
                cache[unit] = segment(unit, "volume")
            if cache[unit] and cache[unit][0] == "volume":
                end, size = first + spans[k - 1].end(), cache[unit][1]
                break
        if size is None or not value:
            continue
        if size == 1 and m["n"] and GROUPED.fullmatch(m["n"]):
            value = Fraction(re.sub(r"[.,]", "", m["n"]))
        start, pieces = m.start(), 1
        if b := BEFORE.search(text, 0, start):
            start, pieces = b.start(), count(b)
            while b := OUTER.search(text, 0, start):
                start, pieces = b.start(), pieces * count(b)
        elif a := AFTER.match(text[end:]):
            pieces, end = count(a), end + a.end()
            while a := FURTHER.match(text[end:]):
                pieces, end = pieces * count(a), end + a.end()
        at, ml = end, half_up(value * size)
        if ml > 0 and pieces > 0:
            out.append((start, end, ml, pieces))
    return out


AMOUNT = re.compile(r"(?P<p>[€$¢]|[^\W\d_]+)?\s*(?P<n>\d{1,3}(?:[. ]\d{3})+(?:,\d+)?|\d+(?:[.,]\d+)?)\s*(?P<s>[€$¢]|[^\W\d_]+)?")


def cents(text: str, currency: str | None, cache: dict) -> int | None:
    """The EUR cents that a plain price text states. The EUR amount wins if two are stated; a bare number is in ``currency`` (EUR if that is null or unknown)."""
    bare, hrk, eur = None, None, None
    for m in AMOUNT.finditer(text):
        n = m["n"].replace(" ", "")
        n = n.replace(".", "").replace(",", ".") if "," in n or re.fullmatch(r"\d{1,3}(\.\d{3})+", n) else n
        value, known = Fraction(n), None
        for unit in (m["s"], m["p"]):
            if unit and unit not in cache:
                cache[unit] = segment(unit, "price")
            if unit and cache[unit] and cache[unit][0] in ("eur", "hrk"):
                known = cache[unit]
                break
        if known is None:
            bare = value if bare is None else bare
        elif known[0] == "eur":
            eur = value * known[1] if eur is None else eur
        else:
            hrk = value * known[1] / HRK_PER_EUR if hrk is None else hrk
    if eur is None:
        eur = hrk
    if eur is None and bare is not None:
        eur = bare * 100 / (HRK_PER_EUR if (currency or "").strip().upper() in ("HRK", "KN") else 1)
    return None if eur is None else half_up(eur)


def stated(title: str | None, metadata: str | None, cache: dict) -> tuple[int | None, int | None]:
    """(ml of a piece, pieces) stated by the title or else by the metadata; a pack stated by either one counts."""
    found = [c for text in (title, metadata) if text for c in contents(simple_plain(text), cache)[:1]]
    if not found:
        return None, None
    packs = [c for c in found if c[3] > 1]
    return (packs or found)[0][2:]
