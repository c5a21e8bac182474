"""Listing texts as Column expressions: normal form, content, price, links, match keys and set similarities. No Python runs on the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns for packaging and gifts that a normal form leaves out, applied in this order.
PACKAGING = (
    r"\+\s*gb\b", r"\+\s*karton\b", r"\+\s*čaše", r"\+\s*case", r"\+\s*glass", r"\+\s*pack", r"\+\s*box", r"\+\s*cradle", r"\+\s*stalak", r"\+\s*\d+\s*čaš[ea]", r"\bkarton\b",
    r"\bcradle\b", r"\bstalak\b", r"\beco\b", r"\bcooler\b", r"\bice\s*jacket\b", r"\bfridge\b",
)
# Content patterns in order of precedence; groups are pieces (packs only), whole units and decimals, the factor is ml for one of the last group.
CONTENT = (
    (r"(\d+)\s*[x×]\s*(\d+)[,.](\d{3})\s*l\b", "pack3", 1), (r"(\d+)\s*[x×]\s*(\d+)[,.](\d{2})\s*l\b", "pack3", 10), (r"(\d+)\s*[x×]\s*(\d+)[,.](\d)\s*l\b", "pack3", 100),
    (r"(\d+)\s*[x×]\s*(\d+)\s*l\b", "pack", 1000), (r"(\d+)\s*[x×]\s*(\d+)\s*ml\b", "pack", 1), (r"(\d+)\s*[x×]\s*(\d+)\s*cl\b", "pack", 10),
    (r"(\d+)[,.](\d{3})\s*l\b", "decimal", 1), (r"(\d+)[,.](\d{2})\s*l\b", "decimal", 10), (r"(\d+)[,.](\d)\s*l\b", "decimal", 100),
    (r"(\d+)\s*l\b", "single", 1000), (r"(\d+)\s*ml\b", "single", 1), (r"(\d+)\s*cl\b", "single", 10),
)
LEAST_ML, MOST_ML = 10, 50_000
# Words that don't tell products apart when keys are matched, and words that must agree.
NOISE = (
    "whisky", "whiskey", "vodka", "gin", "rum", "tequila", "mezcal", "konjak", "brandy", "cognac", "rakija", "bourbon", "scotch", "liker", "likeri", "pivo", "beer", "vino", "wine", "the", "i", "hrvatska", "original", "yo",
    "kutija", "tuba", "kartonska", "poklon", "pjenušac", "tamno", "pšenično", "alcoholic", "coctail", "cocktail", "koktel", "viljamovka", "bez", "carton", "box", "naked", "bottle",
)
VARIANTS = ("rose", "rosé", "ice", "pink", "noir", "vs", "vsop", "xo")
#: The smaller lists by which matchers are compared.
COMPARED_NOISE, COMPARED_VARIANTS = NOISE[:24], VARIANTS[:5]


def rx(pattern: str) -> str:
    """A pattern whose classes cover all of Unicode."""
    return "(?U)" + pattern


def replaced(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, rx(pattern), by)


def to_ml(c: Column, pattern: str, shifted: str) -> Column:
    """Rewrites amounts as ml by shifting digits in the text: a marked number loses its leading zeros, of which one stays."""
    return F.regexp_replace(replaced(c, pattern, "\u0001" + shifted), "\u00010*(\\d+ml)", "$1")


def normalized_title(title: Column) -> Column:
    """The normal form of a title: lower case, one spelling of contents (ml) and ages (yo), without strengths, packaging and signs. Null stays null."""
    t = F.replace(F.lower(title), F.lit("whiskey"), F.lit("whisky"))
    t = replaced(t, r"\d+[,.]?\d*\s*%", "")
    t = replaced(t, r"\bthe\s+", "")
    t = replaced(t, r"([a-z])(\d+[,.]?\d*)(l|ml|cl)\b", "$1 $2$3")
    t = to_ml(t, r"(\d+)[,.](\d{2})\s*l\b", "$1$20ml")
    t = to_ml(t, r"(\d+)[,.](\d)\s*l\b", "$1$200ml")
    t = to_ml(t, r"(\d+)\s*l\b", "$1000ml")
    t = to_ml(t, r"(\d+)\s*cl\b", "$10ml")
    t = replaced(t, r"(\d+)\s+ml\b", "$1ml")
    for pattern in (r"(\d+)\s*y\.?o\.?", r"(\d+)\s*years?\s*old", r"(\d+)\s*years?"):
        t = replaced(t, pattern, "$1yo")
    t = reduce(lambda c, p: replaced(c, p, ""), PACKAGING, t)
    return F.trim(replaced(replaced(t, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def simple_title(title: Column) -> Column:
    """Lower case, only ASCII letters, digits and blanks kept."""
    return F.lower(F.regexp_replace(F.trim(title), r"(?i)[^a-z0-9\s]", ""))


def content_ml(text: Column) -> Column:
    """The content in ml that a text states: the first pattern in order of precedence whose first occurrence gives 10 to 50000 ml; null if none does.

    Each pattern scans the text once and only if those before it gave nothing; its numbers are cut from what it found. Packs are tried only where a number
    follows a times sign. Numbers may have any length: what overflows is no content.
    """
    low = F.lower(text)

    def amount(pattern: str, kind: str, factor: int) -> Column:
        def of(numbers: Column) -> Column:
            a, b, c = (F.get(numbers, F.lit(i)).try_cast("bigint") for i in range(3))
            thousand = lambda whole, rest: F.try_add(F.try_multiply(whole, F.lit(1000)), rest * factor)
            each = thousand(b, c) if kind == "pack3" else F.try_multiply(b, F.lit(factor)) if kind == "pack" else thousand(a, b) if kind == "decimal" else F.try_multiply(a, F.lit(factor))
            return F.try_multiply(a, each) if kind in ("pack3", "pack") else each

        numbers = F.regexp_extract_all(F.regexp_extract(low, rx(pattern), 0), F.lit(rx(r"(\d+)")), 1)
        return F.get(F.filter(F.transform(F.array(numbers), of), lambda x: x.between(LEAST_ML, MOST_ML)), F.lit(0))

    packs = F.coalesce(*[amount(*c) for c in CONTENT if c[1].startswith("pack")])
    rest = F.coalesce(*[amount(*c) for c in CONTENT if not c[1].startswith("pack")])
    stated = F.coalesce(F.when(low.rlike(rx(r"\d\s*[x×]\s*\d")), packs), rest)
    return F.when(low.rlike(rx(r"\d\s*[mc]?l\b")), stated).cast("int")


def listing_ml(size: Column, title: Column) -> Column:
    """The content by the size field, else by the title."""
    return F.coalesce(content_ml(size), content_ml(title))


def parsed_price(text: Column) -> Column:
    """A price text as decimal(10,2): with dot and comma the dot groups thousands, a lone comma is the decimal sign, a lone dot too; null if it can't be read."""
    bare = F.regexp_replace(text, rx(r"[€$\s]"), "")
    plain = F.when(bare.contains(","), F.replace(F.when(bare.contains("."), F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare), F.lit(","), F.lit("."))).otherwise(bare)
    return F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), plain.try_cast("decimal(10,2)"))


def resolved_url(link: Column, base: Column) -> Column:
    """Absolute links pass, links from the root get the shop's address, others stay as they are."""
    return F.when(link.startswith("http"), link).when(link.startswith("/"), F.concat(base, link)).otherwise(link)


def relative_url(link: Column, base: Column) -> Column:
    """Like ``resolved_url``, and links that are neither absolute nor from the root are joined to the shop's address."""
    return F.when(link.startswith("http"), link).when(link.startswith("/"), F.concat(base, link)).otherwise(F.concat(base, F.lit("/"), link))


def fingerprint(members: Column) -> Column:
    """MD5 of the sorted source:url members of a group."""
    return F.md5(F.array_join(F.array_sort(members), ","))


def match_tokens(normal: Column, noise: tuple[str, ...] = NOISE) -> Column:
    """The words of a normal form that identify a product, in order: without contents, noise and single letters, ages as bare numbers."""
    words = F.filter(F.split(F.coalesce(normal, F.lit("")), " "), lambda w: (w != "") & ~w.rlike(rx(r"^\d+ml$")))
    folded = F.transform(words, lambda w: F.regexp_replace(w, rx(r"^(\d+)yo$"), "$1"))
    return F.filter(folded, lambda w: ~w.isin(*noise) & ((F.length(w) > 1) | w.rlike(rx(r"^\d$"))))


def trigrams(tokens: Column) -> Column:
    """The distinct three-letter pieces of the joined words; a shorter text is its own piece, an empty one has none."""
    text = F.array_join(tokens, " ")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < 3, F.array(text)).otherwise(F.array_distinct(pieces))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements by all elements of two sets; two empty ones are equal, an empty and another one have nothing in common."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements by those of the smaller set; like ``jaccard`` for empty ones."""
    least = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def digits_in(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda w: w.rlike(rx(r"^\d+$")))))


def variants_in(tokens: Column, variants: tuple[str, ...] = VARIANTS) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda w: w.isin(*variants))))
