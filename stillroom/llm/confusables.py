"""Text that looks the same, brought to one spelling by the scripts its words can be written in."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillroom.functions.unicode import SIGNS, kind_of
from stillroom.llm.alike import Alike, alike

# A word: letters with their marks, and the joiners between them.
WORDS = regex.compile(r"[\p{L}\p{M}\u200c\u200d]+")
PICTURE = regex.compile(r"\p{Extended_Pictographic}|\p{Emoji_Modifier}")


def common_scripts(word: str, tables: Alike) -> frozenset[str] | None:
    """The scripts that every character of a word is used in; None if all are of no script."""
    sets = [s for s in map(tables.scripts_of, word) if s is not None]
    return frozenset.intersection(*sets) if sets else None


def resolve(word: str, tables: Alike | None = None) -> str:
    """The word in the one script that can spell it.

    The script sets of its characters are intersected (Script_Extensions; characters of no script count for every one). A word of one script that isn't Latin
    is truly of it and kept, unless each of its letters is a sure double of a Latin one. A Latin word keeps its letters but for those that only look like a
    plain one. If no script is common, the word is mixed: it takes Latin letters if each of its letters is Latin or has a Latin double, else the first script
    in which each letter is at home or has a double; if none can spell all and most letters are Latin, the doubles among the rest are replaced.
    """
    if word.isascii():
        return word
    tables = tables or alike()
    scripts = common_scripts(word, tables)
    if scripts is None or "LATIN" in scripts:
        return "".join(tables.latin.get(c, c) for c in word)
    if scripts:
        letters = [c for c in word if c.isalpha()]
        return "".join(tables.sure.get(c, c) for c in word) if all(c in tables.sure for c in letters) else word
    at_home = lambda c, s: (found := tables.scripts_of(c)) is None or s in found
    if all(at_home(c, "LATIN") or c in tables.latin for c in word):
        return "".join(tables.latin.get(c, c) for c in word)
    present = sorted({s for c in word for s in tables.scripts_of(c) or ()} - {"LATIN"})
    for script in present:
        spelled = [c if at_home(c, script) else tables.in_script(c, script) for c in word]
        if None not in spelled:
            return "".join(spelled)
    latin = sum(at_home(c, "LATIN") for c in word)
    return "".join(tables.latin.get(c, c) for c in word) if latin * 2 > len(word) else word


def joins(before: str, c: str, after: str) -> bool:
    """Whether a joiner changes what is seen: after a sign that drops a vowel, between letters that link, or between pictures."""
    if c not in "\u200c\u200d" or not before:
        return False
    if unicodedata.combining(before) == 9:
        return True
    links = lambda x: bool(x) and unicodedata.bidirectional(x) == "AL"
    if links(before) and (links(after) or c == "\u200d"):
        return True
    return c == "\u200d" and bool(PICTURE.match(before)) and bool(after) and bool(PICTURE.match(after))


def consistent(text: str, tables: Alike | None = None) -> tuple[str, bool]:
    """(the text in one consistent form, whether a character of it had to be replaced). Only a look-alike that stands for a Latin letter counts as replaced."""
    if text.isascii() and text.isprintable():
        return text, False
    tables = tables or alike()
    out, found, before = [], False, ""
    for i, c in enumerate(text):
        kind = kind_of(c)
        if kind == "invisible" and joins(before, c, next((x for x in text[i + 1 : i + 3] if kind_of(x) != "invisible"), "")):
            out.append(c)
            continue
        if kind in ("invisible", "space", "form", "sign") or (kind == "mark" and before.isalpha() and ("LATIN" in (tables.scripts_of(before) or ()) or unicodedata.normalize("NFC", before + c) != before + c)):
            found = True
        if kind == "invisible":
            continue
        out.append(" " if kind == "space" else unicodedata.normalize("NFKC", c) if kind == "form" else SIGNS[c] if kind == "sign" else c)
        before = c
    joined = unicodedata.normalize("NFC", "".join(out))
    if joined.isascii():
        return joined, found
    spelled = WORDS.sub(lambda m: resolve(m[0], tables), joined)
    return spelled, found or any(a != b and b.isascii() for a, b in zip(joined, spelled, strict=True))


def consistent_form(value: Column | str) -> Column:
    """The consistent form of a text, and whether it differs in a character that had to be replaced. The tables travel with the function."""
    tables = alike()

    @F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("found", T.BooleanType())]))
    def form_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([(None, False) if t is None else consistent(t, tables) for t in texts], columns=["form", "found"])

    return form_of(value)


def normalized(df: DataFrame, fields: list[str]) -> DataFrame:
    """Every field in its consistent form: equal-looking values become equal. Nulls stay null, empty texts empty; all rows and columns are kept."""
    return df.withColumns({f: consistent_form(f)["form"] for f in fields})


def disguised(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, form) of the values that hold a character to be replaced. Plain ASCII values are settled in the scan's filter and never reach Python."""
    long = df.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])))
    return long.where(F.col("value").rlike("[^ -~]")).select(key, "field", consistent_form("value").alias("x")).where("x.found").select(key, "field", "x.form").distinct()
