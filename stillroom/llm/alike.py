"""Scripts of letters, and which letters look alike: the Unicode consortium's data as Spark's own ICU library carries them."""

from __future__ import annotations

import glob
import os
import struct
import zipfile
from dataclasses import dataclass, field

import regex
from pyspark.find_spark_home import _find_spark_home

from stillroom.functions.unicode import LOOKALIKE

CONFUSABLES = "com/ibm/icu/impl/data/icudata/confusables.cfu"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Scripts that are written together, as one.
TOGETHER = {"HANI": ("HANB", "JPAN", "KORE"), "HIRAGANA": ("JPAN",), "KATAKANA": ("JPAN",), "HANGUL": ("KORE",), "BOPOMOFO": ("HANB",)}


def prototypes(path: str | None = None) -> dict[str, str]:
    """For each character that looks like another text that text: the prototype map of the confusables data (UTS 39), read from Spark's icu4j library.

    The file: a header whose first two bytes give its size, then offsets and counts of three tables: keys (character in the low 24 bits, length less one in
    the high 8), values (a character, or the place of a longer text) and the longer texts, all big-endian.
    """
    found = glob.glob(path or os.path.join(_find_spark_home(), "jars", "icu4j-*.jar"))
    if not found:
        raise FileNotFoundError("no icu4j library among Spark's jars; name one that holds the confusables data")
    with zipfile.ZipFile(found[0]) as jar:
        raw = jar.read(CONFUSABLES)
    data = raw[struct.unpack_from(">H", raw)[0] :]
    keys_at, n, values_at, n_values, texts_at, n_texts = struct.unpack_from(">6i", data, 12)
    keys, values = struct.unpack_from(f">{n}I", data, keys_at), struct.unpack_from(f">{n_values}H", data, values_at)
    texts = data[texts_at : texts_at + 2 * n_texts]

    def text(value: int, length: int) -> str:
        return chr(value) if length == 1 else texts[2 * value : 2 * (value + length)].decode("utf-16-be")

    return {chr(k & 0xFFFFFF): text(v, (k >> 24) + 1) for k, v in zip(keys, values, strict=True)}


def script_patterns() -> list[tuple[str, regex.Pattern]]:
    from regex._regex_core import PROPERTIES

    names: dict[int, str] = {}
    for name, number in PROPERTIES["SCRIPTEXTENSIONS"][1].items():
        if len(name) > len(names.get(number, "")):
            names[number] = name
    return [(name, regex.compile(rf"\p{{Script_Extensions={name}}}")) for name in names.values() if name not in ("COMMON", "INHERITED", "UNKNOWN")]


@dataclass
class Alike:
    """``latin``: letters and the plain Latin letter that each looks like. ``sure``: those of them that have the very shape of a capital or are common doubles;
    only these turn a word that is wholly of another script. ``doubles``: for each prototype the letters that share it, smallest first."""

    latin: dict[str, str] = field(default_factory=dict)
    sure: dict[str, str] = field(default_factory=dict)
    prototype: dict[str, str] = field(default_factory=dict)
    doubles: dict[str, list[str]] = field(default_factory=dict)
    patterns: list[tuple[str, regex.Pattern]] = field(default_factory=script_patterns)
    seen: dict[str, frozenset[str] | None] = field(default_factory=dict)

    def scripts_of(self, c: str) -> frozenset[str] | None:
        """The scripts that a character is used in, with those written together with them; None stands for all (digits, signs, marks)."""
        if c not in self.seen:
            own = {name for name, pattern in self.patterns if pattern.match(c)}
            self.seen[c] = frozenset(own.union(*(TOGETHER.get(s, ()) for s in own))) or None
        return self.seen[c]

    def in_script(self, c: str, script: str) -> str | None:
        """The letter of a script that looks like c and has its case; None if there is none."""
        known = [d for d, plain in LOOKALIKE.items() if plain == c and script in (self.scripts_of(d) or ())]
        like = known + [d for d in self.doubles.get(self.prototype.get(c, c), ()) if script in (self.scripts_of(d) or ())]
        same = [d for d in like if d.isupper() == c.isupper()]
        return same[0] if same else None


TABLES: list[Alike] = []


def alike() -> Alike:
    """The tables, built once on the driver; functions take them along to the workers."""
    if not TABLES:
        TABLES.append(built())
    return TABLES[0]


def built() -> Alike:
    found = Alike(prototype={c: p for c, p in prototypes().items() if c.isalpha()})
    plain: dict[str, list[str]] = {}
    for letter in LETTERS:
        plain.setdefault(found.prototype.get(letter, letter), []).append(letter)
    for c, p in sorted(found.prototype.items()):
        found.doubles.setdefault(p, []).append(c)
        if c.isascii() or p not in plain:
            continue
        # I and l share a prototype: small letters are read as l, others as I.
        letter = next((x for x in plain[p] if x.islower() == c.islower()), plain[p][0])
        found.latin[c] = letter
        if letter.isupper() and not c.islower():
            found.sure[c] = letter
    for p in list(found.doubles):
        if p not in found.doubles[p] and p.isalpha():
            found.doubles[p].insert(0, p)
    found.latin |= LOOKALIKE
    found.sure |= LOOKALIKE
    return found
