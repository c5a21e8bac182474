"""Statistics of a document's text, and trees on them that tell prose from lists, tables and junk."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillroom.llm.boosting import Boosted, fit
from stillroom.llm.markup import TAG

KINDS = ("prose", "list", "table", "junk")
#: The statistics, in the order of the model's columns. The first five are those asked for by name.
STATS = (
    "word_count", "mean_word_length", "symbol_ratio", "line_end_ratio", "common_ratio",
    "n_lines", "mean_line_words", "short_line_ratio", "bullet_ratio", "cell_line_ratio", "cell_regularity", "digit_ratio", "distinct_ratio", "vowel_ratio", "alpha_word_ratio",
    "squeeze_ratio", "longest_word", "bar_ratio", "capital_start_ratio", "sentence_ratio", "odd_letter_ratio", "number_word_ratio", "code_ratio", "mean_cells", "rule_line_ratio",
)
FENCED = re.compile(r"```.*?(?:```|\Z)|<pre>.*?(?:</pre>|\Z)", re.S | re.I)
INDENTED = re.compile(r"(?:(?<=\n)|\A)(?: {4}|\t)[^\n]*(?=[(){}\[\];=<>$:#]|Error|Traceback)[^\n]*")
ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.S | re.I)
CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|\Z)", re.S | re.I)
LINK = re.compile(r"https?://\S+")
BULLET = re.compile(r"^\s*(?:[-*+•·‣▪–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+")
ENDS = re.compile(r"[.!?:;…][\"')\]»”*_]*$")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
GAPS = re.compile(r"\s{2,}")
# Vowels of the corpus' languages.
PLAIN_VOWELS, VOWELS = "aeiouy", "aeiouyäöüáéíóúàèìòùâêîôû"


# What is not letter or digit; words that hold a digit; signs that may stand around a word of letters.
SYMBOLS, DIGITS, NUMBERED = re.compile(r"[\W_]+"), re.compile(r"\d+"), re.compile(r"(?<!\S)[^\s\d]*+\d")
AROUND = ".,;:!?()[]\"'*_"


def cells_of(line: str) -> int:
    """The number of cells that a line falls into by its most frequent separator; 1 if there is none. Commas and semicolons separate without a blank after them."""
    bare = line.strip()
    gaps = len(GAPS.findall(bare)) if "  " in bare or not bare.isascii() or "\t" in bare else 0
    return 1 + max(bare.count("\t"), bare.strip("|").count("|"), bare.count(",") - bare.count(", "), bare.count(";") - bare.count("; "), gaps)


def statistics(text: str | None, common: dict[str, frozenset]) -> list[float]:
    """The statistics of one text, each a finite number. Code is set aside and counted as code_ratio; a text that is code only is judged as it stands.

    Counts are taken over whole strings where they can be, so that Python's loops run over lines and not over letters and words.
    """
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    body = ROW.sub(lambda m: "\n" + "\t".join(c.strip() or " " for c in CELL.findall(m[1])) + "\n", text) if "<tr" in text.lower() else text
    prose = FENCED.sub("\n", body) if "`" in body or "<" in body else body
    if "    " in prose or "\t" in prose:
        prose = INDENTED.sub("", prose)
    code = 1 - len(prose) / len(body) if body else 0.0
    if not prose.strip():
        prose = body
    prose = TAG.sub(" ", prose) if "<" in prose else prose
    prose = html.unescape(prose) if "&" in prose else prose
    plain = LINK.sub("link", prose) if "http" in prose else prose
    lines = [x for x in plain.split("\n") if x.strip()]
    words, spoken = plain.split(), [WORD.findall(x.lower()) for x in lines]
    letters = list(chain.from_iterable(spoken))
    joined = "".join(words)
    n, solid = max(1, len(words)), max(1, len(joined))
    shares = [sum(map(known.__contains__, letters)) / max(1, len(letters)) for known in common.values()]
    line_words = [len(x.split()) for x in lines]
    bulleted = [BULLET.match(x) for x in lines]
    cells = [cells_of(x[m.end() :] if m else x) for x, m in zip(lines, bulleted, strict=True)]
    wide = [c for c in cells if c >= 2]
    regular = max(Counter(wide).values()) if wide else 0
    known_words = frozenset().union(*common.values())
    sentences = sum(1 for own, k in zip(spoken, line_words, strict=True) if k >= 4 and not known_words.isdisjoint(own))
    many = max(1, len(lines))
    packed = plain.encode("utf-8", "replace")
    spelled = "".join(letters)
    vowels = sum(map(spelled.count, PLAIN_VOWELS if spelled.isascii() else VOWELS))
    alpha = sum(map(str.isalpha, words)) + sum(1 for w in words if not w.isalpha() and w.strip(AROUND).replace("-", "").replace("'", "").isalpha())
    numbered = len(NUMBERED.findall(plain)) if DIGITS.search(joined) else 0
    return [
        float(len(words)), len(joined) / n, sum(map(len, SYMBOLS.findall(joined))) / solid, sum(bool(ENDS.search(x.rstrip())) for x in lines) / many, max(shares, default=0.0),
        float(len(lines)), sum(line_words) / many, sum(w <= 5 for w in line_words) / many, sum(map(bool, bulleted)) / many, len(wide) / many, regular / many,
        sum(map(len, DIGITS.findall(joined))) / solid, len(set(plain.lower().split())) / n, vowels / max(1, len(spelled)), alpha / n,
        len(zlib.compress(packed, 6)) / max(1, len(packed)), float(max(map(len, words), default=0)), plain.count("|") / n, sum(x.lstrip()[:1].isupper() for x in lines) / many, sentences / many,
        (0 if joined.isascii() else len(joined) - len(joined.encode("ascii", "ignore"))) / solid, numbered / n, code, sum(cells) / many, sum(not any(map(str.isalnum, x)) for x in lines) / many,
    ]


def weak_labels(s: pd.DataFrame) -> pd.Series:
    """A label where the statistics leave little doubt, else None: the model learns from these and decides the rest. The first rule that holds counts."""
    words, lines, common, sentences = s["word_count"], s["n_lines"], s["common_ratio"], s["sentence_ratio"]
    short = (words > 0) & (lines <= 2) & (s["longest_word"] < 25)
    rules = [
        ("junk", (words >= 15) & (s["distinct_ratio"] < 0.12)),
        ("prose", (common >= 0.25) & (sentences >= 0.5) & (s["mean_line_words"] >= 7)),
        ("prose", (common >= 0.1) & (s["line_end_ratio"] >= 0.2) & (sentences >= 0.3) & (s["mean_line_words"] >= 6) & (s["distinct_ratio"] > 0.2) & (s["alpha_word_ratio"] > 0.7)),
        ("prose", short & (words <= 15) & (s["line_end_ratio"] == 1) & (s["capital_start_ratio"] == 1) & (s["distinct_ratio"] > 0.7) & (s["alpha_word_ratio"] > 0.8)),
        ("prose", short & (words <= 12) & (s["symbol_ratio"] < 0.25) & (s["cell_line_ratio"] == 0) & (s["bar_ratio"] == 0) & ((common >= 0.1) | (words <= 4))),
        ("table", (lines >= 4) & (s["cell_regularity"] >= 0.8) & (s["mean_cells"] >= 2.5) & (sentences < 0.2)),
        ("list", (lines >= 6) & (s["short_line_ratio"] >= 0.85) & (s["cell_line_ratio"] < 0.2) & (sentences < 0.2) & (common < 0.12) & (s["line_end_ratio"] < 0.3) & (s["distinct_ratio"] > 0.2) & (s["vowel_ratio"] > 0.25) & (s["longest_word"] < 35)),
        ("junk", (words > 0) & (s["mean_word_length"] > 30) & (common < 0.05) & (s["cell_line_ratio"] < 0.2)),
        ("junk", (lines <= 3) & (words + s["longest_word"] >= 20) & (common < 0.05) & (sentences < 0.35) & (s["code_ratio"] < 0.2)),
    ]
    return pd.Series(np.select([r.to_numpy() for _, r in rules], [k for k, _ in rules], ""), dtype=object).replace("", None)


def columns(rows: list[list[float]]) -> np.ndarray:
    return np.asarray(rows, dtype=np.float64).reshape(-1, len(STATS))


#: Statistics enter the table under these types.
STAT_SCHEMA = "doc_id bigint, " + ", ".join(f"{s} double" for s in STATS)


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row of statistics for each document row, from its whole text; null and empty texts have zeros.

    ``common_words`` (lang, word) is a list of function words, read to the driver; common_ratio is the best share over its languages, so a wrong or
    missing language label doesn't matter. weak_kind is the label of rows that leave little doubt, null for others.
    """
    common = known_words(common_words)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame(columns([statistics(t, common) for t in batch["text"]]), columns=list(STATS))
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            frame["weak_kind"] = weak_labels(frame)
            yield frame

    return documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(measure, STAT_SCHEMA + ", weak_kind string")


def known_words(common_words: DataFrame) -> dict[str, frozenset]:
    by: dict[str, set] = {}
    for r in common_words.where("word is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), F.lower("word").alias("word")).distinct().collect():
        by.setdefault(r["lang"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in sorted(by.items())}


def train(stats: DataFrame, common: dict[str, frozenset], sample: int = 1_500) -> Boosted:
    """Gradient-boosted trees on weakly labelled documents, at most ``sample`` of each kind and four times as many of prose, and probabilities calibrated on real documents labelled by hand (``labelled_documents``).

    The sample is the documents with the smallest hashes of their id among those with a label: bounded, the same on every run, and drawn from all
    documents. Made-up structural junk and plain sentences, labelled as they are made, are added for kinds and layouts that a small corpus lacks.
    """
    from stillroom.llm.holdout import labelled_documents, made_up

    ranked = stats.withColumn("h", F.xxhash64("doc_id"))
    rows, kinds = [], []
    for kind in KINDS:
        for r in ranked.where(F.col("weak_kind") == kind).orderBy("h", "doc_id").limit(sample * (4 if kind == "prose" else 1)).select(*STATS).collect():
            rows.append(list(r))
            kinds.append(KINDS.index(kind))
    for text, kind in made_up():
        rows.append(statistics(text, common))
        kinds.append(KINDS.index(kind))
    model = fit(columns(rows), np.asarray(kinds), len(KINDS))
    held, kinds_held = labelled_documents("calibration")
    return model.calibrated(columns(held), np.asarray([KINDS.index(k) for k in kinds_held]))


def judged(stats: DataFrame, model: Boosted) -> DataFrame:
    """The statistics with p_prose, p_list, p_table, p_junk and kind, the most probable one."""
    names = [f"p_{k}" for k in KINDS]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = model.probabilities(batch[list(STATS)].to_numpy(np.float64))
            batch[names] = p
            batch["kind"] = [KINDS[k] for k in p.argmax(axis=1)] if len(batch) else pd.Series(dtype=object)
            yield batch

    return stats.drop("weak_kind").mapInPandas(score, STAT_SCHEMA + "".join(f", {n} double" for n in names) + ", kind string")

