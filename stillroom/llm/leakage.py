"""Test items inside training text: a BM25 index with block-max WAND, then verification word by word."""

from __future__ import annotations

import html
import math
import operator
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillroom.functions.unicode import simple_plain
from stillroom.llm.markup import TAG

ESCAPED = re.compile(r"\\[ntr\"'/]")
BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[\s>*/#%;|'!-]*(?=\w)")
INSIDE = re.compile(r"(?<=\w)[-'](?=\w)")
WORD = re.compile(r"[^\W_]+")
ITEM = operator.itemgetter(0)
K1, B, BLOCK = 1.2, 0.75, 32
#: Words of a passage, of which the next one starts so that every run of RUN words lies in one.
RUN, PASSAGE = 13, 26


def words_of(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, spacing, markup, quoting and comment signs; a hyphen inside a word, also before a line break, joins it."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "\\" in text:
        text = ESCAPED.sub(" ", text)
    lines_joined = BROKEN.sub("", simple_lines(text))
    return WORD.findall(INSIDE.sub("", lines_joined).lower())


def simple_lines(text: str) -> str:
    """The plain form of a text, its line breaks kept."""
    return text if text.isascii() else "\n".join(map(simple_plain, text.splitlines()))


class Index:
    """BM25 impacts of test items, each divided by the least score that a run of RUN of its words can have: a passage that holds such a run scores at
    least 1 for its item, so retrieval above 1 loses none. Postings are kept in blocks with their greatest impact."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]]):
        self.items = [(i, w, a) for i, w, a in items if len(w) >= RUN]
        n, df, tf = len(self.items), {}, []
        for _, words, _ in self.items:
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            tf.append(counts)
            for w in counts:
                df[w] = df.get(w, 0) + 1
        mean = sum(len(w) for _, w, _ in self.items) / max(1, n)
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, words, _) in enumerate(self.items):
            impact = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in tf[k].items()}
            least = min(sum(impact[w] for w in set(words[i : i + RUN])) for i in range(len(words) - RUN + 1))
            for w, x in impact.items():
                postings.setdefault(w, []).append((k, x / least))
        self.postings = {w: [(p[i : i + BLOCK], p[min(i + BLOCK, len(p)) - 1][0], max(x for _, x in p[i : i + BLOCK])) for i in range(0, len(p), BLOCK)] for w, p in postings.items()}
        self.most = {w: max(b[2] for b in blocks) for w, blocks in self.postings.items()}
        self.runs: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for k, (_, words, _) in enumerate(self.items):
            for i in range(len(words) - RUN + 1):
                self.runs.setdefault(tuple(words[i : i + RUN]), []).append((k, i))

    def above(self, terms: set[str], least: float = 1 - 1e-9) -> list[int]:
        """Every item whose score for the terms is at least ``least``, by block-max WAND.

        Cursors are kept by item; the pivot is the first item at which the terms' greatest impacts reach ``least``. If the current blocks' maxima don't
        reach it, all cursors skip to the end of the nearest block; else the pivot is scored if all cursors before it stand on it.
        """
        # A cursor: item it stands on, block, place in it, blocks, greatest impact.
        cursors = [[self.postings[t][0][0][0][0], 0, 0, self.postings[t], self.most[t]] for t in terms if t in self.most]
        found: list[int] = []
        while cursors:
            cursors.sort(key=ITEM)
            reach, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                reach += c[4]
                if reach >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item, n = cursors[pivot][0], len(cursors)
            while pivot + 1 < n and cursors[pivot + 1][0] == item:
                pivot += 1
            tops, nearest = 0.0, -1
            for c in cursors[: pivot + 1]:
                b, blocks = c[1], c[3]
                while b < len(blocks) and blocks[b][1] < item:
                    b += 1
                if b < len(blocks):
                    _, last, top = blocks[b]
                    tops += top
                    if nearest < 0 or last < nearest:
                        nearest = last
            if tops < least:  # no item up to the end of the nearest block, and before the next cursor, can reach it
                target = nearest + 1 if nearest >= item else item + 1
                if pivot + 1 < n and cursors[pivot + 1][0] < target:
                    target = cursors[pivot + 1][0]
            elif cursors[0][0] == item:
                if sum(c[3][c[1]][0][c[2]][1] for c in cursors[: pivot + 1]) >= least:
                    found.append(item)
                target = item + 1
            else:
                target = item
            kept = []
            for c in cursors[: pivot + 1]:
                if c[0] < target:  # on to the first posting at or after the target; blocks before it aren't looked into
                    blocks, b, place = c[3], c[1], c[2]
                    while b < len(blocks) and blocks[b][1] < target:
                        b, place = b + 1, 0
                    if b == len(blocks):
                        continue
                    block = blocks[b][0]
                    while block[place][0] < target:
                        place += 1
                    c[0], c[1], c[2] = block[place][0], b, place
                kept.append(c)
            cursors[: pivot + 1] = kept
        return found


def contains(words: list[str], part: list[str]) -> bool:
    n = len(part)
    return bool(part) and any(words[i : i + n] == part for i in range(len(words) - n + 1))


def stretches(most: dict[str, float], words: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest stretches of words that all stand in the index: a run of an item's words never goes beyond one."""
    start, n = 0, len(words)
    while start + RUN <= n:
        # Of the next RUN words the last unknown one is looked for first: no run can begin up to it.
        end = start + RUN - 1
        while end >= start and words[end] in most:
            end -= 1
        if end >= start:
            start = end + 1
            continue
        end = start + RUN
        while end < n and words[end] in most:
            end += 1
        yield start, end
        start = end + 1


def search(index: Index, words: list[str]) -> dict[int, int]:
    """{item: words of the longest verified run} of a document. Its stretches of indexed words are cut into passages that overlap by RUN - 1 words, and every
    passage is a query; one whose terms cannot reach 1 together is passed over."""
    most, best = index.most, {}
    for first, last in stretches(most, words):
        for start in range(first, last - RUN + 1, PASSAGE - RUN + 1):
            end = min(last, start + PASSAGE)
            terms = set(words[start:end])
            if sum(map(most.__getitem__, terms)) < 0.999:
                continue
            candidates = set(index.above(terms))
            if not candidates:
                continue
            for p in range(start, end - RUN + 1):
                for k, q in index.runs.get(tuple(words[p : p + RUN]), ()):
                    if k in candidates and (p == 0 or q == 0 or words[p - 1] != index.items[k][1][q - 1] or best.get(k, 0) < RUN):
                        own, n = index.items[k][1], RUN
                        while p + n < len(words) and q + n < len(own) and words[p + n] == own[q + n]:
                            n += 1
                        best[k] = max(best.get(k, 0), n)
    return best


def leaks(documents: DataFrame, items: DataFrame, shard_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, run_words, item_words, answer_found, leak) for every document that holds at least RUN consecutive words of an item.

    The items, by their nature few, are indexed in shards of at most ``shard_items``; each shard is small enough to be sent to every task, and the
    documents are scanned once for each shard. Documents never move: the search is a map over them, whole texts, of any length and number.

    Null or empty texts and items of fewer than RUN words match nothing; repeated rows give one row. answer_found tells whether the item's answer
    stands in the document too, as consecutive words; leak is 'whole' if all of the passage is there and its answer too, 'passage' if all of it without the answer,
    'part with answer' or 'part'.
    """
    chosen = items.select("item_id", "text", "answer").distinct()
    shards = max(1, math.ceil(chosen.count() / shard_items))
    parts = []
    for s in range(shards):
        rows = chosen.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s).collect()
        part = sorted((r["item_id"], words_of(r["text"]), words_of(r["answer"])) for r in rows)

        def run(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            index = Index(part)
            for batch in batches:
                out = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    words = words_of(text)
                    if len(words) >= RUN:
                        for k, n in search(index, words).items():
                            item_id, own, answer = index.items[k]
                            out.append((doc_id, item_id, n, len(own), contains(words, answer)))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "run_words", "item_words", "answer_found"])

        parts.append(documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(run, "doc_id bigint, item_id bigint, run_words int, item_words int, answer_found boolean"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("item_words").alias("item_words"), F.max("answer_found").alias("answer_found"))
    all_ = F.col("run_words") == F.col("item_words")
    return best.withColumn("leak", F.when(all_ & F.col("answer_found"), "whole").when(all_, "passage").when(F.col("answer_found"), "part with answer").otherwise("part"))
