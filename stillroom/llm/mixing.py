"""Mixing sources to target shares of tokens: packed blocks, multinomial draws for each output shard, and pseudorandom index permutations."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillroom.sources.tables import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) in tokens of a public byte-level BPE vocabulary, whole texts; a null text has none.

    ``tokenizer`` names the rank file on the driver; it is sent to the executors and loaded once in a Python worker.
    """
    from public_tokenizers import PATTERN

    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [0 if t is None else len(encoding.encode_ordinary(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": n})

    return documents.select("doc_id", "source", "text").where("doc_id is not null").mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def mixed_hash(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of x under a key; wraps around."""
    z = x.astype(np.uint64) + key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. size - 1 sends each index: a four-round Feistel network over the next even power of two, walked on until it
    lands inside. Needs no table, so any executor finds any slot's block by itself."""
    size = np.maximum(size.astype(np.int64), 1)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (mixed_hash(right, key[todo] * 8 + r) & mask[todo])
        x[todo] = (left << half[todo]) | right
        todo &= x >= size.astype(np.uint64)
    return x.astype(np.int64)


@F.pandas_udf(T.LongType())
def permuted_index(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(np.int64), size.to_numpy(np.int64), key.to_numpy(np.int64) & 0xFFFFFFFF))


def packed(sized: DataFrame, bucket_docs: int = 20_000) -> DataFrame:
    """Adds start, the place of a document's first token in the stream of its source's documents.

    Sums go in two levels, so that a source with a third of all documents isn't one task: documents fall by hash into buckets of about
    ``bucket_docs``; buckets get their offsets from their totals, documents theirs within the bucket.
    """
    buckets = max(1, sized.count() // bucket_docs)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    totals = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    offsets = totals.withColumn("offset", F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("source", "bucket", F.coalesce("offset", F.lit(0)).alias("offset"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    return sized.withColumn("inside", inside).join(offsets, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("offset") + F.col("inside")).alias("start"))


def apportioned(shares: list[float], limits: list[int], slots: int) -> list[int]:
    """Whole slots by shares, largest remainders first, each within its limit; what a limit leaves over stays empty."""
    exact = [s / (sum(shares) or 1.0) * slots for s in shares]
    counts = [int(x) for x in exact]
    for k in sorted(range(len(exact)), key=lambda k: (counts[k] - exact[k], k))[: slots - sum(counts)]:
        counts[k] += 1
    return [min(n, most) for n, most in zip(counts, limits, strict=True)]


def split(counts: list[int], size: int, draw: np.random.Generator) -> list[int]:
    """``size`` slots drawn without replacement from counts of sources: how many of each. Source by source by the hypergeometric law; beyond the size that numpy draws
    exactly, by the normal law with its mean and variance."""
    out, rest, need = [], sum(counts), size
    for n in counts:
        rest -= n
        if n + rest < 1_000_000_000:
            x = int(draw.hypergeometric(n, rest, need)) if need and n else 0
        else:
            all_, mean = n + rest, need * n / (n + rest)
            x = round(draw.normal(mean, math.sqrt(max(0.0, mean * (rest / all_) * ((all_ - need) / max(1, all_ - 1))))))
        out.append(max(need - rest, min(x, n, need)))
        need -= out[-1]
    return out


def drawn_slots(spark: SparkSession, counts: list[int], shard_slots: int, seed: int) -> DataFrame:
    """(shard, s, first, n): how many slots of each output shard go to source number s, and how many of its slots come in shards before.

    The shards' counts are multinomial draws given the totals: the totals are halved again and again by draws without replacement, each half by a random number
    of its own place, down to single shards. So every task finds its shards' draws, and what comes before them, without a word from others.
    """
    total = sum(counts)
    shards = max(1, -(-total // shard_slots))
    size = lambda lo, hi: min(hi * shard_slots, total) - lo * shard_slots

    def below(lo: int, hi: int, held: list[int], before: list[int], first: int, last: int) -> Iterator[tuple]:
        if last < lo or first >= hi:
            return
        if hi - lo == 1:
            yield from ((lo, k, b, n) for k, (n, b) in enumerate(zip(held, before, strict=True)) if n)
            return
        mid = (lo + hi) // 2
        left = split(held, size(lo, mid), np.random.default_rng([seed, lo, hi]))
        yield from below(lo, mid, left, before, first, last)
        yield from below(mid, hi, [a - b for a, b in zip(held, left, strict=True)], [a + b for a, b in zip(before, left, strict=True)], first, last)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):  # a range's batch holds consecutive numbers
                rows = below(0, shards, counts, [0] * len(counts), int(batch["id"].iloc[0]), int(batch["id"].iloc[-1]))
                yield pd.DataFrame(rows, columns=["shard", "s", "first", "n"])

    return spark.range(shards).mapInPandas(draw, "shard bigint, s int, first bigint, n bigint")


@dataclass
class Mix:
    """A drawn mix: ``sized`` (documents and their tokens), ``slots`` (drawn slots of each source) and ``chosen``."""

    targets: DataFrame
    sized: DataFrame
    slots: DataFrame
    chosen: DataFrame

    def reached(self) -> DataFrame:
        """(source, target_share, max_repeats, n_documents, available_tokens, used_tokens, reached_share, max_used, slots_drawn): one row for each target."""
        chosen = cut(self.chosen)
        sums = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("used_tokens").alias("used_tokens"), F.max("repeats").alias("max_used"))
        total = chosen.agg(F.sum("used_tokens").alias("n")).collect()[0]["n"]
        available = self.sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
        zero = F.lit(0).cast("bigint")
        return self.targets.select("source", "target_share", "max_repeats").join(available, "source", "left").join(sums, "source", "left").join(self.slots, "source", "left").select(
            "source", "target_share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("n_documents", "available_tokens", "used_tokens")],
            F.coalesce(F.col("used_tokens") / F.lit(float(total or 1)), F.lit(0.0)).alias("reached_share"), *[F.coalesce(c, zero).alias(c) for c in ("max_used", "slots_drawn")],
        )


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 512, shard_slots: int = 4_096, seed: int = 7, tokenizer: str = TOKENIZER) -> Mix:
    """The documents used with how often, and (``Mix.reached``) the share that each source reached.

    chosen (doc_id, source, n_tokens, repeats, used_tokens): repeats is the number of times the most used block of the document is used, and at most
    max_repeats; used_tokens counts its tokens in all blocks drawn.

    The documents of a source, packed end to end, are cut into blocks of ``block_tokens`` (the last one shorter). The slots of the whole mix are apportioned to the
    sources by their shares; each output shard of ``shard_slots`` slots draws its slots' sources from them multinomially. Slot k of a source takes block
    permutation(k mod blocks), a new permutation for each pass, and passes end with max_repeats. Blocks are then joined by index. Shares are off by less than a
    block for each source, and by the shorter last blocks.

    Without ``total_tokens`` the mix is as large as it can be with every source at its share. Targets without documents get nothing and the others' shares are taken
    relative to each other; a source that can't fill its share leaves its slots empty; documents of no target source or without tokens are never used. Empty
    tables give empty results. The targets are a list of sources, read to the driver; documents never are.
    """
    spark = documents.sparkSession
    wanted = {r["source"]: r for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()}
    known = documents.where(F.col("source").isin(list(wanted))) if wanted else documents.limit(0)
    sized = cut(token_counts(known, tokenizer).where("n_tokens > 0"))
    # One row for each source.
    stock = {r["source"]: r["tokens"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    sources = [{"source": s, "share": float(wanted[s]["target_share"]), "cap": int(wanted[s]["max_repeats"]), "blocks": -(-int(stock[s]) // block_tokens)} for s in sorted(stock)]
    whole = sum(x["share"] for x in sources) or 1.0
    most = int(min((x["cap"] * x["blocks"] * whole / x["share"] for x in sources), default=0))
    slots = most if total_tokens is None else max(0, total_tokens // block_tokens)
    counts = apportioned([x["share"] for x in sources], [x["cap"] * x["blocks"] for x in sources], slots)
    table = spark.createDataFrame([(k, x["source"], x["blocks"], n) for k, (x, n) in enumerate(zip(sources, counts, strict=True))], "s int, source string, blocks bigint, slots_drawn bigint")
    drawn = drawn_slots(spark, counts, shard_slots, seed) if sum(counts) else spark.createDataFrame([], "shard bigint, s int, first bigint, n bigint")
    taken = drawn.join(F.broadcast(table), "s").select("s", "source", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("bigint")
    placed = taken.withColumn("block", permuted_index(F.col("slot") % F.col("blocks"), F.col("blocks"), F.abs(F.hash(F.lit(seed), "s", turn)).cast("bigint")))
    uses = placed.groupBy("source", "block").agg(F.count("*").alias("uses"))
    end = F.col("start") + F.col("n_tokens")
    pieces = packed(sized).select("doc_id", "source", "n_tokens", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((end - 1) / block_tokens))).alias("block"))
    within = F.least(F.col("end"), (F.col("block") + 1) * block_tokens) - F.greatest(F.col("start"), F.col("block") * block_tokens)
    used = pieces.withColumn("within", within).join(uses, ["source", "block"])
    chosen = used.groupBy("doc_id", "source", "n_tokens").agg(F.max("uses").alias("repeats"), F.sum(F.col("within") * F.col("uses")).alias("used_tokens"))
    return Mix(targets, sized, table.select("source", "slots_drawn"), chosen)
