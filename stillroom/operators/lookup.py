"""Titles looked up in the catalogue, suggestions queued once, and words searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillroom.functions.titles import fingerprint

PREFIX = 40


def looked_up(wanted: DataFrame, products: DataFrame) -> DataFrame:
    """(request, shop, product_id, pass) for every requested title (request, shop, title) that a shop's listings hold: equal but for case, else the shortest
    title that begins with the request's first 40 letters; of equals the smallest id. A null or empty request finds nothing.

    Of the listings one row is kept for each whole title and for each beginning of a length that is asked for, combined before the shuffle, so that the joins are
    one to one however many listings begin alike. % and _ in a request stand for themselves.
    """
    asked = wanted.where(F.length(F.trim("title")) > 0).select("request", "shop", F.lower("title").alias("text"), F.lower(F.trim(F.substring("title", 1, PREFIX))).alias("head")).distinct()
    listed = products.where("title is not null").select(F.col("id").alias("product_id"), F.col("source_id").alias("shop"), F.lower("title").alias("text"))
    whole = listed.groupBy("shop", "text").agg(F.min("product_id").alias("product_id"))
    exact = asked.join(whole, ["shop", "text"]).select("request", "shop", "product_id", F.lit(1).alias("pass"))
    # A head shorter than 40 letters begins titles too; a beginning may end in a blank that the request's head has lost, so all lengths up to 40 are kept.
    heads = listed.select("shop", "product_id", F.length("text").alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(PREFIX), F.greatest(F.length("text"), F.lit(1)))), lambda n: F.substring(F.col("text"), F.lit(1), n))).alias("head"))
    shortest = heads.join(asked.select("shop", "head").distinct(), ["shop", "head"], "left_semi").groupBy("shop", "head").agg(F.min(F.struct("length", "product_id")).alias("best"))
    begun = asked.join(shortest, ["shop", "head"]).select("request", "shop", F.col("best.product_id").alias("product_id"), F.lit(2).alias("pass"))
    return exact.unionByName(begun).groupBy("request", "shop").agg(F.min(F.struct("pass", "product_id")).alias("best")).select("request", "shop", "best.product_id", "best.pass")


def seeded(entries: DataFrame, products: DataFrame, matched: DataFrame) -> DataFrame:
    """(group_id, source_id, product_id) of curated groups (group_id, position, source_id, title) as the shops' listings: each entry is looked up, of a shop's several entries the
    first that is found stays, groups of fewer than two shops and those that name a matched listing (product_id) are left out."""
    wanted = entries.select(F.struct("group_id", "position").alias("request"), F.col("source_id").alias("shop"), "title")
    found = looked_up(wanted, products).groupBy("request.group_id", F.col("shop").alias("source_id")).agg(F.min_by("product_id", "request.position").alias("product_id"))
    hit = found.join(matched.select("product_id").distinct(), "product_id", "left_semi").select("group_id").distinct()
    whole = found.groupBy("group_id").agg(F.count("*").alias("shops")).where("shops > 1").select("group_id")
    return found.join(whole, "group_id", "left_semi").join(hit, "group_id", "left_anti")


def queued(suggested: DataFrame, queue: DataFrame, matched: DataFrame) -> DataFrame:
    """(fingerprint, members, jaccard, trigram, suggestion_source) of suggested groups (kind, label, product_id, member, jaccard, trigram) that are new: none of their
    listings is matched (product_id) and their fingerprint isn't in the queue (fingerprint). member is source:url. Groups with one fingerprint are queued once."""
    hit = suggested.join(matched.select("product_id"), "product_id", "left_semi").select("kind", "label").distinct()
    rows = suggested.join(hit, ["kind", "label"], "left_anti").groupBy("kind", "label").agg(fingerprint(F.collect_list("member")).alias("fingerprint"), F.count("*").cast("int").alias("members"), F.max("jaccard").alias("jaccard"), F.max("trigram").alias("trigram"))
    once = rows.groupBy("fingerprint").agg(F.max("members").alias("members"), F.max("jaccard").alias("jaccard"), F.max("trigram").alias("trigram"), F.min("kind").alias("suggestion_source"))
    return once.join(queue.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "members", F.bround("jaccard", 3).alias("jaccard"), F.bround("trigram", 3).alias("trigram"), "suggestion_source")


def text_words(text: Column) -> Column:
    """The distinct words of a text, lower case: what a word index holds."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+"), lambda w: w != ""))


def word_search(products: DataFrame, words: list[str]) -> DataFrame:
    """Listings whose title holds all of the words as whole words."""
    index = text_words(F.col("title"))
    return products.where(F.size(F.array_except(F.array(*[F.lit(w.lower()) for w in words]), index)) == 0) if words else products.limit(0)


def parse_group(text: str) -> tuple[str, int]:
    """('g' or 'p', number) of a group id; raises ValueError for anything else."""
    if len(text) < 2 or text[0] not in "gp" or not text[1:].isdecimal():
        raise ValueError(f"no group id: {text!r}")
    return text[0], int(text[1:])
