"""Listings matched across shops: exact set-similarity join in buckets, components, one listing for each shop, no listing in two matches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillroom.functions.titles import COMPARED_NOISE, COMPARED_VARIANTS, NOISE, VARIANTS, digits_in, jaccard, match_tokens, normalized_title, overlap, trigrams, variants_in
from stillroom.operators import blocks
from stillroom.operators.blocks import NO_SHOP, chosen, components, firsts, likeness, similar
from stillroom.operators.graph import smallest_label
from stillroom.sources.tables import cut, settled

MATCH, NEAR, OVERLAP_FLOOR = 0.70, 0.37, 0.50


@dataclass(frozen=True)
class Rules:
    """What a matcher heeds: words left out of keys, words that must agree, whether different numbers forbid a match by letters, whether listings without a
    content join every bucket of their category, and whether keys come from the stored normal form."""

    noise: tuple[str, ...] = NOISE
    variants: tuple[str, ...] = VARIANTS
    digit_guard: bool = True
    spread_unknown: bool = True
    stored: bool = False


COMPARED = Rules(COMPARED_NOISE, COMPARED_VARIANTS, False, False)


def bucketed(products: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(category_id, bucket, product_id, source_id, key, tokens) of available listings with a category; bucket is the content, -1 for none.

    A listing without a content is also in every bucket of its category, so that it can match there. Keys come from the normal form of the title, worked out here,
    or with ``rules.stored`` from the column normalized_title as it stands; a null one is an empty key.
    """
    normal = F.col("normalized_title") if rules.stored else normalized_title(F.col("title"))
    rows = products.where("is_available and category_id is not null").select("category_id", F.col("id").alias("product_id"), "source_id", "volume_ml", match_tokens(normal, rules.noise).alias("tokens"))
    rows = rows.withColumn("key", F.array_join("tokens", " "))
    own = rows.withColumn("bucket", F.coalesce("volume_ml", F.lit(-1))).select("category_id", "bucket", "product_id", "source_id", "key", "tokens")
    if not rules.spread_unknown:
        return own
    volumes = rows.where("volume_ml is not null").select("category_id", F.col("volume_ml").alias("bucket")).distinct()
    spread = rows.where("volume_ml is null").join(volumes, "category_id").select(*own.columns)
    return own.unionByName(spread)


def key_classes(members: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row for each bucket and key: members with equal keys are copies and are compared once. node numbers the class by its first member and bucket.

    The sets to be compared hold 64-bit hashes of their words and letters' pieces, which are smaller to move and quicker to intersect than texts.
    """
    by = members.groupBy("category_id", "bucket", "key").agg(F.min("product_id").alias("first_id"), F.first("tokens").alias("tokens"), F.collect_set("source_id").alias("sources"), F.count("*").alias("n"))
    node = F.format_string("%010d|%010d|%010d", F.col("category_id"), F.when(F.col("bucket") < 0, F.lit(2_000_000_000)).otherwise(F.col("bucket")), F.col("first_id"))
    # token_list keeps order and repeats, from which letters' pieces are taken.
    return by.select("category_id", "bucket", "key", "sources", "n", node.alias("node"), F.transform(F.array_distinct("tokens"), lambda w: F.xxhash64(w)).alias("words"), F.transform(trigrams(F.col("tokens")), lambda w: F.xxhash64(w)).alias("pieces"), digits_in(F.col("tokens")).alias("digits"), variants_in(F.col("tokens"), rules.variants).alias("variants"))


def copies(products: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(category_id, volume_ml, key, source_id, product_id, n): a shop's available listings of one category, content and key, which lie in the same buckets, named by the smallest."""
    rows = bucketed(products, replace(rules, spread_unknown=False)).select("category_id", F.when(F.col("bucket") >= 0, F.col("bucket")).alias("volume_ml"), "key", "source_id", "product_id")
    return settled(rows.groupBy("category_id", "volume_ml", "key", "source_id").agg(F.min("product_id").alias("product_id"), F.count("*").cast("int").alias("n")))


def bucket_sizes(copied: DataFrame) -> DataFrame:
    """(category_id, bucket, n) with at least as many rows as a bucket has keys, those that only come from listings without a content aside."""
    return copied.groupBy("category_id", F.coalesce("volume_ml", F.lit(-1)).alias("bucket")).agg(F.count("*").alias("n"))


def word_list(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def word_numbers(key: Column) -> Column:
    return F.transform(F.array_distinct(word_list(key)), lambda w: F.xxhash64(w))


def slim_classes(copied: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(category_id, bucket, key, first_id, many, shop, copies, own, mine, every) of the keys of each bucket; copies: (source_id, product_id, n), one for each shop and content.

    own is false for a key that is in a bucket only because its listings without a content are in every one. Of keys in bucket -1 that do so, mine are the contents of the key's other
    listings, and every the contents of the category. Only copies are moved, never what is spread over buckets.
    """
    none, entry = F.array().cast("array<int>"), F.struct("volume_ml", "source_id", "product_id", "n")
    keyed = copied.groupBy("category_id", "key").agg(F.collect_list(entry).alias("x")).withColumn("mine", F.array_compact(F.array_distinct("x.volume_ml")))
    spread = F.lit(rules.spread_unknown)
    known = keyed.select("category_id", "key", "x", F.explode("mine").alias("bucket"), none.alias("mine"), none.alias("every"), F.lit(True).alias("own"))
    contents = copied.where("volume_ml is not null").groupBy("category_id").agg(F.collect_set("volume_ml").alias("every"))
    unknown = keyed.where(F.exists("x", lambda c: c["volume_ml"].isNull())).join(contents, "category_id", "left").withColumn("every", F.when(spread, F.coalesce("every", none)).otherwise(none))
    buckets = F.concat(F.array(F.lit(-1)), F.array_except("every", "mine"))
    rows = known.unionByName(unknown.withColumns({"bucket": F.explode(buckets), "own": F.lit(True)}).withColumn("own", F.col("bucket") == -1).select(*known.columns))
    here = F.filter("x", lambda c: c["volume_ml"].isNull() & (spread | (F.col("bucket") == -1)) | F.coalesce(c["volume_ml"] == F.col("bucket"), F.lit(False)))
    classes = rows.withColumn("copies", F.transform(here, lambda c: F.struct(c["source_id"].alias("source_id"), c["product_id"].alias("product_id"), c["n"].alias("n"))))
    source = F.col("copies.source_id")
    return classes.select(
        "category_id", "bucket", "key", F.array_min("copies.product_id").alias("first_id"), F.coalesce(F.array_min(source) != F.array_max(source), F.lit(False)).alias("many"),
        F.coalesce(F.array_min(source), F.lit(NO_SHOP)).alias("shop"), "copies", "own", "mine", "every",
    )


def similar_keys(copied: DataFrame, classes: DataFrame, least: float, rules: Rules = Rules(), **more) -> DataFrame:  # noqa: B008
    """``similar`` of the key classes (with columns squares, listings and shops where they are needed)."""
    tokens = word_list(F.col("key"))
    extra = [c for c in ("squares", "listings", "shops") if c in classes.columns] + ["mine", "every"] * rules.spread_unknown
    rows = classes.where("own").select("category_id", "bucket", "first_id", "key", F.array_join(digits_in(tokens), " ").alias("digits"), F.array_join(variants_in(tokens, rules.variants), " ").alias("variants"), "many", "shop", *extra)
    return similar(rows, bucket_sizes(copied), least, spread=rules.spread_unknown, **more)


def prefixes(classes: DataFrame, field: str, least: float) -> DataFrame:
    """(category_id, bucket, element, node, size, place) of the elements by which a set can be found: of its elements, those rarest in its bucket first, the first
    size - ceil(least * size) + 1. Two sets of a bucket with a Jaccard of at least ``least`` share one of them. place counts from 1."""
    elements = classes.select("category_id", "bucket", "node", F.size(field).alias("size"), F.explode(field).alias("element"))
    df = elements.groupBy("category_id", "bucket", "element").agg(F.count("*").alias("df"))
    ordered = elements.join(df, ["category_id", "bucket", "element"]).groupBy("category_id", "bucket", "node", "size").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("o"))
    keep = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    return ordered.select("category_id", "bucket", "node", "size", F.posexplode(F.slice("o", F.lit(1), keep.cast("int"))).alias("place", "x")).select("category_id", "bucket", "node", "size", F.col("x.element").alias("element"), (F.col("place") + 1).alias("place"))


def candidates(classes: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of all class pairs of a bucket whose words or pieces may have a Jaccard of at least ``least``: an equi-join on shared prefix elements with
    the filters by length and by place, which lose no pair: from the first shared element on, enough elements must be left in both sets. Empty keys
    have one class each and need none."""
    found = None
    for field in ("words", "pieces"):
        p = prefixes(classes, field, least)
        q = p.select("category_id", "bucket", "element", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
        lengths = F.least("size", "size_b") >= F.greatest("size", "size_b") * least - 1e-9
        left = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b")) + 1
        pairs = p.join(q, ["category_id", "bucket", "element"]).where((F.col("node") < F.col("b")) & lengths & (left >= (F.col("size") + F.col("size_b")) * (least / (1 + least)) - 1e-9)).select(F.col("node").alias("a"), "b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def measured(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with their scores: j (words), t (letters' pieces), o (overlap), and whether numbers or variants forbid."""
    columns = ("node", "words", "pieces", "digits", "variants", "sources")
    a = classes.select(*[F.col(c).alias(f"{c}_a") for c in columns], "category_id", "bucket")
    b = classes.select(*[F.col(c).alias(f"{c}_b") for c in columns])
    rows = pairs.join(a, pairs["a"] == a["node_a"]).join(b, pairs["b"] == b["node_b"])
    blocked = (F.size("digits_a") > 0) & (F.size("digits_b") > 0) & (F.col("digits_a") != F.col("digits_b"))
    return rows.select(
        "category_id", "bucket", "a", "b", jaccard(F.col("words_a"), F.col("words_b")).alias("j"), jaccard(F.col("pieces_a"), F.col("pieces_b")).alias("t"), overlap(F.col("words_a"), F.col("words_b")).alias("o"),
        blocked.alias("digit_blocked"), (F.col("variants_a") == F.col("variants_b")).alias("same_variant"), (F.size(F.array_union("sources_a", "sources_b")) > 1).alias("across"),
    )


def scored_pairs(classes: DataFrame, least: float = NEAR) -> DataFrame:
    """Pairs of key classes across shops with agreeing variants, of which a score reaches ``least``."""
    rows = measured(classes, candidates(classes, least)).where("across and same_variant")
    return rows.where((F.col("j") >= least) | (F.col("t") >= least)).drop("across", "same_variant")


def best_score() -> Column:
    return F.when(F.col("digit_blocked"), F.col("j")).otherwise(F.greatest("j", "t"))


def edges(scored: DataFrame, least: float = MATCH, digit_guard: bool = True) -> DataFrame:
    """The pairs that match: equal enough words, or letters if numbers don't forbid."""
    by_letters = (F.col("t") >= least) & (~F.col("digit_blocked") if digit_guard else F.lit(True))
    return scored.where((F.col("j") >= least) | by_letters)


def pair_classes(scored: DataFrame, low: float = NEAR) -> DataFrame:
    """Near misses (best score from ``low`` to below a match) and, beyond them, pairs whose smaller key mostly lies in the other."""
    rows = scored.withColumn("best", best_score()).where(F.col("best") < MATCH)
    near, inside = F.col("best") >= low, (F.col("o") >= MATCH) & (F.col("best") >= OVERLAP_FLOOR)
    return rows.where(near | inside).withColumn("kind", F.when(near, "near_miss").otherwise("overlap"))


def clusters(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(category_id, bucket, cluster, product_id, source_id): components of key classes, one listing for each shop, two shops at least.

    Of a shop's listings in a component, the one most like the other shops' listings stays: the mean word Jaccard to all of them, ties to the
    smaller id. Equal keys are one class, so that copies are weighed, not paired. Classes and links may carry further columns that keep apart what ``node`` names.
    """
    labels = smallest_label(classes.select("node"), links.select("a", "b"))
    full = classes.select("category_id", "bucket", "key", "node", "words").join(labels, "node").withColumnRenamed("label", "cluster")
    counted = members.groupBy("category_id", "bucket", "key", "source_id").agg(F.count("*").alias("n"), F.min("product_id").alias("product_id"))
    rows = cut(counted.join(full, ["category_id", "bucket", "key"]).select("category_id", "bucket", F.xxhash64("cluster").alias("number"), "cluster", "words", "source_id", "n", "product_id"))
    names = rows.select("number", "category_id", "bucket", "cluster").distinct()
    return weighed_in_blocks(rows, ("number",)).join(names, "number").select("category_id", "bucket", "cluster", "product_id", "source_id")


def clustered(classes: DataFrame, links: DataFrame, by: tuple[str, ...] = ("category_id", "bucket"), several: DataFrame | None = None) -> DataFrame:
    """(*by, cluster, product_id, source_id, shops) like ``clusters``, of slim classes and links (*by, a, b) between first_ids. cluster is the smallest listing of a component.
    ``several``: the classes of several shops, which are clusters without a link, too, with all of ``by`` where classes lack some.

    A linked class of one shop is looked up among the own classes by its smallest listing, so that the others, which are spread over buckets, aren't moved.
    """
    labels = settled(components(links, by).withColumnRenamed("node", "first_id"))
    columns = (*by, F.coalesce("label", F.col("first_id").cast("bigint")).alias("cluster"), "key", F.explode("copies").alias("x"))
    many = (classes.where("many") if several is None else several).join(labels, [*by, "first_id"], "left").select(*columns)
    home = classes.where("own and not many").select("category_id", F.col("first_id").cast("bigint").alias("first_id"), F.col("bucket").alias("home"), "mine", "key", "copies")
    there = (F.col("home") == F.col("bucket")) | (F.col("home") == -1) & ~F.array_contains("mine", F.col("bucket").cast("int"))
    each = many.unionByName(labels.join(home, ["category_id", "first_id"]).where(there).select(*columns))
    rows = each.groupBy(*by, "cluster", "key", F.col("x.source_id").alias("source_id")).agg(F.sum("x.n").alias("n"), F.min("x.product_id").alias("product_id"))
    return one_of_each_shop(settled(rows), (*by, "cluster"))


def weighed_in_blocks(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``one_of_each_shop`` of rows with a key, or with words in its place, for clusters of any size: words are compared in blocks, so no task holds a whole cluster.

    Only clusters are weighed in which a shop has several keys. An empty key has one word of its own, so that empty keys are alike.
    """
    rows = rows.where(F.col("source_id").isNotNull())
    text = "words" if "words" in rows.columns else "key"
    if text == "words":
        rows = rows.withColumn("words", F.when(F.size("words") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("words")))
    per_shop = rows.groupBy(*by, "source_id").agg(F.count("*").alias("keys"), F.sum("n").alias("of_shop"))
    per_cluster = per_shop.groupBy(*by).agg(F.count("*").alias("shops"), F.sum("of_shop").alias("of_all"), F.sum("keys").alias("n"), F.max("keys").alias("most")).where("shops > 1")
    weighed = per_cluster.where("most > 1")
    sums = likeness(rows.join(weighed.select(*by), [*by], "left_semi").select(*by, "product_id", "source_id", "n", text), by, weighed.select(*by, "n"))
    ranked = rows.select(*by, "product_id", "source_id", "n").join(per_shop.join(per_cluster.select(*by, "shops", "of_all"), [*by]).drop("keys"), [*by, "source_id"]).join(sums, [*by, "product_id"], "left")
    best = ranked.groupBy(*by, "source_id").agg(F.max_by("product_id", F.struct(F.round(F.coalesce(F.col("likeness") / (F.col("of_all") - F.col("of_shop")), F.lit(0.0)), 12), -F.col("product_id"))).alias("product_id"), F.first("shops").alias("shops"))
    return best.select(*by, "product_id", "source_id", "shops")


def one_of_each_shop(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, product_id, source_id, shops) of rows (*by, product_id, source_id, n, key; n: the copies of a key in a shop): of each shop of a cluster (by) across shops the listing
    with the highest mean word Jaccard to the other shops' listings. The rows are read three times.

    Clusters of at most BLOCK rows are one task's each, larger ones are compared in blocks.
    """
    rows = rows.where(F.col("source_id").isNotNull())
    # Of all rows at most one in BLOCK counts here.
    large = F.broadcast(rows.groupBy(*by).agg(F.count("*").alias("size")).where(F.col("size") > blocks.BLOCK).select(*by))
    few = chosen(rows.join(large, [*by], "left_anti"), by)
    kinds = dict(rows.dtypes)
    many = weighed_in_blocks(rows.join(large, [*by], "left_semi"), by)
    return many.unionByName(few.select(*[F.col(c).cast(kinds[c]).alias(c) for c in (*by, "product_id", "source_id")], "shops"))


def chained(members: DataFrame, near: DataFrame) -> DataFrame:
    """(label, product_id, source_id, key): the listings of the class pairs (category_id, bucket, key_a, key_b), chained within a category over all buckets; label is the
    smallest listing.

    Two listings are a pair if their classes are and their shops differ. A shop's copies in a class have the same pairs, so the smallest stands for them in
    pairs and is linked to each of them, provided that there is a pair at all.
    """
    copies = cut(members.groupBy("category_id", "bucket", "key", "source_id").agg(F.min("product_id").alias("first_id")))
    side = lambda x: copies.select("category_id", "bucket", F.col("key").alias(f"key_{x}"), F.col("source_id").alias(f"source_{x}"), F.col("first_id").alias(x))
    pairs = cut(near.join(side("a"), ["category_id", "bucket", "key_a"]).join(side("b"), ["category_id", "bucket", "key_b"]).where("source_a <> source_b"))
    used = pairs.select("category_id", "bucket", F.explode(F.array(F.struct(F.col("key_a").alias("key"), F.col("source_a").alias("source_id"), F.col("a").alias("first_id")), F.struct(F.col("key_b").alias("key"), F.col("source_b").alias("source_id"), F.col("b").alias("first_id")))).alias("x")).select("category_id", "bucket", "x.*").distinct()
    nodes = cut(members.join(used, ["category_id", "bucket", "key", "source_id"]).select("product_id", "source_id", "key", "first_id"))
    links = pairs.select("a", "b").unionByName(nodes.select(F.col("first_id").alias("a"), F.col("product_id").alias("b"))).distinct()
    labels = smallest_label(nodes.select(F.col("product_id").alias("node")), links)
    return nodes.drop("first_id").distinct().join(labels.withColumnRenamed("node", "product_id"), "product_id").select("label", "product_id", "source_id", "key")


def typical(chains: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """(*by, source_id, product_id): one listing for each shop of a chain across shops; chains of one shop have none. Without a column n each row is one listing."""
    n = F.sum("n") if "n" in chains.columns else F.count("*")
    counted = settled(chains.groupBy(*by, "source_id", "key").agg(n.alias("n"), F.min("product_id").alias("product_id")))
    return one_of_each_shop(counted, by).select(*by, "source_id", "product_id")


KINDS = ("near_miss", "overlap")


def kind_numbers(low: float) -> Callable:
    """Of pairs' scores the place of their kind in KINDS, -1 for none, as in ``pair_classes``."""

    def of(j, t, o, digit_blocked):
        import numpy as np

        best = np.where(digit_blocked, j, np.maximum(j, t))
        return np.where(best >= MATCH, -1, np.where(best >= low, 0, np.where((o >= MATCH) & (best >= OVERLAP_FLOOR), 1, -1)))

    return of


def suggestions(products: DataFrame, low: float = NEAR, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(kind, label, source_id, product_id, jaccard, trigram): groups of near misses, and, chained apart from them, of pairs whose smaller key mostly lies in the other.

    A group is a chain over a category's buckets, of each shop its most typical listing; its scores are the greatest word and letter Jaccard of any two of its
    listings that share a bucket and agree in variants, also of those that are no near miss themselves. With a ``low`` up to OVERLAP_FLOOR every pair of the
    second kind is a near miss, so there are none.

    Chains link copies of one shop, content and key as one, since these are in the same pairs. Pairs go to the chains where they are found.
    """
    copied = copies(products, rules)
    classes = slim_classes(copied, rules).withColumns({"listings": F.col("copies.product_id"), "shops": F.transform("copies", lambda x: F.coalesce(x["source_id"], F.lit(NO_SHOP)))})
    links = similar_keys(copied, classes, min(low, OVERLAP_FLOOR), rules, kinds=kind_numbers(low))
    chains = components(links, ("kind", "category_id")).select("kind", F.col("label").cast("int").alias("label"), F.col("node").cast("int").alias("product_id"))
    found = typical(chains.join(copied.select("product_id", "source_id", "key", "n"), "product_id"), ("kind", "label"))
    # One row for each shop of a group, with what its scores need.
    full = settled(found.join(copied.select("product_id", "key", F.coalesce("volume_ml", F.lit(-1)).alias("bucket")), "product_id"))
    tokens = word_list(F.col("key"))
    rows = full.select("kind", "label", "product_id", "bucket", word_numbers(F.col("key")).alias("words"), trigrams(tokens).alias("pieces"), variants_in(tokens, rules.variants).alias("variants"))
    other = rows.select("kind", "label", *[F.col(c).alias(f"{c}_o") for c in ("product_id", "bucket", "words", "pieces", "variants")])
    # A group has one listing a shop, so there are few pairs.
    pairs = rows.join(other, ["kind", "label"]).where("product_id < product_id_o and variants = variants_o and (bucket = bucket_o or bucket = -1 or bucket_o = -1)")
    best = pairs.groupBy("kind", "label").agg(F.max(jaccard(F.col("words"), F.col("words_o"))).alias("jaccard"), F.max(jaccard(F.col("pieces"), F.col("pieces_o"))).alias("trigram"))
    zero = F.lit(0.0)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind").cast("int") + 1)
    return full.join(best, ["kind", "label"], "left").select(name.alias("kind"), "label", "source_id", "product_id", F.coalesce("jaccard", zero).alias("jaccard"), F.coalesce("trigram", zero).alias("trigram"))


def disjoint(found: DataFrame) -> DataFrame:
    """The clusters that stay when each listing may be in one only: those with most shops first, then by bucket and first member, all in parallel.

    A cluster that ranks before all undecided ones it shares a listing with is kept, and those are dropped; repeated until all are decided. The first of the
    undecided is decided in each round, so any number of them comes to an end.
    """
    size = found.groupBy("cluster").agg(F.count("*").alias("shops"))
    ranked = cut(found.join(size, "cluster").withColumn("rank", F.concat_ws("|", F.lpad((F.lit(9) - F.col("shops")).cast("string"), 2, "0"), "cluster")))
    kept, open_ = None, ranked
    while True:
        best = open_.groupBy("product_id").agg(F.min("rank").alias("best"))
        marked = open_.join(best, "product_id").groupBy("cluster").agg(F.min((F.col("rank") == F.col("best")).cast("int")).alias("wins"))
        winners = cut(open_.join(marked.where("wins = 1").select("cluster"), "cluster", "left_semi"))
        kept = winners if kept is None else kept.unionByName(winners)
        hit = open_.join(winners.select("product_id"), "product_id", "left_semi").select("cluster").distinct()
        open_ = cut(open_.join(hit, "cluster", "left_anti"))
        if open_.isEmpty():
            return kept.drop("shops", "rank")


def match_links(scored: DataFrame, digit_guard: bool = True) -> DataFrame:
    return edges(scored, MATCH, digit_guard).select("category_id", "bucket", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def match_rows(products: DataFrame, taken: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Long matches (match_id, source_id, product_id); clusters that name a listing of ``taken`` (product_id) are left out. match_id is the smallest listing.

    Of clusters that share a listing the first stays: those with most shops, then by bucket (without a content last) and smallest listing.
    """
    copied = copies(products, rules)
    classes = slim_classes(copied, rules)
    found = clustered(classes, match_links(similar_keys(copied, classes, MATCH, rules), rules.digit_guard))
    ordered = found.withColumns({"fewer": -F.col("shops"), "unknown": (F.col("bucket") < 0).cast("int")})
    kept = firsts(ordered, "category_id", ("fewer", "unknown"), ("bucket", "cluster"))
    if taken is not None:
        kept = kept.join(taken.select("product_id", F.lit(1).alias("taken")).distinct(), "product_id", "left")
    by = ("category_id", "bucket", "cluster")
    groups = kept.groupBy(*by).agg(F.min("product_id").alias("match_id"), F.collect_list(F.struct("source_id", "product_id")).alias("x"), *([F.count("taken").alias("hits")] if taken is not None else []))
    return (groups if taken is None else groups.where("hits = 0")).select("match_id", F.explode("x").alias("x")).select("match_id", "x.source_id", "x.product_id")


def idf(products: DataFrame, rules: Rules = COMPARED) -> DataFrame:
    """(token, df, idf) with idf = ln((N + 1) / (df + 1)) + 1 over the available listings with a category."""
    rows = bucketed(products, rules)
    total = rows.count()
    df = rows.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.select("token", "df", (F.log(F.lit(total + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def cosine_pairs(classes: DataFrame, weights: DataFrame, least: float = MATCH) -> DataFrame:
    """(a, b, cosine) of the class pairs of a bucket that share a word and whose idf cosine reaches ``least``: dot products by word, so that only pairs with
    something in common are formed. The words that can't lift a pair to ``least`` alone are no keys: pairs are found by the heavier ones."""
    words = classes.select("category_id", "bucket", "node", F.explode("words").alias("token")).join(weights.select(F.xxhash64("token").alias("token"), "idf"), "token")
    norm = words.groupBy("node").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    unit = words.join(norm, "node").select("category_id", "bucket", "node", "token", (F.col("idf") / F.col("norm")).alias("w"))
    # Sorted by token, the last words whose squares add up to less than least squared can't reach it by themselves.
    tail = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("node").orderBy("w", "token"))
    keys = unit.withColumn("tail", tail).where(F.col("tail") >= least * least - 1e-9)
    other = unit.select("category_id", "bucket", "token", F.col("node").alias("b"))
    pairs = keys.select("category_id", "bucket", "token", F.col("node").alias("a")).join(other, ["category_id", "bucket", "token"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = unit.select(F.col("node").alias("a"), "token", F.col("w").alias("wa")), unit.select(F.col("node").alias("b"), "token", F.col("w").alias("wb"))
    return pairs.join(left, "a").join(right, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least - 1e-12)


def key_weights(copied: DataFrame, classes: DataFrame) -> DataFrame:
    """(first_id, squares): of classes whose listings are in one each, the squared idf of the key's distinct words, in their order. Words are moved with the class's number, not its key."""
    total = copied.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = copied.select("n", F.explode(F.array_distinct(word_list(F.col("key")))).alias("word")).groupBy("word").agg(F.sum("n").alias("df"))
    weight = df.select("word", (F.log(F.lit(total + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    words = classes.select("first_id", F.posexplode(F.array_distinct(word_list(F.col("key")))).alias("place", "word"))
    listed = words.join(weight, "word").groupBy("first_id").agg(F.array_sort(F.collect_list(F.struct("place", "idf"))).alias("x"))
    return listed.select("first_id", F.transform("x", lambda x: x["idf"] * x["idf"]).alias("squares"))


def matcher_pairs(products: DataFrame) -> DataFrame:
    """(matcher, id_a, id_b) of the listings that each of four matchers puts into one cluster, under the comparison rules."""
    copied = copies(products, COMPARED)
    classes = slim_classes(copied, COMPARED)
    weighed = classes.join(key_weights(copied, classes), "first_id", "left").withColumn("squares", F.coalesce("squares", F.array().cast("array<double>")))
    found = similar_keys(copied, weighed, MATCH, COMPARED, contained=MATCH, cosine=MATCH)
    reached = F.array(*[F.when(ok, F.lit(i)) for i, ok in enumerate((F.col("j") >= MATCH, F.col("t") >= MATCH, F.col("o") >= MATCH, F.col("c") >= MATCH - 1e-12))])
    links = found.select(F.explode(F.array_compact(reached)).alias("matcher"), "category_id", "bucket", F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    # Empty keys are alike for all matchers but the cosine.
    several = classes.where("many").withColumn("matcher", F.explode(F.when(F.col("key") == "", F.array(*map(F.lit, range(3)))).otherwise(F.array(*map(F.lit, range(4))))))
    by = ("matcher", "category_id", "bucket")
    # A cluster has one listing a shop, so there are few pairs.
    listings = clustered(classes, links, by, several).groupBy(*by, "cluster").agg(F.array_sort(F.collect_list("product_id")).alias("x"))
    firsts_ = listings.select("matcher", F.posexplode("x").alias("i", "id_a"), "x").select("matcher", "id_a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("id_b"))
    name = F.element_at(F.array(*[F.lit(m) for m in MATCHERS]), F.col("matcher").cast("int") + 1)
    return firsts_.select(name.alias("matcher"), "id_a", "id_b").distinct()


def clustered_pairs(members: DataFrame, classes: DataFrame, links: dict[str, DataFrame], empty_alike: tuple[str, ...]) -> DataFrame:
    """(matcher, id_a, id_b) of the listings that each matcher's links (a, b) put into one cluster. One run of labels does for all matchers: a matcher's name is part
    of its nodes. Empty keys are alike only for the matchers named; the others leave them out."""
    tag = lambda c: F.concat_ws("|", "matcher", c)
    named = classes.withColumn("matcher", F.explode(F.array(*[F.lit(m) for m in links]))).where((F.size("words") > 0) | F.col("matcher").isin(*empty_alike)).withColumn("node", tag("node"))
    edges_ = None
    for name, rows in links.items():
        part = rows.withColumn("matcher", F.lit(name)).select(tag("a").alias("a"), tag("b").alias("b"))
        edges_ = part if edges_ is None else edges_.unionByName(part)
    found = cut(clusters(members, cut(named), edges_).select(F.substring_index("cluster", "|", 1).alias("matcher"), "cluster", "product_id"))
    b = found.select("cluster", F.col("product_id").alias("id_b"))
    # A cluster has one listing a shop, so there are few pairs.
    return found.withColumnRenamed("product_id", "id_a").join(b, "cluster").where("id_a < id_b").select("matcher", "id_a", "id_b").distinct()


def similarity_pairs(products: DataFrame, similarity: Callable[[Column, Column], Column], least: float = MATCH, rules: Rules = COMPARED, name: str = "own") -> DataFrame:
    """(matcher, id_a, id_b) by a similarity of one's own: a function of two sorted word arrays (as Columns) that gives a number, 0 for arrays without a common word.

    Class pairs that share a word and agree in variants are measured; which listing of a shop stays in a cluster is decided by word Jaccard, as for every
    matcher. Empty keys match nothing.
    """
    members = cut(bucketed(products, rules))
    classes = cut(key_classes(members, rules))
    texts = members.groupBy("category_id", "bucket", "key").agg(F.array_sort(F.array_distinct(F.first("tokens"))).alias("texts"))
    full = cut(classes.join(texts, ["category_id", "bucket", "key"]).select("node", "variants", "sources", "texts"))
    words = classes.select("category_id", "bucket", "node", F.explode("words").alias("word"))
    met = words.withColumnRenamed("node", "a").join(words.withColumnRenamed("node", "b"), ["category_id", "bucket", "word"]).where("a < b").select("a", "b").distinct()
    side = lambda x: full.select(*[F.col(c).alias(f"{c}_{x}") for c in full.columns]).withColumnRenamed(f"node_{x}", x)
    rows = met.join(side("a"), "a").join(side("b"), "b").where((F.col("variants_a") == F.col("variants_b")) & (F.size(F.array_union("sources_a", "sources_b")) > 1))
    return clustered_pairs(members, classes, {name: rows.where(similarity(F.col("texts_a"), F.col("texts_b")) >= least).select("a", "b")}, empty_alike=())


def shared_words(classes: DataFrame) -> DataFrame:
    """(a, b) of the class pairs of a bucket that can have an overlap of at least MATCH: of the smaller set at least that share of words is common, so one of its
    rarest size - ceil(share) + 1 words is; these are joined to all words of the other set."""
    words = classes.select("category_id", "bucket", "node", F.explode("words").alias("element"))
    keys = prefixes(classes, "words", MATCH).select("category_id", "bucket", "element", F.col("node").alias("x"))
    pairs = keys.join(words.withColumnRenamed("node", "y"), ["category_id", "bucket", "element"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


#: The four similarities compared.
MATCHERS = ("jaccard", "trigram", "overlap", "cosine")


def agreement(pairs: DataFrame, matchers: tuple[str, ...] = MATCHERS) -> DataFrame:
    """(matcher_a, matcher_b, common, percent): for every two matchers their shared pairs, in percent of the first one's; 0 where there are none."""
    names = pairs.sparkSession.createDataFrame([(a, b) for a in matchers for b in matchers], "matcher_a string, matcher_b string")
    sizes = pairs.groupBy(F.col("matcher").alias("matcher_a")).agg(F.count("*").alias("n"))
    other = pairs.select(F.col("matcher").alias("matcher_b"), "id_a", "id_b")
    common = pairs.withColumnRenamed("matcher", "matcher_a").join(other, ["id_a", "id_b"]).groupBy("matcher_a", "matcher_b").agg(F.count("*").alias("common"))
    rows = names.join(common, ["matcher_a", "matcher_b"], "left").join(sizes, "matcher_a", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return rows.select("matcher_a", "matcher_b", "common", F.round(F.col("common") / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)) * 100, 6).alias("percent"))
