"""Queries of the matcher over the products, and the SQL that checks them by brute force on whole buckets.

Listings with equal keys in a bucket are copies: pair queries give pairs of key classes, named by their smallest listing, and ``key_members`` says
who belongs to a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillroom.functions.titles import COMPARED_NOISE, COMPARED_VARIANTS, NOISE, VARIANTS, fingerprint, match_tokens, normalized_title
from stillroom.operators.blocks import components
from stillroom.operators.groups import confirmed_matches
from stillroom.operators.lookup import queued
from stillroom.operators.matching import MATCH, MATCHERS, NEAR, agreement, bucketed, clustered, copies, edges, idf, match_links, match_rows, matcher_pairs, pair_classes, similar_keys, similarity_pairs, slim_classes, suggestions
from stillroom.plans.catalogue_sql import NORMAL
from stillroom.sources.landing import export_json
from stillroom.sources.tables import settled, table


def products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products", "id", "source_id", "category_id", "title", "volume_ml", "is_available")


def match_keys(spark, d):
    return products(spark, d).select("id", F.array_join(match_tokens(normalized_title(F.col("title"))), " ").alias("key"))


def key_members(spark, d):
    """Every listing in every bucket it takes part in, with the smallest listing of its key there."""
    rows = bucketed(products(spark, d))
    first = rows.groupBy("category_id", "bucket", "key").agg(F.min("product_id").alias("first_id"))
    return rows.join(first, ["category_id", "bucket", "key"]).select("category_id", "bucket", "product_id", "first_id")


def scores(spark, d, least: float = NEAR) -> DataFrame:
    copied = copies(products(spark, d))
    return similar_keys(copied, slim_classes(copied), least)


def all_scored_pairs(spark, d):
    rows = scores(spark, d)
    return rows.select("category_id", "bucket", "id_a", "id_b", F.round("j", 6).alias("j"), F.round("t", 6).alias("t"), F.round("o", 6).alias("o"), "digit_blocked")


def match_edges(spark, d):
    return edges(scores(spark, d, MATCH)).select("category_id", "bucket", "id_a", "id_b")


def pair_kinds(spark, d):
    rows = pair_classes(scores(spark, d))
    return rows.select("category_id", "bucket", "id_a", "id_b", F.round("best", 6).alias("best"), "kind")


def pair_kinds_high_floor(spark, d):
    """With a floor of 0.55 some pairs are candidates only because one key lies in the other."""
    rows = pair_classes(scores(spark, d), 0.55)
    return rows.select("category_id", "bucket", "id_a", "id_b", F.round("best", 6).alias("best"), "kind")


def match_components(spark, d):
    """Key classes with the smallest class of their component."""
    copied = copies(products(spark, d))
    classes = slim_classes(copied)
    labels = components(match_links(similar_keys(copied, classes, MATCH)), ("category_id", "bucket")).withColumnRenamed("node", "first_id")
    return classes.select("category_id", "bucket", "first_id").join(labels, ["category_id", "bucket", "first_id"], "left").select("category_id", "bucket", "first_id", F.coalesce(F.col("label").cast("int"), "first_id").alias("component"))


def match_clusters(spark, d):
    copied = copies(products(spark, d))
    classes = slim_classes(copied)
    return clustered(classes, match_links(similar_keys(copied, classes, MATCH))).select("category_id", "bucket", "product_id", "source_id")


def new_matches(spark, d):
    return match_rows(products(spark, d))


def suggested(spark, d, low: float = NEAR) -> DataFrame:
    """Suggested groups, one row each: kind, first_id (the chain's smallest listing), shops, listings, jaccard and trigram, rounded as they are queued."""
    grouped = suggestions(products(spark, d), low).groupBy("kind", "label").agg(F.count("*").alias("shops"), F.array_sort(F.collect_list("product_id")).alias("listings"), F.first("jaccard").alias("jaccard"), F.first("trigram").alias("trigram"))
    return grouped.select("kind", F.col("label").alias("first_id"), "shops", F.array_join("listings", ",").alias("listings"), F.bround("jaccard", 3).alias("jaccard"), F.bround("trigram", 3).alias("trigram"))


def suggested_clusters(spark, d):
    """Near misses chained within a category, copies included: each shop's most typical listing, named by the chain's smallest, with the group's best scores."""
    return suggested(spark, d)


def suggested_clusters_high_floor(spark, d):
    """With a floor of 0.55 groups of the second kind appear."""
    return suggested(spark, d, 0.55)


def suggestion_queue(spark, d):
    """Suggested groups that aren't queued yet and name no matched listing, with their fingerprints."""
    shops = table(spark, d, "sources").select(F.col("id").alias("source_id"), "name")
    urls = table(spark, d, "products", "id", "source_id", "product_url").join(shops, "source_id").select(F.col("id").alias("product_id"), F.concat_ws(":", "name", "product_url").alias("member"))
    groups = suggested(spark, d).select(F.col("first_id").alias("label"), "kind", "jaccard", "trigram", F.explode(F.split("listings", ",").cast("array<int>")).alias("product_id")).join(urls, "product_id")
    candidates = table(spark, d, "possible_matches")
    return queued(groups, candidates.select(F.col("group_fingerprint").alias("fingerprint")), confirmed_matches(candidates))


def suggestion_counters(spark, d):
    """Counters of a suggestion run in one row: groups, those that name a matched listing, those whose fingerprint is queued, and those that are new."""
    shops = table(spark, d, "sources").select(F.col("id").alias("source_id"), "name")
    urls = table(spark, d, "products", "id", "source_id", "product_url").join(shops, "source_id").select(F.col("id").alias("product_id"), F.concat_ws(":", "name", "product_url").alias("member"))
    candidates = table(spark, d, "possible_matches")
    taken = confirmed_matches(candidates).select("product_id", F.lit(True).alias("taken")).distinct()
    groups = suggested(spark, d).select("kind", "first_id", F.explode(F.split("listings", ",").cast("array<int>")).alias("product_id")).join(urls, "product_id").join(taken, "product_id", "left")
    rows = groups.groupBy("kind", "first_id").agg(fingerprint(F.collect_list("member")).alias("fingerprint"), F.count("taken").alias("taken"))
    known = candidates.select(F.col("group_fingerprint").alias("fingerprint"), F.lit(True).alias("queued")).distinct()
    matched, queued_ = F.col("taken") > 0, F.col("queued").isNotNull()
    return rows.join(known, "fingerprint", "left").agg(F.count("*").alias("groups"), F.count_if(matched).alias("skipped_already_matched"), F.count_if(~matched & queued_).alias("skipped_already_queued"), F.count_distinct(F.when(~matched & ~queued_, F.col("fingerprint"))).alias("inserted"))


def run_summary(spark, d):
    """The counters of a matching run as one JSON text."""
    return export_json(run_counters(spark, d))


def matches_beside_confirmed(spark, d):
    """The matches of a run in which the algorithm's earlier rows are dropped and the confirmed ones stay: clusters that name a listing of a confirmed match are not inserted."""
    return match_rows(products(spark, d), confirmed_matches(table(spark, d, "possible_matches")))


def run_counters(spark, d):
    """Counters of a matching run in one row: categories, contents (buckets, also of one shop), clusters kept, rows inserted and rows left out for a conflict with a confirmed match."""
    rows = products(spark, d).where("is_available and category_id is not null")
    found = settled(match_rows(products(spark, d)))
    free = found.join(confirmed_matches(table(spark, d, "possible_matches")).select("product_id").distinct(), "product_id", "left_semi").select("match_id").distinct()
    one = lambda df: df.withColumn("one", F.lit(1))
    counted = one(rows.agg(F.count_distinct("category_id").alias("categories"), F.count_distinct(F.struct("category_id", F.coalesce("volume_ml", F.lit(-1)))).alias("volume_groups")))
    kept = one(found.agg(F.count_distinct("match_id").alias("clusters_found")))
    conflicts = one(free.agg(F.count("*").alias("rows_skipped_conflict")))
    return counted.join(kept, "one").join(conflicts, "one").select("categories", "volume_groups", "clusters_found", (F.col("clusters_found") - F.col("rows_skipped_conflict")).alias("rows_inserted"), "rows_skipped_conflict")


def cluster_histogram(spark, d):
    """How many matches have listings of how many shops."""
    return match_rows(products(spark, d)).groupBy("match_id").agg(F.count("*").cast("int").alias("shops")).groupBy("shops").agg(F.count("*").alias("matches"))


def cluster_labels(spark, d):
    """For each match its shortest title and whether its listings state one content, several or none."""
    rows = match_rows(products(spark, d)).join(products(spark, d).select(F.col("id").alias("product_id"), "title", "volume_ml"), "product_id")
    volumes = F.count_distinct("volume_ml")
    return rows.groupBy("match_id").agg(F.min_by("title", F.struct(F.length("title"), F.col("product_id"))).alias("label"), F.when(volumes == 0, "no-vol").when(volumes == 1, F.min("volume_ml").cast("string")).otherwise("mixed-vol").alias("volume"))


def matching_statistics(spark, d):
    """Counters of a matching run: listings, buckets, buckets with two shops or more."""
    rows = bucketed(products(spark, d))
    buckets = rows.groupBy("category_id", "bucket").agg(F.count_distinct("source_id").alias("shops"))
    counted = buckets.agg(F.count("*").alias("buckets"), F.count_if(F.col("shops") > 1).alias("buckets_across"))
    placed = rows.agg(F.count_distinct("product_id").alias("listings"), F.count("*").alias("placements"))
    return placed.withColumn("one", F.lit(1)).join(counted.withColumn("one", F.lit(1)), "one").drop("one")


def token_weights(spark, d):
    return idf(products(spark, d)).select("token", "df", F.round("idf", 6).alias("idf"))


def matcher_summary(spark, d):
    pairs = matcher_pairs(products(spark, d))
    return pairs.groupBy("matcher").agg(F.count("*").alias("pairs"), F.count_distinct("id_a").alias("first_listings"))


def matcher_agreement(spark, d):
    return agreement(settled(matcher_pairs(products(spark, d))))


def consensus_pairs(spark, d):
    """Pairs that all four matchers find."""
    return matcher_pairs(products(spark, d)).groupBy("id_a", "id_b").agg(F.count_distinct("matcher").alias("n")).where("n = 4").select("id_a", "id_b")


def disagreements(pairs: DataFrame) -> DataFrame:
    """(matcher, side, id_a, id_b) of the pairs that a matcher finds and the word Jaccard doesn't (only_here), or the other way round (only_jaccard)."""
    base, others = pairs.where("matcher = 'jaccard'").select("id_a", "id_b"), pairs.where("matcher <> 'jaccard'")
    here = others.join(base, ["id_a", "id_b"], "left_anti").select("matcher", F.lit("only_here").alias("side"), "id_a", "id_b")
    each = base.withColumn("matcher", F.explode(F.array(*[F.lit(m) for m in MATCHERS if m != "jaccard"])))
    return here.unionByName(each.join(others, ["matcher", "id_a", "id_b"], "left_anti").select("matcher", F.lit("only_jaccard").alias("side"), "id_a", "id_b"))


def matcher_disagreements(spark, d):
    """How many pairs each matcher finds that the word Jaccard doesn't, and the other way round."""
    found = disagreements(settled(matcher_pairs(products(spark, d)))).groupBy("matcher").agg(F.count_if(F.col("side") == "only_here").alias("only_here"), F.count_if(F.col("side") == "only_jaccard").alias("only_jaccard"))
    names = spark.createDataFrame([(m,) for m in MATCHERS if m != "jaccard"], "matcher string")
    return names.join(found, "matcher", "left").select("matcher", F.coalesce("only_here", F.lit(0)).alias("only_here"), F.coalesce("only_jaccard", F.lit(0)).alias("only_jaccard"))


def matcher_examples(spark, d):
    """The first five pairs of each disagreement, with their titles."""
    found = disagreements(settled(matcher_pairs(products(spark, d))))
    order = Window.partitionBy("matcher", "side").orderBy("id_a", "id_b")
    first = found.withColumn("k", F.row_number().over(order)).where("k <= 5")
    titles = lambda x: products(spark, d).select(F.col("id").alias(f"id_{x}"), F.col("title").alias(f"title_{x}"))
    return first.join(titles("a"), "id_a").join(titles("b"), "id_b").select("matcher", "side", "k", "id_a", "id_b", "title_a", "title_b")


def dice(a: Column, b: Column) -> Column:
    """Twice the shared words by all words of both."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def own_similarity_pairs(spark, d):
    """The matcher run with a similarity that a caller hands in: here Dice's."""
    return similarity_pairs(products(spark, d), dice, 0.8, name="dice")


QUERIES = {f.__name__: f for f in (
    match_keys, key_members, all_scored_pairs, match_edges, pair_kinds, pair_kinds_high_floor, match_components, match_clusters, new_matches, matches_beside_confirmed, run_counters, run_summary, suggestion_counters, suggested_clusters, suggested_clusters_high_floor, suggestion_queue, cluster_histogram, cluster_labels, matching_statistics, token_weights, matcher_summary, matcher_agreement,
    consensus_pairs, matcher_disagreements, matcher_examples, own_similarity_pairs,
)}


def words_sql(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


TOKENS = f"list_filter(list_transform(list_filter(string_split({NORMAL}, ' '), lambda x: x <> '' AND NOT regexp_full_match(x, '\\p{{Nd}}+ml')), lambda x: regexp_replace(x, '^(\\p{{Nd}}+)yo$', '\\1')), lambda x: x NOT IN ({words_sql(NOISE)}) AND (length(x) > 1 OR regexp_full_match(x, '\\p{{Nd}}')))"
COMPARED_TOKENS = TOKENS.replace(words_sql(NOISE), words_sql(COMPARED_NOISE))
BUCKETS = f"""
WITH RECURSIVE base AS (SELECT id AS product_id, source_id, category_id, volume_ml, coalesce({TOKENS}, []) AS toks FROM products WHERE is_available AND category_id IS NOT NULL),
keyed AS (SELECT *, array_to_string(toks, ' ') AS key FROM base),
m AS (SELECT category_id, coalesce(volume_ml, -1) AS bucket, product_id, source_id, key, toks FROM keyed
  UNION ALL SELECT k.category_id, v.volume_ml, k.product_id, k.source_id, k.key, k.toks FROM keyed k JOIN (SELECT DISTINCT category_id, volume_ml FROM keyed WHERE volume_ml IS NOT NULL) v ON v.category_id = k.category_id WHERE k.volume_ml IS NULL),
cls AS (SELECT category_id, bucket, key, min(product_id) AS first_id, list_distinct(any_value(toks)) AS words, list_distinct(array_agg(source_id)) AS shops,
  CASE WHEN length(key) = 0 THEN [] WHEN length(key) < 3 THEN [key] ELSE list_distinct(list_transform(generate_series(1, length(key) - 2), lambda i: substring(key, i::INT, 3))) END AS pieces,
  list_sort(list_distinct(list_filter(any_value(toks), lambda x: regexp_full_match(x, '\\p{{Nd}}+')))) AS digits, list_sort(list_distinct(list_filter(any_value(toks), lambda x: x IN ({words_sql(VARIANTS)})))) AS variants
  FROM m GROUP BY category_id, bucket, key),
p AS (SELECT a.category_id, a.bucket, least(a.first_id, b.first_id) AS id_a, greatest(a.first_id, b.first_id) AS id_b, len(list_intersect(a.words, b.words)) AS wi, len(a.words) AS wa, len(b.words) AS wb,
  len(list_intersect(a.pieces, b.pieces)) AS pi, len(a.pieces) AS pa, len(b.pieces) AS pb, len(a.digits) > 0 AND len(b.digits) > 0 AND a.digits <> b.digits AS digit_blocked
  FROM cls a JOIN cls b ON a.category_id = b.category_id AND a.bucket = b.bucket AND a.key < b.key WHERE a.variants = b.variants AND len(list_distinct(list_concat(a.shops, b.shops))) > 1),
s AS (SELECT category_id, bucket, id_a, id_b, digit_blocked, wi / (wa + wb - wi) AS j, pi / (pa + pb - pi) AS t, CASE WHEN least(wa, wb) = 0 THEN 0.0 ELSE wi / least(wa, wb) END AS o FROM p),
near AS (SELECT *, CASE WHEN digit_blocked THEN j ELSE greatest(j, t) END AS best FROM s WHERE j >= 0.37 OR t >= 0.37),
e AS (SELECT * FROM s WHERE j >= 0.7 OR (t >= 0.7 AND NOT digit_blocked))
"""

def resolved_sql(name: str, listings: str, labels: str) -> str:
    """Of each cluster (comp) across shops each shop's listing with the highest mean word Jaccard to the other shops' listings, every pair compared."""
    return f"""
{name}_l AS ({listings}),
{name}_a AS (SELECT x.*, avg(CASE WHEN len(x.words) = 0 AND len(y.words) = 0 THEN 1.0 ELSE len(list_intersect(x.words, y.words)) / greatest(1, len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) END) AS likeness
  FROM {name}_l x JOIN {name}_l y ON {" AND ".join(f"x.{c} = y.{c}" for c in labels.split(", "))} AND x.source_id <> y.source_id GROUP BY ALL),
{name} AS (SELECT {labels}, product_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY {labels}, source_id ORDER BY round(likeness, 12) DESC, product_id) AS k FROM {name}_a) WHERE k = 1)
"""


COMPONENTS = BUCKETS.rstrip() + """,
ways AS (SELECT category_id, bucket, id_a AS a, id_b AS b FROM e UNION SELECT category_id, bucket, id_b, id_a FROM e),
r AS (SELECT category_id, bucket, first_id AS n, first_id AS l FROM cls UNION SELECT r.category_id, r.bucket, ways.b, r.l FROM r JOIN ways ON ways.category_id = r.category_id AND ways.bucket = r.bucket AND ways.a = r.n),
comp AS (SELECT category_id, bucket, n AS first_id, min(l) AS comp FROM r GROUP BY category_id, bucket, n)"""
CLUSTERS = COMPONENTS + "," + resolved_sql("c", "SELECT m.category_id, m.bucket, comp.comp, m.product_id, m.source_id, cls.words FROM m JOIN cls USING (category_id, bucket, key) JOIN comp USING (category_id, bucket, first_id)", "category_id, bucket, comp")
# The greedy choice as it is stated: one cluster after the other, with all listings taken so far.
GREEDY = CLUSTERS.rstrip() + """,
k AS (SELECT category_id, list_sort(array_agg(product_id)) AS ids, row_number() OVER (PARTITION BY category_id ORDER BY count(*) DESC, bucket = -1, bucket, comp) AS rank FROM c GROUP BY category_id, bucket, comp),
g AS (SELECT DISTINCT category_id, 0::BIGINT AS rank, []::INT[] AS seen, []::INT[] AS ids FROM k
  UNION ALL SELECT k.category_id, k.rank, CASE WHEN list_has_any(g.seen, k.ids) THEN g.seen ELSE list_concat(g.seen, k.ids) END, CASE WHEN list_has_any(g.seen, k.ids) THEN []::INT[] ELSE k.ids END FROM g JOIN k ON k.category_id = g.category_id AND k.rank = g.rank + 1),
won AS (SELECT list_min(ids) AS match_id, unnest(ids) AS product_id FROM g),
nm AS (SELECT won.match_id, p.source_id, won.product_id FROM won JOIN products p ON p.id = won.product_id)
"""
CONFIRMED = """
lm AS (SELECT id AS match_id, unnest([ecuga_id, cugaklik_id, promili_id, diskontfumar_id, rotodinamic_id]) AS product_id FROM possible_matches WHERE review_status = 'confirmed'),
lf AS (SELECT product_id, min(match_id) AS first_id FROM lm WHERE product_id IS NOT NULL GROUP BY product_id),
lo AS (SELECT lm.match_id FROM lm JOIN lf USING (product_id) GROUP BY lm.match_id HAVING bool_and(lm.match_id = lf.first_id) AND count(*) >= 2),
confirmed AS (SELECT DISTINCT lm.product_id FROM lm JOIN lo USING (match_id) WHERE lm.product_id IS NOT NULL)
"""


def suggestions_sql(low: float) -> str:
    kinds = ["near_miss", "overlap"] if low > 0.5 else ["near_miss"]
    conditions = {"near_miss": f"best >= {low}", "overlap": f"best < {low} AND o >= 0.7 AND best >= 0.5"}
    # Scores of all pairs are needed, so the pairs are taken before their floor.
    out = BUCKETS.rstrip() + """,
every AS (SELECT *, CASE WHEN digit_blocked THEN j ELSE greatest(j, t) END AS best FROM s)"""
    for kind in kinds:
        out += f""",
{kind}_p AS (SELECT DISTINCT x.product_id AS a, y.product_id AS b FROM (SELECT category_id, bucket, id_a, id_b FROM every WHERE best < 0.7 AND {conditions[kind]} UNION SELECT category_id, bucket, id_b, id_a FROM every WHERE best < 0.7 AND {conditions[kind]}) e
  JOIN cls ca ON ca.category_id = e.category_id AND ca.bucket = e.bucket AND ca.first_id = e.id_a JOIN cls cb ON cb.category_id = e.category_id AND cb.bucket = e.bucket AND cb.first_id = e.id_b
  JOIN m x ON x.category_id = e.category_id AND x.bucket = e.bucket AND x.key = ca.key JOIN m y ON y.category_id = e.category_id AND y.bucket = e.bucket AND y.key = cb.key WHERE x.source_id <> y.source_id),
{kind}_r AS (SELECT DISTINCT a AS n, a AS l FROM {kind}_p UNION SELECT p.b, r.l FROM {kind}_r r JOIN {kind}_p p ON p.a = r.n),
{kind}_c AS (SELECT n AS product_id, min(l) AS comp FROM {kind}_r GROUP BY n),""" + resolved_sql(kind, f"SELECT DISTINCT q.comp, q.product_id, k.source_id, list_distinct(k.toks) AS words FROM {kind}_c q JOIN keyed k USING (product_id)", "comp")
    out = out.rstrip() + ",\nchosen AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM {kind}" for kind in kinds) + "),"
    return out + f"""
lists AS (SELECT c.*, coalesce(k.volume_ml, -1) AS bucket, list_distinct(k.toks) AS words, list_sort(list_distinct(list_filter(k.toks, lambda x: x IN ({words_sql(VARIANTS)})))) AS variants,
  CASE WHEN length(k.key) = 0 THEN [] WHEN length(k.key) < 3 THEN [k.key] ELSE list_distinct(list_transform(generate_series(1, length(k.key) - 2), lambda i: substring(k.key, i::INT, 3))) END AS pieces FROM chosen c JOIN keyed k USING (product_id)),
two AS (SELECT x.kind, x.comp, max(CASE WHEN len(x.words) + len(y.words) = 0 THEN 1.0 ELSE len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words))) END) AS j, max(CASE WHEN len(x.pieces) + len(y.pieces) = 0 THEN 1.0 ELSE len(list_intersect(x.pieces, y.pieces)) / len(list_distinct(list_concat(x.pieces, y.pieces))) END) AS t
  FROM lists x JOIN lists y ON x.kind = y.kind AND x.comp = y.comp AND x.product_id < y.product_id AND x.variants = y.variants AND (x.bucket = y.bucket OR x.bucket = -1 OR y.bucket = -1) GROUP BY x.kind, x.comp),
sug AS (SELECT kind, comp AS first_id, count(*)::BIGINT AS shops, array_to_string(list_sort(array_agg(product_id)), ',') AS listings, round_even(coalesce(any_value(two.j), 0.0), 3) AS jaccard, round_even(coalesce(any_value(two.t), 0.0), 3) AS trigram FROM chosen LEFT JOIN two USING (kind, comp) GROUP BY kind, comp)
"""


# The four matchers under the comparison rules: every pair of a bucket measured, components by closure.
COMPARED_BUCKETS = BUCKETS[: BUCKETS.index("m AS (")].replace(TOKENS, COMPARED_TOKENS) + "m AS (SELECT category_id, coalesce(volume_ml, -1) AS bucket, product_id, source_id, key, toks FROM keyed),\n" + BUCKETS[BUCKETS.index("cls AS (") : BUCKETS.index("near AS (")].replace(words_sql(VARIANTS), words_sql(COMPARED_VARIANTS)).replace("len(a.words) AS wa, len(b.words) AS wb", "len(a.words) AS wa, len(b.words) AS wb, list_sum(list_transform(list_intersect(a.words, b.words), lambda x: idf.m[x] * idf.m[x])) / sqrt(list_sum(list_transform(a.words, lambda x: idf.m[x] * idf.m[x])) * list_sum(list_transform(b.words, lambda x: idf.m[x] * idf.m[x]))) AS cosine").replace("WHERE a.variants = b.variants", "CROSS JOIN idf WHERE a.variants = b.variants").replace("cls AS (", "w AS (SELECT token, ln(((SELECT count(*) FROM keyed) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM (SELECT unnest(list_distinct(toks)) AS token FROM keyed) GROUP BY token), idf AS (SELECT map(array_agg(token), array_agg(idf)) AS m FROM w),\ncls AS (", 1).replace("\ns AS (SELECT category_id", "\ns AS (SELECT cosine, category_id", 1).rstrip().rstrip(",")
MATCHER_PAIRS = COMPARED_BUCKETS + """,
links AS (SELECT 'jaccard' AS matcher, category_id, bucket, id_a, id_b FROM s WHERE j >= 0.7 UNION ALL SELECT 'trigram', category_id, bucket, id_a, id_b FROM s WHERE t >= 0.7 UNION ALL SELECT 'overlap', category_id, bucket, id_a, id_b FROM s WHERE o >= 0.7
  UNION ALL SELECT 'cosine', category_id, bucket, id_a, id_b FROM s WHERE cosine >= 0.7 - 1e-12),
ways AS (SELECT matcher, category_id, bucket, id_a AS a, id_b AS b FROM links UNION SELECT matcher, category_id, bucket, id_b, id_a FROM links),
r AS (SELECT matcher, category_id, bucket, first_id AS n, first_id AS l FROM cls CROSS JOIN (SELECT unnest(['jaccard', 'trigram', 'overlap', 'cosine']) AS matcher) WHERE matcher <> 'cosine' OR len(words) > 0 UNION SELECT r.matcher, r.category_id, r.bucket, ways.b, r.l FROM r JOIN ways ON ways.matcher = r.matcher AND ways.category_id = r.category_id AND ways.bucket = r.bucket AND ways.a = r.n),
comp AS (SELECT matcher, category_id, bucket, n AS first_id, min(l) AS comp FROM r GROUP BY matcher, category_id, bucket, n),""" + resolved_sql("c", "SELECT comp.matcher, m.category_id, m.bucket, comp.comp, m.product_id, m.source_id, cls.words FROM m JOIN cls USING (category_id, bucket, key) JOIN comp USING (category_id, bucket, first_id)", "matcher, category_id, bucket, comp").rstrip() + """,
mp AS (SELECT DISTINCT x.matcher, x.product_id AS id_a, y.product_id AS id_b FROM c x JOIN c y ON x.matcher = y.matcher AND x.category_id = y.category_id AND x.bucket = y.bucket AND x.comp = y.comp AND x.product_id < y.product_id),
names AS (SELECT unnest(['jaccard', 'trigram', 'overlap', 'cosine']) AS matcher),
dis AS (SELECT matcher, 'only_here' AS side, id_a, id_b FROM mp WHERE matcher <> 'jaccard' AND (id_a, id_b) NOT IN (SELECT (id_a, id_b) FROM mp WHERE matcher = 'jaccard')
  UNION ALL SELECT names.matcher, 'only_jaccard', id_a, id_b FROM mp CROSS JOIN names WHERE mp.matcher = 'jaccard' AND names.matcher <> 'jaccard' AND (names.matcher, id_a, id_b) NOT IN (SELECT (matcher, id_a, id_b) FROM mp))
"""

FP = """,
fp AS (SELECT kind, comp AS first_id, md5(string_agg(s.name || ':' || p.product_url, ',' ORDER BY s.name || ':' || p.product_url)) AS fingerprint, bool_or(p.id IN (SELECT product_id FROM confirmed)) AS taken FROM chosen JOIN products p ON p.id = chosen.product_id JOIN sources s ON s.id = p.source_id GROUP BY kind, comp)
"""

ORACLES = {
    "match_keys": f"SELECT id, array_to_string(coalesce({TOKENS}, []), ' ') AS key FROM products",
    "key_members": BUCKETS + "SELECT m.category_id, m.bucket, m.product_id, c.first_id FROM m JOIN cls c USING (category_id, bucket, key)",
    "all_scored_pairs": BUCKETS + "SELECT category_id, bucket, id_a, id_b, round(j, 6) AS j, round(t, 6) AS t, round(o, 6) AS o, digit_blocked FROM near",
    "matching_statistics": BUCKETS.rstrip() + ",\nb AS (SELECT category_id, bucket, count(DISTINCT source_id) AS n FROM m GROUP BY category_id, bucket) SELECT (SELECT count(DISTINCT product_id) FROM m)::BIGINT AS listings, (SELECT count(*) FROM m)::BIGINT AS placements, (SELECT count(*) FROM b)::BIGINT AS buckets, (SELECT count(*) FROM b WHERE n > 1)::BIGINT AS buckets_across",
    "token_weights": f"WITH c AS (SELECT coalesce({COMPARED_TOKENS}, []) AS toks FROM products WHERE is_available AND category_id IS NOT NULL), t AS (SELECT unnest(list_distinct(toks)) AS token FROM c) SELECT token, count(*)::BIGINT AS df, round(ln(((SELECT count(*) FROM c) + 1.0) / (count(*) + 1.0)) + 1.0, 6) AS idf FROM t GROUP BY token",
    "match_edges": BUCKETS + "SELECT category_id, bucket, id_a, id_b FROM e",
    "pair_kinds": BUCKETS + "SELECT category_id, bucket, id_a, id_b, round(best, 6) AS best, CASE WHEN best >= 0.37 THEN 'near_miss' ELSE 'overlap' END AS kind FROM near WHERE best < 0.7 AND (best >= 0.37 OR (o >= 0.7 AND best >= 0.5))",
    "pair_kinds_high_floor": BUCKETS + "SELECT category_id, bucket, id_a, id_b, round(best, 6) AS best, CASE WHEN best >= 0.55 THEN 'near_miss' ELSE 'overlap' END AS kind FROM near WHERE best < 0.7 AND (best >= 0.55 OR (o >= 0.7 AND best >= 0.5))",
    "match_components": COMPONENTS + " SELECT category_id, bucket, first_id, comp AS component FROM comp",
    "match_clusters": CLUSTERS + "SELECT category_id, bucket, product_id, source_id FROM c",
    "new_matches": GREEDY + "SELECT * FROM nm",
    "matches_beside_confirmed": GREEDY.rstrip() + "," + CONFIRMED + "SELECT * FROM nm WHERE match_id NOT IN (SELECT match_id FROM nm WHERE product_id IN (SELECT product_id FROM confirmed))",
    "run_counters": GREEDY.rstrip() + "," + CONFIRMED.rstrip() + ",\nhit AS (SELECT count(DISTINCT match_id) AS n FROM nm WHERE product_id IN (SELECT product_id FROM confirmed)), al AS (SELECT count(DISTINCT match_id) AS n FROM nm) SELECT (SELECT count(DISTINCT category_id) FROM base)::BIGINT AS categories, (SELECT count(*) FROM (SELECT DISTINCT category_id, volume_ml FROM base))::BIGINT AS volume_groups, al.n::BIGINT AS clusters_found, (al.n - hit.n)::BIGINT AS rows_inserted, hit.n::BIGINT AS rows_skipped_conflict FROM al, hit",
    "run_summary": GREEDY.rstrip() + "," + CONFIRMED.rstrip() + ",\nhit AS (SELECT count(DISTINCT match_id) AS n FROM nm WHERE product_id IN (SELECT product_id FROM confirmed)), al AS (SELECT count(DISTINCT match_id) AS n FROM nm) SELECT to_json({'categories': (SELECT count(DISTINCT category_id) FROM base), 'volume_groups': (SELECT count(*) FROM (SELECT DISTINCT category_id, volume_ml FROM base)), 'clusters_found': al.n, 'rows_inserted': al.n - hit.n, 'rows_skipped_conflict': hit.n})::VARCHAR AS row FROM al, hit",
    "cluster_histogram": GREEDY + "SELECT shops, count(*)::BIGINT AS matches FROM (SELECT match_id, count(*)::INT AS shops FROM nm GROUP BY match_id) GROUP BY shops",
    "cluster_labels": GREEDY + "SELECT match_id, arg_min(title, length(title) * 1000000000000 + product_id) AS label, CASE count(DISTINCT volume_ml) WHEN 0 THEN 'no-vol' WHEN 1 THEN min(volume_ml)::VARCHAR ELSE 'mixed-vol' END AS volume FROM nm JOIN products p ON p.id = nm.product_id GROUP BY match_id",
    "suggested_clusters": suggestions_sql(0.37) + "SELECT * FROM sug",
    "suggested_clusters_high_floor": suggestions_sql(0.55) + "SELECT * FROM sug",
    "suggestion_queue": suggestions_sql(0.37).rstrip() + "," + CONFIRMED.rstrip() + FP + "SELECT fingerprint, max(sug.shops)::INT AS members, max(jaccard) AS jaccard, max(trigram) AS trigram, min(kind) AS suggestion_source FROM fp JOIN sug USING (kind, first_id) WHERE NOT taken AND fingerprint NOT IN (SELECT group_fingerprint FROM possible_matches WHERE group_fingerprint IS NOT NULL) GROUP BY fingerprint",
    "suggestion_counters": suggestions_sql(0.37).rstrip() + "," + CONFIRMED.rstrip() + FP + "SELECT count(*)::BIGINT AS groups, count(*) FILTER (WHERE taken)::BIGINT AS skipped_already_matched, count(*) FILTER (WHERE NOT taken AND queued)::BIGINT AS skipped_already_queued, count(DISTINCT fingerprint) FILTER (WHERE NOT taken AND NOT queued)::BIGINT AS inserted FROM (SELECT *, fingerprint IN (SELECT group_fingerprint FROM possible_matches WHERE group_fingerprint IS NOT NULL) AS queued FROM fp)",
    "matcher_summary": MATCHER_PAIRS + "SELECT matcher, count(*)::BIGINT AS pairs, count(DISTINCT id_a)::BIGINT AS first_listings FROM mp GROUP BY matcher",
    "matcher_agreement": MATCHER_PAIRS + "SELECT a.matcher AS matcher_a, b.matcher AS matcher_b, (SELECT count(*) FROM mp x JOIN mp y USING (id_a, id_b) WHERE x.matcher = a.matcher AND y.matcher = b.matcher)::BIGINT AS common, round((SELECT count(*) FROM mp x JOIN mp y USING (id_a, id_b) WHERE x.matcher = a.matcher AND y.matcher = b.matcher) / greatest(1, (SELECT count(*) FROM mp x WHERE x.matcher = a.matcher)) * 100, 6) AS percent FROM names a CROSS JOIN names b",
    "consensus_pairs": MATCHER_PAIRS + "SELECT id_a, id_b FROM mp GROUP BY id_a, id_b HAVING count(*) = 4",
    "matcher_disagreements": MATCHER_PAIRS + "SELECT names.matcher, count(*) FILTER (WHERE side = 'only_here')::BIGINT AS only_here, count(*) FILTER (WHERE side = 'only_jaccard')::BIGINT AS only_jaccard FROM names LEFT JOIN dis USING (matcher) WHERE names.matcher <> 'jaccard' GROUP BY names.matcher",
    "matcher_examples": MATCHER_PAIRS + "SELECT matcher, side, k::INT AS k, id_a, id_b, a.title AS title_a, b.title AS title_b FROM (SELECT *, row_number() OVER (PARTITION BY matcher, side ORDER BY id_a, id_b) AS k FROM dis) JOIN products a ON a.id = id_a JOIN products b ON b.id = id_b WHERE k <= 5",
}
