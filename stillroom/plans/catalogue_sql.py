"""SQL for DuckDB that checks the catalogue's queries, written by itself: wide joins where the plans use long form."""

from __future__ import annotations

from stillroom.functions.titles import CONTENT, PACKAGING
from stillroom.operators.groups import SHOPS

C1, C2, C3, C4, C5 = (SHOPS[s] for s in range(1, 6))
LONG = "SELECT id AS match_id, review_status, unnest([1, 2, 3, 4, 5]) AS source_id, unnest([" + ", ".join(SHOPS.values()) + "]) AS product_id FROM possible_matches"
PM = f"""
WITH lm AS (SELECT * FROM ({LONG}) WHERE product_id IS NOT NULL AND review_status = 'confirmed'),
f AS (SELECT product_id, min(match_id) AS first_id FROM lm GROUP BY product_id),
ok AS (SELECT lm.match_id FROM lm JOIN f USING (product_id) GROUP BY lm.match_id HAVING min((lm.match_id = f.first_id)::INT) = 1 AND count(*) >= 2),
pm AS (SELECT * FROM possible_matches WHERE id IN (SELECT match_id FROM ok)),
om AS (SELECT lm.* FROM lm JOIN ok USING (match_id))
"""
GROUPS = (
    PM
    + f""", vg AS (
SELECT 'g' || pm.id AS group_id, pm.id::INT AS match_id, NULL::INT AS singleton_id,
  coalesce(p3.title, p1.title, p4.title, p2.title, p5.title) AS display_title, coalesce(p1.image_url, p2.image_url, p4.image_url, p3.image_url, p5.image_url) AS display_image_url,
  coalesce(p1.volume_ml, p2.volume_ml, p4.volume_ml, p3.volume_ml, p5.volume_ml) AS volume_ml, coalesce(c1.slug, c2.slug, c4.slug, c3.slug, c5.slug) AS category_slug,
  coalesce(c1.display_name, c2.display_name, c4.display_name, c3.display_name, c5.display_name) AS category_name,
  least(p1.price, p2.price, p3.price, p4.price, p5.price) AS min_price, greatest(p1.price, p2.price, p3.price, p4.price, p5.price) AS max_price,
  ((p1.id IS NOT NULL)::INT + (p2.id IS NOT NULL)::INT + (p3.id IS NOT NULL)::INT + (p4.id IS NOT NULL)::INT + (p5.id IS NOT NULL)::INT) AS store_count
FROM pm {" ".join(f"LEFT JOIN products p{s} ON p{s}.id = pm.{c} AND p{s}.is_available AND p{s}.price > 0 LEFT JOIN categories c{s} ON c{s}.id = p{s}.category_id" for s, c in SHOPS.items())}
WHERE coalesce(p1.id, p2.id, p3.id, p4.id, p5.id) IS NOT NULL
UNION ALL
SELECT 'p' || p.id, NULL, p.id, p.title, p.image_url, p.volume_ml, c.slug, c.display_name, p.price, p.price, 1
FROM products p LEFT JOIN categories c ON c.id = p.category_id
WHERE p.is_available AND p.price > 0 AND NOT EXISTS (SELECT 1 FROM pm WHERE {" OR ".join(f"pm.{c} = p.id" for c in SHOPS.values())})),
sg AS (SELECT *, round(max_price - min_price, 2)::DECIMAL(10, 2) AS savings FROM vg)
"""
)
HITS = (
    GROUPS
    + f""", hit AS (SELECT id FROM products WHERE normalized_title ILIKE '%reserve%'),
found AS (SELECT sg.* FROM sg WHERE match_id IN ({" UNION ".join(f"SELECT pm.id FROM pm JOIN hit ON hit.id = pm.{c}" for c in SHOPS.values())})
UNION ALL SELECT sg.* FROM sg WHERE singleton_id IN (SELECT id FROM hit))
"""
)
ORDER = {
    "price_asc": "min_price ASC NULLS LAST, display_title ASC NULLS LAST", "price_desc": "min_price DESC NULLS FIRST, display_title ASC NULLS LAST", "name_asc": "display_title ASC NULLS LAST",
    "name_desc": "display_title DESC NULLS FIRST", "savings_desc": "savings DESC NULLS FIRST, min_price ASC NULLS LAST",
}


def sql_class(pattern: str) -> str:
    """A pattern with classes that cover all of Unicode in this dialect."""
    spaced = pattern.replace(r"_\s]", r"_\s\p{Z}]") if "[^" in pattern else pattern.replace(r"\s", r"[\s\p{Z}]")
    return spaced.replace(r"\d", r"\p{Nd}").replace("'", "''")


def chained(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        column = f"regexp_replace({column}, '{sql_class(pattern)}', '{by}', 'g')"
    return column


STEPS = [(r"\d+[,.]?\d*\s*%", ""), (r"\bthe\s+", ""), (r"([a-z])(\d+[,.]?\d*)(l|ml|cl)\b", r"\1 \2\3")]
for _pattern, _by in ((r"(\d+)[,.](\d{2})\s*l\b", r"\1\20ml"), (r"(\d+)[,.](\d)\s*l\b", r"\1\200ml"), (r"(\d+)\s*l\b", r"\1000ml"), (r"(\d+)\s*cl\b", r"\10ml")):
    STEPS += [(_pattern, "~~" + _by), (r"~~0*(\d+ml)", r"\1")]
STEPS += [(r"(\d+)\s+ml\b", r"\1ml"), (r"(\d+)\s*y\.?o\.?", r"\1yo"), (r"(\d+)\s*years?\s*old", r"\1yo"), (r"(\d+)\s*years?", r"\1yo"), *[(p, "") for p in PACKAGING], (r"[^\p{L}\p{N}_\s]", " "), (r"\s+", " ")]
NORMAL = f"trim({chained('replace(lower(title), $$whiskey$$, $$whisky$$)', STEPS)})"


def content(text: str) -> str:
    tried = []
    for pattern, kind, factor in CONTENT:
        a, b, c = (f"try_cast(regexp_extract(lower({text}), '{sql_class(pattern)}', {g}) AS BIGINT)" for g in (1, 2, 3))
        ml = {"pack3": f"{a} * ({b} * 1000 + {c} * {factor})", "pack": f"{a} * {b} * {factor}", "decimal": f"{a} * 1000 + {b} * {factor}", "single": f"{a} * {factor}"}[kind]
        tried.append(f"CASE WHEN {ml} BETWEEN 10 AND 50000 THEN ({ml})::INT END")
    return f"coalesce({', '.join(tried)})"


SIZE = "coalesce(metadata::JSON->>'$.size', metadata::JSON->>'$.pack.size')"
BARE = "regexp_replace(price_original, '[€$\\s\\p{Z}]', '', 'g')"
PLAIN_PRICE = f"CASE WHEN contains({BARE}, ',') THEN replace(CASE WHEN contains({BARE}, '.') THEN replace({BARE}, '.', '') ELSE {BARE} END, ',', '.') ELSE {BARE} END"
WEEK, MONTH = "TIMESTAMPTZ '2026-03-15 00:00:00+00' - INTERVAL 7 DAY", "TIMESTAMPTZ '2026-03-15 00:00:00+00' - INTERVAL 30 DAY"
# Every delivery from the second on, each merged into what the one before it left.
MERGES = """
WITH d AS (SELECT snapshot_no, source_id, product_id, price, is_available, last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, source_id, product_id ORDER BY last_seen_at DESC NULLS LAST) AS k FROM product_snapshots) WHERE k = 1),
landed_at AS (SELECT snapshot_no, max(snapshot_at) AS landing FROM product_snapshots GROUP BY snapshot_no),
s1 AS (SELECT source_id, product_id, price, is_available, last_seen_at FROM d WHERE snapshot_no = 1)"""
for _n in range(2, 6):
    MERGES += f""",
d{_n} AS (SELECT * FROM d WHERE snapshot_no = {_n}),
m{_n} AS (SELECT {_n} AS snapshot_no, coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.product_id, b.product_id) AS product_id, a.price AS old_price, a.is_available AS old_available,
  CASE WHEN b.product_id IS NOT NULL THEN b.price ELSE a.price END AS price,
  CASE WHEN b.product_id IS NOT NULL THEN true WHEN a.is_available AND a.source_id IN (SELECT source_id FROM d{_n}) THEN false ELSE a.is_available END AS is_available,
  CASE WHEN b.product_id IS NOT NULL THEN (SELECT landing FROM landed_at WHERE snapshot_no = {_n}) ELSE a.last_seen_at END AS last_seen_at,
  CASE WHEN a.product_id IS NULL THEN 'inserted' WHEN b.product_id IS NOT NULL THEN 'updated' WHEN a.is_available AND a.source_id IN (SELECT source_id FROM d{_n}) THEN 'deactivated' ELSE 'kept' END AS outcome
  FROM s{_n - 1} a FULL JOIN d{_n} b ON a.source_id = b.source_id AND a.product_id = b.product_id),
s{_n} AS (SELECT source_id, product_id, price, is_available, last_seen_at FROM m{_n})"""
MERGES += ",\nm AS (" + " UNION ALL ".join(f"SELECT * FROM m{n}" for n in range(2, 6)) + ")\n"
CURRENT = "SELECT p.id, p.title, p.price, p.currency, p.product_url, c.display_name AS category, c.slug AS category_slug, s.display_name AS source, s.name AS source_name FROM products p LEFT JOIN categories c ON p.category_id = c.id JOIN sources s ON p.source_id = s.id WHERE p.is_available"
ISO = "%Y-%m-%dT%H:%M:%S"
TRIMMED = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
PATH = "regexp_replace(product_url, '^https?://[^/]+', '')"


def per_shop(text: str) -> str:
    """A list over the filled shop columns of a text with p1 to p5 (listings) and c1 to c5 (categories)."""
    return "list_filter([" + ", ".join(f"CASE WHEN pm.{c} IS NOT NULL THEN {text.format(s=s)} END" for s, c in SHOPS.items()) + "], lambda x: x IS NOT NULL)"


ORACLES = {
    "current_prices": CURRENT,
    "price_comparison": PM + f"SELECT pm.id AS match_id, coalesce(p1.title, p2.title, p3.title, p4.title, p5.title) AS title, coalesce(p1.volume_ml, p2.volume_ml, p3.volume_ml, p4.volume_ml, p5.volume_ml) AS volume_ml, least(p1.price, p2.price, p3.price, p4.price, p5.price) AS min_price, greatest(p1.price, p2.price, p3.price, p4.price, p5.price) AS max_price, {', '.join(f'p{s}.id AS {c.removesuffix("_id")}_product_id, p{s}.price AS {c.removesuffix("_id")}_price, p{s}.product_url AS {c.removesuffix("_id")}_url' for s, c in SHOPS.items())} FROM pm {' '.join(f'LEFT JOIN products p{s} ON p{s}.id = pm.{c}' for s, c in SHOPS.items())}",
    "groups_view": GROUPS + "SELECT * FROM vg",
    **{f"browse_{name}": GROUPS + f"SELECT * FROM sg ORDER BY {order}, group_id LIMIT 24" for name, order in ORDER.items()},
    "browse_filtered": GROUPS + f"SELECT * FROM sg WHERE category_slug IN ('gin', 'rum', 'whisky') AND min_price BETWEEN 5 AND 60 AND volume_ml = 700 ORDER BY {ORDER['price_asc']}, group_id LIMIT 100",
    "browse_total": GROUPS + "SELECT count(*)::BIGINT AS total FROM sg WHERE category_slug IN ('gin', 'rum', 'whisky') AND min_price BETWEEN 5 AND 60 AND store_count >= 1",
    "featured_savings": GROUPS + f"SELECT * FROM sg ORDER BY {ORDER['savings_desc']}, group_id LIMIT 6",
    "group_detail": PM + ", r AS (SELECT om.match_id, om.source_id, s.display_name AS shop, p.id AS product_id, p.title, p.price, CASE om.source_id WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 3 THEN 4 ELSE 5 END AS place FROM om JOIN products p ON p.id = om.product_id AND p.is_available AND p.price > 0 JOIN sources s ON s.id = om.source_id), w AS (SELECT *, min(price) OVER m AS lo, max(price) OVER m AS hi, row_number() OVER (PARTITION BY match_id ORDER BY price, place) AS k FROM r WINDOW m AS (PARTITION BY match_id)) SELECT match_id, source_id, shop, product_id, title, price, k = 1 AS is_cheapest, round(hi - lo, 2)::DECIMAL(10, 2) AS savings, round_even((hi - lo)::DOUBLE / hi::DOUBLE * 100, 1) AS savings_percent FROM w",
    "singleton_detail": GROUPS + "SELECT p.id, p.title, p.price, p.volume_ml, c.display_name AS category, s.display_name AS shop FROM vg JOIN products p ON p.id = vg.singleton_id JOIN sources s ON s.id = p.source_id LEFT JOIN categories c ON c.id = p.category_id",
    "search_groups": HITS + "SELECT * FROM found",
    "search_filtered": HITS + "SELECT * FROM found WHERE category_slug IN ('whisky', 'rum') AND min_price <= 80 AND store_count >= 2",
    "search_total": HITS + "SELECT count(*)::BIGINT AS total FROM found",
    "suggestions_for_title": GROUPS + "SELECT group_id, display_title, store_count, min_price FROM vg WHERE display_title ILIKE '%reserve%' ORDER BY store_count DESC, min_price ASC, group_id LIMIT 8",
    "category_counts": GROUPS + "SELECT c.id, c.slug, c.display_name, count(*)::BIGINT AS groups FROM categories c JOIN vg ON vg.category_slug = c.slug GROUP BY c.id, c.slug, c.display_name",
    "vendor_counts": "SELECT s.id AS source_id, s.name, s.display_name, count(p.id)::BIGINT AS listings FROM sources s LEFT JOIN products p ON p.source_id = s.id AND p.is_available AND p.price > 0 WHERE s.is_active GROUP BY s.id, s.name, s.display_name",
    "landing_stats": GROUPS + "SELECT (SELECT count(*) FROM products WHERE is_available AND price > 0)::BIGINT AS products_total, (SELECT count(*) FROM vg)::BIGINT AS groups_total, (SELECT count(DISTINCT category_slug) FROM vg)::BIGINT AS categories_total, (SELECT count(*) FROM sources WHERE is_active)::BIGINT AS stores_total, (SELECT count(*) FROM vg WHERE store_count >= 2)::BIGINT AS matched_groups",
    "cheapest_in_category": "SELECT * FROM (SELECT category_id, row_number() OVER (PARTITION BY category_id ORDER BY price, id)::INT AS k, id, title, price FROM products WHERE is_available AND price > 0 AND category_id IS NOT NULL) WHERE k <= 10",
    "cheapest_hits": CURRENT + " AND p.title ILIKE '%reserve%' ORDER BY p.price NULLS LAST, p.id LIMIT 50 OFFSET 50",
    "word_hits": r"SELECT id FROM products WHERE list_contains(regexp_split_to_array(lower(title), '[^\p{L}\p{N}_\p{M}\x{200c}\x{200d}]+'), 'double') AND list_contains(regexp_split_to_array(lower(title), '[^\p{L}\p{N}_\p{M}\x{200c}\x{200d}]+'), 'wood')",
    "price_steps": "SELECT id, product_id, before, price, (price - before)::DECIMAL(10, 2) AS step FROM (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY recorded_at, id) AS before FROM price_history) WHERE price <> before",
    "title_lookup": "WITH a AS (SELECT p.id AS request, s.id AS shop, CASE WHEN p.id % 200 = 0 THEN upper(p.title) ELSE substring(p.title, 1, 12) END AS t FROM products p, sources s WHERE p.id % 100 = 0 AND length(trim(p.title)) > 0), h AS (SELECT a.request, a.shop, p.id AS product_id, CASE WHEN lower(a.t) = lower(p.title) THEN 1 ELSE 2 END AS pass, CASE WHEN lower(a.t) = lower(p.title) THEN 0 ELSE length(p.title) END AS l FROM a JOIN products p ON p.source_id = a.shop AND (lower(a.t) = lower(p.title) OR starts_with(lower(p.title), lower(trim(substring(a.t, 1, 40)))))) SELECT request, shop, product_id, pass FROM (SELECT *, row_number() OVER (PARTITION BY request, shop ORDER BY pass, l, product_id) AS k FROM h) WHERE k = 1",
    "group_badges": GROUPS + "SELECT group_id, store_count > 1 AND savings > 0.01 AS has_badge, CASE WHEN volume_ml >= 1000 THEN regexp_replace(printf('%.1f', volume_ml / 1000.0), '\\.0$', '') || ' L' ELSE volume_ml || ' ml' END AS volume_label, CASE WHEN volume_ml >= 1000 THEN regexp_replace(printf('%.1f', volume_ml / 1000.0), '\\.0$', '') || 'L' ELSE volume_ml || 'ml' END AS chip_label, replace(min_price::VARCHAR, '.', ',') AS price_label, replace(savings::VARCHAR, '.', ',') || ' €' AS savings_label, floor(round_even((max_price - min_price)::DOUBLE / max_price::DOUBLE * 100, 1) + 0.5)::BIGINT || '%' AS percent_label, substring(display_title, 1, 55) AS short_title FROM sg",
    "shop_counts": "SELECT s.name, count(*)::BIGINT AS listings FROM products p JOIN sources s ON p.source_id = s.id GROUP BY s.name",
    "avg_by_category": "SELECT c.name, round(avg(p.price::DOUBLE), 4) AS avg_price, count(*)::BIGINT AS listings FROM products p JOIN categories c ON p.category_id = c.id WHERE p.price IS NOT NULL GROUP BY c.name",
    "avg_by_category_shop": "SELECT c.name AS category, s.name AS shop, round(avg(p.price::DOUBLE), 4) AS avg_price FROM products p JOIN categories c ON p.category_id = c.id JOIN sources s ON p.source_id = s.id WHERE p.price IS NOT NULL GROUP BY c.name, s.name",
    "price_history_window": f"SELECT id, product_id, price, recorded_at FROM price_history WHERE recorded_at >= {MONTH}",
    "listing_history": f"SELECT id, price, recorded_at FROM price_history WHERE recorded_at >= {MONTH} AND product_id = 1",
    "recent_changes": f"SELECT DISTINCT p.id, p.title, p.price FROM products p JOIN price_history h ON h.product_id = p.id WHERE h.recorded_at >= {WEEK}",
    "price_drops": f"SELECT h.id AS history_id, p.id, p.title, p.price AS current_price, h.price AS old_price, (h.price - p.price)::DECIMAL(10, 2) AS saved, round((h.price - p.price)::DOUBLE / h.price::DOUBLE * 100, 2) AS discount_percent FROM products p JOIN price_history h ON h.product_id = p.id WHERE h.recorded_at >= {WEEK} AND p.price < h.price ORDER BY saved DESC, h.id LIMIT 20",
    "shop_pair_differences": PM + ", r AS (SELECT om.match_id, om.source_id, p.price::DOUBLE AS price FROM om JOIN products p ON p.id = om.product_id WHERE p.is_available AND p.price > 0) SELECT a.source_id AS source_a, b.source_id AS source_b, count(*)::BIGINT AS shared, round(avg(abs(a.price - b.price)), 4) AS mean_difference FROM r a JOIN r b ON a.match_id = b.match_id AND a.source_id < b.source_id GROUP BY a.source_id, b.source_id",
    "orphan_check": f"SELECT source_id, count(*)::BIGINT AS orphans FROM ({LONG}) WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM products) GROUP BY source_id",
    "wrong_shop_check": f"SELECT l.source_id, count(*)::BIGINT AS misplaced FROM ({LONG}) l JOIN products p ON p.id = l.product_id WHERE l.source_id <> p.source_id GROUP BY l.source_id",
    "mapping_check": "SELECT s.name AS shop, coalesce(c.name, 'none') AS category, count(*)::BIGINT AS slugs FROM source_category_mappings m JOIN sources s ON s.id = m.source_id LEFT JOIN categories c ON c.id = m.canonical_category_id GROUP BY 1, 2",
    "review_queue": f"SELECT pm.id, len({per_shop('1')})::INT AS shops, array_to_string({per_shop("coalesce(p{s}.title, '?')")}, ' / ') AS titles, array_to_string({per_shop("printf('%.2f', coalesce(p{s}.price::DOUBLE, 0.0))")}, ' / ') AS prices, array_to_string({per_shop("coalesce(p{s}.product_url, '?')")}, ' ') AS urls, coalesce({', '.join(f'c{s}.display_name' for s in SHOPS)}) AS category, coalesce({', '.join(f'nullif(p{s}.volume_ml, 0)' for s in SHOPS)}) AS volume_ml, suggestion_source, jaccard_score::DOUBLE AS jaccard, trigram_score::DOUBLE AS trigram, strftime(pm.created_at AT TIME ZONE 'UTC', '{ISO}') AS created_at FROM possible_matches pm {' '.join(f'LEFT JOIN products p{s} ON p{s}.id = pm.{c} LEFT JOIN categories c{s} ON c{s}.id = p{s}.category_id' for s, c in SHOPS.items())} WHERE review_status = 'pending'",
    "review_counts": "SELECT " + ", ".join(f"count(*) FILTER (WHERE review_status = '{s}')::BIGINT AS {s}" for s in ("pending", "confirmed", "rejected", "superseded")) + " FROM possible_matches",
    "review_history": f"SELECT id, review_status, strftime(reviewed_at AT TIME ZONE 'UTC', '{ISO}') AS reviewed_at FROM (SELECT * FROM possible_matches WHERE review_status IN ('confirmed', 'rejected', 'superseded') ORDER BY reviewed_at DESC NULLS LAST, id LIMIT 200)",
    "match_table": PM + f"SELECT id, {', '.join(SHOPS.values())} FROM pm",
    "normalized_titles": f"SELECT id, {NORMAL} AS normal FROM products",
    "simple_titles": r"SELECT id, lower(regexp_replace(trim(title), '[^A-Za-z0-9\s]', '', 'g')) AS simple FROM products",
    "title_contents": f"SELECT id, {content('title')} AS of_title, coalesce({content(SIZE)}, {content('title')}) AS of_listing FROM products",
    "parsed_prices": f"SELECT id, CASE WHEN regexp_matches({PLAIN_PRICE}, '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$') THEN try_cast({PLAIN_PRICE} AS DECIMAL(10, 2)) END AS parsed FROM products",
    "resolved_urls": f"SELECT p.id, p.product_url AS url, CASE WHEN starts_with({PATH}, '/') THEN website_url || {PATH} ELSE {PATH} END AS from_path, website_url || '/' || regexp_replace({PATH}, '^/', '') AS from_relative FROM products p JOIN sources s ON s.id = p.source_id",
    "fingerprints": f"SELECT l.match_id, md5(string_agg(s.name || ':' || p.product_url, ',' ORDER BY s.name || ':' || p.product_url)) AS fingerprint FROM ({LONG}) l JOIN products p ON p.id = l.product_id JOIN sources s ON s.id = l.source_id GROUP BY l.match_id",
    "parsed_pages": r"SELECT (id // 20)::BIGINT AS page_id, regexp_replace(title, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS title, regexp_replace(replace(price_original, chr(160), chr(160)), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS price, product_url AS link, CASE WHEN starts_with(image_url, 'http') THEN image_url END AS image FROM products WHERE nullif(regexp_replace(title, '[\s\p{Z}]', '', 'g'), '') IS NOT NULL AND nullif(regexp_replace(price_original, '[\s\p{Z}]', '', 'g'), '') IS NOT NULL",
    "landing_slugs": "SELECT id, replace(file_slug, '/', '-') AS slug FROM source_category_mappings",
    "image_backfill": "WITH l AS (SELECT title, arg_max(image_url, id) AS image FROM products WHERE image_url IS NOT NULL GROUP BY title) SELECT p.id, p.title, coalesce(p.image_url, l.image) AS image_url FROM products p LEFT JOIN l ON l.title = p.title",
    "exported_sources": "SELECT to_json({'id': id, 'name': name, 'display_name': display_name, 'website_url': website_url, 'logo_url': logo_url, 'is_active': is_active})::VARCHAR AS row FROM sources",
    "snapshot_merge": MERGES + "SELECT snapshot_no, source_id, product_id, price, is_available, last_seen_at, outcome FROM m",
    "deactivated": MERGES + "SELECT snapshot_no, source_id, product_id FROM m WHERE outcome = 'deactivated'",
    "history_delta": MERGES + "SELECT snapshot_no, source_id, product_id, price, is_available AS was_available FROM m WHERE outcome <> 'inserted' AND (old_price <> price OR old_available <> is_available)",
    "browse_page": GROUPS + f"SELECT *, greatest(1, ceil(total / 10))::BIGINT AS pages FROM (SELECT *, count(*) OVER ()::BIGINT AS total FROM sg WHERE category_slug IN ('gin', 'rum', 'whisky') AND store_count >= 1) ORDER BY {ORDER['price_desc']}, group_id LIMIT 10 OFFSET 10",
    "landing_labels": GROUPS + "SELECT replace(format('{:,}', (SELECT count(*) FROM products WHERE is_available AND price > 0)), ',', chr(160)) || '+' AS products_label, replace(format('{:,}', (SELECT count(*) FROM vg)), ',', chr(160)) || '+' AS groups_label",
    "cheapest_of_category": CURRENT + " AND c.slug = 'whisky' ORDER BY p.price NULLS LAST, p.id LIMIT 100",
    "group_images": PM + f"SELECT pm.id AS match_id, coalesce(p1.image_url, p2.image_url, p4.image_url, p3.image_url, p5.image_url) AS image_url FROM pm {' '.join(f'LEFT JOIN products p{s} ON p{s}.id = pm.{c} AND p{s}.is_available AND p{s}.price > 0' for s, c in SHOPS.items())} WHERE coalesce(p1.id, p2.id, p3.id, p4.id, p5.id) IS NOT NULL",
    "paged_listings": f"WITH r AS (SELECT id, (id // 20)::BIGINT AS page_id, product_url AS link, {TRIMMED.format('title')} AS title, {TRIMMED.format('price_original')} AS price FROM products) SELECT link, title, price, CASE WHEN page_id = (SELECT min(page_id) FROM r) THEN (SELECT max(page_id) + 1 FROM r) ELSE page_id END AS turn FROM r WHERE title <> '' AND price <> ''",
    "landed_listings": "SELECT title, price_original AS price, metadata::JSON->>'$.size' AS size, product_url AS link, image_url AS image, source_id AS source, coalesce(category_id::VARCHAR, 'none') AS file_slug FROM products",
    "restored_listings": "SELECT id, title, price, last_seen_at FROM products",
    "csv_listings": "SELECT id, nullif(title, '') AS title, price FROM products",
    "mapped_slugs": "SELECT m.id, s.name AS shop, m.file_slug, c.slug AS category, CASE WHEN c.slug IS NULL THEN 'skipped' ELSE 'mapped' END AS outcome FROM source_category_mappings m JOIN sources s ON s.id = m.source_id LEFT JOIN categories c ON c.id = m.canonical_category_id",
    "curated_groups": f"WITH e AS (SELECT l.match_id AS group_id, l.source_id, s.name AS source, upper(p.title) AS original_title, row_number() OVER (PARTITION BY l.match_id ORDER BY l.source_id) - 1 AS position, count(*) OVER (PARTITION BY l.match_id) AS n FROM ({LONG}) l JOIN products p ON p.id = l.product_id JOIN sources s ON s.id = l.source_id WHERE l.review_status = 'pending'), t AS (SELECT group_id, source_id, source, original_title, position FROM e UNION ALL SELECT group_id, source_id, source, original_title, n FROM e WHERE position = 0) SELECT group_id::INT AS group_id, 'group ' || group_id AS matched_name, 'mixed' AS category, 'ambiguous' AS classification, position::INT AS position, source, original_title FROM t",
    "seeded_groups": f"{PM.rstrip()}, e AS (SELECT l.match_id AS group_id, l.source_id, s.name AS source, upper(p.title) AS original_title, row_number() OVER (PARTITION BY l.match_id ORDER BY l.source_id) - 1 AS position, count(*) OVER (PARTITION BY l.match_id) AS n FROM ({LONG}) l JOIN products p ON p.id = l.product_id JOIN sources s ON s.id = l.source_id WHERE l.review_status = 'pending'), t AS (SELECT group_id, source_id, source, original_title, position FROM e UNION ALL SELECT group_id, source_id, source, original_title, n FROM e WHERE position = 0), w AS (SELECT source_id, lower(title) AS low, min(id) AS product_id FROM products GROUP BY source_id, lower(title)), sf AS (SELECT t.group_id, t.source_id, w.product_id FROM t JOIN w ON w.source_id = t.source_id AND w.low = lower(t.original_title) WHERE trim(t.original_title) <> '' AND t.position = (SELECT min(x.position) FROM t x WHERE x.group_id = t.group_id AND x.source_id = t.source_id)) SELECT group_id::INT AS group_id, source_id, product_id FROM sf WHERE group_id IN (SELECT group_id FROM sf GROUP BY group_id HAVING count(*) > 1) AND group_id NOT IN (SELECT group_id FROM sf WHERE product_id IN (SELECT product_id FROM om))",
    "listing_upsert": MERGES.rstrip() + f""", f AS (SELECT id AS fid, trim(title) AS t, {NORMAL} AS n, {content('title')} AS v FROM products),
u AS (SELECT coalesce(p.source_id, l.source_id) AS source_id, coalesce(p.id, l.product_id) AS product_id, l.product_id IS NOT NULL AS landed, p.id IS NULL AS fresh, coalesce(p.is_available AND p.source_id IN (SELECT source_id FROM d4), false) AS live, p.*, l.price AS new_price, f.* FROM (SELECT id, source_id AS sid, title, normalized_title, volume_ml, price, is_available, last_seen_at, updated_at, out_of_stock_count, source_id FROM products) p FULL JOIN d4 l ON l.product_id = p.id AND l.source_id = p.source_id LEFT JOIN f ON f.fid = l.product_id)
SELECT u.source_id, u.product_id, CASE WHEN landed THEN t ELSE title END AS title, CASE WHEN landed THEN n ELSE normalized_title END AS normalized_title, CASE WHEN landed THEN v ELSE volume_ml END AS volume_ml, CASE WHEN landed THEN new_price ELSE price END AS price, CASE WHEN landed THEN true WHEN live THEN false ELSE is_available END AS is_available,
  CASE WHEN landed THEN TIMESTAMPTZ '2026-03-15 00:00:00+00' ELSE last_seen_at END AS last_seen_at, CASE WHEN landed OR live THEN TIMESTAMPTZ '2026-03-15 00:00:00+00' ELSE updated_at END AS updated_at, (coalesce(out_of_stock_count, 0) + CASE WHEN live AND NOT landed THEN 1 ELSE 0 END)::INT AS out_of_stock_count, CASE WHEN fresh THEN 'inserted' WHEN landed THEN 'updated' WHEN live THEN 'deactivated' ELSE 'kept' END AS outcome FROM u""",
    "after_removals": f"WITH k AS (SELECT id, source_id, CASE WHEN category_id IN (SELECT id FROM categories WHERE slug = 'whisky') THEN NULL ELSE category_id END AS category_id FROM products WHERE source_id IN (SELECT id FROM sources WHERE is_active)), gone AS (SELECT id FROM products WHERE id NOT IN (SELECT id FROM k)), h AS (SELECT k.source_id, count(*)::BIGINT AS history FROM price_history h JOIN k ON k.id = h.product_id GROUP BY k.source_id), n AS (SELECT source_id, count(*)::BIGINT AS members FROM ({LONG}) WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM gone) GROUP BY source_id) SELECT k.source_id, count(*)::BIGINT AS listings, count(category_id)::BIGINT AS with_category, any_value(history) AS history, any_value(members) AS members FROM k LEFT JOIN h USING (source_id) LEFT JOIN n USING (source_id) GROUP BY k.source_id",
    "parsed_shop_pages": f"SELECT source_id AS shop, product_url AS link, {TRIMMED.format('title')} AS title, {TRIMMED.format('price_original')} AS price, CASE WHEN source_id IN (1, 3, 5) THEN 'no ' || id END AS size FROM products WHERE {TRIMMED.format('title')} <> '' AND {TRIMMED.format('price_original')} <> ''",
}
