"""Serving queries over the catalogue, and the SQL that checks them: the group view's oracle is the literal wide form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillroom.functions.titles import content_ml, fingerprint, listing_ml, normalized_title, parsed_price, relative_url, resolved_url, simple_title
from stillroom.operators.groups import SHOPS, Filters, Page, active, autocomplete, badges, browse, confirmed_matches, count_label, first_images, group_details, long_matches, paged, parse_page, product_groups, review_items, search, wide_matches
from stillroom.operators.history import previous_values
from stillroom.operators.ingest import backfilled, last_writes, merged, recorded_changes, without_categories, without_shops
from stillroom.operators.lookup import looked_up, seeded, word_search
from stillroom.plans.catalogue_sql import ORACLES  # noqa: F401
from stillroom.sources.landing import LAYOUTS, dump, export_csv, export_json, file_slug, page_listings, read_groups, read_landing, restore, write_landing
from stillroom.sources.tables import cut, shared_folder, table

TODAY = "2026-03-15"
QUERY = "reserve"
MONEY = "decimal(10,2)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "possible_matches", "id", *SHOPS.values(), "review_status")


def matches(spark: SparkSession, d: str) -> DataFrame:
    return confirmed_matches(candidates(spark, d))


def groups(spark: SparkSession, d: str) -> DataFrame:
    return product_groups(table(spark, d, "products"), table(spark, d, "categories"), matches(spark, d))


# ---- views ----


def current_prices(spark, d):
    shops = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("display_name").alias("source"), F.col("name").alias("source_name"))
    kinds = table(spark, d, "categories").select(F.col("id").alias("category_id"), F.col("display_name").alias("category"), F.col("slug").alias("category_slug"))
    rows = table(spark, d, "products", "id", "title", "price", "currency", "product_url", "category_id", "source_id", "is_available").where("is_available")
    return rows.join(shops, "source_id").join(kinds, "category_id", "left").select("id", "title", "price", "currency", "product_url", "category", "category_slug", "source", "source_name")


def price_comparison(spark, d):
    """Every match with the listing, price and link of each shop, available or not; a match whose listings are all gone keeps its row."""
    rows = table(spark, d, "products").select(F.col("id").alias("product_id"), "title", "volume_ml", "price", "product_url")
    of = matches(spark, d).join(rows.withColumn("listed", F.col("product_id")), "product_id", "left").withColumnRenamed("product_url", "url")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_id")))
    places = [F.min(F.when(F.col("source_id") == s, F.col(c))).alias(f"{name.removesuffix('_id')}_{as_}") for s, name in SHOPS.items() for c, as_ in (("listed", "product_id"), ("price", "price"), ("url", "url"))]
    return of.groupBy("match_id").agg(first("title").alias("title"), first("volume_ml").alias("volume_ml"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), *places)


def groups_view(spark, d):
    return groups(spark, d)


# ---- browse, detail, search ----


def browsed(sort):
    return lambda spark, d: browse(groups(spark, d), sort=sort)


def browse_filtered(spark, d):
    return browse(groups(spark, d), Filters(("gin", "rum", "whisky"), 5.0, 60.0, 700), "price_asc", Page(1, 100))


def browse_page(spark, d):
    """A page with its total and the number of pages."""
    return paged(groups(spark, d), Filters(("gin", "rum", "whisky"), shops=1), "price_desc", parse_page("2", "10"))


def browse_total(spark, d):
    return groups(spark, d).where(Filters(("gin", "rum", "whisky"), 5.0, 60.0, shops=1).condition()).agg(F.count("*").alias("total"))


def featured_savings(spark, d):
    return browse(groups(spark, d), sort="savings_desc", page=Page(1, 6))


def group_detail(spark, d):
    return group_details(table(spark, d, "products"), table(spark, d, "sources"), matches(spark, d))


def singleton_detail(spark, d):
    alone = groups(spark, d).where("singleton_id is not null").select(F.col("singleton_id").alias("id"))
    kinds = table(spark, d, "categories").select(F.col("id").alias("category_id"), F.col("display_name").alias("category"))
    shops = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("display_name").alias("shop"))
    return table(spark, d, "products", "id", "title", "price", "volume_ml", "category_id", "source_id").join(alone, "id", "left_semi").join(shops, "source_id").join(kinds, "category_id", "left").select("id", "title", "price", "volume_ml", "category", "shop")


def searched(spark, d):
    return search(groups(spark, d), table(spark, d, "products", "id", "normalized_title"), matches(spark, d), QUERY)


def search_groups(spark, d):
    return searched(spark, d)


def search_filtered(spark, d):
    return searched(spark, d).where(Filters(("whisky", "rum"), price_to=80.0, shops=2).condition())


def search_total(spark, d):
    return searched(spark, d).agg(F.count("*").alias("total"))


def suggestions_for_title(spark, d):
    return autocomplete(groups(spark, d), QUERY)


def group_badges(spark, d):
    return badges(groups(spark, d))


def group_images(spark, d):
    return first_images(table(spark, d, "products"), matches(spark, d))


# ---- statistics ----


def category_counts(spark, d):
    n = groups(spark, d).groupBy(F.col("category_slug").alias("slug")).agg(F.count("*").alias("groups"))
    return table(spark, d, "categories", "id", "slug", "display_name").join(n, "slug").select("id", "slug", "display_name", "groups")


def vendor_counts(spark, d):
    n = active(table(spark, d, "products", "source_id", "is_available", "price")).groupBy("source_id").agg(F.count("*").alias("n"))
    shops = table(spark, d, "sources").where("is_active").select(F.col("id").alias("source_id"), "name", "display_name")
    return shops.join(n, "source_id", "left").select("source_id", "name", "display_name", F.coalesce("n", F.lit(0)).alias("listings"))


def landing_stats(spark, d):
    """Five numbers in one row."""
    one = lambda df: df.withColumn("one", F.lit(1))
    g = groups(spark, d).agg(F.count("*").alias("groups_total"), F.count_distinct("category_slug").alias("categories_total"), F.count_if(F.col("store_count") >= 2).alias("matched_groups"))
    n = active(table(spark, d, "products", "is_available", "price")).agg(F.count("*").alias("products_total"))
    s = table(spark, d, "sources", "is_active").where("is_active").agg(F.count("*").alias("stores_total"))
    return one(g).join(one(n), "one").join(one(s), "one").drop("one")


def landing_labels(spark, d):
    """The numbers of listings and groups as they are shown."""
    return landing_stats(spark, d).select(count_label(F.col("products_total")).alias("products_label"), count_label(F.col("groups_total")).alias("groups_label"))


def cheapest_in_category(spark, d):
    """The ten cheapest listings of every category."""
    w = Window.partitionBy("category_id").orderBy("price", "id")
    return active(table(spark, d, "products", "id", "category_id", "title", "price", "is_available")).where("category_id is not null").withColumn("k", F.row_number().over(w)).where("k <= 10").select("category_id", "k", "id", "title", "price")


def shop_counts(spark, d):
    n = table(spark, d, "products", "source_id").groupBy("source_id").agg(F.count("*").alias("listings"))
    return n.join(table(spark, d, "sources").select(F.col("id").alias("source_id"), "name"), "source_id").select("name", "listings")


def avg_by_category(spark, d):
    rows = table(spark, d, "products", "category_id", "price").where("price is not null").groupBy("category_id").agg(F.avg(F.col("price").cast("double")).alias("avg_price"), F.count("*").alias("listings"))
    return rows.join(table(spark, d, "categories").select(F.col("id").alias("category_id"), "name"), "category_id").select("name", F.round("avg_price", 4).alias("avg_price"), "listings")


def avg_by_category_shop(spark, d):
    rows = table(spark, d, "products", "category_id", "source_id", "price").where("price is not null and category_id is not null").groupBy("category_id", "source_id").agg(F.avg(F.col("price").cast("double")).alias("avg_price"))
    kinds, shops = table(spark, d, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category")), table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("shop"))
    return rows.join(kinds, "category_id").join(shops, "source_id").select("category", "shop", F.round("avg_price", 4).alias("avg_price"))


def price_history_window(spark, d):
    return table(spark, d, "price_history", "id", "product_id", "price", "recorded_at").where(F.col("recorded_at") >= F.to_timestamp(F.lit(TODAY)) - F.expr("INTERVAL 30 DAYS"))


def listing_history(spark, d):
    """The last thirty days of one listing (here the one with most rows), oldest first: a look-up by key, which reaches the scan as a filter."""
    return price_history_window(spark, d).where("product_id = 1").orderBy("recorded_at", "id").select("id", "price", "recorded_at")


def recent_changes(spark, d):
    """Listings with a history row in the last week."""
    seen = price_history_window(spark, d).where(F.col("recorded_at") >= F.to_timestamp(F.lit(TODAY)) - F.expr("INTERVAL 7 DAYS")).select(F.col("product_id").alias("id")).distinct()
    return table(spark, d, "products", "id", "title", "price").join(seen, "id", "left_semi")


def price_drops(spark, d):
    """The twenty greatest drops of a listing's price below one recorded in the last week."""
    h = table(spark, d, "price_history").where(F.col("recorded_at") >= F.to_timestamp(F.lit(TODAY)) - F.expr("INTERVAL 7 DAYS")).select(F.col("id").alias("history_id"), F.col("product_id").alias("id"), F.col("price").alias("old_price"))
    rows = table(spark, d, "products", "id", "title", "price").join(h, "id").where("price < old_price")
    saved = F.col("old_price") - F.col("price")
    rows = rows.select("history_id", "id", "title", F.col("price").alias("current_price"), "old_price", saved.cast(MONEY).alias("saved"), F.round(saved.cast("double") / F.col("old_price").cast("double") * 100, 2).alias("discount_percent"))
    return rows.orderBy(F.desc("saved"), F.asc("history_id")).limit(20)


def shop_pair_differences(spark, d):
    """For every two shops: how many matches they share and by how much their prices differ."""
    rows = matches(spark, d).join(active(table(spark, d, "products")).select(F.col("id").alias("product_id"), F.col("price").cast("double").alias("price")), "product_id").select("match_id", "source_id", "price")
    b = rows.select("match_id", F.col("source_id").alias("source_b"), F.col("price").alias("price_b"))
    both = rows.withColumnRenamed("source_id", "source_a").join(b, "match_id").where("source_a < source_b")
    return both.groupBy("source_a", "source_b").agg(F.count("*").alias("shared"), F.round(F.avg(F.abs(F.col("price") - F.col("price_b"))), 4).alias("mean_difference"))


def orphan_check(spark, d):
    """Match members that name no listing, by shop."""
    known = table(spark, d, "products").select(F.col("id").alias("product_id"))
    return long_matches(candidates(spark, d)).join(known, "product_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("orphans"))


def wrong_shop_check(spark, d):
    """Match members that stand in the column of a shop that doesn't list them, by shop."""
    known = table(spark, d, "products").select(F.col("id").alias("product_id"), F.col("source_id").alias("listed_by"))
    return long_matches(candidates(spark, d)).join(known, "product_id").where("source_id <> listed_by").groupBy("source_id").agg(F.count("*").alias("misplaced"))


def mapping_check(spark, d):
    """Mappings by shop and category name; none stands for ids that the canonical list lacks."""
    m = table(spark, d, "source_category_mappings", "source_id", "canonical_category_id").withColumnRenamed("canonical_category_id", "category_id")
    n = m.groupBy("source_id", "category_id").agg(F.count("*").alias("slugs"))
    return n.join(table(spark, d, "categories").select(F.col("id").alias("category_id"), "name"), "category_id", "left").join(table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("shop")), "source_id").groupBy("shop", F.coalesce("name", F.lit("none")).alias("category")).agg(F.sum("slugs").alias("slugs"))


def cheapest_hits(spark, d):
    """The second fifty of the cheapest available listings whose title holds a text; null prices come last."""
    return current_prices(spark, d).where(F.col("title").ilike(f"%{QUERY}%")).orderBy(F.asc_nulls_last("price"), "id").offset(50).limit(50)


def cheapest_of_category(spark, d):
    """The hundred cheapest available listings of a category."""
    return current_prices(spark, d).where("category_slug = 'whisky'").orderBy(F.asc_nulls_last("price"), "id").limit(100)


def word_hits(spark, d):
    return word_search(table(spark, d, "products", "id", "title"), ["double", "wood"]).select("id")


def price_steps(spark, d):
    """Every change of a listing's price against the row before it in time."""
    history = table(spark, d, "price_history", "id", "product_id", "price", "recorded_at")
    rows = previous_values(history, "product_id", ["recorded_at", "id"], "price", F.date_trunc("day", "recorded_at"))
    return rows.where(F.col("price") != F.col("before")).select("id", "product_id", "before", "price", (F.col("price") - F.col("before")).cast(MONEY).alias("step"))


def title_lookup(spark, d):
    """The titles of every listing whose id is divisible by 100, in capitals or cut, looked up at every shop."""
    rows = table(spark, d, "products", "id", "source_id", "title")
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("request"), F.when(F.col("id") % 200 == 0, F.upper("title")).otherwise(F.substring("title", 1, 12)).alias("title"))
    return looked_up(asked.withColumn("shop", F.explode(F.sequence(F.lit(1), F.lit(5)))), rows)


def curated(spark, d) -> DataFrame:
    """Curated groups with nested entries, made of the open suggestions: each names its listings' titles in capitals, twice for the first shop."""
    rows = long_matches(table(spark, d, "possible_matches").where("review_status = 'pending'")).join(table(spark, d, "products").select(F.col("id").alias("product_id"), "title"), "product_id").join(table(spark, d, "sources").select(F.col("id").alias("source_id"), "name"), "source_id")
    entry = F.struct("source_id", F.col("name").alias("source"), F.upper("title").alias("original_title"))
    grouped = rows.groupBy(F.col("match_id").cast("int").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    entries = F.transform(F.concat("e", F.slice("e", F.lit(1), F.lit(1))), lambda x: F.struct(x["source"].alias("source"), x["original_title"].alias("original_title")))
    return grouped.select("id", F.concat(F.lit("group "), "id").alias("matched_name"), F.lit("mixed").alias("category"), F.lit("ambiguous").alias("classification"), entries.alias("entries"))


def curated_groups(spark, d):
    """The curated groups written as nested JSON, a group a line, and read again, one row for each entry."""
    path = shared_folder(spark)
    curated(spark, d).select(F.array(F.struct("id", "matched_name", "category", "classification", "entries")).alias("groups")).write.json(path)
    return read_groups(spark, path, lines=True)


def seeded_groups(spark, d):
    """Curated groups found among the listings that no confirmed match names."""
    shops = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    entries = curated_groups(spark, d).join(shops, "source").select("group_id", "position", "source_id", F.col("original_title").alias("title"))
    return seeded(entries, table(spark, d, "products", "id", "source_id", "title"), matches(spark, d))


# ---- candidates ----


def review_queue(spark, d):
    """Open suggestions by scores, with the listings they name, as JSON."""
    order = [F.desc_nulls_last("jaccard"), F.desc_nulls_last("trigram"), F.asc("id")]
    rows = review_items(table(spark, d, "possible_matches").where("review_status = 'pending'"), table(spark, d, "products"), table(spark, d, "sources"), table(spark, d, "categories"))
    titles = F.array_join(F.transform("stores", lambda s: F.coalesce(s["title"], F.lit("?"))), " / ")
    prices = F.array_join(F.transform("stores", lambda s: F.format_string("%.2f", s["price"])), " / ")
    urls = F.array_join(F.transform("stores", lambda s: F.coalesce(s["url"], F.lit("?"))), " ")
    return rows.orderBy(*order).select("id", F.size("stores").alias("shops"), titles.alias("titles"), prices.alias("prices"), urls.alias("urls"), "category", "volume_ml", "suggestion_source", "jaccard", "trigram", "created_at")


def review_counts(spark, d):
    rows = table(spark, d, "possible_matches", "review_status")
    return rows.agg(*[F.count_if(F.col("review_status") == s).alias(s) for s in ("pending", "confirmed", "rejected", "superseded")])


def review_history(spark, d):
    rows = table(spark, d, "possible_matches").where("review_status in ('confirmed', 'rejected', 'superseded')")
    return rows.orderBy(F.desc_nulls_last("reviewed_at"), F.asc("id")).limit(200).select("id", "review_status", F.date_format("reviewed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("reviewed_at"))


def match_table(spark, d):
    """Confirmed matches as wide rows."""
    return wide_matches(matches(spark, d))


# ---- texts ----


def normalized_titles(spark, d):
    return table(spark, d, "products", "id", "title").select("id", normalized_title(F.col("title")).alias("normal"))


def simple_titles(spark, d):
    return table(spark, d, "products", "id", "title").select("id", simple_title(F.col("title")).alias("simple"))


def title_contents(spark, d):
    size = F.coalesce(F.get_json_object("metadata", "$.size"), F.get_json_object("metadata", "$.pack.size"))
    return table(spark, d, "products", "id", "title", "metadata").select("id", content_ml(F.col("title")).alias("of_title"), listing_ml(size, F.col("title")).alias("of_listing"))


def parsed_prices(spark, d):
    return table(spark, d, "products", "id", "price_original").select("id", parsed_price(F.col("price_original")).alias("parsed"))


def resolved_urls(spark, d):
    """Every link as it is, cut to its path, and cut to a path without the leading slash, resolved against its shop again."""
    rows = table(spark, d, "products", "id", "source_id", "product_url").join(table(spark, d, "sources").select(F.col("id").alias("source_id"), "website_url"), "source_id")
    path = F.regexp_replace("product_url", r"^https?://[^/]+", "")
    base = F.col("website_url")
    return rows.select("id", resolved_url(F.col("product_url"), base).alias("url"), resolved_url(path, base).alias("from_path"), relative_url(F.regexp_replace(path, "^/", ""), base).alias("from_relative"))


def fingerprints(spark, d):
    rows = table(spark, d, "products").select(F.col("id").alias("product_id"), "product_url").join(long_matches(candidates(spark, d)), "product_id").join(table(spark, d, "sources").select(F.col("id").alias("source_id"), "name"), "source_id")
    return rows.groupBy("match_id").agg(fingerprint(F.collect_list(F.concat_ws(":", "name", "product_url"))).alias("fingerprint"))


# ---- landing ----


def pages_of(spark, d):
    """Listings shown as pages of twenty, of which the parser gets them back."""
    def quoted(c):
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(sign), F.lit(entity))
        return c

    rows = table(spark, d, "products", "id", "title", "price_original", "product_url", "image_url")
    price = F.when(F.col("price_original").isNotNull(), F.concat(F.lit('<span class="price">'), quoted(F.col("price_original")), F.lit("</span>"))).otherwise(F.lit(""))
    image = F.when(F.col("image_url").isNotNull(), F.concat(F.lit('<img class="p" src="'), "image_url", F.lit('"/>'))).otherwise(F.lit('<img class="p" src="data:none"/>'))
    item = F.concat(F.lit('<div class="item"><h2> <a class="t" href="'), "product_url", F.lit('">'), quoted(F.coalesce("title", F.lit(""))), F.lit("</a></h2>"), price, image, F.lit("</div>\n"))
    return rows.groupBy(F.floor(F.col("id") / 20).alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", item.alias("h")))).getField("h"), "").alias("html"))


def parsed_pages(spark, d):
    return page_listings(pages_of(spark, d)).select("page_id", "title", "price", "link", "image")


def landing_slugs(spark, d):
    rows = table(spark, d, "source_category_mappings", "id", "source_id", "file_slug").join(table(spark, d, "sources").select(F.col("id").alias("source_id"), "name"), "source_id")
    return rows.select("id", file_slug(F.concat(F.lit("landing/"), F.replace("file_slug", F.lit("/"), F.lit("-")), F.lit("_"), "name", F.lit(".json")), F.col("name")).alias("slug"))


def shop_pages(spark, d) -> DataFrame:
    """(page_id, shop, html): every shop's listings in its own layout, twenty a page."""
    def quoted(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("é"), F.lit("&eacute;"))

    rows = table(spark, d, "products", "id", "source_id", "title", "price_original", "product_url")
    title, price = quoted(F.coalesce("title", F.lit(""))), quoted(F.coalesce("price_original", F.lit("")))
    link = F.concat(F.lit('<a href="'), "product_url", F.lit('">link</a>'))
    size = F.concat(F.lit("no "), F.col("id").cast("string"))
    part = lambda before, text, after: F.concat(F.lit(before), text, F.lit(after))
    shown = {
        1: F.concat(F.lit('<li class="sc-5ce8ced0-0 bcCFxH">'), link, part('<h3 class="efPlgI sc-5ce8ced0-6">', title, "</h3>"), part('<span class="sc-7fb65671-2 icPbuR">', price, "</span>"), part('<span class="sc-5ce8ced0-9 QXiqi">', size, "</span></li>")),
        2: F.concat(F.lit('<div class="c-product-card js-animated-element">'), link, part("<h6>", title, "</h6><div><b>-5%</b></div>"), part('<span class="woocommerce-Price-amount amount"><bdi>', price, "</bdi></span></div>")),
        3: F.concat(F.lit('<div class="oe_product g-col-6 g-col-md-4 g-col-lg-3">'), link, part('<a class="text-decoration-none" href="/x">', title, "</a>"), part('<span class="oe_currency_value">', price, "</span>"), part('<span class="o_ribbons o_not_editable o_wsale_ribbon o_right">', size, "</span></div>")),
        4: F.concat(F.lit('<div class="product-item" data-productid="1">'), link, part('<h2 class="product-title"><a href="/y">', title, "</a></h2>"), part('<span class="price actual-price">', price, "</span></div>")),
        5: F.concat(F.lit('<div class="item single-product">'), link, part('<span class="product-name">', title, '</span><div class="price">'), part("<span>", price, "</span></div>"), part('<div class="custom-fields-field-1">', size, "</div></div>")),
    }
    item = reduce(lambda c, s: c.when(F.col("source_id") == s, shown[s]), list(shown)[1:], F.when(F.col("source_id") == 1, shown[1]))
    return rows.groupBy(F.floor(F.col("id") / 20).alias("page_id"), F.col("source_id").alias("shop")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", item.alias("h")))).getField("h"), "\n").alias("html"))


def parsed_shop_pages(spark, d):
    """Every shop's pages read by its own layout."""
    pages = cut(shop_pages(spark, d))
    parts = [page_listings(pages.where(F.col("shop") == s).select("page_id", "html"), layout).select(F.lit(s).alias("shop"), "link", "title", "price", "size") for s, layout in LAYOUTS.items()]
    return reduce(DataFrame.unionByName, parts)


def paged_listings(spark, d):
    """A shop's pages read in turn with the first page read a second time at the end, as a scan that starts over delivers them: every listing's last reading counts."""
    pages = pages_of(spark, d).withColumn("turn", F.col("page_id"))
    again = pages.groupBy().agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("p"), F.max("page_id").alias("last")).select("p.page_id", "p.html", (F.col("last") + 1).alias("turn"))
    readings = page_listings(pages.unionByName(again).select(F.col("turn").alias("page_id"), "html"))
    return last_writes(readings.select("link", "title", "price", F.col("page_id").alias("turn"), "position"), ["link"], [F.col("turn"), F.col("position")]).select("link", "title", "price", "turn")


def landed_listings(spark, d):
    """Listings written as landing files, one folder for each shop and slug, and read again."""
    rows = table(spark, d, "products", "source_id", "title", "price_original", "product_url", "image_url", "category_id", "metadata")
    path = shared_folder(spark)
    write_landing(rows.select("title", F.col("price_original").alias("price"), F.get_json_object("metadata", "$.size").alias("size"), F.col("product_url").alias("link"), F.col("image_url").alias("image"), F.col("source_id").alias("source"), F.coalesce(F.col("category_id").cast("string"), F.lit("none")).alias("file_slug")), path)
    return read_landing(spark, f"{path}/*/*", lines=True)[0].withColumns({"source": F.regexp_extract("file", r"source=(\d+)", 1).cast("int"), "file_slug": F.regexp_extract("file", r"file_slug=(\w+)", 1)}).drop("file")


def restored_listings(spark, d):
    """The listings dumped and restored."""
    path = shared_folder(spark)
    dump({"products": table(spark, d, "products", "id", "title", "price", "last_seen_at")}, path)
    return restore(spark, path, ["products"])["products"]


def csv_listings(spark, d):
    """Listings exported as CSV with a header and read again: nothing is lost, but an empty text comes back as null."""
    path = shared_folder(spark)
    export_csv(table(spark, d, "products", "id", "title", "price"), path)
    return spark.read.schema("id int, title string, price decimal(10,2)").option("header", True).option("multiLine", True).option("escape", "\"").csv(path)


def mapped_slugs(spark, d):
    """Every typed slug with its shop and category by name; outcome says whether its file would be read or skipped."""
    m = table(spark, d, "source_category_mappings", "id", "source_id", "file_slug", "canonical_category_id").withColumnRenamed("canonical_category_id", "category_id")
    named = m.join(table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("shop")), "source_id").join(table(spark, d, "categories").select(F.col("id").alias("category_id"), F.col("slug").alias("category")), "category_id", "left")
    return named.select("id", "shop", "file_slug", "category", F.when(F.col("category").isNull(), "skipped").otherwise("mapped").alias("outcome"))


def image_backfill(spark, d):
    """The whole table as the current landing, its rows with an image as the previous one."""
    rows = table(spark, d, "products", "id", "title", "image_url")
    return backfilled(rows, rows, "title", "image_url", "id")


def exported_sources(spark, d):
    return export_json(table(spark, d, "sources"))


# ---- merge ----


def delivery(spark, d, n):
    rows = table(spark, d, "product_snapshots").where(F.col("snapshot_no") == n).select("source_id", "product_id", "price", "is_available", "last_seen_at")
    return last_writes(rows, ["source_id", "product_id"], [F.col("last_seen_at")])


def all_merges(spark, d):
    """Every delivery after the first merged in turn into the state that the ones before it left, with its snapshot_no; seen is the time of the delivery."""
    key = ["source_id", "product_id"]
    numbers = table(spark, d, "product_snapshots", "snapshot_no", "snapshot_at").groupBy("snapshot_no").agg(F.max("snapshot_at").alias("at"))
    # One row a delivery.
    order = [(r["snapshot_no"], r["at"]) for r in numbers.orderBy("snapshot_no").collect()]
    state, out = delivery(spark, d, order[0][0] if order else 1), None
    for n, at in order[1:] or [(2, None)]:
        after = cut(merged(state, delivery(spark, d, n), key, ["source_id"], F.lit(at).cast("timestamp")).withColumn("snapshot_no", F.lit(n)))
        state = after.select(*state.columns)
        out = after if out is None else out.unionByName(after)
    return out


def snapshot_merge(spark, d):
    return all_merges(spark, d).select("snapshot_no", "source_id", "product_id", "price", "is_available", "last_seen_at", "outcome")


def deactivated(spark, d):
    return all_merges(spark, d).where("outcome = 'deactivated'").select("snapshot_no", "source_id", "product_id")


def history_delta(spark, d):
    return recorded_changes(all_merges(spark, d), ["snapshot_no", "source_id", "product_id"])


def listing_upsert(spark, d):
    """Delivery 4 landed on the listings with all fields: title, normal form and content are read anew; changes are stamped, and what is missing is counted."""
    state = table(spark, d, "products", "id", "source_id", "title", "normalized_title", "volume_ml", "price", "is_available", "last_seen_at", "updated_at", "out_of_stock_count").withColumnRenamed("id", "product_id")
    fresh = state.select("product_id", F.trim("title").alias("title"), normalized_title(F.col("title")).alias("normalized_title"), content_ml(F.col("title")).alias("volume_ml"))
    landed = delivery(spark, d, 4).select("source_id", "product_id", "price").join(fresh, "product_id", "left")
    after = merged(state, landed, ["source_id", "product_id"], ["source_id"], F.to_timestamp(F.lit(TODAY)), ("title", "normalized_title", "volume_ml"), "updated_at", "out_of_stock_count")
    return after.select("source_id", "product_id", "title", "normalized_title", "volume_ml", "price", "is_available", "last_seen_at", "updated_at", "out_of_stock_count", "outcome")


def after_removals(spark, d):
    """What is left when the shops that aren't active and the categories without a slug like theirs are removed: rows of each table by shop."""
    sources, kinds = table(spark, d, "sources"), table(spark, d, "categories")
    gone = sources.where("is_active is distinct from true").select(F.col("id").alias("source_id"))
    products, history, members = without_shops(gone, table(spark, d, "products", "id", "source_id", "category_id"), table(spark, d, "price_history", "id", "product_id"), long_matches(candidates(spark, d)))
    products = without_categories(kinds.where("slug = 'whisky'").select(F.col("id").alias("category_id")), products)
    of = history.join(products.select(F.col("id").alias("product_id"), "source_id"), "product_id").groupBy("source_id").agg(F.count("*").alias("history"))
    named = members.groupBy("source_id").agg(F.count("*").alias("members"))
    left = products.groupBy("source_id").agg(F.count("*").alias("listings"), F.count("category_id").alias("with_category"))
    return left.join(of, "source_id", "left").join(named, "source_id", "left")


QUERIES = {f.__name__: f for f in (
    current_prices, price_comparison, groups_view, browse_filtered, browse_page, browse_total, featured_savings, group_detail, singleton_detail, search_groups, search_filtered, search_total, suggestions_for_title, group_badges, group_images,
    category_counts, vendor_counts, landing_stats, landing_labels, cheapest_in_category, cheapest_hits, cheapest_of_category, word_hits, price_steps, title_lookup, shop_counts, avg_by_category, avg_by_category_shop, price_history_window, listing_history, recent_changes, price_drops, shop_pair_differences, orphan_check,
    wrong_shop_check, mapping_check, review_queue, review_counts, review_history, match_table, normalized_titles, simple_titles, title_contents, parsed_prices, resolved_urls, fingerprints, parsed_pages, landing_slugs,
    parsed_shop_pages, paged_listings, landed_listings, restored_listings, csv_listings, mapped_slugs, curated_groups, seeded_groups, image_backfill, exported_sources, snapshot_merge, deactivated, history_delta, listing_upsert, after_removals,
)} | {f"browse_{s}": browsed(s) for s in ("price_asc", "price_desc", "name_asc", "name_desc", "savings_desc")}
