"""Product groups over shops: matches in long form, the group view, and the queries that serve it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a wide match row, by the id of their shop.
SHOPS = {1: "ecuga_id", 2: "cugaklik_id", 3: "promili_id", 4: "diskontfumar_id", 5: "rotodinamic_id"}
#: From which shop a group takes its title, and its picture, content and category: the first that has one.
TITLE_ORDER, PICTURE_ORDER = (3, 1, 4, 2, 5), (1, 2, 4, 3, 5)
#: Equal prices: the shop that counts as the cheapest.
PRICE_ORDER = (1, 2, 4, 3, 5)
MONEY = "decimal(10,2)"


def long_matches(matches: DataFrame) -> DataFrame:
    """(match_id, source_id, product_id) of wide rows (id and one column for each shop); empty places are left out."""
    members = F.array(*[F.struct(F.lit(s).alias("source_id"), F.col(c).alias("product_id")) for s, c in SHOPS.items()])
    return matches.select(F.col("id").alias("match_id"), F.inline(F.filter(members, lambda m: m["product_id"].isNotNull())))


def wide_matches(matches: DataFrame) -> DataFrame:
    """Long matches as wide rows again; of several listings of one shop the smallest id stays."""
    return matches.groupBy(F.col("match_id").alias("id")).agg(*[F.min(F.when(F.col("source_id") == s, F.col("product_id"))).alias(c) for s, c in SHOPS.items()])


def confirmed_matches(candidates: DataFrame) -> DataFrame:
    """Long matches of the confirmed candidates of which every listing is named first by this row; so a listing is in one match at most."""
    rows = long_matches(candidates.where("review_status = 'confirmed'"))
    first = rows.groupBy("product_id").agg(F.min("match_id").alias("first_id"))
    whole = rows.join(first, "product_id").groupBy("match_id").agg(F.min((F.col("match_id") == F.col("first_id")).cast("int")).alias("own"), F.count("*").alias("n")).where("own = 1 and n >= 2")
    return rows.join(whole.select("match_id"), "match_id", "left_semi")


def rank_of(order: tuple[int, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source_id"))


def first_of(value: str, order: tuple[int, ...]) -> Column:
    """The value of the first shop in order that has one."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), rank_of(order)))


def active(products: DataFrame) -> DataFrame:
    """Listings that can be bought: available and with a price above zero."""
    return products.where("is_available and price > 0")


def product_groups(products: DataFrame, categories: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each match with an active listing and for each active listing in no match.

    One join on long matches and one aggregate stand for the ten joins of the wide form; listings outside matches come by one anti join on their id.
    """
    named = categories.select(F.col("id").alias("category_id"), F.col("slug").alias("category_slug"), F.col("display_name").alias("category_name"))
    live = active(products.select("id", "title", "image_url", "volume_ml", "price", "category_id", "is_available")).drop("is_available").join(named, "category_id", "left")
    matched = matches.join(live, matches["product_id"] == live["id"]).groupBy("match_id").agg(
        first_of("title", TITLE_ORDER).alias("display_title"), first_of("image_url", PICTURE_ORDER).alias("display_image_url"), first_of("volume_ml", PICTURE_ORDER).alias("volume_ml"),
        first_of("category_slug", PICTURE_ORDER).alias("category_slug"), first_of("category_name", PICTURE_ORDER).alias("category_name"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count_distinct("source_id").cast("int").alias("store_count"),
    )
    columns = ("display_title", "display_image_url", "volume_ml", "category_slug", "category_name", "min_price", "max_price", "store_count")
    groups = matched.select(F.concat(F.lit("g"), F.col("match_id").cast("string")).alias("group_id"), F.col("match_id").cast("int").alias("match_id"), F.lit(None).cast("int").alias("singleton_id"), *columns)
    alone = live.join(matches.select(F.col("product_id").alias("id")), "id", "left_anti")
    singles = alone.select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("group_id"), F.lit(None).cast("int").alias("match_id"), F.col("id").alias("singleton_id"), F.col("title").alias("display_title"),
        F.col("image_url").alias("display_image_url"), "volume_ml", "category_slug", "category_name", F.col("price").alias("min_price"), F.col("price").alias("max_price"), F.lit(1).alias("store_count"),
    )
    return groups.unionByName(singles)


def with_savings(groups: DataFrame) -> DataFrame:
    return groups.withColumn("savings", F.round(F.col("max_price") - F.col("min_price"), 2).cast(MONEY))


#: Allowed sorts; the group id makes every order total.
SORTS = {
    "price_asc": (("min_price", "asc"), ("display_title", "asc")), "price_desc": (("min_price", "desc"), ("display_title", "asc")), "name_asc": (("display_title", "asc"),),
    "name_desc": (("display_title", "desc"),), "savings_desc": (("savings", "desc"), ("min_price", "asc")),
}


def order_of(sort: str) -> list[Column]:
    """The columns of a sort, nulls last going up and first going down; an unknown sort falls back to the title."""
    ways = {"asc": lambda c: c.asc_nulls_last(), "desc": lambda c: c.desc_nulls_first()}
    return [ways[way](F.col(name)) for name, way in SORTS.get(sort, SORTS["name_asc"])] + [F.col("group_id").asc()]


@dataclass(frozen=True)
class Page:
    """A page of a sorted result; out-of-range values raise ValueError before any plan is built."""

    number: int = 1
    limit: int = 24

    def __post_init__(self) -> None:
        if self.number < 1 or not 1 <= self.limit <= 100:
            raise ValueError("a page starts at 1 and has 1 to 100 rows")

    def of(self, df: DataFrame) -> DataFrame:
        return df.offset((self.number - 1) * self.limit).limit(self.limit)


def page_count(total: int, limit: int) -> int:
    return max(1, -(-total // limit))


def page_numbers(current: int, pages: int) -> list[int | None]:
    """Page numbers to show: all of up to seven, else the first, two on either side of the current one and the last; None stands for a gap."""
    if pages <= 7:
        return list(range(1, pages + 1))
    near = sorted({1, pages, *range(max(1, current - 2), min(pages, current + 2) + 1)})
    out: list[int | None] = []
    for n in near:
        if out and out[-1] is not None and n - out[-1] > 1:
            out.append(None)
        out.append(n)
    return out


@dataclass(frozen=True)
class Filters:
    """Conditions of a browse or search; each one given must hold. Prices bound the lowest price, both ends included."""

    categories: tuple[str, ...] = ()
    price_from: float | None = None
    price_to: float | None = None
    volume_ml: int | None = None
    shops: int | None = None
    extra: tuple[Column, ...] = field(default=())

    def condition(self) -> Column:
        parts = list(self.extra)
        if self.categories:
            parts.append(F.col("category_slug").isin(*self.categories))
        if self.price_from is not None:
            parts.append(F.col("min_price") >= F.lit(self.price_from).cast(MONEY))
        if self.price_to is not None:
            parts.append(F.col("min_price") <= F.lit(self.price_to).cast(MONEY))
        if self.volume_ml is not None:
            parts.append(F.col("volume_ml") == self.volume_ml)
        if self.shops is not None and self.shops >= 1:
            parts.append(F.col("store_count") >= self.shops)
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def browse(groups: DataFrame, filters: Filters | None = None, sort: str = "name_asc", page: Page | None = None) -> DataFrame:
    """One page of the groups that meet the filters."""
    return (page or Page()).of(with_savings(groups).where((filters or Filters()).condition()).orderBy(*order_of(sort)))


def like_pattern(query: str) -> str:
    """A substring pattern of a query; % and _ stay wildcards, a stray backslash is doubled."""
    out, i = "", 0
    while i < len(query):
        if query[i] == "\\":
            known = i + 1 < len(query) and query[i + 1] in "%_\\"
            out += query[i : i + 2] if known else "\\\\"
            i += 2 if known else 1
        else:
            out += query[i]
            i += 1
    return f"%{out}%"


def search(groups: DataFrame, products: DataFrame, matches: DataFrame, query: str) -> DataFrame:
    """Groups of which any listing's normal form holds the query, active or not, and single listings that hold it."""
    if len(query) < 2:
        raise ValueError("a query has two letters at least")
    hits = products.where(F.col("normalized_title").ilike(like_pattern(query))).select(F.col("id").alias("product_id"))
    of_groups = matches.join(hits, "product_id", "left_semi").select("match_id").distinct()
    found = groups.where("match_id is not null").join(of_groups, "match_id", "left_semi")
    alone = groups.where("singleton_id is not null").join(hits, groups["singleton_id"] == hits["product_id"], "left_semi")
    return with_savings(found.unionByName(alone))


def autocomplete(groups: DataFrame, query: str, k: int = 8) -> DataFrame:
    """The k best suggestions for the start of a title's search: most shops first, then cheapest."""
    hits = groups.where(F.col("display_title").ilike(like_pattern(query))) if len(query) >= 2 else groups.limit(0)
    return hits.orderBy(F.desc("store_count"), F.asc("min_price"), F.asc("group_id")).limit(min(max(k, 1), 20)).select("group_id", "display_title", "store_count", "min_price")


def group_details(products: DataFrame, sources: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each active listing of a match, with the one cheapest of each match marked and the match's savings."""
    live = active(products.select("id", "title", "price", "image_url", "product_url", "is_available")).drop("is_available")
    shops = sources.select(F.col("id").alias("source_id"), F.col("display_name").alias("shop"))
    rows = matches.join(live, matches["product_id"] == live["id"]).join(shops, "source_id")
    per = Window.partitionBy("match_id")
    rows = rows.withColumn("low", F.min("price").over(per)).withColumn("high", F.max("price").over(per)).withColumn("k", F.row_number().over(per.orderBy("price", rank_of(PRICE_ORDER))))
    saved = (F.col("high") - F.col("low")).cast("double")
    return rows.select(
        "match_id", "source_id", "shop", "product_id", "title", "price", (F.col("k") == 1).alias("is_cheapest"), F.round(F.col("high") - F.col("low"), 2).cast(MONEY).alias("savings"),
        F.when(F.col("high") > 0, F.bround(saved / F.col("high").cast("double") * 100, 1)).otherwise(0.0).alias("savings_percent"),
    )


def volume_label(ml: Column, space: str) -> Column:
    """A content as text: litres from 1000 ml on, one decimal unless whole."""
    return F.when(ml >= 1000, F.concat(F.regexp_replace(F.format_string("%.1f", ml / F.lit(1000.0)), r"\.0$", ""), F.lit(f"{space}L"))).otherwise(F.concat(ml.cast("string"), F.lit(f"{space}ml")))


def count_label(n: Column) -> Column:
    """A count with thousands grouped by a hard blank, and a plus."""
    return F.concat(F.regexp_replace(n.cast("string"), r"\B(?=(\d{3})+(?!\d))", "\u00a0"), F.lit("+"))


def badges(groups: DataFrame) -> DataFrame:
    """Labels of a group: savings badge, content (for details and, without a blank, for filters), price and savings as text."""
    ml, rows = F.col("volume_ml"), with_savings(groups)
    high = F.col("max_price").cast("double")
    percent = F.when(high > 0, F.bround((F.col("max_price") - F.col("min_price")).cast("double") / high * 100, 1)).otherwise(0.0)
    return rows.select(
        "group_id", ((F.col("store_count") > 1) & (F.col("savings") > 0.01)).alias("has_badge"), volume_label(ml, " ").alias("volume_label"), volume_label(ml, "").alias("chip_label"),
        F.translate(F.col("min_price").cast("string"), ".", ",").alias("price_label"), F.concat(F.translate(F.col("savings").cast("string"), ".", ","), F.lit(" €")).alias("savings_label"),
        F.concat(F.floor(percent + 0.5).cast("string"), F.lit("%")).alias("percent_label"), F.substring("display_title", 1, 55).alias("short_title"),
    )


def first_images(products: DataFrame, matches: DataFrame) -> DataFrame:
    """(match_id, image_url): of a match's active listings the picture of the first shop in order that has one."""
    live = active(products.select("id", "image_url", "price", "is_available"))
    return matches.join(live, matches["product_id"] == live["id"]).groupBy("match_id").agg(first_of("image_url", PICTURE_ORDER).alias("image_url"))


def review_items(candidates: DataFrame, products: DataFrame, sources: DataFrame, categories: DataFrame) -> DataFrame:
    """Suggestions as they are shown: one row each with the named listings as an array of structs in shop order, and the first category and content any of them has.
    Listings that are gone keep their place with nulls, times are ISO texts, scores numbers."""
    shops = sources.select(F.col("id").alias("source_id"), "name", F.col("display_name").alias("shop"))
    kinds = categories.select(F.col("id").alias("category_id"), F.col("display_name").alias("category"))
    listed = products.select(F.col("id").alias("product_id"), "title", "price", "product_url", "volume_ml", "category_id").join(kinds, "category_id", "left")
    rows = long_matches(candidates).join(listed, "product_id", "left").join(shops, "source_id")
    entry = F.struct("source_id", "name", "shop", "title", F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"), F.col("product_url").alias("url"), "volume_ml", "category")
    of = rows.groupBy("match_id").agg(F.array_sort(F.collect_list(entry)).alias("stores"))
    first = lambda c: F.get(F.filter(F.transform("stores", lambda s: s[c]), lambda x: x.isNotNull() & (x.cast("string") != "0")), F.lit(0))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    kept = candidates.select(F.col("id").alias("match_id"), "suggestion_source", F.col("jaccard_score").cast("double").alias("jaccard"), F.col("trigram_score").cast("double").alias("trigram"), "review_status", iso("reviewed_at").alias("reviewed_at"), "reviewer_notes", iso("created_at").alias("created_at"))
    return kept.join(of, "match_id", "left").withColumns({"category": first("category"), "volume_ml": first("volume_ml")}).withColumnRenamed("match_id", "id")


def parse_page(number: str | int | None, limit: str | int | None) -> Page:
    """A page from request texts: missing ones have their defaults; what is no number raises ValueError."""
    return Page(int(1 if number in (None, "") else number), int(24 if limit in (None, "") else limit))


def paged(groups: DataFrame, filters: Filters | None = None, sort: str = "name_asc", page: Page | None = None) -> DataFrame:
    """One page of the groups that meet the filters, each row with the total of such groups and the number of pages. An empty page has no rows."""
    page = page or Page()
    rows = groups.where((filters or Filters()).condition())
    total = rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page.limit)).cast("bigint"))
    # One row on the right side.
    return browse(groups, filters, sort, page).withColumn("__one", F.lit(1)).join(F.broadcast(total.withColumn("__one", F.lit(1))), "__one").drop("__one")
