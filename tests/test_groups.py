from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stillroom.operators.groups import Filters, Page, autocomplete, badges, browse, confirmed_matches, count_label, first_images, group_details, like_pattern, long_matches, page_count, page_numbers, paged, parse_page, product_groups, search, wide_matches

PRODUCTS = "id int, source_id int, category_id int, title string, normalized_title string, volume_ml int, price decimal(10,2), image_url string, product_url string, is_available boolean"
MATCHES = "id int, ecuga_id int, cugaklik_id int, promili_id int, diskontfumar_id int, rotodinamic_id int, review_status string"


@pytest.fixture(scope="module")
def data(spark):
    d = Decimal
    products = spark.createDataFrame([
        (1, 1, 1, "A one", "a one", 700, d("10.00"), None, "u1", True), (2, 2, 1, "A two", "a two", 700, d("8.00"), "i2", "u2", True), (3, 3, None, "A three", "a three%", None, d("8.00"), None, "u3", True), (4, 1, 2, "B", "b reserve", None, d("5.00"), None, "u4", True),
        (5, 2, 2, "B dead", "b dead reserve", 500, d("4.00"), None, "u5", False), (6, 4, 2, "C", "c", 500, d("0.00"), None, "u6", True), (7, 5, None, None, None, None, None, None, "u7", None), (8, 4, 2, "Solo", "solo", 1500, d("7.25"), None, "u8", True),
    ], PRODUCTS)
    categories = spark.createDataFrame([(1, "gin", "Gin"), (2, "rum", "Rum")], "id int, slug string, display_name string")
    candidates = spark.createDataFrame([(1, 1, 2, 3, None, None, "confirmed"), (2, 4, 5, None, None, None, "confirmed"), (3, 1, 5, None, None, None, "confirmed"), (4, None, None, None, 6, None, "confirmed"), (5, None, None, 3, 8, None, "rejected")], MATCHES)
    return products, categories, candidates


def test_matches(data):
    _, _, candidates = data
    kept = confirmed_matches(candidates)
    assert {tuple(r) for r in kept.collect()} == {(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 4), (2, 2, 5)}
    assert {r.id: (r.ecuga_id, r.cugaklik_id, r.promili_id) for r in wide_matches(kept).collect()} == {1: (1, 2, 3), 2: (4, 5, None)}
    assert long_matches(candidates).count() == 10


def test_view(data):
    products, categories, candidates = data
    got = {r.group_id: r for r in product_groups(products, categories, confirmed_matches(candidates)).collect()}
    assert set(got) == {"g1", "g2", "p8"}
    g = got["g1"]
    assert (g.display_title, g.display_image_url, g.volume_ml, g.category_slug, g.min_price, g.max_price, g.store_count) == ("A three", "i2", 700, "gin", Decimal("8.00"), Decimal("10.00"), 3)
    assert (got["g2"].display_title, got["g2"].store_count) == ("B", 1)  # the unavailable listing counts for nothing
    assert product_groups(products.limit(0), categories, confirmed_matches(candidates)).count() == 0


def test_browse_search_detail(spark, data):
    products, categories, candidates = data
    matches = confirmed_matches(candidates)
    groups = product_groups(products, categories, matches)
    assert [r.group_id for r in browse(groups, sort="price_asc").collect()] == ["g2", "p8", "g1"]
    assert [r.group_id for r in browse(groups, sort="no such").collect()] == ["g1", "g2", "p8"]
    assert [r.group_id for r in browse(groups, Filters(("gin",), 8, 8, 700, 2)).collect()] == ["g1"]
    assert browse(groups, page=Page(2, 2)).count() == 1
    assert {r.group_id for r in search(groups, products, matches, "reserve").collect()} == {"g2"}
    assert {r.group_id for r in search(groups, products, matches, "a%e").collect()} == {"g1", "g2"}
    assert search(groups, products, matches, "\\q").count() == 0
    with pytest.raises(ValueError):
        search(groups, products, matches, "x")
    assert [r.group_id for r in autocomplete(groups, "a t").collect()] == ["g1"] and autocomplete(groups, "a").count() == 0
    sources = spark.createDataFrame([(i, f"Shop {i}") for i in range(1, 6)], "id int, display_name string")
    rows = {r.product_id: r for r in group_details(products, sources, matches).collect()}
    assert [p for p, r in rows.items() if r.is_cheapest and r.match_id == 1] == [2]  # an equal price goes to the earlier shop
    assert rows[1].savings == Decimal("2.00") and rows[1].savings_percent == 20.0
    labels = {r.group_id: r for r in badges(groups).collect()}
    assert labels["g1"].has_badge and labels["p8"].volume_label == "1.5 L" and labels["g1"].volume_label == "700 ml" and labels["p8"].price_label == "7,25"


def test_labels_pages_and_images(spark, data):
    products, categories, candidates = data
    matches = confirmed_matches(candidates)
    rows = paged(product_groups(products, categories, matches), page=Page(1, 2)).collect()
    assert [(r.group_id, r.total, r.pages) for r in rows] == [("g1", 3, 2), ("g2", 3, 2)]
    assert {r.match_id: r.image_url for r in first_images(products, matches).collect()} == {1: "i2", 2: None}
    labels = spark.createDataFrame([(0,), (4573,), (1234567,)], "n bigint").select(count_label(F.col("n")).alias("l"))
    assert [r.l for r in labels.collect()] == ["0+", "4\u00a0573+", "1\u00a0234\u00a0567+"]
    assert parse_page(None, "") == Page(1, 24) and parse_page("3", "10") == Page(3, 10)
    for bad in (("x", "1"), ("1", "1.5"), ("0", "1")):
        with pytest.raises(ValueError):
            parse_page(*bad)


def test_group_ids():
    from stillroom.operators.lookup import parse_group

    assert parse_group("g12") == ("g", 12) and parse_group("p7") == ("p", 7)
    for bad in ("", "g", "x1", "g-1", "g1.5", "12"):
        with pytest.raises(ValueError):
            parse_group(bad)


def test_pages_and_patterns():
    assert [page_count(n, 24) for n in (0, 24, 25)] == [1, 1, 2]
    assert page_numbers(1, 3) == [1, 2, 3] and page_numbers(10, 20) == [1, None, 8, 9, 10, 11, 12, None, 20]
    assert like_pattern("a\\b%_\\%") == "%a\\\\b%_\\%%"
    for bad in ((0, 24), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            Page(*bad)
