from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stillroom.functions.titles import content_ml, fingerprint, jaccard, listing_ml, match_tokens, normalized_title, overlap, parsed_price, resolved_url, simple_title, trigrams


def one(spark, make, *values, types="string"):
    kinds = types if isinstance(types, (list, tuple)) else [types] * len(values)
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {t}" for i, t in enumerate(kinds)))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).collect()[0].x


@pytest.mark.parametrize("text, ml", [("0.7l", 700), ("0,70l", 700), ("700ml", 700), ("70cl", 700), ("Gin0.5l", 500), ("0,02l", 20), ("1.75l", 1750), ("12 x 0,05 L", 600), ("24 x 33cl", 7920), ("120 x 0,05l", 6000), ("0,375l", 375), ("6 × 1l", 6000), ("5ml", None), ("60 l", None), ("40% 0,7l", 700), ("none", None), ("", None), (None, None)])
def test_content(spark, text, ml):
    assert one(spark, content_ml, text) == ml


@pytest.mark.parametrize("text, price", [("99,99€", "99.99"), ("99.99 €", "99.99"), ("3.339,50€", "3339.50"), ("99,50", "99.50"), ("Ponuda na upit", None), ("1.500", "1.50"), ("12,50 €/kom", None), ("1,234,56", None), ("", None), ("12,5 €", "12.50"), (None, None)])
def test_price(spark, text, price):
    assert one(spark, parsed_price, text) == (price and Decimal(price))


@pytest.mark.parametrize("title, normal, key", [
    ("Jack Daniel's 0,7l", "jack daniel s 700ml", "jack daniel"), ("THE Macallan 12 YO 70cl", "macallan 12yo 700ml", "macallan 12"), ("Whiskey 43,2% 0.75 L", "whisky 750ml", ""), ("Gordon's Pink Gin0.7L", "gordon s pink gin 700ml", "gordon pink"),
    ("Bumbu 0,375l", "bumbu 0 375000ml", "bumbu 0"), ("Glenfiddich 12YO + karton", "glenfiddich 12yo", "glenfiddich 12"), ("Rum 12 x 0,05 L", "rum 12 x 50ml", "12"), ("Čaše-a šljiva", "čaše a šljiva", "čaše šljiva"), ("", "", ""),
])
def test_normal_form_and_key(spark, title, normal, key):
    assert one(spark, normalized_title, title) == normal
    assert " ".join(one(spark, lambda c: match_tokens(normalized_title(c)), title)) == key


def test_null_title(spark):
    assert one(spark, normalized_title, None) is None
    assert one(spark, lambda c: match_tokens(normalized_title(c)), None) == []


@pytest.mark.parametrize("a, b, j, t", [
    ("ardbeg 10", "ardbeg 10", 1, 1), ("macallan 12 double cask", "macallan 12 triple cask", 0.6, 15 / 27), ("plavac mali", "plavac mali reserve", 2 / 3, 9 / 17), ("chivas 12", "chivas 18", 1 / 3, 6 / 8), ("patron reposado", "patron resposado", 1 / 3, 11 / 16), ("", "", 1, 1), ("", "jameson", 0, 0),
])
def test_similarities(spark, a, b, j, t):
    lists = [[w for w in x.split(" ") if w] for x in (a, b)]
    kinds = ["array<string>", "array<string>"]
    assert one(spark, jaccard, *lists, types=kinds) == pytest.approx(j)
    assert one(spark, lambda x, y: jaccard(trigrams(x), trigrams(y)), *lists, types=kinds) == pytest.approx(t)


def test_overlap_links_and_others(spark):
    kinds = ["array<string>", "array<string>"]
    assert one(spark, overlap, ["a", "b", "c"], ["b", "c"], types=kinds) == 1.0
    assert one(spark, overlap, [], ["b"], types=kinds) == 0.0
    assert one(spark, resolved_url, "/x", "https://s.example") == "https://s.example/x"
    assert one(spark, resolved_url, "http://y", "https://s.example") == "http://y"
    assert one(spark, resolved_url, "rel", "https://s.example") == "rel"
    assert one(spark, simple_title, " A-b Č1 ") == "ab 1"
    assert one(spark, listing_ml, None, "1l") == 1000
    assert one(spark, fingerprint, ["b:2", "a:1"], types=["array<string>"]) == one(spark, fingerprint, ["a:1", "b:2"], types=["array<string>"])
