from decimal import Decimal

import pytest

from stillroom.functions.unicode import simple_plain
from stillroom.functions.units import cents, contents, segment
from stillroom.operators.units import all_in_common_units, common_units, misstated

SCHEMA = "id int, title string, metadata string, price_original string, currency string, volume_ml int, price decimal(10,2)"


@pytest.mark.parametrize("unit, field, reading", [
    ("ml", "volume", ("volume", 1)), ("cL", "volume", ("volume", 10)), ("dl", "volume", ("volume", 100)), ("Liter", "volume", ("volume", 1000)), ("lit.", "volume", ("volume", 1000)), ("litara", "volume", ("volume", 1000)),
    ("centiliter", "volume", ("volume", 10)), ("hl", "volume", ("volume", 100_000)), ("cm3", "volume", ("volume", 1)), ("dm³", "volume", ("volume", 1000)), ("m3", "volume", ("volume", 1_000_000)),
    ("c", "price", ("eur", 1)), ("centi", "price", ("eur", 1)), ("ct", "price", ("eur", 1)), ("€", "price", ("eur", 100)), ("kn", "price", ("hrk", 100)), ("lp", "price", ("hrk", 1)), ("kg", "volume", ("mass", 1000)),
])
def test_segment(unit, field, reading):
    assert segment(unit, field) == reading


def test_segment_priors_decide():
    assert segment("ct", "price")[0] == "eur"
    assert segment("ct", "volume")[0] == "mass"  # a hundredth of a tonne, where money isn't expected


@pytest.mark.parametrize("unit", ["yo", "vol", "Canyon", "", "xyz", "l" * 30])
def test_segment_unknown(unit):
    assert segment(unit, "volume") is None


@pytest.mark.parametrize("text, ml", [
    ("Gin 0,7l", 700), ("Rum 0.70 l 40%", 700), ("Rum 1,75 lit.", 1750), ("12 x 0,05L", 600), ("24 × 0,33 l", 7920), ("50 ML x 12", 600), ("20 CL (24 kom)", 4800), ("6/1 75cl", 4500), ("12 US fl oz x 6", 2130), ("16 fl. oz.", 473),
    ("3/4 l", 750), ("6x3/4 l", 4500), ("8yo pola litre", 500), ("6x33 cl", 1980), ("4x2 dl", 800), ("12 godina 10 dl", 1000), ("Ginger ２００ｍｌ", 200), ("1.000 ml", 1000), ("0.500 ml", 1), ("1000 x 0,33 l", 330_000), ("0,7 L (1200 kom)", 840_000), ("1.200 kom x 0,7 l", 840_000), ("2 x 6 x 0,33 l", 3960), ("0,33 l x 6 x 4", 7920), ("0,75 l (2019)", 750), ("0,7 L (2000 kom)", 1_400_000), ("2000 kom 0,7 l", 1_400_000), ("0,7 l 2000 pcs", 1_400_000), ("berba 2019 boca 0,75 l", 750), ("750 ccm", 750), ("1 pint", 473), ("1/2 gallon", 1893), ("1.000 l", 1000), ("0 l", None), ("berba 2019. 13%", None), ("1887 Gin", None), ("", None),
])
def test_contents(text, ml):
    found = contents(simple_plain(text), {})
    assert (found[0][2] * found[0][3] if found else None) == ml


@pytest.mark.parametrize("text, currency, value", [
    ("12,50 €", None, 1250), ("€ 12.50", "HRK", 1250), ("1.415,43 HRK", "EUR", 18786), ("75,345 kn", None, 1000), ("753,45 kn", None, 10000), ("2671 cent", "EUR", 2671), ("198052 lipa", "HRK", 26286), ("25,74 € | 193,94 kn", "HRK", 2574),
    ("17,78 kn / 2,36 €", "EUR", 236), ("od 14,12 €", "EUR", 1412), ("6,15 €/kom", "EUR", 615), ("386,37", "HRK", 5128), ("386,37", None, 38637), ("na upit", "EUR", None), ("", "EUR", None), ("MPC 4,86 €", "EUR", 486),
])
def test_cents(text, currency, value):
    assert cents(simple_plain(text), currency, {}) == value


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    rows = [
        (1, "Gin 0,7 l", None, "10,00 €", "EUR", 700, Decimal("10.00")), (2, "Gin 0,7 l", None, "10,00 €", "EUR", 70, None), (2, "Gin 0,7 l", None, "10,00 €", "EUR", 70, None), (3, None, '{"size": "33cl"}', None, None, None, None),
        (4, "", "", "", "", 0, Decimal("0.00")), (5, "Rum " * 5000 + "1 l", "{}", "rasprodano", "EUR", 1000, Decimal("1.00")),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("common_ml", __import__("pyspark").sql.functions.lit("own"))
    got = {(r.product_id, r.field): r.common_value for r in misstated(df).collect()}
    assert got == {(2, "volume_ml"): 700, (2, "price"): 1000, (3, "volume_ml"): 330}
    assert common_units(df).count() == len(rows)
    assert misstated(df.limit(0)).count() == 0


def test_recorded_numbers_are_converted_by_the_scale_of_their_shop(spark):
    d = Decimal
    rows = [(i, "Gin 0,7 l", None, "75,35 kn", None, 70, d("75.35"), 1) for i in range(5)] + [(10 + i, "Gin 0,7 l", None, "10,00 €", "EUR", 700, d("10.00"), 2) for i in range(5)]
    rows += [(20, "Rum", None, None, None, 70, d("75.00"), 1), (21, "Rum", None, None, "EUR", 700, d("10.50"), 2), (22, None, None, "", None, None, None, 1), (23, "", "", "", "EUR", 0, d("0.00"), 2), (23, "", "", "", "EUR", 0, d("0.00"), 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", source_id int, inferred string")
    got = {r.id: (r.common_ml, r.common_cents, r.ml_from, r.cents_from) for r in all_in_common_units(df).collect()}
    assert got[0] == (700, 1000, "stated", "stated") and got[20] == (700, 995, "recorded", "recorded") and got[21] == (700, 1050, "recorded", "recorded")
    assert got[22] == (None, None, None, None) and got[23] == (None, 0, None, "recorded")
    assert all_in_common_units(df).count() == len(rows) and all_in_common_units(df.limit(0)).count() == 0
