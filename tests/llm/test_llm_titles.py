import pytest

from stillroom.llm.titles import identity, pairs_within, phrase_trie, product_groups, slip

PHRASES = ["rum", "gin", "bijelo vino", "craft pivo", "akcija", "izdvojeno", "gift box", "daughters", "1887"]
SCHEMA = "id int, title string, normalized_title string, volume_ml int, metadata string, group_id string"


@pytest.mark.parametrize("a, b, near", [("kinake", "kinke", True), ("kinake", "kianke", True), ("kinake", "kinakke", True), ("kinake", "kinaxe", True), ("kinake", "kinake", False), ("kinake", "knaek", False), ("ab", "ba", True), ("a", "", True), ("abc", "", False)])
def test_slip(a, b, near):
    assert slip(a, b) is near and slip(b, a) is near


@pytest.mark.parametrize("title, tokens, age, vintage, ml", [
    ("KINAKE & Daughters Drifter selekcija berba 2024. 11,5% vol. 750 mL", ["kinake", "drifter", "selekcija"], None, 2024, 750), ("Rum, Rutabrax, Saddle, 12 godina, gift box", ["rutabrax", "saddle"], 12, None, None),
    ("6x0,33l AKCIJA Peglufu Echo – izdvojeno", ["peglufu", "echo"], None, None, 1980), ("Gubrunan 1887 Orchard aged 18 years -20%", ["gubrunan", "orchard"], 18, None, None), ("0.0 Brosebre Mornar 33cl", ["brosebre", "mornar"], None, None, 330), ("", [], None, None, None),
])
def test_identity(title, tokens, age, vintage, ml):
    assert identity(title, phrase_trie(PHRASES), {}) == (tokens, age, vintage, ml)


def test_groups(spark):
    titles = {
        1: ("Kinake Drifter Noir Rum 0,7 l", 700, None), 2: ("Rum KINAKE & Daughters, Drifter, Noir", 7, '{"size": "70cl"}'), 3: ("Noir Drifter Kinke 700ml", None, None), 4: ("Kinake Drifter 0,7l", None, None), 5: ("Kinake Drifter Noir 1 l", None, None),
        6: ("Kinake Drifter Noir 12yo 0,7l", None, None), 7: ("Kinake Sable Noir 0,7l", None, None), 8: ("Kinake Gable Noir 0,7l", None, None), 9: (None, None, None), 10: ("", 700, None), 11: ("Rum AKCIJA", 700, None), 12: ("Kinаke Drіfter Noir ７０cl", None, None),
        13: ("Gable Kinake Noir 700 ml", None, None), 14: ("Kinake Gable Noir 0.7 l", None, None), 15: ("Sable Kinake Noir 0.70 l", None, None), 16: ("Kinake Sable Noir 7dl", None, None), 17: ("Solo Unic", None, None), 18: ("Solo Unic 50 cl", None, None),
    }
    rows = [(i, t, None if t is None or i != 4 else "kinake drifter 700ml", v, m, "clash") for i, (t, v, m) in titles.items()]
    got = product_groups(spark.createDataFrame(rows, SCHEMA), PHRASES)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.group_id, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 12], [4], [5], [6], [7, 15, 16], [8, 13, 14], [9], [10], [11], [17, 18]]
    assert {(r.product_id_a, r.product_id_b) for r in pairs_within(got.where("id in (17, 18, 4)")).collect()} == {(17, 18)}


def test_empty(spark):
    assert product_groups(spark.createDataFrame([], SCHEMA), PHRASES).count() == 0


def test_copies(spark):
    rows = [(i, "Kinake Drifter Noir 0,7 l", None, 700, None, "") for i in range(50)]
    got = product_groups(spark.createDataFrame(rows, SCHEMA), PHRASES).collect()
    assert {r.group_id for r in got} == {0} and len(got) == 50


def test_unlisted_filler_is_left_out_and_a_variant_is_not(spark):
    rows = []
    for i in range(30):
        name = f"{'bcdfg'[i % 5]}otarel {'klmnpr'[i // 5]}ivandor"
        titles = [name, f"{name} ekskluziv", f"{name} najbolja kupnja"] if i < 24 else [f"{name} noir"]
        rows += [(10 * i + k, t, None, 700, None, "") for k, t in enumerate(titles)]
    rows += [(1000 + i, f"{'bcdfg'[i % 5]}otarel {'klmnpr'[i // 5]}ivandor noir", None, 700, None, "") for i in range(2)]
    groups = {}
    for r in product_groups(spark.createDataFrame(rows, SCHEMA), PHRASES).collect():
        groups.setdefault(r.group_id, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == sorted([[10 * i, 10 * i + 1, 10 * i + 2] for i in range(24)] + [[10 * i] for i in range(24, 30)] + [[1000], [1001]])


def test_words_one_slip_apart_meet_at_any_length(spark):
    import random

    from pyspark.sql import functions as F

    from stillroom.llm.titles import meeting_points, spellings

    rnd, pairs = random.Random(5), []
    for n in [*range(3, 20), 41, 90]:
        for _ in range(12):
            a = "".join(rnd.choice("abcdefgh") for _ in range(n))
            i = rnd.randrange(n)
            pairs += [(a, a[:i] + a[i + 1 :]), (a, a[:i] + "x" + a[i:]), (a, a[:i] + "y" + a[i + 1 :]), (a, a[:i] + a[i : i + 2][::-1] + a[i + 2 :])]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.arrays_overlap(meeting_points(F.col("a")), meeting_points(F.col("b"))).alias("meet"))
    assert all(r.meet for r in df.collect())
    long = "w" * 60 + "kinake" + "v" * 60
    words = spark.createDataFrame([(long, 50), (long[:70] + "q" + long[70:], 1), ("ab", 9), ("abc", 1)], "token string, df bigint")
    assert [(r.token, r.repair) for r in spellings(words).collect()] == [(long[:70] + "q" + long[70:], long)]


def test_fillers_that_stand_together_are_found_round_by_round(spark):
    rows = []
    for i in range(40):
        name = f"{'bcdfghj'[i % 7]}otarel {'klmnpr'[i // 7]}ivandor"
        rows += [(10 * i + k, t, None, 700, None, "") for k, t in enumerate([name, f"{name} u kutiji", f"{name} estate", f"{name} estate vraceno na zalihu u kutiji"])]
    rows.append((9000, " ".join(f"word{i}" for i in range(3000)) + " estate", None, 700, None, ""))
    got = product_groups(spark.createDataFrame(rows, SCHEMA), PHRASES).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group_id, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[10 * i + k for k in range(4)] for i in range(40)] + [[9000]]
