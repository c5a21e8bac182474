import pytest

from stillroom.llm.alike import alike
from stillroom.llm.confusables import common_scripts, consistent, disguised, normalized, resolve


@pytest.mark.parametrize("text, form, found", [
    ("Gin 0,7 l – ® × 5 %", "Gin 0,7 l – ® × 5 %", False), ("Žar Šljivovica", "Žar Šljivovica", False), ("Rum\u00a01 l", "Rum 1 l", True), ("Ru\u200bm", "Rum", True), ("Ｒｕｍ ７００ｍｌ", "Rum 700ml", True), ("Sˇ", "Sˇ", False),
    ("Čempres", "Čempres", True), ("ﬁno", "fino", True), ("Kоzy", "Kozy", True), ("АКСІЈА", "AKCIJA", True), ("12 х 0,05 l", "12 x 0,05 l", True), ("Щедрик", "Щедрик", False), ("Φωλιά", "Φωλιά", False), ("Same‐day", "Same-day", True),
    ("D’Or", "D'Or", True), ("Щедрuк", "Щедрuк", False), ("", "", False), ("\u200b", "", True), ("a\tb", "a b", True), ("ǌiva", "njiva", True), ("жй", "жй"[0] + "й", True),
])
def test_consistent(text, form, found):
    assert consistent(text) == (form, found)


@pytest.mark.parametrize("text, form", [
    ("Gın", "Gin"), ("ɡin", "gin"), ("Ѵodka", "Vodka"), ("Ү rum", "Y rum"), ("Ӏrish", "Irish"), ("Ꭱum", "Rum"), ("ꓣum", "Rum"), ("ⲟak", "oak"), ("Ϲognac", "Cognac"), ("ϲognac", "cognac"), ("Ginո", "Ginn"),
])
def test_letters_of_other_scripts_and_rare_latin_ones(text, form):
    assert consistent(text) == (form, True)


@pytest.mark.parametrize("text", ["гора", "για", "日本語の酒", "한국 술", "क्\u200dष", "\U0001f469\u200d\U0001f469\u200d\U0001f467", "می\u200cخواهم", "Łódź", "smørrebrød", "हिन्दी"])
def test_true_words_and_meaningful_joiners_are_kept(text):
    assert consistent(text) == (text, False)


def test_scripts_are_sets():
    of = alike().scripts_of
    assert of("a") == {"LATIN"} and of("1") is None and "JPAN" in of("酒") and len(of("ー")) > 1
    assert common_scripts("酒の", alike()) and not common_scripts("aж", alike())


def test_mixed_word_takes_the_script_that_can_spell_it():
    assert resolve("Щедpик") == "Щедрик"  # a Latin p inside a Cyrillic word
    assert resolve("Рapa") == "Papa"
    assert resolve("plain") == "plain"


def test_rows(spark):
    rows = [(1, "Rum", "rum"), (2, "R®um", None), (3, None, "r\u200bum"), (3, None, "r\u200bum"), (4, "", ""), (5, "x" * 100_000 + "\ufeff", "ok")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, title string, normalized_title string, form string")
    assert {(r.id, r.field) for r in disguised(df, "id", ["title", "normalized_title"]).collect()} == {(3, "normalized_title"), (5, "title")}
    assert [r.title for r in normalized(df, ["title"]).orderBy("id").collect()][:2] == ["Rum", "R®um"]
    assert disguised(df.limit(0), "id", ["title"]).count() == 0
