import random

import pytest

from stillroom.llm.leakage import RUN, Index, leaks, search, stretches, words_of

ITEM = "In 1849 the archivist Ilvana of Pellingrad bought 73 bundles of hop bines for 64 marks apiece and the bell-founder Urmas-Ken kept the rest."


@pytest.mark.parametrize("text", [
    ITEM, ITEM.upper(), ITEM.replace(" ", "\u00a0"), "<p>" + ITEM.replace("bundles", "<b>bundles</b>") + "</p>", ITEM.replace("hop", "*hop*").replace("64", "**64**"), "\n".join("> " + x for x in ITEM.split(" b")).replace("> ", "> b", 0),
    ITEM.replace("archivist", "archi-\n-- vist"), ITEM.replace(" marks", "\n * marks"), '{"passage": "' + ITEM + '"}', ITEM.replace("the", "t\u200bhe"), ITEM.replace("Urmas-Ken", "Urmas-\r\nKen"), ITEM.replace("'", "&#x27;"),
])
def test_layouts_have_the_same_words(text):
    if text.startswith(">"):
        text = "\n".join("> " + x for x in ITEM.split("\n"))
    words, own = words_of(text), words_of(ITEM)
    assert any(words[i : i + len(own)] == own for i in range(len(words)))


def test_search_is_brute_force():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    pick = lambda n: [vocabulary[min(59, int(rnd.expovariate(0.08)))] for _ in range(n)]
    items = [(i, pick(rnd.randint(5, 70)), []) for i in range(80)]
    index = Index(items)
    for _ in range(120):
        doc = pick(rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 3)):
            _, own, _ = rnd.choice(items)
            a, n = rnd.randrange(len(own)), rnd.randint(8, 25)
            at = rnd.randint(0, len(doc))
            doc = doc[:at] + own[a : a + n] + doc[at:]
        expected = {}
        for k, (_, own, _) in enumerate(index.items):
            best = 0
            for p in range(len(doc)):
                for q in range(len(own)):
                    n = 0
                    while p + n < len(doc) and q + n < len(own) and doc[p + n] == own[q + n]:
                        n += 1
                    best = max(best, n)
            if best >= RUN:
                expected[k] = best
        assert search(index, doc) == expected


def test_wand_returns_all_above():
    rnd = random.Random(6)
    items = [(i, [f"w{int(rnd.expovariate(0.05))}" for _ in range(rnd.randint(13, 60))], []) for i in range(150)]
    index = Index(items)
    for _ in range(200):
        terms = {f"w{int(rnd.expovariate(0.05))}" for _ in range(rnd.randint(1, 30))}
        score = [0.0] * len(items)
        for t in terms:
            for block, _, _ in index.postings.get(t, ()):
                for k, x in block:
                    score[k] += x
        for least in (0.3, 0.7, 1.0):
            assert sorted(index.above(terms, least)) == [k for k, s in enumerate(score) if s >= least]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "before. " + ITEM, ""), (1, "before. " + ITEM, ""), (2, None, ""), (3, "", ""), (4, " ".join(ITEM.split()[:12]), ""), (None, ITEM, ""), (5, "filler " * 60_000 + ITEM + " 706", "")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM, "706"), (11, "too short", None), (12, None, None), (13, ITEM, None)], "item_id bigint, text string, answer string")
    for shard in (20_000, 1):
        got = {(r.doc_id, r.item_id): (r.run_words, r.answer_found) for r in leaks(docs, items, shard).collect()}
        n = len(words_of(ITEM))
        assert got == {(1, 10): (n, False), (1, 13): (n, False), (5, 10): (n, True), (5, 13): (n, False)}
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ['<a href="https://x.example/?' + "utm=1&" * 100 + '">', '<img\n  class="p"\n  src=\'data:x\'\n/>', "<a\nhref=x?a=b>"])
def test_long_and_broken_tags_are_no_words(tag):
    assert words_of(ITEM.replace("hop", tag + "hop")) == words_of(ITEM)


def test_text_after_a_stray_sign_stays():
    assert words_of("if n <m\n" + ITEM + "\n> quoted")[-len(words_of(ITEM)) - 1 : -1] == words_of(ITEM)


def test_tags_of_any_length_and_text_that_only_looks_like_one():
    inside = "word " * 100
    assert words_of(f"one <a href='x' title='{inside}'> two <p {inside}= > three") == ["one", "two", "three"]
    assert words_of("one <td nowrap> two </td > three <https://x.example/y> four <br/> five <!-- six") == ["one", "two", "three", "four", "five", "six"]
    assert words_of("is a <b and c\n> quoted") == ["is", "a", "b", "and", "c", "quoted"]


def test_stretches():
    known = dict.fromkeys("abc", 1.0)
    words = list("abc" * 5) + ["x"] + list("ab" * 6) + ["y", "z"] + list("cab" * 5)
    assert list(stretches(known, words)) == [(0, 15), (30, 45)]
    assert list(stretches(known, [])) == list(stretches(known, list("abc" * 4))) == []
