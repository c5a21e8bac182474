"""Listings of one product under different wordings: title combination voting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillroom.functions.unicode import unaccented
from stillroom.functions.units import contents
from stillroom.llm.alike import Alike, alike
from stillroom.llm.confusables import consistent
from stillroom.sources.tables import cut

ABV = re.compile(r"[(\[]?(?:\balk(?:\.|ohol)?\s*)?[-+]?\d+(?:[.,]\d+)?\s*%(?:\s*vol\b\.?)?[)\]]?|(?<![\d.,])0[.,]0(?![\d.,]*\d)|\balk\.?(?=\s|$)|\bvol\b\.?", re.I)
AGE = re.compile(r"\baged\s+(\d{1,3})\s*years?\b|\b(\d{1,3})\s*(?:y\.?\s?o\b\.?|years?\s+old\b|years?\b|jahre\b|godina\b|god\b\.?)", re.I)
VINTAGE = re.compile(r"(?:\bberba\s+)?[(\[]?(?<![\d.,])\b((?:19|20)\d\d)\b(?![.,]?\d)[)\]]?\.?", re.I)
TOKEN = re.compile(r"[^\W_]+")
# A combination leaves out at most three tokens; what it leaves out tells nothing apart if it occurs in FILLER_SETS token sets, of which this share is also listed without it.
FILLER_SETS, FILLER_SHARE = 20, 0.3
#: Words up to this length meet by dropping one letter, longer ones by their halves.
SHORT = 12


def phrase_trie(phrases: list[str]) -> dict:
    top: dict = {}
    for phrase in phrases:
        node = top
        for token in TOKEN.findall(unaccented(phrase)):
            node = node.setdefault(token, {})
        if node is not top:
            node[""] = True
    return top


def identity(text: str, phrases: dict, units: dict, tables: Alike | None = None) -> tuple[list[str], int | None, int | None, int | None]:
    """(distinct tokens in order, age, vintage, total content in ml) of a title, its characters made consistent and every phrase of the trie left out."""
    plain = consistent(text, tables)[0]
    found = contents(plain, units)
    ml = found[0][2] * found[0][3] if found else None
    for c in reversed(found):
        plain = plain[: c[0]] + " " + plain[c[1] :]
    plain = ABV.sub(" ", plain)
    age = AGE.search(plain)
    plain = AGE.sub(" ", plain)
    vintage = VINTAGE.search(plain)
    plain = VINTAGE.sub(" ", plain)
    words, kept, i = TOKEN.findall(unaccented(plain)), [], 0
    while i < len(words):
        node, end = phrases, 0
        for j in range(i, len(words)):
            node = node.get(words[j])
            if node is None:
                break
            if "" in node:
                end = j + 1
        if end:
            i = end
        else:
            kept.append(words[i])
            i += 1
    return list(dict.fromkeys(kept)), age and int(age[1] or age[2]), vintage and int(vintage[1]), ml


def analyser(phrases: list[str]) -> Callable:
    trie, tables = phrase_trie(phrases), alike()

    @F.pandas_udf("struct<tokens: array<string>, age: int, vintage: int, ml: bigint>")
    def analyse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units: dict = {}
        for titles, metadata in batches:
            rows = []
            for t, m in zip(titles, metadata, strict=True):
                tokens, age, vintage, ml = identity(t or "", trie, units, tables)
                if ml is None and m:
                    ml = next((c[2] * c[3] for c in contents(consistent(m, tables)[0], units)), None)
                rows.append((tokens, age, vintage, ml))
            frame = pd.DataFrame(rows, columns=["tokens", "age", "vintage", "ml"])
            yield frame.astype({"age": "Int32", "vintage": "Int32", "ml": "Int64"})

    return analyse


@F.pandas_udf(T.BooleanType())
def one_slip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two words differ by one letter added, dropped, replaced or swapped with its neighbour."""
    for left, right in batches:
        yield pd.Series([slip(a, b) for a, b in zip(left, right, strict=True)], dtype=bool)


def slip(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    x, y = a[start:], b[start:]
    if len(x) == len(y):
        return x[1:] == y[1:] or (x[2:] == y[2:] and x[:2] == y[1::-1])
    return x[1:] == y if len(x) > len(y) else x == y[1:]


def meeting_points(word: Column) -> Column:
    """Hashes of which two words that are one slip apart always share one.

    Short words, where the shorter has up to SHORT letters: the word itself and what is left of it without one letter. Longer ones: the start or the end, each
    one letter less than half as long as the shorter word; a slip in one half leaves the other as it is. A word takes part with itself as the shorter one
    and as one letter longer, so four starts and ends do for any length.
    """
    n = F.length(word)
    dropped = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    short = F.when(n <= SHORT + 1, F.transform(F.array_append(dropped, word), lambda x: F.xxhash64(x)))

    def halves(least: Column) -> Column:
        h = F.floor(least / 2).cast("int") - 1
        return F.when(least > SHORT, F.array(F.xxhash64(least, F.lit("start"), F.substring(word, F.lit(1), h)), F.xxhash64(least, F.lit("end"), F.substring(word, n - h + 1, h))))

    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in (short, halves(n), halves(n - 1))]))


def spellings(tokens: DataFrame) -> DataFrame:
    """(token, repair, repair_df): words one slip away from a commoner one. A repair is at least five times as common, or the word hardly occurs at all.

    Words of one or two letters are no misspellings: nearly every other such word is one slip away. Only words that share a meeting point are compared, and
    of these only rare ones with commoner ones.
    """
    met = tokens.where(F.length("token") >= 3).select("token", "df", F.explode(meeting_points(F.col("token"))).alias("cut"))
    rare, common = met, met.select("cut", F.col("token").alias("repair"), F.col("df").alias("repair_df"))
    near = rare.join(common, "cut").where("token <> repair and (repair_df >= 5 * df or (df <= 2 and (repair_df > df or (repair_df = df and repair < token)))) ")
    return near.select("token", "repair", "repair_df").distinct().where(one_slip("token", "repair"))


def labelled(tokens: Column | str, age: str = "age", vintage: str = "vintage"):
    """A combination of tokens with age and vintage as one string."""
    return F.concat_ws("|", F.array_join(F.array_sort(tokens), " "), F.coalesce(F.col(age).cast("string"), F.lit("-")), F.coalesce(F.col(vintage).cast("string"), F.lit("-")))


def respelled():
    """The combination with every token of ``swaps`` replaced by its repair."""
    repair = F.map_from_entries("swaps")
    return labelled(F.array_distinct(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(repair, t), t))))


def code_of(codes: Column) -> Column:
    """The 64-bit code of a set of codes: what is left of a set when some are taken out has the code of the set with theirs taken out."""
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def sent_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """The rows, counted, marked for broadcast if there are so few that they are sure to fit; else left to a shuffle. The result is the same."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def left_out(sets: DataFrame) -> DataFrame:
    """(code, left) for each k-combination of a set of tokens (code, codes), k from size - 3 (at least 1) to size - 1, by the codes that it leaves out.

    Only what FILLER_SETS sets hold can be a filler, and then each part of it is held by as many: tokens that are rarer take no part, two only if each is common,
    three only if each two are common together. That loses no filler and keeps the combinations of long titles few. A set's combinations are made one
    after the other, so that a set of any size fits.
    """
    enough = F.col("n") >= FILLER_SETS
    singles = sets.select("code", F.size("codes").alias("size"), F.explode("codes").alias("x"))
    frequent = sent_if_small(singles.groupBy("x").agg(F.count("*").alias("n")).where(enough).select("x"))
    common = cut(singles.join(frequent, "x").groupBy("code", "size").agg(F.array_sort(F.collect_list("x")).alias("items")))
    ones = common.select("code", "size", "items", F.posexplode("items").alias("at", "x"))
    after = F.slice("items", F.col("at") + 2, F.size("items"))
    twos = ones.select("code", "size", "x", F.col("at"), "items", F.posexplode(after).alias("further", "y"))
    together = sent_if_small(twos.groupBy("x", "y").agg(F.count("*").alias("n")).where(enough).select("x", "y"))
    pairs = twos.join(together, ["x", "y"])
    threes = pairs.select("code", "size", "x", "y", F.explode(F.slice("items", F.col("at") + F.col("further") + 3, F.size("items"))).alias("z"))
    threes = threes.join(together.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"], "left_semi").join(together.select("x", F.col("y").alias("z")), ["x", "z"], "left_semi")
    parts = [rows.where(F.col("size") > len(c)).select("code", F.array(*c).alias("left")) for rows, c in ((ones, ["x"]), (pairs, ["x", "y"]), (threes, ["x", "y", "z"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fillers_of(sets: DataFrame) -> DataFrame:
    """(code, dropped) of the sets of tokens (code, codes) that hold fillers, with the fillers' codes.

    What a k-combination leaves out is a filler if the combination is a listed title of its own often enough: shops put sales words, kinds and tails of firms
    beside a title at will, while a variant seldom has all else equal beside it. A set that would be left empty keeps its tokens.
    """
    parts = left_out(sets)
    votes = parts.select("left", F.col("code").bitwiseXOR(code_of(F.col("left"))).alias("code")).join(sets.select("code", F.lit(1).alias("listed")), "code", "left")
    tally = votes.groupBy("left").agg(F.count("*").alias("sets"), F.count("listed").alias("listed"))
    fillers = sent_if_small(tally.where((F.col("sets") >= FILLER_SETS) & (F.col("listed") >= FILLER_SHARE * F.col("sets"))).select("left"))
    dropped = parts.join(fillers, "left").groupBy("code").agg(F.array_distinct(F.flatten(F.collect_list("left"))).alias("dropped"))
    whole = dropped.join(sets.select("code", F.size("codes").alias("size")), "code")
    return cut(whole.where(F.size("dropped") < F.col("size")).drop("size"))


def without_fillers(named: DataFrame) -> DataFrame:
    """(identity, tokens): the distinct token sets of listings (identity, age, vintage, tokens) and what is left of them without fillers.

    Votes are taken again on what is left, since a title with three additions shows only then that one without them is listed; until no filler is found. Every
    round shortens a title, so rounds end.
    """
    first = named.groupBy("identity", "age", "vintage").agg(F.first(F.array_sort("tokens")).alias("tokens"))
    codes = F.transform("tokens", lambda t: F.xxhash64(t))
    # Equal codes of different sets, at 64 bits, could shift a vote but never join two titles.
    cores = cut(first.select("identity", "tokens", F.xxhash64("age", "vintage").alias("marks"), codes.alias("codes")))
    while True:
        coded = cores.withColumn("code", F.col("marks").bitwiseXOR(code_of(F.col("codes"))))
        dropped = fillers_of(cut(coded.groupBy("code").agg(F.first("codes").alias("codes"))))
        if dropped.isEmpty():
            return cores.select("identity", F.filter("tokens", lambda t: F.array_contains("codes", F.xxhash64(t))).alias("tokens"))
        left = F.when(F.col("dropped").isNotNull(), F.array_except("codes", "dropped")).otherwise(F.col("codes"))
        cores = cut(coded.join(dropped, "code", "left").select("identity", "tokens", "marks", left.alias("codes")))


def last_taken(best: DataFrame) -> DataFrame:
    """(identity, takes) with each combination's repairs followed to the end: clusters whose combination takes another one are merged into that one's.

    Repairs lead to commoner words, or among equally rare ones to the smaller, so chains end; each round halves what is left of them.
    """
    steps = cut(best)
    while True:
        onward = steps.select(F.col("identity").alias("takes"), F.col("takes").alias("further"))
        if steps.join(onward, "takes", "left_semi").isEmpty():
            return steps
        steps = cut(steps.join(onward, "takes", "left").select("identity", F.coalesce("further", "takes").alias("takes")))


def product_groups(listings: DataFrame, phrases: list[str]) -> DataFrame:
    """(id, group_id, n_tokens, age, vintage, ml) for every listing; listings with one group_id are the same product.

    Voting: a title's tokens, less measures and the canonical list's own names (``phrases``), are its widest combination; its k-combinations leave out up to
    three of them, and again up to three of what is left. One is verified if all it leaves out are fillers (``without_fillers``), and the title goes on with its
    smallest verified one. There it takes the best candidate: the combination as it stands, or one that holds repairs in place of tokens one slip away from
    them (one token, or all doubtful ones) while all others, age and vintage agree. Candidates are ranked by k * k * ln(1 + frequency) / (1 + mean position of
    the repaired token); all of a title's have the same k, so frequency and position decide. Titles that take the same combination form a cluster, and
    clusters chained by repairs are merged. Within a cluster the total content must be equal; a listing that states none takes volume_ml, and if that is
    missing too, the one content that its cluster has, if it has just one.

    Titles without identifying tokens, null ones too, stay alone. A title that is null is replaced by normalized_title. Frequencies cover all listings;
    everything after the scan works on distinct token sets, so copies cost one row.
    """
    seen = analyser(phrases)(F.coalesce("title", "normalized_title"), "metadata")
    rows = listings.select("id", "volume_ml", seen.alias("s")).select("id", "s.*", F.when(F.col("volume_ml") > 0, F.col("volume_ml").cast("bigint")).alias("volume_ml"))
    rows = cut(rows.select("id", "age", "vintage", F.coalesce("ml", "volume_ml").alias("ml"), "tokens", labelled("tokens").alias("identity")))
    listed = rows.where(F.size("tokens") > 0)
    cores = without_fillers(listed).select("identity", F.col("tokens").alias("core"))
    named = cut(listed.join(cores, "identity").select("id", "age", "vintage", "ml", F.array_intersect("tokens", "core").alias("tokens"), labelled("core").alias("identity")))
    # Votes are counted once for each distinct combination, and combinations are told apart by their codes, so that a long title costs a number for each
    # repair; the position of a token is its mean place in the titles.
    lexicon = cut(named.groupBy("identity", "age", "vintage").agg(F.count("*").alias("n"), F.first(F.array_sort("tokens")).alias("tokens")).withColumn("code", F.xxhash64("age", "vintage").bitwiseXOR(code_of(F.transform("tokens", lambda t: F.xxhash64(t))))))
    tokens = lexicon.select("n", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("df"))
    repairs = cut(spellings(tokens))
    places = named.select(F.posexplode("tokens").alias("place", "token")).groupBy("token").agg(F.avg("place").alias("place"))
    held = lexicon.select("code", "n", F.size("tokens").alias("k"), F.explode("tokens").alias("token"))
    doubtful = held.join(repairs, "token")
    # A repair that the title holds already only takes the word's place away.
    doubtful = cut(doubtful.join(held.select("code", F.col("token").alias("repair"), F.lit(True).alias("double")), ["code", "repair"], "left").withColumn("added", F.when(F.col("double").isNull(), F.xxhash64("repair"))))
    swap = F.struct("token", "repair")
    chosen = doubtful.groupBy("code", "n", "k", "token").agg(F.max_by(F.struct("repair", "added"), F.struct("repair_df", "repair")).alias("r")).groupBy("code", "n", "k").agg(
        F.collect_list(F.struct("token", F.col("r.repair").alias("repair"))).alias("swaps"), F.collect_set("r.added").alias("added"), F.bit_xor(F.xxhash64("token")).alias("gone"),
    ).where(F.size("swaps") > 1)
    common = chosen.select("code", "n", "k", "swaps", F.col("code").bitwiseXOR(F.col("gone")).bitwiseXOR(code_of(F.col("added"))).alias("takes"))
    single = doubtful.select("code", "n", "k", F.array(swap).alias("swaps"), F.col("code").bitwiseXOR(F.xxhash64("token")).bitwiseXOR(F.coalesce("added", F.lit(0))).alias("takes"))
    repaired = cut(single.unionByName(common))
    # A combination's frequency counts the titles that spell it so and those that would after a repair.
    support = repaired.groupBy("takes").agg(F.sum("n").alias("repaired_n")).join(lexicon.select(F.col("code").alias("takes"), F.col("n").alias("own_n")), "takes", "left")
    votes = repaired.join(support, "takes").withColumn("repair", F.explode("swaps.repair")).join(places.select(F.col("token").alias("repair"), "place"), "repair", "left")
    frequency = (F.col("repaired_n") + F.coalesce("own_n", F.lit(0))).cast("double")
    score = F.col("k") * F.col("k") * F.log1p(frequency) / (1 + F.coalesce("place", F.lit(0.0)))
    best = votes.where(F.coalesce("own_n", F.lit(0)) + F.col("repaired_n") > F.col("n")).groupBy("code").agg(F.max_by("swaps", F.struct(score, F.col("takes"))).alias("swaps"))
    best = lexicon.join(best, "code").select("identity", respelled().alias("takes")).where("identity <> takes")
    label = last_taken(best).select("identity", F.col("takes").alias("cluster"))
    clustered = cut(named.join(label, "identity", "left").select("id", "age", "vintage", "ml", F.size("tokens").alias("n_tokens"), F.coalesce("cluster", "identity").alias("cluster")))
    only = clustered.where("ml is not null").groupBy("cluster").agg(F.min("ml").alias("lo"), F.max("ml").alias("hi")).where("lo = hi").select("cluster", F.col("lo").alias("only_ml"))
    missing = clustered.where("ml is null").join(only, "cluster", "left").withColumn("ml", F.col("only_ml")).drop("only_ml")
    filled = clustered.where("ml is not null").unionByName(missing).withColumn("size", F.coalesce("ml", F.lit(-1)))
    first = filled.groupBy("cluster", "size").agg(F.min("id").alias("group_id"))
    grouped = filled.join(first, ["cluster", "size"]).select("id", "group_id", "n_tokens", "age", "vintage", "ml")
    return grouped.unionByName(rows.where(F.size("tokens") == 0).select("id", F.col("id").alias("group_id"), F.lit(0).alias("n_tokens"), "age", "vintage", "ml"))


def pairs_within(groups: DataFrame) -> DataFrame:
    """(product_id_a, product_id_b), a < b, of all listings that share a group: the form in which the result is asked for."""
    a, b = groups.select("group_id", F.col("id").alias("product_id_a")), groups.select("group_id", F.col("id").alias("product_id_b"))
    return a.join(b, "group_id").where("product_id_a < product_id_b").select("product_id_a", "product_id_b")
