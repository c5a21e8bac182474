import datetime
import json
from decimal import Decimal

from pyspark.sql import functions as F

from stillroom.operators.ingest import backfilled, last_writes, merged, recorded_changes, without_categories, without_shops
from stillroom.sources.landing import CARDS, dump, export_csv, export_json, file_slug, page_listings, read_groups, read_landing, restore, write_landing
from stillroom.streaming.merge import merge_stream

T = datetime.datetime(2026, 1, 1)
STATE = "shop int, url string, category int, price decimal(10,2), is_available boolean, last_seen_at timestamp"


def test_merge_and_history(spark):
    d = Decimal
    state = spark.createDataFrame([(1, "same", 1, d("10"), True, T), (1, "dearer", 1, d("10"), True, T), (1, "gone", 1, d("10"), True, T), (1, "elsewhere", 2, d("10"), True, T), (1, "back", 1, d("10"), False, T), (1, "nullprice", 1, None, True, T), (1, "dead", 1, d("1"), False, T)], STATE)
    landed = spark.createDataFrame([(1, "same", 1, d("10")), (1, "dearer", 1, d("12")), (1, "back", 1, d("10")), (1, "new", 1, d("3")), (1, "nullprice", 1, d("4"))], "shop int, url string, category int, price decimal(10,2)")
    after = merged(state, landed, ["shop", "url"], ["shop", "category"], F.lit(T))
    got = {r.url: (r.price, r.is_available, r.outcome) for r in after.collect()}
    assert got == {"same": (d("10"), True, "updated"), "dearer": (d("12"), True, "updated"), "gone": (d("10"), False, "deactivated"), "elsewhere": (d("10"), True, "kept"), "back": (d("10"), True, "updated"), "new": (d("3"), True, "inserted"), "nullprice": (d("4"), True, "updated"), "dead": (d("1"), False, "kept")}
    assert {(r.url, r.price, r.was_available) for r in recorded_changes(after, ["shop", "url"]).collect()} == {("dearer", d("12"), True), ("gone", d("10"), False), ("back", d("10"), True)}
    assert merged(state.limit(0), landed, ["shop", "url"], ["shop", "category"], F.lit(T)).where("outcome = 'inserted'").count() == 5
    assert merged(state, landed.limit(0), ["shop", "url"], ["shop", "category"], F.lit(T)).where("outcome = 'kept'").count() == 7


def test_last_writes(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "x")], "k int, at int, v string")
    assert {(r.k, r.v) for r in last_writes(df, ["k"], [F.col("at"), F.col("v")]).collect()} == {(1, "c"), (2, "x")}


def test_all_fields_are_overwritten_stamped_and_counted(spark):
    state = spark.createDataFrame([("a", "old", 1, True, T, T, None), ("b", "old", 1, True, T, T, 2), ("c", "old", 1, False, T, T, 2)], "url string, title string, price int, is_available boolean, last_seen_at timestamp, updated_at timestamp, missed int").withColumn("shop", F.lit(1))
    landed = spark.createDataFrame([("a", "new", 1), ("d", None, 2)], "url string, title string, price int").withColumn("shop", F.lit(1))
    now = datetime.datetime(2026, 2, 2)
    got = {r.url: (r.title, r.updated_at, r.missed, r.outcome) for r in merged(state, landed, ["shop", "url"], ["shop"], F.lit(now), ("title",), "updated_at", "missed").collect()}
    assert got == {"a": ("new", now, 0, "updated"), "b": ("old", now, 3, "deactivated"), "c": ("old", T, 2, "kept"), "d": (None, now, 0, "inserted")}


def test_removals(spark):
    products = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 2, None)], "id int, source_id int, category_id int")
    history, members = spark.createDataFrame([(1, 9), (2, 8), (2, 7)], "product_id int, price int"), spark.createDataFrame([(50, 1, 1), (50, 2, 2)], "match_id int, source_id int, product_id int")
    kept = without_shops(spark.createDataFrame([(2,), (2,), (None,)], "source_id int"), products, history, members)
    assert [sorted(r[0] for r in k.select("id" if "id" in k.columns else "product_id").collect()) for k in kept] == [[1], [1], [1]]
    assert {(r.id, r.category_id) for r in without_categories(spark.createDataFrame([(5,)], "category_id int"), products).collect()} == {(1, None), (2, None), (3, None)}


def test_backfill(spark):
    now = spark.createDataFrame([("a", None), ("b", "own"), (None, None), ("c", None)], "title string, image string")
    old = spark.createDataFrame([("a", "first", 1), ("a", "second", 2), ("a", None, 3), ("b", "x", 1)], "title string, image string, n int")
    assert {(r.title, r.image) for r in backfilled(now, old, "title", "image", "n").collect()} == {("a", "second"), ("b", "own"), (None, None), ("c", None)}


def test_landing_files(spark, tmp_path):
    (tmp_path / "gin_shop.json").write_text(json.dumps([{"title": "A", "price": "1,00 €", "size": None}, {"title": "B", "price": "2"}]))
    (tmp_path / "rum_shop.json").write_text("[{broken")
    good, damaged = read_landing(spark, str(tmp_path))
    assert {(r.title, r.price, r.size) for r in good.collect()} == {("A", "1,00 €", None), ("B", "2", None)}
    assert damaged.count() == 1
    assert {r.s for r in good.select(file_slug(F.col("file"), F.lit("shop")).alias("s")).collect()} == {"gin"}
    write_landing(good.select("title", "price", F.lit("shop").alias("source"), F.lit("a,b").alias("file_slug")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_curated_groups_and_exports(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"groups": [{"id": 1, "matched_name": "m", "category": "gin", "classification": "x", "entries": [{"source": "s", "original_title": "t"}, {"source": "s2", "original_title": None}]}]}))
    assert [(r.group_id, r.position, r.source) for r in read_groups(spark, str(tmp_path / "g.json")).orderBy("position").collect()] == [(1, 0, "s"), (1, 1, "s2")]
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    assert [r.row for r in export_json(df).collect()] == ['{"id":1,"v":null}', '{"id":2,"v":"x"}']
    export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    dump({"t": df}, str(tmp_path / "dump"))
    assert restore(spark, str(tmp_path / "dump"), ["t"])["t"].count() == 2


def test_pages(spark):
    html = '<div class="item"><h2><a href="/x">A &amp; B</a></h2><span class="price">1 &lt; 2</span><img src="data:x" data-lazy="http://i"/></div><div class="item"><h2>no price</h2></div>'
    cards = '<li class="card new"><a class="name" href="http://y"><b class="q">Gin</b> X</a><b>3,00</b><img src="http://j"/></li>'
    rows = page_listings(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).collect()
    assert [(r.page_id, r.title, r.price, r.link, r.image) for r in rows] == [(1, "A & B", "1 < 2", "/x", "http://i")]
    rows = page_listings(spark.createDataFrame([(1, cards)], "page_id int, html string"), CARDS).collect()
    assert [(r.title, r.link, r.image) for r in rows] == [("Gin X", "http://y", "http://j")]


def test_stream_keeps_the_last_state_of_every_listing(spark, tmp_path):
    schema = "url string, price double, seen int"
    source, target = tmp_path / "in", tmp_path / "state"
    for n, rows in enumerate([[("a", 1.0, 1), ("b", 2.0, 1)], [("a", 3.0, 2), ("a", 2.5, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = merge_stream(spark.readStream.schema(schema).parquet(str(source)), str(target), ["url"], "seen", str(tmp_path / "progress"))
        query.awaitTermination(120)
    from stillroom.streaming.merge import current_state

    assert {(r.url, r.price) for r in current_state(spark, str(target)).collect()} == {("a", 3.0), ("b", 2.0)}


def test_every_delivery_is_merged(spark, tmp_path):
    from stillroom.plans.catalogue import deactivated, history_delta, snapshot_merge

    rows = [(n, i, 1, p) for n, held in {1: {1: 5, 2: 5}, 2: {1: 5, 2: 5}, 3: {1: 6}, 4: {1: 6, 2: 5}, 5: {1: 6, 3: 1}}.items() for i, p in held.items()]
    frame = spark.createDataFrame(rows, "snapshot_no int, product_id int, source_id int, price int").selectExpr("snapshot_no", "timestamp_seconds(snapshot_no * 100) as snapshot_at", "product_id", "source_id", "cast(price as decimal(10,2)) as price", "true as is_available", "timestamp_seconds(snapshot_no * 100 - 1) as last_seen_at")
    frame.write.parquet(str(tmp_path / "product_snapshots.parquet"))
    d = str(tmp_path)
    assert {(r.snapshot_no, r.product_id) for r in deactivated(spark, d).collect()} == {(3, 2), (5, 2)}
    assert {(r.snapshot_no, r.product_id, int(r.price), r.was_available) for r in history_delta(spark, d).collect()} == {(3, 1, 6, True), (3, 2, 5, False), (4, 2, 5, True), (5, 2, 5, False)}
    merges = {(r.snapshot_no, r.product_id): (r.outcome, r.last_seen_at.timestamp()) for r in snapshot_merge(spark, d).collect()}
    assert len(merges) == 9 and merges[5, 3] == ("inserted", 500) and merges[5, 2] == ("deactivated", 400)


def test_every_listing_may_give_and_take_an_image(spark, tmp_path):
    from stillroom.plans.catalogue import image_backfill

    spark.createDataFrame([(1, "a", None), (2, "b", "y"), (3, "a", "x"), (4, "b", None), (5, "c", None), (6, None, None)], "id int, title string, image_url string").write.parquet(str(tmp_path / "products.parquet"))
    assert {(r.id, r.image_url) for r in image_backfill(spark, str(tmp_path)).collect()} == {(1, "x"), (2, "y"), (3, "x"), (4, "y"), (5, None), (6, None)}


def test_character_references(spark):
    from stillroom.sources.landing import text_of

    cases = {"a &amp;lt; b": "a &lt; b", "caf&eacute; &#8211; &#x20AC;5 &nbsp;": "café – €5", "&unknown; & co": "&unknown; & co", "&#0;&#55555;": "&#0;&#55555;", "<b> </b>": None, "": None, "&": "&"}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text_of(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [*cases.values()]
