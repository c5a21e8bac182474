"""Landing files: JSON arrays of listings by shop and slug, listing pages in HTML, exports."""

from __future__ import annotations

import html.entities
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A landed listing; absent keys are null.
LISTING = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "price", "size", "link", "image")])


def write_landing(listings: DataFrame, path: str) -> None:
    """Listings (source, file_slug and the fields) as JSON, one folder for each shop and slug."""
    listings.write.mode("overwrite").partitionBy("source", "file_slug").json(path)


def read_landing(spark: SparkSession, *paths: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(listings, damaged): the objects of JSON files with their file, arrays, or with ``lines`` an object a line as ``write_landing`` writes them; what can't be read is
    set aside, never fatal.

    Reads whole files with one schema and no inference; a file that isn't a list of objects gives damaged rows only.
    """
    schema = T.StructType([*LISTING.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(list(paths)).select("*", F.col("_metadata.file_path").alias("file"))
    empty = F.coalesce("title", "price", "size", "link", "image").isNull()
    return rows.where(F.col("_corrupt_record").isNull() & ~empty).drop("_corrupt_record"), rows.where(F.col("_corrupt_record").isNotNull() | empty).select("file", "_corrupt_record")


def read_groups(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(group_id, matched_name, category, classification, position, source, original_title) of curated files with nested entries: one object a file, or with ``lines`` one a line."""
    entry = "array<struct<source: string, original_title: string>>"
    groups = spark.read.schema(f"groups array<struct<id: int, matched_name: string, category: string, classification: string, entries: {entry}>>").option("multiLine", not lines).json(path)
    flat = groups.select(F.inline("groups")).withColumnRenamed("id", "group_id")
    return flat.select("group_id", "matched_name", "category", "classification", F.posexplode("entries").alias("position", "e")).select("group_id", "matched_name", "category", "classification", "position", "e.source", "e.original_title")


def file_slug(path: Column, source: Column) -> Column:
    """The slug of a landing file name: the part before _<shop>.json, else the name without .json."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.concat(F.lit("_"), source, F.lit(".json"))
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - F.length(suffix))).otherwise(F.regexp_replace(name, r"\.json$", ""))


@dataclass(frozen=True)
class Layout:
    """How a shop's pages show a listing: patterns with one group each. ``item`` cuts a page into listings; a field takes the first pattern that matches."""

    item: str
    title: tuple[str, ...]
    price: tuple[str, ...]
    link: tuple[str, ...] = (r'<a[^>]*\shref="([^"]*)"',)
    image: tuple[str, ...] = (r'<img[^>]*\ssrc="(http[^"]*)"', r'<img[^>]*\sdata-[a-z]+="([^"]*)"')
    size: tuple[str, ...] = ()


PLAIN = Layout(r'(?s)<div class="item">(.*?)</div>', (r"(?s)<h2[^>]*>(?:\s*<a[^>]*>)?(.*?)<",), (r'(?s)<span class="price-new">(.*?)</span>', r'(?s)<span class="price">(.*?)</span>'), size=(r'(?s)<span class="size">(.*?)</span>',))
CARDS = Layout(r"(?s)<li class=\"card[^\"]*\">(.*?)</li>", (r'(?s)<a[^>]*class="name"[^>]*>(.*?)</a>',), (r"(?s)<ins>(.*?)</ins>", r"(?s)<b>(.*?)</b>"))


def opening(part: str) -> str:
    """A pattern for the opening tag of tag.class.class, up to its end; the classes may stand in any order among others."""
    tag, *classes = part.split(".")
    return rf"<{tag}\b" + "".join(rf"""(?=[^>]*\sclass="[^"]*(?<![\w-]){re.escape(c)}(?![\w-]))""" for c in classes) + "[^>]*>"


def inner(selector: str) -> str:
    """A pattern whose group is what stands in the first element that a chain of tag.class parts names."""
    parts = selector.split()
    return "(?s)" + ".*?".join(map(opening, parts)) + f"(.*?)</{parts[-1].split('.')[0]}>"


def by_selectors(item: str, title: str, price: tuple[str, ...], size: tuple[str, ...] = (), image: str = "img") -> Layout:
    """A layout by selectors: an item goes from its opening tag to the next one's."""
    source = lambda name, start="": "(?s)" + ".*?".join(map(opening, image.split()[:-1])) + (".*?" if " " in image else "") + opening(image.split()[-1])[:-5] + rf"""[^>]*\s{name}="({start}[^"]*)\""""
    return Layout(rf"(?s){opening(item)}(.*?)(?={opening(item)}|\z)", (inner(title),), tuple(map(inner, price)), size=tuple(map(inner, size)), image=(source("src", "http"), source("data-[a-z]+"), source("src")))


# How the pages of shops 1 to 5 name their parts.
LAYOUTS = {
    1: by_selectors("li.sc-5ce8ced0-0.bcCFxH", "h3.sc-5ce8ced0-6.efPlgI", ("span.sc-7fb65671-2.icPbuR",), ("span.sc-5ce8ced0-9.QXiqi",)),
    2: by_selectors("div.c-product-card.js-animated-element", "h6", ("span.woocommerce-Price-amount.amount",), image="div.c-product-card__image-wrapper img"),
    3: by_selectors("div.oe_product.g-col-6.g-col-md-4.g-col-lg-3", "a.text-decoration-none", ("span.oe_currency_value",), ("span.o_ribbons.o_not_editable.o_wsale_ribbon.o_right",), "span.oe_product_image_img_wrapper_primary img"),
    4: by_selectors("div.product-item", "h2.product-title a", ("span.price.actual-price",), image="img.picture-img"),
    5: by_selectors("div.item.single-product", "span.product-name", ("span.price-new", "div.price span"), ("div.custom-fields-field-1",), "div.image img"),
}


def unescaped(text: Column) -> Column:
    """Character references undone once, named ones of HTML 4 and numbers; others stay as they are."""
    named = F.create_map(*[F.lit(x) for name, code in html.entities.name2codepoint.items() for x in (name, chr(code))])

    def one(piece: Column) -> Column:
        name, number, hexa = (F.regexp_extract(piece, p, 1) for p in (r"^([A-Za-z][A-Za-z0-9]*);", r"^#(\d{1,7});", r"^#[xX]([0-9a-fA-F]{1,6});"))
        code = F.coalesce(F.nullif(number, F.lit("")).cast("bigint"), F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("bigint"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        sign = F.coalesce(F.try_element_at(named, name), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.when(sign.isNotNull(), F.concat(sign, F.substring(piece, F.instr(piece, ";") + 1, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.when(text.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""))).otherwise(text)


def text_of(markup: Column) -> Column:
    """The text of a piece of markup: tags dropped, character references undone, blanks trimmed; null if nothing is left."""
    trimmed = F.regexp_replace(unescaped(F.regexp_replace(markup, r"<[^>]*>", "")), r"(?U)^\s+|\s+$", "")
    return F.nullif(trimmed, F.lit(""))


def page_listings(pages: DataFrame, layout: Layout = PLAIN) -> DataFrame:
    """(page_id, position, title, price, size, link, image) of the listings of pages (page_id, html); those without a title or a price are left out.

    Patterns in the scan's projection, no Python; a null or empty page has no listings.
    """
    def first(patterns: tuple[str, ...]) -> Column:
        return F.coalesce(*[text_of(F.nullif(F.regexp_extract("item", p, 1), F.lit(""))) for p in patterns]) if patterns else F.lit(None).cast("string")

    items = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(layout.item), 1)).alias("position", "item"))
    fields = {"title": layout.title, "price": layout.price, "size": layout.size, "link": layout.link, "image": layout.image}
    return items.select("page_id", "position", *[first(p).alias(c) for c, p in fields.items()]).where("title is not null and price is not null")


def export_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row, nulls written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet under one folder; ``restore`` reads it back."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
