"""Feed payloads to parsed listings.

Payloads are landed rows ``(source_slug, page, payload)``; ``sources`` is the source dimension
``(source_slug, website, city, province, shipping_summary, furniture_only)``. Every feed has an
explicit schema; malformed JSON reads as null and yields no rows. One payload is one page, so the
explode stays inside the task that read it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions import enrich as E
from vitrine.functions.text import (
    additional_images,
    clean_text,
    cleaned,
    described_key,
    distinct_urls,
    dollars,
    first_match,
    fold_all,
    html_texts,
    java,
    keys_of,
    let,
    lookup_key,
    non_zero,
    normalize_lookup,
    null_if_empty,
    parse_price,
    price_text,
    primary_image,
    quote_plus,
    resolve_url,
    rewrite_query_param,
    slug_to_title,
    squashed,
    text_or_empty,
    texts_of,
)
from vitrine.operators.skew import latest, top_per_key
from vitrine.session import broadcast_if_small
from vitrine.sources.html import read_pages

COLLECTION = (
    "struct<products:array<struct<title:string,handle:string,body_html:string,"
    "variants:array<struct<price:string,available:boolean>>,images:array<struct<src:string>>>>>"
)
STORE = (
    "struct<items:array<struct<title:string,id:string,fullUrl:string,excerpt:string,body:string,"
    "assetUrl:string,items:array<struct<assetUrl:string,url:string>>,"
    "variants:array<struct<unlimited:boolean,qtyInStock:int,priceMoney:struct<value:string>,"
    "price:double>>>>>"
)
GALLERY = (
    "struct<structure:struct<components:map<string,struct<componentType:string>>>,"
    "props:struct<render:struct<compProps:map<string,struct<images:array<struct<id:string,"
    "uri:string,title:string,description:string>>>>>>>"
)
STOREFRONT = (
    "struct<data:array<struct<name:string,site_product_id:string,id:string,"
    "short_description:string,absolute_site_link:string,"
    "images:struct<data:array<struct<absolute_urls:map<string,string>,absolute_url:string,"
    "url:string>>>,thumbnail:struct<data:struct<absolute_url:string,url:string>>,"
    "price:struct<low:double,low_subunits:double>,badges:struct<out_of_stock:boolean>,"
    "inventory:struct<all_variations_sold_out:boolean,"
    "marked_sold_out_at_all_existing_locations:boolean>>>>"
)
GALLERY_PAGES = (
    "array<struct<title:string,id:string,purl:string,content:string,"
    "thumbnail:struct<hash:string,name:string>,media:array<struct<hash:string,name:string>>>>"
)
EMBEDDED = (
    "array<struct<urlPart:string,name:string,media:array<struct<fullUrl:string>>,price:double,"
    "isInStock:boolean,formattedPrice:string,currency:string>>"
)
# image and offers may be one value or a list; they are read as the JSON text that stands there
PRODUCT_LD = "struct<`@type`:string,name:string,description:string,image:string,offers:string>"
PRODUCT_OFFER = "struct<price:string,availability:string,priceCurrency:string>"
SOURCE_COLUMNS = ("website", "city", "province", "shipping_summary", "furniture_only")


def _rows(payloads: DataFrame, sources: DataFrame, items: Column) -> DataFrame:
    """One row per feed item with its position and its source's columns.

    The source dimension is joined to the pages, before they are exploded.
    """
    return (
        _with_source(payloads.select("source_slug", "page", "payload"), sources)
        .select(
            "source_slug", "page", *SOURCE_COLUMNS, F.posexplode(items).alias("pos", "item")
        )
        .filter(F.col("item").isNotNull())
    )


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    dim = sources.select("source_slug", *SOURCE_COLUMNS)
    return rows.join(broadcast_if_small(dim), "source_slug")


def _finish(
    df: DataFrame, kind: str, scope: Column | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Common columns of a parsed listing, in one order."""
    return df.select(
        "source_slug", "page", "pos", "source_listing_url", "source_listing_key", "title",
        "price_raw", "price_value",
        F.coalesce(F.col("currency"), F.lit(V.DEFAULT_CURRENCY)).alias("currency")
        if "currency" in df.columns
        else F.lit(V.DEFAULT_CURRENCY).alias("currency"),
        primary_image(F.col("images")).alias("primary_image_url"),
        additional_images(F.col("images")).alias("additional_image_urls"),
        "availability_status",
        (scope if scope is not None else E.shipping_scope(F.col("shipping_summary"))).alias(
            "shipping_scope"
        ),
        F.lit(1).alias("ships_to_montreal"),
        F.col("shipping_summary").alias("shipping_note"),
        "category", "designer", "maker", "era", "materials", "dimensions_text", "condition_text",
        F.concat_ws(", ", "city", "province").alias("location_text"),
        "source_description",
        F.lit(V.LIVE_TYPE).alias("ingest_source_type"),
        F.lit(V.FEED_CONFIDENCE[kind]).alias("parse_confidence"),
        *extra,
    )


def _price_or_contact(value: Column) -> Column:
    return F.when(value.isNotNull(), dollars(value)).otherwise(V.PRICE_CONTACT)


def _described(df: DataFrame, markup: Column) -> DataFrame:
    """Adds ``lines`` and ``folded`` (visible text by line), ``source_description`` and the lookup
    keys of title, description and both."""
    read = df.withColumn("_html", html_texts(text_or_empty(markup))).withColumn(
        "_title_key", lookup_key(F.col("title"))
    )
    return read.withColumns(
        {
            "lines": F.col("_html.lines"),
            "folded": F.col("_html.folded"),
            "source_description": F.col("_html.text"),
            "_text_key": F.col("_html.key"),
        }
    ).withColumn("_lookup", F.trim(F.concat_ws(" ", "_title_key", "_text_key")))


def _enriched(df: DataFrame, with_sections: bool = False) -> DataFrame:
    if with_sections:
        return E.enrich_listings(df, "title", "source_description", "lines", "folded")
    return E.enrich_listings(df, "title", "source_description")


def collection_feed(
    payloads: DataFrame, sources: DataFrame, include_sold_out: bool = True
) -> DataFrame:
    """Collection products: first priced variant, available if any variant is; gift cards, current
    production and, for ``furniture_only`` sources, other goods are skipped."""
    rows = _rows(payloads, sources, F.from_json("payload", COLLECTION)["products"])
    parsed = _described(
        rows.withColumn("title", clean_text(F.col("item.title"))), F.col("item.body_html")
    )
    kept = parsed.filter(
        ~E.is_gift_card(F.col("_title_key"))
        & ~E.is_current_production(F.col("_text_key"))
        & (~F.col("furniture_only") | E.is_furniture(F.col("_lookup")))
    )
    variants = F.coalesce(F.col("item.variants"), F.array().cast(
        "array<struct<price:string,available:boolean>>"
    ))
    priced = F.filter(variants, lambda v: text_or_empty(v["price"]) != "")
    value = non_zero(parse_price(F.get(priced, F.lit(0))["price"]))
    url = resolve_url(
        F.col("website"), F.concat(F.lit("/products/"), clean_text(F.col("item.handle")))
    )
    shaped = kept.withColumns(
        {
            "source_listing_url": url,
            "source_listing_key": url,
            "price_value": value,
            "images": F.filter(
                F.transform(F.coalesce("item.images", F.array().cast("array<struct<src:string>>")),
                            lambda i: i["src"]),
                lambda u: text_or_empty(u) != "",
            ),
            "availability_status": F.when(
                F.exists(variants, lambda v: F.coalesce(v["available"], F.lit(False))),
                "available",
            ).otherwise("sold_out"),
        }
    ).withColumn("price_raw", _price_or_contact(F.col("price_value")))
    if not include_sold_out:
        shaped = shaped.filter(F.col("availability_status") != "sold_out")
    return _finish(_enriched(shaped, with_sections=True), "collection")


def store_feed(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Store items with title, id, address, image and stock; furniture only. The first variant in
    stock with a price gives it, as money value or else in cents."""
    rows = _rows(payloads, sources, F.from_json("payload", STORE)["items"])
    parsed = rows.withColumns(
        {
            "title": clean_text(F.col("item.title")),
            "_id": clean_text(F.col("item.id")),
            "_address": clean_text(F.col("item.fullUrl")),
            "_stocked": F.filter(
                "item.variants",
                lambda v: F.coalesce(v["unlimited"], F.lit(False))
                | (F.coalesce(v["qtyInStock"], F.lit(0)) > 0),
            ),
            "images": distinct_urls(
                F.array_append(
                    F.transform(
                        F.coalesce(
                            "item.items", F.array().cast("array<struct<assetUrl:string,url:string>>")
                        ),
                        lambda i: F.coalesce(null_if_empty(i["assetUrl"]), i["url"]),
                    ),
                    F.col("item.assetUrl"),
                )
            ),
        }
    ).filter(
        (F.col("title") != "") & (F.col("_id") != "") & (F.col("_address") != "")
        & (F.size("_stocked") > 0) & (F.size("images") > 0)
    )

    def variant_price(variant: Column) -> Column:
        money = parse_price(variant["priceMoney"]["value"])
        return F.when(money > 0, money).when(variant["price"] > 0, variant["price"] / 100)

    prices = F.filter(F.transform("_stocked", variant_price), lambda p: p.isNotNull())
    described = _described(
        parsed, F.coalesce(null_if_empty(F.col("item.excerpt")), F.col("item.body"))
    )
    shaped = (
        described.filter(E.is_furniture(F.col("_lookup")))
        .withColumns(
            {
                "source_listing_url": resolve_url(F.col("website"), F.col("_address")),
                "source_listing_key": F.concat_ws(":", "source_slug", "_id"),
                "price_value": F.get(prices, F.lit(0)),
                "availability_status": F.lit("available"),
            }
        )
        .withColumn("price_raw", _price_or_contact(F.col("price_value")))
    )
    return _finish(_enriched(shaped), "store")


PRICE_LINE = re.compile(V.PRICE_LINE_PATTERN)
TITLE_STOP = re.compile(V.TITLE_STOP_PATTERN)
GALLERY_TEXTS = ("text", "key", "title", "price_line")


def read_gallery_text(raw: str, folded: str) -> tuple[str, str, str, str]:
    """``GALLERY_TEXTS`` of a description with plain line feeds and its folded form.

    The title is up to two lines before a price, a measure or (from the second) a sold mark; the price line is
    ``price_line``'s, the last with a price or a sold mark.
    """
    titles: list[str] = []
    done, price = False, ""
    for text, fold in zip(raw.split("\n"), folded.split("\n"), strict=True):
        whole = cleaned(text)
        if not whole:
            continue
        key, line = squashed(fold), whole.strip(" -")
        sold = V.SOLD_MARKER in key
        if sold or PRICE_LINE.search(whole):
            price = whole
        done = done or bool(
            PRICE_LINE.search(line) or (sold and titles) or TITLE_STOP.search(key) or len(titles) >= 2
        )
        if not done:
            titles.append(line)
    return cleaned(raw), squashed(folded), " ".join(titles), price


@F.arrow_udf(texts_of(GALLERY_TEXTS))
def gallery_texts(raw: pa.Array) -> pa.Array:
    """Of texts without nulls."""
    rows = [read_gallery_text(*x) for x in zip(raw.to_pylist(), fold_all(raw).to_pylist(), strict=True)]
    columns = zip(*rows, strict=True) if rows else ([] for _ in GALLERY_TEXTS)
    return pa.StructArray.from_arrays(
        [pa.array(list(column), pa.string()) for column in columns], list(GALLERY_TEXTS)
    )


def gallery_feed(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Images of the first gallery component that has any; ``payload`` rows carry ``entry_url``.

    Titles and prices are read from the description lines; announcements are skipped.
    """
    root = F.from_json("payload", GALLERY)

    def images_of(bound: Column) -> Column:
        galleries = F.filter(
            F.map_entries(bound["structure"]["components"]),
            lambda c: c["value"]["componentType"] == V.GALLERY_COMPONENT,
        )
        found = F.transform(
            galleries,
            lambda c: F.try_element_at(bound["props"]["render"]["compProps"], c["key"])["images"],
        )
        return F.get(F.filter(found, lambda x: F.coalesce(F.size(x), F.lit(0)) > 0), F.lit(0))

    entries = payloads.select("source_slug", "page", "entry_url", "payload")
    rows = (
        _with_source(entries, sources)
        .select(
            "source_slug", "page", "entry_url", *SOURCE_COLUMNS,
            F.posexplode(let(root, images_of)).alias("pos", "item"),
        )
        .filter(F.col("item").isNotNull())
    )
    raw = F.regexp_replace(text_or_empty(F.col("item.description")), "\r", "\n")
    staged = (
        rows.withColumn("_raw", raw)
        .withColumn("_read", gallery_texts(F.col("_raw")))
        .withColumns(
            {
                "source_description": F.col("_read.text"),
                "_id": clean_text(F.col("item.id")),
                "_item_title": clean_text(F.col("item.title")),
                "_price_line": F.col("_read.price_line"),
            }
        )
        .withColumn(
            "title",
            F.coalesce(
                null_if_empty(F.col("_read.title")),
                null_if_empty(F.col("_item_title")),
                slug_to_title(F.col("item.id")),
            ),
        )
        .filter(
            (F.col("source_description") != "") & (F.col("title") != "") & (F.col("_id") != "")
        )
        .withColumns(
            {
                "_title_key": lookup_key(F.col("title")),
                "_item_key": lookup_key(F.col("_item_title")),
                "_text_key": F.col("_read.key"),
            }
        )
        .withColumn("_lookup", F.trim(F.concat_ws(" ", "_title_key", "_text_key")))
        .filter(
            ~F.col("_title_key").startswith("dataitem")
            & ~F.col("_title_key").startswith("contactez nous")
            & ~E.is_promotional(F.col("_lookup"))
        )
    )
    image = F.when(
        clean_text(F.col("item.uri")) != "",
        F.concat(F.lit(V.GALLERY_MEDIA_URL), clean_text(F.col("item.uri"))),
    ).otherwise("")
    sold_text = F.concat_ws(" ", "_item_key", "_lookup")
    shaped = staged.withColumns(
        {
            "images": F.filter(F.array(image), lambda u: u != ""),
            "availability_status": E.marked_sold(sold_text),
            "price_value": parse_price(
                first_match(F.col("_price_line"), java(V.PRICE_FRENCH_PATTERN), 1)
            ),
            "source_listing_url": rewrite_query_param(F.col("entry_url"), "lightbox", F.col("_id")),
        }
    ).withColumns(
        {
            "source_listing_key": described_key(
                F.col("source_slug"), F.col("title"), F.col("_text_key"),
                primary_image(F.col("images")),
            ),
            "price_raw": F.coalesce(
                null_if_empty(F.col("_price_line")),
                F.when(F.col("availability_status") == "sold_out", V.PRICE_SOLD_FRENCH).otherwise(
                    V.PRICE_CONTACT_FRENCH
                ),
            ),
        }
    )
    enriched = _enriched(shaped).withColumn(
        "condition_text", F.when(F.col("_text_key").contains("restaur"), "Restored").otherwise("")
    )
    return _finish(enriched, "gallery", F.lit("local_quote"))


def storefront_feed(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Storefront products with title, id and image; furniture only. Sold out by any of three flags
    or by a marker in the text."""
    rows = _rows(payloads, sources, F.from_json("payload", STOREFRONT)["data"])
    urls = F.transform(
        F.coalesce(
            "item.images.data",
            F.array().cast(
                "array<struct<absolute_urls:map<string,string>,absolute_url:string,url:string>>"
            ),
        ),
        lambda i: F.coalesce(
            null_if_empty(F.try_element_at(i["absolute_urls"], F.lit("1280"))),
            null_if_empty(F.try_element_at(i["absolute_urls"], F.lit("2560"))),
            null_if_empty(i["absolute_url"]),
            i["url"],
        ),
    )
    thumbnail = F.coalesce(
        null_if_empty(F.col("item.thumbnail.data.absolute_url")),
        F.col("item.thumbnail.data.url"),
        F.lit(""),
    )
    # a thumbnail that is not among the images goes first
    images = let(
        F.struct(distinct_urls(urls).alias("urls"), thumbnail.alias("thumbnail")),
        lambda b: F.when(
            (b["thumbnail"] == "") | F.array_contains(b["urls"], b["thumbnail"]), b["urls"]
        ).otherwise(F.array_prepend(b["urls"], b["thumbnail"])),
    )
    parsed = rows.withColumns(
        {
            "title": clean_text(F.col("item.name")),
            "_id": clean_text(
                F.coalesce(null_if_empty(F.col("item.site_product_id")), F.col("item.id"))
            ),
            "images": images,
        }
    ).filter((F.col("title") != "") & (F.col("_id") != "") & (F.size("images") > 0))
    described = _described(parsed, F.col("item.short_description"))
    staged = described.filter(E.is_furniture(F.col("_lookup")))

    def flag(path: str) -> Column:
        return F.coalesce(F.col(path), F.lit(False))

    sold = (
        flag("item.badges.out_of_stock")
        | flag("item.inventory.all_variations_sold_out")
        | flag("item.inventory.marked_sold_out_at_all_existing_locations")
        | E.is_sold_out_page(F.col("_lookup"))
    )
    shaped = staged.withColumns(
        {
            "source_listing_url": F.coalesce(
                null_if_empty(F.col("item.absolute_site_link")), F.col("website")
            ),
            "source_listing_key": F.concat_ws(":", "source_slug", "_id"),
            "price_value": F.coalesce(
                F.col("item.price.low"), F.col("item.price.low_subunits") / 100
            ),
            "availability_status": F.when(sold, "sold_out").otherwise("available"),
        }
    ).withColumn("price_raw", _price_or_contact(F.col("price_value")))
    return _finish(_enriched(shaped), "storefront")


def gallery_pages_feed(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Gallery pages whose title ends in a price; image addresses are built from hash and name."""
    rows = _rows(payloads, sources, F.from_json("payload", GALLERY_PAGES))
    media = F.concat(
        F.array("item.thumbnail"),
        F.coalesce("item.media", F.array().cast("array<struct<hash:string,name:string>>")),
    )

    def media_url(entry: Column) -> Column:
        name = clean_text(entry["name"])
        quoted = F.replace(
            F.replace(quote_plus(name), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")
        )
        return F.when(
            clean_text(entry["hash"]) != "",
            F.concat(
                F.lit(V.GALLERY_PAGES_MEDIA_URL), clean_text(entry["hash"]), F.lit("/"),
                F.when(name != "", quoted).otherwise("image"),
            ),
        )

    title = clean_text(F.col("item.title"))
    price = java(V.PRICE_TITLE_PATTERN)
    parsed = rows.withColumns(
        {
            "_title": title,
            "_id": clean_text(F.col("item.id")),
            "_purl": clean_text(F.col("item.purl")),
            "images": distinct_urls(F.transform(media, media_url)),
        }
    ).filter((F.col("_title") != "") & (F.col("_id") != "") & (F.col("_purl") != ""))
    titled = parsed.withColumn(
        "title", clean_text(F.regexp_replace("_title", java(V.PRICE_TITLE_SUFFIX_PATTERN), ""))
    )
    shaped = _described(titled, F.col("item.content")).withColumns(
        {
            "price_value": parse_price(first_match(F.col("_title"), price, 1)),
            "price_raw": F.coalesce(
                null_if_empty(first_match(F.col("_title"), price, 0)), F.lit(V.PRICE_CONTACT)
            ),
            "source_listing_url": resolve_url(F.col("website"), F.col("_purl")),
            "source_listing_key": F.concat_ws(":", "source_slug", "_id"),
            "availability_status": F.lit("available"),
        }
    )
    return _finish(_enriched(shaped), "gallery_pages")


def embedded_products(pages: DataFrame) -> DataFrame:
    """JSON product lists inside HTML pages, one row per product; bad JSON gives none."""
    raw = F.regexp_extract("html", V.EMBEDDED_PRODUCTS_PATTERN, 1)
    items = F.from_json(raw, EMBEDDED)
    return pages.select(
        *[c for c in pages.columns if c != "html"], F.posexplode(items).alias("pos", "item")
    ).filter(F.col("item").isNotNull())


def embedded_state(pages: DataFrame, schema: str) -> DataFrame:
    """The preloaded state object inside HTML pages, read with ``schema``; null when absent."""
    raw = F.rtrim(F.trim(F.regexp_extract("html", V.EMBEDDED_STATE_PATTERN, 1)), F.lit(";"))
    return pages.select(
        *[c for c in pages.columns if c != "html"], F.from_json(raw, schema).alias("state")
    )


def embedded_feed(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Listings from embedded product lists ``(source_slug, page, html)``."""
    rows = embedded_products(_with_source(pages, sources))
    in_stock = F.coalesce("item.isInStock", F.lit(False))
    title = clean_text(F.col("item.name"))
    shaped = rows.withColumn("title", title).filter(
        (text_or_empty(F.col("item.urlPart")) != "") & (F.col("title") != "")
    ).withColumns(
        {
            "source_listing_url": resolve_url(
                F.col("website"), F.concat(F.lit("/product-page/"), F.col("item.urlPart"))
            ),
            "source_listing_key": F.concat_ws(":", "source_slug", F.col("item.urlPart")),
            "price_raw": F.when(
                in_stock,
                F.coalesce(
                    null_if_empty(clean_text(F.col("item.formattedPrice"))),
                    F.lit(V.PRICE_OUT_OF_STOCK_FRENCH),
                ),
            ).otherwise(V.PRICE_OUT_OF_STOCK_FRENCH),
            "price_value": F.when(F.col("item.price") > 0, F.col("item.price")),
            "currency": F.coalesce("item.currency", F.lit(V.DEFAULT_CURRENCY)),
            "images": F.filter(
                F.transform(
                    F.coalesce("item.media", F.array().cast("array<struct<fullUrl:string>>")),
                    lambda m: m["fullUrl"],
                ),
                lambda u: text_or_empty(u) != "",
            ),
            "availability_status": F.when(in_stock, "available").otherwise("sold_out"),
            "category": E.categorize(F.col("title"), F.lit("")),
            "materials": E.extract_materials(F.col("title")),
            "era": E.extract_era(F.col("title")),
            "source_description": F.col("title"),
            **{
                name: F.lit("")
                for name in ("designer", "maker", "dimensions_text", "condition_text")
            },
        }
    )
    return _finish(shaped, "embedded", F.lit("local_quote"))


def json_items(text: Column) -> Column:
    """The texts of a JSON list's items, or the text alone; none for bad JSON or null."""
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(
        text.isNotNull(), F.array(text)
    )
    return F.coalesce(items, F.array().cast("array<string>"))


def product_document(scripts: Column) -> Column:
    """The first product among a page's JSON-LD scripts, each one document or a list of them."""
    documents = F.flatten(F.transform(scripts, lambda s: json_items(F.trim(s))))
    read = F.transform(documents, lambda d: F.from_json(d, PRODUCT_LD))
    return F.get(F.filter(read, lambda d: d["@type"] == "Product"), F.lit(0))


def product_page_feed(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Product pages ``(source_slug, page, url, html)``: JSON-LD first, then the page itself."""
    read = (
        _with_source(
            read_pages(
                pages, ["source_slug", "page", "url"],
                ("heading", "description_text", "visible_text", "ld_scripts"),
            ),
            sources,
        )
        .withColumn("_ld", product_document(F.col("ld_scripts")))
        .withColumn(
            "_offer",
            F.from_json(F.get(json_items(F.col("_ld.offers")), F.lit(0)), PRODUCT_OFFER),
        )
    )
    described = read.withColumn(
        "lines",
        F.coalesce(
            null_if_empty(F.col("description_text")),
            clean_text(F.col("_ld.description")),
        ),
    ).withColumn(
        "source_description",
        clean_text(F.coalesce(null_if_empty(F.col("_ld.description")), F.col("lines"))),
    )
    kept = (
        described.withColumn("_text_key", lookup_key(F.col("source_description")))
        .filter(~E.is_current_production(F.col("_text_key")))
        .withColumn("_shown", price_text(F.col("visible_text")))
    )
    value = non_zero(parse_price(F.coalesce(null_if_empty(F.col("_offer.price")), F.col("_shown"))))
    shaped = kept.withColumns(
        {
            "title": F.coalesce(
                null_if_empty(F.col("_ld.name")),
                null_if_empty(clean_text(F.col("heading"))),
                slug_to_title(F.substring_index("url", "/", -1)),
            ),
            "price_value": value,
            "currency": F.coalesce("_offer.priceCurrency", F.lit(V.DEFAULT_CURRENCY)),
            "images": F.filter(
                json_items(F.col("_ld.image")), lambda u: u.isNotNull() & ~u.startswith("{")
            ),
            "availability_status": E.normalize_availability(
                F.col("_offer.availability"), F.col("visible_text")
            ),
            "source_listing_url": F.col("url"),
            "source_listing_key": F.lit(None).cast("string"),
            "pos": F.lit(0),
        }
    ).withColumn(
        "price_raw",
        F.coalesce(
            null_if_empty(F.col("_shown")), dollars(F.col("price_value")), F.lit("")
        ),
    )
    enriched = E.enrich_listings(shaped, "title", "source_description", "lines")
    return _finish(enriched, "product_page")


META_TEXTS = ("title", "text", "lookup", "page_key")


@F.arrow_udf(texts_of(META_TEXTS))
def meta_texts(titles: pa.Array, texts: pa.Array, pages: pa.Array) -> pa.Array:
    """Cleaned title and unescaped description, the lookup key of both, and that of the visible text with the
    description."""
    heads = ["" if x is None else cleaned(x) for x in titles.to_pylist()]
    said = ["" if x is None else cleaned(unescape(x)) for x in texts.to_pylist()]
    seen = ["" if x is None else x for x in pages.to_pylist()]
    lookups, page_keys = (
        keys_of(pa.array([f"{a} {b}" for a, b in zip(left, said, strict=True)], pa.string()))
        for left in (heads, seen)
    )
    return pa.StructArray.from_arrays(
        [pa.array(column, pa.string()) for column in (heads, said, lookups, page_keys)], list(META_TEXTS)
    )


def meta_page_feed(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Product pages that only say what they are in their meta tags; furniture with an image."""
    fields = (
        "og_title", "og_description", "og_image", "meta_description", "page_title", "visible_text"
    )
    read = _with_source(read_pages(pages, ["source_slug", "page", "url"], fields), sources)
    slug = F.get(F.reverse(F.split("url", "/")), F.lit(1))
    title = F.coalesce(
        null_if_empty(F.col("og_title")), null_if_empty(F.col("page_title")), slug_to_title(slug)
    )
    text = F.coalesce(null_if_empty(F.col("og_description")), F.col("meta_description"))
    described = (
        read.withColumns(
            {
                "_read": meta_texts(title, text, F.col("visible_text")),
                "images": F.filter(F.array(clean_text(F.col("og_image"))), lambda u: u != ""),
            }
        )
        .withColumns({"title": F.col("_read.title"), "source_description": F.col("_read.text")})
        .filter((F.col("title") != "") & (F.size("images") > 0))
    )
    staged = described.filter(E.is_furniture(F.col("_read.lookup")))
    shaped = staged.withColumns(
        {
            "price_raw": F.lit("Contactez-nous pour les details"),
            "price_value": F.lit(None).cast("double"),
            "availability_status": F.when(
                E.is_sold_out_page(F.col("_read.page_key")), "sold_out"
            ).otherwise("available"),
            "source_listing_url": F.col("url"),
            "source_listing_key": F.col("url"),
            "pos": F.lit(0),
        }
    )
    return _finish(_enriched(shaped), "meta_page")


# --- crawl-level rules --------------------------------------------------------------------------


def dedupe_last(listings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Within a crawl the last record of a key wins."""
    return latest(listings, keys, order)


def dedupe_identity(
    listings: DataFrame,
    source: str,
    key: str,
    order: list[str],
    priority: Column,
    keep: list[str] | None = None,
) -> DataFrame:
    """One record per item seen under several keys, and one per key.

    The identity is normalized title, image and normalized description; without one of them the
    record stands by its key. A record with an image is preferred, then the higher ``priority``
    (a category page over the news page), then the first by ``order``. Aggregates, so a group of
    copies costs each task one row. ``keep`` names the columns wanted (all by default): the others are
    read for the identity, which is sent as a digest, and are not sent themselves.
    """
    title, text = normalize_lookup(F.col("title")), normalize_lookup(F.col("source_description"))
    image = text_or_empty(F.col("primary_image_url"))
    columns = listings.columns if keep is None else list(dict.fromkeys([source, key, *keep]))
    staged = listings.withColumns({"_title": title, "_text": text, "_priority": priority})
    complete = (F.col("_title") != "") & (image != "") & (F.col("_text") != "")
    identity = F.when(
        complete, F.concat_ws("|", F.lit("i"), "_title", image, "_text")
    ).otherwise(F.concat_ws("|", F.lit("k"), F.col(key)))
    ranked = staged.withColumn("_identity", F.unhex(F.sha2(identity, 256))).withColumn(
        "_rank",
        F.struct(
            F.when(image != "", 0).otherwise(1).alias("image"),
            (-F.col("_priority")).alias("priority"),
            *order,
        ),
    )
    best = latest(
        ranked.select(*columns, "_identity", "_rank"), [source, "_identity"], ["_rank"], last=False
    )
    return latest(best.select(*columns, "_rank"), [source, key], ["_rank"], last=False).select(
        *columns
    )


def feed_cap(
    listings: DataFrame,
    source: str,
    order: list[str],
    limit: int | None = V.FEED_LIMIT,
    own_limits: DataFrame | None = None,
) -> DataFrame:
    """The first ``limit`` rows of every source's crawl; None keeps all.

    ``own_limits(source, limit)`` holds the sources with a limit of their own (null: none).
    """
    columns = [F.col(c) for c in order]
    if own_limits is None:
        return listings if limit is None else top_per_key(listings, [source], columns, limit)
    own = own_limits.select(source, F.col("limit").alias("_own"), F.lit(True).alias("_has"))
    ranked = listings.join(own, source, "left").withColumn(
        "_limit", F.when(F.col("_has"), F.col("_own")).otherwise(F.lit(limit).cast("long"))
    ).withColumn("_rn", F.row_number().over(Window.partitionBy(source).orderBy(*columns)))
    return ranked.filter("_limit is null or _rn <= _limit").select(*listings.columns)


def with_fallback(live: DataFrame, seed: DataFrame, crawls: DataFrame) -> DataFrame:
    """Live rows plus seed rows of the sources whose crawl failed.

    ``crawls(source_slug, error)``; seeds are marked and carry little confidence.
    """
    rows = seed.withColumns(
        {
            "parse_confidence": F.lit(V.FALLBACK_CONFIDENCE),
            "ingest_source_type": F.lit(V.FALLBACK_TYPE),
        }
    )
    failed = crawls.filter(text_or_empty(F.col("error")) != "").select("source_slug")
    # a source without a crawl row has not failed
    kept = live.join(failed, "source_slug", "left_anti")
    return kept.unionByName(rows.join(failed, "source_slug", "left_semi").select(*live.columns))


FEEDS: dict[str, Callable[..., DataFrame]] = {
    "collection": collection_feed,
    "store": store_feed,
    "gallery": gallery_feed,
    "storefront": storefront_feed,
    "gallery_pages": gallery_pages_feed,
    "embedded": embedded_feed,
    "product_page": product_page_feed,
    "meta_page": meta_page_feed,
}
