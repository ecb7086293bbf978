"""Registered feed queries. The payloads are made from the test tables and read back; the SQL
states the listings that must come out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import enrich as E
from vitrine.functions.text import clean_text, html_texts
from vitrine.plans.registry import query
from vitrine.sources import adapters as A
from vitrine.sources import feeds as S
from vitrine.sources import payloads as Y
from vitrine.sources.html import link_discovery, read_pages


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(field: str) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {_literal(t.get(field, ''))}" for i, t in enumerate(Y.TEMPLATES)
    )
    return f"replace(CASE t {arms} END, '{{n}}', n)"


PARTS = {
    "products": f"""SELECT *, CASE WHEN t = 4 THEN 'Gift card'
    ELSE p_name || ' ' || {_case('noun')} END AS title,
  {', '.join(f'{_case(f)} AS {f}' for f in (
      'text', 'category', 'era', 'materials', 'dimensions', 'condition', 'designer', 'maker',
      'section_materials', 'section_dimensions'))},
  'https://img.example.com/' || code AS img, t IN (0, 1, 2, 3, 5) AS furniture
FROM (SELECT DISTINCT l_suppkey AS shop_id, l_partkey AS part_id, l_partkey % 7 AS t,
    CAST(l_partkey % 90 + 10 AS VARCHAR) AS n, 'p' || l_partkey AS code,
    p_name, p_retailprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
}


def _parsed(
    kind_confidence: float,
    *,
    where: str = "true",
    url: str,
    key: str,
    price_raw: str,
    price_value: str,
    primary: str,
    additional: str,
    availability: str,
    title: str = "p.title",
    description: str = "p.text",
    category: str = "p.category",
    designer: str = "p.designer",
    maker: str = "p.maker",
    era: str = "p.era",
    materials: str = "p.materials",
    dimensions: str = "p.dimensions",
    condition: str = "p.condition",
    scope: str | None = None,
) -> str:
    scope = scope or (
        "CASE s.id % 5 WHEN 0 THEN 'worldwide_quote' WHEN 1 THEN 'international' "
        "WHEN 2 THEN 'canada_us' WHEN 3 THEN 'canada' ELSE 'local_quote' END"
    )
    return f"""SELECT s.slug AS source_slug, {url} AS source_listing_url, {key} AS source_listing_key,
  {title} AS title, {price_raw} AS price_raw, CAST({price_value} AS DOUBLE) AS price_value,
  'CAD' AS currency, {primary} AS primary_image_url, {additional} AS additional_image_urls,
  {availability} AS availability_status, {scope} AS shipping_scope, 1 AS ships_to_montreal,
  s.shipping_summary AS shipping_note, {category} AS category, {designer} AS designer,
  {maker} AS maker, {era} AS era, {materials} AS materials, {dimensions} AS dimensions_text,
  {condition} AS condition_text, s.city || ', ' || s.province AS location_text,
  {description} AS source_description, 'live_fetch' AS ingest_source_type,
  CAST({kind_confidence} AS DOUBLE) AS parse_confidence
FROM products p JOIN shops s ON s.id = p.shop_id WHERE {where}"""


def _flat(df: DataFrame) -> DataFrame:
    return df.drop("page", "pos").withColumn(
        "additional_image_urls", F.array_join("additional_image_urls", ",")
    )


def _money(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'Contact for price' ELSE format('${{:,.2f}} CAD', {value}) END"


_COLLECTION_PRICE = "CASE WHEN part_id % 10 <> 0 THEN price END"
_COLLECTION = _parsed(
    0.86,
    where="t NOT IN (4, 5) AND (s.id % 2 = 1 OR furniture)",
    url="s.website || '/products/' || code",
    key="s.website || '/products/' || code",
    price_raw=_money(f"({_COLLECTION_PRICE})"),
    price_value=_COLLECTION_PRICE,
    primary="img || '-a.jpg'",
    additional="img || '-b.jpg'",
    availability="CASE WHEN part_id % 4 <> 0 THEN 'available' ELSE 'sold_out' END",
    materials="coalesce(nullif(section_materials, ''), materials)",
    dimensions="coalesce(nullif(section_dimensions, ''), dimensions)",
)


@query("feed_collection_json", _COLLECTION, PARTS)
def feed_collection_json(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(
        S.collection_feed(Y.collection_payloads(spark, folder), Y.source_dimension(spark, folder))
    )


@query(
    "feed_collection_in_stock",
    f"SELECT source_slug, source_listing_key FROM ({_COLLECTION}) "
    "WHERE availability_status = 'available'",
    PARTS,
)
def feed_collection_in_stock(spark: SparkSession, folder: str) -> DataFrame:
    return S.collection_feed(
        Y.collection_payloads(spark, folder), Y.source_dimension(spark, folder),
        include_sold_out=False,
    ).select("source_slug", "source_listing_key")


_STORE_PRICE = "CASE part_id % 3 WHEN 0 THEN price WHEN 2 THEN price / 100 END"


@query(
    "feed_store_items_json",
    _parsed(
        0.82,
        where="part_id % 11 <> 0 AND part_id % 5 <> 0 AND furniture",
        url="s.website || '/shop/' || code",
        key="s.slug || ':' || code",
        price_raw=_money(f"({_STORE_PRICE})"),
        price_value=_STORE_PRICE,
        primary="img || '-1.jpg'",
        additional="img || '-2.jpg'",
        availability="'available'",
    ),
    PARTS,
)
def feed_store_items_json(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(S.store_feed(Y.store_payloads(spark, folder), Y.source_dimension(spark, folder)))


_GALLERY_TEXT = """('- ' || title || ' - 90 cm x 40 cm' || CASE part_id % 5 WHEN 0 THEN ' Véndu'
    WHEN 1 THEN '' ELSE ' ' || CAST(floor(price / 1000) AS BIGINT) || ' '
    || lpad(CAST(CAST(floor(price % 1000) AS BIGINT) AS VARCHAR), 3, '0') || ' $' END)"""


@query(
    "feed_gallery_json",
    _parsed(
        0.9,
        where="part_id % 13 <> 0",
        url="'https://' || s.slug || '.example.com/p' || CAST(floor(part_id / 50) AS BIGINT) "
        "|| '?v=1&lightbox=dataItem-' || code",
        key="s.slug || ':' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || ':' "
        f"|| substr(sha1(trim(regexp_replace(lower(strip_accents({_GALLERY_TEXT})), "
        "'[^a-z0-9]+', ' ', 'g'))), 1, 12)",
        price_raw="CASE part_id % 5 WHEN 0 THEN 'Véndu' WHEN 1 THEN 'Contactez nous pour les details' "
        "ELSE CAST(floor(price / 1000) AS BIGINT) || ' ' "
        "|| lpad(CAST(CAST(floor(price % 1000) AS BIGINT) AS VARCHAR), 3, '0') || ' $' END",
        price_value="CASE WHEN part_id % 5 > 1 THEN floor(price) END",
        primary="CASE WHEN part_id % 9 <> 0 THEN 'https://static.wixstatic.com/media/' || code "
        "|| '~mv2.jpg' ELSE '' END",
        additional="''",
        availability="CASE WHEN part_id % 5 = 0 THEN 'sold_out' ELSE 'available' END",
        description=_GALLERY_TEXT,
        designer="CASE WHEN t = 2 THEN 'Poul Henningsen' ELSE '' END",
        maker="CASE WHEN t = 2 THEN 'Louis Poulsen' ELSE '' END",
        era="''",
        materials="''",
        dimensions="'90 cm x 40 cm'",
        condition="''",
        scope="'local_quote'",
    ),
    PARTS,
)
def feed_gallery_json(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(
        S.gallery_feed(Y.gallery_payloads(spark, folder), Y.source_dimension(spark, folder))
    )


_FRONT_PRICE = "CASE part_id % 3 WHEN 0 THEN price WHEN 1 THEN round(price * 100) / 100 END"


@query(
    "feed_storefront_json",
    _parsed(
        0.84,
        where="furniture",
        url="CASE WHEN part_id % 3 = 0 THEN 'https://shop.example.com/' || code ELSE s.website END",
        key="s.slug || CASE WHEN part_id % 2 = 0 THEN ':' ELSE ':id-' END || code",
        price_raw=_money(f"({_FRONT_PRICE})"),
        price_value=_FRONT_PRICE,
        primary="img || CASE WHEN part_id % 2 = 0 THEN '-t.jpg' ELSE '-1280.jpg' END",
        additional="CASE WHEN part_id % 2 = 0 THEN img || '-1280.jpg,' ELSE '' END "
        "|| img || '-2560.jpg'",
        availability="CASE WHEN part_id % 7 = 0 OR part_id % 8 = 0 OR part_id % 9 = 0 "
        "THEN 'sold_out' ELSE 'available' END",
        description="text || CASE WHEN part_id % 8 = 0 THEN ' En rupture de stock' ELSE '' END",
        maker="CASE WHEN part_id % 8 = 0 AND t = 5 THEN '' ELSE maker END",
    ),
    PARTS,
)
def feed_storefront_json(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(
        S.storefront_feed(Y.storefront_payloads(spark, folder), Y.source_dimension(spark, folder))
    )


@query(
    "feed_gallery_pages_json",
    _parsed(
        0.78,
        url="s.website || '/item-' || code",
        key="s.slug || ':' || code",
        price_raw="CASE WHEN part_id % 3 <> 0 THEN printf('%.2f $', price) "
        "ELSE 'Contact for price' END",
        price_value="CASE WHEN part_id % 3 <> 0 THEN price END",
        primary="'https://freight.cargo.site/w/1200/i/h' || code || '/' "
        "|| CASE WHEN part_id % 2 = 0 THEN code || '%20%C3%A9.jpg' ELSE 'image' END",
        additional="'https://freight.cargo.site/w/1200/i/z' || code || '/b.jpg'",
        availability="'available'",
    ),
    PARTS,
)
def feed_gallery_pages_json(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(
        S.gallery_pages_feed(
            Y.gallery_pages_payloads(spark, folder), Y.source_dimension(spark, folder)
        )
    )


@query(
    "feed_embedded_json",
    _parsed(
        0.9,
        where="part_id % 12 <> 0 AND CAST(floor(part_id / 50) AS BIGINT) % 17 <> 16",
        url="s.website || '/product-page/' || code",
        key="s.slug || ':' || code",
        price_raw="CASE WHEN part_id % 4 <> 0 AND part_id % 6 <> 0 THEN printf('%.2f C$', price) "
        "ELSE 'Rupture de stock' END",
        price_value="CASE WHEN part_id % 10 <> 0 THEN price END",
        primary="img || '-1.jpg'",
        additional="img || '-2.jpg'",
        availability="CASE WHEN part_id % 4 <> 0 THEN 'available' ELSE 'sold_out' END",
        description="title",
        designer="''",
        maker="''",
        era="''",
        materials="''",
        dimensions="''",
        condition="''",
        scope="'local_quote'",
    ),
    PARTS,
)
def feed_embedded_json(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(
        S.embedded_feed(Y.embedded_pages(spark, folder), Y.source_dimension(spark, folder))
    )


@query(
    "feed_embedded_state",
    """SELECT DISTINCT 's' || shop_id AS source_slug, page,
  CASE WHEN page % 17 <> 16 THEN 's' || shop_id || '-' || page END AS site_id
FROM (SELECT shop_id, CAST(floor(part_id / 50) AS BIGINT) AS page FROM products)""",
    PARTS,
)
def feed_embedded_state(spark: SparkSession, folder: str) -> DataFrame:
    states = S.embedded_state(
        Y.embedded_pages(spark, folder), "struct<site:struct<id:string>>"
    )
    return states.select("source_slug", "page", F.col("state.site.id").alias("site_id"))


@query(
    "html_product_page",
    _parsed(
        0.82,
        where="t <> 5",
        url="'https://' || s.slug || '.example.com/products/' || code",
        key="CAST(NULL AS VARCHAR)",
        price_raw="CASE WHEN part_id % 3 <> 0 THEN format('${:,.2f} CAD', price) "
        "ELSE printf('$%.2f CAD', price) END",
        price_value="price",
        primary="CASE WHEN part_id % 3 <> 0 AND part_id % 2 = 0 THEN img || '-1.jpg' ELSE '' END",
        additional="''",
        availability="CASE WHEN part_id % 4 = 0 THEN 'sold_out' ELSE 'available' END",
        materials="coalesce(nullif(section_materials, ''), materials)",
        dimensions="coalesce(nullif(section_dimensions, ''), dimensions)",
    ),
    PARTS,
)
def html_product_page(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(
        S.product_page_feed(Y.product_pages(spark, folder), Y.source_dimension(spark, folder))
    )


@query(
    "html_meta_page",
    _parsed(
        0.66,
        url="'https://' || s.slug || '.example.com/products/' || code",
        key="'https://' || s.slug || '.example.com/products/' || code",
        price_raw="'Contactez-nous pour les details'",
        price_value="NULL",
        primary="img || '-og.jpg'",
        additional="''",
        availability="CASE WHEN part_id % 4 = 0 AND part_id % 3 = 0 THEN 'sold_out' "
        "ELSE 'available' END",
        description="'Table & chaises'",
        category="CASE WHEN t = 1 THEN 'sideboards / credenzas' ELSE 'dining chairs' END",
        designer="CASE WHEN t = 2 THEN 'Poul Henningsen' ELSE '' END",
        maker="CASE WHEN t = 2 THEN 'Louis Poulsen' ELSE 'Table & chaises' END",
        era="''",
        materials="''",
        dimensions="''",
        condition="''",
    ),
    PARTS,
)
def html_meta_page(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(
        S.meta_page_feed(Y.product_pages(spark, folder), Y.source_dimension(spark, folder))
    )


@query(
    "html_page_fields",
    r"""SELECT page_id,
  trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g'))
    AS raw_title,
  CAST(contains(html, '<h1') AS INTEGER) AS has_heading
FROM pages""",
)
def html_page_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Title and heading of every crawled page, by native expressions."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return A.pages(spark, folder).select(
        "page_id", clean_text(title).alias("raw_title"),
        F.col("html").contains("<h1").cast("int").alias("has_heading"),
    )


@query("html_page_read")
def html_page_read(spark: SparkSession, folder: str) -> DataFrame:
    """Every crawled page parsed in place; entities and malformed markup are beyond SQL."""
    return read_pages(A.pages(spark, folder), ["page_id", "url"]).select(
        "page_id", "url", "page_title", "heading", F.length("visible_text").alias("text_chars"),
        E.normalize_availability(F.lit(None).cast("string"), F.col("visible_text")).alias(
            "availability"
        ),
    )


@query(
    "html_link_discovery",
    r"""SELECT page_id, CAST(pos AS INTEGER) AS pos,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) || path || page_id AS link
FROM pages, (VALUES (0, '/planted/right-'), (1, '/planted/plain-'), (2, '/planted/a&b-'),
  (3, '/planted/up-')) t(pos, path)""",
)
def html_link_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Every crawled page with anchors planted before its own: another attribute that ends in href,
    a value without quotes, one in a comment, an entity, and a path with dots."""
    planted = F.concat(
        *[
            F.replace(F.lit(text), F.lit("#"), F.col("page_id").cast("string"))
            for text in (
                '<a data-href="/planted/wrong-#" href="/planted/right-#?from=1">1</a>',
                "<A HREF=/planted/plain-#>2</A><a href='/planted/right-#'>again</a>",
                '<!-- <a href="/planted/hidden-#">3</a> --><a name="planted">4</a>',
                '<a href="/planted/a&amp;b-#">5</a><a href="/x/./y/../../planted/up-#">6</a>',
            )
        ]
    )
    pages = A.pages(spark, folder).withColumn("html", F.concat(planted, "html"))
    return link_discovery(pages, "planted", F.col("url"))


# --- attributes of product texts ----------------------------------------------------------------


@query(
    "enrich_listings",
    """SELECT shop_id, part_id, category, era, designer, maker, condition AS condition_text,
  coalesce(nullif(section_materials, ''), materials) AS materials,
  coalesce(nullif(section_dimensions, ''), dimensions) AS dimensions_text
FROM products""",
    PARTS,
)
def enrich_listings(spark: SparkSession, folder: str) -> DataFrame:
    rows = (
        Y.products(spark, folder)
        .withColumn("_html", html_texts(F.col("markup")))
        .withColumns({"lines": F.col("_html.lines"), "folded": F.col("_html.folded")})
        .withColumn("description", F.col("_html.text"))
    )
    return E.enrich_listings(rows, "title", "description", "lines", "folded").select(
        "shop_id", "part_id", "category", "era", "designer", "maker", "condition_text",
        "materials", "dimensions_text",
    )
