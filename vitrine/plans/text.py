"""Registered text, key and display queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions import display as D
from vitrine.functions import enrich as E
from vitrine.functions import text as X
from vitrine.functions.dimensions import extract_dimensions
from vitrine.plans.registry import query
from vitrine.sources import adapters as A

# --- SQL counterparts ---------------------------------------------------------------------------

FOLD = "regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')"
LOOKUP = f"trim(regexp_replace(lower({FOLD}), '[^a-z0-9]+', ' ', 'g'))"
FILTER_KEY = f"trim(regexp_replace(lower(replace({FOLD}, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"
TITLE = "trim(lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g')))"
SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
CLEAN = f"trim(regexp_replace({{}}, '{V.WHITESPACE}+', ' ', 'g'))"


def sql(template: str, value: str) -> str:
    return template.replace("{}", value).replace("{{", "{").replace("}}", "}")


def has_any(value: str, terms: tuple[str, ...]) -> str:
    quoted = [t.replace("'", "''") for t in terms]
    return "(" + " OR ".join(f"contains({value}, '{t}')" for t in quoted) + ")"


def joined_flags(value: str, options: tuple) -> str:
    arms = ", ".join(
        f"CASE WHEN {has_any(value, words)} THEN '{name}' END" for name, words in options
    )
    return f"concat_ws(', ', {arms})"


def category_sql(value: str) -> str:
    arms = " ".join(f"WHEN {has_any(value, words)} THEN '{name}'" for name, words in V.CATEGORIES)
    return f"CASE {arms} ELSE '{V.DEFAULT_CATEGORY}' END"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return A.documents(spark, folder)


# --- job K: keys --------------------------------------------------------------------------------


@query("clean_text", f"SELECT doc_id, {sql(CLEAN, 'text')} AS clean FROM documents")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query("normalize_lookup", f"SELECT doc_id, {sql(LOOKUP, 'text')} AS lookup FROM documents")
def normalize_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", X.normalize_lookup(F.col("text")).alias("lookup")
    )


@query(
    "filter_key",
    f"""SELECT doc_id, {sql(FILTER_KEY, 'body')} AS filter_key
FROM (SELECT doc_id, 'Ray & ' || replace(text, '&', '+') AS body FROM documents)""",
)
def filter_key(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts behind a name with an escaped ampersand."""
    body = F.concat(F.lit("Ray &amp; "), F.replace("text", F.lit("&"), F.lit("+")))
    return documents(spark, folder).select("doc_id", X.filter_key(body).alias("filter_key"))


@query("normalize_title", f"SELECT doc_id, {sql(TITLE, 'text')} AS title_key FROM documents")
def normalize_title(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", X.normalize_title(F.col("text")).alias("title_key")
    )


@query("slugify", f"SELECT doc_id, {sql(SLUG, 'text')} AS slug FROM documents")
def slugify(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query(
    "slug_to_title",
    """SELECT p_partkey, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' '
  || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) || ' '
  || p_size || 'S' AS title FROM part""",
)
def slug_to_title(spark: SparkSession, folder: str) -> DataFrame:
    slug = F.concat(X.slugify(F.col("p_name")), F.lit("_"), F.col("p_size").cast("string"),
                    F.lit("s"))
    return A.read(spark, folder, "part").select(
        "p_partkey", X.slug_to_title(slug).alias("title")
    )


@query(
    "category_slug",
    """SELECT id, CASE effective_category WHEN 'lighting' THEN 'lighting' ELSE effective_category END
  AS slug, CASE WHEN effective_category = 'lighting' THEN 'lighting' END AS launch_category
FROM effective""",
)
def category_slug(spark: SparkSession, folder: str) -> DataFrame:
    """The slug, and the launch category it stands for (a fixed list of thirteen)."""
    from vitrine.operators.catalog import effective_category

    known = spark.createDataFrame(
        [(name,) for name in V.LAUNCH_CATEGORIES], "launch_category string"
    ).withColumn("slug", X.slugify(F.col("launch_category")))
    return (
        A.listings(spark, folder)
        .select("id", X.slugify(effective_category()).alias("slug"))
        .join(F.broadcast(known), "slug", "left")
    )


@query(
    "source_key",
    f"""SELECT doc_id, 'src:' || {sql(SLUG, 'title')} || ':' || CASE
  WHEN {sql(LOOKUP, 'text')} <> '' THEN substr(sha1({sql(LOOKUP, 'text')}), 1, 12)
  ELSE 'img-' || doc_id END AS described_key, 'https://x.com/a' || doc_id AS url_key
FROM (SELECT *, regexp_extract(text, '^[^\\n]*') AS title FROM documents)""",
)
def source_key(spark: SparkSession, folder: str) -> DataFrame:
    image = F.concat(
        F.lit("https://cdn.example.com/media/IMG_"), F.col("doc_id").cast("string"),
        F.lit("~mv2.jpg?w=1"),
    )
    rows = documents(spark, folder).withColumn("lookup", X.normalize_lookup(F.col("text")))
    return rows.select(
        "doc_id",
        X.described_key(
            F.lit("src"), F.regexp_extract("text", r"^[^\n]*", 0), F.col("lookup"), image
        ).alias("described_key"),
        X.url_key(
            F.concat(F.lit("HTTPS://X.com/A"), F.col("doc_id").cast("string"), F.lit("//"))
        ).alias("url_key"),
    )


@query(
    "rewrite_query_param",
    """SELECT page_id, regexp_extract(url, '^[^?#]*') || '?'
  || CASE WHEN contains(url, '?') THEN regexp_extract(url, '\\?([^#]*)', 1) || '&' ELSE '' END
  || 'lightbox=item+' || page_id || regexp_extract(url, '#.*$') AS rewritten FROM pages""",
)
def rewrite_query_param(spark: SparkSession, folder: str) -> DataFrame:
    """The parameter set on every page address; addresses that have it already get it replaced."""
    pages = A.pages(spark, folder)
    item = F.concat(F.lit("item "), F.col("page_id").cast("string"))
    once = X.rewrite_query_param(F.col("url"), "lightbox", F.lit("old"))
    return pages.withColumn("once", once).select(
        "page_id", X.rewrite_query_param(F.col("once"), "lightbox", item).alias("rewritten")
    )


@query(
    "image_list",
    """SELECT page_id, coalesce(list_extract(urls, 1), '') AS primary_image,
  array_to_string(list_slice(urls, 2, 6), ' ') AS additional_images,
  CAST(len(urls) AS INTEGER) AS images
FROM (SELECT page_id, list_filter(list_transform(list_filter(
    list_transform(range(len(hrefs)), lambda i: struct_pack(i := i, h := hrefs[i + 1])),
    lambda x: x.h <> '' AND list_position(hrefs, x.h) = x.i + 1), lambda x: x.h), lambda h: true)
  AS urls
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages))""",
)
def image_list(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered distinct non-empty addresses of every page."""
    urls = X.distinct_urls(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return A.pages(spark, folder).withColumn("urls", urls).select(
        "page_id", X.primary_image(F.col("urls")).alias("primary_image"),
        F.array_join(X.additional_images(F.col("urls")), " ").alias("additional_images"),
        F.size("urls").alias("images"),
    )


@query(
    "item_number",
    """SELECT id, printf('MCM-%06d', id % 2000000) AS item_number, id % 2000000 AS parsed,
  CASE WHEN id % 2 = 0 THEN id % 2000000 END AS parsed_loose FROM listings""",
)
def item_number(spark: SparkSession, folder: str) -> DataFrame:
    number = X.item_number(F.col("id") % 2_000_000)
    loose = F.concat(F.lit(" "), F.lower(number), F.when(F.col("id") % 2 == 0, " ").otherwise("x"))
    return A.listings(spark, folder).select(
        "id", number.alias("item_number"), X.parse_item_number(number).alias("parsed"),
        X.parse_item_number(loose).alias("parsed_loose"),
    )


@query(
    "owner_key",
    "SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS owner_key FROM events",
)
def owner_key(spark: SparkSession, folder: str) -> DataFrame:
    return A.read(spark, folder, "events").select(
        "event_id", X.owner_key(F.col("user_id").cast("string")).alias("owner_key")
    )


@query(
    "derive_keys",
    f"""SELECT id, {sql(LOOKUP, 'title')} AS lookup, {sql(FILTER_KEY, 'designer')} AS designer_key,
  {sql(FILTER_KEY, 'maker')} AS maker_key, {sql(TITLE, 'source_description')} AS description_key,
  {sql(SLUG, 'title')} AS slug, printf('MCM-%06d', id) AS item_number,
  rtrim(lower(source_listing_url), '/') AS url_key FROM listings""",
)
def derive_keys(spark: SparkSession, folder: str) -> DataFrame:
    """All keys of all listings; names are folded in one pass."""
    return A.listings(spark, folder).select(
        "id",
        X.normalize_lookup(F.col("title")).alias("lookup"),
        X.filter_key(F.col("designer")).alias("designer_key"),
        X.filter_key(F.col("maker")).alias("maker_key"),
        X.normalize_title(F.col("source_description")).alias("description_key"),
        X.slugify(F.col("title")).alias("slug"),
        X.item_number(F.col("id")).alias("item_number"),
        X.url_key(F.col("source_listing_url")).alias("url_key"),
    )


# --- job E: attributes --------------------------------------------------------------------------


@query(
    "parse_price",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber % 7
    WHEN 5 THEN floor(l_extendedprice) WHEN 6 THEN NULL ELSE l_extendedprice END AS price
FROM lineitem""",
)
def parse_price(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item's price written in one of seven ways and read back."""
    price = F.col("l_extendedprice")
    plain = F.format_string("%.2f", price)
    us = F.format_string("%,.2f", price)
    whole = F.format_string("%,.0f", F.floor(price).cast("double"))
    swapped = F.translate(us, ",.", ".,")
    line = F.col("l_linenumber") % 7
    text = (
        F.when(line == 0, F.concat(F.lit("C$"), us))
        .when(line == 1, F.concat(swapped, F.lit(" $")))
        .when(line == 2, F.concat(F.lit("Prix "), F.translate(us, ",", " "), F.lit(" CAD")))
        .when(line == 3, F.concat(F.translate(us, ",", "."), F.lit("$")))
        .when(line == 4, plain)
        .when(line == 5, F.concat(F.lit("$"), whole))
        .otherwise("sur demande ...")
    )
    return A.read(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", X.parse_price(text).alias("price")
    )


@query(
    "price_text_extract",
    r"""SELECT doc_id,
  coalesce(nullif(regexp_extract(text, '\$[\d,]+(?:\.\d{2})?\s*CAD'), ''),
    regexp_extract(text, '\$[\d,]+(?:\.\d{2})?')) AS price_text,
  regexp_extract(text, '(\d[\d\s]*(?:[.,]\d{2})?)\s*\$', 1) AS french_price
FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' $12 or $' || doc_id || ',000.50 CAD'
  WHEN 1 THEN ' now ' || doc_id || ' 500,25 $' ELSE '' END AS text FROM documents)""",
)
def price_text_extract(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    text = F.concat(
        F.col("text"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" $12 or $"), key, F.lit(",000.50 CAD")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" now "), key, F.lit(" 500,25 $")))
        .otherwise(""),
    )
    rows = documents(spark, folder).select("doc_id", text.alias("text"))
    return rows.select(
        "doc_id", X.price_text(F.col("text")).alias("price_text"),
        X.first_match(F.col("text"), X.java(V.PRICE_FRENCH_PATTERN), 1).alias("french_price"),
    )


@query(
    "price_line",
    f"""SELECT doc_id, coalesce(list_extract(list_filter(list_transform(
    string_split(text, chr(10)), lambda l: {sql(CLEAN, 'l')}),
  lambda l: l <> '' AND (regexp_matches(l, '\\d+\\s*\\$') OR contains({sql(LOOKUP, 'l')}, 'vendu'))),
  -1), '') AS price_line
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, '.', ' Vendú.') ELSE text END
  || CASE doc_id % 3 WHEN 1 THEN chr(10) || '  1 ' || doc_id || ' $  ' || chr(10) || 'fin' ELSE '' END
  AS text FROM documents)""",
)
def price_line(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    text = F.concat(
        F.when(kind == 0, F.replace("text", F.lit("."), F.lit(" Vendú."))).otherwise(
            F.col("text")
        ),
        F.when(
            kind == 1,
            F.concat(F.lit("\n  1 "), F.col("doc_id").cast("string"), F.lit(" $  \nfin")),
        ).otherwise(""),
    )
    rows = documents(spark, folder).select("doc_id", text.alias("text"))
    return rows.select(
        "doc_id", X.price_line(F.col("text"), X.ascii_fold(F.col("text"))).alias("price_line")
    )


_ERA_LETTER = r"[\p{L}\p{N}_]"


@query(
    "extract_era",
    f"""SELECT doc_id, coalesce(
  CASE WHEN found = '' THEN NULL WHEN found[1] IN ('''', '’')
    THEN '19' || replace(replace(found, '''', ''), '’', '')
    ELSE replace(replace(found, '''', ''), '’', '') END,
  CASE WHEN french <> '' THEN '19' || french || 's' END, '') AS era
FROM (SELECT doc_id,
    regexp_extract(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(19[4-9]0[’'']?s|20[0-2]0[’'']?s|[’'']\\d0s)(?:$|[^\\p{{L}}\\p{{N}}_])', 1) AS found,
    regexp_extract(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])ann[ée]es?\\s+([4-9]0)(?:$|[^\\p{{L}}\\p{{N}}_])', 1) AS french
  FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' 1960’s' WHEN 1 THEN ' (''70s)'
    WHEN 2 THEN ' Années 50' WHEN 3 THEN ' x1980s' ELSE '' END AS text FROM documents))""",
)
def extract_era(spark: SparkSession, folder: str) -> DataFrame:
    tail = A.pick(F.col("doc_id"), (" 1960’s", " ('70s)", " Années 50", " x1980s", ""))
    rows = documents(spark, folder).select("doc_id", F.concat("text", tail).alias("text"))
    return rows.select("doc_id", E.extract_era(F.col("text")).alias("era"))


@query(
    "extract_dimensions",
    """SELECT p_partkey, CASE p_partkey % 6
    WHEN 0 THEN p_size || ' cm x 80 cm' WHEN 1 THEN p_size || '”Ø x 9”H'
    WHEN 2 THEN p_size || '"L x 16"P x 24"/30"H' WHEN 3 THEN p_size || 'cmW x 80cmD'
    WHEN 4 THEN p_size || '"H' ELSE '' END AS dimensions
FROM part""",
)
def extract_dimensions_of_parts(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.col("p_name"), F.lit(", "),
        F.replace(
            A.pick(
                F.col("p_partkey"),
                (
                    "[n] cm x 80 cm (approx)",
                    "diam [n]”Ø x 9”H",
                    'Longueur totale : [n]" - Profondeur : 16" Hauteur (assise) : 15" Hauteur : 24" à 30"',
                    "W [n] D 80 cm",
                    'haut: [n]"H and then some more words, seat height 12"H',
                    "no [n] given",
                ),
            ),
            F.lit("[n]"), size,
        ),
    )
    rows = A.read(spark, folder, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", extract_dimensions(F.col("text")).alias("dimensions"))


@query("extract_dimensions_of_texts")
def extract_dimensions_of_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The whole cascade over whole documents (its scans need lookarounds SQL does not have)."""
    return documents(spark, folder).select(
        "doc_id", extract_dimensions(X.clean_text(F.col("text"))).alias("dimensions")
    )


@query("extract_designer_maker")
def extract_designer_maker(spark: SparkSession, folder: str) -> DataFrame:
    """Names over whole documents: the first line as title, the whole text as description."""
    rows = documents(spark, folder).select(
        "doc_id",
        X.clean_text(F.regexp_extract("text", r"^[^\n]*", 0)).alias("title"),
        X.clean_text(F.col("text")).alias("description"),
    )
    return rows.withColumn(
        "names", E.designer_maker(F.col("title"), F.col("description"))
    ).select("doc_id", "names.designer", "names.maker")


@query(
    "extract_materials",
    f"SELECT doc_id, {joined_flags('lower(text)', V.MATERIALS)} AS materials FROM documents",
)
def extract_materials(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", E.extract_materials(F.col("text")).alias("materials")
    )


@query(
    "extract_condition",
    f"""SELECT doc_id, {joined_flags('lower(text)', V.CONDITIONS)} AS condition
FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' RESTAURÉ refinished' WHEN 1
  THEN ' Reupholstered' ELSE '' END AS text FROM documents)""",
)
def extract_condition(spark: SparkSession, folder: str) -> DataFrame:
    tail = A.pick(F.col("doc_id"), (" RESTAURÉ refinished", " Reupholstered", ""))
    return documents(spark, folder).select(
        "doc_id", E.extract_condition(F.concat("text", tail)).alias("condition")
    )


@query(
    "categorize",
    f"SELECT doc_id, {category_sql('lower(source || chr(32) || text)')} AS category FROM documents",
)
def categorize(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", E.categorize(F.col("source"), F.col("text")).alias("category")
    )


@query(
    "labeled_section",
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE {sql(CLEAN, 'text')} END AS section
FROM documents""",
)
def labeled_section(spark: SparkSession, folder: str) -> DataFrame:
    """The whole document as the section below a label, another section behind it."""
    kind = F.col("doc_id") % 4
    label = F.when(kind == 0, "MATERIALS").when(kind == 1, " Matériaux: ").when(
        kind == 2, "materiaux"
    ).otherwise("Matter")
    text = F.concat(F.lit("Intro\r\n\n"), label, F.lit("\n"), F.col("text"),
                    F.lit("\n\nLead time\nsix weeks"))
    rows = documents(spark, folder).select("doc_id", text.alias("body"))
    return E.labeled_section(rows, "body", V.MATERIAL_LABELS, "section").select(
        "doc_id", "section"
    )


def _flag(expression: str) -> str:
    return f"CAST({expression} AS INTEGER)"


@query(
    "row_classifiers",
    f"""SELECT doc_id, {_flag(has_any('k', V.FURNITURE_TERMS))} AS is_furniture,
  {_flag("contains(k, 'current production')")} AS is_current_production,
  {_flag(f"k = '' OR ({has_any('k', V.ANNOUNCEMENT_TERMS)} AND NOT {has_any('k', V.INVENTORY_TERMS)})")}
    AS is_promotional,
  {_flag("k = 'gift card'")} AS is_gift_card
FROM (SELECT doc_id, {sql(LOOKUP, 'text')} AS k FROM (SELECT doc_id, CASE
  WHEN doc_id % 10 = 0 THEN 'Gïft  card!' WHEN doc_id % 10 = 1 THEN text || ' current-production'
  WHEN doc_id % 10 = 2 THEN 'Joyeux Noël' WHEN doc_id % 10 = 3 THEN ' … ' ELSE text END AS text
  FROM documents))""",
)
def row_classifiers(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("doc_id") % 10
    text = (
        F.when(kind == 0, "Gïft  card!")
        .when(kind == 1, F.concat("text", F.lit(" current-production")))
        .when(kind == 2, "Joyeux Noël")
        .when(kind == 3, " … ")
        .otherwise(F.col("text"))
    )
    rows = documents(spark, folder).select("doc_id", X.normalize_lookup(text).alias("k"))
    key = F.col("k")
    return rows.select(
        "doc_id",
        E.is_furniture(key).cast("int").alias("is_furniture"),
        E.is_current_production(key).cast("int").alias("is_current_production"),
        E.is_promotional(key).cast("int").alias("is_promotional"),
        E.is_gift_card(key).cast("int").alias("is_gift_card"),
    )


@query(
    "normalize_availability",
    f"""SELECT doc_id,
  CASE WHEN doc_id % 3 = 0 OR {has_any('lower(text)', ('rupture de stock', 'sold out', 'out of stock'))}
    THEN 'sold_out' ELSE 'available' END AS by_offer,
  CASE WHEN contains({sql(LOOKUP, 'text')}, 'vendu') THEN 'sold_out' ELSE 'available' END AS by_mark,
  {_flag(has_any(sql(LOOKUP, 'text'), V.SOLD_OUT_PAGE_TERMS))} AS page_sold_out
FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 1 THEN ' Sold Out' WHEN 2 THEN ' VENDÚ' ELSE '' END
  AS text FROM documents)""",
)
def normalize_availability(spark: SparkSession, folder: str) -> DataFrame:
    tail = A.pick(F.col("doc_id"), ("", " Sold Out", " VENDÚ", ""))
    rows = documents(spark, folder).select("doc_id", F.concat("text", tail).alias("text"))
    offer = F.when(F.col("doc_id") % 3 == 0, "https://schema.org/SoldOut")
    rows = rows.withColumn("k", X.normalize_lookup(F.col("text")))
    return rows.select(
        "doc_id", E.normalize_availability(offer, F.col("text")).alias("by_offer"),
        E.marked_sold(F.col("k")).alias("by_mark"),
        E.is_sold_out_page(F.col("k")).cast("int").alias("page_sold_out"),
    )


@query(
    "clean_designer",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Hans J. Wegner' WHEN 1 THEN c_name
    WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN 'Charles & Ray Eames' ELSE '' END AS designer
FROM customer""",
)
def clean_designer(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = (
        F.when(key % 6 == 0, " - Design  Hans Wegner,")
        .when(key % 6 == 1, F.concat(F.col("c_name"), F.lit(" –")))
        .when(key % 6 == 2, F.concat(F.lit("Store Policies "), "c_name"))
        .when(key % 6 == 3, F.concat(F.lit("1960s designer "), "c_name"))
        .when(key % 6 == 4, "Charles and Ray  Eames")
        .otherwise("Montréal")
    )
    return A.read(spark, folder, "customer").select(
        "c_custkey", E.clean_designer(raw).alias("designer")
    )


@query(
    "enrich_documents",
    f"""SELECT doc_id, {category_sql("lower(title || ' ' || body)")} AS category,
  {joined_flags("lower(title || ' ' || body)", V.MATERIALS)} AS materials,
  {joined_flags('lower(body)', V.CONDITIONS)} AS condition_text
FROM (SELECT doc_id, {sql(CLEAN, 'first')} AS title, {sql(CLEAN, 'text')} AS body
  FROM (SELECT doc_id, text, regexp_extract(text, '^[^\\n]*') AS first FROM documents))""",
)
def enrich_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The attribute job over whole documents, the first line as title."""
    rows = documents(spark, folder).select(
        "doc_id",
        X.clean_text(F.regexp_extract("text", r"^[^\n]*", 0)).alias("title"),
        X.clean_text(F.col("text")).alias("description"),
    )
    return E.enrich_listings(rows).select("doc_id", "category", "materials", "condition_text")


# --- job L: display -----------------------------------------------------------------------------

AS_OF = "2001-11-05 00:00:00"


def _localized_sql(lang: str) -> str:
    labels = {
        "en": {"sold": "Sold out", "available": "Available", "removed": "Removed",
               "reserved": "reserved", "light": "lighting", "restored": "Restored",
               "refinished": "Refinished", "quote": "Contact us for details"},
        "fr": {"sold": "Vendu", "available": "Disponible", "removed": "Retiré",
               "reserved": "reserved", "light": "luminaires", "restored": "Restauré",
               "refinished": "Refini", "quote": "Contactez-nous pour les détails"},
    }[lang]
    today, week, stale = V.FRESHNESS[lang]
    months = ", ".join(f"'{m}'" for m in V.MONTHS[lang])
    price = (
        "replace(format('{:,}', CAST(round_even(price_value, 0) AS BIGINT)), ',', ' ') || ' $ CA'"
        if lang == "fr"
        else "'$' || format('{:,}', CAST(round_even(price_value, 0) AS BIGINT)) || ' CAD'"
    )
    date = (
        f"day(first_seen_at) || ' ' || ([{months}])[month(first_seen_at)] || ' ' || year(first_seen_at)"
        if lang == "fr"
        else f"([{months}])[month(first_seen_at)] || ' ' || day(first_seen_at) || ', ' || year(first_seen_at)"
    )
    era = "'années ' || left(era, 4)" if lang == "fr" else "era"
    place = "s.city || ' ' || s.province || ' ' || s.postal_code"
    query_text = (
        "replace(replace(url_encode(concat_ws(', ', s.name, nullif(s.street_address, ''), s.city, "
        "s.province, s.postal_code)), '%20', '+'), '%7E', '~')"
    )
    translated = (
        "CASE WHEN s.id % 2 = 0 THEN 'Livraison ' || s.slug ELSE s.shipping_summary END"
        if lang == "fr"
        else "s.shipping_summary"
    )
    return f"""SELECT e.id, s.slug AS shop_slug, s.name AS shop_name,
  concat_ws(chr(10), nullif(s.street_address, ''), {place}, s.country) AS shop_address,
  'https://www.google.com/maps/search/?api=1&query=' || {query_text} AS shop_directions_url,
  'https://maps.apple.com/?q=' || {query_text} AS shop_apple_maps_url,
  CAST(s.street_address <> '' AND coalesce(s.latitude <> 0 AND s.longitude <> 0, false) AS INTEGER)
    AS shop_has_map,
  s.description AS shop_description, s.style_focus AS shop_style_focus,
  CASE WHEN price_value IS NULL THEN '{labels['quote']}' ELSE {price} END AS price_text,
  CASE effective_availability WHEN 'sold_out' THEN '{labels['sold']}'
    WHEN 'available' THEN '{labels['available']}' WHEN 'removed' THEN '{labels['removed']}' END
    AS status_text,
  CASE effective_category WHEN 'lighting' THEN '{labels['light']}' ELSE effective_category END
    AS category_text,
  materials AS material_text,
  replace(replace(condition_text, 'Restored', '{labels['restored']}'), 'Refinished',
    '{labels['refinished']}') AS condition_label,
  {era} AS era_text, {date} AS first_seen_text,
  CASE WHEN last_checked_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN '{today}'
    WHEN last_checked_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN '{week}' ELSE '{stale}' END
    AS freshness,
  {translated} AS shipping_text
FROM effective e JOIN shops s ON s.id = e.source_shop_id"""


def _localized(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    shops = A.shops(spark, folder)
    labels = shops.filter(F.col("id") % 2 == 0).select(
        "slug", F.lit("fr").alias("lang"), F.lit("shipping_summary").alias("field"),
        F.concat(F.lit("Livraison "), "slug").alias("text"),
    )
    return D.localize_catalog(A.listings(spark, folder), shops, labels, lang, A.moment(AS_OF))


@query("localize_catalog", _localized_sql("en"))
def localize_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _localized(spark, folder, "en")


@query("localize_catalog_fr", _localized_sql("fr"))
def localize_catalog_fr(spark: SparkSession, folder: str) -> DataFrame:
    return _localized(spark, folder, "fr")


@query(
    "price_display",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE l_linenumber % 7 WHEN 0 THEN 'Vendu' WHEN 1 THEN 'Contactez-nous pour les détails'
    WHEN 2 THEN 'sur demande'
    ELSE replace(format('{:,}', CAST(round_even(l_extendedprice, 0) AS BIGINT)), ',', ' ')
      || CASE WHEN l_linenumber % 7 = 5 THEN ' EUR' ELSE ' $ CA' END
      || CASE l_linenumber % 7 WHEN 3 THEN ' pour l’ensemble de 6' WHEN 4 THEN ' pour la paire'
        WHEN 5 THEN ' chaque' ELSE ' pour l’ensemble' END END AS price_text
FROM lineitem""",
)
def price_display(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("l_linenumber") % 7
    raw = A.pick(
        F.col("l_linenumber"),
        ("SOLD OUT", "Contact us", "sur demande", "x / 6", "x /paire", "x ch. ", "x / l’ens."),
    )
    return A.read(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        D.price_display(
            F.when(line > 2, F.col("l_extendedprice")), raw,
            F.when(line == 5, "EUR").otherwise("CAD"), "fr",
        ).alias("price_text"),
    )


@query(
    "label_localize",
    """SELECT id, coalesce(categories, '') AS categories,
  CASE WHEN n = 1 THEN '1 annonce' ELSE n || ' annonces' END AS listing_count
FROM (SELECT s.id, (SELECT string_agg(replace(c, 'lighting', 'luminaires'), ', ' ORDER BY c) FROM (
    SELECT DISTINCT effective_category AS c FROM effective e WHERE e.source_shop_id = s.id))
    AS categories,
  (SELECT count(*) FROM effective e WHERE e.source_shop_id = s.id) AS n FROM shops s)""",
)
def label_localize(spark: SparkSession, folder: str) -> DataFrame:
    """French category lists and counts per shop, active or not."""
    from vitrine.operators.facets import shop_rollup

    shops, listings = A.shops(spark, folder), A.listings(spark, folder)
    everyone = shop_rollup(shops.withColumn("active", F.lit(1)), listings)
    counts = listings.groupBy(F.col("source_shop_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return everyone.join(counts, "id", "left").select(
        "id", D.category_list(F.col("categories_carried"), "fr").alias("categories"),
        D.listing_count(F.coalesce("n", F.lit(0)), "fr").alias("listing_count"),
    )


@query(
    "address_lines",
    """SELECT id, concat_ws('|', nullif(street_address, ''), city || ' ' || province || ' ' || postal_code,
  country) AS lines, CAST(street_address <> '' AND coalesce(latitude <> 0, false) AS INTEGER) AS has_map
FROM shops""",
)
def address_lines(spark: SparkSession, folder: str) -> DataFrame:
    shops = A.shops(spark, folder)
    return shops.select(
        "id", F.array_join(D.address_lines(shops), "|").alias("lines"),
        D.has_map(shops).cast("int").alias("has_map"),
    )
