"""Registered facet, report, export and similarity queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import facets as R
from vitrine.operators import similarity as S
from vitrine.operators.entities import entity_alias_map
from vitrine.plans.registry import query
from vitrine.sources import adapters as A

BASE_URL = "https://catalog.example.com"
SHOWN = "is_active = 1 AND effective_availability <> 'removed'"


def _facet_sql(field: str, limit: str = "LIMIT 30") -> str:
    return f"""SELECT value FROM (
  SELECT trim(piece) AS value, min((raw, pos)) AS seen FROM (
    SELECT raw, unnest(string_split(raw, ',')) AS piece,
      unnest(range(len(string_split(raw, ',')))) AS pos
    FROM (SELECT DISTINCT {field} AS raw FROM effective WHERE {SHOWN} AND {field} <> ''))
  WHERE trim(piece) <> '' GROUP BY 1) ORDER BY seen {limit}"""


@query("facet_values", _facet_sql("materials"))
def facet_values(spark: SparkSession, folder: str) -> DataFrame:
    return R.facet_values(A.listings(spark, folder), "materials")


@query("facet_values_category", _facet_sql("category"))
def facet_values_category(spark: SparkSession, folder: str) -> DataFrame:
    return R.facet_values(A.listings(spark, folder), "category")


@query(
    "location_values",
    f"""SELECT DISTINCT trim(location_text) AS value FROM effective
WHERE {SHOWN} AND trim(location_text) <> ''""",
)
def location_values(spark: SparkSession, folder: str) -> DataFrame:
    return R.location_values(A.listings(spark, folder))


@query(
    "designer_facet",
    f"""SELECT value, count FROM (
  SELECT count(*) OVER () AS names, key, CAST(sum(n) AS BIGINT) AS count, arg_min(label, (length(label), label)) AS value
  FROM (
    SELECT coalesce(m.canonical_name, t.raw) AS label, t.n,
      trim(regexp_replace(lower(coalesce(m.canonical_name, t.raw)), '[^a-z0-9]+', ' ', 'g')) AS key
    FROM (SELECT raw, count(*) AS n FROM (
        SELECT designer AS raw FROM effective WHERE {SHOWN}
        UNION ALL SELECT maker FROM effective WHERE {SHOWN}) WHERE raw <> '' GROUP BY 1) t
    LEFT JOIN alias_map m ON m.alias_key
      = trim(regexp_replace(lower(t.raw), '[^a-z0-9]+', ' ', 'g')))
  GROUP BY key)
WHERE count >= 2 OR names <= 30
ORDER BY count DESC, key LIMIT 24""",
)
def designer_facet(spark: SparkSession, folder: str) -> DataFrame:
    aliases = entity_alias_map(
        A.design_entities(spark, folder), A.design_entity_aliases(spark, folder)
    )
    return R.designer_facet(A.listings(spark, folder), aliases)


@query(
    "shop_rollup",
    """SELECT s.id, s.slug, s.name, s.is_montreal_local,
  CAST(sum(CASE WHEN l.id IS NULL THEN NULL
    WHEN l.is_active = 1 AND effective_availability <> 'sold_out' THEN 1 ELSE 0 END) AS BIGINT)
    AS active_listing_count,
  string_agg(DISTINCT effective_category, ',' ORDER BY effective_category) AS categories_carried
FROM shops s LEFT JOIN effective l ON l.source_shop_id = s.id
WHERE s.active = 1 GROUP BY 1, 2, 3, 4""",
)
def shop_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return R.shop_rollup(A.shops(spark, folder), A.listings(spark, folder)).select(
        "id", "slug", "name", "is_montreal_local", "active_listing_count", "categories_carried"
    )


@query(
    "source_status",
    """SELECT s.id, s.slug, s.crawl_priority, r.ran_at AS last_run_at, r.status AS last_status,
  r.error_message AS last_error, j.started_at AS last_job_started_at,
  j.finished_at AS last_job_finished_at, j.status AS last_job_status,
  j.new_count AS last_job_new_count, j.hidden_count AS last_job_hidden_count,
  j.chunk_index AS last_job_chunk_index,
  (SELECT count(*) FROM listings l WHERE l.source_shop_id = s.id AND l.is_active = 1)
    AS active_listing_count
FROM shops s
LEFT JOIN (SELECT * FROM crawl_runs QUALIFY row_number() OVER (
  PARTITION BY shop_id ORDER BY ran_at DESC, id DESC) = 1) r ON r.shop_id = s.id
LEFT JOIN (SELECT * FROM jobs QUALIFY row_number() OVER (
  PARTITION BY shop_id ORDER BY started_at DESC, id DESC) = 1) j ON j.shop_id = s.id
WHERE s.active = 1""",
)
def source_status(spark: SparkSession, folder: str) -> DataFrame:
    status = R.source_status(
        A.shops(spark, folder), A.crawl_runs(spark, folder), A.refresh_jobs(spark, folder),
        A.listings(spark, folder),
    )
    return status.select(
        "id", "slug", "crawl_priority",
        *[c for c in status.columns if c.startswith("last_")], "active_listing_count",
    )


@query(
    "recent_failures",
    """SELECT f.*, s.name AS shop_name FROM crawl_failures f JOIN shops s ON s.id = f.shop_id
ORDER BY created_at DESC, f.id DESC LIMIT 20""",
)
def recent_failures(spark: SparkSession, folder: str) -> DataFrame:
    return R.recent_failures(A.crawl_failures(spark, folder), A.shops(spark, folder))


@query(
    "export_sitemap",
    f"""SELECT '{BASE_URL}' || p AS loc, '' AS lastmod FROM (VALUES ('/'), ('/shops'), ('/about')) t(p)
UNION ALL SELECT '{BASE_URL}/categories/'
  || trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-'), '' FROM category_facet
UNION ALL SELECT '{BASE_URL}/shops/' || slug, '' FROM shops WHERE active = 1
UNION ALL SELECT '{BASE_URL}/listing/' || printf('MCM-%06d', id),
  strftime(last_checked_at, '%Y-%m-%d') FROM (
    SELECT l.id, l.last_checked_at FROM effective l JOIN shops s ON s.id = l.source_shop_id
    WHERE s.active = 1 AND {SHOWN})""",
    {"category_facet": _facet_sql("category", "")},
)
def export_sitemap(spark: SparkSession, folder: str) -> DataFrame:
    return R.sitemap(A.listings(spark, folder), A.shops(spark, folder), BASE_URL)


@query(
    "export_sitemap_files",
    f"""SELECT CAST(floor((r - 1) / 1000) AS BIGINT) AS file, count(*) AS urls, min(loc) AS first_loc,
  max(loc) AS last_loc FROM (
  SELECT loc, row_number() OVER (ORDER BY loc) AS r FROM (
    SELECT '{BASE_URL}' || p AS loc FROM (VALUES ('/'), ('/shops'), ('/about')) t(p)
    UNION ALL SELECT '{BASE_URL}/categories/'
      || trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-') FROM category_facet
    UNION ALL SELECT '{BASE_URL}/shops/' || slug FROM shops WHERE active = 1
    UNION ALL SELECT '{BASE_URL}/listing/' || printf('MCM-%06d', l.id)
      FROM effective l JOIN shops s ON s.id = l.source_shop_id WHERE s.active = 1 AND {SHOWN}))
GROUP BY 1""",
    {"category_facet": _facet_sql("category", "")},
)
def export_sitemap_files(spark: SparkSession, folder: str) -> DataFrame:
    """What each of the numbered files holds."""
    urls = R.sitemap(A.listings(spark, folder), A.shops(spark, folder), BASE_URL)
    return R.sitemap_files(urls, 1000).groupBy("file").agg(
        F.count("*").alias("urls"), F.min("loc").alias("first_loc"), F.max("loc").alias("last_loc")
    )


@query(
    "export_structured_data",
    f"""SELECT l.id, '{{"@context":"https://schema.org","@type":"Product","name":"' || title
  || '","description":"' || source_description || '","url":"{BASE_URL}/listing/'
  || printf('MCM-%06d', l.id) || '"'
  || CASE WHEN primary_image_url <> '' THEN ',"image":"' || primary_image_url || '"' ELSE '' END
  || ',"brand":{{"@type":"Brand","name":"' || s.name || '"}},"category":"' || effective_category
  || '","offers":{{"@type":"Offer","url":"' || source_listing_url
  || '","priceCurrency":"CAD","availability":"https://schema.org/'
  || CASE WHEN effective_availability = 'sold_out' THEN 'OutOfStock' ELSE 'InStock' END
  || '","seller":{{"@type":"Store","name":"' || s.name || '"}}'
  || CASE WHEN price_value IS NOT NULL THEN ',"price":' || CAST(price_value AS VARCHAR) ELSE '' END
  || '}}}}' AS json_ld
FROM effective l JOIN shops s ON s.id = l.source_shop_id""",
)
def export_structured_data(spark: SparkSession, folder: str) -> DataFrame:
    return R.listing_json_ld(A.listings(spark, folder), A.shops(spark, folder), BASE_URL)


@query(
    "export_shop_data",
    f"""SELECT id, '{{"@context":"https://schema.org","@type":"Store","name":"' || name
  || '","description":"' || description || '","url":"{BASE_URL}/shops/' || slug
  || '","sameAs":"' || website || '","address":{{"@type":"PostalAddress","addressLocality":"'
  || city || '","addressRegion":"' || province || '","addressCountry":"' || country || '"'
  || CASE WHEN street_address <> '' THEN ',"streetAddress":"' || street_address
    || '","postalCode":"' || postal_code || '"' ELSE '' END || '}}'
  || CASE WHEN latitude <> 0 THEN ',"geo":{{"@type":"GeoCoordinates","latitude":'
    || CAST(latitude AS VARCHAR) || ',"longitude":' || CAST(longitude AS VARCHAR) || '}}'
    ELSE '' END || '}}' AS json_ld
FROM shops""",
)
def export_shop_data(spark: SparkSession, folder: str) -> DataFrame:
    return R.shop_json_ld(A.shops(spark, folder), BASE_URL)


@query(
    "export_collection_data",
    f"""SELECT path, '{{"@context":"https://schema.org","@type":"CollectionPage","name":"' || category
  || '","description":"' || n || ' listings","url":"{BASE_URL}' || path
  || '","isPartOf":{{"@type":"WebSite","name":"Catalog"}}}}' AS json_ld
FROM (SELECT effective_category AS category, '/categories/' || effective_category AS path,
  count(*) AS n FROM effective GROUP BY 1, 2)""",
)
def export_collection_data(spark: SparkSession, folder: str) -> DataFrame:
    from vitrine.operators.catalog import with_effective_values

    collections = (
        with_effective_values(A.listings(spark, folder))
        .groupBy(F.col("effective_category").alias("name"))
        .agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" listings")).alias("description"))
        .withColumn("path", F.concat(F.lit("/categories/"), "name"))
    )
    return R.collection_json_ld(collections, BASE_URL, "Catalog")


@query(
    "duplicate_pairs",
    """SELECT a.id AS left_id, b.id AS right_id,
  len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS score
FROM ranked a JOIN ranked b ON b.r > a.r AND b.r <= a.r + 11
WHERE a.source_shop_id <> b.source_shop_id
  AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.72
ORDER BY a.r, b.r LIMIT 12""",
    {
        "ranked": """SELECT id, source_shop_id, list_distinct(string_split(normalized_title, ' ')) AS w,
  row_number() OVER (ORDER BY normalized_title, id) AS r FROM listings WHERE is_active = 1"""
    },
)
def duplicate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return S.duplicate_pairs(A.listings(spark, folder))


@query(
    "duplicate_pairs_all",
    """SELECT a.id AS left_id, b.id AS right_id,
  len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS score
FROM ranked a JOIN ranked b ON b.r > a.r AND b.r <= a.r + 11
WHERE a.source_shop_id <> b.source_shop_id
  AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.72""",
    {
        "ranked": """SELECT id, source_shop_id, list_distinct(string_split(normalized_title, ' ')) AS w,
  row_number() OVER (ORDER BY normalized_title, id) AS r FROM listings WHERE is_active = 1"""
    },
)
def duplicate_pairs_all(spark: SparkSession, folder: str) -> DataFrame:
    """The whole result, not the report's first rows."""
    return S.duplicate_pairs(A.listings(spark, folder), limit=None)


_SETS = r"""SELECT id, w, array_to_string(w, ' ') AS fp FROM (
  SELECT id, list_sort(list_distinct(list_filter(string_split_regex(
    trim(lower(regexp_replace(text, '[^\p{L}\p{N}]', ' ', 'g'))), '\s+'),
    lambda x: x <> ''))) AS w FROM texts)
WHERE len(w) > 0"""
_JACCARD_SQL = """SELECT l.lead AS left, r.lead AS right,
  CAST(p.shared AS DOUBLE) / (len(l.w) + len(r.w) - p.shared) AS score
FROM shared p JOIN leaders l ON l.lead = p.a JOIN leaders r ON r.lead = p.b
WHERE CAST(p.shared AS DOUBLE) / (len(l.w) + len(r.w) - p.shared) >= 0.72
UNION ALL
SELECT l.lead, s.id, CAST(1 AS DOUBLE) FROM sets s JOIN leaders l ON l.fp = s.fp
WHERE s.id <> l.lead"""


def _jaccard_parts(texts: str) -> dict[str, str]:
    return {
        "texts": texts,
        "sets": _SETS,
        "leaders": "SELECT fp, min(id) AS lead, first(w) AS w FROM sets GROUP BY fp",
        "words": "SELECT lead, unnest(w) AS word FROM leaders",
        "shared": """SELECT a.lead AS a, b.lead AS b, count(*) AS shared
FROM words a JOIN words b ON a.word = b.word AND a.lead < b.lead GROUP BY 1, 2""",
    }


@query("jaccard_pairs", _JACCARD_SQL,
       _jaccard_parts("SELECT doc_id AS id, text FROM documents"))
def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return S.jaccard_pairs(A.documents(spark, folder), "doc_id", "text")


@query("jaccard_titles", _JACCARD_SQL,
       _jaccard_parts("SELECT id, source_description AS text FROM listings"))
def jaccard_titles(spark: SparkSession, folder: str) -> DataFrame:
    return S.jaccard_pairs(A.listings(spark, folder), "id", "source_description")
