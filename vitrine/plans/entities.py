"""Registered entity-resolution queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import entities as N
from vitrine.plans.registry import query
from vitrine.session import materialized
from vitrine.sources import adapters as A

AS_OF = "2002-01-01 00:00:00"
KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
PARTS = {
    "house_ids": """SELECT n, (SELECT max(id) FROM entities)
  + row_number() OVER (ORDER BY 'house ' || n) AS id FROM brands WHERE n % 3 = 1""",
    "entities_after": f"""SELECT id, canonical_name, normalized_name, entity_type, review_status, notes,
  created_at, updated_at FROM entities
UNION ALL SELECT id, 'House ' || n, 'house ' || n,
  CASE WHEN n % 2 = 0 THEN 'maker' ELSE 'creator' END, 'approved', 'ok',
  TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' FROM house_ids""",
    "new_aliases": """SELECT h.id AS entity_id, t.alias, t.key FROM (
  SELECT n, 'House ' || n AS alias, 'house ' || n AS key FROM brands
  UNION ALL SELECT n, p_brand, 'brand ' || n FROM brands
  UNION ALL SELECT n, p_brand || ' Works', 'brand ' || n || ' works' FROM brands) t
JOIN house_ids h ON h.n = t.n""",
    "aliases_after": f"""SELECT id, entity_id, alias, normalized_alias, source, created_at FROM aliases
UNION ALL SELECT (SELECT max(id) FROM aliases) + row_number() OVER (ORDER BY key), entity_id, alias,
  key, 'admin', TIMESTAMP '{AS_OF}' FROM new_aliases""",
    "evidence_after": f"""SELECT (row_number() OVER (
    ORDER BY l.id, h.id, 'designer', 'brand ' || h.n)) AS id, l.id AS listing_id,
  h.id AS entity_id, 'designer' AS evidence_role, l.designer AS source_text,
  'brand ' || h.n AS normalized_source_text, CAST(1 AS DOUBLE) AS confidence,
  'approved' AS review_status, TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at
FROM listings l JOIN brands b ON b.p_brand = l.designer JOIN house_ids h ON h.n = b.n
WHERE l.is_active = 1""",
    "reviews_after": f"""SELECT row_number() OVER (ORDER BY 'brand ' || b.n) AS id,
  'designer' AS source_role, p_brand AS source_text, 'brand ' || b.n AS normalized_source_text,
  'rejected' AS review_status, CAST(NULL AS BIGINT) AS entity_id, '' AS notes,
  TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at
FROM brands b WHERE b.n % 3 = 2""",
}


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return A.design_entities(spark, folder), A.design_entity_aliases(spark, folder)


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    return N.entity_reject(
        A.empty(spark, "design_entity_candidate_reviews"), A.rejections(spark, folder),
        A.moment(AS_OF),
    )


def approved(spark: SparkSession, folder: str) -> N.EntityOutput:
    entities, aliases = tables(spark, folder)
    return N.entity_approve(
        entities,
        aliases,
        A.empty(spark, "listing_design_entity_evidence"),
        A.empty(spark, "design_entity_candidate_reviews"),
        A.listings(spark, folder),
        A.approvals(spark, folder),
        A.moment(AS_OF),
    )


@query("entity_upsert", "SELECT * FROM entities_after", PARTS)
def entity_upsert(spark: SparkSession, folder: str) -> DataFrame:
    entities, aliases = tables(spark, folder)
    decisions = A.approvals(spark, folder).select(
        "seq", "canonical_name", "entity_type", "aliases", "notes"
    )
    return N.entity_upsert(entities, aliases, decisions, A.moment(AS_OF))[0]


@query(
    "entity_upsert_aliases",
    """SELECT a.id, CASE WHEN named AND next.id IS NOT NULL THEN next.id ELSE entity_id END AS entity_id,
  CASE WHEN named AND next.id IS NOT NULL THEN 'brand' || substr(alias, 6) ELSE alias END AS alias,
  normalized_alias,
  CASE WHEN named AND (next.id IS NOT NULL OR previous.id IS NOT NULL) THEN 'admin' ELSE 'seed' END
    AS source
FROM (SELECT *, normalized_alias = 'brand ' || entity_id AS named FROM aliases) a
LEFT JOIN entities next ON next.id = a.entity_id + 3
LEFT JOIN entities previous ON previous.id = a.entity_id - 3""",
)
def entity_upsert_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity takes over the name of the one before it; the later decision wins."""
    entities, aliases = tables(spark, folder)
    decisions = entities.select(F.col("id"), "canonical_name", "entity_type", "notes").join(
        entities.select(
            (F.col("id") + 3).alias("id"),
            F.array(
                F.concat(F.lit("brand"), F.expr("substr(canonical_name, 6)"))
            ).alias("aliases"),
        ),
        "id",
    ).withColumn("seq", F.col("id"))
    _, after = N.entity_upsert(
        entities, aliases, decisions.drop("id"), A.moment(AS_OF)
    )
    return after.select("id", "entity_id", "alias", "normalized_alias", "source")


@query("entity_alias_map", "SELECT alias_key, canonical_name FROM alias_map")
def entity_alias_map(spark: SparkSession, folder: str) -> DataFrame:
    return N.entity_alias_map(*tables(spark, folder))


@query(
    "entity_query_values",
    """SELECT DISTINCT value, alias FROM (
  SELECT p_brand AS value, p_brand AS alias FROM brands
  UNION ALL SELECT b.p_brand, a.alias FROM brands b JOIN aliases a ON a.entity_id = b.n)""",
)
def entity_query_values(spark: SparkSession, folder: str) -> DataFrame:
    entities, aliases = tables(spark, folder)
    names = A.read(spark, folder, "part").select(F.col("p_brand").alias("value"))
    return N.query_values(names, entities, aliases)


@query(
    "entity_candidates",
    f"""SELECT source_text, source_role, listing_count FROM (
  SELECT source_text, source_role, count(*) AS listing_count FROM (
    SELECT designer AS source_text, 'designer' AS source_role FROM listings WHERE is_active = 1
    UNION ALL SELECT maker, 'maker' FROM listings WHERE is_active = 1)
  WHERE source_text <> '' GROUP BY 1, 2)
WHERE {KEY.format('source_text')} NOT IN (SELECT alias_key FROM alias_map)
  AND (source_role, {KEY.format('source_text')})
    NOT IN (SELECT (source_role, normalized_source_text) FROM reviews_after)
ORDER BY listing_count DESC, source_text, source_role LIMIT 20""",
    PARTS,
)
def entity_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return N.entity_candidates(
        A.listings(spark, folder), N.entity_alias_map(*tables(spark, folder)),
        rejected(spark, folder),
    )


@query("entity_approve", "SELECT * FROM aliases_after", PARTS)
def entity_approve(spark: SparkSession, folder: str) -> DataFrame:
    return approved(spark, folder).aliases


@query(
    "entity_approve_reviews",
    """SELECT source_text, source_role, review_status, entity_id, notes FROM (
  SELECT p_brand AS source_text, 'designer' AS source_role, 'approved' AS review_status,
    h.id AS entity_id, 'ok' AS notes FROM brands b JOIN house_ids h ON h.n = b.n)""",
    PARTS,
)
def entity_approve_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return approved(spark, folder).reviews.select(
        "source_text", "source_role", "review_status", "entity_id", "notes"
    )


@query("entity_reject", "SELECT * FROM reviews_after", PARTS)
def entity_reject(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(spark, folder)


@query("entity_evidence", "SELECT * FROM evidence_after", PARTS)
def entity_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return approved(spark, folder).evidence


@query(
    "entity_index",
    """SELECT e.id, canonical_name, entity_type, review_status, notes,
  (SELECT string_agg(alias, '|' ORDER BY alias) FROM aliases_after a WHERE a.entity_id = e.id)
    AS aliases,
  (SELECT count(*) FROM aliases_after a WHERE a.entity_id = e.id) AS alias_count,
  (SELECT count(*) FROM evidence_after v WHERE v.entity_id = e.id) AS evidence_count,
  (SELECT count(DISTINCT listing_id) FROM evidence_after v WHERE v.entity_id = e.id)
    AS listing_count
FROM entities_after e
WHERE contains(normalized_name, 'brand 1') OR EXISTS (SELECT 1 FROM aliases_after a
  WHERE a.entity_id = e.id AND contains(normalized_alias, 'brand 1'))
ORDER BY canonical_name, e.id LIMIT 100""",
    PARTS,
)
def entity_index(spark: SparkSession, folder: str) -> DataFrame:
    after = approved(spark, folder)
    index = N.entity_index(
        materialized(after.entities), materialized(after.aliases), materialized(after.evidence),
        F.lit("brand 1"),
    )
    return index.withColumn("aliases", F.array_join("aliases", "|"))


@query(
    "canonicalize_listings",
    f"""SELECT l.id, coalesce(d.canonical_name, l.designer) AS designer_canonical,
  coalesce(m.canonical_name, l.maker) AS maker_canonical
FROM listings l
LEFT JOIN alias_map d ON d.alias_key = {KEY.format('l.designer')}
LEFT JOIN alias_map m ON m.alias_key = {KEY.format('l.maker')}""",
)
def canonicalize_listings(spark: SparkSession, folder: str) -> DataFrame:
    return N.canonicalize_listings(
        A.listings(spark, folder), N.entity_alias_map(*tables(spark, folder))
    ).select("id", "designer_canonical", "maker_canonical")
