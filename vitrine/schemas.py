"""Fixed schemas of the catalog tables and of the parsed-listing batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "l": T.LongType(),
    "i": T.IntegerType(),
    "d": T.DoubleType(),
    "s": T.StringType(),
    "t": T.TimestampType(),
    "date": T.DateType(),
}


def _schema(text: str) -> T.StructType:
    fields = (field.split(":") for field in text.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


TABLES: dict[str, T.StructType] = {
    "shops": _schema(
        "id:l slug:s name:s website:s wordmark_text:s wordmark_style:s street_address:s city:s "
        "province:s postal_code:s country:s latitude:d longitude:d public_location_note:s "
        "is_montreal_local:i shipping_summary:s source_type:s crawl_priority:i notes:s "
        "description:s style_focus:s listing_url:s active:i"
    ),
    "listings": _schema(
        "id:l source_shop_id:l source_listing_url:s source_listing_key:s title:s "
        "normalized_title:s price_raw:s price_value:d currency:s primary_image_url:s "
        "additional_image_urls:s availability_status:s shipping_scope:s ships_to_montreal:i "
        "shipping_note:s last_seen_at:t last_checked_at:t first_seen_at:t category:s "
        "subcategory:s designer:s maker:s era:s materials:s dimensions_text:s width:d depth:d "
        "height:d condition_text:s location_text:s source_description:s ingest_source_type:s "
        "parse_confidence:d dedupe_group_id:s is_active:i is_featured:i manual_notes:s "
        "availability_override:s category_override:s"
    ),
    "crawl_runs": _schema(
        "id:l shop_id:l ran_at:t status:s listings_found:i error_message:s"
    ),
    "crawl_failures": _schema("id:l shop_id:l created_at:t error_message:s"),
    "listing_identity_reviews": _schema(
        "id:l shop_id:l created_at:t source_listing_key:s title:s candidate_listing_ids:s "
        "reason:s status:s"
    ),
    "listing_availability_events": _schema(
        "id:l listing_id:l shop_id:l source_listing_key:s observed_at:t from_status:s "
        "to_status:s event_type:s"
    ),
    "listing_price_events": _schema(
        "id:l listing_id:l shop_id:l source_listing_key:s observed_at:t from_price_raw:s "
        "from_price_value:d to_price_raw:s to_price_value:d currency:s event_type:s"
    ),
    "refresh_jobs": _schema(
        "id:l shop_id:l source_slug:s chunk_index:i entry_url:s started_at:t finished_at:t "
        "status:s listings_found:i new_count:i reconciled_count:i hidden_count:i error_message:s"
    ),
    "anonymous_identities": _schema("owner_key:s created_at:t last_seen_at:t"),
    "anonymous_favourite_listings": _schema("owner_key:s listing_id:l created_at:t"),
    "anonymous_favourite_shops": _schema("owner_key:s shop_id:l created_at:t"),
    "anonymous_saved_searches": _schema(
        "id:l owner_key:s name:s query_string:s created_at:t updated_at:t"
    ),
    "analytics_page_views": _schema(
        "view_date:date page_type:s path_key:s lang:s views:l updated_at:t"
    ),
    "design_entities": _schema(
        "id:l canonical_name:s normalized_name:s entity_type:s review_status:s notes:s "
        "created_at:t updated_at:t"
    ),
    "design_entity_aliases": _schema(
        "id:l entity_id:l alias:s normalized_alias:s source:s created_at:t"
    ),
    "listing_design_entity_evidence": _schema(
        "id:l listing_id:l entity_id:l evidence_role:s source_text:s normalized_source_text:s "
        "confidence:d review_status:s created_at:t updated_at:t"
    ),
    "design_entity_candidate_reviews": _schema(
        "id:l source_role:s source_text:s normalized_source_text:s review_status:s entity_id:l "
        "notes:s created_at:t updated_at:t"
    ),
}

# A parsed record as the feeds emit it; only url and title are required.
PARSED = T.StructType(
    [
        *_schema(
            "shop_id:l seq:l source_listing_url:s source_listing_key:s title:s price_raw:s "
            "price_value:d currency:s primary_image_url:s"
        ).fields,
        T.StructField("additional_image_urls", T.ArrayType(T.StringType())),
        *_schema(
            "availability_status:s shipping_scope:s ships_to_montreal:i shipping_note:s "
            "category:s designer:s maker:s era:s materials:s dimensions_text:s condition_text:s "
            "location_text:s source_description:s ingest_source_type:s parse_confidence:d"
        ).fields,
    ]
)


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Read one catalog table under its fixed schema (never inferred)."""
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns in order, casting; a missing column becomes a typed null.

    Timestamps keep the kind they come with (with or without zone).
    """
    present = {name.lower(): kind for name, kind in df.dtypes}
    columns = []
    for field in schema.fields:
        kind = present.get(field.name.lower())
        if kind is None:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif kind == "timestamp_ntz" and isinstance(field.dataType, T.TimestampType):
            columns.append(F.col(field.name))
        elif kind == field.dataType.simpleString():
            columns.append(F.col(field.name))
        else:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*columns)
