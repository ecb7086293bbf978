"""Registered owner-state queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import owners as O
from vitrine.plans.registry import query
from vitrine.sources import adapters as A

MIGRATED_AT = "2024-02-01 00:00:00"


def listing_favourites(spark: SparkSession, folder: str) -> DataFrame:
    return O.favourites_fold(A.listing_toggles(spark, folder), "listing_id")


def shop_favourites(spark: SparkSession, folder: str) -> DataFrame:
    return O.favourites_fold(A.shop_toggles(spark, folder), "shop_id")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    arguments = A.search_arguments(spark, folder)
    filters = {name: F.col(name) for name in O.SEARCH_ARGUMENTS}
    return arguments.select(
        "owner_key", "ts", "seq",
        O.saved_search_key(filters).alias("query_string"),
        O.saved_search_name(filters).alias("name"),
    )


def saved(spark: SparkSession, folder: str) -> DataFrame:
    return O.saved_search_upsert(
        A.empty(spark, "anonymous_saved_searches"), requests(spark, folder)
    )


@query("favourites_fold", "SELECT owner_key, listing_id, created_at FROM favourite_listings")
def favourites_fold(spark: SparkSession, folder: str) -> DataFrame:
    return listing_favourites(spark, folder)


@query("favourites_fold_shops", "SELECT owner_key, shop_id, created_at FROM favourite_shops")
def favourites_fold_shops(spark: SparkSession, folder: str) -> DataFrame:
    return shop_favourites(spark, folder)


@query(
    "favourites_list",
    """SELECT f.owner_key, f.listing_id, f.created_at, l.title, s.slug AS shop_slug
FROM favourite_listings f JOIN listings l ON l.id = f.listing_id
JOIN shops s ON s.id = l.source_shop_id""",
)
def favourites_list(spark: SparkSession, folder: str) -> DataFrame:
    return O.favourite_listings(
        listing_favourites(spark, folder), A.listings(spark, folder), A.shops(spark, folder)
    ).select("owner_key", "listing_id", "created_at", "title", "shop_slug")


@query(
    "favourites_list_shops",
    """SELECT f.owner_key, f.shop_id, f.created_at, s.slug, s.name
FROM favourite_shops f JOIN shops s ON s.id = f.shop_id WHERE s.active = 1""",
)
def favourites_list_shops(spark: SparkSession, folder: str) -> DataFrame:
    return O.favourite_shops(shop_favourites(spark, folder), A.shops(spark, folder)).select(
        "owner_key", "shop_id", "created_at", "slug", "name"
    )


@query(
    "favourites_counts",
    """SELECT owner_key, CAST(sum(l) AS BIGINT) AS listings, CAST(sum(s) AS BIGINT) AS shops,
  CAST(sum(q) AS BIGINT) AS searches, CAST(sum(l + s + q) AS BIGINT) AS total
FROM (SELECT owner_key, 1 AS l, 0 AS s, 0 AS q FROM favourite_listings
  UNION ALL SELECT owner_key, 0, 1, 0 FROM favourite_shops
  UNION ALL SELECT owner_key, 0, 0, 1 FROM saved_searches) GROUP BY 1""",
)
def favourites_counts(spark: SparkSession, folder: str) -> DataFrame:
    return O.favourites_counts(
        listing_favourites(spark, folder), shop_favourites(spark, folder), saved(spark, folder)
    )


@query(
    "favourites_migrate",
    f"""SELECT owner_key, listing_id, created_at FROM favourite_listings
UNION ALL SELECT DISTINCT owner_key, k, TIMESTAMP '{MIGRATED_AT}' FROM (
  SELECT sha256(CAST(user_id AS VARCHAR)) AS owner_key, user_id % 10 * {A.ID_STEP} + k AS k
  FROM event_rows WHERE event_type = 'view' AND event_id % 4 <> 0)
WHERE (owner_key, k) NOT IN (SELECT (owner_key, listing_id) FROM favourite_listings)""",
)
def favourites_migrate(spark: SparkSession, folder: str) -> DataFrame:
    """Session favourites from views; a quarter of the values is no number."""
    rows = A.event_rows(A.read(spark, folder, "events")).filter(F.col("event_type") == "view")
    number = (F.col("user_id") % 10 * A.ID_STEP + F.col("k")).cast("string")
    session = rows.select(
        A.owner_of(F.col("user_id")).alias("owner_key"),
        F.when(F.col("event_id") % 4 == 0, F.concat(number, F.lit("x")))
        .otherwise(F.concat(F.lit(" "), number))
        .alias("raw_value"),
    )
    return O.favourites_migrate(
        listing_favourites(spark, folder), session, "listing_id", A.moment(MIGRATED_AT)
    )


@query(
    "identity_upsert",
    """SELECT sha256(CAST(user_id AS VARCHAR)) AS owner_key, min(ts) AS created_at,
  max(ts) AS last_seen_at FROM events GROUP BY 1""",
)
def identity_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Visits of the first half of the month, then those of the second."""
    visits = A.visits(spark, folder)
    middle = A.moment("2024-01-16 00:00:00")
    first = O.identity_upsert(
        A.empty(spark, "anonymous_identities"), visits.filter(F.col("ts") < middle)
    )
    return O.identity_upsert(first, visits.filter(F.col("ts") >= middle))


@query(
    "saved_search_key",
    "SELECT seq, query_string, name FROM search_requests",
)
def saved_search_key(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select("seq", "query_string", "name")


@query(
    "saved_search_upsert",
    "SELECT id, owner_key, name, query_string, created_at, updated_at FROM saved_searches",
)
def saved_search_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return saved(spark, folder)


@query(
    "saved_search_list",
    """SELECT owner_key, id, name, CAST(row_number() OVER (
  PARTITION BY owner_key ORDER BY updated_at DESC, id DESC) AS INTEGER) AS position
FROM saved_searches""",
)
def saved_search_list(spark: SparkSession, folder: str) -> DataFrame:
    """The list's order shown as a position per owner."""
    from pyspark.sql import Window

    newest = Window.partitionBy("owner_key").orderBy(F.col("updated_at").desc(), F.col("id").desc())
    return O.saved_search_list(saved(spark, folder)).select(
        "owner_key", "id", "name", F.row_number().over(newest).alias("position")
    )


@query(
    "saved_search_delete",
    """SELECT id, owner_key, query_string FROM saved_searches
WHERE NOT (id % 3 = 0) OR id % 2 = 0""",
)
def saved_search_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Every third search is deleted, half of them by somebody who does not own it."""
    rows = saved(spark, folder)
    deletions = rows.filter(F.col("id") % 3 == 0).select(
        "id",
        F.when(F.col("id") % 2 == 0, "somebody else").otherwise(F.col("owner_key")).alias(
            "owner_key"
        ),
    )
    return O.saved_search_delete(rows, deletions).select("id", "owner_key", "query_string")
