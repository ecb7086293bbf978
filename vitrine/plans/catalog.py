"""Registered browse queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import catalog as C
from vitrine.operators import entities as N
from vitrine.operators.owners import favourites_fold
from vitrine.plans.registry import query
from vitrine.schemas import TABLES, conform
from vitrine.sources import adapters as A

LISTING_COLUMNS = TABLES["listings"].fieldNames()
BULK = C.CurationRule(bulk_slug="s2", bulk_last_category="promo")
BRIEF = ["id", "title", "price_value", "effective_availability", "effective_category",
         "shop_slug", "is_montreal_local", "first_seen_at"]
BRIEF_SQL = ", ".join(BRIEF)
CURATED_SQL = """CASE WHEN is_montreal_local = 1 THEN 0
    WHEN shop_slug = 's2' AND effective_category = 'promo' THEN 3
    WHEN shop_slug = 's2' THEN 2 ELSE 1 END"""


def rows_for(
    spark: SparkSession, folder: str, spec: C.FilterSpec, include_inactive: bool = False
) -> DataFrame:
    designer_values = search_values = None
    if spec.designer or spec.q:
        entities = A.design_entities(spark, folder)
        aliases = A.design_entity_aliases(spark, folder)
        designer_values = N.texts_of_name(spec.designer, entities, aliases)
        search_values = N.texts_of_name(spec.q, entities, aliases)
    return C.browse(
        A.listings(spark, folder),
        A.shops(spark, folder),
        A.availability_events(spark, folder),
        spec,
        include_inactive=include_inactive,
        designer_values=designer_values,
        search_values=search_values,
        shops_bound=A.shops_bound(spark, folder),
    )


def spec(**filters: str) -> C.FilterSpec:
    return C.FilterSpec.from_args(filters, BULK)


@query("scan_catalog", "SELECT * FROM listings")
def scan_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return conform(A.listings(spark, folder), TABLES["listings"])


@query("scan_shops", "SELECT * FROM shops")
def scan_shops(spark: SparkSession, folder: str) -> DataFrame:
    return conform(A.shops(spark, folder), TABLES["shops"])


@query(
    "effective_values",
    "SELECT id, effective_availability, effective_category FROM effective",
)
def effective_values(spark: SparkSession, folder: str) -> DataFrame:
    return C.with_effective_values(A.listings(spark, folder)).select(
        "id", "effective_availability", "effective_category"
    )


@query(
    "visible_listings",
    """SELECT id, availability_status, availability_override FROM effective e
WHERE is_active = 1 AND effective_availability <> 'removed'
  AND (effective_availability <> 'sold_out' OR availability_override = 'sold_out'
    OR EXISTS (SELECT 1 FROM availability_events a WHERE a.listing_id = e.id
      AND a.from_status = 'available' AND a.to_status = 'sold_out'))""",
)
def visible_listings(spark: SparkSession, folder: str) -> DataFrame:
    return C.visible_listings(
        A.listings(spark, folder), A.availability_events(spark, folder)
    ).select("id", "availability_status", "availability_override")


@query(
    "facet_filters",
    f"""SELECT {BRIEF_SQL} FROM visible
WHERE contains(lower(location_text), 'nation_1') AND effective_category = 'promo'
  AND contains(lower(materials), 'red') AND ships_to_montreal = 1
  AND price_value >= 5000.5 AND price_value <= 90000""",
)
def facet_filters(spark: SparkSession, folder: str) -> DataFrame:
    filters = spec(
        location=" Nation_1 ", category="promo", material="RED", ships_to_montreal="1",
        availability="all", price_min="5000.5", price_max="9e4",
    )
    return rows_for(spark, folder, filters).select(*BRIEF)


@query(
    "facet_filters_fallback",
    f"""SELECT {BRIEF_SQL} FROM visible
WHERE shop_slug = 's1' AND effective_availability = 'available'""",
)
def facet_filters_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Bad prices are ignored, an unknown availability and sort fall back."""
    filters = spec(shop="s1", availability="gone", price_min="cheap", price_max="nan", sort="x")
    return rows_for(spark, folder, filters).select(*BRIEF)


@query(
    "designer_filter",
    f"""SELECT {BRIEF_SQL}, designer, maker FROM visible
WHERE effective_availability = 'available' AND (
  contains(lower(designer), 'brand#3') OR contains(lower(maker), 'brand#3')
  OR contains(lower(designer), 'by brand#3') OR contains(lower(maker), 'by brand#3'))""",
)
def designer_filter(spark: SparkSession, folder: str) -> DataFrame:
    return rows_for(spark, folder, spec(designer="By Brand#3")).select(
        *BRIEF, "designer", "maker"
    )


@query("designer_filter_unusable", f"SELECT {BRIEF_SQL} FROM visible WHERE false")
def designer_filter_unusable(spark: SparkSession, folder: str) -> DataFrame:
    """A name without usable alias matches nothing."""
    return rows_for(spark, folder, spec(designer="---")).select(*BRIEF)


_FIELDS = ("title", "designer", "maker", "effective_category", "materials", "source_description")


def _term(term: str) -> str:
    return "(" + " OR ".join(f"contains(lower({f}), '{term}')" for f in _FIELDS) + ")"


@query(
    "search_synonyms",
    f"""SELECT {BRIEF_SQL} FROM visible
WHERE {_term('red')} AND ({_term('lamp')} OR {_term('lamps')} OR {_term('lampe')}
  OR {_term('lampes')} OR {_term('ring')}) AND {_term('ring')}""",
)
def search_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    return rows_for(
        spark, folder, spec(q="Réd ring's red RING", availability="all").with_(q="Réd ring")
    ).select(*BRIEF)


@query(
    "search_entity_alias",
    f"""SELECT {BRIEF_SQL}, maker FROM visible
WHERE effective_availability = 'available'
  AND (({_term('by')} AND {_term('brand')} AND {_term('6')})
    OR contains(lower(designer), 'brand#6') OR contains(lower(maker), 'brand#6'))""",
)
def search_entity_alias(spark: SparkSession, folder: str) -> DataFrame:
    return rows_for(spark, folder, spec(q="by Brand#6")).select(*BRIEF, "maker")


def _score(terms: list[list[str]]) -> str:
    weights = (("title", 16), ("designer", 12), ("maker", 12), ("effective_category", 10),
               ("materials", 8), ("source_description", 3))
    parts = [
        f"CASE WHEN {' OR '.join(f'''contains(lower({f}), '{t}')''' for t in group)} THEN {w} "
        "ELSE 0 END"
        for group in terms
        for f, w in weights
    ]
    return " + ".join(parts)


@query(
    "search_rank",
    f"""SELECT {BRIEF_SQL}, CAST({_score([['red'], ['promo']])} AS INTEGER) AS score FROM visible
WHERE effective_availability = 'available' AND {_term('red')} AND {_term('promo')}
ORDER BY score DESC, {CURATED_SQL}, first_seen_at DESC, id LIMIT 100""",
)
def search_rank(spark: SparkSession, folder: str) -> DataFrame:
    filters = spec(q="red promo")
    rows = rows_for(spark, folder, filters).withColumn("score", C.search_score(filters.q))
    return C.page_listings(rows, filters, 100).select(*BRIEF, "score")


@query(
    "lookup_by_key",
    """SELECT l.id, title, l.is_active, s.slug AS shop_slug, s.website AS shop_website
FROM listings l JOIN shops s ON s.id = source_shop_id
WHERE l.id IN (SELECT listing_id FROM listing_toggles)""",
)
def lookup_by_key(spark: SparkSession, folder: str) -> DataFrame:
    keys = A.listing_toggles(spark, folder).select(F.col("listing_id").alias("id"))
    return C.lookup_listings(keys, A.listings(spark, folder), A.shops(spark, folder)).select(
        "id", "title", "is_active", "shop_slug", "shop_website"
    )


@query(
    "lookup_shops",
    """SELECT id, slug, name FROM shops
WHERE active = 1 AND slug IN (SELECT source_slug FROM jobs)""",
)
def lookup_shops(spark: SparkSession, folder: str) -> DataFrame:
    keys = A.refresh_jobs(spark, folder).select(F.col("source_slug").alias("slug"))
    return C.lookup_shops(keys, A.shops(spark, folder), "slug").select("id", "slug", "name")


@query(
    "listing_detail",
    """SELECT l.id, l.title, s.slug AS shop_slug,
  coalesce((SELECT string_agg(strftime(observed_at, '%Y-%m-%d') || ' ' || to_status, ';'
      ORDER BY observed_at DESC, e.id DESC) FROM last_availability e WHERE e.listing_id = l.id), '')
    AS availability_history,
  coalesce((SELECT string_agg(strftime(observed_at, '%Y-%m-%d'), ';'
      ORDER BY observed_at DESC, e.id DESC) FROM last_prices e WHERE e.listing_id = l.id), '')
    AS price_history
FROM effective l JOIN shops s ON s.id = source_shop_id
WHERE s.active = 1 AND l.is_active = 1 AND effective_availability <> 'removed'""",
    {
        "last_availability": """SELECT * FROM availability_events QUALIFY row_number() OVER (
  PARTITION BY listing_id ORDER BY observed_at DESC, id DESC) <= 12""",
        "last_prices": """SELECT * FROM price_events QUALIFY row_number() OVER (
  PARTITION BY listing_id ORDER BY observed_at DESC, id DESC) <= 12""",
    },
)
def listing_detail(spark: SparkSession, folder: str) -> DataFrame:
    changes = A.logged_changes(spark, folder)
    detail = C.listing_detail(
        A.listings(spark, folder), A.shops(spark, folder),
        A.availability_events(spark, folder, changes), A.price_events(spark, folder, changes),
    )

    def day(entry):
        return F.date_format(entry["observed_at"], "yyyy-MM-dd")

    def text(entries, render):
        return F.coalesce(F.array_join(F.transform(entries, render), ";"), F.lit(""))

    return detail.select(
        "id", "title", "shop_slug",
        text("availability_history", lambda e: F.concat_ws(" ", day(e), e["to_status"])).alias(
            "availability_history"
        ),
        text("price_history", day).alias("price_history"),
    )


@query(
    "favourite_flag",
    """SELECT v.id, CAST(f.listing_id IS NOT NULL AS INTEGER) AS is_favourited FROM visible v
LEFT JOIN (SELECT DISTINCT listing_id FROM favourite_listings
  WHERE owner_key = sha256('7')) f ON f.listing_id = v.id""",
)
def favourite_flag(spark: SparkSession, folder: str) -> DataFrame:
    favourites = favourites_fold(A.listing_toggles(spark, folder), "listing_id").select(
        "owner_key", F.col("listing_id").alias("id")
    )
    owner = "7902699be42c8a8e46fbbb4501726517e86b22c56a189f7625a6da49081b2451"
    rows = rows_for(spark, folder, spec(availability="all"))
    return C.with_favourite_flag(rows, favourites, owner).select("id", "is_favourited")


@query(
    "count_listings",
    "SELECT count(*) AS count FROM visible WHERE effective_category = 'promo'",
)
def count_listings(spark: SparkSession, folder: str) -> DataFrame:
    return C.count_listings(rows_for(spark, folder, spec(category="promo", availability="all")))


def _page(name: str, order: str, offset: int, **filters: str) -> None:
    @query(
        name,
        f"""SELECT {BRIEF_SQL} FROM visible WHERE effective_availability = 'available'
ORDER BY {order}, id LIMIT 48 OFFSET {offset}""",
    )
    def page(spark: SparkSession, folder: str) -> DataFrame:
        chosen = spec(**filters)
        rows = rows_for(spark, folder, chosen)
        return C.page_listings(rows, chosen, offset=offset).select(*BRIEF)


_page("curated_order", f"{CURATED_SQL}, first_seen_at DESC", 0)
_page("sort_newest", "first_seen_at DESC", 0, sort="newest")
_page("sort_recent_check", "last_checked_at DESC", 48, sort="recent_check")
_page("sort_price_low", "price_value ASC NULLS LAST", 0, sort="price_low")
_page("sort_price_high", "price_value DESC NULLS LAST", 96, sort="price_high")
_page("sort_recent_source", "last_seen_at DESC", 0, sort="recent_source")


@query(
    "sort_variants",
    f"""SELECT {BRIEF_SQL} FROM visible ORDER BY price_value DESC NULLS LAST, id""",
)
def sort_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The whole result in order, as without a limit."""
    chosen = spec(sort="price_high", availability="all")
    return C.page_listings(rows_for(spark, folder, chosen), chosen, None).select(*BRIEF)


@query(
    "page_listings",
    f"""SELECT {BRIEF_SQL}, CAST((SELECT count(*) FROM visible) > 480 AS INTEGER) AS has_more
FROM visible ORDER BY {CURATED_SQL}, first_seen_at DESC, id LIMIT 48 OFFSET 432""",
)
def page_listings(spark: SparkSession, folder: str) -> DataFrame:
    chosen = spec(availability="all")
    return C.page_with_more(rows_for(spark, folder, chosen), chosen, offset=432).select(
        *BRIEF, "has_more"
    )


@query(
    "page_admin",
    f"""SELECT {BRIEF_SQL}, last_checked_at FROM (
  SELECT e.*, s.slug AS shop_slug, s.is_montreal_local FROM effective e
  JOIN shops s ON s.id = e.source_shop_id WHERE s.active = 1)
ORDER BY last_checked_at DESC, id LIMIT 40""",
)
def page_admin(spark: SparkSession, folder: str) -> DataFrame:
    chosen = spec(availability="all", sort="recent_check")
    rows = rows_for(spark, folder, chosen, include_inactive=True)
    return C.page_listings(rows, chosen, 40).select(*BRIEF, "last_checked_at")


@query(
    "page_after",
    """SELECT id, last_checked_at FROM visible
WHERE effective_availability = 'available' AND last_checked_at <= TIMESTAMP '1999-06-01'
  AND (last_checked_at < TIMESTAMP '1999-06-01' OR id > 5000000000)
ORDER BY last_checked_at DESC, id LIMIT 48""",
)
def page_after(spark: SparkSession, folder: str) -> DataFrame:
    rows = rows_for(spark, folder, spec())
    seen = A.moment("1999-06-01 00:00:00")
    return C.page_after(rows, "last_checked_at", seen, 5_000_000_000).select(
        "id", "last_checked_at"
    )


@query(
    "listing_events_latest",
    """SELECT id, listing_id, observed_at, from_status, to_status FROM availability_events
QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, id DESC) <= 12""",
)
def listing_events_latest(spark: SparkSession, folder: str) -> DataFrame:
    return C.listing_events_latest(A.availability_events(spark, folder)).select(
        "id", "listing_id", "observed_at", "from_status", "to_status"
    )


@query(
    "price_events_latest",
    """SELECT id, listing_id, observed_at, from_price_value, to_price_value, event_type
FROM price_events
QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, id DESC) <= 12""",
)
def price_events_latest(spark: SparkSession, folder: str) -> DataFrame:
    return C.listing_events_latest(A.price_events(spark, folder)).select(
        "id", "listing_id", "observed_at", "from_price_value", "to_price_value", "event_type"
    )


@query(
    "update_overrides",
    """SELECT l.id,
  CASE WHEN t.id IS NULL THEN category_override ELSE 'art' END AS category_override,
  CASE WHEN t.id IS NULL THEN availability_override ELSE 'reserved' END AS availability_override,
  CASE WHEN t.id IS NULL THEN is_featured ELSE 1 END AS is_featured,
  CASE WHEN t.id IS NULL THEN manual_notes ELSE 'seen ' || t.n || ' times' END AS manual_notes
FROM listings l LEFT JOIN (
  SELECT listing_id AS id, count(*) AS n FROM listing_toggles GROUP BY 1) t ON t.id = l.id""",
)
def update_overrides(spark: SparkSession, folder: str) -> DataFrame:
    overrides = (
        A.listing_toggles(spark, folder)
        .groupBy(F.col("listing_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "id", F.lit("art").alias("category_override"),
            F.lit("reserved").alias("availability_override"), F.lit(1).alias("is_featured"),
            F.concat(F.lit("seen "), F.col("n").cast("string"), F.lit(" times")).alias(
                "manual_notes"
            ),
        )
    )
    return C.update_overrides(A.listings(spark, folder), overrides).select(
        "id", "category_override", "availability_override", "is_featured", "manual_notes"
    )
