"""The test tables seen as catalog tables.

Each function derives one catalog table from the parquet files in a folder, over all their rows.
``plans.oracle`` states the same definitions in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import filter_key, normalize_title
from vitrine.operators.skew import lag_in_buckets, latest
from vitrine.schemas import TABLES, conform
from vitrine.session import broadcast_if_small, materialized

ID_STEP = 1_000_000_000  # listing id = shop id * step + part id
NEW_ID_STEP = 500_000_000
REFRESH_FROM = "1999-01-01 00:00:00"
REFRESH_AT = "2002-01-01 00:00:00"  # when the refresh runs; it sees all later states
JOBS_DAY = "2001-06-01 12:00:00"
SHIPPING = (
    "Ships worldwide, quote on request",
    "International shipping",
    "Canada and United States",
    "Across Canada",
    "Local pickup",
)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages")


def moment(text: str) -> Column:
    """Timestamp literal without zone, as the test tables have them."""
    return F.lit(text).cast("timestamp_ntz")


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def pick(key: Column, options: tuple[str, ...]) -> Column:
    """The option at ``key`` modulo their number."""
    chain = F
    for index, option in enumerate(options):
        chain = chain.when(key % len(options) == index, F.lit(option))
    return chain


def shops_bound(spark: SparkSession, folder: str) -> DataFrame:
    """The scan that has one row per shop: proves the size of ``shops``."""
    return read(spark, folder, "supplier")


def shops(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = read(spark, folder, "nation"), read(spark, folder, "region")
    rows = read(spark, folder, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    ).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    share = (key % 100).cast("double") / 100
    return conform(
        rows.select(
            key.alias("id"),
            F.concat(F.lit("s"), _text(key)).alias("slug"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("https://s"), _text(key), F.lit(".example.com")).alias("website"),
            F.lit("").alias("wordmark_text"),
            F.lit("").alias("wordmark_style"),
            F.when(key % 3 == 0, "")
            .otherwise(F.concat(_text(key), F.lit(" Main Street")))
            .alias("street_address"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("province"),
            F.concat(F.lit("H"), _text(key % 10), F.lit("A")).alias("postal_code"),
            F.lit("Canada").alias("country"),
            F.when(key % 4 != 0, F.lit(45.0) + share).alias("latitude"),
            F.when(key % 4 != 0, F.lit(-73.0) - share).alias("longitude"),
            F.lit("").alias("public_location_note"),
            (F.col("n_regionkey") == 1).cast("int").alias("is_montreal_local"),
            pick(key, SHIPPING).alias("shipping_summary"),
            F.lit("shop").alias("source_type"),
            (key % 3 + 1).cast("int").alias("crawl_priority"),
            F.lit("").alias("notes"),
            F.concat(F.lit("Shop "), "s_name").alias("description"),
            F.lit("").alias("style_focus"),
            F.concat(F.lit("https://s"), _text(key), F.lit(".example.com/shop")).alias(
                "listing_url"
            ),
            (F.col("s_acctbal") >= 0).cast("int").alias("active"),
        ),
        TABLES["shops"],
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Observed states of listings, one per line item."""
    status = (
        F.when(F.col("l_returnflag") == "R", "sold_out")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "removed")
        .otherwise("available")
    )
    return read(spark, folder, "lineitem").select(
        (F.col("l_suppkey") * ID_STEP + F.col("l_partkey")).alias("listing_id"),
        F.col("l_suppkey").alias("shop_id"),
        F.col("l_partkey").alias("part_id"),
        status.alias("status"),
        F.when(F.col("l_quantity") >= 5, F.col("l_extendedprice")).alias("price"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
    )


ORDER = ["ts", "ok", "ln"]


def price_raw(price: Column) -> Column:
    return F.when(
        price.isNotNull(), F.concat(F.lit("$"), F.format_string("%.2f", price), F.lit(" CAD"))
    ).otherwise("")


def image_url(part: Column) -> Column:
    return F.when(part % 26 == 0, "").otherwise(
        F.concat(F.lit("https://img.example.com/"), _text(part), F.lit(".jpg"))
    )


def description(part: Column) -> Column:
    return F.when(part % 26 == 0, F.col("p_name")).otherwise(
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" #"), _text(part))
    )


def listings_from(spark: SparkSession, folder: str, states: DataFrame) -> DataFrame:
    """Catalog listings as of the last of the given states.

    Two joins with dimensions (parts, shop places); both sides' sizes are left to the optimizer.
    """
    last = states.groupBy("listing_id", "shop_id", "part_id").agg(
        F.max(F.struct(*ORDER, "status", "price")).alias("s"),
        F.min("ts").alias("first_seen_at"),
    ).withColumn("last_seen_at", F.col("s.ts"))
    places = shops(spark, folder).select(
        F.col("id").alias("shop_id"),
        F.concat_ws(", ", "city", "province").alias("location_text"),
        F.col("shipping_summary").alias("shipping_note"),
    )
    part = read(spark, folder, "part")
    rows = last.join(part, F.col("part_id") == F.col("p_partkey")).join(
        broadcast_if_small(places, shops_bound(spark, folder)), "shop_id"
    )
    key = F.col("part_id")
    size = F.col("p_size")
    status = F.col("s.status")
    return conform(
        rows.select(
            F.col("listing_id").alias("id"),
            F.col("shop_id").alias("source_shop_id"),
            F.concat(
                F.lit("https://s"), _text("shop_id"), F.lit(".example.com/p/"), _text(key)
            ).alias("source_listing_url"),
            F.concat(F.lit("p"), _text(key)).alias("source_listing_key"),
            F.col("p_name").alias("title"),
            normalize_title(F.col("p_name")).alias("normalized_title"),
            price_raw(F.col("s.price")).alias("price_raw"),
            F.col("s.price").alias("price_value"),
            F.lit("CAD").alias("currency"),
            image_url(key).alias("primary_image_url"),
            F.lit("[]").alias("additional_image_urls"),
            status.alias("availability_status"),
            F.lit("canada").alias("shipping_scope"),
            (size % 2).cast("int").alias("ships_to_montreal"),
            F.when(size % 5 == 0, "").otherwise(F.col("shipping_note")).alias("shipping_note"),
            F.col("last_seen_at"),
            F.col("last_seen_at").alias("last_checked_at"),
            F.col("first_seen_at"),
            F.lower("p_type").alias("category"),
            F.lit("").alias("subcategory"),
            F.col("p_brand").alias("designer"),
            F.when(size % 4 == 0, F.concat("p_brand", F.lit(" Works"))).otherwise("").alias(
                "maker"
            ),
            F.concat(F.lit("19"), _text(40 + 10 * (size % 5)), F.lit("s")).alias("era"),
            F.replace("p_name", F.lit(" "), F.lit(", ")).alias("materials"),
            F.lit("").alias("dimensions_text"),
            pick(size, ("Restored", "Restored, Refinished", "")).alias("condition_text"),
            F.col("location_text"),
            description(key).alias("source_description"),
            F.lit("refresh").alias("ingest_source_type"),
            F.lit(0.86).alias("parse_confidence"),
            F.lit("").alias("dedupe_group_id"),
            (status != "removed").cast("int").alias("is_active"),
            F.lit(0).alias("is_featured"),
            F.lit("").alias("manual_notes"),
            F.when(key % 97 == 0, "sold_out").otherwise("").alias("availability_override"),
            F.when(key % 31 == 0, "lighting").otherwise("").alias("category_override"),
        ),
        TABLES["listings"],
    )


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return listings_from(spark, folder, history(spark, folder))


def state_changes(spark: SparkSession, folder: str) -> DataFrame:
    """History rows with the previous state of the same listing.

    Windowed per listing and month, so a listing with very many states is spread.
    """
    return lag_in_buckets(
        history(spark, folder), "listing_id", F.date_trunc("MONTH", "ts"), ORDER,
        ["status", "price"],
    ).withColumn("id", F.col("ok") * 10 + F.col("ln"))


def _status_changed() -> Column:
    return F.col("is_first") | (F.col("status") != F.col("prev_status"))


def _price_changed() -> Column:
    first = F.col("is_first")
    changed = ~F.col("price").eqNullSafe(F.col("prev_price"))
    return (first & F.col("price").isNotNull()) | (~first & changed)


def logged_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The state changes that are in one of the two logs, written once for a reader of both."""
    return materialized(state_changes(spark, folder).filter(_status_changed() | _price_changed()))


def availability_events(
    spark: SparkSession, folder: str, changes: DataFrame | None = None
) -> DataFrame:
    """``changes``: ``logged_changes``, if the caller has them."""
    rows = (state_changes(spark, folder) if changes is None else changes).filter(_status_changed())
    return rows.select(
        "id", "listing_id", "shop_id",
        F.concat(F.lit("p"), _text("part_id")).alias("source_listing_key"),
        F.col("ts").alias("observed_at"),
        F.coalesce("prev_status", F.lit("")).alias("from_status"),
        F.col("status").alias("to_status"),
        F.when(F.col("is_first"), "discovered").otherwise("source_refresh").alias("event_type"),
    )


def price_events(spark: SparkSession, folder: str, changes: DataFrame | None = None) -> DataFrame:
    """``changes``: ``logged_changes``, if the caller has them."""
    rows = (state_changes(spark, folder) if changes is None else changes).filter(_price_changed())
    return rows.select(
        "id", "listing_id", "shop_id",
        F.concat(F.lit("p"), _text("part_id")).alias("source_listing_key"),
        F.col("ts").alias("observed_at"),
        price_raw(F.col("prev_price")).alias("from_price_raw"),
        F.col("prev_price").alias("from_price_value"),
        price_raw(F.col("price")).alias("to_price_raw"),
        F.col("price").alias("to_price_value"),
        F.lit("CAD").alias("currency"),
        F.when(F.col("is_first"), "discovered").otherwise("source_refresh").alias("event_type"),
    )


# --- refresh ------------------------------------------------------------------------------------


def prior_listings(spark: SparkSession, folder: str) -> DataFrame:
    """The stored catalog before the refresh window."""
    states = history(spark, folder).filter(F.col("ts") < moment(REFRESH_FROM))
    return listings_from(spark, folder, states)


def refresh_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The crawl: the last state of every listing seen since; some keys have drifted."""
    window = history(spark, folder).filter(F.col("ts") >= moment(REFRESH_FROM))
    rows = latest(window, ["listing_id"], ORDER).join(
        read(spark, folder, "part"), F.col("part_id") == F.col("p_partkey")
    )
    key = F.col("part_id")
    return rows.select(
        "shop_id",
        key.alias("seq"),
        F.concat(
            F.lit("https://s"), _text("shop_id"), F.lit(".example.com/p/"), _text(key)
        ).alias("source_listing_url"),
        F.concat(F.lit("p"), _text(key), F.when(key % 13 == 0, "-v2").otherwise("")).alias(
            "source_listing_key"
        ),
        F.col("p_name").alias("title"),
        price_raw(F.col("price")).alias("price_raw"),
        F.col("price").alias("price_value"),
        F.lit("CAD").alias("currency"),
        image_url(key).alias("primary_image_url"),
        F.array().cast("array<string>").alias("additional_image_urls"),
        F.when(F.col("status") == "sold_out", "sold_out").otherwise("available").alias(
            "availability_status"
        ),
        F.lit("canada").alias("shipping_scope"),
        F.lit(1).alias("ships_to_montreal"),
        F.lit(None).cast("string").alias("shipping_note"),
        F.lower("p_type").alias("category"),
        F.col("p_brand").alias("designer"),
        F.lit(None).cast("string").alias("maker"),
        F.lit(None).cast("string").alias("era"),
        F.replace("p_name", F.lit(" "), F.lit(", ")).alias("materials"),
        F.lit(None).cast("string").alias("dimensions_text"),
        F.lit(None).cast("string").alias("condition_text"),
        F.lit(None).cast("string").alias("location_text"),
        description(key).alias("source_description"),
        F.lit("live_fetch").alias("ingest_source_type"),
        F.lit(0.86).alias("parse_confidence"),
    )


def crawls(spark: SparkSession, folder: str) -> DataFrame:
    """One crawl per shop; some failed, some saw only a part."""
    key = F.col("id")
    return shops(spark, folder).select(
        key.alias("shop_id"),
        F.col("slug").alias("source_slug"),
        F.when(key % 10 == 7, 0).otherwise(1).alias("authoritative"),
        F.when(key % 10 == 3, "timeout").otherwise("").alias("error"),
        F.lit(None).cast("int").alias("chunk_index"),
        F.lit("").alias("entry_url"),
    )


def refresh_new_id() -> Column:
    return F.col("shop_id") * ID_STEP + NEW_ID_STEP + F.col("seq")


def refresh_jobs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    started = F.col("o_orderdate") + F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))
    status = (
        F.when(F.col("o_orderstatus") == "F", "success")
        .when(F.col("o_orderstatus") == "O", "warning")
        .otherwise("running")
    )
    shop = F.col("o_custkey") % 10
    rows = read(spark, folder, "orders").select(
        key.alias("id"),
        shop.alias("shop_id"),
        F.concat(F.lit("s"), _text(shop)).alias("source_slug"),
        F.nullif((key % 13).cast("int"), F.lit(12)).alias("chunk_index"),
        F.lit("").alias("entry_url"),
        started.alias("started_at"),
        F.when(
            status != "running", started + F.expr("INTERVAL 10 MINUTES")
        ).alias("finished_at"),
        status.alias("status"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("listings_found"),
        (key % 7).cast("int").alias("new_count"),
        (key % 3).cast("int").alias("reconciled_count"),
        (key % 200).cast("int").alias("hidden_count"),
        F.when(status == "warning", F.concat(F.lit("warning "), "o_orderpriority"))
        .otherwise("")
        .alias("error_message"),
    )
    return conform(rows, TABLES["refresh_jobs"])


def crawl_runs(spark: SparkSession, folder: str) -> DataFrame:
    return refresh_jobs(spark, folder).select(
        "id", "shop_id", F.col("started_at").alias("ran_at"), "status", "listings_found",
        "error_message",
    )


def crawl_failures(spark: SparkSession, folder: str) -> DataFrame:
    return refresh_jobs(spark, folder).filter(F.col("status") == "warning").select(
        "id", "shop_id", F.col("started_at").alias("created_at"), "error_message"
    )


def expected_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """What a day must bring per shop; every tenth shop is not expected at all."""
    key = F.col("id")
    return shops(spark, folder).filter(key % 10 != 4).select(
        F.col("slug").alias("source_slug"),
        (key % 10 * 5 + 1).cast("int").alias("expected_jobs"),
        F.when(key % 3 == 0, 12).when(key % 3 == 1, 13).otherwise(0).alias("chunk_count"),
    )


# --- traffic and owners -------------------------------------------------------------------------


def event_rows(events: DataFrame) -> DataFrame:
    """Events with their key ``k``; works on batch and streaming frames."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def page_views_of(events: DataFrame) -> DataFrame:
    rows = event_rows(events)
    k = F.col("k")
    path = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("/listing/MCM-"), _text(k)))
        .when(F.col("event_type") == "click",
              F.concat(F.lit("/shops/s"), _text(k % 10), F.lit("?from=card")))
        .when(F.col("event_type") == "signup", F.lit("/favourites"))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("categories/c"), _text(k % 7)))
        .otherwise(F.lit("/healthz"))
    )
    user = F.col("user_id") % 3
    lang = F.when(user == 0, "en").when(user == 1, "fr").otherwise("de")
    return rows.select("event_id", "ts", path.alias("path"), lang.alias("lang"))


def page_view_events(spark: SparkSession, folder: str) -> DataFrame:
    return page_views_of(read(spark, folder, "events"))


def owner_of(user: Column) -> Column:
    return F.sha2(_text(user), 256)


def listing_toggles_of(events: DataFrame) -> DataFrame:
    rows = event_rows(events).filter(F.col("event_type") == "click")
    return rows.select(
        owner_of(F.col("user_id")).alias("owner_key"),
        (F.col("user_id") % 10 * ID_STEP + F.col("k")).alias("listing_id"),
        "ts",
        "event_id",
    )


def listing_toggles(spark: SparkSession, folder: str) -> DataFrame:
    return listing_toggles_of(read(spark, folder, "events"))


def shop_toggles(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_rows(read(spark, folder, "events")).filter(F.col("event_type") == "view")
    return rows.select(
        owner_of(F.col("user_id")).alias("owner_key"), F.col("k").alias("shop_id"), "ts"
    )


def search_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """Saved-search requests with one column per filter."""
    rows = event_rows(read(spark, folder, "events")).filter(F.col("event_type") == "signup")
    k = F.col("k")
    return rows.select(
        owner_of(F.col("user_id")).alias("owner_key"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(k % 3 == 0, "red & blue ~ring*").otherwise("").alias("q"),
        F.when(k % 5 == 0, F.concat(F.lit("s"), _text(k % 4))).otherwise("").alias("shop"),
        F.lit("").alias("location"),
        F.when(k % 2 == 0, "promo").otherwise("").alias("category"),
        F.lit("").alias("material"),
        F.when(k % 7 == 0, "Brand#3").otherwise("").alias("designer"),
        F.lit("").alias("ships_to_montreal"),
        pick(k, ("available", "sold_out", "all", "")).alias("availability"),
        F.when(k % 4 == 1, "100").otherwise("").alias("price_min"),
        F.when(k % 6 == 1, "900").otherwise("").alias("price_max"),
        pick(k, ("curated", "newest")).alias("sort"),
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(
        owner_of(F.col("user_id")).alias("owner_key"), "ts"
    )


# --- entities -----------------------------------------------------------------------------------


def brands(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct brands with their number."""
    return (
        read(spark, folder, "part").select("p_brand").distinct()
        .withColumn("n", F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("bigint"))
    )


ENTITY_TIME = "1998-01-01 00:00:00"


def design_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every third brand is a known entity; every ninth still waits for approval."""
    rows = brands(spark, folder).filter(F.col("n") % 3 == 0)
    return conform(
        rows.select(
            F.col("n").alias("id"),
            F.col("p_brand").alias("canonical_name"),
            filter_key(F.col("p_brand")).alias("normalized_name"),
            F.lit("brand").alias("entity_type"),
            F.when(F.col("n") % 9 == 0, "open").otherwise("approved").alias("review_status"),
            F.lit("").alias("notes"),
            moment(ENTITY_TIME).alias("created_at"),
            moment(ENTITY_TIME).alias("updated_at"),
        ),
        TABLES["design_entities"],
    )


def design_entity_aliases(spark: SparkSession, folder: str) -> DataFrame:
    rows = brands(spark, folder).filter(F.col("n") % 3 == 0).select(
        "n",
        F.posexplode(
            F.array(
                F.col("p_brand"),
                F.concat("p_brand", F.lit(" Works")),
                F.concat(F.lit("By "), "p_brand"),
            )
        ).alias("pos", "alias"),
    )
    return conform(
        rows.select(
            (F.col("n") * 10 + F.col("pos")).alias("id"),
            F.col("n").alias("entity_id"),
            "alias",
            filter_key(F.col("alias")).alias("normalized_alias"),
            F.lit("seed").alias("source"),
            moment(ENTITY_TIME).alias("created_at"),
        ),
        TABLES["design_entity_aliases"],
    )


def approvals(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions that make every brand after a known one an entity of its own name."""
    return brands(spark, folder).filter(F.col("n") % 3 == 1).select(
        F.col("n").alias("seq"),
        F.col("p_brand").alias("source_text"),
        F.lit("designer").alias("source_role"),
        F.concat(F.lit("House "), _text("n")).alias("canonical_name"),
        F.when(F.col("n") % 2 == 0, "maker").otherwise("other").alias("entity_type"),
        F.array(F.concat("p_brand", F.lit(" Works"))).alias("aliases"),
        F.lit(" ok ").alias("notes"),
    )


def rejections(spark: SparkSession, folder: str) -> DataFrame:
    return brands(spark, folder).filter(F.col("n") % 3 == 2).select(
        F.col("n").alias("seq"),
        F.col("p_brand").alias("source_text"),
        F.lit("designer").alias("source_role"),
        F.when(F.col("n") % 2 == 0, "rejected").otherwise("maybe").alias("review_status"),
        F.lit(None).cast("bigint").alias("entity_id"),
        F.lit("").alias("notes"),
    )


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty catalog table with zone-free timestamps, as the adapters produce."""
    from pyspark.sql import types as T

    fields = [
        T.StructField(
            f.name,
            T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) else f.dataType,
        )
        for f in TABLES[table].fields
    ]
    return spark.createDataFrame([], T.StructType(fields))
