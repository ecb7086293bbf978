"""Facet values, shop roll-ups, source status and other catalog reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions.enrich import clean_designer
from vitrine.functions.text import filter_key, item_number, null_if_empty, slugify
from vitrine.operators.catalog import effective_availability, effective_category
from vitrine.operators.skew import with_global_rank

LISTED = ("category", "materials")


def _shown(listings: DataFrame) -> DataFrame:
    return listings.filter((F.col("is_active") == 1) & (effective_availability() != "removed"))


def facet_values(
    listings: DataFrame, field: str, limit: int | None = V.FACET_LIMIT
) -> DataFrame:
    """Distinct comma-separated values of a raw field, in first-seen order of the sorted texts.

    Uses the raw category, not its override, and all shops. Distinct texts are reduced first, then
    each value keeps its earliest (text, position), so no group holds more than one row per task.
    """
    if field not in LISTED:
        raise ValueError(f"Unsupported facet field: {field}")
    raws = _shown(listings).filter(F.col(field) != "").select(F.col(field).alias("raw")).distinct()
    pieces = raws.select("raw", F.posexplode(F.split("raw", ",")).alias("pos", "piece"))
    values = (
        pieces.select(F.trim("piece").alias("value"), F.struct("raw", "pos").alias("seen"))
        .filter(F.col("value") != "")
        .groupBy("value")
        .agg(F.min("seen").alias("seen"))
    )
    return (values if limit is None else values.orderBy("seen").limit(limit)).select("value")


def location_values(listings: DataFrame) -> DataFrame:
    """Distinct trimmed locations."""
    return (
        _shown(listings)
        .select(F.trim("location_text").alias("value"))
        .filter(F.col("value") != "")
        .distinct()
        .orderBy("value")
    )


def designer_facet(
    listings: DataFrame,
    alias_map: DataFrame | None = None,
    limit: int = V.DESIGNER_FACET_LIMIT,
    busy: int = V.DESIGNER_FACET_BUSY,
) -> DataFrame:
    """Most frequent designers and makers under their canonical names.

    ``alias_map(alias_key, canonical_name)`` is the approved entity alias map. Occurrences are
    counted per raw text first, so names are cleaned once per distinct text. The label is the
    shortest variant, then the smallest. With more than ``busy`` names those seen once are left
    out.
    """
    named = (
        _shown(listings)
        .select(F.explode(F.array("designer", "maker")).alias("raw"))
        .filter(F.col("raw") != "")
        .groupBy("raw")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("label", clean_designer(F.col("raw")))
        .filter(F.col("label") != "")
        .withColumn("alias_key", filter_key(F.col("label")))
        .filter(F.col("alias_key") != "")
    )
    if alias_map is not None:
        named = named.join(alias_map.select("alias_key", "canonical_name"), "alias_key", "left")
        label = F.coalesce("canonical_name", "label")
    else:
        label = F.col("label")
    counted = (
        named.select("n", label.alias("label"))
        .groupBy("label")
        .agg(F.sum("n").alias("n"))
        .withColumn("key", filter_key(F.col("label")))
        .groupBy("key")
        .agg(
            F.sum("n").alias("count"),
            F.min_by("label", F.struct(F.length("label"), F.col("label"))).alias("value"),
        )
    )
    # the first busy + 1 names say whether there are more than busy; the window is over those only
    first = counted.orderBy(F.col("count").desc(), F.col("key").asc()).limit(
        max(busy + 1, limit)
    )
    crowded = F.count(F.lit(1)).over(Window.partitionBy()) > busy
    kept = first.withColumn("_crowded", crowded).filter(
        ~F.col("_crowded") | (F.col("count") >= 2)
    )
    top = kept.orderBy(F.col("count").desc(), F.col("key").asc()).limit(limit)
    return top.select("value", "count").orderBy("value")


def shop_rollup(shops: DataFrame, listings: DataFrame) -> DataFrame:
    """Active shops with the number of active unsold listings and the categories they carry.

    Categories come from all of a shop's listings, with overrides; both are null for a shop without
    listings (the count is a sum). Listings are reduced to one row per (shop, category) first, so
    the category list is built from distinct values only.
    """
    per_category = (
        listings.groupBy(
            F.col("source_shop_id").alias("id"), effective_category().alias("category")
        )
        .agg(
            F.sum(
                F.when((F.col("is_active") == 1) & (effective_availability() != "sold_out"), 1)
                .otherwise(0)
            ).alias("n")
        )
    )
    stats = per_category.groupBy("id").agg(
        F.sum("n").alias("active_listing_count"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories_carried"),
    )
    return (
        shops.filter(F.col("active") == 1)
        .join(stats, "id", "left")
        .orderBy(F.col("is_montreal_local").desc(), "name")
    )


def source_status(
    shops: DataFrame, runs: DataFrame, jobs: DataFrame, listings: DataFrame
) -> DataFrame:
    """Active shops with their latest crawl run, latest job and number of active listings.

    Three aggregates with one row per shop; the latest row of a group is an aggregate, not a
    window.
    """
    run_fields, job_fields = (
        ["ran_at", "status", "error_message"],
        ["started_at", "finished_at", "status", "new_count", "hidden_count", "chunk_index"],
    )
    last_run = runs.groupBy(F.col("shop_id").alias("id")).agg(
        F.max_by(F.struct(*run_fields), F.struct("ran_at", "id")).alias("run")
    )
    last_job = jobs.groupBy(F.col("shop_id").alias("id")).agg(
        F.max_by(F.struct(*job_fields), F.struct("started_at", "id")).alias("job")
    )
    active = (
        listings.filter(F.col("is_active") == 1)
        .groupBy(F.col("source_shop_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        shops.filter(F.col("active") == 1)
        .join(last_run, "id", "left")
        .join(last_job, "id", "left")
        .join(active, "id", "left")
        .select(
            *[F.col(c) for c in shops.columns],
            F.col("run.ran_at").alias("last_run_at"),
            F.col("run.status").alias("last_status"),
            F.col("run.error_message").alias("last_error"),
            F.col("job.started_at").alias("last_job_started_at"),
            F.col("job.finished_at").alias("last_job_finished_at"),
            F.col("job.status").alias("last_job_status"),
            F.col("job.new_count").alias("last_job_new_count"),
            F.col("job.hidden_count").alias("last_job_hidden_count"),
            F.col("job.chunk_index").alias("last_job_chunk_index"),
            F.coalesce("n", F.lit(0)).alias("active_listing_count"),
        )
        .orderBy("crawl_priority", "name")
    )


def recent_failures(
    failures: DataFrame, shops: DataFrame, limit: int = V.FAILURE_LIMIT
) -> DataFrame:
    """The latest failures with their shop's name. Shops are joined first, because a failure of an
    unknown shop must not take a place."""
    names = shops.select(F.col("id").alias("shop_id"), F.col("name").alias("shop_name"))
    return (
        failures.join(names, "shop_id")
        .orderBy(F.col("created_at").desc(), F.col("id").desc())
        .limit(limit)
    )


def sitemap(
    listings: DataFrame, shops: DataFrame, base_url: str, limit: int | None = None
) -> DataFrame:
    """Addresses of the public pages: fixed pages, categories, shops and listings.

    All of them, unless ``limit`` keeps the listings that were checked last.
    """
    spark = listings.sparkSession
    fixed = spark.createDataFrame(
        [(base_url + path, "") for path in V.STATIC_PATHS], "loc string, lastmod string"
    )
    categories = facet_values(listings, "category", limit=None).select(
        F.concat(F.lit(f"{base_url}/categories/"), slugify(F.col("value"))).alias("loc"),
        F.lit("").alias("lastmod"),
    )
    active = shops.filter(F.col("active") == 1)
    shop_pages = active.select(
        F.concat(F.lit(f"{base_url}/shops/"), "slug").alias("loc"), F.lit("").alias("lastmod")
    )

    def stamp(name: str) -> Column:
        return F.date_format(F.col(name), "yyyy-MM-dd")

    newest = (
        _shown(listings)
        .join(active.select(F.col("id").alias("source_shop_id")), "source_shop_id", "left_semi")
        .select("id", "last_checked_at", "last_seen_at", "first_seen_at")
    )
    if limit is not None:
        newest = newest.orderBy(F.col("last_checked_at").desc(), F.col("id").desc()).limit(limit)
    listing_pages = newest.select(
        F.concat(F.lit(f"{base_url}/listing/"), item_number(F.col("id"))).alias("loc"),
        F.coalesce(
            stamp("last_checked_at"), stamp("last_seen_at"), stamp("first_seen_at"), F.lit("")
        ).alias("lastmod"),
    )
    return fixed.unionByName(categories).unionByName(shop_pages).unionByName(listing_pages)


def sitemap_xml_entries(urls: DataFrame, *keep: str) -> DataFrame:
    """One ``<url>`` element per row (``value``), ready for ``write.text``, after the columns ``keep``."""
    def escape(column: Column) -> Column:
        safe = F.replace(column, F.lit("&"), F.lit("&amp;"))
        safe = F.replace(safe, F.lit("<"), F.lit("&lt;"))
        return F.replace(safe, F.lit(">"), F.lit("&gt;"))

    lastmod = F.when(
        F.col("lastmod") != "",
        F.concat(F.lit("<lastmod>"), escape(F.col("lastmod")), F.lit("</lastmod>")),
    ).otherwise("")
    return urls.select(
        *keep,
        F.concat(
            F.lit("<url><loc>"), escape(F.col("loc")), F.lit("</loc>"), lastmod, F.lit("</url>")
        ).alias("value")
    )


def sitemap_files(urls: DataFrame, per_file: int = V.SITEMAP_FILE_URLS) -> DataFrame:
    """The addresses dealt to numbered files in their order: ``file``, ``loc``, ``lastmod``."""
    ranked = with_global_rank(urls, ["loc"])
    return ranked.select(F.floor(F.col("rank") / per_file).alias("file"), "loc", "lastmod")


def write_sitemap(urls: DataFrame, folder: str, base_url: str, per_file: int = V.SITEMAP_FILE_URLS) -> None:
    """Write ``folder/urls/file=n`` with the entries of each file, and ``folder/index`` that names them.

    An entry is a line; who serves a file puts the head and the end of the document around it.
    """
    files = sitemap_files(urls, per_file)
    entries = sitemap_xml_entries(files, "file")
    entries.repartition("file").write.mode("overwrite").partitionBy("file").text(f"{folder}/urls")
    names = files.select("file").distinct().orderBy("file").select(
        F.concat(
            F.lit(f"<sitemap><loc>{base_url}/sitemap-"), F.col("file").cast("string"),
            F.lit(".xml</loc></sitemap>"),
        ).alias("value")
    )
    names.write.mode("overwrite").text(f"{folder}/index")


def site_json_ld(spark: SparkSession, base_url: str, site_name: str) -> DataFrame:
    """The WebSite document with its search action; one row."""
    target = F.struct(
        F.lit("EntryPoint").alias("@type"),
        F.lit(f"{base_url}/?q={{search_term_string}}").alias("urlTemplate"),
    )
    action = F.struct(
        F.lit("SearchAction").alias("@type"),
        target.alias("target"),
        F.lit("required name=search_term_string").alias("query-input"),
    )
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("WebSite").alias("@type"),
        F.lit(site_name).alias("name"),
        F.lit(f"{base_url}/").alias("url"),
        action.alias("potentialAction"),
    )
    return spark.range(1).select(F.to_json(document).alias("json_ld"))


def listing_json_ld(listings: DataFrame, shops: DataFrame, base_url: str) -> DataFrame:
    """A Product document per listing. Absent parts (image, price) are left out of the JSON."""
    dim = shops.select(F.col("id").alias("source_shop_id"), F.col("name").alias("shop_name"))
    sold = effective_availability() == "sold_out"
    offer = F.struct(
        F.lit("Offer").alias("@type"),
        F.col("source_listing_url").alias("url"),
        F.coalesce(null_if_empty(F.col("currency")), F.lit(V.DEFAULT_CURRENCY)).alias(
            "priceCurrency"
        ),
        F.when(sold, "https://schema.org/OutOfStock")
        .otherwise("https://schema.org/InStock")
        .alias("availability"),
        F.struct(F.lit("Store").alias("@type"), F.col("shop_name").alias("name")).alias("seller"),
        F.col("price_value").alias("price"),
    )
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("Product").alias("@type"),
        F.col("title").alias("name"),
        F.coalesce(null_if_empty(F.col("source_description")), F.col("title")).alias("description"),
        F.concat(F.lit(f"{base_url}/listing/"), item_number(F.col("id"))).alias("url"),
        null_if_empty(F.col("primary_image_url")).alias("image"),
        F.struct(F.lit("Brand").alias("@type"), F.col("shop_name").alias("name")).alias("brand"),
        F.trim(effective_category()).alias("category"),
        offer.alias("offers"),
    )
    return listings.join(dim, "source_shop_id").select("id", F.to_json(document).alias("json_ld"))


def shop_json_ld(shops: DataFrame, base_url: str) -> DataFrame:
    """A Store document per shop; street and position only where known."""
    street = F.col("street_address") != ""
    known = F.coalesce((F.col("latitude") != 0) & (F.col("longitude") != 0), F.lit(False))
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("Store").alias("@type"),
        "name",
        "description",
        F.concat(F.lit(f"{base_url}/shops/"), "slug").alias("url"),
        F.col("website").alias("sameAs"),
        F.struct(
            F.lit("PostalAddress").alias("@type"),
            F.col("city").alias("addressLocality"),
            F.col("province").alias("addressRegion"),
            F.col("country").alias("addressCountry"),
            F.when(street, F.col("street_address")).alias("streetAddress"),
            F.when(street, F.col("postal_code")).alias("postalCode"),
        ).alias("address"),
        F.when(
            known,
            F.struct(F.lit("GeoCoordinates").alias("@type"), "latitude", "longitude"),
        ).alias("geo"),
    )
    return shops.select("id", F.to_json(document).alias("json_ld"))


def collection_json_ld(
    collections: DataFrame, base_url: str, site_name: str
) -> DataFrame:
    """A CollectionPage document per ``collections(path, name, description)`` row."""
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("CollectionPage").alias("@type"),
        "name",
        "description",
        F.concat(F.lit(base_url), "path").alias("url"),
        F.struct(F.lit("WebSite").alias("@type"), F.lit(site_name).alias("name")).alias("isPartOf"),
    )
    return collections.select("path", F.to_json(document).alias("json_ld"))
