"""Per-owner state: favourites, saved searches and identities, for all owners at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions.text import quote_plus, text_or_empty
from vitrine.operators.skew import with_new_ids
from vitrine.sources.tables import sink_upsert


def favourites_fold(toggles: DataFrame, item: str) -> DataFrame:
    """Current favourites from toggles ``(owner_key, <item>, ts)``.

    An item is a favourite after an odd number of toggles, since the last of them.
    """
    return (
        toggles.groupBy("owner_key", item)
        .agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("created_at"))
        .filter(F.col("_n") % 2 == 1)
        .drop("_n")
    )


def favourite_listings(favourites: DataFrame, listings: DataFrame, shops: DataFrame) -> DataFrame:
    """Every owner's listings in the order they were saved."""
    dim = shops.select(
        F.col("id").alias("source_shop_id"), F.col("slug").alias("shop_slug"),
        F.col("name").alias("shop_name"), "is_montreal_local",
    )
    return (
        favourites.join(listings.withColumnRenamed("id", "listing_id"), "listing_id")
        .join(dim, "source_shop_id")
        .orderBy("owner_key", "created_at", "listing_id")
    )


def favourite_shops(favourites: DataFrame, shops: DataFrame) -> DataFrame:
    """Every owner's shops in the order they were saved; inactive shops are left out."""
    active = shops.filter(F.col("active") == 1).withColumnRenamed("id", "shop_id")
    return favourites.join(active, "shop_id").orderBy("owner_key", "created_at", "shop_id")


def favourites_counts(
    listing_favourites: DataFrame, shop_favourites: DataFrame, searches: DataFrame
) -> DataFrame:
    """Listings, shops, searches and their total per owner."""
    kinds = {"listings": listing_favourites, "shops": shop_favourites, "searches": searches}
    rows = None
    for kind, df in kinds.items():
        part = df.groupBy("owner_key").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "kind", F.lit(kind)
        )
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("owner_key").agg(
        *[
            F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)
            for kind in kinds
        ]
    )
    return counts.withColumn("total", F.col("listings") + F.col("shops") + F.col("searches"))


def favourites_migrate(
    durable: DataFrame, session: DataFrame, item: str, as_of: Column
) -> DataFrame:
    """Durable favourites plus the ids of ``session(owner_key, raw_value)`` not yet among them.

    Values that are no whole number are dropped.
    """
    ids = (
        session.select("owner_key", F.col("raw_value").try_cast("bigint").alias(item))
        .filter(F.col(item).isNotNull())
        .distinct()
        .join(durable.select("owner_key", item), ["owner_key", item], "left_anti")
    )
    return durable.unionByName(ids.withColumn("created_at", as_of).select(*durable.columns))


def identity_upsert(identities: DataFrame, visits: DataFrame) -> DataFrame:
    """First and last visit per owner after ``visits(owner_key, ts)``."""
    seen = visits.groupBy("owner_key").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen_at")
    )
    return sink_upsert(identities, seen, ["owner_key"], preserve=("created_at",))


SEARCH_ARGUMENTS = (
    "q", "shop", "location", "category", "material", "designer", "ships_to_montreal",
    "availability", "price_min", "price_max", "sort",
)


def saved_search_key(filters: dict[str, Column]) -> Column:
    """Url-encoded filters that are set and not at their default, in their given order."""
    defaults = {"availability": "available", "sort": "curated"}
    parts = []
    for name, value in filters.items():
        plain = text_or_empty(value)
        is_set = plain != ""
        if name in defaults:
            is_set = is_set & (plain != defaults[name])
        parts.append(F.when(is_set, F.concat(F.lit(f"{name}="), quote_plus(plain))))
    return F.concat_ws("&", *parts)


def saved_search_name(filters: dict[str, Column]) -> Column:
    """Readable name: the texts joined by `` / ``, cut to 120 characters."""
    def filled(value: Column) -> Column:
        return F.nullif(text_or_empty(value), F.lit(""))

    texts = [
        filled(filters[name])
        for name in ("q", "shop", "category", "material", "designer", "location")
    ]
    prices = filled(
        F.concat_ws(" ", filled(filters["price_min"]), filled(filters["price_max"]))
    )
    status = filled(filters["availability"])
    status = F.when(status != "available", F.translate(status, "_", " "))
    name = F.substring(F.concat_ws(" / ", *texts, prices, status), 1, V.SAVED_SEARCH_NAME_CHARS)
    return F.when(name == "", V.SAVED_SEARCH_DEFAULT_NAME).otherwise(name)


def saved_search_upsert(saved: DataFrame, requests: DataFrame) -> DataFrame:
    """Saved searches after ``requests(owner_key, name, query_string, ts, seq)``.

    One per (owner, query); the name is the last one given, the creation time the first. New ids
    follow the time of the first request.
    """
    folded = (
        requests.filter((F.col("owner_key") != "") & (F.col("query_string") != ""))
        .groupBy("owner_key", "query_string")
        .agg(
            F.max_by("name", F.struct("ts", "seq")).alias("name"),
            F.min("ts").alias("created_at"),
            F.max("ts").alias("updated_at"),
            F.min(F.struct("ts", "seq")).alias("_first"),
        )
    )
    keys = ["owner_key", "query_string"]
    fresh = with_new_ids(
        folded.join(saved.select(*keys), keys, "left_anti"), ["_first", *keys], saved
    )
    stored = folded.join(saved.select(*keys, "id"), keys)
    rows = stored.unionByName(fresh).drop("_first")
    return sink_upsert(saved, rows, keys, preserve=("id", "created_at"))


def saved_search_list(saved: DataFrame) -> DataFrame:
    """Every owner's searches, newest first."""
    return saved.orderBy("owner_key", F.col("updated_at").desc(), F.col("id").desc())


def saved_search_delete(saved: DataFrame, deletions: DataFrame) -> DataFrame:
    """Without ``deletions(owner_key, id)``; an id of another owner is not touched."""
    return saved.join(deletions.select("owner_key", "id"), ["owner_key", "id"], "left_anti")
