"""Set-based reconciliation of a crawl with the stored catalog.

The whole batch, over all shops, is one plan:

1. keyed match: batch and stored rows by (shop, key);
2. drift match: items without an active keyed row look for a stored row with the same shop and
   title whose key is not in the batch, scored image 2 + description 2 + price 1, at least 2;
3. every item ends up with at most one stored row, every stored row with at most one item;
4. the new snapshot, event rows, reviews and job counts are projections of that assignment.

Nothing here compares rows pairwise. A score of at least 2 means equal image or equal
description, so each score level is an equality on a few fields; candidates are counted per such
signature and an item looks its signatures up. A group of copies costs one row per task.

Set-based rules that differ from a row-at-a-time loop: every key present in the batch is excluded
from the drift candidates, wherever it stands in the batch; of several items that want one stored
row the lowest batch position gets it, and the others are new.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions.text import (
    normalize_title,
    null_if_empty,
    text_or_empty,
    url_key,
)
from vitrine.operators.skew import latest, with_new_ids
from vitrine.session import BROADCAST_BYTES, broadcast_if_small, materialized, size_in_bytes

# Columns an update takes from the batch, with the default for an absent field.
UPDATED = {
    "price_raw": "",
    "price_value": None,
    "currency": V.DEFAULT_CURRENCY,
    "primary_image_url": "",
    "availability_status": V.DEFAULT_AVAILABILITY,
    "shipping_scope": "",
    "ships_to_montreal": 0,
    "shipping_note": "",
    "category": "",
    "designer": "",
    "maker": "",
    "era": "",
    "materials": "",
    "dimensions_text": "",
    "condition_text": "",
    "source_description": "",
    "ingest_source_type": V.DEFAULT_INGEST_TYPE,
    "parse_confidence": V.DEFAULT_CONFIDENCE,
}
ITEM_COLUMNS = (
    "source_listing_url", "source_listing_key", "title", "normalized_title",
    "additional_image_urls", "location_text", *UPDATED,
)
# What matching, events and counts read of stored rows; only the next snapshot needs the others.
READ_COLUMNS = (
    "id", "source_shop_id", "source_listing_key", "normalized_title", "price_raw", "price_value",
    "currency", "primary_image_url", "availability_status", "last_checked_at", "source_description",
    "is_active",
)
# Score level -> signature kinds that make it. Kinds name the equal fields.
LEVELS = {5: ("idp",), 4: ("id",), 3: ("ip", "dp"), 2: ("i", "d")}
KINDS = tuple(kind for kinds in LEVELS.values() for kind in kinds)
# Every kind needs equal images or equal descriptions; each is looked for under one of the two.
BASES = {
    "i": tuple(kind for kind in KINDS if "i" in kind),
    "d": tuple(kind for kind in KINDS if "i" not in kind),
}


@dataclass
class RefreshOutput:
    """Everything one refresh produces; all are DataFrames."""

    listings: DataFrame
    availability_events: DataFrame
    price_events: DataFrame
    event_moves: DataFrame
    reviews: DataFrame
    review_candidates: DataFrame
    runs: DataFrame
    failures: DataFrame
    jobs: DataFrame


@dataclass
class Assignment:
    """Intermediate result: who is matched with whom."""

    crawls: DataFrame
    items: DataFrame
    candidates: DataFrame
    resolved: DataFrame
    merged: DataFrame


def crawl_states(
    crawls: DataFrame, batch: DataFrame, listings: DataFrame, min_rows: int = 0
) -> DataFrame:
    """One row per crawled shop with what may be done for it.

    A failed crawl of a shop that has listings processes nothing and hides nothing; for an empty
    shop its (fallback) rows are taken. Only an error-free authoritative crawl with at least
    ``min_rows`` rows hides what it did not see; by default an empty one hides the whole shop. Rows
    of a shop without a crawl row count as a part of a crawl that succeeded.
    """
    stored = listings.groupBy(F.col("source_shop_id").alias("shop_id")).agg(
        F.lit(1).alias("_has_rows")
    )
    sizes = batch.groupBy("shop_id").agg(F.count(F.lit(1)).alias("_received"))
    named = crawls.select("shop_id")
    unnamed = batch.select("shop_id").distinct().join(named, "shop_id", "left_anti").withColumn(
        "authoritative", F.lit(0)
    )
    crawls = crawls.unionByName(unnamed, allowMissingColumns=True)
    failed = text_or_empty(F.col("error")) != ""
    kept = failed & F.col("_has_rows").isNotNull()
    received = F.coalesce("_received", F.lit(0))
    return (
        crawls.join(stored, "shop_id", "left")
        .join(sizes, "shop_id", "left")
        .withColumn("error", text_or_empty(F.col("error")))
        .withColumn("kept_existing", kept)
        .withColumn("listings_found", F.when(kept, 0).otherwise(received).cast("int"))
        .withColumn(
            "hides", (F.col("authoritative") == 1) & ~failed & (received >= min_rows)
        )
        .drop("_has_rows", "_received")
    )


def last_records(
    rows: DataFrame, cut: Callable[[DataFrame], DataFrame] = materialized
) -> DataFrame:
    """``latest`` by (shop, key) that sends whole rows only where a key may be sent twice.

    Rows are counted by a hash of their key; those whose hash is there once stay where they are. Where
    repeated hashes are too many to broadcast, all rows go through the shuffle.
    """
    keys = ["shop_id", "source_listing_key"]
    hashed = rows.withColumn("_hash", F.xxhash64(*keys))
    repeated = cut(
        hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_hash")
    )
    if size_in_bytes(repeated) > BROADCAST_BYTES:
        return cut(latest(rows, keys, ["seq"]))
    once = hashed.join(F.broadcast(repeated), "_hash", "left_anti").drop("_hash")
    several = hashed.join(F.broadcast(repeated), "_hash", "left_semi").drop("_hash")
    return once.unionByName(cut(latest(several, keys, ["seq"])))


def prepare_items(
    batch: DataFrame,
    states: DataFrame,
    shops: DataFrame,
    bound: DataFrame,
    cut: Callable[[DataFrame], DataFrame] = materialized,
) -> DataFrame:
    """Batch rows to process, defaults applied, one per (shop, key): the last record wins."""
    places = shops.select(
        F.col("id").alias("shop_id"), F.concat_ws(", ", "city", "province").alias("_place")
    )
    open_shops = states.filter(~F.col("kept_existing")).select("shop_id")
    rows = (
        batch.join(broadcast_if_small(open_shops, bound), "shop_id")
        .join(broadcast_if_small(places, bound), "shop_id")
        .withColumns(
            {
                name: F.coalesce(F.col(name), F.lit(default))
                for name, default in UPDATED.items()
                if default is not None
            }
        )
        .withColumns(
            {
                "source_listing_key": F.coalesce(
                    null_if_empty(F.col("source_listing_key")),
                    url_key(F.col("source_listing_url")),
                ),
                "normalized_title": normalize_title(F.col("title")),
                "additional_image_urls": F.to_json(
                    F.coalesce(F.col("additional_image_urls"), F.array().cast("array<string>"))
                ),
                "location_text": F.coalesce(F.col("location_text"), F.col("_place")),
            }
        )
        .select("shop_id", "seq", *ITEM_COLUMNS)
    )
    return last_records(rows, cut)


def _stored_keys(listings: DataFrame) -> DataFrame:
    return listings.select(
        F.col("id").alias("stored_id"),
        F.col("source_shop_id").alias("shop_id"),
        "source_listing_key",
        F.col("is_active").alias("stored_active"),
    )


def keyed_match(items: DataFrame, listings: DataFrame) -> DataFrame:
    """Items with the stored row of the same (shop, key), if any."""
    return items.join(_stored_keys(listings), ["shop_id", "source_listing_key"], "left")


def _compared() -> dict[str, Column]:
    """The compared fields, null where there is nothing to compare."""
    return {
        "i": null_if_empty(F.col("primary_image_url")),
        "d": null_if_empty(normalize_title(F.col("source_description"))),
        "p": F.col("price_value").cast("string"),
    }


def _title() -> list[Column]:
    return [F.col("shop_id").cast("string"), F.col("normalized_title")]


def mark_columns() -> dict[str, Column]:
    """The mark of each base, null where the row has no field for it."""
    fields = _compared()
    return {
        f"_mark_{base}": F.when(
            fields[base].isNotNull(), F.xxhash64(F.lit(base), *_title(), fields[base])
        )
        for base in BASES
    }


def base_marks(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per base the row has a field for: ``keep``, ``base``, ``mark``.

    Rows of which some signature agrees have an equal mark. A mark is one long: it only rules rows out
    before their signatures are made, which decide. ``df`` may bring its ``mark_columns``.
    """
    made = {
        name: F.col(name) if name in df.columns else mark for name, mark in mark_columns().items()
    }
    marks = F.array(
        *[
            F.struct(F.lit(base).alias("base"), made[f"_mark_{base}"].alias("mark"))
            for base in BASES
        ]
    )
    present = F.filter(marks, lambda m: m["mark"].isNotNull())
    return df.select(*keep, F.explode(present).alias("_m")).select(*keep, "_m.base", "_m.mark")


def signatures(df: DataFrame, keep: list[str], base: str | None = None) -> DataFrame:
    """One row per signature kind the row can take part in: ``keep``, ``kind``, ``sig``.

    ``base`` names a column with the base whose kinds are wanted; all kinds without it.
    """
    fields, title = _compared(), _title()

    def one(kind: str) -> Column:
        # concat is null as soon as one field is missing
        joined = F.concat(*[F.concat(F.lit("\x01"), fields[f]) for f in kind])
        sig = F.sha2(F.concat(F.concat_ws("\x01", *title), joined), 256)
        return F.struct(F.lit(kind).alias("kind"), sig.alias("sig"))

    def some(kinds: tuple[str, ...]) -> Column:
        return F.filter(F.array(*[one(k) for k in kinds]), lambda s: s["sig"].isNotNull())

    if base is None:
        options = some(KINDS)
    else:
        options = F.coalesce(*[F.when(F.col(base) == b, some(kinds)) for b, kinds in BASES.items()])
    return df.select(*keep, F.explode(options).alias("_s")).select(*keep, "_s.kind", "_s.sig")


def _drifting(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("stored_id").isNull() | (F.col("stored_active") == 0))


def drift_candidates(
    items: DataFrame,
    matched: DataFrame,
    listings: DataFrame,
    cut: Callable[[DataFrame], DataFrame] = materialized,
) -> DataFrame:
    """Stored rows a drifting item may claim: same shop and title, key not in the batch, and the
    image or the description of some drifting item.

    They are found by their marks, a few bytes a row, and written, so that joins know how many they are.
    """
    stored = listings.select(
        F.col("id").alias("candidate_id"),
        F.col("source_shop_id").alias("shop_id"),
        "source_listing_key", "normalized_title", "primary_image_url", "source_description",
        "price_value", "last_checked_at",
    ).filter(F.col("shop_id").isNotNull() & F.col("normalized_title").isNotNull())
    wanted = base_marks(_drifting(matched), []).select("mark").distinct()
    near = cut(
        base_marks(stored, ["candidate_id"]).join(wanted, "mark", "left_semi").select(
            F.col("candidate_id").alias("_near")
        ).distinct()
    )
    return cut(
        stored.join(near, F.col("candidate_id").eqNullSafe(F.col("_near")), "left_semi")
        .join(items.select("shop_id", "source_listing_key"),
              ["shop_id", "source_listing_key"], "left_anti")
    )


def near_items(
    items: DataFrame,
    matched: DataFrame,
    candidates: DataFrame,
    cut: Callable[[DataFrame], DataFrame] = materialized,
) -> DataFrame:
    """The drifting ones of ``matched`` that share a mark with a candidate, with the compared fields of
    their items. ``matched`` has keys and marks only, so few bytes of most items are sent."""
    key = ["shop_id", "source_listing_key", "seq"]
    near = cut(
        base_marks(_drifting(matched).withColumn("_row", F.monotonically_increasing_id()),
                   [*key, "stored_id", "stored_active", "_row"])
        .join(base_marks(candidates, []).select("mark").distinct(), "mark", "left_semi")
        .drop("base", "mark").distinct().drop("_row")
    )
    fields = ["normalized_title", "primary_image_url", "source_description", "price_value"]
    mine, theirs = items.select(*key[:2], *fields).alias("mine"), broadcast_if_small(near).alias("theirs")
    return mine.join(theirs, _same_key("mine", "theirs")).select("theirs.*", *fields)


def _same_key(left: str, right: str) -> Column:
    """Equal (shop, key); a key that is missing stands for itself."""
    return (F.col(f"{left}.shop_id") == F.col(f"{right}.shop_id")) & F.col(
        f"{left}.source_listing_key"
    ).eqNullSafe(F.col(f"{right}.source_listing_key"))


def drift_match(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best score, number of stored rows that reach it and, when it is one, its id.

    One row per item that has any candidate: ``shop_id, source_listing_key, seq, score, ties,
    candidate_id``.
    """
    counted = signatures(candidates, ["candidate_id"]).groupBy("kind", "sig").agg(
        F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("candidate_id")
    )
    key = ["shop_id", "source_listing_key", "seq"]
    fields = ["normalized_title", "primary_image_url", "source_description", "price_value"]
    near = base_marks(_drifting(matched), [*key, *fields]).join(
        base_marks(candidates, []).select("mark").distinct(), "mark", "left_semi"
    )
    hits = signatures(near, key, "base").join(counted, ["kind", "sig"])

    def total(kinds: tuple[str, ...]) -> Column:
        return F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")))

    def chosen(kinds: tuple[str, ...]) -> Column:
        return F.min(F.when(F.col("kind").isin(*kinds), F.col("candidate_id")))

    levels = hits.groupBy("shop_id", "source_listing_key", "seq").agg(
        *[total(kinds).alias(f"n{level}") for level, kinds in LEVELS.items()],
        *[chosen(kinds).alias(f"c{level}") for level, kinds in LEVELS.items()],
    )
    # Without a higher level, the kinds of one level match disjoint sets of rows.
    best = F.coalesce(
        *[
            F.when(
                F.col(f"n{level}") > 0,
                F.struct(
                    F.lit(level).alias("score"),
                    F.col(f"n{level}").alias("ties"),
                    F.col(f"c{level}").alias("candidate_id"),
                ),
            )
            for level in LEVELS
        ]
    )
    return levels.select("shop_id", "source_listing_key", "seq", best.alias("b")).select(
        "shop_id", "source_listing_key", "seq", "b.score", "b.ties", "b.candidate_id"
    )


def assign(matched: DataFrame, drift: DataFrame) -> DataFrame:
    """Each item with the stored row it updates (``target_id``, null for none).

    A drift match beats an inactive keyed row, which is then superseded (``superseded_id``).
    """
    unique = drift.filter(F.col("ties") == 1)
    winners = unique.groupBy("candidate_id").agg(
        F.min(F.struct("seq", "shop_id", "source_listing_key")).alias("w")
    ).select(
        "w.shop_id", "w.source_listing_key", F.col("candidate_id").alias("drift_id")
    )
    tied = drift.filter(F.col("ties") > 1).select(
        "shop_id", "source_listing_key", "score", "ties"
    )
    key = ["shop_id", "source_listing_key"]
    return (
        matched.join(winners, key, "left")
        .join(tied, key, "left")
        .withColumn("target_id", F.coalesce("drift_id", "stored_id"))
        .withColumn(
            "superseded_id", F.when(F.col("drift_id").isNotNull(), F.col("stored_id"))
        )
        .withColumn("matched_by_key", F.col("drift_id").isNull() & F.col("stored_id").isNotNull())
        .withColumn("reconciled", F.col("drift_id").isNotNull())
    )


def merge_stored(
    listings: DataFrame, resolved: DataFrame, states: DataFrame, bound: DataFrame
) -> DataFrame:
    """Stored rows with the item that updates them and flags; superseded rows are gone.

    ``updated``: takes the item's values (a removed row is not brought back by a sold-out item).
    ``hidden``: not seen by an authoritative crawl of its shop.
    """
    targets = resolved.filter(F.col("target_id").isNotNull()).select(
        F.col("target_id").alias("id"),
        "matched_by_key",
        F.struct(*ITEM_COLUMNS).alias("item"),
    )
    gone = resolved.filter(F.col("superseded_id").isNotNull()).select(
        F.col("superseded_id").alias("id")
    )
    hides = states.select(F.col("shop_id").alias("source_shop_id"), "hides")
    revives_sold = (
        (F.col("item.availability_status") == "sold_out")
        & (F.col("availability_status") == "removed")
        & (F.col("is_active") == 0)
    )
    return (
        listings.join(targets, "id", "left")
        .join(gone, "id", "left_anti")
        .join(broadcast_if_small(hides, bound), "source_shop_id", "left")
        .withColumn("updated", F.col("item").isNotNull() & ~revives_sold)
        .withColumn(
            "hidden",
            F.coalesce(F.col("hides"), F.lit(False))
            & ~F.col("updated")
            & ~F.coalesce(F.col("matched_by_key"), F.lit(False)),
        )
        .drop("hides", "matched_by_key")
    )


def match_batch(
    listings: DataFrame,
    batch: DataFrame,
    crawls: DataFrame,
    shops: DataFrame,
    *,
    shops_bound: DataFrame | None = None,
    min_rows: int = 0,
    cut: Callable[[DataFrame], DataFrame] = materialized,
    cut_merged: Callable[[DataFrame], DataFrame] | None = None,
) -> Assignment:
    """Matches are made and written as keys, marks and ids; items join them at the end.

    ``cut_merged`` is ``cut`` by default; a caller whose batch is a table and who reads one output may leave
    the rows of ``items``, ``resolved`` and ``merged`` in its plan, which then takes the columns it needs
    through the joins instead of the whole rows."""
    bound = shops_bound if shops_bound is not None else shops
    cut_rows = cut_merged or cut
    states = cut(crawl_states(crawls, batch, listings, min_rows))
    items = cut_rows(prepare_items(batch, states, shops, bound, cut))
    key = ["shop_id", "source_listing_key"]
    matched = cut(
        keyed_match(items.withColumns(mark_columns()).select(*key, "seq", *mark_columns()), listings)
    )
    candidates = drift_candidates(matched, matched, listings, cut)
    drift = cut(drift_match(near_items(items, matched, candidates, cut), candidates))
    decided = cut(assign(matched.drop("seq", *mark_columns()), drift))
    resolved = cut_rows(
        items.alias("items").join(decided.alias("decided"), _same_key("items", "decided")).select(
            "items.*", *[f"decided.{name}" for name in decided.columns if name not in key]
        )
    )
    merged = cut_rows(merge_stored(listings, resolved, states, bound))
    return Assignment(states, items, candidates, resolved, merged)


def uncut(df: DataFrame) -> DataFrame:
    """For results that are read once."""
    return df


def new_rows(resolved: DataFrame) -> DataFrame:
    """Items that become new listings: no stored row, and not already sold out."""
    return resolved.filter(
        F.col("target_id").isNull() & (F.col("availability_status") != "sold_out")
    )


def next_listings(merged: DataFrame, new: DataFrame, columns: list[str], as_of: Column) -> DataFrame:
    """The new snapshot. Ids, first-seen times, overrides, featured marks and notes survive."""
    updated, hidden = F.col("updated"), F.col("hidden")

    def stored_value(name: str) -> Column:
        if name == "is_active":
            value = F.when(updated, 1).when(hidden, 0).otherwise(F.col(name))
        elif name == "availability_status":
            value = (
                F.when(updated, F.col(f"item.{name}"))
                .when(hidden, "removed")
                .otherwise(F.col(name))
            )
        elif name == "last_checked_at":
            value = F.when(updated | hidden, as_of).otherwise(F.col(name))
        elif name == "last_seen_at":
            value = F.when(updated, as_of).otherwise(F.col(name))
        elif name in ITEM_COLUMNS:
            value = F.when(updated, F.col(f"item.{name}")).otherwise(F.col(name))
        else:
            return F.col(name)
        return value.alias(name)

    def new_value(name: str) -> Column:
        fixed = {
            "source_shop_id": F.col("shop_id"), "first_seen_at": as_of, "last_seen_at": as_of,
            "last_checked_at": as_of, "is_active": F.lit(1), "is_featured": F.lit(0),
            "width": F.lit(None).cast("double"), "depth": F.lit(None).cast("double"),
            "height": F.lit(None).cast("double"),
        }
        if name in fixed:
            return fixed[name].alias(name)
        if name == "id" or name in ITEM_COLUMNS:
            return F.col(name)
        return F.lit("").alias(name)

    return merged.select(*[stored_value(c) for c in columns]).unionByName(
        new.select(*[new_value(c) for c in columns])
    )


def availability_changes(merged: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    old, now = text_or_empty(F.col("availability_status")), F.col("item.availability_status")
    common = [as_of.alias("observed_at")]
    changed = merged.filter(F.col("updated") & (old != now)).select(
        F.col("id").alias("listing_id"), F.col("source_shop_id").alias("shop_id"),
        F.col("item.source_listing_key").alias("source_listing_key"), *common,
        old.alias("from_status"), now.alias("to_status"),
        F.lit("source_refresh").alias("event_type"),
    )
    removed = merged.filter(
        F.col("hidden") & (F.col("is_active") == 1) & (old != "removed")
    ).select(
        F.col("id").alias("listing_id"), F.col("source_shop_id").alias("shop_id"),
        "source_listing_key", *common, old.alias("from_status"),
        F.lit("removed").alias("to_status"), F.lit("source_refresh").alias("event_type"),
    )
    discovered = new.select(
        F.col("id").alias("listing_id"), "shop_id", "source_listing_key", *common,
        F.lit("").alias("from_status"), F.col("availability_status").alias("to_status"),
        F.lit("discovered").alias("event_type"),
    )
    return changed.unionByName(removed).unionByName(discovered)


def price_changes(merged: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """A change of raw text, exact value or currency; or any price on discovery."""
    old_raw, old_currency = text_or_empty(F.col("price_raw")), F.coalesce(
        null_if_empty(F.col("currency")), F.lit(V.DEFAULT_CURRENCY)
    )
    differs = (
        (old_raw != F.col("item.price_raw"))
        | ~F.col("price_value").eqNullSafe(F.col("item.price_value"))
        | (old_currency != F.col("item.currency"))
    )
    changed = merged.filter(F.col("updated") & differs).select(
        F.col("id").alias("listing_id"), F.col("source_shop_id").alias("shop_id"),
        F.col("item.source_listing_key").alias("source_listing_key"),
        as_of.alias("observed_at"), old_raw.alias("from_price_raw"),
        F.col("price_value").alias("from_price_value"),
        F.col("item.price_raw").alias("to_price_raw"),
        F.col("item.price_value").alias("to_price_value"),
        F.col("item.currency").alias("currency"), F.lit("source_refresh").alias("event_type"),
    )
    discovered = new.filter((F.col("price_raw") != "") | F.col("price_value").isNotNull()).select(
        F.col("id").alias("listing_id"), "shop_id", "source_listing_key",
        as_of.alias("observed_at"), F.lit("").alias("from_price_raw"),
        F.lit(None).cast("double").alias("from_price_value"),
        F.col("price_raw").alias("to_price_raw"), F.col("price_value").alias("to_price_value"),
        "currency", F.lit("discovered").alias("event_type"),
    )
    return changed.unionByName(discovered)


def event_moves(resolved: DataFrame) -> DataFrame:
    """Which listing's events move to which, under which key."""
    return resolved.filter(F.col("superseded_id").isNotNull()).select(
        F.col("superseded_id").alias("from_id"),
        F.col("target_id").alias("to_id"),
        F.col("source_listing_key").alias("to_key"),
    )


def reassign_events(events: DataFrame, moves: DataFrame) -> DataFrame:
    """Event log with the events of superseded listings carried by the surviving ones."""
    moved = events.join(moves.withColumnRenamed("from_id", "listing_id"), "listing_id", "left")
    return moved.withColumns(
        {
            "listing_id": F.coalesce("to_id", "listing_id"),
            "source_listing_key": F.coalesce("to_key", "source_listing_key"),
        }
    ).select(*events.columns)


def ambiguous_reviews(
    resolved: DataFrame,
    candidates: DataFrame,
    as_of: Column,
    open_reviews: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Reviews for items whose best score is shared, and their candidates in long form.

    There is one open review per (shop, key). It names its groups of candidates; the second result
    (``candidate_group``, ``listing_id``, ``last_checked_at``) has the members of each group once,
    however many items share it. ``with_candidate_texts`` writes the lists out.
    """
    key = ["shop_id", "source_listing_key"]
    tied = resolved.filter(F.col("ties").isNotNull())
    if open_reviews is not None:
        tied = tied.join(
            open_reviews.filter(F.col("status") == "open").select(*key), key, "left_anti"
        )
    level_of = F.create_map(
        *[F.lit(x) for level, kinds in LEVELS.items() for k in kinds for x in (k, level)]
    )
    wanted = signatures(tied, [*key, "score"]).filter(
        F.try_element_at(level_of, F.col("kind")) == F.col("score")
    )
    members = signatures(candidates, ["candidate_id", "last_checked_at"]).join(
        wanted.select("kind", "sig").distinct(), ["kind", "sig"], "left_semi"
    )
    # of an item's signatures some may have no candidate at all
    groups = wanted.join(members.select("kind", "sig").distinct(), ["kind", "sig"], "left_semi")
    named = groups.groupBy(*key).agg(F.array_sort(F.collect_list("sig")).alias("candidate_groups"))
    reviews = (
        tied.select(*key, "title", "score", "ties")
        .join(named, key)
        .select(
            "shop_id",
            as_of.alias("created_at"),
            "source_listing_key",
            "title",
            F.concat(
                F.lit("Ambiguous source-key reconciliation at score "), F.col("score")
            ).alias("reason"),
            F.lit("open").alias("status"),
            F.col("ties").alias("candidate_count"),
            "candidate_groups",
        )
    )
    return reviews, members.select(
        F.col("sig").alias("candidate_group"), F.col("candidate_id").alias("listing_id"),
        "last_checked_at",
    )


def with_candidate_texts(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``candidate_listing_ids``: all candidates of each review, newest check first.

    For the reviews that a reader asks for; items that share a group each get its whole list.
    """
    lists = candidates.groupBy("candidate_group").agg(
        F.collect_list(F.struct("last_checked_at", "listing_id")).alias("_members")
    )
    key = ["shop_id", "source_listing_key"]
    texts = (
        reviews.select(*key, F.explode("candidate_groups").alias("candidate_group"))
        .join(lists, "candidate_group")
        .groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("_members"))).alias("_all"))
    )
    text = F.array_join(
        F.transform(F.reverse("_all"), lambda m: m["listing_id"].cast("string")), ","
    )
    return reviews.join(
        texts.select(*key, text.alias("candidate_listing_ids")), key
    )


def refresh_result(
    states: DataFrame, resolved: DataFrame, new: DataFrame, merged: DataFrame, as_of: Column
) -> DataFrame:
    """One job row per crawled shop. The hide count includes rows that were inactive before."""
    added = new.groupBy("shop_id").agg(F.count(F.lit(1)).alias("new_count"))
    reconciled = (
        resolved.filter("reconciled").groupBy("shop_id")
        .agg(F.count(F.lit(1)).alias("reconciled_count"))
    )
    hidden = (
        merged.filter("hidden").groupBy(F.col("source_shop_id").alias("shop_id"))
        .agg(F.count(F.lit(1)).alias("hidden_count"))
    )
    joined = (
        states.join(added, "shop_id", "left")
        .join(reconciled, "shop_id", "left")
        .join(hidden, "shop_id", "left")
    )
    counts = ["new_count", "reconciled_count", "hidden_count"]
    return joined.select(
        "shop_id", "source_slug", "chunk_index", "entry_url",
        as_of.alias("started_at"), as_of.alias("finished_at"),
        F.when(F.col("error") != "", "warning").otherwise("success").alias("status"),
        "listings_found",
        *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in counts],
        F.col("error").alias("error_message"),
        F.col("kept_existing").cast("int").alias("kept_existing"),
    )


def reconcile(
    listings: DataFrame,
    batch: DataFrame,
    crawls: DataFrame,
    shops: DataFrame,
    as_of: Column,
    *,
    open_reviews: DataFrame | None = None,
    new_id: Column | None = None,
    stored_ids: DataFrame | None = None,
    shops_bound: DataFrame | None = None,
    min_rows: int = 0,
    cut: Callable[[DataFrame], DataFrame] = materialized,
    cut_merged: Callable[[DataFrame], DataFrame] | None = None,
) -> RefreshOutput:
    """Reconcile ``batch`` (parsed rows with ``shop_id`` and batch position ``seq``).

    ``crawls(shop_id, source_slug, authoritative, error, chunk_index, entry_url)`` has one row per
    crawled shop. ``new_id`` computes a new listing's id from its item; by default ids continue
    after the highest stored one. ``cut`` writes the intermediate results, so that the matching runs
    once however many outputs are used; ``cut_merged`` is for ``match_batch``.
    """
    matched = match_batch(
        listings, batch, crawls, shops, shops_bound=shops_bound, min_rows=min_rows, cut=cut,
        cut_merged=cut_merged,
    )
    new = new_rows(matched.resolved)
    if new_id is not None:
        new = new.withColumn("id", new_id)
    else:
        new = with_new_ids(
            new, ["shop_id", "source_listing_key"], listings if stored_ids is None else stored_ids
        )
    reviews, review_candidates = ambiguous_reviews(
        matched.resolved, matched.candidates, as_of, open_reviews
    )
    jobs = refresh_result(matched.crawls, matched.resolved, new, matched.merged, as_of)
    return RefreshOutput(
        listings=next_listings(matched.merged, new, listings.columns, as_of),
        availability_events=availability_changes(matched.merged, new, as_of),
        price_events=price_changes(matched.merged, new, as_of),
        event_moves=event_moves(matched.resolved),
        reviews=reviews,
        review_candidates=review_candidates,
        runs=jobs.select(
            "shop_id", F.col("started_at").alias("ran_at"), "status", "listings_found",
            "error_message",
        ),
        failures=jobs.filter(F.col("error_message") != "").select(
            "shop_id", F.col("started_at").alias("created_at"), "error_message"
        ),
        jobs=jobs,
    )


# What orders the rows of one refresh in their log; unique within it.
LOG_ORDER = {
    "availability_events": ("listing_id",),
    "price_events": ("listing_id",),
    "reviews": ("shop_id", "source_listing_key"),
    "runs": ("shop_id",),
    "failures": ("shop_id",),
    "jobs": ("shop_id",),
}


def with_log_ids(out: RefreshOutput, stored: Mapping[str, DataFrame]) -> RefreshOutput:
    """The output with ids on the rows that are appended to logs, after the highest stored ones.

    ``stored`` holds the logs (``id``) by the names of the output's fields; others stay as they are.
    """
    numbered = {
        name: with_new_ids(getattr(out, name), list(LOG_ORDER[name]), log) for name, log in stored.items()
    }
    return replace(out, **numbered)


# --- chunked sources ----------------------------------------------------------------------------


@dataclass
class ChunkOutput:
    listings: DataFrame
    availability_events: DataFrame
    results: DataFrame


def chunk_latest_success(
    jobs: DataFrame, expected: DataFrame, since: Column | None = None
) -> DataFrame:
    """The latest successful job of every expected chunk (``expected(source_slug,
    chunk_count)``)."""
    succeeded = jobs.filter((F.col("status") == "success") & F.col("chunk_index").isNotNull())
    if since is not None:
        succeeded = succeeded.filter(F.col("started_at") >= since)
    rows = succeeded.select("source_slug", "chunk_index", "started_at", "id", "listings_found")
    newest = latest(rows, ["source_slug", "chunk_index"], ["started_at", "id"])
    return newest.join(expected, "source_slug").filter(
        (F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("chunk_count"))
    ).drop("chunk_count", "expected_jobs")


def chunk_states(
    jobs: DataFrame, expected: DataFrame, since: Column | None = None
) -> DataFrame:
    """Per expected source: cutoff, rows found and the chunks that are missing."""
    done = (
        chunk_latest_success(jobs, expected, since)
        .groupBy("source_slug")
        .agg(
            F.min("started_at").alias("cutoff"),
            F.sum("listings_found").alias("_found"),
            F.collect_set("chunk_index").alias("_seen"),
        )
    )
    wanted = F.when(
        F.col("chunk_count") > 0, F.sequence(F.lit(0), F.col("chunk_count") - 1)
    ).otherwise(F.array().cast("array<int>"))
    seen = F.coalesce(F.col("_seen"), F.array().cast("array<int>"))
    return expected.join(done, "source_slug", "left").select(
        "source_slug", "cutoff", F.col("_found").alias("found"),
        F.array_except(wanted, seen).alias("missing"),
    )


def chunk_reconcile(
    listings: DataFrame,
    shops: DataFrame,
    jobs: DataFrame,
    expected: DataFrame,
    as_of: Column,
    since: Column | None = None,
) -> ChunkOutput:
    """Hide what no chunk of a complete run has seen.

    A source with a missing chunk only gets a warning that names the indexes. Unlike an
    authoritative crawl this touches active rows only.
    """
    states = chunk_states(jobs, expected, since).join(
        shops.select(F.col("id").alias("source_shop_id"), F.col("slug").alias("source_slug")),
        "source_slug",
    )
    complete = states.filter(F.size("missing") == 0).select("source_shop_id", "cutoff")
    marked = listings.join(complete, "source_shop_id", "left").withColumn(
        "_hide",
        F.coalesce(
            (F.col("is_active") == 1) & (F.col("last_seen_at") < F.col("cutoff")), F.lit(False)
        ),
    )
    events = marked.filter(F.col("_hide") & (F.col("availability_status") != "removed")).select(
        F.col("id").alias("listing_id"), F.col("source_shop_id").alias("shop_id"),
        "source_listing_key", as_of.alias("observed_at"),
        F.col("availability_status").alias("from_status"), F.lit("removed").alias("to_status"),
        F.lit("source_reconciliation").alias("event_type"),
    )
    hidden = (
        marked.filter("_hide").groupBy("source_shop_id")
        .agg(F.count(F.lit(1)).alias("hidden_count"))
    )
    incomplete = F.size("missing") > 0
    results = states.join(hidden, "source_shop_id", "left").select(
        F.col("source_shop_id").alias("shop_id"), "source_slug",
        F.lit("source-wide-reconciliation").alias("entry_url"),
        as_of.alias("started_at"),
        F.when(incomplete, "warning").otherwise("success").alias("status"),
        F.when(incomplete, 0).otherwise(F.coalesce("found", F.lit(0))).cast("int")
        .alias("listings_found"),
        F.lit(0).alias("new_count"),
        F.lit(0).alias("reconciled_count"),
        F.coalesce("hidden_count", F.lit(0)).cast("int").alias("hidden_count"),
        F.when(
            incomplete,
            F.concat(
                F.lit("Missing successful chunk jobs for indexes: "),
                F.array_join(F.col("missing").cast("array<string>"), ", "),
            ),
        ).otherwise("").alias("error_message"),
        incomplete.cast("int").alias("kept_existing"),
    )
    after = marked.withColumns(
        {
            "is_active": F.when(F.col("_hide"), 0).otherwise(F.col("is_active")),
            "availability_status": F.when(F.col("_hide"), "removed").otherwise(
                F.col("availability_status")
            ),
            "last_checked_at": F.when(F.col("_hide"), as_of).otherwise(F.col("last_checked_at")),
        }
    ).select(*listings.columns)
    return ChunkOutput(after, events, results)
