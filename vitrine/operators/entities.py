"""Canonical designers and makers: aliases, candidates, decisions and evidence.

Decisions come as tables, many at once; of several for one key the last by ``seq`` wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions.enrich import clean_designer
from vitrine.functions.text import filter_key, text_or_empty
from vitrine.operators.skew import latest, with_new_ids
from vitrine.sources.tables import sink_upsert


def _clamped(column: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(column.isin(*allowed), column).otherwise(F.lit(default))


def entity_upsert(
    entities: DataFrame, aliases: DataFrame, decisions: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Entities by normalized name and aliases by normalized alias after the decisions.

    ``decisions(seq, canonical_name, entity_type, aliases, notes)``. The canonical name is an alias
    of its own entity; an alias given to another entity moves to it.
    """
    rows = (
        decisions.withColumn("canonical_name", F.trim("canonical_name"))
        .filter(F.col("canonical_name") != "")
        .withColumn("normalized_name", filter_key(F.col("canonical_name")))
    )
    named = latest(
        rows.select(
            "seq", "normalized_name", "canonical_name",
            _clamped(F.col("entity_type"), V.ENTITY_TYPES, "creator").alias("entity_type"),
            F.trim(text_or_empty(F.col("notes"))).alias("notes"),
        ),
        ["normalized_name"],
        ["seq"],
    )
    unknown = named.join(entities.select("normalized_name"), "normalized_name", "left_anti")
    known = named.join(entities.select("normalized_name", "id"), "normalized_name")
    identified = known.unionByName(with_new_ids(unknown, ["normalized_name"], entities))
    entity_rows = identified.select(
        "id", "normalized_name", "canonical_name", "entity_type", "notes",
        F.lit("approved").alias("review_status"),
        as_of.alias("created_at"), as_of.alias("updated_at"),
    )
    entities_after = sink_upsert(
        entities, entity_rows, ["normalized_name"], preserve=("id", "review_status", "created_at")
    )

    texts = rows.select(
        "seq",
        "normalized_name",
        F.explode(
            F.concat(
                F.array("canonical_name"),
                F.coalesce(F.col("aliases"), F.array().cast("array<string>")),
            )
        ).alias("alias"),
    )
    keyed = (
        texts.withColumn("alias", F.trim("alias"))
        .withColumn("normalized_alias", filter_key(F.col("alias")))
        .filter((F.col("alias") != "") & (F.col("normalized_alias") != ""))
    )
    owned = latest(keyed, ["normalized_alias"], ["seq", "alias"]).join(
        identified.select("normalized_name", F.col("id").alias("entity_id")), "normalized_name"
    )
    new = with_new_ids(
        owned.join(aliases.select("normalized_alias"), "normalized_alias", "left_anti"),
        ["normalized_alias"],
        aliases,
    )
    old = owned.join(aliases.select("normalized_alias", "id"), "normalized_alias")
    alias_rows = old.unionByName(new).select(
        "id", "entity_id", "alias", "normalized_alias",
        F.lit("admin").alias("source"), as_of.alias("created_at"),
    )
    aliases_after = sink_upsert(
        aliases, alias_rows, ["normalized_alias"], preserve=("id", "created_at")
    )
    return entities_after, aliases_after


def entity_alias_map(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``alias_key -> canonical_name`` of approved entities."""
    approved = entities.filter(F.col("review_status") == "approved").select(
        F.col("id").alias("entity_id"), "canonical_name"
    )
    return aliases.join(approved, "entity_id").select(
        F.col("normalized_alias").alias("alias_key"), "canonical_name"
    )


def query_values(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """All texts to search for per name: ``(value, alias)``.

    The cleaned name, the fixed dictionary's entries for it, and canonical name and aliases of the
    entities known by that name or alias. Two equi-joins unioned instead of an OR join.
    """
    spark = names.sparkSession
    asked = (
        names.select("value").distinct()
        .withColumn("cleaned", clean_designer(F.col("value")))
        .withColumn("cleaned_key", filter_key(F.col("cleaned")))
        .withColumn("value_key", filter_key(F.col("value")))
    )
    dictionary = spark.createDataFrame(
        list(V.DESIGNER_ALIASES.items()), "dictionary_key string, canonical string"
    ).withColumn("canonical_key", filter_key(F.col("canonical")))
    entries = (
        dictionary.select(F.col("dictionary_key").alias("cleaned_key"), "dictionary_key",
                          "canonical")
        .unionByName(
            dictionary.select(F.col("canonical_key").alias("cleaned_key"), "dictionary_key",
                              "canonical")
        )
    )
    usable = asked.filter(F.col("cleaned") != "")
    # the dictionary is a fixed list of a few dozen rows
    from_dictionary = usable.join(F.broadcast(entries), "cleaned_key").select(
        "value", F.explode(F.array("canonical", "dictionary_key")).alias("alias")
    )
    known = asked.filter(F.col("value_key") != "").select("value", "value_key")
    by_name = known.join(
        entities.select(F.col("normalized_name").alias("value_key"),
                        F.col("id").alias("entity_id")),
        "value_key",
    )
    by_alias = known.join(
        aliases.select(F.col("normalized_alias").alias("value_key"), "entity_id"), "value_key"
    )
    matched = by_name.unionByName(by_alias).select("value", "entity_id").distinct()
    texts = aliases.select("entity_id", "alias").unionByName(
        entities.join(aliases.select(F.col("entity_id").alias("id")), "id", "left_semi").select(
            F.col("id").alias("entity_id"), F.col("canonical_name").alias("alias")
        )
    )
    from_tables = matched.join(texts, "entity_id").select("value", "alias")
    return (
        usable.select("value", F.col("cleaned").alias("alias"))
        .unionByName(from_dictionary)
        .unionByName(from_tables)
        .distinct()
        .filter(F.trim("alias") != "")
    )


def texts_of_name(name: str, entities: DataFrame, aliases: DataFrame) -> DataFrame | None:
    """All texts to search for under one name (``alias``), as a table; None without a name."""
    if not name:
        return None
    names = entities.sparkSession.createDataFrame([(name,)], "value string")
    return query_values(names, entities, aliases).select("alias")


def entity_candidates(
    listings: DataFrame,
    alias_map: DataFrame,
    reviews: DataFrame,
    limit: int = V.CANDIDATE_LIMIT,
    prelimit: bool = False,
) -> DataFrame:
    """Most frequent designer and maker texts that are not known, reviewed or junk.

    Texts are counted before they are cleaned. ``prelimit`` looks at the ``4 * limit`` most
    frequent texts only, and may then return fewer than ``limit``.
    """
    active = listings.filter(F.col("is_active") == 1)
    roles = F.explode(
        F.array(
            *[
                F.struct(F.col(role).alias("source_text"), F.lit(role).alias("source_role"))
                for role in V.CANDIDATE_ROLES
            ]
        )
    )
    counted = (
        active.select(roles.alias("r")).select("r.*")
        .filter(F.col("source_text") != "")
        .groupBy("source_text", "source_role")
        .agg(F.count(F.lit(1)).alias("listing_count"))
    )
    order = [F.col("listing_count").desc(), F.col("source_text"), F.col("source_role")]
    if prelimit:
        counted = counted.orderBy(*order).limit(4 * limit)
    decided = reviews.filter(F.col("review_status").isin(*V.REVIEW_STATUSES)).select(
        "source_role", F.col("normalized_source_text").alias("key")
    )
    return (
        counted.withColumn("key", filter_key(F.col("source_text")))
        .join(alias_map.select(F.col("alias_key").alias("key")), "key", "left_anti")
        .join(decided, ["source_role", "key"], "left_anti")
        .filter(clean_designer(F.col("source_text")) != "")
        .select("source_text", "source_role", "listing_count")
        .orderBy(*order)
        .limit(limit)
    )


def entity_reject(reviews: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """Candidate reviews after ``decisions(seq, source_text, source_role, review_status,
    entity_id, notes)``, one per (role, normalized text)."""
    rows = (
        decisions.withColumn("source_text", F.trim("source_text"))
        .withColumn("normalized_source_text", filter_key(F.col("source_text")))
        .filter((F.col("source_text") != "") & (F.col("normalized_source_text") != ""))
        .withColumns(
            {
                "source_role": _clamped(F.col("source_role"), V.CANDIDATE_ROLES, "designer"),
                "review_status": _clamped(F.col("review_status"), V.REVIEW_STATUSES, "rejected"),
                "notes": F.trim(text_or_empty(F.col("notes"))),
                "created_at": as_of,
                "updated_at": as_of,
            }
        )
    )
    keys = ["source_role", "normalized_source_text"]
    return _upsert_with_ids(reviews, latest(rows, keys, ["seq"]), keys)


def entity_evidence(evidence: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Evidence after ``rows(listing_id, entity_id, evidence_role, source_text)``."""
    clean = (
        rows.withColumn("source_text", F.trim("source_text"))
        .filter(F.col("source_text") != "")
        .withColumns(
            {
                "evidence_role": _clamped(F.col("evidence_role"), V.EVIDENCE_ROLES, "creator"),
                "normalized_source_text": filter_key(F.col("source_text")),
                "confidence": F.lit(1.0),
                "review_status": F.lit("approved"),
                "created_at": as_of,
                "updated_at": as_of,
            }
        )
    )
    keys = ["listing_id", "entity_id", "evidence_role", "normalized_source_text"]
    return _upsert_with_ids(
        evidence, latest(clean, keys, ["source_text"]), keys, ("confidence",)
    )


def _upsert_with_ids(
    target: DataFrame, rows: DataFrame, keys: list[str], preserve: tuple[str, ...] = ()
) -> DataFrame:
    fresh = with_new_ids(
        rows.join(target.select(*keys), keys, "left_anti"), keys, target.select("id")
    )
    stored = rows.join(target.select(*keys, "id"), keys)
    return sink_upsert(
        target, stored.unionByName(fresh), keys, preserve=("id", "created_at", *preserve)
    )


@dataclass
class EntityOutput:
    entities: DataFrame
    aliases: DataFrame
    evidence: DataFrame
    reviews: DataFrame


def evidence_rows(listings: DataFrame, decided: DataFrame) -> DataFrame:
    """Active listings whose designer (maker) text equals a decided text."""
    active = listings.filter(F.col("is_active") == 1)
    texts = active.select(
        F.col("id").alias("listing_id"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(role).alias("source_role"), F.col(role).alias("source_text"))
                    for role in V.CANDIDATE_ROLES
                ]
            )
        ).alias("r"),
    ).select("listing_id", "r.*")
    return texts.join(decided, ["source_role", "source_text"]).select(
        "listing_id", "entity_id", F.col("source_role").alias("evidence_role"), "source_text"
    )


def entity_approve(
    entities: DataFrame,
    aliases: DataFrame,
    evidence: DataFrame,
    reviews: DataFrame,
    listings: DataFrame,
    decisions: DataFrame,
    as_of: Column,
) -> EntityOutput:
    """Approve candidates: entity with the text as alias, evidence on listings, review.

    ``decisions(seq, source_text, source_role, canonical_name, entity_type, aliases, notes)``.
    """
    rows = decisions.withColumns(
        {
            "source_text": F.trim("source_text"),
            "source_role": _clamped(F.col("source_role"), V.CANDIDATE_ROLES, "designer"),
            "aliases": F.concat(
                F.array(F.trim("source_text")),
                F.coalesce(F.col("aliases"), F.array().cast("array<string>")),
            ),
        }
    )
    entities_after, aliases_after = entity_upsert(entities, aliases, rows, as_of)
    decided = (
        rows.withColumn("normalized_name", filter_key(F.trim("canonical_name")))
        .join(
            entities_after.select("normalized_name", F.col("id").alias("entity_id")),
            "normalized_name",
        )
        .withColumn("review_status", F.lit("approved"))
    )
    found = evidence_rows(
        listings, decided.select("source_role", "source_text", "entity_id").distinct()
    )
    return EntityOutput(
        entities_after,
        aliases_after,
        entity_evidence(evidence, found, as_of),
        entity_reject(
            reviews,
            decided.select("seq", "source_text", "source_role", "review_status", "entity_id",
                           "notes"),
            as_of,
        ),
    )


def entity_index(
    entities: DataFrame,
    aliases: DataFrame,
    evidence: DataFrame,
    query_key: Column | None = None,
    limit: int | None = V.ENTITY_INDEX_LIMIT,
) -> DataFrame:
    """Entities by name with their aliases and evidence counts.

    ``query_key`` is the normalized search text, looked up in names and aliases. The page of
    entities is cut first (None: all entities); each has all of its aliases.
    """
    chosen = entities
    if query_key is not None:
        by_alias = aliases.filter(F.col("normalized_alias").contains(query_key)).select(
            F.col("entity_id").alias("id")
        )
        by_name = entities.filter(F.col("normalized_name").contains(query_key)).select("id")
        chosen = entities.join(by_alias.unionByName(by_name), "id", "left_semi")
    first = chosen.orderBy("canonical_name", "id").limit(limit) if limit is not None else chosen
    page = first.select(
        "id", "canonical_name", "entity_type", "review_status", "notes"
    )
    wanted = page.select("id")
    own = aliases.withColumnRenamed("id", "_alias_id").withColumnRenamed("entity_id", "id").join(
        wanted, "id", "left_semi"
    )
    names = own.groupBy("id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    sizes = own.groupBy("id").agg(F.count(F.lit(1)).alias("alias_count"))
    # evidence ids are unique, so counting rows counts them; listings are made distinct by their
    # own key before an entity adds them up
    per_listing = (
        evidence.withColumnRenamed("entity_id", "_entity")
        .groupBy(F.col("_entity").alias("id"), "listing_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(wanted, "id", "left_semi")
    )
    counts = per_listing.groupBy("id").agg(
        F.sum("_n").alias("evidence_count"), F.count(F.lit(1)).alias("listing_count")
    )
    return (
        page.join(names, "id", "left")
        .join(sizes, "id", "left")
        .join(counts, "id", "left")
        .withColumns(
            {
                "aliases": F.coalesce("aliases", F.array().cast("array<string>")),
                "alias_count": F.coalesce("alias_count", F.lit(0)),
                "evidence_count": F.coalesce("evidence_count", F.lit(0)),
                "listing_count": F.coalesce("listing_count", F.lit(0)),
            }
        )
        .orderBy("canonical_name", "id")
    )


def canonicalize_listings(listings: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Adds ``designer_canonical`` and ``maker_canonical`` ('' where the text is no name).

    Each distinct text is cleaned once and looked up; listings then join the result.
    """
    texts = (
        listings.select(F.explode(F.array("designer", "maker")).alias("raw"))
        .distinct()
        .withColumn("cleaned", clean_designer(F.col("raw")))
        .withColumn("alias_key", filter_key(F.col("cleaned")))
    )
    names = texts.join(alias_map, "alias_key", "left").select(
        "raw",
        F.when((F.col("cleaned") == "") | (F.col("alias_key") == ""), "")
        .otherwise(F.coalesce("canonical_name", "cleaned"))
        .alias("name"),
    )
    result = listings
    for column in ("designer", "maker"):
        side = names.select(F.col("raw").alias(column),
                            F.col("name").alias(f"{column}_canonical"))
        result = result.join(side, column, "left")
    return result
