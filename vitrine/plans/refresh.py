"""Registered reconciliation queries: one per output of the refresh."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions.enrich import shipping_scope
from vitrine.operators import refresh as R
from vitrine.operators.skew import latest
from vitrine.plans.registry import query
from vitrine.schemas import TABLES
from vitrine.session import materialized, shared_dir
from vitrine.sources import adapters as A
from vitrine.sources import feeds as S
from vitrine.sources import tables as T
from vitrine.sources.buckets import BucketTable

AS_OF = A.REFRESH_AT
LISTING_SQL = ", ".join(TABLES["listings"].fieldNames())
UPDATED_SQL = ", ".join(
    f"CASE WHEN updated THEN i_{c} ELSE {c} END AS {c}"
    for c in R.ITEM_COLUMNS
    if c != "availability_status"
)
KEPT_SQL = ", ".join(
    c
    for c in TABLES["listings"].fieldNames()
    if c not in R.ITEM_COLUMNS
    and c not in ("is_active", "last_seen_at", "last_checked_at")
)
NEW_SQL = ", ".join(
    {
        "id": f"shop_id * {A.ID_STEP} + {A.NEW_ID_STEP} + seq AS id",
        "source_shop_id": "shop_id AS source_shop_id",
        "is_active": "1 AS is_active",
        "is_featured": "0 AS is_featured",
        **{c: f"TIMESTAMP '{AS_OF}' AS {c}"
           for c in ("last_seen_at", "last_checked_at", "first_seen_at")},
        **{c: f"CAST(NULL AS DOUBLE) AS {c}" for c in ("width", "depth", "height")},
    }.get(c, c if c in R.ITEM_COLUMNS else f"'' AS {c}")
    for c in TABLES["listings"].fieldNames()
)
NORMAL = "trim(lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g')))"

PARTS = {
    "items": f"""SELECT b.*, {NORMAL.format('title')} AS normalized_title
FROM batch b JOIN crawls c ON c.shop_id = b.shop_id
WHERE c.error = '' OR NOT EXISTS (SELECT 1 FROM prior p WHERE p.source_shop_id = b.shop_id)""",
    "matched": """SELECT i.*, p.id AS stored_id, p.is_active AS stored_active FROM items i
LEFT JOIN prior p ON p.source_shop_id = i.shop_id AND p.source_listing_key = i.source_listing_key""",
    "scored": f"""SELECT m.shop_id, m.source_listing_key, m.seq, m.title, p.id AS candidate_id,
  p.last_checked_at,
  CASE WHEN m.primary_image_url <> '' AND m.primary_image_url = p.primary_image_url THEN 2 ELSE 0 END
  + CASE WHEN m.source_description <> ''
      AND {NORMAL.format('m.source_description')} = {NORMAL.format('p.source_description')}
    THEN 2 ELSE 0 END
  + CASE WHEN m.price_value = p.price_value THEN 1 ELSE 0 END AS score
FROM matched m JOIN prior p
  ON p.source_shop_id = m.shop_id AND p.normalized_title = m.normalized_title
LEFT JOIN items o ON o.shop_id = p.source_shop_id AND o.source_listing_key = p.source_listing_key
WHERE (m.stored_id IS NULL OR m.stored_active = 0) AND o.shop_id IS NULL""",
    "best": """SELECT *, count(*) OVER (PARTITION BY shop_id, source_listing_key) AS ties FROM (
  SELECT * FROM scored WHERE score >= 2
  QUALIFY score = max(score) OVER (PARTITION BY shop_id, source_listing_key))""",
    "winners": """SELECT shop_id, source_listing_key, candidate_id AS drift_id FROM best
WHERE ties = 1
QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY seq, shop_id, source_listing_key) = 1""",
    "resolved": """SELECT m.*, w.drift_id, coalesce(w.drift_id, m.stored_id) AS target_id,
  CASE WHEN w.drift_id IS NOT NULL THEN m.stored_id END AS superseded_id
FROM matched m LEFT JOIN winners w
  ON w.shop_id = m.shop_id AND w.source_listing_key = m.source_listing_key""",
    "merged": f"""SELECT p.*, c.authoritative = 1 AND c.error = '' AND NOT coalesce(upd, false)
    AND (r.target_id IS NULL OR r.drift_id IS NOT NULL) AS hidden, coalesce(upd, false) AS updated,
  {', '.join(f'r.{c} AS i_{c}' for c in R.ITEM_COLUMNS)}
FROM prior p
LEFT JOIN (SELECT r.*, NOT (r.availability_status = 'sold_out' AND q.is_active = 0
    AND q.availability_status = 'removed') AS upd
  FROM resolved r JOIN prior q ON q.id = r.target_id) r ON r.target_id = p.id
JOIN crawls c ON c.shop_id = p.source_shop_id
WHERE p.id NOT IN (SELECT superseded_id FROM resolved WHERE superseded_id IS NOT NULL)""",
    "fresh": "SELECT * FROM resolved WHERE target_id IS NULL AND availability_status <> 'sold_out'",
}


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The stored catalog with what matching and events read of it."""
    return materialized(A.prior_listings(spark, folder).select(*R.READ_COLUMNS))


def outputs(spark: SparkSession, folder: str, prior: DataFrame | None = None) -> R.RefreshOutput:
    """The stored catalog and the batch are tables in practice, so they are written first.

    Each query reads one output, so items and merged rows stay in its plan.
    """
    return R.reconcile(
        stored(spark, folder) if prior is None else prior,
        materialized(A.refresh_batch(spark, folder)),
        A.crawls(spark, folder),
        A.shops(spark, folder),
        A.moment(AS_OF),
        new_id=A.refresh_new_id(),
        shops_bound=A.shops_bound(spark, folder),
        cut_merged=R.uncut,
    )


def matching(spark: SparkSession, folder: str, prior: DataFrame | None = None) -> R.Assignment:
    return R.match_batch(
        stored(spark, folder) if prior is None else prior,
        materialized(A.refresh_batch(spark, folder)),
        A.crawls(spark, folder),
        A.shops(spark, folder),
        shops_bound=A.shops_bound(spark, folder),
        cut_merged=R.uncut,
    )


@query(
    "refresh_keyed_match",
    "SELECT shop_id, source_listing_key, stored_id, stored_active FROM matched",
    PARTS,
)
def refresh_keyed_match(spark: SparkSession, folder: str) -> DataFrame:
    prior = stored(spark, folder)
    found = matching(spark, folder, prior)
    return R.keyed_match(found.items, prior).select(
        "shop_id", "source_listing_key", "stored_id", "stored_active"
    )


@query(
    "refresh_drift_match",
    """SELECT shop_id, source_listing_key, score, ties,
  CASE WHEN ties = 1 THEN min(candidate_id) END AS candidate_id
FROM best GROUP BY shop_id, source_listing_key, score, ties""",
    PARTS,
)
def refresh_drift_match(spark: SparkSession, folder: str) -> DataFrame:
    prior = stored(spark, folder)
    found = matching(spark, folder, prior)
    matched = R.keyed_match(found.items, prior)
    return R.drift_match(matched, found.candidates).select(
        "shop_id", "source_listing_key", "score", "ties",
        F.when(F.col("ties") == 1, F.col("candidate_id")).alias("candidate_id"),
    )


@query(
    "refresh_assignment",
    """SELECT shop_id, source_listing_key, target_id, superseded_id,
  CAST(drift_id IS NOT NULL AS INTEGER) AS reconciled FROM resolved""",
    PARTS,
)
def refresh_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return matching(spark, folder).resolved.select(
        "shop_id", "source_listing_key", "target_id", "superseded_id",
        F.col("reconciled").cast("int").alias("reconciled"),
    )


@query(
    "refresh_ambiguous_review",
    f"""SELECT shop_id, TIMESTAMP '{AS_OF}' AS created_at, source_listing_key, title,
  string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY last_checked_at DESC, candidate_id DESC)
    AS candidate_listing_ids,
  'Ambiguous source-key reconciliation at score ' || score AS reason, 'open' AS status,
  ties AS candidate_count
FROM best WHERE ties > 1 GROUP BY shop_id, source_listing_key, title, score, ties""",
    PARTS,
)
def refresh_ambiguous_review(spark: SparkSession, folder: str) -> DataFrame:
    out = outputs(spark, folder)
    return R.with_candidate_texts(out.reviews, out.review_candidates).drop("candidate_groups")


@query(
    "refresh_event_reassign",
    """SELECT e.id, coalesce(r.target_id, e.listing_id) AS listing_id, e.shop_id,
  coalesce(r.source_listing_key, e.source_listing_key) AS source_listing_key, e.observed_at,
  e.from_status, e.to_status, e.event_type
FROM availability_events e LEFT JOIN resolved r ON r.superseded_id = e.listing_id""",
    PARTS,
)
def refresh_event_reassign(spark: SparkSession, folder: str) -> DataFrame:
    moves = R.event_moves(matching(spark, folder).resolved)
    return R.reassign_events(A.availability_events(spark, folder), moves)


@query(
    "refresh_skip_sold",
    """SELECT r.shop_id, r.source_listing_key, r.target_id FROM resolved r
LEFT JOIN prior p ON p.id = r.target_id
WHERE r.availability_status = 'sold_out'
  AND (r.target_id IS NULL OR (p.is_active = 0 AND p.availability_status = 'removed'))""",
    PARTS,
)
def refresh_skip_sold(spark: SparkSession, folder: str) -> DataFrame:
    """Items that are skipped: new but sold out, or sold out where the stored row is removed."""
    found = matching(spark, folder)
    skipped = found.merged.filter(F.col("item").isNotNull() & ~F.col("updated")).select(
        F.col("source_shop_id").alias("shop_id"),
        F.col("item.source_listing_key").alias("source_listing_key"),
        F.col("id").alias("target_id"),
    )
    unknown = found.resolved.filter(
        F.col("target_id").isNull() & (F.col("availability_status") == "sold_out")
    ).select("shop_id", "source_listing_key", "target_id")
    return skipped.unionByName(unknown)


@query(
    "refresh_upsert",
    f"""SELECT {LISTING_SQL} FROM (
  SELECT {KEPT_SQL}, {UPDATED_SQL},
    CASE WHEN updated THEN i_availability_status WHEN hidden THEN 'removed'
      ELSE availability_status END AS availability_status,
    CASE WHEN updated THEN 1 WHEN hidden THEN 0 ELSE is_active END AS is_active,
    CASE WHEN updated THEN TIMESTAMP '{AS_OF}' ELSE last_seen_at END AS last_seen_at,
    CASE WHEN updated OR hidden THEN TIMESTAMP '{AS_OF}' ELSE last_checked_at END AS last_checked_at
  FROM merged)
UNION ALL SELECT {NEW_SQL} FROM fresh""",
    PARTS,
)
def refresh_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return outputs(spark, folder, materialized(A.prior_listings(spark, folder))).listings


_AVAILABILITY_SQL = f"""SELECT id AS listing_id, source_shop_id AS shop_id,
  CASE WHEN updated THEN i_source_listing_key ELSE source_listing_key END AS source_listing_key,
  TIMESTAMP '{AS_OF}' AS observed_at, availability_status AS from_status,
  CASE WHEN updated THEN i_availability_status ELSE 'removed' END AS to_status,
  'source_refresh' AS event_type
FROM merged WHERE (updated AND availability_status <> i_availability_status)
  OR (hidden AND is_active = 1 AND availability_status <> 'removed')
UNION ALL SELECT shop_id * {A.ID_STEP} + {A.NEW_ID_STEP} + seq, shop_id, source_listing_key,
  TIMESTAMP '{AS_OF}', '', availability_status, 'discovered' FROM fresh"""


@query("refresh_availability_events", _AVAILABILITY_SQL, PARTS)
def refresh_availability_events(spark: SparkSession, folder: str) -> DataFrame:
    return outputs(spark, folder).availability_events


@query(
    "refresh_availability_log",
    """SELECT *, (SELECT max(id) FROM availability_events)
  + row_number() OVER (ORDER BY listing_id) AS id FROM changes""",
    {**PARTS, "changes": _AVAILABILITY_SQL},
)
def refresh_availability_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events as they are appended to the stored log."""
    log = A.availability_events(spark, folder)
    return R.with_log_ids(
        outputs(spark, folder), {"availability_events": log}
    ).availability_events


@query(
    "refresh_price_events",
    f"""SELECT id AS listing_id, source_shop_id AS shop_id, i_source_listing_key AS source_listing_key,
  TIMESTAMP '{AS_OF}' AS observed_at, price_raw AS from_price_raw, price_value AS from_price_value,
  i_price_raw AS to_price_raw, i_price_value AS to_price_value, i_currency AS currency,
  'source_refresh' AS event_type
FROM merged WHERE updated AND (price_raw <> i_price_raw
  OR price_value IS DISTINCT FROM i_price_value OR currency <> i_currency)
UNION ALL SELECT shop_id * {A.ID_STEP} + {A.NEW_ID_STEP} + seq, shop_id, source_listing_key,
  TIMESTAMP '{AS_OF}', '', NULL, price_raw, price_value, currency, 'discovered'
FROM fresh WHERE price_value IS NOT NULL""",
    PARTS,
)
def refresh_price_events(spark: SparkSession, folder: str) -> DataFrame:
    return outputs(spark, folder).price_events


@query(
    "refresh_deactivate_missing",
    """SELECT id, source_listing_key, availability_status AS old_status, is_active AS old_active
FROM merged WHERE hidden""",
    PARTS,
)
def refresh_deactivate_missing(spark: SparkSession, folder: str) -> DataFrame:
    return matching(spark, folder).merged.filter("hidden").select(
        "id", "source_listing_key", F.col("availability_status").alias("old_status"),
        F.col("is_active").alias("old_active"),
    )


@query(
    "refresh_error_policy",
    """SELECT c.shop_id, c.error,
  CAST(c.error <> '' AND coalesce(p.n, 0) > 0 AS INTEGER) AS kept_existing,
  CAST(c.authoritative = 1 AND c.error = '' AS INTEGER) AS hides,
  CAST(CASE WHEN c.error <> '' AND coalesce(p.n, 0) > 0 THEN 0 ELSE coalesce(b.n, 0) END AS INTEGER)
    AS listings_found
FROM crawls c
LEFT JOIN (SELECT source_shop_id, count(*) AS n FROM prior GROUP BY 1) p
  ON p.source_shop_id = c.shop_id
LEFT JOIN (SELECT shop_id, count(*) AS n FROM batch GROUP BY 1) b ON b.shop_id = c.shop_id""",
)
def refresh_error_policy(spark: SparkSession, folder: str) -> DataFrame:
    states = R.crawl_states(
        A.crawls(spark, folder), A.refresh_batch(spark, folder), A.prior_listings(spark, folder)
    )
    return states.select(
        "shop_id", "error", F.col("kept_existing").cast("int").alias("kept_existing"),
        F.col("hides").cast("int").alias("hides"), "listings_found",
    )


@query(
    "refresh_result",
    f"""SELECT c.shop_id, c.source_slug, TIMESTAMP '{AS_OF}' AS started_at,
  CASE WHEN c.error <> '' THEN 'warning' ELSE 'success' END AS status,
  (SELECT CAST(count(*) AS INTEGER) FROM items i WHERE i.shop_id = c.shop_id) AS listings_found,
  (SELECT CAST(count(*) AS INTEGER) FROM fresh f WHERE f.shop_id = c.shop_id) AS new_count,
  (SELECT CAST(count(*) AS INTEGER) FROM winners w WHERE w.shop_id = c.shop_id)
    AS reconciled_count,
  (SELECT CAST(count(*) AS INTEGER) FROM merged m WHERE m.source_shop_id = c.shop_id AND m.hidden)
    AS hidden_count,
  c.error AS error_message,
  CAST(c.error <> '' AND EXISTS (SELECT 1 FROM prior p WHERE p.source_shop_id = c.shop_id)
    AS INTEGER) AS kept_existing
FROM crawls c""",
    PARTS,
)
def refresh_result(spark: SparkSession, folder: str) -> DataFrame:
    return outputs(spark, folder).jobs.drop("chunk_index", "entry_url", "finished_at")


@query(
    "refresh_all",
    """SELECT CAST(count(*) AS BIGINT) AS shops, CAST(sum(f) AS BIGINT) AS found,
  CAST(sum(n) AS BIGINT) AS added, CAST(sum(h) AS BIGINT) AS hidden
FROM (SELECT (SELECT count(*) FROM items i WHERE i.shop_id = c.shop_id) AS f,
    (SELECT count(*) FROM fresh f WHERE f.shop_id = c.shop_id) AS n,
    (SELECT count(*) FROM merged m WHERE m.source_shop_id = c.shop_id AND m.hidden) AS h
  FROM crawls c)""",
    PARTS,
)
def refresh_all(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over the jobs of all shops, which are refreshed in one pass."""
    return outputs(spark, folder).jobs.agg(
        F.count(F.lit(1)).alias("shops"), F.sum("listings_found").alias("found"),
        F.sum("new_count").alias("added"), F.sum("hidden_count").alias("hidden"),
    )


# --- chunked sources ----------------------------------------------------------------------------

CHUNK_SINCE = "2000-01-01 00:00:00"
CHUNK_PARTS = {
    "chunk_done": f"""SELECT j.source_slug, chunk_index, started_at, j.id, listings_found
FROM jobs j JOIN expected e ON e.source_slug = j.source_slug
WHERE status = 'success' AND chunk_index IS NOT NULL AND started_at >= TIMESTAMP '{CHUNK_SINCE}'
  AND chunk_index >= 0 AND chunk_index < e.chunk_count
QUALIFY row_number() OVER (
  PARTITION BY j.source_slug, chunk_index ORDER BY started_at DESC, j.id DESC) = 1""",
    "chunk_missing": """SELECT e.source_slug,
  string_agg(CAST(i AS VARCHAR), ', ' ORDER BY i) AS missing
FROM expected e, unnest(range(e.chunk_count)) t(i)
LEFT JOIN chunk_done d ON d.source_slug = e.source_slug AND d.chunk_index = i
WHERE d.id IS NULL GROUP BY 1""",
    "chunk_cut": """SELECT e.source_slug, s.id AS shop_id, m.missing, d.cutoff, d.found
FROM expected e JOIN shops s ON s.slug = e.source_slug
LEFT JOIN chunk_missing m ON m.source_slug = e.source_slug
LEFT JOIN (SELECT source_slug, min(started_at) AS cutoff, sum(listings_found) AS found
  FROM chunk_done GROUP BY 1) d ON d.source_slug = e.source_slug""",
    "chunk_hidden": """SELECT l.* FROM listings l JOIN chunk_cut c ON c.shop_id = l.source_shop_id
WHERE c.missing IS NULL AND l.is_active = 1 AND l.last_seen_at < c.cutoff""",
}


def chunk_outputs(spark: SparkSession, folder: str) -> R.ChunkOutput:
    return R.chunk_reconcile(
        A.listings(spark, folder), A.shops(spark, folder), A.refresh_jobs(spark, folder),
        A.expected_jobs(spark, folder), A.moment(A.JOBS_DAY), A.moment(CHUNK_SINCE),
    )


@query(
    "chunk_latest_success",
    "SELECT source_slug, chunk_index, started_at, id, listings_found FROM chunk_done",
    CHUNK_PARTS,
)
def chunk_latest_success(spark: SparkSession, folder: str) -> DataFrame:
    return R.chunk_latest_success(
        A.refresh_jobs(spark, folder), A.expected_jobs(spark, folder), A.moment(CHUNK_SINCE)
    )


@query(
    "chunk_reconcile",
    """SELECT c.shop_id, c.source_slug,
  CASE WHEN missing IS NULL THEN 'success' ELSE 'warning' END AS status,
  CAST(CASE WHEN missing IS NULL THEN coalesce(found, 0) ELSE 0 END AS INTEGER) AS listings_found,
  (SELECT CAST(count(*) AS INTEGER) FROM chunk_hidden h WHERE h.source_shop_id = c.shop_id)
    AS hidden_count,
  CASE WHEN missing IS NULL THEN ''
    ELSE 'Missing successful chunk jobs for indexes: ' || missing END AS error_message,
  CAST(missing IS NOT NULL AS INTEGER) AS kept_existing
FROM chunk_cut c""",
    CHUNK_PARTS,
)
def chunk_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_outputs(spark, folder).results.select(
        "shop_id", "source_slug", "status", "listings_found", "hidden_count", "error_message",
        "kept_existing",
    )


@query(
    "chunk_reconcile_listings",
    f"""SELECT l.id, CAST(CASE WHEN h.id IS NULL THEN l.is_active ELSE 0 END AS INTEGER) AS is_active,
  CASE WHEN h.id IS NULL THEN l.availability_status ELSE 'removed' END AS availability_status,
  CASE WHEN h.id IS NULL THEN l.last_checked_at ELSE TIMESTAMP '{A.JOBS_DAY}' END AS last_checked_at
FROM listings l LEFT JOIN chunk_hidden h ON h.id = l.id""",
    CHUNK_PARTS,
)
def chunk_reconcile_listings(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_outputs(spark, folder).listings.select(
        "id", "is_active", "availability_status", "last_checked_at"
    )


@query(
    "chunk_reconcile_events",
    f"""SELECT id AS listing_id, source_shop_id AS shop_id, source_listing_key,
  TIMESTAMP '{A.JOBS_DAY}' AS observed_at, availability_status AS from_status,
  'removed' AS to_status, 'source_reconciliation' AS event_type
FROM chunk_hidden WHERE availability_status <> 'removed'""",
    CHUNK_PARTS,
)
def chunk_reconcile_events(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_outputs(spark, folder).availability_events


# --- sinks and crawl-level rules ----------------------------------------------------------------


@query(
    "sink_upsert",
    """SELECT coalesce(p.id, l.id) AS id, coalesce(p.first_seen_at, l.first_seen_at) AS first_seen_at,
  coalesce(l.last_seen_at, p.last_seen_at) AS last_seen_at,
  CASE WHEN l.id IS NULL THEN p.price_value ELSE l.price_value END AS price_value,
  CASE WHEN l.id IS NULL THEN p.availability_status ELSE l.availability_status END
    AS availability_status
FROM prior p FULL OUTER JOIN (SELECT * FROM listings
  WHERE last_seen_at >= TIMESTAMP '1999-01-01') l ON l.id = p.id""",
)
def sink_upsert(spark: SparkSession, folder: str) -> DataFrame:
    changed = A.listings(spark, folder).filter(
        F.col("last_seen_at") >= A.moment(A.REFRESH_FROM)
    )
    # one shop's rows change together, and a row's shop never does
    table = BucketTable(
        f"{shared_dir(spark)}/vitrine/table-{uuid.uuid4().hex}", ("source_shop_id", "id"), ("source_shop_id",)
    )
    table.replace(A.prior_listings(spark, folder), 0)
    table.upsert(changed, 1, preserve=("first_seen_at",))
    return table.read(spark).select("id", "first_seen_at", "last_seen_at", "price_value", "availability_status")


@query(
    "sink_seed_shops",
    """SELECT l.id, CASE WHEN l.source_shop_id % 6 = 5 THEN 0 ELSE l.is_active END AS is_active
FROM listings l""",
)
def sink_seed_shops(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of shops that are no longer defined become inactive."""
    shops = A.shops(spark, folder)
    defined = shops.filter(F.col("id") % 6 != 5)
    _, listings = T.seed_shops(shops, A.listings(spark, folder), defined)
    return listings.select("id", "is_active")


@query(
    "sink_seed_shops_dimension",
    """SELECT id, slug, CASE WHEN id % 6 = 5 THEN name ELSE 'New ' || name END AS name,
  CAST(id % 6 <> 5 AS INTEGER) AS active FROM shops""",
)
def sink_seed_shops_dimension(spark: SparkSession, folder: str) -> DataFrame:
    shops = A.shops(spark, folder)
    defined = shops.filter(F.col("id") % 6 != 5).withColumns(
        {"name": F.concat(F.lit("New "), "name"), "id": F.lit(-1).cast("bigint")}
    )
    seeded, _ = T.seed_shops(shops, A.listings(spark, folder), defined)
    return seeded.select("id", "slug", "name", "active")


@query(
    "sink_append_events",
    """SELECT id, listing_id, observed_at, to_status FROM availability_events""",
)
def sink_append_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log written in two appends and read back."""
    import uuid

    from vitrine.session import shared_dir

    path = f"{shared_dir(spark)}/event-log-{uuid.uuid4().hex}"
    events = materialized(A.availability_events(spark, folder))
    T.append_events(events.filter(F.col("event_type") == "discovered"), path)
    T.append_events(events.filter(F.col("event_type") != "discovered"), path)
    return T.read_events(spark, path).select("id", "listing_id", "observed_at", "to_status")


@query(
    "feed_dedupe_last",
    """SELECT listing_id, shop_id, part_id, status, price, ts, ok, ln FROM history
QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY ts DESC, ok DESC, ln DESC) = 1""",
)
def feed_dedupe_last(spark: SparkSession, folder: str) -> DataFrame:
    return S.dedupe_last(A.history(spark, folder), ["listing_id"], A.ORDER)


@query(
    "feed_dedupe_identity",
    """SELECT id, source_shop_id, page_key FROM (
  SELECT *, row_number() OVER (PARTITION BY source_shop_id, page_key
    ORDER BY (primary_image_url = ''), pri DESC, id, page) AS rk FROM (
    SELECT *, row_number() OVER (PARTITION BY source_shop_id, identity
      ORDER BY (primary_image_url = ''), pri DESC, id, page) AS ri FROM (
      SELECT id, source_shop_id, primary_image_url, page,
        CASE WHEN page = 'news' THEN 0 ELSE 1 END AS pri, page || ':' || source_listing_key AS page_key,
        CASE WHEN primary_image_url <> '' THEN 'i' || normalized_title || '|' || primary_image_url
          || '|' || source_description
        ELSE 'k' || page || ':' || source_listing_key END AS identity
      FROM listings, (VALUES ('news'), ('shop')) t(page)))
  WHERE ri = 1) WHERE rk = 1""",
)
def feed_dedupe_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing crawled twice: from the news page and from its category page."""
    crawled = A.listings(spark, folder).withColumn(
        "page", F.explode(F.array(F.lit("news"), F.lit("shop")))
    ).withColumn("page_key", F.concat_ws(":", "page", "source_listing_key"))
    priority = F.when(F.col("page") == "news", 0).otherwise(1)
    return S.dedupe_identity(
        crawled, "source_shop_id", "page_key", ["id", "page"], priority, ["id"]
    ).select("id", "source_shop_id", "page_key")


@query(
    "feed_cap",
    """SELECT source_shop_id, id FROM listings
QUALIFY row_number() OVER (PARTITION BY source_shop_id ORDER BY id) <= 200""",
)
def feed_cap(spark: SparkSession, folder: str) -> DataFrame:
    return S.feed_cap(A.listings(spark, folder), "source_shop_id", ["id"]).select(
        "source_shop_id", "id"
    )


@query(
    "feed_cap_per_source",
    """SELECT source_shop_id, id FROM listings
QUALIFY row_number() OVER (PARTITION BY source_shop_id ORDER BY id) <= CASE source_shop_id
  WHEN 2 THEN 600 WHEN 5 THEN 120 WHEN 7 THEN 1000000000 ELSE 200 END""",
)
def feed_cap_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """One source with a larger limit, one with a smaller and one without."""
    own = spark.createDataFrame(
        [(2, V.FEED_LIMIT_BULK), (5, V.FEED_LIMIT_LEGACY), (7, None)], "source_shop_id long, limit long"
    )
    return S.feed_cap(
        A.listings(spark, folder), "source_shop_id", ["id"], own_limits=own
    ).select("source_shop_id", "id")


@query(
    "feed_fallback",
    """SELECT 's' || shop_id AS source_slug, source_listing_key, 'live_fetch' AS ingest_source_type,
  CAST(0.86 AS DOUBLE) AS parse_confidence
FROM batch WHERE shop_id % 10 <> 3
UNION ALL SELECT 's' || source_shop_id, source_listing_key, 'seed_fallback', CAST(0.45 AS DOUBLE)
FROM prior WHERE source_shop_id % 10 = 3""",
)
def feed_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose crawl failed fall back to what was stored before."""
    columns = ["source_slug", "source_listing_key", "ingest_source_type", "parse_confidence"]
    live = A.refresh_batch(spark, folder).withColumn(
        "source_slug", F.concat(F.lit("s"), F.col("shop_id").cast("string"))
    ).select(*columns)
    seed = A.prior_listings(spark, folder).withColumn(
        "source_slug", F.concat(F.lit("s"), F.col("source_shop_id").cast("string"))
    ).select(*columns)
    return S.with_fallback(live, seed, A.crawls(spark, folder))


@query(
    "shipping_scope",
    """SELECT id, CASE id % 5 WHEN 0 THEN 'worldwide_quote' WHEN 1 THEN 'international'
  WHEN 2 THEN 'canada_us' WHEN 3 THEN 'canada' ELSE 'local_quote' END AS shipping_scope FROM shops""",
)
def scope_of_shops(spark: SparkSession, folder: str) -> DataFrame:
    return A.shops(spark, folder).select(
        "id", shipping_scope(F.col("shipping_summary")).alias("shipping_scope")
    )


@query(
    "feed_last_seen",
    """SELECT shop_id, max(ts) AS ts FROM history GROUP BY 1""",
)
def feed_last_seen(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of every shop, whatever the share of the largest shop."""
    rows = A.history(spark, folder).select("shop_id", "ts", "ok", "ln")
    return latest(rows, ["shop_id"], A.ORDER).select("shop_id", "ts")
