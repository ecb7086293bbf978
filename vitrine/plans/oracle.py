"""The adapters' definitions in SQL, as named parts of a WITH clause."""

from __future__ import annotations

import re

from vitrine.sources import adapters as A

_SHIPPING = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(A.SHIPPING))


def _listings(states: str) -> str:
    return f"""
SELECT s.listing_id AS id, s.shop_id AS source_shop_id,
  'https://s' || s.shop_id || '.example.com/p/' || s.part_id AS source_listing_url,
  'p' || s.part_id AS source_listing_key, p_name AS title,
  trim(lower(regexp_replace(p_name, '[^\\p{{L}}\\p{{N}}]', ' ', 'g'))) AS normalized_title,
  CASE WHEN s.price IS NULL THEN '' ELSE printf('$%.2f CAD', s.price) END AS price_raw,
  s.price AS price_value, 'CAD' AS currency,
  CASE WHEN s.part_id % 26 = 0 THEN '' ELSE 'https://img.example.com/' || s.part_id || '.jpg' END
    AS primary_image_url,
  '[]' AS additional_image_urls, s.status AS availability_status, 'canada' AS shipping_scope,
  CAST(p_size % 2 AS INTEGER) AS ships_to_montreal,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE sh.shipping_summary END AS shipping_note,
  s.last_ts AS last_seen_at, s.last_ts AS last_checked_at, s.first_ts AS first_seen_at,
  lower(p_type) AS category, '' AS subcategory, p_brand AS designer,
  CASE WHEN p_size % 4 = 0 THEN p_brand || ' Works' ELSE '' END AS maker,
  '19' || (40 + 10 * (p_size % 5)) || 's' AS era, replace(p_name, ' ', ', ') AS materials,
  '' AS dimensions_text, CAST(NULL AS DOUBLE) AS width, CAST(NULL AS DOUBLE) AS depth,
  CAST(NULL AS DOUBLE) AS height,
  CASE p_size % 3 WHEN 0 THEN 'Restored' WHEN 1 THEN 'Restored, Refinished' ELSE '' END
    AS condition_text,
  sh.city || ', ' || sh.province AS location_text,
  CASE WHEN s.part_id % 26 = 0 THEN p_name ELSE p_name || ' ' || p_brand || ' #' || s.part_id END
    AS source_description,
  'refresh' AS ingest_source_type, CAST(0.86 AS DOUBLE) AS parse_confidence,
  '' AS dedupe_group_id, CAST(s.status <> 'removed' AS INTEGER) AS is_active, 0 AS is_featured,
  '' AS manual_notes,
  CASE WHEN s.part_id % 97 = 0 THEN 'sold_out' ELSE '' END AS availability_override,
  CASE WHEN s.part_id % 31 = 0 THEN 'lighting' ELSE '' END AS category_override
FROM {states} s JOIN part ON p_partkey = s.part_id JOIN shops sh ON sh.id = s.shop_id"""


def _last(where: str) -> str:
    return f"""
SELECT * FROM (
  SELECT *, min(ts) OVER (PARTITION BY listing_id) AS first_ts,
    max(ts) OVER (PARTITION BY listing_id) AS last_ts,
    row_number() OVER (PARTITION BY listing_id ORDER BY ts DESC, ok DESC, ln DESC) AS rn
  FROM history WHERE {where}) WHERE rn = 1"""


PARTS: dict[str, str] = {
    "shops": f"""
SELECT s_suppkey AS id, 's' || s_suppkey AS slug, s_name AS name,
  'https://s' || s_suppkey || '.example.com' AS website, '' AS wordmark_text,
  '' AS wordmark_style,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_suppkey || ' Main Street' END AS street_address,
  n_name AS city, r_name AS province, 'H' || (s_suppkey % 10) || 'A' AS postal_code,
  'Canada' AS country,
  CASE WHEN s_suppkey % 4 <> 0 THEN CAST(45 AS DOUBLE) + CAST(s_suppkey % 100 AS DOUBLE) / 100 END
    AS latitude,
  CASE WHEN s_suppkey % 4 <> 0 THEN CAST(-73 AS DOUBLE) - CAST(s_suppkey % 100 AS DOUBLE) / 100 END
    AS longitude,
  '' AS public_location_note, CAST(n_regionkey = 1 AS INTEGER) AS is_montreal_local,
  CASE s_suppkey % 5 {_SHIPPING} END AS shipping_summary, 'shop' AS source_type,
  CAST(s_suppkey % 3 + 1 AS INTEGER) AS crawl_priority, '' AS notes,
  'Shop ' || s_name AS description, '' AS style_focus,
  'https://s' || s_suppkey || '.example.com/shop' AS listing_url,
  CAST(s_acctbal >= 0 AS INTEGER) AS active
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "history": f"""
SELECT l_suppkey * {A.ID_STEP} + l_partkey AS listing_id, l_suppkey AS shop_id,
  l_partkey AS part_id,
  CASE WHEN l_returnflag = 'R' THEN 'sold_out'
    WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'removed' ELSE 'available' END AS status,
  CASE WHEN l_quantity >= 5 THEN l_extendedprice END AS price, l_shipdate AS ts,
  l_orderkey AS ok, l_linenumber AS ln
FROM lineitem""",
    "last_states": _last("true"),
    "listings": _listings("last_states"),
    "state_changes": """
SELECT *, ok * 10 + ln AS id, lag(status) OVER w AS prev_status, lag(price) OVER w AS prev_price,
  row_number() OVER w = 1 AS is_first
FROM history WINDOW w AS (PARTITION BY listing_id ORDER BY ts, ok, ln)""",
    "availability_events": """
SELECT id, listing_id, shop_id, 'p' || part_id AS source_listing_key, ts AS observed_at,
  coalesce(prev_status, '') AS from_status, status AS to_status,
  CASE WHEN is_first THEN 'discovered' ELSE 'source_refresh' END AS event_type
FROM state_changes WHERE is_first OR status <> prev_status""",
    "price_events": """
SELECT id, listing_id, shop_id, 'p' || part_id AS source_listing_key, ts AS observed_at,
  CASE WHEN prev_price IS NULL THEN '' ELSE printf('$%.2f CAD', prev_price) END AS from_price_raw,
  prev_price AS from_price_value,
  CASE WHEN price IS NULL THEN '' ELSE printf('$%.2f CAD', price) END AS to_price_raw,
  price AS to_price_value, 'CAD' AS currency,
  CASE WHEN is_first THEN 'discovered' ELSE 'source_refresh' END AS event_type
FROM state_changes
WHERE (is_first AND price IS NOT NULL) OR (NOT is_first AND price IS DISTINCT FROM prev_price)""",
    "effective": """
SELECT l.*, coalesce(nullif(availability_override, ''), availability_status)
    AS effective_availability,
  coalesce(nullif(category_override, ''), category) AS effective_category
FROM listings l""",
    "visible": """
SELECT e.*, s.slug AS shop_slug, s.name AS shop_name, s.wordmark_text AS shop_wordmark_text,
  s.wordmark_style AS shop_wordmark_style, s.is_montreal_local
FROM effective e JOIN shops s ON s.id = e.source_shop_id
WHERE s.active = 1 AND e.is_active = 1 AND effective_availability <> 'removed'
  AND (effective_availability <> 'sold_out' OR availability_override = 'sold_out'
    OR EXISTS (SELECT 1 FROM availability_events a WHERE a.listing_id = e.id
      AND a.from_status = 'available' AND a.to_status = 'sold_out'))""",
    "prior_states": _last(f"ts < TIMESTAMP '{A.REFRESH_FROM}'"),
    "prior": _listings("prior_states"),
    "batch_states": _last(f"ts >= TIMESTAMP '{A.REFRESH_FROM}'"),
    "batch": """
SELECT shop_id, part_id AS seq,
  'https://s' || shop_id || '.example.com/p/' || part_id AS source_listing_url,
  'p' || part_id || CASE WHEN part_id % 13 = 0 THEN '-v2' ELSE '' END AS source_listing_key,
  p_name AS title,
  CASE WHEN price IS NULL THEN '' ELSE printf('$%.2f CAD', price) END AS price_raw,
  price AS price_value, 'CAD' AS currency,
  CASE WHEN part_id % 26 = 0 THEN '' ELSE 'https://img.example.com/' || part_id || '.jpg' END
    AS primary_image_url,
  '[]' AS additional_image_urls,
  CASE WHEN status = 'sold_out' THEN 'sold_out' ELSE 'available' END AS availability_status,
  'canada' AS shipping_scope, 1 AS ships_to_montreal, '' AS shipping_note,
  lower(p_type) AS category, p_brand AS designer, '' AS maker, '' AS era,
  replace(p_name, ' ', ', ') AS materials, '' AS dimensions_text, '' AS condition_text,
  sh.city || ', ' || sh.province AS location_text,
  CASE WHEN part_id % 26 = 0 THEN p_name ELSE p_name || ' ' || p_brand || ' #' || part_id END
    AS source_description,
  'live_fetch' AS ingest_source_type, CAST(0.86 AS DOUBLE) AS parse_confidence
FROM batch_states JOIN part ON p_partkey = part_id JOIN shops sh ON sh.id = shop_id""",
    "crawls": """
SELECT id AS shop_id, slug AS source_slug, CASE WHEN id % 10 = 7 THEN 0 ELSE 1 END AS authoritative,
  CASE WHEN id % 10 = 3 THEN 'timeout' ELSE '' END AS error
FROM shops""",
    "jobs": """
SELECT o_orderkey AS id, o_custkey % 10 AS shop_id, 's' || (o_custkey % 10) AS source_slug,
  nullif(CAST(o_orderkey % 13 AS INTEGER), 12) AS chunk_index, '' AS entry_url,
  o_orderdate + to_seconds(o_orderkey % 86400) AS started_at,
  CASE WHEN o_orderstatus IN ('F', 'O')
    THEN o_orderdate + to_seconds(o_orderkey % 86400) + INTERVAL 10 MINUTE END AS finished_at,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'warning' ELSE 'running' END AS status,
  CAST(floor(o_totalprice / 1000) AS INTEGER) AS listings_found,
  CAST(o_orderkey % 7 AS INTEGER) AS new_count,
  CAST(o_orderkey % 3 AS INTEGER) AS reconciled_count,
  CAST(o_orderkey % 200 AS INTEGER) AS hidden_count,
  CASE WHEN o_orderstatus = 'O' THEN 'warning ' || o_orderpriority ELSE '' END AS error_message
FROM orders""",
    "crawl_runs": """
SELECT id, shop_id, started_at AS ran_at, status, listings_found, error_message FROM jobs""",
    "crawl_failures": """
SELECT id, shop_id, started_at AS created_at, error_message FROM jobs WHERE status = 'warning'""",
    "expected": """
SELECT slug AS source_slug, CAST(id % 10 * 5 + 1 AS INTEGER) AS expected_jobs,
  CASE id % 3 WHEN 0 THEN 12 WHEN 1 THEN 13 ELSE 0 END AS chunk_count
FROM shops WHERE id % 10 <> 4""",
    "event_rows": """
SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "page_views": """
SELECT event_id, ts,
  CASE event_type WHEN 'view' THEN '/listing/MCM-' || k
    WHEN 'click' THEN '/shops/s' || (k % 10) || '?from=card' WHEN 'signup' THEN '/favourites'
    WHEN 'purchase' THEN 'categories/c' || (k % 7) ELSE '/healthz' END AS path,
  CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS lang
FROM event_rows""",
    "views": """
SELECT CAST(ts AS DATE) AS view_date,
  CASE WHEN path LIKE '/listing/%' THEN 'listing' WHEN path LIKE '/shops/%' THEN 'shop'
    WHEN path = '/favourites' THEN 'favourites' ELSE 'other' END AS page_type,
  CASE WHEN path LIKE '/%' THEN split_part(path, '?', 1) ELSE '/' || path END AS path_key,
  CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'en' END AS lang,
  count(*) AS views, max(ts) AS updated_at
FROM page_views WHERE path <> '/healthz' GROUP BY 1, 2, 3, 4""",
    "listing_toggles": f"""
SELECT sha256(CAST(user_id AS VARCHAR)) AS owner_key, user_id % 10 * {A.ID_STEP} + k AS listing_id,
  ts
FROM event_rows WHERE event_type = 'click'""",
    "shop_toggles": """
SELECT sha256(CAST(user_id AS VARCHAR)) AS owner_key, k AS shop_id, ts
FROM event_rows WHERE event_type = 'view'""",
    "favourite_listings": """
SELECT owner_key, listing_id, max(ts) AS created_at FROM listing_toggles
GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
    "favourite_shops": """
SELECT owner_key, shop_id, max(ts) AS created_at FROM shop_toggles
GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
    "search_arguments": """
SELECT sha256(CAST(user_id AS VARCHAR)) AS owner_key, ts, event_id AS seq,
  CASE WHEN k % 3 = 0 THEN 'red & blue ~ring*' ELSE '' END AS q,
  CASE WHEN k % 5 = 0 THEN 's' || (k % 4) ELSE '' END AS shop,
  CASE WHEN k % 2 = 0 THEN 'promo' ELSE '' END AS category,
  CASE WHEN k % 7 = 0 THEN 'Brand#3' ELSE '' END AS designer,
  CASE k % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'sold_out' WHEN 2 THEN 'all' ELSE '' END
    AS availability,
  CASE WHEN k % 4 = 1 THEN '100' ELSE '' END AS price_min,
  CASE WHEN k % 6 = 1 THEN '900' ELSE '' END AS price_max,
  CASE k % 2 WHEN 0 THEN 'curated' ELSE 'newest' END AS sort
FROM event_rows WHERE event_type = 'signup'""",
    "search_requests": """
SELECT owner_key, ts, seq,
  concat_ws('&',
    CASE WHEN q <> '' THEN 'q=red+%26+blue+~ring%2A' END,
    CASE WHEN shop <> '' THEN 'shop=' || shop END,
    CASE WHEN category <> '' THEN 'category=' || category END,
    CASE WHEN designer <> '' THEN 'designer=Brand%233' END,
    CASE WHEN availability NOT IN ('', 'available') THEN 'availability=' || availability END,
    CASE WHEN price_min <> '' THEN 'price_min=' || price_min END,
    CASE WHEN price_max <> '' THEN 'price_max=' || price_max END,
    CASE WHEN sort <> 'curated' THEN 'sort=' || sort END) AS query_string,
  coalesce(nullif(left(concat_ws(' / ', nullif(q, ''), nullif(shop, ''), nullif(category, ''),
    nullif(designer, ''),
    nullif(trim(price_min || ' ' || price_max), ''),
    CASE WHEN availability NOT IN ('', 'available') THEN replace(availability, '_', ' ') END),
    120), ''), 'Default browse') AS name
FROM search_arguments""",
    "saved_searches": """
SELECT row_number() OVER (ORDER BY created_at, first_seq, owner_key, query_string) AS id, *
  EXCLUDE (first_seq)
FROM (SELECT owner_key, query_string, arg_max(name, (ts, seq)) AS name, min(ts) AS created_at,
    max(ts) AS updated_at, arg_min(seq, (ts, seq)) AS first_seq
  FROM search_requests WHERE query_string <> '' GROUP BY 1, 2)""",
    "brands": """
SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS BIGINT) AS n FROM part""",
    "entities": f"""
SELECT n AS id, p_brand AS canonical_name, 'brand ' || n AS normalized_name,
  'brand' AS entity_type, CASE WHEN n % 9 = 0 THEN 'open' ELSE 'approved' END AS review_status,
  '' AS notes, TIMESTAMP '{A.ENTITY_TIME}' AS created_at, TIMESTAMP '{A.ENTITY_TIME}' AS updated_at
FROM brands WHERE n % 3 = 0""",
    "aliases": f"""
SELECT n * 10 + pos AS id, n AS entity_id, alias, normalized_alias, 'seed' AS source,
  TIMESTAMP '{A.ENTITY_TIME}' AS created_at
FROM (
  SELECT n, 0 AS pos, p_brand AS alias, 'brand ' || n AS normalized_alias FROM brands
  UNION ALL SELECT n, 1, p_brand || ' Works', 'brand ' || n || ' works' FROM brands
  UNION ALL SELECT n, 2, 'By ' || p_brand, 'by brand ' || n FROM brands)
WHERE n % 3 = 0""",
    "alias_map": """
SELECT normalized_alias AS alias_key, canonical_name
FROM aliases a JOIN entities e ON e.id = a.entity_id WHERE e.review_status = 'approved'""",
}


def with_parts(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind a WITH clause that defines the parts it mentions, directly or not."""
    known = {**PARTS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    clauses = ",\n".join(f"{name} AS ({known[name]})" for name in needed)
    return f"WITH {clauses}\n{body}"
