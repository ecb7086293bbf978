"""Traffic, owners, entities, monitoring, feeds and streams on small tables."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_catalog import T0, listings, shops
from vitrine.functions.text import filter_key
from vitrine.operators import entities as N
from vitrine.operators import monitor as M
from vitrine.operators import owners as O
from vitrine.operators import skew
from vitrine.operators import traffic as W
from vitrine.schemas import TABLES
from vitrine.sources import feeds as S
from vitrine.sources.html import link_discovery, read_page, visible_strings


def empty(spark, table):
    return spark.createDataFrame([], TABLES[table])


def test_traffic_reports(spark):
    rows = [("2026-06-19", "home", "/", "en", 3), ("2026-06-18", "shop", "/shops/a", "en", 4),
            ("2026-06-18", "listing", "/listing/1", "fr", 2), ("2026-06-01", "home", "/", "en", 50)]
    rows = [(date.fromisoformat(d), t, p, lang, v, T0) for d, t, p, lang, v in rows]
    views = spark.createDataFrame(rows, TABLES["analytics_page_views"])
    since = F.lit(date(2026, 6, 18))
    assert [(str(r.view_date), r.views, r.path_count) for r in W.analytics_daily(views, since).collect()] == [
        ("2026-06-19", 3, 1), ("2026-06-18", 6, 2)]
    assert [(r.page_type, r.views) for r in W.analytics_page_types(views, since).collect()] == [
        ("shop", 4), ("home", 3), ("listing", 2)]
    assert [r.path_key for r in W.analytics_top_paths(views, since).collect()] == ["/shops/a", "/", "/listing/1"]
    raw = spark.createDataFrame([("2026-02-30",), ("2026-02-03",), ("",), (None,)], "d string")
    got = raw.select(W.since_date(F.col("d"), F.lit("2026-06-20 10:00:00").cast("timestamp")).alias("s")).collect()
    assert [str(r.s) for r in got] == ["2026-06-07", "2026-02-03", "2026-06-07", "2026-06-07"]


def test_tracking_blocklist(spark):
    paths = ["/healthz", "/admin", "/cron/refresh", "/internal/d1/query", "/static/app.js", "/robots.txt?x", "robots.txt"]
    df = spark.createDataFrame([(p, "en", T0) for p in [*paths, "/", "/robots.txt/x"]], "path string, lang string, ts timestamp")
    assert W.pageview_rollup(df).count() == 2


def test_favourites(spark):
    toggles = spark.createDataFrame(
        [("a", 1, T0), ("a", 1, datetime(2026, 6, 1)), ("a", 1, datetime(2026, 7, 1)), ("a", 2, T0), ("a", 2, T0), ("b", 1, T0)],
        "owner_key string, listing_id long, ts timestamp")
    fav = O.favourites_fold(toggles, "listing_id")
    assert sorted((r.owner_key, r.listing_id, r.created_at) for r in fav.collect()) == [
        ("a", 1, datetime(2026, 7, 1)), ("b", 1, T0)]
    session = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", " 3 "), ("a", "3"), ("a", None)], "owner_key string, raw_value string")
    merged = O.favourites_migrate(fav, session, "listing_id", F.lit("2026-08-01").cast("timestamp"))
    assert sorted((r.owner_key, r.listing_id) for r in merged.collect()) == [("a", 1), ("a", 3), ("b", 1)]
    shown = O.favourite_listings(fav, listings(spark, {}), shops(spark, {"active": 0}))
    assert shown.count() == 2 and O.favourite_shops(fav.withColumnRenamed("listing_id", "shop_id"), shops(spark, {"active": 0})).count() == 0


def test_saved_searches(spark):
    req = spark.createDataFrame(
        [("a", "old", "q=x", T0, 1), ("a", "new", "q=x", datetime(2026, 6, 1), 2), ("", "n", "q=y", T0, 3), ("b", "n", "", T0, 4)],
        "owner_key string, name string, query_string string, ts timestamp, seq long")
    saved = O.saved_search_upsert(empty(spark, "anonymous_saved_searches"), req)
    assert [(r.id, r.name, r.created_at, r.updated_at) for r in saved.collect()] == [(1, "new", T0, datetime(2026, 6, 1))]
    again = O.saved_search_upsert(saved, req.withColumn("name", F.lit("third")))
    assert [(r.id, r.name, r.created_at) for r in again.collect()] == [(1, "third", T0)]
    gone = spark.createDataFrame([("b", 1)], "owner_key string, id long")
    assert O.saved_search_delete(saved, gone).count() == 1


def test_entities(spark):
    decisions = spark.createDataFrame(
        [(1, " Arne Vodder ", "designer", ["A. Vodder", "arne vodder", "--"], None), (2, "Finn Juhl", "robot", ["A Vodder"], " n ")],
        "seq long, canonical_name string, entity_type string, aliases array<string>, notes string")
    ent, ali = N.entity_upsert(empty(spark, "design_entities"), empty(spark, "design_entity_aliases"), decisions,
                               F.lit(T0.isoformat()).cast("timestamp"))
    assert sorted((r.id, r.canonical_name, r.entity_type, r.notes) for r in ent.collect()) == [
        (1, "Arne Vodder", "designer", ""), (2, "Finn Juhl", "creator", "n")]
    # the later decision takes the alias
    assert sorted((r.normalized_alias, r.entity_id) for r in ali.collect()) == [("a vodder", 2), ("arne vodder", 1), ("finn juhl", 2)]
    rows = listings(spark, {"designer": "Jens Risom"}, {"designer": "Jens Risom"}, {"designer": "Store policies"},
                    {"maker": "Arne Vodder", "designer": "X Y"}, {"designer": "Jens Risom", "is_active": 0})
    reviews = N.entity_reject(
        empty(spark, "design_entity_candidate_reviews"),
        spark.createDataFrame([(1, "X Y", "designer", "rejected", None, "")],
                              "seq long, source_text string, source_role string, review_status string, entity_id long, notes string"),
        F.lit(T0.isoformat()).cast("timestamp"))
    found = N.entity_candidates(rows, N.entity_alias_map(ent, ali), reviews).collect()
    assert [(r.source_text, r.listing_count) for r in found] == [("Jens Risom", 2)]
    out = N.entity_approve(
        ent, ali, empty(spark, "listing_design_entity_evidence"), reviews, rows,
        spark.createDataFrame([(1, "Jens Risom", "designer", "Jens Risom", "designer", None, "")],
                              "seq long, source_text string, source_role string, canonical_name string, entity_type string, aliases array<string>, notes string"),
        F.lit(T0.isoformat()).cast("timestamp"))
    assert sorted((r.listing_id, r.entity_id) for r in out.evidence.collect()) == [(1, 3), (2, 3)]
    index = N.entity_index(out.entities, out.aliases, out.evidence, filter_key(F.lit("RISOM"))).collect()
    assert [(r.canonical_name, r.evidence_count, r.listing_count, r.aliases) for r in index] == [("Jens Risom", 2, 2, ["Jens Risom"])]
    assert N.entity_candidates(rows, N.entity_alias_map(out.entities, out.aliases), out.reviews).count() == 0


def test_monitor_rules(spark):
    day = datetime(2026, 6, 1, 11, 23)
    def job(i, slug, chunk, status, hour, found=10, hidden=0):
        return (i, 1, slug, chunk, "", datetime(2026, 6, 1, hour), None, status, found, 0, 0, hidden, "")
    ledger = [job(i, "chunky", c, "success", 5) for i, c in enumerate(c for c in range(12) if c != 7)]
    ledger += [job(50, "plain", None, "warning", 6), job(51, "spiky", None, "success", 6, 100, 60), job(52, "odd", None, "running", 11),
               job(53, "plain", None, "running", 5), job(54, "spiky", None, "success", 7, 0, 50), job(55, "spiky", None, "success", 8, 400, 60)]
    df = spark.createDataFrame(ledger, TABLES["refresh_jobs"])
    expected = spark.createDataFrame([("chunky", 12, 12), ("plain", 1, 0), ("spiky", 1, 0), ("absent", 1, 3)],
                                     "source_slug string, expected_jobs int, chunk_count int")
    report = M.jobs_report(df, expected, F.lit(day.isoformat()).cast("timestamp")).collect()
    got = {(r.source_slug, r.reason) for r in report}
    assert got == {("chunky", "missing_refresh_jobs"), ("absent", "missing_refresh_jobs"), ("plain", "refresh_jobs_not_success"),
                   ("spiky", "suspicious_hidden_count"), ("odd", "unknown_refresh_source"), ("odd", "refresh_job_still_running")}
    by = {(r.source_slug, r.reason): r for r in report}
    assert by["chunky", "missing_refresh_jobs"].missing_chunk_indexes == "7"
    assert by["absent", "missing_refresh_jobs"].missing_chunk_indexes == ""
    plain = by["plain", "refresh_jobs_not_success"]
    assert (plain["count"], plain.statuses) == (2, "stale:1,warning:1")
    assert sorted(r.hidden_count for r in report if r.reason == "suspicious_hidden_count") == [50, 60]


SOURCE = "source_slug string, website string, city string, province string, shipping_summary string, furniture_only boolean"


def source(spark, furniture_only=False):
    return spark.createDataFrame([("src", "https://x.com", "Montreal", "QC", "Canada", furniture_only)], SOURCE)


def payloads(spark, *texts):
    return spark.createDataFrame([("src", i, json.dumps(t) if not isinstance(t, str) else t) for i, t in enumerate(texts)],
                                 "source_slug string, page long, payload string")


def test_malformed_feeds_give_no_rows(spark):
    bad = payloads(spark, "{oops", "[]", '{"products": 5}', "")
    assert S.collection_feed(bad, source(spark)).count() == 0
    assert S.store_feed(bad, source(spark)).count() == 0
    assert S.storefront_feed(bad, source(spark)).count() == 0
    assert S.gallery_pages_feed(bad, source(spark)).count() == 0
    assert S.gallery_feed(bad.withColumn("entry_url", F.lit("https://x.com")), source(spark)).count() == 0


def test_sparse_feed_items(spark):
    rows = S.collection_feed(payloads(spark, {"products": [{"title": "Lamp", "handle": "l"}, None]}), source(spark)).collect()
    assert [(r.title, r.price_raw, r.availability_status, r.primary_image_url) for r in rows] == [
        ("Lamp", "Contact for price", "sold_out", "")]
    front = {"data": [{"name": "Table", "id": "1", "thumbnail": {"data": {"url": "u"}}, "price": {"low_subunits": 1250}},
                      {"name": "Table", "id": "2"}, {"name": "Hat", "id": "3", "thumbnail": {"data": {"url": "u"}}}]}
    got = S.storefront_feed(payloads(spark, front), source(spark)).collect()
    assert [(r.source_listing_key, r.price_value, r.primary_image_url, r.source_listing_url) for r in got] == [
        ("src:1", 12.5, "u", "https://x.com")]


def test_cap_fallback_and_identity(spark):
    rows = spark.createDataFrame(
        [("s", "k1", "https://x/n", "T", "i", "D", 0, 1), ("s", "k2", "https://x/c", "t!", "i", "d", 1, 2), ("s", "k3", "u", "T", "", "D", 1, 3)],
        "source_slug string, key string, url string, title string, primary_image_url string, source_description string, pri int, seq int")
    kept = S.dedupe_identity(rows, "source_slug", "key", ["seq"], F.col("pri")).collect()
    assert sorted(r.key for r in kept) == ["k2", "k3"]
    assert sorted(r.key for r in S.feed_cap(rows, "source_slug", ["seq"], 2).collect()) == ["k1", "k2"]


def test_identity_sends_the_columns_asked_for(spark):
    rows = spark.createDataFrame(
        [("s", "k1", "T", "i", "D", 0, 1), ("s", "k2", "t!", "i", "d", 1, 2), ("s", "k3", "T", "", "D", 1, 3)],
        "source_slug string, key string, title string, primary_image_url string, source_description string, pri int, seq int")
    few = S.dedupe_identity(rows, "source_slug", "key", ["seq"], F.col("pri"), ["seq"])
    whole = S.dedupe_identity(rows, "source_slug", "key", ["seq"], F.col("pri"))
    assert few.columns == ["source_slug", "key", "seq"]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.select(few.columns).collect()))


def test_append_events_derives_the_log_once(spark, sf_dir, monkeypatch):
    from vitrine.plans import refresh as P

    log = P.A.availability_events(spark, sf_dir)
    rows, made = log.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(P.A, "availability_events", lambda *_: log.mapInArrow(counted, log.schema))
    assert entry.queries()["sink_append_events"](spark, sf_dir).count() == rows
    assert made.value == rows


def test_html(spark):
    assert visible_strings("a<!-- c -->b<script>x</script><p> d &amp; e </p><style>s</style>") == ["a", "b", "d & e"]
    page = read_page('<h1>A <b>B</b></h1><div class="rte">x<div>y</div>z</div>t<script type="application/ld+json">'
                     '[{"@type":"Thing"},{"@type":"Product","image":"i","offers":{"price":5}}]</script>')
    assert (page["heading"], page["description_text"]) == ("A B", "x\ny\nz")
    assert json.loads(page["ld_scripts"][0])[1]["image"] == "i"
    page = read_page('<img class="rte"><div class="rte">x<br>y</div>after<input itemprop="description"> end')
    assert page["description_text"] == "x\ny"
    df = spark.createDataFrame([(1, '<a href="/products/a?x=1">1</a><a class=q href="/products/a">2</a><a href="/no">n</a>'
                                '<a data-href="/products/w" href=/x/../products/b>b</a><!--<a href="/products/c">--><a href="/products/d&amp;e">d</a>')],
                               "page_id long, html string")
    assert [r.link for r in link_discovery(df, "/products/", F.lit("https://x.com/p")).collect()] == [
        "https://x.com/products/a", "https://x.com/products/b", "https://x.com/products/d&e"]
    scripts = [["{bad", '[{"@type":"Thing"},{"@type":"Product","name":"n","image":"i","offers":{"price":5}}]'],
               ['{"@type":"Product","name":"m","image":["a","b"],"offers":[{"price":"7"}]}'], ["[1"], []]
    table = spark.createDataFrame([(s,) for s in scripts], "s array<string>").select(S.product_document(F.col("s")).alias("d"))
    table = table.select("d.name", S.json_items(F.col("d.image")).alias("images"),
                         F.from_json(F.get(S.json_items(F.col("d.offers")), F.lit(0)), S.PRODUCT_OFFER)["price"].alias("price"))
    assert [tuple(r) for r in table.collect()] == [("n", ["i"], "5"), ("m", ["a", "b"], "7"), (None, [], None), (None, [], None)]


def test_lag_across_buckets_and_ranks(spark):
    data = [(k, (k * 37 + i * 11) % 50, i) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(data, "k long, t long, v long").dropDuplicates(["k", "t"])
    got = {(r.k, r.t): r.prev_v for r in skew.lag_in_buckets(df, "k", F.floor(F.col("t") / 10), ["t"], ["v"]).collect()}
    want = {}
    for k in range(3):
        seq = sorted((r.t, r.v) for r in df.collect() if r.k == k)
        for i, (t, _) in enumerate(seq):
            want[(k, t)] = seq[i - 1][1] if i else None
    assert got == want
    ranked = skew.with_global_rank(df, ["t", "k"]).collect()
    order = sorted((r.t, r.k) for r in ranked)
    assert {(r.t, r.k): r.rank for r in ranked} == {x: i for i, x in enumerate(order)}


FAST = ("scan_shops", "parse_price", "path_columns", "jobs_report", "listing_events_latest", "favourites_fold",
        "audit_coverage_today", "stream_favourites", "html_link_discovery", "row_classifiers")


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, sf_dir, name):
    """The check tool does this for all queries; these run with every test run."""
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents pages").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(map(str, r)) for r in cur.fetchall()))
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == want


def test_every_query_is_named_and_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 48


def test_lag_sends_rows_once_unless_keys_are_hot(spark):
    rows = [(k if k < 7 else None, None if i % 9 == 8 else (k * 5 + i * 7) % 40, i, None if i % 5 == 4 else i) for k in range(8) for i in range(k * 6)]
    df = spark.createDataFrame(rows, "k long, t long, n long, v long")
    results = []
    for hot_rows in (0, 20, 1000):
        lagged = skew.lag_in_buckets(df, "k", F.floor(F.col("t") / 10), ["t", "n"], ["v"], hot_rows)
        results.append(sorted(map(str, lagged.select("k", "t", "n", "v", "prev_v", "is_first").collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) > 50
    assert results[0] == sorted(map(str, skew._lag_over_buckets(df, "k", F.floor(F.col("t") / 10), ["t", "n"], ["v"])
                                    .select("k", "t", "n", "v", "prev_v", "is_first").collect()))
    assert lagged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_both_logs_of_a_reader_come_from_changes_written_once(spark, sf_dir):
    from vitrine.sources import adapters as A

    changes = A.logged_changes(spark, sf_dir)
    for log in (A.availability_events, A.price_events):
        assert sorted(map(str, log(spark, sf_dir, changes).collect())) == sorted(map(str, log(spark, sf_dir).collect()))
        assert "lineitem" not in log(spark, sf_dir, changes)._jdf.queryExecution().executedPlan().toString()
