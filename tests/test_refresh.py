"""Golden behaviours and properties of the reconciliation."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_catalog import T0, listings, shops
from vitrine.operators import refresh as R
from vitrine.schemas import PARSED, TABLES
from vitrine.session import materialized
from vitrine.sources import tables as T

NOW = datetime(2026, 7, 1)


def as_of():
    return F.lit(NOW.isoformat()).cast("timestamp")


def batch(spark, *items):
    rows = []
    for i, item in enumerate(items):
        row = {f: None for f in PARSED.fieldNames()}
        row.update(shop_id=1, seq=i, title="Sample Chair", source_listing_url=f"https://x.com/{i}/",
                   availability_status="available", price_raw="$250", price_value=250.0, currency="CAD",
                   primary_image_url="https://example.com/image.jpg", source_description="Sample description")
        row.update(item)
        rows.append(tuple(row[f] for f in PARSED.fieldNames()))
    return spark.createDataFrame(rows, PARSED)


def crawls(spark, *rows):
    return spark.createDataFrame(
        [(s, f"shop{s}", a, e, None, "") for s, a, e in rows or [(1, 1, "")]],
        "shop_id long, source_slug string, authoritative int, error string, chunk_index int, entry_url string",
    )


def refresh(spark, stored, items, crawl=None, shop=None, **options):
    return R.reconcile(stored, items, crawl or crawls(spark), shop if shop is not None else shops(spark),
                       as_of(), **options)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def job(out):
    j = out.jobs.collect()[0]
    return j.listings_found, j.new_count, j.reconciled_count, j.hidden_count, j.status


def test_update_insert_and_defaults(spark):
    stored = listings(spark, {"availability_override": "reserved", "manual_notes": "keep", "is_featured": 1})
    out = refresh(spark, stored, batch(
        spark, {"source_listing_key": "k1", "price_value": 300.0, "price_raw": "$300"},
        {"title": "New Sofa", "price_raw": None, "price_value": None, "availability_status": None, "currency": None,
         "primary_image_url": None, "source_description": None},
    ))
    after = {r.id: r for r in out.listings.collect()}
    old, new = after[1], after[2]
    assert (old.price_value, old.first_seen_at, old.last_seen_at) == (300.0, T0, NOW)
    assert (old.manual_notes, old.is_featured, old.availability_override) == ("keep", 1, "reserved")
    assert (new.source_listing_key, new.availability_status, new.currency) == ("https://x.com/1", "unknown", "CAD")
    assert (new.location_text, new.parse_confidence, new.ingest_source_type) == ("Montreal, QC", 0.4, "refresh")
    assert (new.normalized_title, new.additional_image_urls, new.first_seen_at) == ("new sofa", "[]", NOW)
    assert rows(out.availability_events, "listing_id", "from_status", "to_status", "event_type") == [
        (2, "", "unknown", "discovered")]
    assert rows(out.price_events, "listing_id", "from_price_value", "to_price_value", "event_type") == [
        (1, 250.0, 300.0, "source_refresh")]
    assert job(out) == (2, 1, 0, 0, "success")


def test_unchanged_batch_makes_no_events(spark):
    items = batch(spark, *[{"source_listing_key": f"k{i}", "title": f"Chair {i}"} for i in range(6)])
    empty = listings(spark, {}).filter("false")
    first = refresh(spark, empty, items)
    second = refresh(spark, first.listings, items)
    assert first.listings.count() == second.listings.count() == 6
    assert second.availability_events.count() == second.price_events.count() == 0
    assert job(second) == (6, 0, 0, 0, "success")


def test_key_drift(spark):
    stored = listings(spark, {}, {"title": "Other", "normalized_title": "other"})
    out = refresh(spark, stored, batch(
        spark, {"source_listing_key": "new-key", "source_description": "changed"}, {"source_listing_key": "k2"},
    ))
    after = {r.id: r for r in out.listings.collect()}
    assert after[1].source_listing_key == "new-key" and after[1].first_seen_at == T0
    assert job(out) == (2, 0, 1, 0, "success")
    by_text = refresh(spark, listings(spark, {"primary_image_url": ""}), batch(
        spark, {"source_listing_key": "n", "source_description": "SAMPLE description", "primary_image_url": "y"}))
    assert rows(by_text.listings, "id", "source_listing_key") == [(1, "n")]
    price_only = refresh(spark, listings(spark, {}), batch(
        spark, {"source_listing_key": "n", "source_description": "a", "primary_image_url": "y"}))
    assert job(price_only)[1:3] == (1, 0)


def test_ambiguous_drift_is_reviewed_once(spark):
    stored = listings(spark, {}, {"last_checked_at": NOW}, {"source_description": "unlike", "price_value": 1.0})
    items = batch(spark, {"source_listing_key": "n"})
    out = refresh(spark, stored, items)
    review = R.with_candidate_texts(out.reviews, out.review_candidates).collect()
    assert [(r.candidate_listing_ids, r.candidate_count, r.status) for r in review] == [("2,1", 2, "open")]
    assert review[0].reason.endswith("at score 5")
    assert rows(out.review_candidates, "listing_id") == [(1,), (2,)]
    assert job(out)[1:4] == (1, 0, 3)  # a new listing is made; the unseen ones are hidden
    known = spark.createDataFrame([(1, 1, NOW, "n", "t", "", "", "open")], TABLES["listing_identity_reviews"])
    assert refresh(spark, stored, items, open_reviews=known).reviews.count() == 0


def test_reviews_name_all_candidates(spark):
    stored = listings(spark, *[{} for _ in range(1200)])
    items = batch(spark, {"source_listing_key": "n"}, {"source_listing_key": "m"})
    matched = R.match_batch(stored, items, crawls(spark), shops(spark))
    reviews, candidates = R.ambiguous_reviews(matched.resolved, matched.candidates, as_of())
    assert candidates.count() == 1200  # once for both items
    texts = R.with_candidate_texts(reviews, candidates).collect()
    assert [len(r.candidate_listing_ids.split(",")) for r in texts] == [1200, 1200]


def test_rows_of_a_shop_without_a_crawl_row(spark):
    shop = shops(spark, {}, {})
    stored = listings(spark, {}, {"source_shop_id": 2})
    out = refresh(spark, stored, batch(spark, {"source_listing_key": "n", "title": "New", "shop_id": 2}),
                  crawls(spark, (1, 0, "")), shop)
    assert rows(out.listings, "source_shop_id", "source_listing_key", "is_active") == [
        (1, "k1", 1), (2, "k2", 1), (2, "n", 1)]


def test_two_items_want_one_row(spark):
    out = refresh(spark, listings(spark, {}), batch(
        spark, {"source_listing_key": "b", "seq": 7}, {"source_listing_key": "a", "seq": 8}))
    assert rows(out.listings, "id", "source_listing_key") == [(1, "b"), (2, "a")]
    assert job(out)[1:4] == (1, 1, 0)


def test_superseded_row_gives_up_its_events(spark):
    stored = listings(spark, {"source_listing_key": "old"}, {"source_listing_key": "new-key", "is_active": 0,
                                                             "title": "X", "normalized_title": "x"})
    out = refresh(spark, stored, batch(spark, {"source_listing_key": "new-key"}))
    assert rows(out.listings, "id", "source_listing_key", "is_active") == [(1, "new-key", 1)]
    log = spark.createDataFrame(
        [(1, 1, 1, "old", T0, "", "available", "discovered"), (2, 2, 1, "new-key", T0, "", "available", "discovered")],
        TABLES["listing_availability_events"])
    moved = R.reassign_events(log, out.event_moves)
    assert rows(moved, "id", "listing_id", "source_listing_key") == [(1, 1, "old"), (2, 1, "new-key")]


def test_sold_archive(spark):
    stored = listings(spark, {}, {"availability_status": "removed", "is_active": 0, "title": "Gone", "normalized_title": "gone"})
    out = refresh(spark, stored, batch(
        spark, {"source_listing_key": "k1", "availability_status": "sold_out"},
        {"source_listing_key": "k2", "availability_status": "sold_out", "title": "Gone"},
        {"source_listing_key": "k9", "availability_status": "sold_out", "title": "Fresh"}))
    assert rows(out.listings, "id", "availability_status", "is_active") == [(1, "sold_out", 1), (2, "removed", 0)]
    assert rows(out.availability_events, "listing_id", "from_status", "to_status") == [(1, "available", "sold_out")]
    assert job(out) == (3, 0, 0, 0, "success")


def test_missing_rows_are_hidden(spark):
    stored = listings(spark, {}, {}, {"is_active": 0, "availability_status": "removed"})
    out = refresh(spark, stored, batch(spark, {"source_listing_key": "k1"}))
    assert rows(out.listings, "id", "is_active", "last_checked_at") == [(1, 1, NOW), (2, 0, NOW), (3, 0, NOW)]
    assert rows(out.availability_events, "listing_id", "to_status") == [(2, "removed")]
    assert job(out)[3] == 2  # includes the row that was inactive before
    partial = refresh(spark, stored, batch(spark, {"source_listing_key": "k1"}), crawls(spark, (1, 0, "")))
    assert job(partial)[3] == 0
    nothing = batch(spark, {}).filter("false")
    assert job(refresh(spark, stored, nothing))[3] == 3
    assert job(refresh(spark, stored, nothing, min_rows=1))[3] == 0


def test_ids_of_the_logs(spark):
    out = refresh(spark, listings(spark, {}, {}), batch(spark, {"source_listing_key": "n", "title": "New"}))
    log = spark.createDataFrame([(40, 1, 1, "old", T0, "", "available", "discovered")], TABLES["listing_availability_events"])
    jobs = spark.createDataFrame([], TABLES["refresh_jobs"])
    numbered = R.with_log_ids(out, {"availability_events": log, "jobs": jobs})
    assert rows(numbered.availability_events, "id", "listing_id") == [(41, 1), (42, 2), (43, 3)]
    assert rows(numbered.jobs, "id", "shop_id") == [(1, 1)]
    assert numbered.runs is out.runs


def test_error_policy(spark):
    shop = shops(spark, {}, {})
    items = batch(spark, {"source_listing_key": "f"}, {"source_listing_key": "g", "shop_id": 2})
    out = refresh(spark, listings(spark, {}), items, crawls(spark, (1, 1, "boom"), (2, 1, "boom")), shop)
    assert rows(out.listings, "source_shop_id", "source_listing_key", "is_active") == [(1, "k1", 1), (2, "g", 1)]
    assert rows(out.jobs, "shop_id", "status", "listings_found", "new_count", "hidden_count", "kept_existing") == [
        (1, "warning", 0, 0, 0, 1), (2, "warning", 1, 1, 0, 0)]
    assert out.failures.count() == 2 and out.runs.count() == 2


def test_last_record_of_a_key_wins(spark):
    out = refresh(spark, listings(spark, {}), batch(
        spark, {"source_listing_key": "k1", "price_value": 1.0}, {"source_listing_key": "k1", "price_value": 2.0}))
    assert rows(out.listings, "id", "price_value") == [(1, 2.0)]
    assert job(out)[0] == 2


def test_a_group_of_copies_stays_linear(spark):
    """A third of all rows alike: no output grows with the square of the group."""
    n = 300
    stored = listings(spark, *[{"title": "Copy", "normalized_title": "copy"} for _ in range(n)])
    items = batch(spark, *[{"source_listing_key": f"n{i}", "title": "Copy"} for i in range(n)])
    matched = R.match_batch(stored, items, crawls(spark), shops(spark))
    assert R.signatures(matched.candidates, ["candidate_id"]).count() == 6 * n
    assert matched.resolved.count() == n
    assert matched.resolved.filter(F.col("ties") == n).count() == n


def test_only_rows_that_can_score_are_candidates(spark):
    """Same title alone makes no signatures: of 40 such rows those with an equal image or description stay."""
    unlike = {"primary_image_url": "https://example.com/other.jpg", "source_description": "unlike"}
    stored = listings(
        spark, *[unlike for _ in range(40)], {"source_description": "unlike"},
        {"primary_image_url": "", "price_value": 1.0}, {**unlike, "title": "Y", "normalized_title": None},
    )
    items = batch(spark, {"source_listing_key": "n"}, {"source_listing_key": "m", **unlike, "title": "Z"})
    matched = R.match_batch(stored, items, crawls(spark), shops(spark))
    assert rows(matched.candidates, "candidate_id") == [(41,), (42,)]
    found = R.drift_match(R.keyed_match(matched.items, stored), matched.candidates)
    assert rows(found, "source_listing_key", "score", "ties", "candidate_id") == [("n", 3, 1, 41)]


def test_merged_rows_left_in_the_plan_give_the_same_outputs(spark):
    stored = listings(spark, {}, {}, {"is_active": 0, "availability_status": "removed"})
    items = batch(spark, {"source_listing_key": "k1", "price_value": 300.0}, {"source_listing_key": "n", "title": "New"})
    outs = [refresh(spark, stored, items, cut_merged=cut) for cut in (None, R.uncut)]
    for name in ("listings", "availability_events", "price_events"):
        first, second = [sorted(map(str, getattr(out, name).collect())) for out in outs]
        assert first == second != []
    assert job(outs[0]) == job(outs[1])


def test_only_records_sent_twice_are_written_whole(spark):
    """Matches are written as keys, marks and ids; whole rows only where a key may be sent twice."""
    written = []

    def cut(df):
        written.append(materialized(df))
        return written[-1]

    stored = listings(spark, {}, {"is_active": 0})
    items = batch(
        spark, *[{"source_listing_key": f"k{i}"} for i in (1, 2, 2, 3)],
        {"source_listing_url": None, "title": "No key", "source_description": "", "primary_image_url": ""})
    found = R.match_batch(stored, items, crawls(spark), shops(spark), cut=cut, cut_merged=R.uncut)
    assert sum(df.count() for df in written if "additional_image_urls" in df.columns) == 1
    got = {r.source_listing_key: (r.seq, r.target_id, r.title) for r in found.resolved.collect()}
    assert got == {"k1": (0, 1, "Sample Chair"), "k2": (2, 2, "Sample Chair"), "k3": (3, None, "Sample Chair"),
                   None: (4, None, "No key")}


def jobs(spark, chunks, found=3):
    data = [(i, 1, "shop1", c, "", datetime(2026, 6, 1, 0, i), None, s, found, 0, 0, 0, "") for i, (c, s) in enumerate(chunks)]
    return spark.createDataFrame(data, TABLES["refresh_jobs"])


@pytest.mark.parametrize("complete", [False, True])
def test_chunked_source(spark, complete):
    expected = spark.createDataFrame([("shop1", 1, 12)], "source_slug string, expected_jobs int, chunk_count int")
    ledger = [(c, "success") for c in range(11)] + [(11, "success" if complete else "warning"), (12, "success")]
    stored = listings(spark, {"last_seen_at": datetime(2026, 5, 1)}, {"last_seen_at": datetime(2026, 6, 2)})
    out = R.chunk_reconcile(stored, shops(spark), jobs(spark, ledger), expected, as_of())
    result = out.results.collect()[0]
    if complete:
        assert (result.hidden_count, result.listings_found, result.error_message) == (1, 36, "")
        assert rows(out.availability_events, "listing_id", "to_status", "event_type") == [(1, "removed", "source_reconciliation")]
        assert rows(out.listings, "id", "is_active") == [(1, 0), (2, 1)]
    else:
        assert (result.hidden_count, result.kept_existing) == (0, 1)
        assert result.error_message == "Missing successful chunk jobs for indexes: 11"
        assert rows(out.listings, "id", "is_active") == [(1, 1), (2, 1)]


def test_latest_success_has_one_row_per_chunk(spark):
    expected = spark.createDataFrame([("shop1", 1, 2)], "source_slug string, expected_jobs int, chunk_count int")
    ledger = jobs(spark, [(0, "success"), (0, "success"), (1, "warning")]).withColumn("started_at", F.lit(T0))
    assert rows(R.chunk_latest_success(ledger, expected), "chunk_index", "id") == [(0, 1)]


def test_upsert_and_snapshots(spark, tmp_path):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, born int")
    change = spark.createDataFrame([(2, "B", 9), (3, "C", 9)], "id long, name string, born int")
    after = T.sink_upsert(target, change, ["id"], preserve=("born",))
    assert rows(after, "id", "name", "born") == [(1, "a", 1), (2, "B", 2), (3, "C", 9)]
    root = str(tmp_path / "t")
    assert T.read_snapshot(spark, root) is None
    T.write_snapshot(target, root, 0)
    T.write_snapshot(after, root, 1)
    assert T.read_snapshot(spark, root).count() == 3 and T.read_snapshot(spark, root, before=1).count() == 2


def test_seed_shops(spark):
    defined = shops(spark, {"name": "Renamed"}, {"slug": "fresh", "id": 3}).drop("active")
    seeded, hidden = T.seed_shops(shops(spark, {}, {}), listings(spark, {}, {"source_shop_id": 2}), defined)
    assert rows(seeded, "id", "slug", "name", "active") == [
        (1, "shop1", "Renamed", 1), (2, "shop2", "Shop 2", 0), (3, "fresh", "Shop 2", 1)]
    assert rows(hidden, "id", "is_active") == [(1, 1), (2, 0)]
