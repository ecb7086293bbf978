"""Golden behaviours of browse, facets and reports on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitrine.operators import catalog as C
from vitrine.operators import entities as N
from vitrine.operators import facets as R
from vitrine.operators import similarity as S
from vitrine.schemas import TABLES

T0 = datetime(2026, 5, 6)

SEED = dict(
    id=1, source_shop_id=1, source_listing_url="https://x.com/k", source_listing_key="sample-key",
    title="Sample Chair", normalized_title="sample chair", price_raw="$250", price_value=250.0,
    currency="CAD", primary_image_url="https://example.com/image.jpg", additional_image_urls="[]",
    availability_status="available", shipping_scope="canada", ships_to_montreal=1,
    shipping_note="", last_seen_at=T0, last_checked_at=T0, first_seen_at=T0,
    category="lounge chairs", subcategory="", designer="Test Designer", maker="", era="1960s",
    materials="teak", dimensions_text="20 x 20 x 30", width=None, depth=None, height=None,
    condition_text="Good", location_text="Montreal, QC", source_description="Sample description",
    ingest_source_type="refresh", parse_confidence=1.0, dedupe_group_id="", is_active=1,
    is_featured=0, manual_notes="", availability_override="", category_override="",
)


def listings(spark, *changes):
    rows = []
    for i, change in enumerate(changes):
        row = {**SEED, "id": i + 1, "source_listing_key": f"k{i + 1}", **change}
        rows.append(tuple(row[f] for f in TABLES["listings"].fieldNames()))
    return spark.createDataFrame(rows, TABLES["listings"])


def shops(spark, *changes):
    base = {f.name: ("" if f.dataType.typeName() == "string" else 0) for f in TABLES["shops"].fields}
    base.update(latitude=None, longitude=None, active=1, name="Shop", city="Montreal", province="QC")
    rows = []
    for i, change in enumerate(changes or ({},)):
        row = {**base, "id": i + 1, "slug": f"shop{i + 1}", "name": f"Shop {i + 1}", **change}
        rows.append(tuple(row[f] for f in TABLES["shops"].fieldNames()))
    return spark.createDataFrame(rows, TABLES["shops"])


def events(spark, *rows):
    data = [(i, *r[:1], 1, "k", T0, r[1], r[2], "source_refresh") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, TABLES["listing_availability_events"])


def ids(df):
    return [r.id for r in df.collect()]


def browse(spark, rows, ev=None, shop=None, entities=None, aliases=None, **filters):
    spec = C.FilterSpec.from_args(filters, C.CurationRule("bulk", "dining chairs"))
    entities = entities if entities is not None else spark.createDataFrame([], TABLES["design_entities"])
    aliases = aliases if aliases is not None else spark.createDataFrame([], TABLES["design_entity_aliases"])
    found = C.browse(
        rows, shop if shop is not None else shops(spark), ev if ev is not None else events(spark), spec,
        designer_values=N.texts_of_name(spec.designer, entities, aliases),
        search_values=N.texts_of_name(spec.q, entities, aliases),
    )
    return C.page_listings(found, spec, None)


def test_sold_out_needs_proof(spark):
    rows = listings(spark, {"availability_status": "sold_out"}, {}, {"availability_override": "sold_out"},
                    {"availability_override": "reserved"}, {"availability_status": "removed"}, {"is_active": 0})
    for availability, plain, proven in (
        ("available", [2], [2]), ("sold_out", [3], [1, 3]), ("all", [2, 3, 4], [1, 2, 3, 4]),
    ):
        assert sorted(ids(browse(spark, rows, availability=availability))) == plain
        assert sorted(ids(browse(spark, rows, events(spark, (1, "available", "sold_out"), (2, "", "available")),
                                 availability=availability))) == proven


def test_search(spark):
    rows = listings(
        spark, {"title": "Buffet en teck", "materials": "", "source_description": "x"},
        {"title": "Plain", "source_description": "A teak sideboard", "materials": "", "first_seen_at": datetime(2026, 6, 1)},
        {"title": "Teak Sideboard"}, {"title": "100% wool_rug", "materials": "wool"},
    )
    assert ids(browse(spark, rows, q="teak sideboard")) == [3, 1, 2]
    assert ids(browse(spark, rows, q="teak lamp")) == []
    assert ids(browse(spark, rows, q="%")) == []  # an ordinary character, in no designer
    assert ids(browse(spark, rows, q="  ")) == [2, 1, 3, 4]
    assert ids(browse(spark, rows, material="wool")) == [4]
    assert ids(browse(spark, rows, material="w%l")) == []
    assert ids(browse(spark, rows, q="teak sideboard", sort="newest")) == [2, 1, 3]


def test_combined_filters(spark):
    rows = listings(spark, {}, {"price_value": 500.0}, {"ships_to_montreal": 0}, {"location_text": "Ottawa"},
                    {"price_value": None})
    found = browse(spark, rows, location="montreal", ships_to_montreal="1", price_min="200", price_max="300",
                   availability="available", designer="test designer")
    assert ids(found) == [1]
    assert ids(browse(spark, rows, designer="store policies")) == []
    assert ids(browse(spark, rows, sort="price_low"))[-1] == 5
    assert ids(browse(spark, rows, sort="price_high"))[-1] == 5
    assert C.FilterSpec.from_args({"availability": "x", "sort": "y"}).sort == "curated"
    assert C.price_bound("nan") is None and C.price_bound("x") is None and C.price_bound(" 12 ") == 12.0


def test_curated_order_and_paging(spark):
    dim = shops(spark, {"is_montreal_local": 1}, {}, {"slug": "bulk"}, {"active": 0})
    new, old = datetime(2026, 6, 1), datetime(2026, 1, 1)
    rows = listings(
        spark, {"source_shop_id": 3, "first_seen_at": new, "category": "dining chairs"},
        {"source_shop_id": 3, "first_seen_at": new}, {"source_shop_id": 2, "first_seen_at": old},
        {"source_shop_id": 1, "first_seen_at": old}, {"source_shop_id": 4},
        {"source_shop_id": 3, "category": "sofas", "category_override": "dining chairs", "first_seen_at": old},
    )
    spec = C.FilterSpec.from_args({}, C.CurationRule("bulk", "dining chairs"))
    found = C.browse(rows, dim, events(spark), spec)
    whole = ids(C.page_listings(found, spec, None))
    assert whole == [4, 3, 2, 1, 6]
    pages = [ids(C.page_listings(found, spec, 2, offset)) for offset in (-3, 2, 4)]
    assert sum(pages, []) == whole
    more = C.page_with_more(found, spec, 2, 2).collect()
    assert [r.id for r in more] == [2, 1] and {r.has_more for r in more} == {1}
    assert {r.has_more for r in C.page_with_more(found, spec, 2, 4).collect()} == {0}
    assert C.count_listings(found).collect()[0]["count"] == 5


def test_facets(spark):
    rows = listings(
        spark, {"location_text": " Montreal, QC ", "materials": "teak, glass"}, {"location_text": "Montreal, QC", "materials": "glass,wood"},
        {"materials": "zinc", "is_active": 0}, {"materials": "", "location_text": ""},
    )
    assert [r.value for r in R.location_values(rows).collect()] == ["Montreal, QC"]
    assert [r.value for r in R.facet_values(rows, "materials").collect()] == ["glass", "wood", "teak"]
    with pytest.raises(ValueError):
        R.facet_values(rows, "title")


def test_designer_facet(spark):
    names = ["Store Policies", "1960s Danish designer", "Hans Wegner", "Hans J. Wegner",
             "Charles and Ray Eames", "Charles & Ray Eames", "A. Vodder"]
    rows = listings(spark, *[{"designer": n} for n in names])
    ent = spark.createDataFrame([(1, "Arne Vodder", "arne vodder", "designer", "approved", "", T0, T0)],
                                TABLES["design_entities"])
    ali = spark.createDataFrame([(1, 1, "Arne Vodder", "arne vodder", "s", T0), (2, 1, "A. Vodder", "a vodder", "s", T0)],
                                TABLES["design_entity_aliases"])
    facet = R.designer_facet(rows, N.entity_alias_map(ent, ali)).collect()
    assert [(r.value, r["count"]) for r in facet] == [("Arne Vodder", 1), ("Charles & Ray Eames", 2), ("Hans J. Wegner", 2)]
    assert sorted(ids(browse(spark, rows, designer="Hans J. Wegner"))) == [3, 4]
    assert ids(browse(spark, rows, designer="Arne Vodder", entities=ent, aliases=ali)) == [7]
    assert ids(browse(spark, rows, q="arne vodder", entities=ent, aliases=ali)) == [7]
    many = listings(spark, *[{"designer": f"Name {chr(65 + i // 26)}{chr(65 + i % 26)}", "maker": "Twice"} for i in range(40)])
    assert [r.value for r in R.designer_facet(many).collect()] == ["Twice"]


def test_shop_rollup_keeps_empty_shops(spark):
    rows = listings(spark, {}, {"availability_status": "sold_out", "category": "sofas"},
                    {"is_active": 0, "category_override": "desks"})
    out = {r.id: r for r in R.shop_rollup(shops(spark, {}, {}), rows).collect()}
    assert out[1].active_listing_count == 1 and out[1].categories_carried == "desks,lounge chairs,sofas"
    assert out[2].active_listing_count is None and out[2].categories_carried is None


def test_duplicates_across_blocks(spark):
    """Block edges must not lose or repeat pairs: against brute force, blocks of three rows."""
    rows = listings(spark, *[
        {"source_shop_id": i % 3 + 1, "normalized_title": f"chair {'abc'[i % 3 if i % 5 else 0]} teak old {i // 9}"}
        for i in range(40)
    ])
    order = sorted(((r.normalized_title, r.id, r.source_shop_id) for r in rows.collect()))
    want = set()
    for i, (t, a, s) in enumerate(order):
        for u, b, z in order[i + 1:i + 5]:
            x, y = set(t.split()), set(u.split())
            if s != z and len(x & y) / len(x | y) >= 0.72:
                want.add((a, b))
    got = [(r.left_id, r.right_id) for r in S.duplicate_pairs(rows, window=4, limit=None, block_rows=5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    one = listings(spark, {"title": "x"}, {"source_shop_id": 2})
    assert len(S.duplicate_pairs(one).collect()) == 1


@pytest.mark.parametrize("hot", [1, 1000])
@pytest.mark.parametrize("threshold", [0.4, 0.72, 1.0])
def test_jaccard_is_exact(spark, hot, threshold):
    """Against brute force, with every common word treated as hot and none."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    texts = [(i, " ".join(rng.choice(words[: rng.randint(3, 14)]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    texts += [(200 + i, "same copy of words") for i in range(30)]
    df = spark.createDataFrame(texts, "id long, t string")
    got = S.jaccard_pairs(df, "id", "t", threshold, hot_postings=hot).collect()
    sets = {i: frozenset(t.split()) for i, t in texts if t.split()}
    lead = {}
    for i in sorted(sets):
        lead.setdefault(sets[i], i)
    want = {(lead[s], i): 1.0 for i, s in sets.items() if lead[s] != i}
    leads = sorted(lead.values())
    for x, a in enumerate(leads):
        for b in leads[x + 1:]:
            score = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if score >= threshold:
                want[(a, b)] = score
    assert len(got) == len(want)
    assert {(r.left, r.right): r.score for r in got} == pytest.approx(want)


def test_groups_of_equal_texts_are_named_by_32_bytes(spark):
    """The digest that is shuffled with every text is kept as bytes, not as hexadecimal text."""
    written = []

    def cut(df):
        written.append(df)
        return df

    df = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "c")], "id long, t string")
    assert S.jaccard_pairs(df, "id", "t", cut=cut).collect() == [(1, 2, 1.0)]
    digests = [w.select(F.length("fp").alias("n")).distinct().collect() for w in written if "fp" in w.columns]
    assert [[r.n for r in rows] for rows in digests] == [[32], [32]]


def test_listing_detail_history(spark):
    rows = listings(spark, {}, {"is_active": 0})
    ev = events(spark, *[(1, "a", f"s{i:02d}") for i in range(15)])
    pe = spark.createDataFrame([], TABLES["listing_price_events"])
    detail = C.listing_detail(rows, shops(spark), ev, pe).collect()
    assert [r.id for r in detail] == [1]
    assert [e.to_status for e in detail[0].availability_history] == [f"s{i:02d}" for i in range(14, 2, -1)]
    assert detail[0].price_history is None


def test_overrides_and_flags(spark):
    rows = listings(spark, {}, {})
    o = spark.createDataFrame([(2, "art", "sold_out", 1, "n"), (9, "", "", 0, "")],
                              "id long, category_override string, availability_override string, is_featured int, manual_notes string")
    after = {r.id: r for r in C.update_overrides(rows, o).collect()}
    assert len(after) == 2 and after[2].category_override == "art" and after[1].category_override == ""
    fav = spark.createDataFrame([("me", 1), ("you", 2)], "owner_key string, id long")
    flags = {r.id: r.is_favourited for r in C.with_favourite_flag(rows, fav, "me").collect()}
    assert flags == {1: 1, 2: 0}


def test_json_ld_leaves_out_absent_parts(spark):
    import json

    rows = listings(spark, {"price_value": None, "primary_image_url": "", "availability_override": "sold_out"})
    doc = json.loads(R.listing_json_ld(rows, shops(spark), "https://c.example").collect()[0].json_ld)
    assert "image" not in doc and "price" not in doc["offers"]
    assert doc["offers"]["availability"].endswith("OutOfStock") and doc["url"] == "https://c.example/listing/MCM-000001"
    urls = R.sitemap(rows.withColumn("availability_override", F.lit("")), shops(spark), "https://c.example")
    assert {r["loc"]: r.lastmod for r in urls.collect()}["https://c.example/listing/MCM-000001"] == "2026-05-06"
    assert any("<lastmod>2026-05-06</lastmod>" in r.value for r in R.sitemap_xml_entries(urls).collect())


def test_sitemap_files_and_site_document(spark, tmp_path):
    import json

    urls = spark.createDataFrame([(f"https://c.example/{i:03d}", "") for i in range(25)], "loc string, lastmod string")
    R.write_sitemap(urls, str(tmp_path), "https://c.example", per_file=10)
    files = spark.read.text(str(tmp_path / "urls"))
    assert {r["file"]: r["count"] for r in files.groupBy("file").count().collect()} == {0: 10, 1: 10, 2: 5}
    assert [r.value for r in spark.read.text(str(tmp_path / "index")).orderBy("value").collect()][2] == (
        "<sitemap><loc>https://c.example/sitemap-2.xml</loc></sitemap>")
    site = json.loads(R.site_json_ld(spark, "https://c.example", "Catalog").first().json_ld)
    assert site["@type"] == "WebSite" and site["potentialAction"]["target"]["urlTemplate"].endswith("?q={search_term_string}")


def test_jaccard_sends_few_words_and_pairs(spark):
    """Pairs that share single words of many are counted out before any words are sent, and neither the words that
    follow a hot one nor the sets that stand once are shuffled."""
    from vitrine.operators import similarity as S

    texts = {i: " ".join(f"w{i}x{j}" for j in range(30)) + " " + " ".join(f"c{(i + j) % 40}" for j in range(6)) for i in range(120)}
    texts |= {500: texts[7] + " more", 501: texts[7], 502: " ".join(texts[9].split()[1:]), 503: ""}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    seen = {}

    def cut(frame):
        kept = frame.localCheckpoint()
        seen["-".join(kept.columns)] = [tuple(r) for r in kept.collect()]
        return kept

    want = S.jaccard_pairs(df, "id", "t", hot_postings=1000).collect()
    for hot in (1000, 3):
        seen.clear()
        got = S.jaccard_pairs(df, "id", "t", hot_postings=hot, cut=cut).collect()
        assert sorted(got) == sorted(want)
        assert {(r[0], r[1]) for r in got} == {(7, 500), (7, 501), (9, 502)}
        assert len(seen["left-right"]) < 30
        assert all(len(first) < 25 for *_, first in seen["lead-n-first"])
