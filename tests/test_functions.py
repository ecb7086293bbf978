"""Golden values of the text functions."""

from pyspark.sql import functions as F

from vitrine.functions import dimensions, display, enrich, paths, text


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select(fn(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def check(spark, fn, cases):
    assert values(spark, fn, [c[0] for c in cases]) == [c[1] for c in cases]


def test_text_keys(spark):
    check(spark, text.clean_text, [("  one\n two\tthree  x ", "one two three x"), (None, "")])
    check(spark, text.normalize_lookup, [("Étagère d'appoint", "etagere d appoint"), (None, "")])
    check(spark, text.filter_key, [
        ("Børge Mogensen", "brge mogensen"), ("Charles &amp; Ray Eames", "charles and ray eames"),
        ("ﬁn & Co.", "fin and co"),
    ])
    check(spark, text.normalize_title, [("A-B  c's!", "a b  c s"), ("Étagère ½", "étagère ½")])
    check(spark, text.slugify, [("Danish Sofa + Teak!", "danish-sofa-teak")])
    check(spark, text.slug_to_title, [("mostly-danish_items", "Mostly Danish Items"), ("60s-x", "60S X")])
    check(spark, text.url_key, [("https://X.com/A//", "https://x.com/a")])


def test_a_key_takes_one_python_worker(spark, capsys):
    spark.createDataFrame([("a &amp; b",)], "x string").select(text.filter_key(F.col("x"))).explain()
    assert capsys.readouterr().out.count("EvalPython") == 1
    check(spark, text.html_unescape, [("a &lt;&eacute; &amp", "a <é &"), ("", ""), (None, None)])


def test_prices(spark):
    check(spark, text.parse_price, [
        ("C$1,250.50", 1250.5), ("$1.250.50 CAD", 1250.5), ("$1,250 CAD", 1250.0),
        ("3 500 $", 3500.0), ("1 250,50 $", 1250.5), ("not a price", None), ("...", None),
        ("1.250,50", 1250.5), ("1,2,345", 12345.0), ("12,5", 12.5), ("", None), (None, None),
    ])
    check(spark, text.price_text, [
        ("was $5 now $1,234.00 CAD", "$1,234.00 CAD"), ("only $12.50!", "$12.50"), ("free", ""),
    ])
    df = spark.createDataFrame([("Sofa\n1 200 $\nfin",), ("Lampe\n Véndu \n",), ("rien",)], "d string")
    out = df.select(text.price_line(F.col("d"), text.ascii_fold(F.col("d"))).alias("p")).collect()
    assert [r.p for r in out] == ["1 200 $", "Véndu", ""]


def test_item_numbers(spark):
    df = spark.createDataFrame([(7,), (12345678,)], "x long")
    assert [r[0] for r in df.select(text.item_number(F.col("x"))).collect()] == ["MCM-000007", "MCM-12345678"]
    check(spark, text.parse_item_number, [("mcm-000007", 7), (" 12 ", 12), ("MCM-x", None), ("x1", None)])


def test_urls(spark):
    check(spark, lambda c: text.rewrite_query_param(c, "lightbox", F.lit("a b")), [
        ("https://x.com/p?lightbox=1&q=teck", "https://x.com/p?q=teck&lightbox=a+b"),
        ("https://x.com/p", "https://x.com/p?lightbox=a+b"),
        ("https://x.com/p?a=%20é#f", "https://x.com/p?a=+%C3%A9&lightbox=a+b#f"),
    ])
    check(spark, lambda c: text.resolve_url(F.lit("https://x.com/a/b?c=1"), c), [
        ("/products/z", "https://x.com/products/z"), ("y", "https://x.com/a/y"),
        ("//cdn.com/i", "https://cdn.com/i"), ("http://o.org/", "http://o.org/"),
    ])
    keys = spark.createDataFrame([("Fauteuil Été", "abc", ""), ("Sofa", "", "https://i/x/ab_1~mv2.jpg")],
                                 "t string, d string, i string")
    got = [r[0] for r in keys.select(text.described_key(F.lit("src"), F.col("t"), F.col("d"), F.col("i"))).collect()]
    assert got == ["src:fauteuil-t:a9993e364706", "src:sofa:ab-1"]


def test_era(spark):
    check(spark, enrich.extract_era, [
        ("Chaise '60s", "1960s"), ("Années 60", "1960s"), ("1950’s", "1950s"), ("x1960sx", ""),
        ("in the 2010s", "2010s"), ("1930s", ""), ("", ""), ("‘’70s rug", "1970s"),
    ])


def test_dimensions(spark):
    check(spark, dimensions.extract_dimensions, [
        ("26''L x 30''P x 29.5''H etc", "26''L x 30''P x 29.5''H"),
        ("Largeur : 20” Profondeur : 16” Hauteur : 24”", "20”L x 16”P x 24”H"),
        ("Longueur : 125” Profondeur : 16” Hauteur : 88” à 100”", "125”L x 16”P x 88”/100”H"),
        ("Fauteuil : Largeur : 30\" Profondeur : 31\" Hauteur : 32\" Ottoman : Largeur : 20\" "
         "Profondeur : 21\" Hauteur : 15\"", "Fauteuil: 30\"L x 31\"P x 32\"H; Ottoman: 20\"L x 21\"P x 15\"H"),
        ("8,5\"Ø x 9\"H", "8,5\"Ø x 9\"H"),
        ("5,5\"D(with handle) x 11”H", "5,5\"D x 11”H"),
        ("Length 190 cm. Depth 80 cm. Height 77 cm", "190cmL x 80cmD x 77cmH"),
        ("Hauteur 12”H environ", "12”H"),
        ("seat height 18 in back height 30 in", ""),
        ("Width 1900 cm depth 80 cm", ""),
        ("W 20 D 30 W 10 cm", "20cmW x 30cmD"),
        ("rien", ""), ("10 x 12", ""), ("90 x 40 cm", "90 x 40 cm"),
        ("Largeur : 20” Profondeur : 16” Hauteur (assise) : 15” Hauteur : 24”", "20”L x 16”P x 24”H"),
    ])


def test_names(spark):
    df = spark.createDataFrame([
        (0, "Chaise", "Superbe chaise Arne Hovmand-Olsen pour Onsild Møbelfabrik, Danemark"),
        (1, "Lamp by Alessandro Becchi for Giovannetti", "x. y"),
        (2, "Lampe", "Contactez-nous pour les détails"),
        (3, "Lamp", "A lamp designed by Hans Wegner for Getama. Nice"),
        (4, "Lamp", "Getama Denmark"),
        (5, "Lamp", "This is a very long description of the lamp"),
    ], "i int, t string, d string")
    got = [tuple(r[0]) for r in df.select(enrich.designer_maker(F.col("t"), F.col("d")), "i").orderBy("i").collect()]
    assert got == [
        ("Arne Hovmand-Olsen", "Onsild Møbelfabrik"), ("Alessandro Becchi", "Giovannetti"), ("", ""),
        ("Hans Wegner", "Getama"), ("", "Getama Denmark"), ("", ""),
    ]
    check(spark, enrich.clean_designer, [
        ("Store Policies", ""), ("1960s Danish designer", ""), ("Montreal", ""),
        ("Hans Wegner", "Hans J. Wegner"), ("Design Hans J. Wegner", "Hans J. Wegner"), (" - Ib  Kofod Larsen,", "Ib Kofod-Larsen"),
        ("", ""), ("a b c d e f g", ""), ("Nanna Ditzel", "Nanna Ditzel"),
        ("Charles &amp; Ray Eames", "Charles & Ray Eames"),
    ])


def test_classes(spark):
    check(spark, lambda c: enrich.categorize(c, F.lit("")), [
        ("embedded", "beds / bedroom storage"), ("Buffet en teck", "sideboards / credenzas"),
        ("Chaise", "furniture"), ("Lampe", "lighting"),
    ])
    check(spark, enrich.extract_materials, [("Buffet en TECK et verre, bois", "teak, glass, wood"), ("", "")])
    check(spark, enrich.extract_condition, [("restaurée et reupholstered", "Restored, Reupholstered")])
    check(spark, enrich.shipping_scope, [
        ("Worldwide, quote", "worldwide_quote"), ("International", "international"),
        ("Canada and the United States", "canada_us"), ("Canada", "canada"), ("Montreal", "local_quote"),
    ])
    check(spark, enrich.is_promotional, [("joyeux noel", True), ("open table", False), ("sofa", False), ("", True)])
    check(spark, lambda c: enrich.normalize_availability(F.lit("https://schema.org/SoldOut"), c), [("x", "sold_out")])
    check(spark, lambda c: enrich.normalize_availability(F.lit(None).cast("string"), c), [("x", "available"), ("Out of Stock", "sold_out")])
    df = spark.createDataFrame([("Nice\n\n Matériaux \n\nTeck\nVerre\nDimensions\n10 cm",), ("x",), ("Materials",)], "t string")
    out = enrich.labeled_section(df, "t", ("materials", "materiaux", "matériaux"), "m").select("m").collect()
    assert [r.m for r in out] == ["Teck Verre", "", ""]


def test_display(spark):
    df = spark.createDataFrame([
        (1234.5, "$1,234.50 / 6", "CAD"), (None, "Sold out", "CAD"), (None, "Contact us", "CAD"),
        (None, "", "CAD"), (1250.0, "1250 / paire", "EUR"), (10.0, "10 ch.", "CAD"), (1250.0, "x / l'ens.", "CAD"),
    ], "v double, r string, c string")
    en = [r[0] for r in df.select(display.price_display(F.col("v"), F.col("r"), F.col("c"), "en")).collect()]
    fr = [r[0] for r in df.select(display.price_display(F.col("v"), F.col("r"), F.col("c"), "fr")).collect()]
    assert en == ["$1,234 CAD for set of 6", "Sold out", "Contact us for details", "Contact us for details",
                  "1,250 EUR for pair", "$10 CAD each", "$1,250 CAD for the set"]
    assert fr[0] == "1 234 $ CA pour l’ensemble de 6" and fr[1] == "Vendu"
    check(spark, lambda c: display.date_display(c.cast("timestamp"), "en"), [("2026-05-06T00:00:00", "May 6, 2026")])
    check(spark, lambda c: display.date_display(c.cast("timestamp"), "fr"), [("2026-05-06T00:00:00", "6 mai 2026")])
    check(spark, lambda c: display.category_list(c, "fr"), [("sofas, lighting,sofas,x", "sofas, luminaires, x"), (None, "")])
    check(spark, lambda c: display.material_label(c, "fr"), [("Teak, x,", "teck, x")])
    check(spark, lambda c: display.era_label(c, "fr"), [("1960s", "années 1960"), ("old", "old")])
    check(spark, lambda c: display.status_label(c, "fr"), [("on_hold", "on hold"), ("", "Inconnu")])


def test_paths(spark):
    check(spark, paths.path_type, [
        ("/", "home"), ("/shops?x=1", "shops"), ("/shops/a", "shop"), ("/listing/1", "listing"),
        ("/categories/c", "category"), ("shops", "other"), (None, "home"), ("?q=1", "home"),
    ])
    check(spark, paths.path_key, [("shops?x", "/shops"), ("", "/")])
    check(spark, paths.path_tracked, [
        ("/healthz", False), ("/adminx", False), ("/cron/refresh", False), ("/", True),
        ("/robots.txt", False), ("/internal/d1/query", False), ("/static/app.js", False),
    ])


def test_contains_any_evaluates_its_text_once(spark):
    from vitrine.functions.text import contains_any

    df = spark.createDataFrame([("xa",), ("xb",), ("x",), (None,)], "t string")
    found = contains_any(F.regexp_replace("t", "x", "y"), ("ya", "yb", "c"))
    assert [r[0] for r in df.select(found).collect()] == [True, True, False, None]
    kept = df.withColumn("k", F.regexp_replace("t", "x", "y")).filter(contains_any(F.col("k"), ("ya", "yb", "c"))).drop("k")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r.t for r in kept.collect()] == ["xa", "xb"]


def test_lines_are_cleaned_as_a_whole(spark):
    from vitrine.functions.text import clean_lines, clean_text, key_lines, lines_of, squash_key

    rows = [
        ("a  b \n  c\t",), (" \n\n x \r\n y",), ("",), ("\n",), (None,), ("É-é \x85 z\n--\n 1",),
    ]
    got = spark.createDataFrame(rows, "t string").select(
        clean_lines(F.col("t")).alias("a"), F.transform(lines_of(F.col("t")), clean_text).alias("b"),
        key_lines(F.col("t")).alias("c"), F.transform(lines_of(F.col("t")), squash_key).alias("d"),
    ).collect()
    assert [(r.a, r.c) for r in got] == [(r.b, r.d) for r in got]
    assert got[0].a == ["a b", "c"]


def test_plain_fragments_need_no_parser(monkeypatch):
    from vitrine.sources import html

    def parsed(fragment):
        reader = html._PageReader()
        reader.feed(fragment)
        reader.close()
        return reader.strings

    plain = [
        "", " a &amp; b ", "<p>x&eacute;</p><P class=\"a b\">y</P>z<br/>", "<a href='/x?a=1&amp;b=2'>t</a >",
        "<li>&lt;p&gt;</li>\n<b> </b>&am", "a &#39;50s",
    ]
    other = [
        "a < b", "<script>var a = '<p>';</script>b", "<!-- <p>c</p> -->d", "<p title=\"a>b\">e</p>",
        "<p class=x>f</p>", "<template><p>g</p></template>h", "<textarea><p>i</p></textarea>j", "k <p", "</ p>l",
        "<title>m &amp; n</title>o",
    ]
    assert [html.visible_strings(x) for x in plain + other] == [parsed(x) for x in plain + other]
    want = [parsed(x) for x in plain]
    monkeypatch.delattr(html, "_PageReader")
    assert [html.visible_strings(x) for x in plain] == want


def test_markup_and_titles_share_a_python_step(spark):
    from vitrine.functions.text import ascii_fold, html_text

    df = spark.createDataFrame([("<p>é&amp;</p>a\x0bb", "Ü"), (None, None)], "h string, t string")
    read = df.select(html_text(F.col("h")).alias("h"), ascii_fold(F.col("t")).alias("t"))
    assert read._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    got = read.select("h.*", "t").collect()
    assert [tuple(r) for r in got] == [("é&\na\nb", "e&\na\nb", "U"), (None, None, None)]


def test_pages_are_handed_on_a_few_at_a_time():
    import pyarrow as pa

    from vitrine.sources import html

    markup = [f"<title>t{i}</title><a href='/{i}'>x</a>" if i % 7 else None for i in range(300)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(300)), pa.array(markup), pa.array(["u"] * 300)], names=["page_id", "html", "url"]
    )
    parts = list(html._read_batches(iter([batch])))
    assert max(p.num_rows for p in parts) <= html.PAGES_AT_ONCE
    rows = [row for p in parts for row in p.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(300))
    assert rows[8]["page_title"] == "t8" and rows[8]["links"] == ["/8"] and rows[7]["visible_text"] == ""


def test_traits_are_those_of_the_expressions(spark):
    """What is found by words in Python is what the column expressions find."""
    from vitrine.functions import text as X

    texts = [
        None, "", "Sofa en teck, années 60. 90 cm x 80 cm", "Buffet  RESTAURÉ", "Table de Montréal", "details here",
        "contactez  nous", "Detailſ", "poKer LİT", "designed by A B for C D, 1960’s", "x pour y, 1950ſ",
        "AnnÉe 60", "années 70", "Arne Jacobsen pour Fritz Hansen, cuir", "one two three four five six", "lampe 1980s\x1cverre",
        "ánnée 90", "Ċanada", "canadá", "table a", "manger by",
    ]
    rows = [(i, t, d) for i, (t, d) in enumerate((t, d) for t in texts for d in texts)]
    df = spark.createDataFrame(rows, "i int, title string, description string")
    both = F.concat_ws(" ", "title", "description")
    plain = {
        "names": enrich.designer_maker(F.col("title"), F.col("description")),
        "m": enrich.extract_materials(both), "c": enrich.extract_condition(F.col("description")),
        "k": enrich.categorize(F.col("title"), F.col("description")), "e": enrich.extract_era(both),
    }
    want = [(*r.names, r.m, r.c, r.k, r.e) for r in df.select("i", *[v.alias(k) for k, v in plain.items()]).orderBy("i").collect()]
    columns = ["designer", "maker", "materials", "condition_text", "category", "era"]
    assert [tuple(r) for r in enrich.enrich_listings(df).orderBy("i").select(*columns).collect()] == want
    keys = df.select(X.lookup_key(F.col("title")).alias("a"), X.squash_key(X.ascii_fold(F.col("title"))).alias("b")).collect()
    assert [r.a for r in keys] == [r.b for r in keys]


def test_keywords_and_sections_cost_the_engine_no_pattern(spark):
    """Cleaned texts, keys, sections and keywords come out of the Python step that has the text anyway."""
    from vitrine.functions.text import html_texts

    df = spark.createDataFrame([("Sofa", "<p>a \x85 b</p><li>Materials</li><li> Oak &amp;\tash</li><li>Condition</li>")], "title string, h string")
    rows = df.withColumn("_h", html_texts(F.col("h"))).select("title", "_h.lines", "_h.folded", F.col("_h.text").alias("description"), "_h.key")
    out = enrich.enrich_listings(rows, "title", "description", "lines", "folded")
    plan = out.select("materials", "category", "condition_text", "key")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "contains" not in plan.lower().replace("containsnull", "")
    assert tuple(out.select("materials", "category", "description", "key").first()) == (
        "Oak & ash", "sofas", "a b Materials Oak & ash Condition", "a b materials oak ash condition")
    lines = [None, "", "x\r\nMatériaux\x0b Chêne  Features", "Dimensions", "dimensions\n\n 5 cm\n", "materials\nMaker\ny"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string")
    for labels, name in ((enrich.V.MATERIAL_LABELS, "materials"), (enrich.V.DIMENSION_LABELS, "dimensions")):
        lined = enrich.labeled_section(df, "t", labels, "want").withColumn("got", enrich.labelled_sections(F.col("t"), F.col("t"))[name])
        assert [r.got or "" for r in lined.orderBy("i").collect()] == [r.want for r in lined.orderBy("i").collect()]


def test_gallery_lines_are_read_in_one_pass():
    from vitrine.sources.feeds import read_gallery_text

    assert read_gallery_text("- Chaise  rouge -\n\n Deux pièces\n90 cm x 40\n1 200 $", "- Chaise  rouge -\n\n Deux pieces\n90 cm x 40\n1 200 $") == (
        "- Chaise rouge - Deux pièces 90 cm x 40 1 200 $", "chaise rouge deux pieces 90 cm x 40 1 200", "Chaise rouge Deux pièces", "1 200 $")
    assert read_gallery_text("Vendu\nTable\nVéndu", "Vendu\nTable\nVendu")[2:] == ("Vendu Table", "Véndu")
    assert read_gallery_text("a\nb\nc", "a\nb\nc")[2:] == ("a b", "")
    assert read_gallery_text(" \n", " \n") == ("", "", "", "")


def test_plain_pages_need_no_parser(monkeypatch):
    from vitrine.sources import html

    def parsed(page):
        reader = html._PageReader()
        reader.feed(page)
        reader.close()
        return vars_of(reader)

    def vars_of(reader):
        return reader.strings, reader.meta, reader.scripts, reader.links, reader.firsts

    plain = [
        "", " a &amp; b &am", "<!DOCTYPE html>\n<html lang=\"fr\"><title>T &lt; u</title><META content='1 &amp;amp; 2' name=\"description\"/>",
        "<h1>A <b>B</b></h1><div class=\"x rte\">x<div>y</div>z<br/>w</div>t", "<p itemprop=\"description\">a</p><!-- c - d -->b<!---->c",
        "<script type=\"application/ld+json\">{\"a\": \"&amp; > b\"}</script><SCRIPT>var a;</SCRIPT><style>.x{}</style >z",
        "<a href=\"/a?b=1&amp;c=2\">1</a><a name=\"n\">2</a><template><p>h</p></template>", "<div data-product-description>d</div>a > b",
        "<textarea>x &amp; y</textarea><p\n class='rte'>q</p>", "<script></script><h1></h1><h1>later</h1>",
    ]
    other = [
        "a < b", "<script>if (a < b) {}</script>c", "<script>'<p>'</script>x", "<p class=x>f</p>", "<p title=\"a>b\">e</p>", "<script/>x<p>y",
        "<title><b>m</b></title>o", "<!-- <p>c</p> -->d", "k <p", "</ p>l", "</p x=\"1\">m", "<script><!-- a --></script>b", "<p>x<!DOCTYPE html>y",
        "<noscript><p>n</p></noscript>", "<iframe>a</iframe>b", "<script>a", "<title>b", "<?php x ?>c", "<![CDATA[x]]>y", "<p a =\"1\">z", "<my-tag>x</my-tag>",
    ]
    assert [vars_of(html.parse_page(x)) for x in plain + other] == [parsed(x) for x in plain + other]
    want = [parsed(x) for x in plain]
    monkeypatch.setattr(html._PageReader, "feed", None)
    assert [vars_of(html.parse_page(x)) for x in plain] == want
