"""Display-ready columns in English and French."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions.text import java, let, null_if_empty, quote_plus, text_or_empty


def _label(kind: str, lang: str, key: Column) -> Column:
    labels = V.LABELS[kind][lang]
    if not labels:
        return F.lit(None).cast("string")
    return F.try_element_at(
        F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), key
    )


def status_label(column: Column, lang: str) -> Column:
    value = F.coalesce(null_if_empty(column), F.lit("unknown"))
    return F.coalesce(
        _label("status", lang, value), _label("status", "en", value),
        F.translate(value, "_", " "),
    )


def category_label(column: Column, lang: str) -> Column:
    value = F.trim(text_or_empty(column))
    return F.coalesce(_label("category", lang, value), value)


def category_list(column: Column, lang: str) -> Column:
    labels = F.transform(F.split(text_or_empty(column), ","), lambda c: category_label(c, lang))
    return F.array_join(F.array_distinct(F.filter(labels, lambda x: x != "")), ", ")


def _piecewise(column: Column, label: object) -> Column:
    pieces = F.transform(F.split(text_or_empty(column), ","), lambda p: F.trim(p))
    labels = F.transform(pieces, lambda p: F.coalesce(label(p), p))
    return F.array_join(F.filter(labels, lambda x: x != ""), ", ")


def material_label(column: Column, lang: str) -> Column:
    return _piecewise(column, lambda p: _label("material", lang, F.lower(p)))


def condition_label(column: Column, lang: str) -> Column:
    return _piecewise(column, lambda p: _label("condition", lang, p))


def era_label(column: Column, lang: str) -> Column:
    value = F.trim(text_or_empty(column))
    decade = F.regexp_extract(value, V.ERA_PATTERN, 1)
    return F.when(decade != "", F.format_string(V.ERA_LABEL[lang], decade)).otherwise(value)


def price_set_suffix(raw: Column, lang: str) -> Column:
    words = V.PRICE_SUFFIX[lang]
    text = text_or_empty(raw)
    count = F.regexp_extract(text, java(V.PRICE_SET_COUNT_PATTERN), 1)
    return (
        F.when(count != "", F.concat(F.lit(words["count"]), count))
        .when(text.rlike(java(V.PRICE_PAIR_PATTERN, True)), words["pair"])
        .when(text.rlike(java(V.PRICE_EACH_PATTERN, True)), words["each"])
        .when(text.rlike(java(V.PRICE_WHOLE_SET_PATTERN, True)), words["set"])
        .otherwise("")
    )


def price_display(value: Column, raw: Column, currency: Column, lang: str) -> Column:
    lowered = F.lower(text_or_empty(raw))
    quote = F.lit(V.QUOTE_REQUIRED[lang])
    unpriced = (
        F.when(
            lowered.contains("rupture de stock") | lowered.contains("sold out"),
            status_label(F.lit("sold_out"), lang),
        )
        .when(lowered.contains("contact"), quote)
        .otherwise(F.coalesce(null_if_empty(raw), quote))
    )
    amount = F.format_number(value, 0)  # rounds half to even
    is_default = currency == V.DEFAULT_CURRENCY
    suffix = price_set_suffix(raw, lang)
    if lang == "fr":
        unit = F.when(is_default, "$ CA").otherwise(currency)
        priced = F.concat(F.translate(amount, ",", " "), F.lit(" "), unit, suffix)
    else:
        priced = F.concat(
            F.when(is_default, "$").otherwise(""), amount, F.lit(" "),
            F.when(is_default, V.DEFAULT_CURRENCY).otherwise(currency), suffix,
        )
    return F.when(value.isNull(), unpriced).otherwise(priced)


def freshness_bucket(checked_at: Column, as_of: Column, lang: str) -> Column:
    today, week, stale = V.FRESHNESS[lang]
    return (
        F.when(checked_at >= as_of - F.expr("INTERVAL 1 DAY"), today)
        .when(checked_at >= as_of - F.expr("INTERVAL 7 DAYS"), week)
        .otherwise(stale)
    )


def date_display(moment: Column, lang: str) -> Column:
    month = F.element_at(F.array(*[F.lit(m) for m in V.MONTHS[lang]]), F.month(moment))
    day, year = F.dayofmonth(moment).cast("string"), F.year(moment).cast("string")
    if lang == "fr":
        return F.concat_ws(" ", day, month, year)
    return F.concat(month, F.lit(" "), day, F.lit(", "), year)


def listing_count(count: Column, lang: str) -> Column:
    one, other = V.LISTING_COUNT[lang]
    return F.when(count == 1, one).otherwise(F.format_string(other, count))


def _present(*columns: Column) -> Column:
    return F.filter(
        F.array(*[F.trim(text_or_empty(c)) for c in columns]), lambda x: x != ""
    )


def address_lines(df: DataFrame) -> Column:
    place = F.array_join(_present(df["city"], df["province"], df["postal_code"]), " ")
    return _present(df["street_address"], place, df["country"])


def map_url(df: DataFrame, prefix: str = V.DIRECTIONS_URL) -> Column:
    query = F.array_join(
        _present(
            df["name"], df["street_address"], df["city"], df["province"], df["postal_code"]
        ),
        ", ",
    )
    return let(
        query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit(prefix), quote_plus(q)))
    )


def has_map(df: DataFrame) -> Column:
    """A street and a known position; zero coordinates count as unknown."""
    return (
        (text_or_empty(df["street_address"]) != "")
        & F.coalesce(df["latitude"] != 0, F.lit(False))
        & F.coalesce(df["longitude"] != 0, F.lit(False))
    )


def localize_catalog(
    listings: DataFrame,
    shops: DataFrame,
    shop_labels: DataFrame | None,
    lang: str,
    as_of: Column,
) -> DataFrame:
    """Display-ready listing rows.

    ``shop_labels(slug, lang, field, text)`` holds translated shop texts. They are pivoted to one
    row per shop before the join, and missing ones fall back to the shop's own text.
    """
    fields = ("shipping_summary", "description", "style_focus")
    dim = shops.select(
        F.col("id").alias("source_shop_id"),
        F.col("slug").alias("shop_slug"),
        F.col("name").alias("shop_name"),
        F.array_join(address_lines(shops), "\n").alias("shop_address"),
        map_url(shops).alias("shop_directions_url"),
        map_url(shops, V.APPLE_MAPS_URL).alias("shop_apple_maps_url"),
        has_map(shops).cast("int").alias("shop_has_map"),
        *[F.col(f).alias(f"_{f}") for f in fields],
    )
    if shop_labels is not None:
        texts = (
            shop_labels.filter(F.col("lang") == lang)
            .groupBy(F.col("slug").alias("shop_slug"))
            .agg(
                *[
                    F.max(F.when(F.col("field") == f, null_if_empty(F.col("text")))).alias(f"_t_{f}")
                    for f in fields
                ]
            )
        )
        dim = dim.join(texts, "shop_slug", "left")
    else:
        dim = dim.withColumns({f"_t_{f}": F.lit(None).cast("string") for f in fields})
    dim = dim.select(
        "source_shop_id", "shop_slug", "shop_name", "shop_address", "shop_directions_url",
        "shop_apple_maps_url", "shop_has_map", "_shipping_summary",
        *[F.coalesce(f"_t_{f}", f"_{f}").alias(f"shop_{f}") for f in fields],
    )
    note = text_or_empty(F.col("shipping_note"))
    status = F.coalesce(null_if_empty(F.col("availability_override")), "availability_status")
    category = F.coalesce(null_if_empty(F.col("category_override")), "category")
    return listings.join(dim, "source_shop_id").select(
        "id", "shop_slug", "shop_name", "shop_address", "shop_directions_url",
        "shop_apple_maps_url", "shop_has_map", "shop_description", "shop_style_focus",
        price_display(F.col("price_value"), F.col("price_raw"), F.col("currency"), lang).alias(
            "price_text"
        ),
        status_label(status, lang).alias("status_text"),
        category_label(category, lang).alias("category_text"),
        material_label(F.col("materials"), lang).alias("material_text"),
        condition_label(F.col("condition_text"), lang).alias("condition_label"),
        era_label(F.col("era"), lang).alias("era_text"),
        date_display(F.col("first_seen_at"), lang).alias("first_seen_text"),
        freshness_bucket(F.col("last_checked_at"), as_of, lang).alias("freshness"),
        F.when((note == "") | (note == F.col("_shipping_summary")), F.col("shop_shipping_summary"))
        .otherwise(note)
        .alias("shipping_text"),
    )
