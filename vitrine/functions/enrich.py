"""Attributes and classes read from a listing's title and description."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import fixed_values as V
from vitrine.functions.dimensions import extract_dimensions
from vitrine.functions.text import (
    ascii_fold,
    clean_lines,
    clean_text,
    cleaned,
    contains_any,
    filter_key,
    first_match,
    fold_all,
    has_any,
    html_unescape,
    java,
    key_lines,
    let,
    non_empty,
    normalize_lookup,
    squash_key,
    squashed,
    text_or_empty,
    texts_of,
    unify_line_breaks,
)


def _words(column: Column) -> Column:
    return F.size(F.split(column, " "))


def extract_era(text: Column) -> Column:
    """``1960s`` from ``1960s``, ``1960’s``, ``'60s`` or ``années 60``; first decade form wins."""
    quotes = "[’']"

    def render(found: Column) -> Column:
        bare = F.regexp_replace(found, quotes, "")
        short = found.startswith("'") | found.startswith("’")
        return F.when(found == "", None).when(short, F.concat(F.lit("19"), bare)).otherwise(bare)

    def eras(bound: Column) -> Column:
        decade = let(first_match(bound, java(V.ERA_DECADE_PATTERN, True), 1), render)
        french = let(
            first_match(bound, java(V.ERA_FRENCH_PATTERN, True), 1),
            lambda d: F.when(d != "", F.concat(F.lit("19"), d, F.lit("s"))),
        )
        # every form has a zero
        return F.when(bound.contains("0"), F.coalesce(decade, french))

    return F.coalesce(let(text, eras), F.lit(""))


def extract_materials(text: Column) -> Column:
    """Known materials by substring, in dictionary order."""
    return _names_found(text, V.MATERIALS)


def _names_found(text: Column, names: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The names of which a word is in the text, which is lowered once for all of them."""
    return let(
        F.lower(text_or_empty(text)),
        lambda t: F.array_join(
            F.array(*[F.when(has_any(t, words), F.lit(name)) for name, words in names]), ", "
        ),
    )


def extract_condition(text: Column) -> Column:
    return _names_found(text, V.CONDITIONS)


def categorize(title: Column, description: Column) -> Column:
    """First category with a keyword anywhere in the text (``bed`` also hits "embedded")."""
    text = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(description)))
    return let(
        text,
        lambda t: F.coalesce(
            *[F.when(has_any(t, words), F.lit(name)) for name, words in V.CATEGORIES],
            F.lit(V.DEFAULT_CATEGORY),
        ),
    )


def shipping_scope(summary: Column) -> Column:
    lowered = F.lower(text_or_empty(summary))
    abroad = contains_any(lowered, ("international", "worldwide"))
    return (
        F.when(abroad & lowered.contains("quote"), "worldwide_quote")
        .when(abroad, "international")
        .when(lowered.contains("canada") & lowered.contains("united states"), "canada_us")
        .when(lowered.contains("canada"), "canada")
        .otherwise("local_quote")
    )


def is_furniture(lookup: Column) -> Column:
    """``lookup`` is the normalized title and description, as for the other classifiers."""
    return contains_any(lookup, V.FURNITURE_TERMS)


def is_current_production(lookup: Column) -> Column:
    return lookup.contains(V.CURRENT_PRODUCTION)


def is_gift_card(title_lookup: Column) -> Column:
    return title_lookup == V.GIFT_CARD_TITLE


def is_promotional(lookup: Column) -> Column:
    """An empty text, or an announcement that names no inventory."""
    return (lookup == "") | (
        contains_any(lookup, V.ANNOUNCEMENT_TERMS) & ~contains_any(lookup, V.INVENTORY_TERMS)
    )


def is_sold_out_page(lookup: Column) -> Column:
    return contains_any(lookup, V.SOLD_OUT_PAGE_TERMS)


def normalize_availability(offer: Column, page_text: Column) -> Column:
    offered, text = F.lower(text_or_empty(offer)), F.lower(text_or_empty(page_text))
    sold = contains_any(offered, ("sold out", "soldout")) | contains_any(
        text, ("rupture de stock", "sold out", "out of stock")
    )
    return F.when(sold, "sold_out").otherwise("available")


def marked_sold(lookup: Column) -> Column:
    return F.when(lookup.contains(V.SOLD_MARKER), "sold_out").otherwise("available")


def section_of(lines: Column, keys: Column, labels: tuple[str, ...]) -> Column:
    """Text below the first line that is one of ``labels``, up to the next known label.

    ``lines`` are cleaned lines, ``keys`` their lookup keys at the same positions.
    """
    wanted = list(dict.fromkeys(_plain(label) for label in labels))
    firsts = [F.nullif(F.array_position(keys, label), F.lit(0)) for label in wanted]
    start = F.least(*firsts) if len(firsts) > 1 else firsts[0]

    def below(bound: Column) -> Column:
        after = F.slice(bound["keys"], bound["start"] + 1, F.size(bound["keys"]))
        stop = F.array_position(F.transform(after, lambda k: k.isin(*V.SECTION_LABELS)), True)
        count = F.when(stop > 0, stop - 1).otherwise(F.size(after)).cast("int")
        body = F.slice(bound["lines"], bound["start"] + 1, count)
        return clean_text(F.array_join(F.filter(body, lambda x: x != ""), " "))

    found = F.struct(lines.alias("lines"), keys.alias("keys"), start.cast("int").alias("start"))
    # few texts have the label; only they are cut
    return F.when(start.isNotNull(), let(found, below)).otherwise("")


def _plain(label: str) -> str:
    return label.replace("é", "e")


def with_section_lines(df: DataFrame, text: str, folded: str | None = None) -> DataFrame:
    """Adds ``_lines`` and ``_keys``: the cleaned lines of ``text`` and their lookup keys.

    ``folded`` names the folded form of a ``text`` that has plain line feeds only.
    """
    if folded is not None:
        return df.withColumns(
            {
                "_lines": clean_lines(F.col(text)),
                "_keys": key_lines(F.col(folded)),
            }
        )
    return (
        df.withColumn("_unified", unify_line_breaks(F.col(text)))
        .withColumn("_folded", ascii_fold(F.col("_unified")))
        .withColumn("_lines", clean_lines(F.col("_unified")))
        .withColumn("_keys", key_lines(F.col("_folded")))
        .drop("_unified", "_folded")
    )


def labeled_section(df: DataFrame, text: str, labels: tuple[str, ...], out: str) -> DataFrame:
    lined = with_section_lines(df, text)
    return lined.withColumn(out, section_of(F.col("_lines"), F.col("_keys"), labels)).drop(
        "_lines", "_keys"
    )


def clean_designer_name(column: Column) -> Column:
    """'' for more than five words or sentence punctuation."""
    return let(
        clean_text(column),
        lambda c: F.when((_words(c) > 5) | c.rlike("[.;:!?]"), "").otherwise(c),
    )


def clean_maker_name(column: Column) -> Column:
    """'' for more than six words, boilerplate or places."""
    return let(
        clean_text(column),
        lambda c: F.when((_words(c) > 6) | _no_maker(c), "").otherwise(c),
    )


def _no_maker(name: Column) -> Column:
    return name.rlike(java(V.MAKER_BOILERPLATE_PATTERN, True)) | name.rlike(
        java(V.MAKER_PLACE_PATTERN, True)
    )


def designer_maker(title: Column, description: Column, traits: Column | None = None) -> Column:
    """``struct<designer, maker>`` by the first of four rules that names a designer.

    ``traits`` (of ``text_traits``) tells which rules have their words, so that the others aren't tried.

    1. ``X pour Y`` in the description: the last full name before "pour", and Y.
    2. ``by X for Y`` in the title.
    3. ``designed by X for Y`` in the first sentence of the description.
    4. No designer; a short description is taken as the maker.
    """

    def pair(designer: Column, maker: Column) -> Column:
        return F.struct(designer.alias("designer"), maker.alias("maker"))

    def named(bound: Column) -> Column:
        return F.when(bound["designer"] != "", bound)

    anchored = java("^" + V.POUR_PATTERN, True)
    has_pour = description.rlike(java(r"\spour\s", True))
    pour = F.when(
        has_pour if traits is None else traits["has_pour"] & has_pour,
        pair(
            F.coalesce(
                clean_text(
                    F.try_element_at(
                        F.regexp_extract_all(
                            first_match(description, anchored, 1),
                            F.lit(java(V.PERSON_NAME_PATTERN)),
                            F.lit(0),
                        ),
                        F.lit(-1),
                    )
                ),
                F.lit(""),
            ),
            clean_text(first_match(description, anchored, 2)),
        ),
    )
    # the rules with "by" are only tried where it stands
    by = F.when(
        F.lower(title).contains("by") if traits is None else traits["title_by"],
        pair(
            clean_designer_name(first_match(title, java(V.BY_PATTERN, True), 1)),
            clean_maker_name(first_match(title, java(V.BY_PATTERN, True), 2)),
        ),
    )
    sentence = F.get(F.split(description, r"[.\n|]", 2), F.lit(0))
    designed_by = F.when(
        F.lower(description).contains("by") if traits is None else traits["text_by"],
        pair(
            clean_designer_name(first_match(sentence, java(V.DESIGNED_BY_PATTERN, True), 1)),
            clean_maker_name(first_match(sentence, java(V.DESIGNED_BY_PATTERN, True), 2)),
        ),
    )
    if traits is None:
        short = let(
            clean_maker_name(description), lambda m: F.when(_words(m) < 6, m).otherwise("")
        )
    else:
        short = F.when(
            traits["maker_doubt"], F.when(_no_maker(traits["maker"]), "").otherwise(traits["maker"])
        ).otherwise(traits["maker"])
    return F.coalesce(
        let(pour, named),
        let(by, named),
        let(designed_by, named),
        pair(F.lit(""), short),
    )


def clean_designer(column: Column) -> Column:
    """Name fit for the designer facet, '' for boilerplate, places, decades and long texts."""
    unescaped = F.regexp_replace(html_unescape(text_or_empty(column)), V.JAVA_WHITESPACE + "+", " ")
    name = F.regexp_replace(F.trim(unescaped, F.lit(" -–—,")), r"(?i)^design\s+", "")
    return _known_designer(name, filter_key(name))


def _known_designer(name: Column, key: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in V.DESIGNER_ALIASES.items() for x in pair])

    def render(bound: Column) -> Column:
        cleaned, normalized = bound["name"], bound["key"]
        unusable = (
            (cleaned == "")
            | contains_any(normalized, V.DESIGNER_BOILERPLATE)
            | normalized.isin(*V.DESIGNER_PLACES)
            | normalized.rlike(V.DESIGNER_DECADE_PATTERN)
            | (F.length(cleaned) > V.DESIGNER_MAX_CHARS)
            | (_words(F.trim(cleaned)) > V.DESIGNER_MAX_WORDS)
        )
        return F.when(unusable, "").otherwise(
            F.coalesce(F.try_element_at(aliases, normalized), cleaned)
        )

    return let(F.struct(name.alias("name"), key.alias("key")), render)


def enrich_listings(
    df: DataFrame,
    title: str = "title",
    description: str = "description",
    description_lines: str | None = None,
    folded_lines: str | None = None,
) -> DataFrame:
    """Adds every attribute derived from a parsed record's texts.

    ``description`` is cleaned text; ``description_lines`` the same text with its line breaks, from
    which labelled "Materials" and "Dimensions" sections take precedence over keyword matching.
    """
    both = F.concat_ws(" ", F.col(title), F.col(description))
    made = {"_traits": text_traits(F.col(title), F.col(description))}
    if description_lines is not None:
        texts = F.col(description_lines), F.col(folded_lines or description_lines)
        made["_sections"] = (folded_sections if folded_lines else labelled_sections)(*texts)
    traits = F.col("_traits")
    materials, dimensions = traits["materials"], extract_dimensions(F.col(description))
    if description_lines is not None:
        materials = F.coalesce(F.col("_sections.materials"), materials)
        dimensions = F.coalesce(F.col("_sections.dimensions"), dimensions)
    staged = df.withColumns(made).withColumns(
        {
            "_names": designer_maker(F.col(title), F.col(description), traits),
            "materials": materials,
            "dimensions_text": dimensions,
            "condition_text": traits["condition"],
            "category": traits["category"],
            "era": F.when(traits["has_era"], extract_era(both)).otherwise(""),
        }
    )
    return staged.withColumns(
        {"designer": F.col("_names.designer"), "maker": F.col("_names.maker")}
    ).drop("_names", *made)


# --- what is found by words alone ---------------------------------------------------------------

TRAIT_TEXTS = ("materials", "condition", "category", "maker")
TRAIT_MARKS = ("maker_doubt", "has_pour", "title_by", "text_by", "has_era")
# letters that patterns without case take for others, which lower() does not give
ODD_CASES = str.maketrans("\u017f\u212a\u0130\u0131", "skii")
MAKER_WORDS = (
    "contactez-nous", "contactez nous", "details", "détails", "frais s’appliques", "more information",
    "checkout", "shipping", "policies", "canada", "montreal", "montréal", "ottawa",
)
ERA_WORDS = ("0s", "0's", "0’s", "ann")


def _lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ODD_CASES).lower()


NAMED_WORDS = tuple(dict.fromkeys(w for _, words in V.MATERIALS + V.CATEGORIES for w in words))
CONDITION_WORDS = tuple(w for _, words in V.CONDITIONS for w in words)


MATERIAL_SETS, CONDITION_SETS, CATEGORY_SETS = (
    tuple((name, frozenset(words)) for name, words in names)
    for names in (V.MATERIALS, V.CONDITIONS, V.CATEGORIES)
)


def _names_of(found: list[str], names: tuple[tuple[str, frozenset[str]], ...]) -> list[str]:
    """The names of which a word was found, in their order."""
    return [name for name, words in names if not words.isdisjoint(found)] if found else []


def read_traits(title: str | None, description: str | None) -> tuple:
    """``TRAIT_TEXTS`` and ``TRAIT_MARKS`` of one title and cleaned description.

    ``maker`` is the description if it has less than six words; ``maker_doubt`` that it may be boilerplate or a
    place. The other marks tell that a pattern's words are there; the pattern decides.
    """
    head, text = title or "", description or ""
    low_head, low_text = head.lower(), text.lower()
    # a title that is missing is left out, one that is empty is not
    both = low_text if title is None else low_head if description is None else f"{low_head} {low_text}"
    odd = not (head.isascii() and text.isascii())
    marked = _lowered(text) if odd else low_text
    marked_both = _lowered(head) + " " + marked if odd else both
    clean = cleaned(text)
    maker = clean if len(clean.split(" ")) < 6 else ""
    named = [w for w in NAMED_WORDS if w in both]
    states = [w for w in CONDITION_WORDS if w in low_text]
    shown = _lowered(maker)
    return (
        ", ".join(_names_of(named, MATERIAL_SETS)), ", ".join(_names_of(states, CONDITION_SETS)),
        next(iter(_names_of(named, CATEGORY_SETS)), V.DEFAULT_CATEGORY),
        maker, bool(maker) and any([w in shown for w in MAKER_WORDS]),
        "pour" in marked, "by" in low_head, "by" in low_text,
        "0" in marked_both and any([w in marked_both for w in ERA_WORDS]),
    )


@F.arrow_udf(
    T.StructType(
        [T.StructField(name, T.StringType()) for name in TRAIT_TEXTS]
        + [T.StructField(name, T.BooleanType()) for name in TRAIT_MARKS]
    )
)
def text_traits(titles: pa.Array, descriptions: pa.Array) -> pa.Array:
    rows = [read_traits(*pair) for pair in zip(titles.to_pylist(), descriptions.to_pylist(), strict=True)]
    names = [*TRAIT_TEXTS, *TRAIT_MARKS]
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.StructArray.from_arrays(
        [
            pa.array(list(column), pa.string() if name in TRAIT_TEXTS else pa.bool_())
            for name, column in zip(names, columns, strict=True)
        ],
        names,
    )


SECTIONS = {
    "materials": frozenset(map(_plain, V.MATERIAL_LABELS)),
    "dimensions": frozenset(map(_plain, V.DIMENSION_LABELS)),
}


def read_section(lines: list[str], keys: list[str], labels: frozenset[str]) -> str | None:
    """``section_of`` with Python texts; None where there is none or it is empty."""
    for start, key in enumerate(keys):
        if key in labels:
            break
    else:
        return None
    body = []
    for line, key in zip(lines[start + 1 :], keys[start + 1 :], strict=False):
        if key in V.SECTION_LABELS:
            break
        body.append(line)
    return cleaned(" ".join(body)) or None


def _sections(lines: pa.Array, folded: pa.Array) -> pa.Array:
    found: dict[str, list[str | None]] = {name: [] for name in SECTIONS}
    for text, fold in zip(lines.to_pylist(), folded.to_pylist(), strict=True):
        shown = "" if text is None else text
        keys = [squashed(x) for x in ("" if fold is None else fold).split("\n")]
        for name, labels in SECTIONS.items():
            found[name].append(read_section(shown.split("\n"), keys, labels))
    return pa.StructArray.from_arrays(
        [pa.array(column, pa.string()) for column in found.values()], list(found)
    )


@F.arrow_udf(texts_of(tuple(SECTIONS)))
def folded_sections(lines: pa.Array, folded: pa.Array) -> pa.Array:
    """The labelled sections of texts that have plain line feeds only, and their folded forms."""
    return _sections(lines, folded)


@F.arrow_udf(texts_of(tuple(SECTIONS)))
def labelled_sections(texts: pa.Array, _: pa.Array) -> pa.Array:
    """The labelled sections of texts with line breaks of any kind."""
    lines = pa.array(
        [None if x is None else "\n".join(x.splitlines()) for x in texts.to_pylist()], pa.string()
    )
    return _sections(lines, fold_all(lines))
