"""Column expressions for cleaning text and deriving keys.

Three things are not available as Spark functions and run as small Arrow UDFs: Unicode
compatibility folding (by Arrow's own kernels), HTML entity unescaping and stripping HTML tags. What follows
at once from a text that is there anyway (its cleaned form, its lookup key) is made there too, by Python's own
split and translate, which take a fraction of the engine's time. Everything else is native.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import fixed_values as V
from vitrine.sources.html import visible_strings

INNER_WHITESPACE = V.JAVA_WHITESPACE.replace(r"\n", "")  # within a line
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def java(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` with Unicode character classes, as Python's ``re`` has them."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def null_if_empty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def non_empty(value: Column) -> Column:
    """``value``, null when ''. Unlike ``nullif`` it evaluates a costly ``value`` once."""
    return F.get(F.filter(F.array(value), lambda x: x != ""), F.lit(0))


def non_zero(value: Column) -> Column:
    return F.get(F.filter(F.array(value), lambda x: x != 0), F.lit(0))


def contains_any(column: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Whether one of ``terms`` is in the text. ``column`` is evaluated once, also where a filter on it is
    moved below the projection that makes it."""

    return let(column, lambda value: has_any(value, terms))


def has_any(value: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """As ``contains_any``, for a ``value`` that is bound already: it stands once per term."""
    result = value.contains(terms[0])
    for term in terms[1:]:
        result = result | value.contains(term)
    return result


def fold_all(values: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(
        pc.utf8_normalize(values, form="NFKD"), pattern=r"[^\x00-\x7f]+", replacement=""
    )


@F.arrow_udf(T.StringType())
def ascii_fold(values: pa.Array) -> pa.Array:
    """NFKD, then drop everything outside ASCII. Line breaks survive."""
    return fold_all(values)


@F.arrow_udf(T.StringType())
def without_accents(values: pa.Array) -> pa.Array:
    """NFKD, then drop the marks; letters that are no compositions stay."""
    return pc.replace_substring_regex(
        pc.utf8_normalize(values, form="NFKD"), pattern=r"\pM+", replacement=""
    )


@F.arrow_udf(T.StringType())
def html_unescape(values: pa.Array) -> pa.Array:
    """An Arrow function like the folding ones: those called on its result run in the same worker."""
    return pa.array([None if x is None else html.unescape(x) for x in values.to_pylist()], pa.string())


#: What a lookup key keeps of an ASCII text in lower case; all else is a space.
KEY_CHARACTERS = {i: chr(i) if chr(i).isalnum() else " " for i in range(128)}


def cleaned(text: str) -> str:
    """``clean_text`` of a Python text: its ``split`` knows the same white space."""
    return " ".join(text.split())


def squashed(folded: str) -> str:
    """``squash_key`` of a Python text."""
    return " ".join(folded.lower().translate(KEY_CHARACTERS).split())


def keys_of(values: pa.Array) -> list[str | None]:
    """The lookup keys of texts."""
    return [None if x is None else squashed(x) for x in fold_all(values).to_pylist()]


@F.arrow_udf(T.StringType())
def lookup_key(values: pa.Array) -> pa.Array:
    """``squash_key`` of the folded text."""
    return pa.array(keys_of(values), pa.string())


def _visible_lines(values: pa.Array) -> pa.Array:
    return pa.array(
        [
            None if x is None else "\n".join("\n".join(visible_strings(x)).splitlines())
            for x in values.to_pylist()
        ],
        pa.string(),
    )


@F.arrow_udf(T.StructType().add("lines", "string").add("folded", "string"))
def html_text(values: pa.Array) -> pa.Array:
    """Visible text of an HTML fragment, one text node (or line of it) per line, and its folded
    form, so that a feed passes its markup to Python once, with the texts it only folds."""
    lines = _visible_lines(values)
    return pa.StructArray.from_arrays([lines, fold_all(lines)], ["lines", "folded"])


def texts_of(names: tuple[str, ...]) -> T.StructType:
    """The type of a record of texts."""
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


HTML_TEXTS = ("lines", "folded", "text", "key")


@F.arrow_udf(texts_of(HTML_TEXTS))
def html_texts(values: pa.Array) -> pa.Array:
    """``html_text`` with the cleaned text and its lookup key."""
    lines = _visible_lines(values)
    folded = fold_all(lines)
    text = pa.array(["" if x is None else cleaned(x) for x in lines.to_pylist()], pa.string())
    key = pa.array([None if x is None else squashed(x) for x in folded.to_pylist()], pa.string())
    return pa.StructArray.from_arrays([lines, folded, text, key], list(HTML_TEXTS))


def clean_text(column: Column) -> Column:
    """Collapse Unicode white space to single spaces and trim; null becomes ''."""
    return F.trim(F.regexp_replace(text_or_empty(column), V.JAVA_WHITESPACE + "+", " "))


def squash_key(folded: Column) -> Column:
    """Lower-case ASCII words separated by single spaces, from already folded text."""
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def normalize_lookup(column: Column) -> Column:
    return lookup_key(text_or_empty(column))


def filter_key(column: Column) -> Column:
    """Key used to compare names: entities unescaped, accents folded, ``&`` read as "and".

    A letter without a decomposition (``ø``) is dropped, so ``Børge`` becomes ``brge``.
    """
    folded = ascii_fold(html_unescape(text_or_empty(column)))
    return squash_key(F.replace(folded, F.lit("&"), F.lit(" and ")))


def normalize_title(column: Column) -> Column:
    """Each character that is neither letter nor number becomes a space; not collapsed."""
    return F.trim(F.lower(F.regexp_replace(text_or_empty(column), r"[^\p{L}\p{N}]", " ")))


def slugify(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(column)), "[^a-z0-9]+", "-"), F.lit("-"))


def slug_to_title(column: Column) -> Column:
    words = F.trim(F.translate(text_or_empty(column), "-_", "  "))
    runs = F.regexp_extract_all(words, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def lines_of(column: Column) -> Column:
    return F.split(column, "\n")


def clean_lines(column: Column) -> Column:
    """``clean_text`` of each line, made on the text as a whole."""
    return _trimmed_lines(F.regexp_replace(column, INNER_WHITESPACE + "+", " "))


def key_lines(folded: Column) -> Column:
    """``squash_key`` of each line, made on the text as a whole."""
    return _trimmed_lines(F.regexp_replace(F.lower(folded), "[^a-z0-9\n]+", " "))


def _trimmed_lines(column: Column) -> Column:
    return lines_of(F.trim(F.regexp_replace(column, " ?\n ?", "\n")))


def unify_line_breaks(column: Column) -> Column:
    return F.regexp_replace(text_or_empty(column), LINE_BREAK, "\n")


def parse_price(column: Column) -> Column:
    """Number in a price text; null when there is none.

    With both separators present the last one is the decimal sign. Lone commas separate thousands
    when three digits follow the last one, else the last comma is the decimal sign. Of several
    lone dots the last one is the decimal sign.
    """

    def read(digits: Column) -> Column:
        has_comma, has_dot = digits.contains(","), digits.contains(".")
        only_last_comma = F.translate(F.regexp_replace(digits, ",(?=.*,)", ""), ",", ".")
        number = (
            F.when(
                has_comma & has_dot,
                F.when(
                    digits.rlike(r",[^.]*$"),
                    F.translate(F.replace(digits, F.lit("."), F.lit("")), ",", "."),
                ).otherwise(F.replace(digits, F.lit(","), F.lit(""))),
            )
            .when(has_comma & digits.rlike(r",\d{3}$"), F.replace(digits, F.lit(","), F.lit("")))
            .when(has_comma, only_last_comma)
            .otherwise(F.regexp_replace(digits, r"\.(?=.*\.)", ""))
        )
        return number.try_cast("double")

    return let(F.regexp_replace(text_or_empty(column), "[^0-9,.]", ""), read)


def first_match(column: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, '' when there is none."""
    return F.regexp_extract(column, pattern, group)


def price_text(column: Column) -> Column:
    """First ``$1,234.00 CAD`` in the text, else the first ``$1,234``, else ''."""
    return F.coalesce(
        non_empty(first_match(column, java(V.PRICE_CAD_PATTERN))),
        first_match(column, java(V.PRICE_DOLLAR_PATTERN)),
    )


def price_line(description: Column, folded: Column) -> Column:
    """Last non-blank line holding a price or the sold marker, else ''.

    ``folded`` is ``ascii_fold(description)``: the marker is looked up without accents.
    """
    pairs = F.arrays_zip(
        F.transform(lines_of(description), clean_text).alias("line"),
        F.transform(lines_of(folded), squash_key).alias("key"),
    )
    hits = F.filter(
        pairs,
        lambda p: (p["line"] != "")
        & (p["line"].rlike(java(V.PRICE_LINE_PATTERN)) | p["key"].contains(V.SOLD_MARKER)),
    )
    return text_or_empty(F.try_element_at(hits, F.lit(-1))["line"])


def dollars(amount: Column) -> Column:
    """``$1,234.50 CAD``."""
    return F.concat(F.lit("$"), F.format_string("%,.2f", amount), F.lit(" CAD"))


def item_number(listing_id: Column) -> Column:
    return F.format_string(V.ITEM_NUMBER_FORMAT, listing_id)


def parse_item_number(column: Column) -> Column:
    digits = first_match(F.upper(F.trim(column)), V.ITEM_NUMBER_PATTERN, 1)
    return digits.try_cast("bigint")


def quote_plus(column: Column) -> Column:
    """Form encoding that leaves ``~`` alone and encodes ``*``."""
    encoded = F.replace(F.url_encode(column), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def _reencode(part: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(part), part)
    return quote_plus(decoded)


def rewrite_query_param(url: Column, name: str, value: Column) -> Column:
    """Replace one query parameter, keeping the others; the new one goes last."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)

    def pair(part: Column) -> Column:
        key = F.substring_index(part, "=", 1)
        rest = F.when(part.contains("="), F.regexp_replace(part, "^[^=]*=", "")).otherwise("")
        return F.concat(_reencode(key), F.lit("="), _reencode(rest))

    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & (F.substring_index(p, "=", 1) != name),
    )
    parts = F.array_append(F.transform(kept, pair), F.concat(F.lit(f"{name}="), quote_plus(value)))
    return F.concat(base, F.lit("?"), F.array_join(parts, "&"), fragment)


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` seen on a page whose address is ``base``."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(
        page == site, F.concat(site, F.lit("/"))
    ).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), without_dot_segments(F.concat(site, link)))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(without_dot_segments(F.concat(folder, link)))
    )


def without_dot_segments(url: Column) -> Column:
    """The address with ``.`` and ``..`` taken out of its path."""
    site = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, part)),
    )
    ends = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(
        path.rlike(r"(^|/)\.{1,2}(/|$)"),
        F.concat(site, F.lit("/"), F.array_join(kept, "/"), ends, rest),
    ).otherwise(url)


def distinct_urls(urls: Column) -> Column:
    """Ordered distinct non-empty entries."""
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))


def primary_image(urls: Column) -> Column:
    return text_or_empty(F.get(urls, F.lit(0)))


def additional_images(urls: Column) -> Column:
    return F.slice(urls, 2, 5)


def described_key(slug: Column, title: Column, description_key: Column, image: Column) -> Column:
    """``slug:title-slug:hash of the normalized description``, by image id without description."""
    image_file = F.regexp_extract(image, r"([^/?#]*)(?:[?#].*)?$", 1)
    image_id = F.coalesce(null_if_empty(F.substring_index(image_file, "~", 1)), image_file)
    tail = F.when(
        description_key != "", F.substring(F.sha1(description_key), 1, 12)
    ).otherwise(slugify(image_id))
    return F.concat_ws(":", slug, slugify(title), tail)


def url_key(url: Column) -> Column:
    return F.lower(F.rtrim(url, F.lit("/")))


def owner_key(token: Column) -> Column:
    return F.sha2(token, 256)
