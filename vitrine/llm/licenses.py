"""Licence scan by canonical digests; DataFrame functions only.

A text is brought into canonical form, paragraph by paragraph (parted by blank lines): lower case, copyright
lines, leading title lines ("MIT License") and list marks left out, everything but letters and digits to single spaces,
equivalent spellings to one; paragraphs with nothing left are dropped. Its digest is looked up among the
digests of the known licence texts, as a whole: there is no partial match. What is looked up is each document
as a whole, each of its paragraphs and each of its lines, and runs of paragraphs: where a paragraph begins
with the first ``OPENING`` words of a known text of several paragraphs, as many words from there as that text
has. So a licence is found as a document of its own, with or without its title, and as a block or line within
one, however its later paragraphs are parted.

Only texts with one of the ``ANCHORS`` are brought into canonical form; every known text contains one, in
each spelling. The known texts are a fixed table of some hundred rows (or the caller's, joined by size).

Defined results: null or empty texts match nothing. Null or repeated identifiers need no care, as rows
are independent. A licence found in several ways is listed once, and counted once for the
place where it begins. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.licence_texts import DIGESTS, known_texts
from vitrine.session import broadcast_if_small

# Forms that count as one, words that every known text has one of, and copyright lines.
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bcontributor s\b", "contributors"),
    (r"\bhttp www\b", "https www"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bper cent\b", "percent"),
    (r"\bv ?([0-9])", "version $1"),
    (r"\borganisation", "organization"),
    (r"\bfavour", "favor"),
)
ANCHORS = ("licen", "permission", "redistribution", "under ")
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©)|©|\(c\)(?![ \t]+(?:you must|under|for|the licenses)\b)"
    r"|copyright[ \t]+(?:[0-9]|by\b)|all rights reserved)"
    r"[^\n]*$"
)


#: Titles that stand over texts that are known without one.
TITLE = (
    r"(?:the[ \t]+)?(?:(?:new|modified|revised|simplified)[ \t]+)?"
    r"(?:mit|isc|expat|x11|(?:bsd[ \t-]+)?[23][ -]clause(?:[ \t-]+bsd)?|bsd)"
    r"(?:[ \t]+[\"“](?:new|modified|revised|simplified)(?:[ \t]+or[ \t]+[\"“]?[a-z]+)?[\"”])?"
    r"[ \t]+licen[sc]e(?:[ \t]+\((?:mit|isc|expat|x11|bsd[ a-z0-9-]*)\))?"
    r"|licen[sc]e|software licen[sc]e agreement[ \t]+\(bsd licen[sc]e\)"
)
TITLE_LINES = rf"\A(?:[^\p{{L}}\p{{N}}]*(?:{TITLE})[^\p{{L}}\p{{N}}\n]*(?:\n|\z))+"
#: Numbers and letters of list items: at the start of a paragraph and after a line that ends a clause.
LIST_MARK = (
    r"(\A|[.:;][ \t\r]*\n|\n[^\p{L}\p{N}\n]*\n|\b(?:and|or)[ \t\r]*\n)[^\p{L}\p{N}\n(]*"
    r"(?:[0-9]{1,2}(?:\.[0-9]{1,2})*[.)]|\([a-z0-9]{1,2}\)|[a-z]\))[ \t]+"
)
BLANK_LINES = r"\n[ \t\r]*\n"
OPENING = 8


def canonical(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    plain = F.regexp_replace(plain, TITLE_LINES, " ")
    plain = F.regexp_replace(plain, LIST_MARK, "$1 ")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    for pattern, form in SPELLINGS:
        plain = F.regexp_replace(plain, pattern, form)
    return plain


def canonical_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, BLANK_LINES, -1), canonical), lambda p: p != "")


def _anchored(text: Column) -> Column:
    lower, found = F.lower(text), F.lit(False)
    for word in ANCHORS:
        found = found | F.contains(lower, F.lit(word))
    return found


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, licence, opening, n_words) of ``texts`` (licence, text), by default of the known ones; the
    last two are null for a text of one paragraph."""
    fixed = texts is None
    if texts is None:
        texts = spark.createDataFrame(known_texts(), "licence string, text string")
    coded = texts.select("licence", canonical_paragraphs(F.col("text")).alias("paras"))
    whole, several = F.array_join("paras", " "), F.size("paras") > 1
    digests = coded.filter(F.size("paras") > 0).select(
        F.sha2(whole, 256).alias("digest"),
        "licence",
        F.when(several, F.substring_index(F.col("paras")[0], " ", OPENING)).alias("opening"),
        F.when(several, F.size(F.split(whole, " "))).alias("n_words"),
    )
    if fixed:
        digests = digests.union(
            spark.createDataFrame(DIGESTS, "licence string, digest string, opening string, n_words int")
            .select(*digests.columns)
        )
    return digests.distinct()


def scan_licences(
    docs: DataFrame,
    texts: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``licences`` (sorted, distinct), ``n_matches`` and ``whole`` (licences of which the
    document is the text); one row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text", text)
    known = known_digests(docs.sparkSession, texts)
    lengths = known.filter("opening IS NOT NULL").groupBy("opening").agg(F.collect_set("n_words").alias("n"))
    openings = lengths.agg(F.map_from_entries(F.collect_list(F.struct("opening", "n"))).alias("openings"))
    rows = rows.select(
        "id", "text", F.monotonically_increasing_id().alias("row"),
        F.when(_anchored(F.col("text")), canonical_paragraphs(F.col("text"))).alias("paras"),
    ).crossJoin(F.broadcast(openings))  # one row

    paragraphs = F.split("text", BLANK_LINES, -1)
    lines = F.split("text", "\n", -1)
    inner = F.filter(
        F.concat(F.filter(paragraphs, lambda p: p.contains("\n")), lines), lambda p: p != F.col("text")
    )
    wanted = F.filter(inner, _anchored)

    def unit(whole, at, plain: Column) -> Column:
        return F.struct(F.lit(whole).alias("all"), at.alias("at"), F.sha2(plain, 256).alias("digest"))

    whole = unit(True, F.lit(-1), F.array_join("paras", " "))
    begins = F.filter(
        F.transform("paras", lambda p, i: F.struct(
            i.alias("i"), F.try_element_at("openings", F.substring_index(p, " ", OPENING)).alias("n"))),
        lambda b: b["n"].isNotNull(),
    )

    def run(i: Column, n: Column) -> Column:
        words = F.array_join(F.slice("paras", i + 1, n), " ")  # a paragraph has a word at least
        return unit(False, -1 - i, F.call_function("substring_index", words, F.lit(" "), n))

    runs = F.flatten(F.transform(begins, lambda b: F.transform(b["n"], lambda n: run(b["i"], n))))
    coded = F.concat(
        F.array(whole),
        F.transform(wanted, lambda u, i: unit(False, i, canonical(u))),
        F.filter(runs, lambda r: r["digest"] != whole["digest"]),
    )
    digests = rows.select("id", "row", F.when(F.col("paras").isNotNull(), coded).alias("coded"))
    licences = broadcast_if_small(known.select("digest", "licence").distinct(), max_bytes=4 << 20)
    hits = digests.select("id", "row", F.explode_outer("coded").alias("c")).select(
        "id", "row", "c.all", "c.at", "c.digest"
    ).join(licences, "digest", "left")
    place = F.when(F.col("licence").isNotNull(), F.struct("at", "licence"))
    found = hits.groupBy("id", "row").agg(
        F.array_sort(F.collect_set("licence")).alias("licences"),
        F.size(F.collect_set(place)).cast("long").alias("n_matches"),
        F.array_sort(F.collect_set(F.when(F.col("all"), F.col("licence")))).alias("whole"),
    )
    return found.select(F.col("id").alias(id_col), "licences", "n_matches", "whole")
