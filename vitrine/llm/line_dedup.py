"""Line de-duplication by a deletion-neighbourhood join, in DataFrame functions only.

A line (text between line feeds) is dropped when an earlier line, by (document, position), is equal to
it or, for lines of ``NEAR_CHARS`` characters and more, differs by one insertion, deletion or
substitution of a character. Blank lines (spaces and tabs only) stay. "Earlier" compares the first
occurrences of the two texts; the rule is direct, so a line near to a dropped line is dropped as well.

Two texts within one edit have equal deletion variants: both without the substituted character, or the
longer without the additional one. Variants are made only where they can meet: one edit leaves the
first or the second half of the shorter text untouched, so texts are first counted by their halves
(four hashed keys a line), and a text whose keys are its own emits nothing. The others emit, as one
hashed key each, all variants of the half that is not shared. The key of a substitution includes its
position, hence all members of such a key are within one edit of each other and are joined to the
earliest only; an insertion joins the shorter text to the longer ones and back. Groups therefore never
expand into pairs. Every joined pair is verified by its edit distance.

Defined results: a null or empty text has no lines; null identifiers come after all others, and rows
that repeat an identifier are told apart by their text, and rows equal in both lose the same lines. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import let
from vitrine.session import broadcast_if_small, materialized

NEAR_CHARS = 20
BLOCK_CHARS = 64

_LINE = ("line_a", "line_b")
_DOC = ("id", "row_key")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn(
        "row_key", F.xxhash64("text")
    )


def _lines(documents: DataFrame) -> DataFrame:
    """One row per line that is not blank, with its two hashes."""
    spread = documents.filter("text != ''").select(
        *_DOC, F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    )
    return spread.filter(F.col("line").rlike(r"[^ \t]")).select(
        *_DOC, "at", "line",
        F.xxhash64("line").alias("line_a"),
        F.xxhash64(F.lit(7), "line").alias("line_b"),
    )


def _place() -> Column:
    """Sorts occurrences: null identifiers last, then by document and position."""
    return F.struct(F.col("id").isNull().alias("unknown"), "id", "row_key", "at")


def _half_key(side: str, base: Column, line: Column) -> Column:
    """Hash of the half that an edit in the other half leaves alone, for a shorter length ``base``."""
    head = F.floor(base / 2).cast("int")
    part = F.substring(line, F.lit(1), head) if side == "head" else F.right(line, base - head)
    return F.xxhash64(F.lit(side), base, part)


def _half_keys(lines: DataFrame) -> DataFrame:
    """Keys of each near-eligible line: both halves, as the shorter text and as the longer one."""
    length = F.char_length("line")
    roles = [
        F.struct(
            _half_key(side, length - longer, F.col("line")).alias("half"),
            F.lit(side).alias("side"),
            F.lit(longer).alias("longer"),
        )
        for side in ("head", "tail")
        for longer in (0, 1)
    ]
    return lines.filter(length >= NEAR_CHARS).select(*_LINE, F.explode(F.array(*roles)).alias("k")).select(
        *_LINE, "k.*"
    )


def _chain(parts: Column) -> Column:
    """Hashes of the first 0, 1, 2 ... parts."""
    return F.aggregate(
        parts,
        F.array(F.lit(0).cast("long")),
        lambda hashes, part: F.array_append(hashes, F.xxhash64(F.element_at(hashes, -1), part)),
    )


def _pieces(text: Column) -> Column:
    """The text cut into blocks of ``BLOCK_CHARS`` characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def one_edit(left: Column, right: Column) -> Column:
    """Whether two texts are one insertion, deletion or substitution apart.

    Behind the first character that differs the rests are equal then, the longer text's one place later.
    Work and memory are in proportion to the texts, whereas a distance matrix walks them again and again.
    """
    ordered = F.when(
        F.char_length(left) >= F.char_length(right), F.struct(left.alias("long"), right.alias("short"))
    ).otherwise(F.struct(right.alias("long"), left.alias("short")))

    def apart(texts: Column) -> Column:
        blocks = F.zip_with(
            _pieces(texts["long"]), _pieces(texts["short"]),
            lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit("")).alias("b")),
        )
        numbered = F.transform(blocks, lambda b, k: F.struct(k.alias("k"), b["a"].alias("a"), b["b"].alias("b")))
        first = F.get(F.filter(numbered, lambda b: b["a"] != b["b"]), F.lit(0))
        gap = F.char_length(texts["long"]) - F.char_length(texts["short"])

        def shared(block: Column) -> Column:
            places = F.sequence(F.lit(1), F.lit(BLOCK_CHARS))
            same = F.filter(
                places,
                lambda i: (i <= F.char_length(block["b"]))
                & (F.substring(block["a"], F.lit(1), i) == F.substring(block["b"], F.lit(1), i)),
            )
            return block["k"] * BLOCK_CHARS + F.size(same)

        def rest_equal(at: Column) -> Column:
            end = F.char_length(texts["long"])
            return (gap <= 1) & (
                F.substring(texts["long"], at + 2, end) == F.substring(texts["short"], at + 2 - gap, end)
            )

        return F.when(F.size(blocks) > 0, let(first, lambda block: let(shared(block), rest_equal)))

    return F.coalesce(let(ordered, apart), F.lit(False))


def _blocks(rest: Column, longer: Column, half: Column) -> Column:
    """The half that is not shared as blocks of ``BLOCK_CHARS`` places of the shorter text: of each the
    hash of all else (``context``) and its characters (``middle``), one more in the longer text.

    A place in a text costs as much as the characters before it, so the text is cut into its blocks
    once. ``let`` binds what is used for every block, so that it is computed once for the line.
    """

    def measured(text: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil((F.char_length(text) - longer) / BLOCK_CHARS).cast("int"))
        behind = F.when(longer == 0, text).otherwise(F.substring(text, 2, 2**31 - 1))
        return F.struct(count.alias("count"), _pieces(text).alias("here"), _pieces(behind).alias("behind"))

    def hashed(m: Column) -> Column:
        return F.struct(
            _chain(F.slice(m["here"], F.lit(1), m["count"])).alias("before"),
            _chain(F.reverse(m["behind"])).alias("after"),
            m.alias("m"),
        )

    def cut(h: Column) -> Column:
        m = h["m"]

        def one_more(k: Column) -> Column:
            following = F.coalesce(F.substring(F.get(m["here"], k + 1), 1, 1), F.lit(""))
            return F.when(longer == 0, F.lit("")).otherwise(following)

        return F.transform(
            F.sequence(F.lit(0), m["count"] - 1),
            lambda k: F.struct(
                F.xxhash64(
                    half, k, F.get(h["before"], k), F.get(h["after"], m["count"] - 1 - k)
                ).alias("context"),
                F.concat(F.coalesce(F.get(m["here"], k), F.lit("")), one_more(k)).alias("middle"),
            ),
        )

    return let(rest, lambda text: let(measured(text), lambda m: let(hashed(m), cut)))


def _variants(alive: DataFrame) -> DataFrame:
    """Hashed deletion variants of the half that is not shared, with the role of the line in the key.

    Role 0 shares a key with texts of its own length (same position left out), 1 is the shorter and 2
    the longer text of an insertion. What a variant leaves as it is enters by the hash of its blocks, so
    that the work for a line does not grow with the square of its length.
    """
    line, length = F.col("line"), F.char_length("line")
    base = length - F.col("longer")
    head = F.floor(base / 2).cast("int")
    rest = F.when(
        F.col("side") == "head", F.substring(line, head + 1, length - head)
    ).otherwise(F.substring(line, F.lit(1), length - (base - head)))
    rows = alive.select(*_LINE, "half", "longer", rest.alias("rest"))
    blocks = rows.select(
        *_LINE, "longer", F.explode(_blocks(F.col("rest"), F.col("longer"), F.col("half"))).alias("b")
    ).select(*_LINE, "longer", "b.context", "b.middle")
    places = F.sequence(F.lit(1), F.char_length("middle"))
    if_shorter = F.array(F.lit(0)).cast("array<int>")  # 0: nothing is left out
    spread = blocks.withColumn(
        "i", F.explode(F.when(F.col("longer") == 0, F.concat(if_shorter, places)).otherwise(places))
    )
    left = F.when(F.col("i") == 0, F.col("middle")).otherwise(
        F.concat(
            F.substring("middle", F.lit(1), F.col("i") - 1),
            F.substring("middle", F.col("i") + 1, F.char_length("middle")),
        )
    )
    return spread.select(
        *_LINE,
        F.when((F.col("longer") == 1) | (F.col("i") == 0), F.xxhash64("context", left))
        .otherwise(F.xxhash64("context", "i", left))
        .alias("variant"),
        F.when(F.col("longer") == 1, 2).when(F.col("i") == 0, 1).otherwise(0).alias("role"),
    )


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one text has."""
    ends = rows.groupBy(key).agg(F.min("line_a").alias("least"), F.max("line_a").alias("most"))
    return broadcast_if_known_small(materialized(ends.filter("least != most").select(key)))


def near_lines(lines: DataFrame, first: DataFrame) -> DataFrame:
    """Texts that lie within one edit of an earlier text: ``line_a``, ``line_b``, ``earlier`` (place).

    ``first`` has the place of each text's first occurrence.
    """
    keys = _half_keys(lines)
    roles = materialized(keys.join(_shared(keys, "half"), "half").distinct())
    wanted = broadcast_if_known_small(materialized(roles.select(*_LINE).distinct()))
    texts = materialized(
        lines.join(wanted, [*_LINE], "left_semi").select(*_LINE, "line").distinct()
    )
    variants = _variants(roles.join(texts, [*_LINE]))
    members = materialized(
        variants.join(_shared(variants, "variant"), "variant").distinct().join(first, [*_LINE])
    )
    member = F.struct("place", *_LINE)
    groups = members.groupBy("variant").agg(
        F.min(F.when(F.col("role") < 2, member)).alias("short"),
        F.min(F.when(F.col("role") == 2, member)).alias("long"),
    )
    partner = F.when(F.col("role") == 1, F.col("long")).otherwise(F.col("short"))
    pairs = (
        members.join(groups, "variant").select(*_LINE, "place", partner.alias("partner"))
        .filter("partner is not null and partner.place < place")
        .select(*_LINE, F.col("partner.line_a").alias("other_a"), F.col("partner.line_b").alias("other_b"),
                F.col("partner.place").alias("earlier"))
        .distinct()
    )
    other = texts.select(
        F.col("line_a").alias("other_a"), F.col("line_b").alias("other_b"), F.col("line").alias("other")
    )
    return (
        pairs.join(texts, [*_LINE]).join(other, ["other_a", "other_b"])
        .filter(one_edit(F.col("line"), F.col("other")))
        .groupBy(*_LINE).agg(F.min("earlier").alias("earlier"))
    )


def broadcast_if_known_small(table: DataFrame) -> DataFrame:
    """A written table of hashes: broadcast when its files are small, else left to the shuffle join."""
    return broadcast_if_small(table, max_bytes=4 << 20)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dropped lines: id, row_key, at (position from 0), ``near`` (else an exact copy)."""
    lines = _lines(_documents(docs, id_col, text_col))
    first = materialized(lines.groupBy(*_LINE).agg(F.min(_place()).alias("place")))
    near = materialized(near_lines(lines, first))
    verdict = first.join(near.select(*_LINE, F.lit(True).alias("near")), [*_LINE], "left")
    places = lines.select(*_LINE, _place().alias("here"))
    return (
        places.join(verdict, [*_LINE])
        .filter("near or here != place")
        .select("here.id", "here.row_key", "here.at", F.coalesce("near", F.lit(False)).alias("near"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_lines``, ``n_exact``, ``n_near`` (dropped), ``kept_text`` and ``row`` (all columns
    of the document); one row per row of ``docs``."""
    whole = docs.select(F.col(id_col).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    documents = whole.withColumn("text", F.coalesce(F.col("row")[text_col], F.lit(""))).withColumn(
        "row_key", F.xxhash64("text")
    )
    gone = materialized(
        dropped_lines(docs, id_col, text_col).distinct().groupBy(*_DOC).agg(
            F.collect_list("at").alias("gone"), F.count_if("near").alias("n_near"))
    )
    split = F.split("text", "\n", -1)

    def without_gone(parts: Column) -> Column:
        everything = F.sequence(F.lit(0), F.size(parts) - 1)
        return F.transform(F.array_except(everything, "gone"), lambda i: F.get(parts, i))

    kept = let(split, without_gone)
    joined = documents.join(
        broadcast_if_known_small(gone),
        documents["id"].eqNullSafe(gone["id"]) & (documents["row_key"] == gone["row_key"]),
        "left",
    ).select(documents["id"].alias(id_col), "row", "text", "gone", "n_near")
    none = F.lit(0).cast("long")
    return joined.select(
        id_col,
        F.when(F.col("text") == "", none).otherwise(F.size(split).cast("long")).alias("n_lines"),
        F.coalesce(F.size("gone") - F.col("n_near"), none).alias("n_exact"),
        F.coalesce("n_near", none).alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        "row",
    )


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars"
) -> DataFrame:
    """The documents with their kept lines as text, and its length in ``length_col`` if they have that.

    A document that loses its last line that isn't blank goes; one without such lines stays as it is.
    """
    found = dedup_lines(docs, id_col, text_col)
    touched = F.col("n_exact") + F.col("n_near") > 0
    text = F.when(touched, F.col("kept_text")).otherwise(F.col("row")[text_col])
    length = F.when(touched, F.char_length("kept_text")).otherwise(F.col(f"row.`{length_col}`")) \
        if length_col in docs.columns else None
    new = {text_col: text, length_col: length}
    columns = [
        (new[name] if name in new else F.col(f"row.`{name}`")).cast(docs.schema[name].dataType).alias(name)
        for name in docs.columns
    ]
    return found.filter(~touched | F.col("kept_text").rlike(r"[^ \t\n]")).select(*columns)
