"""Secrets: spans found by pattern, and candidate strings of high entropy; DataFrame functions only.

Patterns give the spans of assignments, access keys and hexadecimal runs. Their positions come from
the text itself: each match is set between two marks, and the lengths of the parts between marks add
up to positions.

Further candidates are runs of ``CANDIDATE`` characters of keys, ``WINDOW`` or more long, in documents
that have any. A window of ``WINDOW`` characters slides over a candidate; its Shannon entropy follows from the
counts of its characters, which change by one character that leaves and one that comes at each step. A
candidate is a secret when its highest entropy reaches the threshold of its class of characters
(hexadecimal, letters only, letters and digits, with signs) and it isn't suppressed: the allow-list
holds shapes that are no secrets (words, repeated or counting characters, placeholders, identifiers in
the form of UUIDs), and a candidate that overlaps a span found by pattern adds none.

Defined results: null text counts as empty and has no spans. The marks are control characters; a text
that holds them is read as if they were other control characters, which no pattern asks for, so
positions stay right. Null or repeated identifiers need no care, as rows are independent. Further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import let

# Kinds in their order, and the patterns that decide the spans.
KINDS = ("assign", "access", "hex", "entropy")
_NAME = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)
ASSIGN = rf"""(?:{_NAME})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = rf"""^(?:{_NAME})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{12,}}$"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
# Bits of entropy that a window of 20 characters must reach, by class of characters.
THRESHOLDS = {"hexadecimal": 3.0, "letters": 4.1, "alphanumeric": 3.7, "signs": 3.9}
# Shapes of strings that are no secrets.
ALLOWED = (
    r"^[A-Z]?[a-z]+$|^[A-Z]+$",  # words
    r"^[A-Za-z]++(?:[-_/][A-Za-z]++)++$",  # words joined by signs, paths; possessive: no stack is needed
    r"(.)\1{5,}",  # one character again and again
    r"(?i)0123456789|abcdefghij|qwertyuiop",  # counting and keyboard rows
    r"(?i)example|placeholder|changeme|your[-_]?(?:api)?[-_]?key|xxxxxx",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]+$",  # numbers
)

#: Parts of a text that are walked together (even: a run begins outside a match), characters of a block.
RUN = 256
BLOCK = 128

_MARK = "\x01"
_OTHER = "\x02"


def _placed(parts: Column, at: Column) -> Column:
    """Every second one of ``parts`` as struct<s, value>, the first part beginning at ``at``."""
    return F.aggregate(
        parts,
        F.struct(
            at.alias("at"),
            F.lit(False).alias("inside"),
            F.array().cast("array<struct<s:int,value:string>>").alias("found"),
        ),
        lambda state, part: F.struct(
            (state["at"] + F.char_length(part)).alias("at"),
            (~state["inside"]).alias("inside"),
            F.when(
                state["inside"],
                F.array_append(state["found"], F.struct(state["at"].alias("s"), part.alias("value"))),
            ).otherwise(state["found"]).alias("found"),
        ),
        lambda state: state["found"],
    )


def _matches(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in ``text`` as array<struct<s, value>>, leftmost and not overlapping.

    Parts are walked in runs of ``RUN``, of which the starts are summed up first: a list that grows by
    appending is copied at each step, so none gets long.
    """
    plain = F.translate(text, _MARK, _OTHER)
    parts = F.split(F.regexp_replace(plain, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)

    def runs(p: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(p), F.lit(RUN))
        return F.transform(firsts, lambda first: F.slice(p, first, F.lit(RUN)))

    def starts(r: Column) -> Column:
        lengths = F.transform(
            r, lambda run: F.aggregate(run, F.lit(0), lambda total, part: total + F.char_length(part))
        )
        return F.aggregate(
            lengths,
            F.array(F.lit(0)),
            lambda sums, length: F.array_append(sums, F.element_at(sums, -1) + length),
        )

    def walked(r: Column) -> Column:
        return let(starts(r), lambda at: F.flatten(F.transform(r, lambda run, i: _placed(run, F.get(at, i)))))

    none = F.array().cast("array<struct<s:int,value:string>>")
    return F.when(text.rlike(pattern), let(parts, lambda p: let(runs(p), walked))).otherwise(none)


def _spans(matches: Column, kind: int) -> Column:
    """(start, rank of the kind, end) of matches."""
    return F.transform(
        matches,
        lambda m: F.struct(
            m["s"].alias("start"), F.lit(kind).alias("kind"), (m["s"] + F.char_length(m["value"])).alias("end")
        ),
    )


def _count(text: Column, character: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, character, F.lit("")))


def _bits(count: Column) -> Column:
    """c * log2(c), 0 for none."""
    return F.when(count > 0, count * F.log2(F.greatest(count, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def _more_bits(c: int) -> float:
    """(c + 1) * log2(c + 1) - c * log2(c)."""
    return (c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)


def _least_sum(text: Column, width: int) -> Column:
    """The least sum(c * log2(c)) of the windows of ``width`` characters of a short text."""
    first = F.substring(text, F.lit(1), F.lit(width))
    at_first = F.aggregate(
        F.array_distinct(F.split(first, "")),
        F.lit(0.0),
        lambda total, c: F.when(c == "", total).otherwise(total + _bits(_count(first, c))),
    )
    steps = F.when(
        F.char_length(text) > width, F.sequence(F.lit(1), F.char_length(text) - width)
    ).otherwise(F.array().cast("array<int>"))

    # what one more character adds where the window holds c of its kind: one look-up a change
    adds = F.array(*[F.lit(_more_bits(c)) for c in range(width)])

    def slide(state: Column, i: Column) -> Column:
        # characters i + 1 .. i + width - 1 stay, character i leaves and i + width comes
        def moved(stay: Column) -> Column:
            old = _count(stay, F.substring(text, i, F.lit(1)))
            new = _count(stay, F.substring(text, i + width, F.lit(1)))
            return state["total"] - F.get(adds, old) + F.get(adds, new)

        return let(
            let(F.substring(text, i + 1, F.lit(width - 1)), moved),
            lambda total: F.struct(total.alias("total"), F.least(state["least"], total).alias("least")),
        )

    return F.aggregate(
        steps,
        F.struct(at_first.alias("total"), at_first.alias("least")),
        slide,
        lambda state: state["least"],
    )


def highest_entropy(text: Column, width: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the windows of ``width`` characters of ``text``.

    With c characters of a kind in the window, the entropy is log2(width) - sum(c * log2(c)) / width. The
    sum is kept while the window slides: only the counts of the two characters that change enter. A
    position costs as much as the characters before it, so the text is cut into blocks that overlap by
    ``width - 1`` characters: every window lies in one of them.
    """

    def overlapping(blocks: Column) -> Column:
        after = F.transform(blocks, lambda _, i: F.substring(F.get(blocks, i + 1), 1, width - 1))
        return F.zip_with(blocks, after, lambda block, more: F.concat(block, F.coalesce(more, F.lit(""))))

    def least(pieces: Column) -> Column:
        # what is shorter than a window holds none of its own, unless it is the whole text
        holding = F.filter(pieces, lambda piece, i: (i == 0) | (F.char_length(piece) >= width))
        return F.array_min(F.transform(holding, lambda piece: let(piece, lambda p: _least_sum(p, width))))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    total = let(blocks, lambda b: let(overlapping(b), least))
    return F.round(F.log2(F.lit(float(width))) - total / width, 6)


def _threshold(text: Column) -> Column:
    bits = F.lit(THRESHOLDS["signs"])
    for name, pattern in (
        ("alphanumeric", "^[A-Za-z0-9]+$"), ("letters", "^[A-Za-z]+$"), ("hexadecimal", "^[0-9a-fA-F]+$")
    ):
        bits = F.when(text.rlike(pattern), F.lit(THRESHOLDS[name])).otherwise(bits)
    return bits


def _suppressed(text: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | text.rlike(pattern)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``, array<struct<start, kind (place in KINDS), end>> sorted by start and kind;
    one row per row of ``docs``. Positions are code points, the end exclusive."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    assigned = F.filter(_matches(text, ASSIGN), lambda m: m["value"].rlike(ASSIGN_VALUE))
    base = rows.select(
        "id",
        F.concat(
            _spans(assigned, 0), _spans(_matches(text, ACCESS), 1), _spans(_matches(text, HEX), 2)
        ).alias("base"),
        _matches(text, CANDIDATE).alias("candidates"),
    )
    secret = F.filter(
        "candidates",
        lambda m: ~_suppressed(m["value"]) & (highest_entropy(m["value"]) >= _threshold(m["value"])),
    )
    fresh = F.filter(
        _spans(secret, 3),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return base.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", fresh)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    texts = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(texts, ",")
