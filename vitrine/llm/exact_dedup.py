"""Exact de-duplication by a tree merge of digest runs.

Every document gets the digest of its text with runs of white space replaced by one space. Documents
are dealt over ``RUNS`` runs; a run holds each of its digests once, with the smallest identifier and
the number of documents. Rounds then merge ``FAN_IN`` runs into one: runs exchange rows by (digest,
merged run), and the merge keeps the smallest identifier of rows that agree in the digest and in the
text's length and second hash. After the last round one run is left, whose identifiers stay. The
result goes back down the same tree, so that a digest that a third of all documents share meets at
most ``FAN_IN`` rows a level, and its documents stay spread over all runs.

Defined results: null text counts as empty. A null identifier never stays while a copy with one does;
if all are null, ``keep_id`` is null and the rows stay. Repeated rows of one identifier share its
fate, and each counts in ``group_size``. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import materialized

RUNS = 256
FAN_IN = 16

# Fixed value: the white space that counts as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"

_SAME_TEXT = ("digest", "n_bytes", "second")


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """One row per document: identifier, what its text must agree in with a copy's, and its run."""
    text = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("text"))
    return text.select(
        "id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("second"),
        F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """Rows of the same text and run as one, with the smallest identifier."""
    return rows.groupBy(*_SAME_TEXT, "run").agg(F.min("id").alias("id"), F.sum("n").alias("n"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    runs: int = RUNS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``; one row per row of ``docs``."""
    rows = materialized(digests(docs, id_col, text_col, runs))
    levels = [materialized(merged(rows.withColumn("n", F.lit(1).cast("long"))))]
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        above = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        levels.append(materialized(merged(above)) if left > 1 else merged(above))

    found = levels[-1].select(
        *_SAME_TEXT, "run", F.col("id").alias("keep_id"), F.col("n").alias("group_size")
    )
    for level in reversed(levels[:-1]):
        below = level.select(
            *_SAME_TEXT, "run", F.floor(F.col("run") / fan_in).cast("int").alias("above")
        )
        found = below.join(found.withColumnRenamed("run", "above"), [*_SAME_TEXT, "above"]).drop("above")
    return rows.join(found, [*_SAME_TEXT, "run"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
