"""Small tables with every odd case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHES = ("id", "row", "row_key", "at", "line", "key", "run", "n", "digest", "rep", "size", "score",
           "start", "windows", "spans", "words", "term", "entity", "kept", "token_ids", "text_a", "total")


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows as a table with additional columns whose names the operators use inside."""
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return table.select("*", *[F.lit(f"x {name}").alias(name) for name in CLASHES])


def sample(spark: SparkSession, folder: str, count: int = 60) -> list[tuple]:
    """The first documents of a test table, for comparisons of all with all."""
    table = spark.read.parquet(f"{folder}/documents.parquet")
    return [(r.doc_id, r.text) for r in table.filter(f"doc_id < {count}").select("doc_id", "text").collect()]


PROSE = (
    "The harbour master counted seven boats before the fog came in, and none of them carried a light that "
    "could be seen from the pier. He wrote their names in the long book, closed the shutters and waited "
    "for the bell to ring twice, as it always did when the tide had turned and the water ran out again."
)

ODD = [
    (1, PROSE),
    (2, None),
    (3, ""),
    (4, " \t\n \n"),
    (5, PROSE),
    (5, PROSE),
    (6, "short"),
    (7, "word " * 4000),
    (8, "x" * 70_000),
    (9, "né à Zürich — 日本語 🙂\x01\x02 end"),
    (None, PROSE),
    (None, "a text of its own that no other row has, of no identifier either"),
]
