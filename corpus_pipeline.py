"""Training-data pipeline over ``documents``: quality, line de-duplication, near-duplicates,
benchmark decontamination, token ids.

Every stage works on all documents that its predecessor kept; its result is written as Parquet to the
shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import bagminhash, bpe, decontaminate, line_dedup, quality
from vitrine.llm.queries import held_out, tokenizer_path
from vitrine.session import broadcast_if_small, materialized


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose identifier is not among ``ids`` (doc_id); null identifiers stay."""
    ids = broadcast_if_small(materialized(ids.distinct()), max_bytes=8 << 20)
    return docs.join(ids, "doc_id", "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below its threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.filter(~held_out()))
    name = "score"
    while name in {column.lower() for column in docs.columns}:
        name += "_"
    scored = quality.with_score(docs, model, score_col=name)
    return scored.filter(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: equal and nearly equal later lines go, and documents of which nothing is left."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each class the document of the smallest identifier stays."""
    found = bagminhash.near_duplicates(docs)
    return _without(docs, found.filter("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contaminated(docs, benchmark).select("doc_id"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token ids of every document, with the digest of what they decode to."""
    coded = bpe.encode_decode(docs, tokenizer_path(), digest=True)
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256"
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

#: SQL cannot express the classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir))
    return docs
