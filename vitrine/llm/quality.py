"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal updates.

Tokens are runs of letters, of digits and of other characters between white space. Features are hashed
n-grams of the tokens themselves (1 and 2) and of their shapes (1 to 3; a shape says how a token is
cased, that it repeats the token before, or which signs it consists of). A feature's value is its share
of the n-grams of its kind, times ``SCALE``; the score of a text is the logistic function of a sparse
dot product. Neither identifier, language nor source takes part.

Training rows: the ``TRAIN_ROWS`` labelled rows of smallest hashed identifier, a documented bound. They
are dealt over ``SHARDS`` groups of bounded size; each group runs ``EPOCHS`` passes of updates, and the
groups' weights are averaged in Spark. The model has ``DIMENSIONS`` weights (1 MB), whatever the
input, so it may go through the driver and to all tasks. Scoring is one pass without a shuffle.

Defined results: a null or empty text, or one of white space only, has the single feature "empty";
rows without a label, with a label other than 0 and 1, or with a null identifier are not trained on;
an identifier labelled twice trains with each label. Without labelled rows all scores are 0.5.
Repeated rows are scored one by one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import textops
from vitrine.session import materialized

DIMENSIONS = 1 << 18
SCALE = 12.0
TRAIN_ROWS = 16_384
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 0.05, 0.02, 0.02
THRESHOLD = 0.7

_U = np.uint64
_LETTERS, _DIGITS, _SIGNS = 1, 2, 3
_KINDS = 6
_LOWER, _CAPITAL, _UPPER, _MIXED, _NUMBER, _AGAIN = range(1, 7)


def _byte_kinds() -> np.ndarray:
    table = np.full(256, _SIGNS, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[ord("0") : ord("9") + 1] = _DIGITS
    table[ord("A") : ord("Z") + 1] = _LETTERS
    table[ord("a") : ord("z") + 1] = _LETTERS
    table[128:] = _LETTERS
    return table


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, feature and value of each n-gram occurrence."""
    texts = len(offsets) - 1
    kinds = _byte_kinds()[data]
    starts, ends, owner = textops.runs(kinds, offsets)
    empty = np.flatnonzero(np.bincount(owner, minlength=texts) == 0)
    tokens = textops.run_hashes(data, starts, ends, folded=False)
    kind = kinds[starts] if len(starts) else np.zeros(0, np.uint8)
    upper = _sums((data >= ord("A")) & (data <= ord("Z")), starts, ends)
    lower = _sums((data >= ord("a")) & (data <= ord("z")), starts, ends)
    shape = np.where(
        kind == _SIGNS,
        tokens,
        np.select(
            [kind == _DIGITS, upper == 0, (upper == 1) & (lower > 0), lower == 0],
            [_NUMBER, _LOWER, _CAPITAL, _UPPER],
            _MIXED,
        ).astype(np.uint64),
    )
    again = np.zeros(len(tokens), bool)
    for back in (1, 2):  # the same word again, with or without signs between
        same = (tokens[back:] == tokens[:-back]) & (owner[back:] == owner[:-back])
        again[back:] |= same & (kind[back:] != _SIGNS)
    shape[again] = _AGAIN
    found = []
    for number, (stream, size) in enumerate(((tokens, 1), (tokens, 2), (shape, 1), (shape, 2), (shape, 3))):
        hashes, first = textops.windows(stream, owner, size)
        text = owner[first]
        share = SCALE / np.maximum(np.bincount(text, minlength=texts), 1)
        slot = (textops.mix(hashes + _U(number)) % _U(DIMENSIONS)).astype(np.int64)
        found.append((text, slot, share[text]))
    found.append((empty, np.full(len(empty), _KINDS, np.int64), np.full(len(empty), SCALE)))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias after ``EPOCHS`` passes of FTRL-proximal updates in the given order."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(slots: np.ndarray) -> np.ndarray:
        pull = z[slots]
        rate = (BETA + np.sqrt(n[slots])) / ALPHA + L2
        return np.where(np.abs(pull) <= L1, 0.0, (np.sign(pull) * L1 - pull) / rate)

    for _ in range(EPOCHS):
        for slots, values, label in rows:
            w = weights(slots)
            wrong = _logistic(float(w @ values)) - label
            gradient = wrong * values
            square = gradient * gradient
            sigma = (np.sqrt(n[slots] + square) - np.sqrt(n[slots])) / ALPHA
            z[slots] += gradient - sigma * w
            n[slots] += square
    final = weights(np.arange(DIMENSIONS + 1))
    return final[:-1], float(final[-1])


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def train_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """Non-zero weights of one group of labelled texts; the bias has slot ``DIMENSIONS``."""
    shard = shard.sort_values(["place", "text", "label"], kind="stable")
    rows = []
    for text, label in zip(shard["text"], shard["label"], strict=True):
        data, offsets = textops.text_bytes(pa.array([text or ""], pa.string()))
        _, slots, values = features(data, offsets)
        slots, at = np.unique(slots, return_inverse=True)
        values = np.bincount(at, weights=values, minlength=len(slots))
        rows.append((np.append(slots, DIMENSIONS), np.append(values, 1.0), float(label)))
    weights, bias = _ftrl(rows)
    slots = np.flatnonzero(weights)
    return pd.DataFrame({"slot": np.append(slots, DIMENSIONS), "weight": np.append(weights[slots], bias)})


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = TRAIN_ROWS,
) -> np.ndarray:
    """The model: ``DIMENSIONS`` weights and the bias. ``labels`` holds the rows to learn from."""
    place = F.xxhash64("id")
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter("id is not null and label in (0, 1)")
        .withColumn("place", place)
        .orderBy("place", "label")
        .limit(rows)
    )
    chosen = F.broadcast(materialized(chosen))  # at most ``rows`` short rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    examples = texts.join(chosen, "id").withColumn("shard", F.pmod("place", F.lit(SHARDS)))
    trained = (
        examples.groupBy("shard")
        .applyInPandas(lambda shard: train_shard(shard), "slot long, weight double")
        .groupBy("slot").agg((F.sum("weight") / SHARDS).alias("weight"))
        .toPandas()
    )
    model = np.zeros(DIMENSIONS + 1)
    model[trained["slot"].to_numpy(np.int64)] = trained["weight"].to_numpy()
    return model


def with_score(
    docs: DataFrame, model: np.ndarray, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """All columns of ``docs`` and ``score_col`` (0 to 1, higher for better texts), row by row; a column
    that has this name already is replaced."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != score_col.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in textops.slices(batches, text_col, 2 << 20):
            owner, slots, values = features(*textops.text_bytes(batch.column(text_col)))
            totals = np.bincount(owner, weights=weights[slots] * values, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_logistic(totals + weights[-1]))],
                names=[*batch.schema.names, score_col],
            )

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score``, one row per row of ``docs``."""
    return with_score(docs.select(id_col, text_col), model, text_col).select(id_col, "score")
