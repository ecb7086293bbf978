"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as words. Seeds are the runs of ``MIN_MATCH`` words that a
document shares with an item. A tile is a maximal common run of words that no other tile covers, on
either side; the longest matches are marked first, until none of ``MIN_MATCH`` words is left. The
longest match is found by running Karp-Rabin hashes of the unmarked words, and words are compared
before they are marked. An item is contained in a document when its tiles cover ``COVERAGE`` of its
words; as tiles may stand in any order, a reordered passage is found too.

The seeds of all items set bits of a bitmap of fixed size (``BITMAP_BITS``, 8 MB whatever the benchmark),
with which one pass over the documents keeps the stretches that may match; wrong bits only cost work.
The stretches are joined to the items by seed, and every tile lies within a stretch, so documents are
not read again. A stretch is compared with those items only that share one of its seeds.

Defined results: an item of fewer than ``MIN_MATCH`` words has no seed and is never found. Null or empty
texts have no words. Rows with a null identifier, on either side, take no part. Rows that repeat an
identifier count as one document (or item) that holds the stretches (or words) of all of them. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import textops
from vitrine.session import broadcast_if_small, materialized

MIN_MATCH = 5
COVERAGE = 0.8
BITMAP_BITS = 26

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _geometric(base: int, count: int) -> np.ndarray:
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Side:
    """Words of one side of a comparison, with marks; ``part`` numbers the stretches."""

    def __init__(self, words: np.ndarray, part: np.ndarray):
        self.words, self.part = words, part
        self.marked = np.zeros(len(words), bool)
        sums = np.cumsum(words * _geometric(_BASE, len(words)), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])
        self.shift = _geometric(_INVERSE, len(words))

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Karp-Rabin hashes of the unmarked runs of ``size`` words, and where they begin."""
        count = len(self.words) - size + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        free = (marks[size:] == marks[:-size]) & (self.part[:count] == self.part[size - 1 :])
        first = np.flatnonzero(free)
        return (self.sums[first + size] - self.sums[first]) * self.shift[first], first


def _longest(one: _Side, two: _Side, bound: int) -> int:
    """Length of the longest common unmarked run of at most ``bound`` words; 0 below ``MIN_MATCH``."""
    low, high = MIN_MATCH - 1, bound
    while low < high:
        size = (low + high + 1) // 2
        if len(np.intersect1d(one.hashes(size)[0], two.hashes(size)[0])):
            low = size
        else:
            high = size - 1
    return low if low >= MIN_MATCH else 0


def tiles(item: np.ndarray, words: np.ndarray, part: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in words, length), in the order in which they are marked."""
    one, two = _Side(item, np.zeros(len(item), np.int64)), _Side(words, part)
    found: list[tuple[int, int, int]] = []
    size = _longest(one, two, len(item))
    while size:
        hashes, first = two.hashes(size)
        places: dict[int, list[int]] = {}
        for value, at in zip(hashes.tolist(), first.tolist(), strict=True):
            places.setdefault(value, []).append(at)
        for value, at in zip(*(column.tolist() for column in one.hashes(size)), strict=True):
            if one.marked[at : at + size].any():
                continue
            for other in places.get(value, ()):
                if two.marked[other : other + size].any():
                    continue
                if (one.words[at : at + size] == two.words[other : other + size]).all():
                    one.marked[at : at + size] = two.marked[other : other + size] = True
                    found.append((at, other, size))
                    break
        size = _longest(one, two, size - 1)
    return found


def _words_table(rows: DataFrame) -> DataFrame:
    """(id, n_words, words, seeds) of each text with a seed."""
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, "text"):
            hashes, owner = textops.words(*textops.text_bytes(batch.column("text")))
            seeds, first = textops.windows(hashes, owner, MIN_MATCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), _lists(hashes, owner, batch.num_rows),
                 _lists(seeds, owner[first], batch.num_rows)],
                names=["id", "words", "seeds"],
            )

    return rows.mapInArrow(work, f"id {id_type}, words array<long>, seeds array<long>")


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.ListArray:
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """One bit for each seed's lowest bits; at most 2 ** (BITMAP_BITS - 6) rows come to the driver."""
    bit = F.col("seed").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = (
        seeds.select(bit.alias("bit"))
        .select(F.shiftright("bit", 6).alias("word"),
                F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("flag"))
        .groupBy("word").agg(F.bit_or("flag").alias("flags")).toPandas()
    )
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["flags"].to_numpy(np.int64)
    return bitmap.view(np.uint64)


def _stretches(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(id, start, words, seeds): maximal runs of a document's seeds whose bits are set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    id_type = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in textops.slices(batches, "text"):
            hashes, owner = textops.words(*textops.text_bytes(batch.column("text")))
            seeds, first = textops.windows(hashes, owner, MIN_MATCH)
            bit = seeds & _U((1 << BITMAP_BITS) - 1)
            known = np.flatnonzero((bits[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1))
            if len(known) == 0:
                continue
            at = first[known]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at))
            text = owner[at[begin]]
            first_word = np.searchsorted(owner, text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(text)),
                 pa.array((at[begin] - first_word).astype(np.int64)),
                 pa.array([hashes[at[b] : at[e - 1] + MIN_MATCH].view(np.int64)
                           for b, e in zip(begin, end, strict=True)], pa.list_(pa.int64())),
                 pa.array([seeds[known[b:e]].view(np.int64)
                           for b, e in zip(begin, end, strict=True)], pa.list_(pa.int64()))],
                names=["id", "start", "words", "seeds"],
            )

    return docs.mapInArrow(
        work, f"id {id_type}, start long, words array<long>, seeds array<long>"
    )


def _tiled(meetings: DataFrame, coverage: float) -> DataFrame:
    """Coverage of the item by the document's stretches (id, item_id, stretches, item), if enough."""
    types = {name: meetings.schema[name].dataType.simpleString() for name in ("id", "item_id")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, count, longest = [], [], []
            for parts, item in zip(batch.column("stretches"), batch.column("item"), strict=True):
                item = item.values.to_numpy().view(np.uint64)
                lists = [part.values.to_numpy() for part in parts.values]
                part = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                found = tiles(item, np.concatenate(lists).view(np.uint64), part)
                covered.append(sum(length for _, _, length in found) / len(item))
                count.append(len(found))
                longest.append(max((length for _, _, length in found), default=0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("item_id"), pa.array(covered, pa.float64()),
                 pa.array(count, pa.int64()), pa.array(longest, pa.int64())],
                names=["id", "item_id", "coverage", "n_tiles", "longest_tile"],
            ).filter(pa.array(np.array(covered) >= coverage))

    return meetings.select("id", "item_id", "stretches", "item").mapInArrow(
        work,
        f"id {types['id']}, item_id {types['item_id']}, coverage double, n_tiles long, longest_tile long",
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document and item that it contains: ``id_col``, ``item_id``, ``coverage`` (share of
    the item's words), ``n_tiles`` and ``longest_tile``."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    items = materialized(_words_table(items.filter("id is not null")).filter("size(seeds) > 0"))
    seeds = items.select(F.col("id").alias("item_id"), F.explode("seeds").alias("seed")).distinct()
    seeds = materialized(seeds)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stretches = materialized(_stretches(rows.filter("id is not null"), _bitmap(seeds)))

    met = (
        stretches.select("id", "start", "words", F.explode(F.array_distinct("seeds")).alias("seed"))
        .join(broadcast_if_small(seeds, max_bytes=4 << 20), "seed")
        .select("id", "item_id", F.struct("start", "words").alias("stretch"))
        .distinct()
        .groupBy("id", "item_id").agg(F.array_sort(F.collect_list("stretch")).alias("stretches"))
        .withColumn("stretches", F.col("stretches.words"))
    )
    texts = items.groupBy(F.col("id").alias("item_id")).agg(
        F.flatten(F.array_sort(F.collect_list("words"))).alias("item")
    )
    texts = broadcast_if_small(materialized(texts), max_bytes=4 << 20)
    return _tiled(met.join(texts, "item_id"), coverage).withColumnRenamed("id", id_col)
