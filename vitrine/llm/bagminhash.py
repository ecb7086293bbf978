"""Near-duplicate documents by BagMinHash signatures of their weighted word shingles.

A document is the multiset of its shingles of five words. Signatures estimate the weighted Jaccard
similarity (sum of least counts over sum of greatest): each shingle has Poisson processes over its
discretised weight, one for each of the intervals [0, 1), [1, 2), [2, 4), [4, 8) ... that its count
reaches. An interval is halved after its first point, down to units of weight: the point goes on in one
half by chance, and the other half continues on its own; halves that the count does not reach are left
out. The points of intervals that the count covers fall on random positions of the signature, which
keep the smallest. A process ends when its next point lies above all positions. All chance comes from hashes, so equal
shingles have equal processes in every document.

Candidates share one of ``BANDS`` bands of ``ROWS`` positions. Documents of equal multisets are first
folded into their smallest identifier. Within a band's key every document is paired with one only, never
with all: with the document that meets most others over all its bands, as an original does among its
copies. Pairs are verified by the overlap of their multisets, and verified links give classes. Where a
key still holds several classes, its members are compared across the classes block by block: by their
signatures, and where these agree often enough by their multisets. A similar pair shares a band with a
probability above 0.9999 at a similarity of 0.8, and more above.

Defined results: a text of one to four words is one shingle of these; a text without words (null, empty,
signs only) is a class of its own. Null identifiers are in classes of their own, one for each row, with
a null class id. Rows that repeat an identifier count as one document: the multiset whose digest sorts
first makes its candidates, and each of its texts is tried when they are verified. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import textops
from vitrine.llm.components import components
from vitrine.session import broadcast_if_small, materialized

SIMILARITY = 0.8
BANDS = 25
ROWS = 5
POSITIONS = BANDS * ROWS
#: Share of equal positions that a pair of different classes needs to be verified: at a similarity of 0.8
#: one of 20,000 pairs stays below, as many as share no band at all.
AGREEMENT = 0.66
BLOCK_ROWS = 512

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


def _uniform(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> _U(11)).astype(np.float64) + 0.5) * _UNIT


def _chance(seed: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    return textops.mix(seed + _STEP * np.asarray(step, np.uint64))


def _spacing(hashes: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    return -np.log(_uniform(hashes)) / width


class _Points:
    """Signatures under construction, one row of ``POSITIONS`` for each text."""

    def __init__(self, texts: int):
        self.flat = np.full(texts * POSITIONS, np.inf)
        self.rows = self.flat.reshape(texts, POSITIONS)
        self.worst = np.full(texts, np.inf)

    def put(self, owner: np.ndarray, shingle: np.ndarray, at: np.ndarray) -> None:
        """A point falls on a position that follows from the point and its shingle alone."""
        place = textops.mix(at.view(np.uint64) ^ shingle) % _U(POSITIONS)
        np.minimum.at(self.flat, owner * POSITIONS + place.astype(np.int64), at)

    def alive(self, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.worst = self.rows.max(axis=1, initial=0.0)
        return at <= self.worst[owner]


def _roots(shingle: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Intervals [0, 1), [1, 2), [2, 4) ... that the counts reach, with their first points: seed, low,
    high, count, owner, shingle, point, and whether the point was used."""
    parts = []
    low, high = 0, 1
    while True:
        seed = textops.mix(shingle ^ _chance(np.full(1, high, np.uint64), 1))
        parts.append([
            seed, np.full(len(seed), low), np.full(len(seed), high), counts, owner, shingle,
            _spacing(_chance(seed, 1), high - low), np.zeros(len(seed), bool),
        ])
        more = counts > high
        if not more.any():
            return [np.concatenate(column) for column in zip(*parts, strict=True)]
        shingle, counts, owner = shingle[more], counts[more], owner[more]
        low, high = high, 2 * high


def _halved(nodes: list[np.ndarray]) -> list[np.ndarray]:
    """Both halves of each interval, unless the count does not reach them: the point goes on in one,
    the other one's first point follows it."""
    seed, low, high, counts, owner, shingle, at, used = nodes
    middle = (low + high) // 2
    goes_left = (_chance(seed, 2) & _U(1)) == 0
    halves = []
    for side, (a, b) in enumerate(((low, middle), (middle, high))):
        child = _chance(seed, 3 + side)
        here = goes_left == (side == 0)
        point = np.where(here, at, at + _spacing(_chance(child, 1), b - a))
        reached = a < counts
        columns = (child, a, b, counts, owner, shingle, point, used & here)
        halves.append([column[reached] for column in columns])
    return [np.concatenate(pair) for pair in zip(*halves, strict=True)]


def signatures(hashes: np.ndarray, counts: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Signature (``POSITIONS`` floats) of each text, from its distinct shingles and their counts.

    An interval wider than one has one point of its own; then its halves go on, whether the count covers
    it all or in part, so that a point is the same point in every document that reaches it.
    """
    points = _Points(texts)
    nodes = _roots(hashes, counts, owner)
    units: list[np.ndarray] = [np.zeros(0, t) for t in (np.uint64, np.int64, np.uint64, np.float64, np.int64)]
    rounds = 1
    while len(nodes[0]) or len(units[0]):
        seed, low, high, counts, owner, shingle, at, used = nodes
        unit = high - low == 1
        # a unit whose point was used above goes on to its next one
        first = np.where(used, at + _spacing(_chance(seed, 11), 1), at)[unit]
        fresh = [seed[unit], owner[unit], shingle[unit], first, used[unit].astype(np.int64)]
        units = [np.concatenate(pair) for pair in zip(units, fresh, strict=True)]
        nodes = [column[~unit] for column in nodes]
        _, _, high, counts, owner, shingle, at, used = nodes
        whole = (high <= counts) & ~used
        points.put(owner[whole], shingle[whole], at[whole])
        nodes[-1] = used | whole

        seed, owner, shingle, at, step = units
        for _ in range(rounds):
            points.put(owner, shingle, at)
            step = step + 1
            at = at + _spacing(_chance(seed, 10 + step), 1)
        alive = points.alive(owner, at)
        units = [column[alive] for column in (seed, owner, shingle, at, step)]
        alive = points.alive(nodes[4], nodes[6])
        nodes = _halved([column[alive] for column in nodes])
        rounds = min(2 * rounds, 32)
    return points.rows


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts and their texts, sorted by text and shingle."""
    hashes, owner = textops.shingles(data, offsets)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(hashes)))
    return hashes[first], counts, owner[first]


def sketch(docs: DataFrame) -> DataFrame:
    """For documents (id, text): ``bag`` (digest of the multiset, null without words), ``size`` (its
    number of shingles), ``bands`` and ``signature`` (two bytes a position)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, "text", 2 << 20):
            texts = batch.num_rows
            hashes, counts, owner = bags(*textops.text_bytes(batch.column("text")))
            sizes = np.bincount(owner, weights=counts, minlength=texts).astype(np.int64)
            found = signatures(hashes, counts.astype(np.int64), owner, texts)
            bits = textops.mix(found.view(np.uint64).reshape(found.shape) + _U(1))
            edges = np.searchsorted(owner, np.arange(texts + 1))
            digests = [
                None if a == b else
                xxhash.xxh3_128_digest(hashes[a:b].tobytes() + counts[a:b].astype(np.int64).tobytes())
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
            ]
            rows = bits.reshape(texts, BANDS, ROWS)
            keys = np.zeros((texts, BANDS), np.uint64)
            for row in range(ROWS):
                keys = textops.mix(keys + rows[:, :, row])
            keys = textops.mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(texts + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1))
            )
            short = [row.tobytes() for row in (bits >> _U(48)).astype(np.uint16)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digests, pa.binary()), pa.array(sizes), lists,
                 pa.array(short, pa.binary())],
                names=["id", "bag", "size", "bands", "signature"],
            )

    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, bag binary, size long, bands array<long>, signature binary"
    return docs.select("id", "text").mapInArrow(work, schema)


def _overlaps(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts' shingle multisets, pair by pair."""
    pairs = len(one)
    h1, c1, o1 = bags(*textops.text_bytes(one))
    h2, c2, o2 = bags(*textops.text_bytes(two))
    hashes, owner = np.concatenate([h1, h2]), np.concatenate([o1, o2])
    counts = np.concatenate([c1, c2])
    order = np.lexsort((hashes, owner))
    hashes, owner, counts = hashes[order], owner[order], counts[order]
    both = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    shared = np.bincount(owner[both], np.minimum(counts[both], counts[both + 1]), pairs)
    total = np.bincount(owner, counts, pairs)
    return shared / np.maximum(total - shared, 1)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough, with ``similarity``."""
    id_type = texts.schema["id"].dataType.simpleString()
    wanted = materialized(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = texts.join(broadcast_if_small(wanted, max_bytes=8 << 20), "id", "left_semi")
    joined = pairs.join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    ).join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, "text_a", 1 << 20):
            found = _overlaps(batch.column("text_a"), batch.column("text_b"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"]
            ).filter(pa.array(found >= similarity))

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(
        work, f"a {id_type}, b {id_type}, similarity double"
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, id, class, ...) of keys with several classes, dealt into blocks that meet in pairs.

    A key's members go to blocks of about ``BLOCK_ROWS`` rows, and each two blocks (``one``, ``two``; a
    row's own is ``own``) form a group, so no group grows with the size of a key.
    """
    mixed = (
        rows.groupBy("key")
        .agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n"))
        .filter("least != most")
        .select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    )
    members = rows.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return members.withColumn("other", other).select(
        *rows.columns, "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")
    )


def _partners(key: tuple, table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a group with the rows of other classes whose signatures agree often enough.

    A pair that shares several bands is found in the first of them.
    """
    of_class, own = table.column("class").to_numpy(), table.column("own").to_numpy()
    bits = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16)
    bits = bits.reshape(-1, POSITIONS)
    band = table.column("band")[0].as_py()
    right = np.flatnonzero(own == key[2].as_py())
    for i in np.flatnonzero(own == key[1].as_py()).tolist():
        others = right[of_class[right] != of_class[i]]
        equal = bits[others] == bits[i]
        earlier = equal[:, : band * ROWS].reshape(len(others), band, ROWS).all(axis=2).any(axis=1)
        others = others[(equal.sum(axis=1) >= AGREEMENT * POSITIONS) & ~earlier]
        if len(others):
            yield i, others


def _confirmed(key: tuple, table: pa.Table, similarity: float) -> list[tuple[int, int, float]]:
    """Verified links (row, row, similarity) of a group; none between classes that are linked already."""
    of_class = table.column("class").to_pylist()
    linked: dict = {}

    def root(c):
        while c in linked:
            c = linked[c]
        return c

    text = pa.concat_arrays([c.cast(pa.large_string()) for c in table.column("text").chunks])
    hashes, counts, owner = bags(*textops.text_bytes(text))
    sizes = np.bincount(owner, counts, table.num_rows)
    edges = np.searchsorted(owner, np.arange(table.num_rows + 1))
    order = np.argsort(hashes, kind="stable")
    by_hash, by_count, by_owner = hashes[order], counts[order], owner[order]
    found = []
    for i, others in _partners(key, table):
        others = [j for j in others.tolist() if root(of_class[i]) != root(of_class[j])]
        if not others:
            continue
        mine = slice(edges[i], edges[i + 1])
        low, high = (np.searchsorted(by_hash, hashes[mine], side) for side in ("left", "right"))
        length = high - low
        at = np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())
        least = np.minimum(np.repeat(counts[mine], length), by_count[at])
        shared = np.bincount(by_owner[at], least, table.num_rows)
        for j in others:
            same = shared[j] / (sizes[i] + sizes[j] - shared[j])
            one, two = root(of_class[i]), root(of_class[j])
            if same >= similarity and one != two:
                linked[two] = one
                found.append((i, j, same))
    return found


def _across(
    rows: DataFrame, classes: DataFrame, signatures_: DataFrame, texts: DataFrame, similarity: float
) -> DataFrame:
    """Verified links (a, b, similarity) between different classes within a key (key, band, id).

    First the members that have a partner are found by signature; only these are compared again with
    their texts, and only links are given, not the pairs that were tried.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    classed = materialized(
        rows.join(classes, "id", "left").select(
            "key", "band", "id", F.coalesce("class_id", "id").alias("class")
        )
    )

    def with_partner(key: tuple, table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for i, others in _partners(key, table):
            hit[i] = True
            hit[others] = True
        return table.select(["key", "id"]).filter(pa.array(hit))

    def links(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        found = _confirmed(key, table, similarity)
        a, b = ids.take(pa.array([f[0] for f in found], pa.int64())), ids.take(
            pa.array([f[1] for f in found], pa.int64()))
        return pa.table({"x": a, "y": b, "similarity": pa.array([f[2] for f in found], pa.float64())})

    mixed = classed.join(_mixed(classed), "key", "left_semi")
    signed = materialized(mixed.join(signatures_, "id"))
    busy = materialized(
        _blocks(signed).groupBy("key", "one", "two")
        .applyInArrow(lambda key, table: with_partner(key, table), f"key long, id {id_type}").distinct()
    )
    wanted = materialized(busy.select("id").distinct())
    wanted = texts.join(broadcast_if_small(wanted, max_bytes=8 << 20), "id", "left_semi")
    again = signed.join(busy, ["key", "id"], "left_semi").join(wanted, "id")
    pairs = (
        _blocks(again).groupBy("key", "one", "two")
        .applyInArrow(lambda key, table: links(key, table), f"x {id_type}, y {id_type}, similarity double")
    )
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _mixed(classed: DataFrame) -> DataFrame:
    """Keys with several classes."""
    ends = classed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    return ends.filter("least != most").select("key")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``id_col``, ``class_id`` (smallest identifier of the class), ``class_size``, ``n_links`` (links of
    the document's multiset that were tried and verified; not the number of similar documents, as most pairs
    within a class are never tried) and ``kept`` (it is the class id); one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = rows.filter("id is not null")
    sketches = materialized(sketch(texts))
    one = sketches.groupBy("id").agg(F.min("bag").alias("bag")).filter("bag is not null")
    folded = one.groupBy("bag").agg(F.min("id").alias("rep"))
    member = materialized(one.join(folded, "bag").select("id", "rep"))

    reps = sketches.join(folded.select(F.col("rep").alias("id"), "bag"), ["id", "bag"], "left_semi")
    banded = materialized(reps.select("id", F.posexplode("bands").alias("band", "key")).distinct())
    keys = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialized(banded.join(keys, "key"))
    central = met.join(met.groupBy("id").agg(F.sum("n").alias("meets")), "id")
    leaders = central.groupBy("key").agg(F.max(F.struct("meets", "id")).alias("leader"))
    stars = (
        met.join(leaders.select("key", F.col("leader.id").alias("leader")), "key").filter("id != leader")
        .select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
    )
    links = materialized(verified(materialized(stars), texts, similarity))
    classes = components(links.select("a", "b"))
    signed = reps.select("id", "signature").dropDuplicates(["id"])
    more = _across(met.select("key", "band", "id"), classes, signed, texts, similarity)
    links = materialized(links.unionByName(more).dropDuplicates(["a", "b"]))
    classes = components(links.select("a", "b"))

    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(
        F.count("*").alias("n_links")
    )
    of_rep = classes.select(F.col("id").alias("rep"), F.col("class_id").alias("found"))
    classed = materialized(
        member.join(of_rep.join(degree, "rep"), "rep", "left")
        .select("id", F.coalesce("found", "rep").alias("class_id"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    sizes = classed.groupBy("class_id").agg(F.count("*").alias("class_size"))
    found = classed.join(sizes, "class_id")
    return rows.select("id").join(found, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("class_id") == F.col("id"), F.lit(True)).alias("kept"),
    )
