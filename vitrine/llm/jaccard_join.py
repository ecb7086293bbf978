"""Exact join of documents whose sets of word shingles have a Jaccard similarity of a threshold or more.

Signature trees: a leaf is a set with a bitmap of its hashed shingles, a node above holds the bitmaps of its
children combined by OR, the range of their sizes, and the most shingles that share a bit within a set. Two
trees (or a tree and itself) are walked together: a pair of nodes is given up where the bits that both have,
with the shared ones, cannot hold the overlap that the smallest sizes need, where the sizes are too far apart, or
where all their sets belong to one component already. Pairs of sets that are left are compared exactly.

Which sets meet in a tree: similar sets share one of the first n - ceil(t * n) + 1 shingles of each, in any order
of shingles that is the same for all. The order is by hash with heavy shingles (passages that many documents
hold) last, so that these bring sets together only where little else could. Sets of the same shingle are a block.

1. Equal sets are folded into one; a task already passes on each of its sets once.
2. In some rounds each set that stands in an open block, one of more than one component, goes to one of its open
   blocks, picked by a hash of the round. Large blocks are dealt into cells at random. The trees of the cells give
   a forest of candidates, these are verified with their shingles, and components of all links found decide what
   is open in the next round.
3. What is still open is searched whole: of a block, the sets of its largest component are dealt into cells and
   the others go to every cell, so that all pairs of different components meet; all candidates are verified.

So no link between sets of different components is lost, and the largest group costs rows in proportion to its
size as long as its members are linked. No task holds more than a cell; a block with many unlinked members costs
a row for each member and cell. Broadcast are the heavy shingles (a bounded number, the heaviest) and identifiers
within a checked size. Shingles and sets are told apart by 64-bit hashes.

Defined results: words are what stands between ASCII white space, ASCII capitals folded; a text of fewer words
than a shingle is one shingle; null texts and texts without words have an empty set, no links, and their own
identifier as component. Rows with equal texts are linked. A component's identifier is the smallest of its rows',
null identifiers aside; rows with equal identifiers stay rows. An empty table gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm import components, textops
from vitrine.session import broadcast_if_small, materialized

SHINGLE_WORDS = textops.SHINGLE_WORDS
THRESHOLD = Fraction(4, 5)
ROUNDS = 4
WORTH_A_ROUND = 50  # another round while the last one linked one in so many open sets
CELL_SETS = 512
FANOUT = 8
SIGNATURE_BITS = 2048
COUNTED_SHINGLES = 2_000_000
SLICE_BYTES = 1 << 20
SEEN_IN_TASK, HEAVY, HEAVY_MOST = 3, 48, 1_000_000
SMALL_BYTES = 16 << 20


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, rising within a text, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    values = pc.list_flatten(lists)
    coded = values.dictionary_encode()
    raw, offsets = textops.text_bytes(coded.dictionary)
    # white space at the ends of a text gives empty words
    full = np.diff(offsets) > 0
    hashes = np.zeros(len(full), np.uint64)
    hashes[full] = textops.run_hashes(raw, offsets[:-1][full], offsets[1:][full], folded=False)
    codes = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    there = full[codes] if len(codes) else np.zeros(0, bool)
    words, text = hashes[codes[there]], text[there]
    found, first = textops.windows(words, text, size)
    counts = np.bincount(text, minlength=len(texts))
    wide = np.maximum(counts - size + 1, 0)
    begins = np.cumsum(counts) - counts
    found = found.view(np.int64)
    parts, sizes = [], np.zeros(len(texts), np.int64)
    ends = np.cumsum(wide)
    for at in np.flatnonzero(counts).tolist():
        if wide[at]:
            one = np.sort(found[ends[at] - wide[at] : ends[at]])
            if len(one) > 1:
                one = one[np.append(True, one[1:] != one[:-1])]
        else:  # fewer words than a shingle has
            few = int(counts[at])
            whole = words[begins[at] : begins[at] + few]
            one = textops.windows(whole, np.zeros(few, np.int64), few)[0].view(np.int64)
        parts.append(one)
        sizes[at] = len(one)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), sizes


def _set_ids(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order of its shingles."""
    full = sizes > 0
    out = np.zeros(len(sizes), np.uint64)
    if full.any():
        begins = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(textops.mix(values.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)), begins)
    return textops.mix(out + sizes.astype(np.uint64)).view(np.int64)


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The sets as binaries."""
    offsets = np.cumsum([0, *(8 * sizes)]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def sizes_and_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS
) -> DataFrame:
    """For every row ``id_col``, ``n`` shingles and ``sid`` (the set; null if empty); and rows with a ``token``,
    shingles that a task has met in several sets, with the number of these in ``n``."""
    id_type = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0
        for batch in textops.slices(batches, text_col, SLICE_BYTES):
            values, sizes = shingle_sets(batch.column(text_col), size)
            ids = _set_ids(values, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(ids, mask=sizes == 0),
                    pa.nulls(len(ids), pa.int64()),
                ],
                names=[id_col, "n", "sid", "token"],
            )
            kept.append(values[np.repeat(_first_met(ids, sizes, seen), sizes)])
            held += len(kept[-1])
            if held > COUNTED_SHINGLES:
                yield counted(kept, batch.column(id_col).type)
                kept, held = [], 0
        if kept:
            yield counted(kept, batch.column(id_col).type)

    def counted(parts: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(parts), return_counts=True)
        values, times = values[times >= SEEN_IN_TASK], times[times >= SEEN_IN_TASK]
        none = pa.nulls(len(values), kind)
        return pa.RecordBatch.from_arrays(
            [none, pa.array(times, pa.int64()), pa.nulls(len(values), pa.int64()), pa.array(values, pa.int64())],
            names=[id_col, "n", "sid", "token"],
        )

    schema = f"`{id_col}` {id_type.simpleString()}, n long, sid long, token long"
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def _first_met(ids: np.ndarray, sizes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which sets, empty ones aside, are not among those ``seen``, which takes them in."""
    first = np.zeros(len(ids), bool)
    for at in np.flatnonzero(sizes).tolist():
        if (key := int(ids[at])) not in seen:
            seen.add(key)
            first[at] = True
    return first


def _each_set(
    docs: DataFrame, text_col: str, size: int,
    made: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str,
) -> DataFrame:
    """``made`` of the shingles, sizes and identifiers of the sets that are not empty; each task takes each of its
    sets once.

    What needs shingles reads the texts again, as they are several times their text, and is made where they are:
    a second Python stage would hold another worker and batches of ten thousand sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in textops.slices(batches, text_col, SLICE_BYTES):
            values, sizes = shingle_sets(batch.column(text_col), size)
            ids = _set_ids(values, sizes)
            first = _first_met(ids, sizes, seen)
            yield made(values[np.repeat(first, sizes)], sizes[first], ids[first])

    return docs.select(text_col).mapInArrow(work, schema)


def heavy_shingles(counted: DataFrame) -> np.ndarray:
    """Shingles of many sets, the heaviest if there are too many, rising. Which ones are found decides on the
    work only: tasks have passed on what they met several times."""
    totals = counted.filter("token is not null").groupBy("token").agg(F.sum("n").alias("c"))
    top = totals.filter(F.col("c") >= HEAVY).orderBy(F.desc("c"), "token").limit(HEAVY_MOST)
    return np.sort(np.array([r["token"] for r in top.select("token").toLocalIterator()], np.int64))


def prefixes(docs: DataFrame, heavy: np.ndarray, threshold: Fraction, text_col: str, size: int) -> DataFrame:
    """``token``, ``sid``, ``heavy``: the shingles of every set of which similar sets share one."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    top, below = threshold.numerator, threshold.denominator

    def made(values: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        late = shared.value
        owner = np.repeat(np.arange(len(sizes)), sizes)
        last = np.zeros(len(values), bool)
        if len(late):
            last = late[np.minimum(np.searchsorted(late, values), len(late) - 1)] == values
        # sets are in order of hash already: a stable sort moves heavy shingles to their ends
        order = np.lexsort((last, owner))
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        needed = sizes - -(-sizes * top // below) + 1
        chosen = order[place < np.repeat(needed, sizes)]
        return pa.RecordBatch.from_arrays(
            [pa.array(values[chosen]), pa.array(ids[owner[chosen]]), pa.array(last[chosen])],
            names=["token", "sid", "heavy"],
        )

    return _each_set(docs, text_col, size, made, "token long, sid long, heavy boolean")


def shared_blocks(rows: DataFrame) -> DataFrame:
    """``token``, ``sid`` of the tokens that several sets have. Heavy ones are taken to be shared, so the window
    sees only tokens of moderate blocks, and the rows are shuffled once."""
    same = Window.partitionBy("token")
    light = (
        rows.filter("not heavy")
        .withColumn("again", F.lag("sid").over(same.orderBy("sid")) == F.col("sid"))
        .withColumn("least", F.min("sid").over(same))
        .withColumn("most", F.max("sid").over(same))
        .filter("least != most and (again is null or not again)")
    )
    return light.select("token", "sid").unionByName(rows.filter("heavy").select("token", "sid").distinct())


def signatures(values: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps of sets (one row of bytes each)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.zeros((len(sizes), bits), bool)
    flat[owner, values & (bits - 1)] = True
    return np.packbits(flat, axis=1)


class Tree:
    """Signature tree over sets given by bitmaps, sizes and components; level 0 are the sets themselves."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, classes: np.ndarray, leaves_only: bool = False):
        set_bits = np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        words = np.ascontiguousarray(bitmaps).view(np.uint64)
        self.levels = [(words, sizes, sizes, sizes - set_bits, classes, classes)]
        while len(self.levels[-1][0]) > FANOUT and not leaves_only:
            self.levels.append(self._above(*self.levels[-1]))

    @staticmethod
    def _above(words, least, most, excess, low, high):
        starts = np.arange(0, len(words), FANOUT)
        return (
            np.bitwise_or.reduceat(words, starts, axis=0),
            np.minimum.reduceat(least, starts),
            np.maximum.reduceat(most, starts),
            np.maximum.reduceat(excess, starts),
            np.minimum.reduceat(low, starts),
            np.maximum.reduceat(high, starts),
        )

    def pairs(self, other: Tree, threshold: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that may be similar and are of different classes, some at a time; of a tree with
        itself each pair once. Trees of different heights start at the lower one's root level."""
        level = min(len(self.levels), len(other.levels)) - 1
        a = np.arange(len(self.levels[level][0]))
        b = np.arange(len(other.levels[level][0]))
        a, b = np.repeat(a, len(b)), np.tile(b, len(a))
        todo = [(level, a, b)]
        while todo:
            level, a, b = todo.pop()
            if other is self:
                a, b = a[a <= b], b[a <= b]
            for start in range(0, len(a), 1 << 15):
                x, y = self.possible(other, level, a[start : start + (1 << 15)], b[start : start + (1 << 15)], threshold)
                if level == 0:
                    if other is self:
                        x, y = x[x < y], y[x < y]
                    if len(x):
                        yield x, y
                elif len(x):
                    below = self._below(other, level, x, y)
                    todo.append((level - 1, *below))

    def _below(self, other: Tree, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = np.arange(FANOUT)
        a = np.repeat((x[:, None] * FANOUT + step), FANOUT, axis=1).ravel()
        b = np.tile((y[:, None] * FANOUT + step), (1, FANOUT)).ravel()
        there = (a < len(self.levels[level - 1][0])) & (b < len(other.levels[level - 1][0]))
        return a[there], b[there]

    def possible(
        self, other: Tree, level: int, a: np.ndarray, b: np.ndarray, threshold: Fraction
    ) -> tuple[np.ndarray, np.ndarray]:
        """Those of the node pairs below which similar sets of different classes may be."""
        top, below = threshold.numerator, threshold.denominator
        w, least, most, excess, low, high = self.levels[level]
        w2, least2, most2, excess2, low2, high2 = other.levels[level]
        fits = (below * most[a] >= top * least2[b]) & (below * most2[b] >= top * least[a])
        fits &= ~((low[a] == high[a]) & (low2[b] == high2[b]) & (low[a] == low2[b]))
        a, b = a[fits], b[fits]
        common = np.bitwise_count(w[a] & w2[b]).sum(1, dtype=np.int64)
        overlap = np.minimum(common + np.minimum(excess[a], excess2[b]), np.minimum(most[a], most2[b]))
        fits = (top + below) * overlap >= top * (least[a] + least2[b])
        return a[fits], b[fits]


def similar(x: np.ndarray, y: np.ndarray, threshold: Fraction) -> bool:
    """Whether two sets (rising) reach the threshold."""
    few, many = sorted((len(x), len(y)))
    if few * threshold.denominator < threshold.numerator * many:
        return False
    shared = np.searchsorted(x, y)
    overlap = int((x[np.minimum(shared, len(x) - 1)] == y).sum())
    return overlap * threshold.denominator >= threshold.numerator * (len(x) + len(y) - overlap)


def _find(parent: list[int], at: int) -> int:
    while parent[at] != at:
        parent[at] = parent[parent[at]]
        at = parent[at]
    return at


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]], classes: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join different classes and close no circle."""
    first: dict[int, int] = {}
    parent = [first.setdefault(one, at) for at, one in enumerate(classes.tolist())]
    out = []
    for x, y in pairs:
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            p, q = _find(parent, i), _find(parent, j)
            if p != q:
                parent[p] = q
                out.append((i, j))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows with equal keys in sorted batches, many at a time, and where they begin and end."""
    rest: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
        if rest is None or not rest.num_rows:
            continue
        change = np.zeros(rest.num_rows + 1, bool)
        change[0] = change[-1] = True
        for column in (rest.column(k).to_numpy() for k in keys):
            change[1:-1] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(change)
        if batch is not None:
            cuts = cuts[:-1]  # the last run may go on
        if len(cuts) > 1:
            yield rest.slice(0, cuts[-1]).combine_chunks(), cuts
        rest = rest.slice(cuts[-1])


def _candidates(rows: DataFrame, key: str, threshold: Fraction, whole: bool) -> DataFrame:
    """``a``, ``b``: pairs of sets of one (key, cell), of which one is its ``own``, that their bitmaps allow to be
    similar; all of them if ``whole``, else in cells of more than a node as many as join their classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _groups(batches, [key, "cell"]):
            ids, classes, sizes, own = (table.column(c).to_numpy() for c in ("sid", "class", "n", "own"))
            raw, _ = textops.text_bytes(table.column("bitmap").chunk(0))
            bitmaps = raw.reshape(-1, SIGNATURE_BITS // 8)
            # a cell that fits a node is its own tree: all such nodes with themselves at once
            runs = np.diff(cuts)
            run = np.repeat(np.arange(len(runs)), runs)
            small = np.flatnonzero(runs[run] <= FANOUT)
            after = cuts[1:][run[small]] - small - 1
            x = np.repeat(small, after)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)
            met = own[x] | own[y]
            leaves = Tree(bitmaps, sizes, classes, leaves_only=True)
            yield named(ids, *leaves.possible(leaves, 0, x[met], y[met], threshold))
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if stop - start > FANOUT:
                    order = start + np.argsort(sizes[start:stop], kind="stable")
                    every = Tree(bitmaps[order], sizes[order], classes[order])
                    if not whole:
                        found = spanning(every.pairs(every, threshold), classes[order])
                        if found:
                            i, j = np.array(found).T
                            yield named(ids, order[i], order[j])
                        continue
                    # those dealt to this cell against all that came: of two guests each has a cell of its own
                    mine = order[own[order]]
                    if len(mine):
                        one = Tree(bitmaps[mine], sizes[mine], classes[mine])
                        for i, j in one.pairs(every, threshold):
                            yield named(ids, mine[i], order[j])

    def named(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    sorted_rows = rows.select(key, "cell", "sid", "class", "n", "own", "bitmap").repartition(key, "cell")
    found = sorted_rows.sortWithinPartitions(key, "cell").mapInArrow(work, "a long, b long")
    return materialized(found.distinct())


def _round(live: DataFrame, open_rows: DataFrame, number: int, threshold: Fraction) -> DataFrame:
    """``a``, ``b``: candidates within the cells of one round. ``open_rows``: token, sid, class of open blocks."""
    home = F.min(F.struct(F.xxhash64("token", F.lit(number)).alias("h"), F.col("token").alias("home")))
    homes = materialized(
        open_rows.groupBy("sid").agg(home.alias("h"), F.min("class").alias("class"))
        .select("sid", "class", F.col("h.home").alias("home"))
    )
    many = homes.groupBy("home").agg(
        F.count("*").alias("c"), F.min("class").alias("x"), F.max("class").alias("y")
    ).filter("x != y")
    cells = F.ceil(F.col("c") / CELL_SETS).alias("cells")
    dealt = homes.join(many.select("home", cells), "home").select(
        "sid", "class", "home", F.pmod(F.xxhash64("sid", F.lit(-number)), F.col("cells")).alias("cell"),
        F.lit(True).alias("own"),
    )
    return _candidates(dealt.join(live.select("sid", "n", "bitmap"), "sid"), "home", threshold, whole=False)


def _whole_blocks(live: DataFrame, open_rows: DataFrame, number: int, threshold: Fraction) -> DataFrame:
    """``a``, ``b``: all candidates of different classes in open blocks."""
    per_class = open_rows.groupBy("token", "class").agg(F.count("*").alias("c"))
    blocks = per_class.groupBy("token").agg(
        F.sum("c").alias("c"), F.max_by("class", F.struct("c", "class")).alias("main")
    )
    cells = F.ceil(F.col("c") / CELL_SETS)
    rows = open_rows.join(blocks.select("token", "main", cells.alias("cells")), "token").withColumn(
        "in_main", F.col("class") == F.col("main")
    )
    own = F.pmod(F.xxhash64("sid"), F.col("cells"))
    dealt = rows.withColumn(
        "cell", F.explode(F.when(F.col("in_main"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("cells") - 1)))
    ).withColumn("own", F.col("in_main") | (F.col("cell") == own))
    return _candidates(dealt.join(live.select("sid", "n", "bitmap"), "sid"), "token", threshold, whole=True)


def _hubs(pairs: DataFrame) -> DataFrame:
    """``sid``, ``hub``, ``cell``, ``guest``: which sets meet to verify the pairs (a, b). The end with more pairs
    is the hub and goes once to each of its cells, the other end is a guest there."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("c"))
    both = (
        pairs.join(ends.select(F.col("sid").alias("a"), F.col("c").alias("ca")), "a")
        .join(ends.select(F.col("sid").alias("b"), F.col("c").alias("cb")), "b")
    )
    a_leads = F.col("ca") >= F.col("cb")
    cells = F.ceil(F.greatest("ca", "cb") / CELL_SETS)
    met = materialized(both.select(
        F.when(a_leads, F.col("a")).otherwise(F.col("b")).alias("hub"),
        F.when(a_leads, F.col("b")).otherwise(F.col("a")).alias("sid"), cells.alias("cells"),
    ).withColumn("cell", F.pmod(F.xxhash64("sid"), F.col("cells"))))
    homes = met.select(F.col("hub").alias("sid"), "hub", "cell").distinct().withColumn("guest", F.lit(False))
    return materialized(met.select("sid", "hub", "cell", F.lit(True).alias("guest")).unionByName(homes))


def _at_hubs(live: DataFrame, pairs: DataFrame, column: str, agree: Callable[..., bool]) -> DataFrame:
    """The pairs (a, b) for which ``agree`` holds of both sets' sizes and ``column``; that is shuffled once a pair,
    and once a hub's cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, size, held = None, 0, b""
        for batch in batches:
            links = []
            sizes = batch.column("n").to_pylist()
            for at, guest in enumerate(batch.column("guest").to_pylist()):
                value = batch.column(column)[at].as_buffer()
                if not guest:  # first of its cell
                    hub, size, held = batch.column("hub")[at].as_py(), sizes[at], value.to_pybytes()
                elif agree(size, held, sizes[at], value):
                    sid = batch.column("sid")[at].as_py()
                    links.append((min(hub, sid), max(hub, sid)))
            low, high = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    few = broadcast_if_small(_hubs(pairs), max_bytes=SMALL_BYTES)
    rows = live.select("sid", "n", column).join(few, "sid").repartition("hub", "cell")
    return rows.sortWithinPartitions("hub", "cell", "guest").mapInArrow(work, "a long, b long")


def wide_bitmap(values: np.ndarray) -> bytes:
    """Bitmap of a set with four bits or more for each of its shingles, so that large sets can be told apart too."""
    bits = 1 << max(6, (4 * len(values) - 1).bit_length())
    flat = np.zeros(bits, bool)
    flat[values & (bits - 1)] = True
    return np.packbits(flat).tobytes()


def wide_possible(n: int, x: bytes, m: int, y: bytes, threshold: Fraction) -> bool:
    """Whether sets of these sizes and wide bitmaps may reach the threshold: what one has in a bit that the other
    lacks is not shared. Of different widths the wider one is folded."""
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(np.frombuffer(z, np.uint8).reshape(-1, width), axis=0) for z in (x, y))
    overlap = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return (threshold.numerator + threshold.denominator) * overlap >= threshold.numerator * (n + m)


def verified(live: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of sets that reach the threshold. The bitmaps of the trees have one width and let large sets
    pass, so wide ones, a sixteenth of the shingles, go first."""

    def whole(n: int, x: bytes, m: int, y: bytes) -> bool:
        return similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), threshold)

    likely = _at_hubs(live, pairs, "wide", lambda *both: wide_possible(*both, threshold))
    return _at_hubs(live, materialized(likely), "shingles", whole)


def _signed(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """``sid``, ``n``, ``shingles`` (packed), ``bitmap``, ``wide`` of the sets."""

    def made(values: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        bitmaps = signatures(values, sizes, SIGNATURE_BITS)
        ends = np.cumsum(sizes)
        wide = [wide_bitmap(values[end - n : end]) for n, end in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids), pa.array(sizes, pa.int64()), _packed(values, sizes),
                pa.array([row.tobytes() for row in bitmaps], pa.binary()), pa.array(wide, pa.binary()),
            ],
            names=["sid", "n", "shingles", "bitmap", "wide"],
        )

    return _each_set(
        docs, text_col, size, made, "sid long, n long, shingles binary, bitmap binary, wide binary"
    )


def _live(docs: DataFrame, members: DataFrame, text_col: str, size: int) -> DataFrame:
    """``sid``, ``n``, ``shingles``, ``bitmap``, ``wide`` of the sets that stand in some block, each once."""
    few = broadcast_if_small(members, max_bytes=SMALL_BYTES)
    chosen = _signed(docs, text_col, size).join(few, "sid", "left_semi")
    rows = materialized(chosen.withColumn("row", F.monotonically_increasing_id()))
    # sets that several tasks have met
    twice = materialized(
        rows.groupBy("sid").agg(F.min("row").alias("keep"), F.count("*").alias("c")).filter("c > 1")
        .select("sid", "keep")
    )
    kept = rows.join(broadcast_if_small(twice, max_bytes=SMALL_BYTES), "sid", "left")
    return kept.filter("keep is null or keep = row").drop("keep", "row")


def set_classes(
    docs: DataFrame, heavy: np.ndarray, threshold: Fraction, text_col: str, size: int, rounds: int = ROUNDS
) -> DataFrame:
    """``id`` (a set's ``sid``) and ``class_id`` of all sets that are linked with another one."""
    blocks = materialized(shared_blocks(prefixes(docs, heavy, threshold, text_col, size)))
    live = _live(docs, materialized(blocks.select("sid").distinct()), text_col, size)
    gained = 1 << 62
    links: DataFrame | None = None
    classes: DataFrame | None = None
    for number in range(1, rounds + 2):
        open_rows = _open(blocks, classes)
        n_open = open_rows.select("sid").distinct().count()
        if not n_open:
            break
        last = number > rounds or gained < n_open // WORTH_A_ROUND
        candidates = (_whole_blocks if last else _round)(live, open_rows, number, threshold)
        new = materialized(verified(live, candidates, threshold))
        gained = new.count()
        if gained:
            links = new if links is None else links.unionByName(new)
            classes = materialized(components.components(links))
        if last:
            break
    return classes if classes is not None else docs.sparkSession.createDataFrame([], "id long, class_id long")


def _open(blocks: DataFrame, classes: DataFrame | None) -> DataFrame:
    """``token``, ``sid``, ``class`` of the blocks that hold sets of more than one class."""
    if classes is None:
        return blocks.withColumn("class", F.col("sid"))
    by_sid = classes.select(F.col("id").alias("sid"), F.col("class_id").alias("class"))
    rows = blocks.join(by_sid, "sid", "left").withColumn("class", F.coalesce("class", "sid"))
    mixed = rows.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x != y")
    return materialized(rows.join(mixed.select("token"), "token"))


def _or_own(column: str, own: str) -> Column:
    return F.coalesce(F.col(column), F.col(own))


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: Fraction = THRESHOLD,
    size: int = SHINGLE_WORDS,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_shingles`` and ``component_id``, the smallest identifier reachable
    over links."""
    counted = materialized(sizes_and_counts(docs, id_col, text_col, size))
    rows = counted.filter("token is null")
    classes = set_classes(docs, heavy_shingles(counted), threshold, text_col, size)
    of_set = classes.select(F.col("id").alias("sid"), F.col("class_id").alias("class"))
    placed = materialized(
        rows.select(F.col(id_col).alias("own"), "n", "sid").join(of_set, "sid", "left")
        .select("own", "n", _or_own("class", "sid").alias("class"))
    )
    least = placed.filter("class is not null").groupBy("class").agg(
        F.min("own").alias("least"), F.count("*").alias("c")
    ).filter("c > 1").select("class", "least")
    return placed.join(least, "class", "left").select(
        F.col("own").alias(id_col), F.col("n").alias("n_shingles"), _or_own("least", "own").alias("component_id")
    )
