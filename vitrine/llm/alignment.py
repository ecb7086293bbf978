"""Alignment of two tokenizers' tokens over whole texts, and how often their ids meet in the corpus.

A text with a space before it is encoded by a byte-level BPE (A), the text itself by a piece model that adds
that space (B), both without special tokens. The bytes of their tokens spell the same string, so the byte
offset after each token places it. Dictionaries lead from these ends to token indexes; the keys that both
have, in order, cut both id lists into groups, and within a group every A token is linked with every B token.

Counting: every task aligns slices of some MB of text. A slice keeps its distinct id pairs with the number of
its documents that hold them, and for each document indexes into these. The pairs are summed over the corpus,
looked up once for each slice (not for each document), and laid over the documents again. A pair that stands
in every slice is one row a slice; the join that looks it up can be split. Nothing is broadcast but the two
models.

Defined results: null and empty texts, and texts that one of the models changes (their tokens' bytes differ
from space and text), have no tokens, no groups and no links; ``groups`` is null. Rows with equal or null
identifiers are aligned one by one and count as documents of their own. Groups of many tokens are linked by
distinct ids and how often they occur, so a long text without common ends needs no memory for each link. An
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import bpe, textops
from vitrine.session import materialized

ENCODED_BYTES = 64 << 10
EXPANDED_LINKS = 4096
KEPT_UNITS = 120_000
SLICE_BYTES = 2 << 20

# The characters of the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Models:
    """Both tokenizers with the bytes of their tokens. Sent as the contents of their files."""

    def __init__(self, a_file: str, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is Spark's to give
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=b_file)
        self.a_bytes = bpe.Vocabulary(json.loads(a_file)).strings
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (list(map(len, t)) for t in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        # an id's text with what follows it: of B inside and at the end of a group, then of A
        self.marks = [
            f"{i}{end}" for table, ends in ((self.b_bytes, ",;"), (self.a_bytes, ",|")) for end in ends
            for i in range(len(table))
        ]
        # A's pattern takes white space at the start of a match only. Where no piece of B has it later than at
        # its start, no token spans a place where white space follows something else.
        inner = {c for p in pieces for c in re.findall(f"[^{WHITE}▁]([{WHITE}▁])", p)}
        plain = not inner & {"▁", " "} and self.b.normalize("a  b ") == "▁a▁▁b▁"
        further = f"(?:[{''.join(map(re.escape, sorted(inner)))}][{WHITE}]*[^{WHITE}]*)*" if inner else ""
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+{further}|[{WHITE}]+" if plain else "(?s).+").findall

    @classmethod
    def read(cls, a_path: str, b_path: str) -> tuple[str, bytes]:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return a.read(), b.read()

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both for a text that starts with the added space or other white space; None where a model
        changes its bytes."""
        a_ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        # B adds a space: it stands for the text's own, or is taken away again
        b_ids = [self.space] if text == " " else self.b.encode(text.removeprefix(" "), num_threads=1)
        if text[0] != " " and b_ids[:1] == [self.space]:
            b_ids = b_ids[1:]
        wanted = text.encode()
        same = (
            b"".join(map(self.a_bytes.__getitem__, a_ids)) == wanted
            and b"".join(map(self.b_bytes.__getitem__, b_ids)) == wanted
        )
        return (a_ids, b_ids) if same else None

    def align(self, text: str) -> Aligned | None:
        ids = self.encode(text)
        return ids and Aligned.of(*ids, self.a_sizes, self.b_sizes)


@dataclass
class Aligned:
    """Ids of a text, where its groups end in bytes, and after how many tokens of each list."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray

    @classmethod
    def of(cls, a_ids: list[int], b_ids: list[int], a_sizes: list[int], b_sizes: list[int]) -> Aligned:
        a_ends = dict(zip(accumulate(map(a_sizes.__getitem__, a_ids)), count(1)))
        b_ends = dict(zip(accumulate(map(b_sizes.__getitem__, b_ids)), count(1)))
        common = sorted(a_ends.keys() & b_ends.keys())
        size = len(common)
        return cls(
            np.array(a_ids, np.int64),
            np.array(b_ids, np.int64),
            np.array(common, np.int64),
            np.fromiter(map(a_ends.__getitem__, common), np.int64, size),
            np.fromiter(map(b_ends.__getitem__, common), np.int64, size),
        )

    @property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_cuts, prepend=0), np.diff(self.b_cuts, prepend=0)

    def group_texts(self, marks: list[str], b_vocabulary: int, a_vocabulary: int) -> list[str]:
        """Ids of A and of B group by group, each with the sign that follows it in ``a1,a2|b1;a3|b2,b3;``."""
        n_a, n_b = len(self.a), len(self.b)
        group = np.arange(len(self.ends))
        out = np.empty(n_a + n_b, np.int64)
        for ids, sizes, cuts, base, vocabulary, before in (
            (self.a, self.sizes[0], self.a_cuts, 2 * b_vocabulary, a_vocabulary, np.append(0, self.b_cuts)[:-1]),
            (self.b, self.sizes[1], self.b_cuts, 0, b_vocabulary, self.a_cuts),
        ):
            last = np.zeros(len(ids), np.int64)
            last[cuts - 1] = vocabulary
            out[np.arange(len(ids)) + before[np.repeat(group, sizes)]] = ids + last + base
        return list(map(marks.__getitem__, out.tolist()))

    def links(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part, id pair (a << 32 | b) and number of links of each pair in each part, in order; ``part`` says
        for every group, rising, which part of the text it belongs to."""
        a_sizes, b_sizes = self.sizes
        a_from, b_from = self.a_cuts - a_sizes, self.b_cuts - b_sizes
        sizes = a_sizes * b_sizes
        few = np.flatnonzero(sizes <= EXPANDED_LINKS)
        group = np.repeat(few, sizes[few])
        at = np.arange(len(group)) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
        codes = [self.a[a_from[group] + at // b_sizes[group]] << 32 | self.b[b_from[group] + at % b_sizes[group]]]
        parts, times = [part[group]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(sizes > EXPANDED_LINKS).tolist():
            ones, n_ones = np.unique(self.a[a_from[g] : self.a_cuts[g]], return_counts=True)
            others, n_others = np.unique(self.b[b_from[g] : self.b_cuts[g]], return_counts=True)
            codes.append((ones[:, None] << 32 | others[None, :]).ravel())
            times.append(np.outer(n_ones, n_others).ravel())
            parts.append(np.full(len(codes[-1]), part[g]))
        return added_up(np.concatenate(parts), np.concatenate(codes), np.concatenate(times))


def added_up(owner: np.ndarray, code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) in order with the sum of their times."""
    if not len(owner):
        return owner, code, times
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))
    return owner[first], code[first], np.add.reduceat(times[order], first)


def spread(sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of ``sizes`` laid one after the other: the places of the chosen ones' entries, and for each
    of these which choice it belongs to."""
    many = sizes[chosen]
    choice = np.repeat(np.arange(len(chosen)), many)
    begins = np.cumsum(sizes) - sizes
    return np.arange(len(choice)) - np.repeat(np.cumsum(many) - many, many) + begins[chosen][choice], choice


class Units:
    """Counts, text and links of the units met so far. A text's alignment is that of its units, one after the
    other, so a unit is encoded and aligned once as long as it is kept; once they are too many, the more
    frequent half is."""

    def __init__(self, models: Models):
        self.models = models
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, whether bytes are kept
        self.sizes = self.pairs = self.times = self.seen = np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of all texts' units, one text after the other, and how many each text has."""
        cut = [self.models.units(" " + text) if text else [] for text in texts]
        self._learn([u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in self.index])
        sizes = np.array(list(map(len, cut)), np.int64)
        flat = chain.from_iterable(cut)
        return np.fromiter(map(self.index.__getitem__, flat), np.int64, sizes.sum()), sizes

    def forget(self, used: np.ndarray) -> None:
        seen = np.bincount(used, minlength=len(self.texts))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        if len(seen) > KEPT_UNITS:
            least = np.partition(seen, -KEPT_UNITS // 2)[-KEPT_UNITS // 2]
            chosen = np.flatnonzero(seen > least)
            self.seen = seen[chosen]
            entries, _ = spread(self.sizes, chosen)
            names = list(self.index)
            self.index = {names[at]: new for new, at in enumerate(chosen.tolist())}
            self.texts = [self.texts[at] for at in chosen.tolist()]
            self.numbers, self.sizes = self.numbers[chosen], self.sizes[chosen]
            self.pairs, self.times = self.pairs[entries], self.times[entries]

    def _learn(self, fresh: list[str]) -> None:
        """Units that end in other than white space are encoded joined together, some at a time."""
        found = []
        joined, size = [], 0
        for unit in fresh:
            alone = unit[-1].isspace()
            if joined and (alone or size + len(unit) > ENCODED_BYTES):
                found.append(self._aligned(joined))
                joined, size = [], 0
            joined.append(unit)
            size += len(unit)
            if alone:
                found.append(self._aligned(joined))
                joined, size = [], 0
        if joined:
            found.append(self._aligned(joined))
        for at, unit in enumerate(fresh, len(self.index)):
            self.index[unit] = at
        for texts, *_ in found:
            self.texts += texts
        old = self.numbers, self.sizes, self.pairs, self.times
        self.numbers, self.sizes, self.pairs, self.times = (
            np.concatenate(parts) for parts in zip(old, *(f[1:] for f in found), strict=True)
        )

    def _aligned(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        one = self.models.align("".join(units))
        if one is None:  # a model changes one of them
            if len(units) == 1:
                none = np.zeros(0, np.int64)
                return [""], np.zeros((1, 5), np.int64), np.zeros(1, np.int64), none, none
            half = len(units) // 2
            left, right = self._aligned(units[:half]), self._aligned(units[half:])
            return left[0] + right[0], *(np.concatenate(x) for x in zip(left[1:], right[1:], strict=True))
        many = len(units)
        unit_ends = np.cumsum([len(u.encode()) for u in units])
        unit = np.searchsorted(unit_ends, one.ends)
        a_sizes, b_sizes = one.sizes
        owner, pairs, times = one.links(unit)
        numbers = np.zeros((many, 5), np.int64)
        for column, amount in enumerate((a_sizes, b_sizes, np.ones_like(unit), a_sizes * b_sizes)):
            np.add.at(numbers[:, column], unit, amount)
        numbers[:, 4] = 1
        marked = one.group_texts(self.models.marks, len(self.models.b_bytes), len(self.models.a_bytes))
        ends = np.cumsum(numbers[:, 0] + numbers[:, 1]).tolist()
        texts = ["".join(marked[start:stop])[:-1] for start, stop in zip([0, *ends], ends)]
        return texts, numbers, np.bincount(owner, minlength=many), pairs, times


def _shared(docs: DataFrame, a_path: str, b_path: str) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(Models.read(a_path, b_path))


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``a_ids`` and ``b_ids`` array<int>, ``a_cuts`` and ``b_cuts`` array<int>: group i holds the
    tokens from cut i - 1 (or 0) up to, without, cut i of both lists. One row per row of ``docs``."""
    shared = _shared(docs, a_path, b_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(*shared.value)
        nothing = Aligned.of([], [], [], [])
        names = ["a_ids", "b_ids", "a_cuts", "b_cuts"]
        for batch in textops.slices(batches, text_col, SLICE_BYTES):
            texts = batch.column(text_col).to_pylist()
            found = [(text and models.align(" " + text)) or nothing for text in texts]
            lists = [
                pa.array([getattr(f, name) for f in found], pa.list_(pa.int32()))
                for name in ("a", "b", "a_cuts", "b_cuts")
            ]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *lists], names=[id_col, *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def _held(units: Units, used: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, ...]:
    """The pairs that a slice's texts hold: distinct pairs, in how many texts each is held; then for every text
    the number of its pairs, the steps from each of them to the next, and their links."""
    chosen = np.unique(used)
    entries, _ = spread(units.sizes, chosen)
    distinct, code = np.unique(units.pairs[entries], return_inverse=True)
    sizes, times = units.sizes[chosen], units.times[entries]
    places, choice = spread(sizes, np.searchsorted(chosen, used))
    owner, index, total = added_up(text[choice], code[places], times[places])
    held = np.bincount(owner, minlength=texts)
    # a text's indexes rise, so the steps between them are small numbers
    steps = np.diff(index, prepend=0)
    begins = (np.cumsum(held) - held)[held > 0]
    steps[begins] = index[begins]
    return distinct, np.bincount(index, minlength=len(distinct)), held, steps, total


def _slices(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row per slice of text: its documents with their counts and the digest of their groups; its distinct
    pairs and in how many of its documents each is held; for each document the steps from pair to pair and
    the number of links of each, packed one after the other."""
    shared = _shared(docs, a_path, b_path)
    id_type = docs.schema[id_col].dataType
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_pairs"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(Models(*shared.value))
        first = TaskContext.get().partitionId() << 32
        for at, batch in enumerate(textops.slices(batches, text_col, SLICE_BYTES)):
            used, many = units.of(batch.column(text_col).to_pylist())
            text = np.repeat(np.arange(len(many)), many)
            changed = np.unique(text[units.numbers[used, 4] == 0])
            whole = ~np.isin(text, changed)
            used, text = used[whole], text[whole]
            many = np.bincount(text, minlength=len(many))
            numbers = np.zeros((len(many), 4), np.int64)
            starts = (np.cumsum(many) - many)[many > 0]
            if len(starts):
                numbers[many > 0] = np.add.reduceat(units.numbers[used, :4], starts)
            names = list(map(units.texts.__getitem__, used.tolist()))
            digests = [
                hashlib.sha256(";".join(names[stop - size : stop]).encode()).hexdigest() if size else ""
                for size, stop in zip(many.tolist(), np.cumsum(many).tolist(), strict=True)
            ]
            distinct, docs_with, held, steps, times = _held(units, used, text, len(many))
            units.forget(used)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + at], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(id_col)),
                    *[pa.array([column], pa.list_(pa.int64())) for column in (*numbers.T, held)],
                    pa.array([digests], pa.list_(pa.string())),
                    pa.array([distinct], pa.list_(pa.int64())),
                    pa.array([docs_with], pa.list_(pa.int64())),
                    pa.array([steps.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([times.tobytes()], pa.binary()),
                ],
                names=["slice", "ids", *counts, "digests", "pairs", "docs_with", "steps", "times"],
            )

    schema = (
        f"slice long, ids array<{id_type.simpleString()}>, "
        + "".join(f"{c} array<long>, " for c in counts)
        + "digests array<string>, pairs array<long>, docs_with array<long>, steps binary, times binary"
    )
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def _pair_counts(slices: DataFrame) -> DataFrame:
    """``pair`` (a << 32 | b), ``n`` documents that hold it, ``best``: no pair of the same a is held by more."""
    rows = slices.select(F.explode(F.arrays_zip("pairs", "docs_with")).alias("p"))
    counts = materialized(rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs_with").alias("n")))
    a_id = F.shiftright("pair", 32).alias("a_id")
    most = counts.groupBy(a_id).agg(F.max("n").alias("most"))
    return counts.withColumn("a_id", a_id).join(most, "a_id").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )


def pair_counts(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``a_id``, ``b_id``, ``n_docs`` and ``best`` of all id pairs that are linked in some document."""
    found = _pair_counts(materialized(_slices(docs, a_path, b_path, id_col, text_col)))
    return found.select(
        F.shiftright("pair", 32).cast("int").alias("a_id"),
        F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"),
        F.col("n").alias("n_docs"), "best",
    )


def link_statistics(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is held by
    as many documents as any pair of their A id), ``count_sum`` (over links, documents that hold the pair) and
    ``groups_sha256`` (of the groups' text; empty without tokens)."""
    slices = materialized(_slices(docs, a_path, b_path, id_col, text_col))
    counts = _pair_counts(slices)
    rows = slices.select("slice", F.posexplode("pairs").alias("at", "pair"))
    value = F.shiftleft("n", 1) + F.col("best").cast("long")
    # ordered by place within the slice; as many as the slice has pairs
    looked_up = (
        rows.join(counts, "pair").groupBy("slice")
        .agg(F.sort_array(F.collect_list(F.struct("at", value.alias("v")))).alias("found"))
        .select("slice", F.col("found.v").alias("found"))
    )
    id_type = docs.schema[id_col].dataType
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)

                def values(name: str, row: pa.RecordBatch = row) -> pa.Array:
                    return row.column(name).flatten()

                sizes = values("n_pairs").to_numpy()
                steps = np.frombuffer(row.column("steps")[0].as_buffer(), np.int32).astype(np.int64)
                times = np.frombuffer(row.column("times")[0].as_buffer(), np.int64)
                begins = np.cumsum(sizes) - sizes
                some = sizes > 0
                total = np.cumsum(steps)
                offset = np.zeros(len(sizes), np.int64)
                offset[some] = total[begins[some]] - steps[begins[some]]
                where = total - np.repeat(offset, sizes)
                found = values("found").to_numpy(zero_copy_only=False)[where] if len(where) else where
                sums = []
                for weight in (found & 1, found >> 1):
                    out = np.zeros(len(sizes), np.int64)
                    if some.any():
                        out[some] = np.add.reduceat(weight * times, begins[some])
                    sums.append(pa.array(out))
                yield pa.RecordBatch.from_arrays(
                    [values("ids"), *[values(n) for n in numbers], *sums, values("digests")],
                    names=[id_col, *numbers, "n_best", "count_sum", "groups_sha256"],
                )

    schema = (
        f"`{id_col}` {id_type.simpleString()}, "
        + "".join(f"{c} long, " for c in [*numbers, "n_best", "count_sum"])
        + "groups_sha256 string"
    )
    columns = ["ids", *numbers, "n_pairs", "digests", "steps", "times", "found"]
    return slices.join(looked_up, "slice", "left").select(columns).mapInArrow(work, schema)
