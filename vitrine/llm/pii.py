"""Personal data: spans found by pattern, and terms that reveal them by corpus co-occurrence.

The values found by pattern (e-mail, IP address, card and phone number) are the protected entities. How
strongly a term reveals an entity is their pointwise mutual information over documents: for N documents,
log2(N * both / (of the entity * of the term)), where ``both`` counts documents with the term and the
entity anywhere in them. The information of the entity itself, log2(N / of the entity), is the most that
can be revealed. A term that reveals a share of ``GENERALISE`` or more of it is generalised to what kind of
term it is; from ``REMOVE`` on it is removed. This holds for each occurrence of the term in a document of
that entity.

``support`` is the least number of documents of an entity and of its pair with a term. With 1 every entity is
estimated, also one that stands in a single document; there rare terms alone reveal it (those of at most
N ** 0.2 documents, and those of N ** 0.05 are removed). The query uses 1; ``SUPPORT`` is what callers get that
name none.

Counts cover all documents: each term of the corpus is counted once, summed by task before the sums meet.
Only terms rare enough to reveal some entity are looked for in documents with values, and entities of the
same documents are estimated once. Documents without values are joined with nothing.

Terms are maximal runs of letters, digits and underscores of any script, compared in lower case. Terms
inside a found value are part of it and no terms of their own.

Defined results: null text counts as empty and has no spans. Rows with a null identifier are treated
like others, and rows that repeat an identifier are told apart by their text; equal rows count twice in
the corpus. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import textops
from vitrine.session import broadcast_if_small, materialized

SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
COUNTED_TERMS = 300_000

# Kinds in their order, and the patterns that decide the spans.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL_BEFORE = r"[A-Za-z0-9._%+-]"
EMAIL_AFTER = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)"
CARD = r"[0-9](?:[ -]?[0-9])+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[0-9]")
_TERM = re.compile(r"\w+")


class Finder:
    """Finds the values of one text; every pattern takes time in proportion to the text."""

    def __init__(self) -> None:
        self.after = re.compile(EMAIL_AFTER).match
        self.ip, self.card, self.phone = (re.compile(p).finditer for p in (IP, CARD, PHONE))

    def emails(self, text: str) -> Iterator[tuple[int, int]]:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            domain = self.after(text, at) if start < at else None
            if domain:
                yield start, domain.end()
                done = domain.end()
            else:
                done = at + 1
            at = text.find("@", done)

    def values(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's number, end), sorted."""
        found = []
        if "@" in text:
            found += [(start, 0, end) for start, end in self.emails(text)]
        if _DIGITS.search(text):
            found += [(m.start(), 1, m.end()) for m in self.ip(text) if _is_ip(m.groups())]
            found += [(m.start(), 2, m.end()) for m in self.card(text) if _is_card(m.group())]
            if "+" in text:
                found += [(m.start(), 3, m.end()) for m in self.phone(text)
                          if 10 <= len(_DIGITS.findall(m.group())) <= 15]
        return sorted(found)


def _is_ip(parts: tuple[str, ...]) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in parts)


def _is_card(text: str) -> bool:
    digits = [int(c) for c in text if c not in " -"] if len(text) <= 40 else []
    if not 14 <= len(digits) <= 19:
        return False
    doubled = sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + doubled) % 10 == 0


def entity(text: str, kind: int) -> str:
    """The value in one spelling: lower case, and numbers without what separates their digits."""
    return f"{KINDS[kind]}:" + (text.lower() if kind < 2 else "".join(_DIGITS.findall(text)))


def terms_outside(text: str, values: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Terms (start, end) that do not touch a value."""
    out, edges = [], iter([*sorted((s, e) for s, _, e in values), (len(text) + 1, 0)])
    low, high = next(edges)
    for match in _TERM.finditer(text):
        while high and high <= match.start():
            low, high = next(edges)
        if match.end() <= low:
            out.append(match.span())
    return out


def _contexts(docs: DataFrame) -> DataFrame:
    """(row_key, id, text, entities, terms): documents with values, their distinct entities and terms."""
    id_type = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in textops.slices(batches, "text"):
            at, entities, terms = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                values = finder.values(text)
                if not values:
                    continue
                at.append(row)
                entities.append(sorted({entity(text[start:end], kind) for start, kind, end in values}))
                terms.append(sorted({text[a:b].lower() for a, b in terms_outside(text, values)}))
            if at:
                part = batch.take(pa.array(at, pa.int64()))
                strings = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("row_key", "id", "text")],
                     pa.array(entities, strings), pa.array(terms, strings)],
                    names=["row_key", "id", "text", "entities", "terms"],
                )

    return docs.select("row_key", "id", "text").mapInArrow(
        work, f"row_key long, id {id_type}, text string, entities array<string>, terms array<string>"
    )


def _term_counts(docs: DataFrame) -> DataFrame:
    """(term, of_term): in how many documents each term of the corpus stands, outside of values."""

    def table(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["term", "n"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        counts: dict[str, int] = {}
        for batch in textops.slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                values = finder.values(text)
                if values:
                    words = {text[a:b].lower() for a, b in terms_outside(text, values)}
                else:
                    words = {word.lower() for word in set(_TERM.findall(text))}
                for word in words:
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > COUNTED_TERMS:  # what a task holds; the sums are made in Spark
                yield table(counts)
                counts = {}
        yield table(counts)

    counted = docs.select("text").mapInArrow(work, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("of_term"))


def disclosure(docs: DataFrame, contexts: DataFrame, support: int) -> DataFrame:
    """(row_key, term, share): terms of a document that reveal ``GENERALISE`` or more of one of its entities.

    ``docs`` (text) are all documents, ``contexts`` what ``_contexts`` found in them.
    """
    entities = contexts.select("row_key", F.explode("entities").alias("entity"))
    # entities of the same documents get the same shares: one stands for all
    places = F.sum(F.xxhash64("row_key").cast("decimal(20,0)"))
    of_entity = materialized(
        entities.groupBy("entity").agg(F.count("*").alias("of_entity"), places.alias("places"))
        .filter(F.col("of_entity") >= support)
    )
    stands = materialized(
        entities.join(broadcast_if_small(of_entity, max_bytes=4 << 20), "entity")
        .select("row_key", "of_entity", "places").distinct()
    )
    limits = F.broadcast(materialized(  # one row
        docs.agg(F.count("*").alias("total")).crossJoin(of_entity.agg(F.max("of_entity").alias("largest")))
    ))

    def can_reveal(largest: str):
        # both <= of_entity, so a share of GENERALISE needs a term of so many documents at most
        rest = F.pow(F.col("total") / F.col(largest), F.lit(1 - GENERALISE))
        return F.col("of_term") <= F.col(largest) * rest * 1.000001

    of_term = materialized(
        _term_counts(docs).crossJoin(limits).filter(can_reveal("largest")).select("term", "of_term")
    )
    pairs = materialized(
        contexts.select("row_key", F.explode("terms").alias("term"))
        .join(broadcast_if_small(of_term, max_bytes=4 << 20), "term")
        .join(broadcast_if_small(stands, max_bytes=4 << 20), "row_key").crossJoin(limits)
        .filter(can_reveal("of_entity"))
        .select("row_key", "of_entity", "places", "term", "of_term")
    )
    known = F.log2(F.col("total") / F.col("of_entity"))
    revealed = F.log2(F.col("total") * F.col("both") / (F.col("of_entity") * F.col("of_term")))
    shares = (
        pairs.groupBy("of_entity", "places", "term", "of_term").agg(F.count("*").alias("both"))
        .filter(F.col("both") >= support).crossJoin(limits)
        .filter(known > 0)
        .select("of_entity", "places", "term", F.round(revealed / known, 9).alias("share"))
        .filter(F.col("share") >= GENERALISE)
    )
    return (
        pairs.join(shares, ["of_entity", "places", "term"])
        .groupBy("row_key", "term").agg(F.max("share").alias("share"))
    )


def _kind_of(term: str) -> str:
    if term.isdigit():
        return "[number]"
    return "[name]" if term[0].isupper() else "[word]"


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT
) -> DataFrame:
    """``id_col``, ``spans`` array<struct<kind, start, end>> (by start, then kind) and ``sanitised``
    text, one row per row of ``docs``. Positions are code points, the end exclusive."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("row_key", F.xxhash64("id", "text"))
    contexts = materialized(_contexts(rows))
    strong = F.map_from_entries(F.collect_list(F.struct("term", "share")))
    marked = materialized(
        disclosure(rows.select("text"), contexts, support).groupBy("row_key").agg(strong.alias("terms"))
    )
    joined = contexts.select("row_key", "id", "text").join(
        broadcast_if_small(marked, max_bytes=4 << 20), "row_key", "left"
    )
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in textops.slices(batches, "text"):
            spans, texts = [], []
            for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(),
                                   strict=True):
                values = finder.values(text)
                share = dict(terms or ())
                cuts = [(a, b, f"[{KINDS[kind]}]") for a, kind, b in values]
                found = list(values)
                for a, b in terms_outside(text, values) if share else ():
                    revealed = share.get(text[a:b].lower())
                    if revealed is not None:
                        found.append((a, len(KINDS) - 1, b))
                        cuts.append((a, b, "" if revealed >= REMOVE else _kind_of(text[a:b])))
                spans.append([(KINDS[kind], a, b) for a, kind, b in sorted(found)])
                texts.append(_replaced(text, cuts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(spans, pa.list_(span)), pa.array(texts, pa.string())],
                names=["id", "spans", "sanitised"],
            )

    def without_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in textops.slices(batches, "text"):
            at = [row for row, text in enumerate(batch.column("text").to_pylist()) if not finder.values(text)]
            if at:
                part = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([[]] * len(at), pa.list_(span)), part.column("text")],
                    names=["id", "spans", "sanitised"],
                )

    schema = f"id {id_type}, spans array<struct<kind:string,start:int,end:int>>, sanitised string"
    out = joined.select("id", "text", "terms").mapInArrow(work, schema).unionByName(
        rows.select("id", "text").mapInArrow(without_values, schema)
    )
    return out.withColumnRenamed("id", id_col)


def _replaced(text: str, cuts: list[tuple[int, int, str]]) -> str:
    """The text with each cut replaced; of cuts that overlap, the first and longest counts."""
    if not cuts:
        return text
    out, done = [], 0
    for a, b, mark in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a >= done:
            out += text[done:a], mark
            done = b
        elif b > done:
            done = b
    return "".join([*out, text[done:]])
