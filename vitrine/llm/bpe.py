"""Byte-level BPE encoding and decoding.

Merging: the symbols of a pre-token form a doubly linked list, and a priority queue holds the merge
rank and position of each adjacent pair. The best entry is taken, entries whose pair no longer stands
there are skipped, and the new neighbours are pushed. Decoding concatenates the vocabulary strings and
reads their bytes as UTF-8, with replacement characters where they are none.

Texts are independent, so the work is one pass without a shuffle. The tokenizer's file is read on the
driver (1.5 MB; its size does not grow with the data) and sent to the tasks once.

Defined results: a null or empty text has no tokens and decodes to an empty text; rows with equal ids,
null ids and repeated rows are encoded one by one; further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vitrine.llm import textops

CACHED_WORDS = 50_000
CACHED_PIECES = 300_000
CACHED_CHARS = 64

# The pre-token pattern of byte-level BPE, white space spelled out as the Unicode property.
PRETOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else one from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What is needed from a tokenizer file (``tokenizers`` JSON with a byte-level BPE model)."""

    def __init__(self, specification: dict):
        model, before = specification["model"], specification["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and before["type"] == "ByteLevel"
            and not before["add_prefix_space"]
            and before.get("use_regex", True)
            and not specification["normalizer"]
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"]
                        for t in specification["added_tokens"])
        )
        if not plain:
            raise ValueError("only plain byte-level BPE without normalizer or prefix space is supported")
        ids = model["vocab"]
        if max(ids.values()) >= 1 << 20:
            raise ValueError("ids must be below 2 ** 20")
        self.special = {t["content"]: t["id"] for t in specification["added_tokens"]}
        self.first = [ids[c] for c in byte_symbols()]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left] << 20 | ids[right]] = rank << 20 | ids[left + right]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.strings = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for content, token in (*ids.items(), *self.special.items()):
            known = all(c in byte_of for c in content)
            self.strings[token] = bytes(byte_of[c] for c in content) if known else content.encode()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))


def merge_symbols(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Merge adjacent symbols, always the pair of lowest rank and of those the leftmost.

    ``merges`` maps a pair (left << 20 | right) to (rank << 20 | merged symbol); the queue holds
    that merge << 32 | position.
    """
    size = len(symbols)
    find, queue = merges.get, []
    for at in range(size - 1):
        merge = find(symbols[at] << 20 | symbols[at + 1])
        if merge is not None:
            queue.append(merge << 32 | at)
    if not queue:
        return symbols
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heapq.heapify(queue)
    take, push = heapq.heappop, heapq.heappush
    while queue:
        entry = take(queue)
        at = entry & 0xFFFFFFFF
        other = after[at]
        if symbols[at] < 0 or other >= size:
            continue  # stale: merged into its left neighbour, or nothing follows any more
        merge = entry >> 32
        if find(symbols[at] << 20 | symbols[other]) != merge:
            continue  # stale: another pair stands here by now
        made = symbols[at] = merge & 0xFFFFF
        symbols[other] = -1
        following = after[at] = after[other]
        if following < size:
            before[following] = at
            merge = find(made << 20 | symbols[following])
            if merge is not None:
                push(queue, merge << 32 | at)
        leading = before[at]
        if leading >= 0:
            merge = find(symbols[leading] << 20 | made)
            if merge is not None:
                push(queue, merge << 32 | leading)
    return [s for s in symbols if s >= 0]


class Recent:
    """A dictionary that forgets what was not asked for lately; two halves of bounded size."""

    def __init__(self, bound: int):
        self.bound = bound
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= CACHED_CHARS:
            if len(self.young) >= self.bound:
                self.old = dict(self.young)
                self.young.clear()  # in place: callers hold its get
            self.young[key] = value


class Encoder:
    """Encodes whole texts to packed 32-bit ids; keeps the ids of words and pieces seen lately.

    Between two characters that are not white space a single space always begins a pre-token, so a
    text cut there may be encoded piece by piece. Texts with other white space around their spaces
    go through the pattern whole. Sent without what it has kept; a broadcast encoder stays with its
    Python worker, so the next task finds the pieces of the tasks before.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(PRETOKENS).findall
        marks = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.words, self.pieces = Recent(CACHED_WORDS), Recent(CACHED_PIECES)

    def __reduce__(self):
        return Encoder, (self.vocabulary,)

    def _merged(self, word: str) -> bytes:
        first = self.vocabulary.first
        return array("i", merge_symbols([first[b] for b in word.encode()], self.vocabulary.merges)).tobytes()

    def _word(self, word: str) -> bytes:
        # a word after a space is kept as the piece that it is
        kept, key = (self.pieces, word[1:]) if word[0] == " " and len(word) > 1 else (self.words, word)
        packed = kept.young.get(key)
        if packed is None:
            packed = kept.old.get(key)
            if packed is None:
                packed = self._merged(word)
            kept.put(key, packed)
        return packed

    def _pattern(self, text: str) -> bytes:
        return b"".join(map(self._word, self.find(text)))

    def _plain(self, text: str) -> bytes:
        head, *pieces = text.split(" ")
        if not pieces or not head or head[-1].isspace():
            return self._pattern(text)
        out = list(map(self.pieces.young.get, pieces))
        for at in [at for at, packed in enumerate(out) if packed is None]:
            piece = pieces[at]
            if not piece or piece[0].isspace() or piece[-1].isspace():
                return self._pattern(text)
            out[at] = self._piece(piece)
        return self._pattern(head) + b"".join(out)

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            return self._word(" " + piece)  # one pre-token, and no special token is read here
        packed = self.pieces.young.get(piece) or self.pieces.old.get(piece)
        if packed is None:
            packed = self._pattern(" " + piece)
        if len(piece.split()) == 1:
            self.pieces.put(piece, packed)
        return packed

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        at = 0
        for mark in self.cut.finditer(text) if self.cut else ():
            out += self._plain(text[at : mark.start()]), self._special(mark.group())
            at = mark.end()
        return b"".join([*out, self._plain(text[at:])])

    def _special(self, content: str) -> bytes:
        return np.int32(self.vocabulary.special[content]).tobytes()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.strings.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """``id_col``, ``token_ids`` array<int> and ``decoded`` string, one row per row of ``docs``. With ``digest``
    the decoded text is left in the task and ``decoded_sha256``, lowercase hex, returned in its place."""
    last = "decoded_sha256" if digest else "decoded"
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Encoder(Vocabulary.read(tokenizer_path)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # merging makes many short lists and no cycles
        try:
            yield from coded(shared.value, batches)
        finally:
            gc.enable()

    def coded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, text_col):
            packed, decoded = [], []
            for text in batch.column(text_col).to_pylist():
                ids = encoder.encode(text or "")
                packed.append(ids)
                text = encoder.decode(np.frombuffer(ids, np.int32).tolist())
                decoded.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), lists, pa.array(decoded, pa.string())],
                names=[id_col, "token_ids", last],
            )

    schema = f"`{id_col}` {id_type}, token_ids array<int>, {last} string"
    return docs.select(id_col, text_col).mapInArrow(work, schema)
