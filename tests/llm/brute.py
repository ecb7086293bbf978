"""Plain versions of the operators, for small tables: every document against every other."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text: str) -> list[bytes]:
    return WORDS.findall((text or "").encode().lower())


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kept_lines(docs: list[tuple], least: int = 20) -> dict:
    """Kept text by identifier of (identifier, text) rows with distinct identifiers."""
    first: dict[str, tuple] = {}
    for key, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        for at, line in enumerate(text.split("\n") if text else []):
            if line.strip(" \t"):
                first.setdefault(line, (key is None, key, at))
    near = set()
    for line, place in first.items():
        for other, earlier in first.items():
            if (
                earlier < place and min(len(line), len(other)) >= least
                and abs(len(line) - len(other)) <= 1 and edits(line, other) == 1
            ):
                near.add(line)
    out = {}
    for key, text in docs:
        lines = text.split("\n") if text else []
        keep = [
            line for at, line in enumerate(lines)
            if not line.strip(" \t") or (first[line] == (key is None, key, at) and line not in near)
        ]
        out[key] = "\n".join(keep)
    return out


def bag(text: str, size: int = 5) -> Counter:
    found = words(text)
    if 0 < len(found) < size:
        return Counter([tuple(found)])
    return Counter(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def classes(docs: list[tuple], least: float = 0.8) -> dict:
    """Smallest identifier of each document's class."""
    bags = {key: bag(text) for key, text in docs}
    parent = {key: key for key in bags}

    def root(key):
        while parent[key] != key:
            key = parent[key]
        return key

    keys = sorted(bags)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bags[a] and bags[b] and similarity(bags[a], bags[b]) >= least:
                one, two = sorted((root(a), root(b)))
                parent[two] = one
    return {key: root(key) for key in keys}


def tiled(item: list, text: list, least: int = 5) -> int:
    """Words of the item that greedy tiles cover; the longest and leftmost first."""
    item_free, text_free = [True] * len(item), [True] * len(text)
    covered = 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (
                    i + n < len(item) and j + n < len(text) and item_free[i + n] and text_free[j + n]
                    and item[i + n] == text[j + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        item_free[i : i + n] = text_free[j : j + n] = [False] * n
        covered += n


def without_repeats(docs: list[tuple], window: int = 50) -> dict:
    """(bytes, removed, spans, kept) by identifier, for rows with distinct identifiers."""
    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        strings = [raw[i : i + window] for i in range(len(raw) - window + 1)]
        for i, string in enumerate(strings):
            if string in seen:
                gone[i : i + window] = b"\1" * window
        seen.update(strings)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[key] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out
