import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import tables
from vitrine.llm import alignment, bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(bpe.byte_symbols())}
    names = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    return one, sentencepiece.SentencePieceProcessor(model_file=B), byte_of, names


def tokens(models, text):
    """(id, bytes) lists of both, or nothing."""
    one, other, byte_of, names = models
    if not text:
        return [], []
    a = [(i, bytes(byte_of[c] for c in names[i])) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in other.encode(text):
        piece = other.id_to_piece(i)
        is_byte = len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")
        b.append((i, bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()))
    wanted = (" " + text).encode()
    same = all(b"".join(raw for _, raw in side) == wanted for side in (a, b))
    return (a, b) if same else ([], [])


def groups(models, text):
    """By walking both lists: a group closes where both have come equally far."""
    a, b = tokens(models, text)
    out, left, right, x, y, i = [], [], [], 0, 0, 0
    for token, raw in a:
        left.append(token)
        x += len(raw)
        while y < x:
            right.append(b[i][0])
            y += len(b[i][1])
            i += 1
        if x == y:
            out.append((left, right))
            left, right = [], []
    return out, len(a), len(b)


def brute(models, rows):
    found = [groups(models, text) for _, text in rows]
    held = Counter(p for g, _, _ in found for p in {(x, y) for a, b in g for x in a for y in b})
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    for (key, _), (g, n_a, n_b) in zip(rows, found, strict=True):
        links = Counter((x, y) for a, b in g for x in a for y in b)
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (key, n_a, n_b, len(g), sum(links.values()),
               sum(n for p, n in links.items() if held[p] == most[p[0]]),
               sum(n * held[p] for p, n in links.items()),
               hashlib.sha256(text.encode()).hexdigest() if g else "")


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_as_brute_force(spark, sf_dir, models):
    pick = random.Random(6).choice
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "12", "é", "!", "<|endoftext|>", "<s>", "<0x41>", "▁", "\x85",
             "日本", "🙂", "\r\n", ");\r", "\r", "½", "\x00", "́", "unbelievable", "zzzz", "ﬁ"]
    made = [(1000 + i, "".join(pick(parts) for _ in range(i % 40))) for i in range(300)]
    rows = [*tables.ODD, *tables.sample(spark, sf_dir), *made, *[(5000 + i, tables.PROSE) for i in range(50)]]
    docs = tables.docs(spark, rows).repartition(5)
    got = alignment.link_statistics(docs, A, B).collect()
    want = list(brute(models, rows))
    assert any(w[1] == 0 and t for w, (_, t) in zip(want, rows, strict=True))  # texts that B changes
    assert order(got) == order(want)


def test_groups_and_pair_counts(spark, models):
    rows = [(1, "Unbelievable, isn't it?"), (2, "Unbelievable tales"), (3, None), (4, "")]
    docs = tables.docs(spark, rows)
    for row in alignment.align(docs, A, B).collect():
        want, n_a, n_b = groups(models, dict(rows)[row.doc_id])
        assert (len(row.a_ids), len(row.b_ids)) == (n_a, n_b)
        a, b = [0, *row.a_cuts], [0, *row.b_cuts]
        assert [(row.a_ids[a[i]:a[i + 1]], row.b_ids[b[i]:b[i + 1]]) for i in range(len(a) - 1)] == want
    held = Counter(p for _, t in rows for p in {(x, y) for a, b in groups(models, t)[0] for x in a for y in b})
    got = alignment.pair_counts(docs, A, B).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in got} == dict(held)
    assert all(r.best == (r.n_docs == max(n for (x, _), n in held.items() if x == r.a_id)) for r in got)


def test_empty_tables(spark):
    assert alignment.link_statistics(tables.docs(spark, []), A, B).collect() == []
    rows = alignment.link_statistics(tables.docs(spark, [(1, None), (2, "")]), A, B).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
    assert alignment.align(tables.docs(spark, []), A, B).collect() == []


def test_a_million_characters(spark):
    noise = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    rows = [(1, noise), (2, "x" * 1_000_000), (3, " " * 100_000)]
    got = alignment.link_statistics(tables.docs(spark, rows), A, B)
    sums = {r.doc_id: r for r in got.withColumn("ok", F.col("n_links") >= F.greatest("n_a", "n_b")).collect()}
    assert all(sums[i].ok and sums[i].n_a > 0 and sums[i].n_best <= sums[i].n_links for i in (1, 2, 3))


def test_large_groups_as_expanded(monkeypatch):
    import numpy as np

    one = alignment.Aligned.of([1, 2, 1, 3], [7, 8, 7], [1, 1, 1, 1], [2, 1, 1, 1, 1, 1, 1, 1, 3])
    other = alignment.Aligned(*map(np.array, ([1, 2, 1, 3] * 30, [8, 9] * 40, [500], [120], [80])))
    for text in (one, other):
        part = np.zeros(len(text.ends), np.int64)
        expanded = text.links(part)
        monkeypatch.setattr(alignment, "EXPANDED_LINKS", 1)
        assert all((x == y).all() for x, y in zip(text.links(part), expanded, strict=True))
        monkeypatch.undo()
    assert expanded[2].sum() == 120 * 80 and len(expanded[1]) == 6


def test_units_as_whole_texts(monkeypatch, spark, sf_dir):
    odd = "(x);\r\ny};\r \r\rz)\ra.\x1cb \x1d c\n\n\n d\t\te  f\r\n\u2028g\u3000h "
    rows = [*tables.ODD, *tables.sample(spark, sf_dir), (1, odd), (2, " "), (3, "▁ a b"), (4, "a b ")]
    texts = [t for _, t in rows]
    models = alignment.Models(*alignment.Models.read(A, B))
    monkeypatch.setattr(alignment, "KEPT_UNITS", 100)
    parts = alignment.Units(models)
    for text in texts:  # one at a time, so that units are forgotten and learned again
        used, many = parts.of([text])
        whole = models.align(" " + text) if text else None
        marked = whole and whole.group_texts(models.marks, len(models.b_bytes), len(models.a_bytes))
        kept = parts.numbers[used, 4].all()
        assert many[0] == len(used) and (len(used) == 0 or bool(kept) == (whole is not None))
        if whole is not None:
            assert ";".join(parts.texts[u] for u in used) == "".join(marked)[:-1]
            assert (parts.numbers[used, :3].sum(0) == [len(whole.a), len(whole.b), len(whole.ends)]).all()
        parts.forget(used)
    assert len(models.units(" " + tables.PROSE)) == len(tables.PROSE.split())
