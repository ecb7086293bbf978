import random
import time
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute, tables
from vitrine.llm import bagminhash, components, exact_dedup, line_dedup, suffix_dedup, textops


def test_exact_groups(spark, sf_dir):
    rows = [*tables.ODD, (20, "a  b"), (21, "a\t\nb"), (22, "a b"), (23, " a b"), *[(i, "hot") for i in range(500, 560)]]
    rows += [(100 + k, t) for k, t in tables.sample(spark, sf_dir)]
    got = exact_dedup.exact_groups(tables.docs(spark, rows), runs=16, fan_in=4).collect()
    import re

    norm = [(k, brute.sha(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""))) for k, t in rows]
    size = Counter(h for _, h in norm)
    least = {}
    for k, h in norm:
        if k is not None:
            least[h] = min(k, least.get(h, k))
    want = Counter((k, least.get(h), size[h], k == least.get(h), h) for k, h in norm)
    assert Counter(map(tuple, got)) == want


def test_exact_groups_of_null_identifiers_and_empty_table(spark):
    got = exact_dedup.exact_groups(tables.docs(spark, [(None, "a"), (None, "a")])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in got] == [(None, 2, True)] * 2
    assert exact_dedup.exact_groups(tables.docs(spark, [])).collect() == []


def lines_table():
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(18, 40))) for _ in range(40)]
    rows = []
    for key in range(60):
        lines = []
        for _ in range(6):
            line = rnd.choice(base)
            at = rnd.randrange(len(line))
            change = rnd.randrange(5)
            if change == 1:
                line = line[:at] + rnd.choice("abcdeé") + line[at + 1 :]
            elif change == 2:
                line = line[:at] + line[at + 1 :]
            elif change == 3:
                line = line[:at] + rnd.choice("xyzü") + line[at:]
            lines.append(line)
        rows.append((key, "\n".join([*lines, "", "tiny"])))
    return rows


def test_lines_as_brute_force(spark):
    rows = lines_table() + [(None, lines_table()[3][1]), (90, None), (91, ""), (92, "\n \n\t\n")]
    got = line_dedup.dedup_lines(tables.docs(spark, rows)).collect()
    want = brute.kept_lines(rows)
    assert {r.doc_id: r.kept_text for r in got} == want
    assert sum(r.n_near for r in got) > 20
    assert {r.doc_id: r.n_lines for r in got}[91] == 0


def test_lines_of_hot_and_long_texts(spark):
    hot = [(i, f"the same opening of all documents\nnumber {i:05d} of a counted series of lines") for i in range(300)]
    long = "very long line " * 4000
    rows = [*hot, (400, long), (401, long[:-2] + "X "), (402, long + "!")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(tables.docs(spark, rows)).collect()}
    assert [k for k, r in got.items() if "opening" in r.kept_text] == [0]
    assert {k for k in range(300) if "number" in got[k].kept_text} == {
        k for k in range(300)
        if not any(brute.edits(f"{k:05d}", f"{j:05d}") == 1 for j in range(k))
    }
    assert [bool(got[k].kept_text) for k in (400, 401, 402)] == [True, False, False]


def test_one_edit_as_brute_force(spark):
    rnd = random.Random(5)
    pairs = [("", ""), ("", "a"), ("a", ""), ("ab", "ba"), ("x" * 64, "x" * 65), ("x" * 128, "x" * 129), ("🙂" * 65, "🙂" * 64)]
    for _ in range(400):
        a = "".join(rnd.choice("abé🙂") for _ in range(rnd.choice([1, 5, 63, 64, 65, 127, 128, 129, 140])))
        b = a
        for _ in range(rnd.choice([0, 1, 1, 1, 2])):
            at = rnd.randrange(len(b) + 1)
            b = rnd.choice([b[:at] + b[at + 1 :], b[:at] + "b" + b[at:], b[:at] + "z" + b[at + 1 :]])
        pairs.append((a, b))
    table = spark.createDataFrame(pairs, "a string, b string")
    for row in table.select("a", "b", line_dedup.one_edit(table.a, table.b).alias("one")).collect():
        near = abs(len(row.a) - len(row.b)) <= 1
        assert row.one == (near and brute.edits(row.a, row.b) == 1), row


def test_lines_of_a_million_characters(spark):
    rnd = random.Random(3)
    long = "".join(rnd.choices("abcdefghij é🙂", k=1_000_000))
    rows = [
        (1, long), (2, long[:300_000] + "#" + long[300_001:]), (3, long[:600_001] + long[600_002:]),
        (4, long[:300_000] + "##" + long[300_000:]), (5, "\n".join(f"line {i} of many" for i in range(30_000)) + "\nline 7 of many"),
    ]
    began = time.monotonic()
    got = line_dedup.dropped_lines(tables.docs(spark, rows)).collect()
    assert sorted((r.id, r.near) for r in got if r.id < 5) == [(2, True), (3, True)]
    assert [r.at for r in got if r.id == 5 and not r.near] == [30_000]
    assert time.monotonic() - began < 120  # some seconds of work; a square of the length takes hours


def test_lines_keep_all_columns_and_odd_rows(spark):
    got = line_dedup.without_repeated_lines(tables.docs(spark, tables.ODD))
    assert got.columns == ["doc_id", "text", *tables.CLASHES]
    found = Counter((r.doc_id, r.text, r.row) for r in got.collect())
    # rows that repeat an identifier and its text share their lines, which the first row keeps
    gone = [(5, tables.PROSE), (5, tables.PROSE), (None, tables.PROSE)]
    want = Counter((k, t, "x row") for k, t in tables.ODD) - Counter((k, t, "x row") for k, t in gone)
    assert found == want
    assert line_dedup.without_repeated_lines(tables.docs(spark, [])).collect() == []


def near_table():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(12):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 120))]
        for copy in range(rnd.randint(1, 5)):
            words = list(text)
            for _ in range(copy * 2):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((20_000 + 100 * group + copy, " ".join(words)))
    return rows


def chain():
    """Each text is near to the next, the first isn't near to the last."""
    words = [f"c{i}" for i in range(200)]
    out = []
    for step in range(6):
        out.append((5000 + (step * 7) % 6, " ".join(words)))
        words = words[:]
        for i in range(step * 3, step * 3 + 3):
            words[i * 9] = f"new{i}"
    return out


def test_near_duplicates_as_brute_force(spark, sf_dir):
    known = [r for r in tables.ODD if r[0] is not None and r[0] != 5] + [(5, tables.PROSE)]
    rows = [*near_table(), *chain(), *known, *[(9000 + k, t) for k, t in tables.sample(spark, sf_dir, 120)]]
    got = bagminhash.near_duplicates(tables.docs(spark, [*rows, (5, tables.PROSE), (None, tables.PROSE)])).collect()
    want = brute.classes(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) + 2
    size = Counter(want.values())
    assert all(r.class_size == size[r.class_id] for r in got if r.doc_id is not None)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_duplicates_of_a_large_group(spark):
    rnd = random.Random(1)
    words = [f"h{i}" for i in range(150)]
    rows = []
    for i in range(400):
        text = list(words)
        text[rnd.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(text)))
    got = bagminhash.near_duplicates(tables.docs(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.n_links for r in got) < 400 * 30


@pytest.mark.parametrize(("a", "b"), [({1: 3, 2: 1, 3: 9}, {1: 5, 2: 1, 4: 2}), ({1: 40}, {1: 25, 2: 3})])
def test_signatures_estimate_the_weighted_similarity(a, b):
    want = brute.similarity(Counter(a), Counter(b))
    equal = []
    for trial in range(60):
        columns = []
        for bag in (a, b):
            keys = textops.mix(np.array(sorted(bag), np.uint64) + np.uint64(1000 * trial))
            counts = np.array([bag[k] for k in sorted(bag)], np.int64)
            columns.append(bagminhash.signatures(keys, counts, np.zeros(len(keys), np.int64), 1))
        equal.append((columns[0] == columns[1]).mean())
    assert abs(np.mean(equal) - want) < 0.03


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        one, two = sorted((root(a), root(b)))
        parent[two] = one
    table = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.class_id for r in components.components(table).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_suffix_array_and_prefixes():
    rnd = random.Random(2)
    pieces = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 90))) for _ in range(40)]
    pieces += [pieces[0], pieces[1][:30], "a" * 200, "a" * 199]
    symbols = np.frombuffer("".join(pieces).encode(), np.uint8).astype(np.int64) + 1
    ends = np.cumsum([len(p) for p in pieces])
    left = np.repeat(ends, [len(p) for p in pieces]) - np.arange(len(symbols))
    text = "".join(pieces)
    suffixes = [(text[i : i + n], i) for i, n in enumerate(left.tolist())]
    order = suffix_dedup.suffix_array(symbols, left)
    assert order.tolist() == [i for _, i in sorted(suffixes)]
    shared = suffix_dedup.common_prefixes(symbols, left, order, 50)
    for before, here in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        a, b = suffixes[before][0], suffixes[here][0]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[here] == min(n, 50)


def repeats_table():
    rnd = random.Random(9)

    def text(n):
        return "".join(rnd.choice("abcdefgh éß") for _ in range(n))

    passages = [text(n) for n in (49, 50, 51, 80, 400)]
    rows = []
    for key in range(60):
        parts = [text(rnd.randint(0, 60)) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            passage = rnd.choice(passages)
            cut = rnd.randint(0, 20)
            parts.insert(rnd.randrange(len(parts) + 1), passage[cut:] if rnd.random() < 0.4 else passage)
        rows.append((rnd.randrange(10**9), "".join(parts)))
    return [*rows, (-1, "ab" * 300), (-2, "a" * 400), (-3, "a" * 120), (-4, "ab" * 90), (-5, None), (-6, "")]


@pytest.mark.parametrize("shard_bytes", [4 << 20, 700])
def test_repeats_as_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    rows = repeats_table()
    head = "one edge that all of them share, long enough to hold an anchor of its own "
    rows += [(2 * 10**9 + i, f"{head}{i % 7}{i % 5}" + f" and {i} more" * 3) for i in range(80)]
    got = suffix_dedup.remove_repeats(tables.docs(spark, rows).repartition(5)).collect()
    want = brute.without_repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_repeats_of_odd_rows(spark):
    rows = [r for r in tables.ODD if r[0] != 5]
    got = suffix_dedup.remove_repeats(tables.docs(spark, [*rows, (5, tables.PROSE), (5, tables.PROSE)])).collect()
    want = brute.without_repeats([*[r for r in rows if r[0] is not None], (5, tables.PROSE)])
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert suffix_dedup.remove_repeats(tables.docs(spark, [])).collect() == []
