import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import tables
from vitrine.llm import jaccard_join


def brute_sets(rows):
    out = []
    for _, text in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", folded)
        found = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        out.append(found or ({tuple(words)} if words else set()))
    return out


def brute(rows):
    """All with all; component by union-find."""
    sets = brute_sets(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v or 0) for v in r))


def made(seed, families=12, copies=12):
    """Families of texts at about the threshold, all with the same passage in half of them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.choices(words, k=25)
    rows = []
    for family in range(families):
        base = rng.choices(words, k=rng.choice([6, 20, 60, 150]))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(text) // 16))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if family % 2:
                text[len(text) // 2 : len(text) // 2] = passage
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("heavy, rounds", [(48, 4), (3, 1), (10**9, 0)])
def test_as_brute_force(spark, sf_dir, monkeypatch, heavy, rounds):
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    monkeypatch.setattr(jaccard_join, "SEEN_IN_TASK", 1)
    monkeypatch.setattr(jaccard_join, "CELL_SETS", 7)
    monkeypatch.setattr(jaccard_join, "FANOUT", 3)
    monkeypatch.setattr(jaccard_join, "WORTH_A_ROUND", 10**9)
    keep = jaccard_join.set_classes
    monkeypatch.setattr(jaccard_join, "set_classes", lambda *a: keep(*a, rounds))
    rows = [*tables.ODD, *[(1000 + i, t) for i, t in made(heavy % 97 + rounds)]]
    rows += [(k + 5000, t) for k, t in tables.sample(spark, sf_dir, 40)]
    got = jaccard_join.similar_documents(tables.docs(spark, rows).repartition(6)).collect()
    want = brute(rows)
    assert order(got) == order(want)
    assert len({c for k, _, c in want}) < len(want) - 60


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert order(jaccard_join.similar_documents(docs).collect()) == order(brute(rows))


def test_empty_tables(spark):
    assert jaccard_join.similar_documents(tables.docs(spark, [])).collect() == []
    got = jaccard_join.similar_documents(tables.docs(spark, [(1, None), (2, " \n"), (3, "")])).collect()
    assert order(got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 40, 200)
    values = [np.unique(np.concatenate([base[: rng.integers(20, 200)], rng.integers(0, 1 << 40, rng.integers(1, 60))]))
              for _ in range(150)]
    sizes = np.array([len(v) for v in values])
    same = np.arange(150) % 5
    limit = Fraction(4, 5)
    tree = jaccard_join.Tree(jaccard_join.signatures(np.concatenate(values), sizes, 256), sizes, same)
    found = {(i, j) for x, y in tree.pairs(tree, limit) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    wanted = {(i, j) for j in range(150) for i in range(j)
              if same[i] != same[j] and jaccard_join.similar(values[i], values[j], limit)}
    assert wanted and wanted <= found and all(i < j and same[i] != same[j] for i, j in found)
    half = jaccard_join.Tree(jaccard_join.signatures(np.concatenate(values[:9]), sizes[:9], 256), sizes[:9], same[:9])
    found = {(i, j) for x, y in half.pairs(tree, limit) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert {(i, j) for i, j in wanted if i < 9} <= found


def test_one_shingle_in_all_documents(spark):
    """A passage that all of 3,000 documents hold does not bring all of them together."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) + " " + passage) for i in range(3000)]
    got = jaccard_join.similar_documents(tables.docs(spark, rows).repartition(8)).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 66 for r in got)


def test_a_million_characters(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, long), (2, long + " and some more words at the end"), (3, "x" * 1_000_000)]
    got = jaccard_join.similar_documents(tables.docs(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_wide_bitmaps_never_drop_a_similar_pair():
    rng = np.random.default_rng(5)
    limit = Fraction(4, 5)
    dropped = 0
    for _ in range(400):
        base = rng.integers(-(2**62), 2**62, int(rng.integers(1, 300)))
        kept = base[rng.random(len(base)) < rng.choice([0.3, 0.8, 0.9, 1.0])]
        x = np.unique(base)
        y = np.unique(np.append(kept, rng.integers(-(2**62), 2**62, int(rng.integers(1, 40)))))
        possible = jaccard_join.wide_possible(
            len(x), jaccard_join.wide_bitmap(x), len(y), jaccard_join.wide_bitmap(y), limit
        )
        assert possible or not jaccard_join.similar(x, y, limit)
        dropped += not possible
    assert dropped > 100
