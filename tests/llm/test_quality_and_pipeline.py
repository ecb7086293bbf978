import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute, tables
from vitrine.llm import quality, queries, textops
from vitrine.session import materialized

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def model(spark, labels):
    return quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels.filter(~queries.held_out()))


def test_held_out_accuracy(spark, labels):
    scored = queries.op10_quality(spark, FOLDER).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    held = [r for r in scored if r.held_out]
    assert len(held) > 20 and np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_scores_of_odd_rows(spark, model):
    got = quality.with_score(tables.docs(spark, tables.ODD).drop("score"), model).collect()
    assert Counter((r.doc_id, r.text, r.row) for r in got) == Counter((k, t, "x row") for k, t in tables.ODD)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert len({r.score for r in got if r.text == tables.PROSE}) == 1
    assert quality.score(tables.docs(spark, []), model).collect() == []


def test_an_existing_score_column_is_replaced(spark, model):
    got = quality.with_score(tables.docs(spark, [(1, "a text")]), model)
    assert got.columns.count("score") == 1 and 0 <= got.first().score <= 1


def test_no_usable_label(spark):
    docs = tables.docs(spark, tables.ODD)
    none = spark.createDataFrame([(1, None), (None, 1), (6, 7)], "doc_id long, quality int")
    untrained = quality.train(docs, none)
    assert {r.score for r in quality.score(docs, untrained).collect()} == {0.5}


def test_features_are_shares():
    texts = pa.array(["One two, two!! THREE 4", None, " \n"])
    owner, slots, values = quality.features(*textops.text_bytes(texts))
    assert np.allclose(np.bincount(owner, values), [5 * quality.SCALE, quality.SCALE, quality.SCALE])
    assert slots.max() < quality.DIMENSIONS


def test_pipeline_as_brute_force(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = materialized(stage(spark, docs, sf_dir))
        kept[name] = (before, docs)
        assert name == "bpe" or docs.columns == columns

    def after(name):
        return {r.doc_id: r.text for r in kept[name][1].select("doc_id", "text").collect()}

    before = kept["quality_classifier"][0]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trained = quality.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~queries.held_out()))
    good = set()
    for key, text in before.items():
        _, slots, values = quality.features(*textops.text_bytes(pa.array([text], pa.string())))
        logit = sum(trained[s] * v for s, v in zip(slots.tolist(), values.tolist(), strict=True)) + trained[-1]
        if 1 / (1 + np.exp(-logit)) >= 0.7:
            good.add(key)
    assert set(after("quality_classifier")) == good

    before = kept["line_dedup"][0]
    lines = brute.kept_lines(list(before.items()))
    assert after("line_dedup") == {k: t for k, t in lines.items() if t.strip() or t == before[k]}

    before = kept["minhash_near_dedup"][0]
    of = brute.classes(list(before.items()))
    assert set(after("minhash_near_dedup")) == {k for k, c in of.items() if k == c}

    before = kept["decontamination"][0]
    items = [brute.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seeds = [{tuple(item[i : i + 5]) for i in range(len(item) - 4)} for item in items]
    clean = set()
    for key, text in before.items():
        found = brute.words(text)
        own = {tuple(found[i : i + 5]) for i in range(len(found) - 4)}
        hit = [item for item, s in zip(items, seeds, strict=True) if s and len(s & own) >= 0.5 * len(s)]
        if not any(brute.tiled(item, found) >= 0.8 * len(item) for item in hit):
            clean.add(key)
    assert set(after("decontamination")) == clean

    before, coded = kept["bpe"]
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in before.items()}
    assert {r.doc_id: r.token_ids for r in coded.collect()} == want


@pytest.mark.parametrize("number", range(4))
def test_stages_take_odd_tables(spark, sf_dir, number):
    name, stage = corpus_pipeline.STAGES[number]
    for rows in (tables.ODD, []):
        docs = tables.docs(spark, rows)
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        found = Counter((r.doc_id, r.text) for r in got.collect())
        assert not found - Counter(rows)
        # no stage drops a document of its own for having no identifier
        own = rows[-1:]
        assert name == "quality_classifier" or all(found[row] for row in own)


def test_last_stage_takes_odd_tables(spark, sf_dir):
    name, stage = corpus_pipeline.STAGES[-1]
    for rows in (tables.ODD, []):
        got = stage(spark, tables.docs(spark, rows), sf_dir)
        assert got.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"]
        found = got.collect()
        assert Counter(r.doc_id for r in found) == Counter(key for key, _ in rows)
        assert all(r.n_tokens == len(r.token_ids) for r in found)
