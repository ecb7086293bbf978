import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import tables
from vitrine.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_and_texts_as_the_library(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    pick = random.Random(4).choice
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'LL", "12", "é", "!", "<|endoftext|>", "<|", "\x85", "\x1c",
             "日本", "🙂", "\r\n", "Ⅷ", "½", "́"]
    made = [(1000 + i, "".join(pick(parts) for _ in range(i % 40))) for i in range(400)]
    rows = [*tables.ODD, *tables.sample(spark, sf_dir), *made]
    got = bpe.encode_decode(tables.docs(spark, rows), PATH).collect()
    texts = {}
    for key, text in rows:
        texts.setdefault(key, []).append(text or "")
    assert len(got) == len(rows)
    for row in got:
        choices = [library.encode(t, add_special_tokens=False).ids for t in texts[row.doc_id]]
        assert row.token_ids in choices
        assert row.decoded == library.decode(row.token_ids, skip_special_tokens=False)


def test_digests_of_decoded_texts(spark):
    docs = tables.docs(spark, [r for r in tables.ODD if r[0] is not None])
    texts = bpe.encode_decode(docs, PATH).withColumn("sha", F.sha2("decoded", 256))
    digests = bpe.encode_decode(docs, PATH, digest=True)
    assert sorted(map(tuple, texts.select("doc_id", "token_ids", "sha").collect())) == sorted(
        map(tuple, digests.select("doc_id", "token_ids", "decoded_sha256").collect())
    )


def test_merging_skips_stale_entries():
    ids = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    pairs = {(0, 1): (1, 2), (1, 0): (0, 3), (2, 0): (2, 4)}
    merges = {left << 20 | right: rank << 20 | made for (left, right), (rank, made) in pairs.items()}
    assert bpe.merge_symbols([0, 1, 0], merges) == [ids["a"], ids["ba"]]
    assert bpe.merge_symbols([0, 1, 1], merges) == [ids["ab"], ids["b"]]
    assert bpe.merge_symbols([], merges) == []


def test_each_word_is_kept_once():
    encoder = bpe.Encoder(bpe.Vocabulary.read(PATH))
    text = "so brontelly, brontelly vankerish vankerish. brontelly!"
    library = Tokenizer.from_file(PATH)
    assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    assert set(encoder.pieces.young) == {"brontelly", "brontelly,", "vankerish", "vankerish.", "brontelly!"}
    assert set(encoder.words.young) == {"so", ",", ".", "!"}


def test_empty_table(spark):
    assert bpe.encode_decode(tables.docs(spark, []), PATH).collect() == []


def test_round_trip_of_a_very_long_word(spark):
    text = "ab" * 60_000 + " end"
    row = bpe.encode_decode(tables.docs(spark, [(1, text)]), PATH).withColumn("n", F.size("token_ids")).first()
    assert row.decoded == text and 0 < row.n < len(text)
