import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = ["", None, "one two", "one two", " lead  and trail ", "tab\tnew\n\nline \n x", "naïve 你好 world　wide", "a  b  c", "word " * 3000, "x" * 9000, "<|endoftext|> tail", "it's we're 12 345", " " * 5000 + "x", "\n\t" * 900_000]


def _whole(pieces, texts):
    rows = pieces.orderBy("doc_id", "start").toPandas()
    for k, text in enumerate(texts):
        ids, at = _ids(text), 0
        own = rows[rows.doc_id == k]
        assert (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return rows


def test_every_id_once_and_sequences_without_gaps(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("offset", F.lit("clash")).withColumn("length", F.lit(1))
    rows = _whole(packing.pack_texts(docs.coalesce(1), PATH), TEXTS)
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all()
        n = s.length.sum()
        assert n <= 1024 and (n == 1024 or n & (n - 1) == 0)


def test_many_partitions_share_no_sequence(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('some words ', CAST(id % 37 AS INT)) AS text").repartition(7)
    out = packing.pack_texts(docs, PATH)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct(F.col("sequence_id").bitwiseAND(-(1 << 40))).alias("p")).filter("n > 1024 OR p > 1").count() == 0
    assert out.select(F.sum("length")).first()[0] == sum(len(_ids("some words " * (k % 37))) for k in range(37)) * (400 // 37) + sum(len(_ids("some words " * (k % 37))) for k in range(400 % 37))


def test_all_three_limits_hold(spark):
    rows = [(k, list(range(1, 2 + (k * 37) % 300)), (k * 13) % 90) for k in range(500)]
    examples = spark.createDataFrame(rows, "doc_id long, ids array<int>, prompt_tokens int").coalesce(2)
    for cut in (True, False):
        limits = packing.Limits(tokens=512, segments=5, loss_tokens=300, waiting=64, cut=cut)
        out = packing.pack_examples(examples, limits).toPandas()
        per = out.groupby("sequence_id").agg(n=("length", "sum"), s=("segment", "count"), loss=("loss_tokens", "sum"))
        assert per.n.max() <= 512 and per.s.max() <= 5 and per.loss.max() <= 300
        assert out.length.sum() == sum(len(r[1]) for r in rows)
        if not cut:
            assert len(out) == len(rows)


def test_without_cuts_too_long_examples_are_returned_unplaced(spark):
    examples = spark.createDataFrame([(1, [5] * 20, 0), (2, [5] * 4, None), (None, None, 0), (3, [], 0)], "doc_id long, ids array<int>, prompt_tokens int")
    out = {r.doc_id: r.sequence_id for r in packing.pack_examples(examples, packing.Limits(tokens=8, segments=2, loss_tokens=8, cut=False)).collect()}
    assert out[1] is None and out[2] is not None and set(out) == {1, 2}


def test_empty_table(spark):
    assert packing.pack_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_the_tokenizer_file(name):
    """Also for files that ranks don't describe."""
    import random

    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path(name), random.Random(4)
    own, plain = packing.Encoder(path), Tokenizer.from_file(path)
    assert (own.ranks is None) == (name != "byte_bpe_50k.json")
    letters = "etaoins hrdluETA.,'\n\t0123éüñ中文🙂\u3000\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for text in texts:
        assert own(text) == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_replies_bear_loss_and_prompts_do_not(spark):
    turns = [(1, 0, "user", "what is it"), (1, 1, "assistant", "a thing"), (1, 2, "user", None), (1, 3, "assistant", "more words here"), (2, 0, "assistant", "alone"), (3, 0, "user", "no reply"), (4, 0, "user", "w " * 2000), (4, 1, "assistant", "ok")]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").coalesce(1)
    out = packing.pack_conversations(rows, PATH).toPandas()
    n = lambda text: len(_ids(text)) - 1
    got = sorted(zip(out.doc_id, out.length, out.loss_tokens))
    assert got == sorted([(1, n("what is it") + n("a thing") + 1, n("a thing") + 1), (1, n("more words here") + 1, n("more words here") + 1), (2, n("alone") + 1, n("alone") + 1), (4, n("w " * 2000) + n("ok") + 1, n("ok") + 1)])
    assert out.sequence_id.isna().sum() == 1 and (out[out.sequence_id.isna()].doc_id == 4).all()


def test_null_doc_ids_stay_null(spark):
    docs = spark.createDataFrame([(None, "one"), (None, "two"), (5, "three"), (5, "three")], "doc_id long, text string")
    out = packing.pack_texts(docs, PATH).toPandas()
    assert out.doc_id.isna().sum() == 2 and (out.doc_id == 5).sum() == 2
