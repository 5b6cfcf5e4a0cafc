"""Encoding equals the tokenizer's; packing splits nothing it need not and leaves little space."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import packing, tokens
from ledgerloom.session import table

JSON = os.path.dirname(tokens.DEFAULT_VOCABULARY) + "/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no vocabulary files here")
TEXTS = [
    None, "", " ", "  \n\t ", "a", "it's we'll they've ¢'s !'s ''s 's", "<|endoftext|> x<|endoftext|>", "x  y   z\n\n a", "   x　y ", "🧵🏭👨‍👩‍👧 ab🧵cd", "Größe „S“ – „XL“", "株式会社ノルマ مستودع Ω≈ç√∫", "​‌﻿", "a" * 20_000, "1234567890 3.14 1,000",
    "x=1;\r\n\ty=2", "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "é ñ", "ab" * 5_000 + " " * 300 + "c",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


def test_encoder_equals_tokenizer(plain):
    e = tokens.Encoder(tokens.DEFAULT_VOCABULARY)
    for t in TEXTS:
        assert e.encode(t) == plain(t), t
    assert len(e.cuts("Die Gesellschaft mit Sitz in Ulm")) >= 5


def test_random_mixtures(plain):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    e = tokens.Encoder(tokens.DEFAULT_VOCABULARY)
    piece = st.sampled_from([" ", "  ", "\n", "'s", "'", "¢", "!", "ab", "Ü", "1", " ", " ", "中", "🧵", ".", "''", "re", "don't", "\t", "é", "\x1c", "\x85"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(piece, max_size=12))
    def check(parts):
        assert e.encode("".join(parts)) == plain("".join(parts))

    check()


def test_all_documents(spark, sf, plain):
    d = table(spark, sf, "documents")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(d, "doc_id", "text").collect()}
    want = {r.doc_id: plain(r.text) for r in d.select("doc_id", "text").collect()}
    assert got == want


def test_packing_is_whole_and_tight(spark, sf):
    d = table(spark, sf, "documents")
    sized = tokens.token_counts(d, "doc_id", "text", ["source"])
    want = {r.doc_id: r.n_tokens for r in sized.collect()}
    rows = packing.pack(sized, "doc_id", "source", window=8).collect()
    back, boxes = {}, {}
    for r in rows:
        back[r.doc_id] = back.get(r.doc_id, 0) + r.n_tokens
        if r.container_id >= 0:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
            assert r.n_tokens == 2048 or want[r.doc_id] % 2048 == r.n_tokens
    assert back == want
    assert max(boxes.values()) <= 2048
    assert sum(boxes.values()) / (2048 * len(boxes)) > 0.9


def test_mixture_holds_in_every_window(spark):
    d = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("s"), (F.col("id") % 37 + 10).cast("int").alias("n_tokens"))
    p = packing.pack(d, "k", "s", capacity=100, window=50)
    share = p.groupBy("window_no").agg((F.sum(F.when(F.col("s") == "a", F.col("n_tokens"))) / F.sum("n_tokens")).alias("x"), F.sum("n_tokens").alias("t")).where("t > 4000").collect()
    assert len(share) > 10
    assert all(abs(r.x - 0.25) < 0.05 for r in share)


def test_a_queue_that_runs_dry_leaves_its_part_to_the_others(spark):
    # "a" has a quarter of the tokens but half of the mixture, so it is dry after half of the windows; "b" and null share the rest.
    d = spark.range(8000).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, F.lit(None)).otherwise("b").alias("s"), (F.col("id") % 37 + 10).cast("int").alias("n_tokens"))
    p = packing.pack(d, "k", "s", capacity=100, window=50, share={"a": 0.5})
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_tokens"))) / F.sum("n_tokens"), F.lit(0.0))
    w = p.groupBy("window_no").agg(of(F.col("s") == "a").alias("a"), of(F.col("s") == "b").alias("b"), F.sum("n_tokens").alias("t")).orderBy("window_no").collect()
    total = sum(r.t for r in w)
    assert p.count() == 8000 and len(w) > 30
    wet = [r for r in w if (r.window_no + 1) * 5000 < total * 0.48]
    dry = [r for r in w if r.window_no * 5000 > total * 0.52]
    assert all(abs(r.a - 0.5) < 0.05 and abs(r.b - 1 / 3) < 0.05 for r in wet) and all(r.a == 0 and abs(r.b - 2 / 3) < 0.05 for r in dry[:-1])
    assert all(abs(r.t - 5000) < 300 for r in w[:-1])


def test_packing_cases(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "a", 5000), (3, None, 2048), (4, "a", 1)], "k long, s string, n_tokens int")
    rows = sorted((r.k, r.piece_no, r.first_token, r.n_tokens, r.container_id >= 0) for r in packing.pack(d, "k", "s").collect())
    assert rows == [(1, 0, 0, 0, False), (2, 0, 0, 2048, True), (2, 1, 2048, 2048, True), (2, 2, 4096, 904, True), (3, 0, 0, 2048, True), (4, 0, 0, 1, True)]
    assert packing.pack(d.where("k < 0"), "k", "s").count() == 0


def test_best_fit():
    assert packing.best_fit([], 10) == []
    where = packing.best_fit([6, 5, 5, 4], 10)
    assert len(set(where)) == 2
