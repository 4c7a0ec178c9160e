import pytest
from pyspark.sql import functions as F

from tidewatch.llm import encode, mixing

TEXTS = [
    None, "", " ", "Hello world, it's 2025!", "Hello world, it's 2025!", "  two  spaces \n\n and\ttabs  ", "naïve café — 東京の天気 🌧️🔥", "<|endoftext|> is text", "don't we'll I'M", "١٢٣ ⅷ ½", "a b c\u0085d", "\x00\x1f﻿�￾",
    "x" * 30_000, "the " * 5_000, "\U0001fae8\U00010d4a\U0001e4d0 new letters", " 's", "!'s ''s", "́combining", "   ", "\n",
]


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizer(spark):
    df = spark.createDataFrame([(i, t, "extra", i) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, word string, pos bigint")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_texts(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference(TEXTS)


def test_repeated_rows_null_keys_and_empty_table(spark):
    schema = "doc_id bigint, text string"
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (2, None), (None, "a"), (3, "x"), (3, "y z")], schema)
    got = sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in encode.encode_texts(df, "doc_id", "text").collect())
    want = reference(["a b c", "a", "x", "y z"])
    assert got == sorted([(1, tuple(want[0])), (2, ()), (-1, tuple(want[1])), (3, tuple(want[2])), (3, tuple(want[3]))])
    assert encode.encode_texts(spark.createDataFrame([], schema), "doc_id", "text").count() == 0


def test_round_trip(spark):
    texts = [t for t in TEXTS if t is not None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = encode.encode_texts(df, "doc_id", "text")
    back = {r["doc_id"]: r["text"] for r in encode.decode_ids(ids, "doc_id", "ids").collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert encode.decode_ids(spark.createDataFrame([(1, None)], "k bigint, ids array<int>"), "k", "ids").first()["text"] is None


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "s", "a b c"), (2, "s", None)], "doc_id bigint, source string, text string")
    assert [tuple(r) for r in encode.count_tokens(df, ["doc_id", "source"], "text").collect()] == [(1, "s", 3)]


def sized(spark, spec):
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, n, k in spec for _ in range(k))]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("hash", F.xxhash64(F.lit("mix"), "doc_id"))


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark):
    docs = sized(spark, [("big", 10, 5000), ("small", 10, 50), ("giant", 5000, 3)])
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.1, 3), ("giant", 0.4, 2), ("none", 0.2, 5), (None, 0.1, 1)], TARGETS)
    mixed = mixing.mix(docs, targets).cache()
    # "small" is scarcest: 3 * 500 tokens are 0.1 of the total.
    shares = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    assert shares["small"]["tokens"] == 1500 and shares["small"]["most_copies"] == 3
    assert abs(shares["big"]["tokens"] - 7500) <= 10 and shares["none"]["tokens"] == 0 and abs(shares["giant"]["tokens"] - 6000) <= 5000
    assert mixed.where("copies < 1").count() == 0 and mixed.groupBy("doc_id").count().where("count > 1").count() == 0


def test_smaller_budgets_take_subsets(spark):
    docs = sized(spark, [("a", 7, 3000), ("b", 7, 100)])
    taken = []
    for share in (0.3, 0.6):
        targets = spark.createDataFrame([("a", share, 1), ("b", 0.1, 1)], TARGETS)
        taken.append({r["doc_id"] for r in mixing.mix(docs, targets).where("source = 'a'").collect()})
    assert taken[0] < taken[1] and abs(len(taken[0]) - 300) <= 1 and abs(len(taken[1]) - 600) <= 1


def test_nothing_to_mix(spark):
    docs = sized(spark, [("a", 7, 3)])
    for targets in ([], [("b", 1.0, 1)], [("a", 0.0, 1)], [("a", 1.0, 0)], [("a", None, None)]):
        assert mixing.mix(docs, spark.createDataFrame(targets, TARGETS)).count() == 0
    whole = mixing.mix(docs, spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert [r["copies"] for r in whole.collect()] == [2, 2, 2]


def test_sizing_ignores_what_has_no_tokens(spark):
    docs = spark.createDataFrame([(1, "a", "one two"), (1, "a", "one two"), (1, "a", "one"), (2, "a", None), (3, "a", ""), (4, None, "x"), (5, "z", "x")], "doc_id bigint, source string, text string")
    out = mixing.size_documents(docs, spark.createDataFrame([("a", 1.0, 1)], TARGETS)).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in out] == [(1, 2)]


def test_rare_words_fill_their_holes(spark, monkeypatch):
    """Whatever counts as frequent, ids and counts are the same."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    want = reference(TEXTS)
    for share in (0, 3, 10_000):
        monkeypatch.setattr(encode, "HOT_SHARE", share)
        got = {r["doc_id"]: r["ids"] for r in encode.encode_texts(df, "doc_id", "text").collect()}
        assert [got[i] for i in range(len(TEXTS))] == want
        counts = {r["doc_id"]: r["n_tokens"] for r in encode.count_tokens(df, ["doc_id"], "text").collect()}
        assert counts == {i: len(w) for i, w in enumerate(want) if w}
