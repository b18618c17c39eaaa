"""Samples without rows, halved items, parts of the index, and equal rows among shards."""

import collections

import numpy as np

from spanweave.llm import decontamination, language, sharding, substrings, suffixes

from .cases import SCHEMA, table
from .test_short_items import FILLER


def test_repeated_rows_are_learned_from_and_nothing_gives_und(spark):
    row = lambda i, text, lang: (i, text, lang, "s", 1, *[None] * 7)
    docs = spark.createDataFrame([row(i, "words of one kind", "en") for i in (1, 2, 3, 4) for _ in range(300)] + [row(7, "\u6f22\u5b57" * 9, "zh")] * 5, SCHEMA)
    names, weights = language.learn(docs, 20, 2)
    assert names == ["en", "zh"] and weights is not None
    none = docs.withColumn("lang", language.F.lit(None).cast("string"))
    assert language.learn(none) == ([], None)
    assert {(r["lang_pred"], r["score"]) for r in language.predict(none, *language.learn(none)).collect()} == {("und", 0.0)}
    again = language.learn(docs.repartition(7), 20, 2)
    assert again[0] == names and all((a == b).all() for a, b in zip(again[1], weights))


def test_items_without_an_answer_are_halved(spark):
    whole = [f"w{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(whole)), (2, "what is the capital of france? paris")], "item_id long, text string")
    texts = [FILLER + " ".join(whole[:10]), FILLER + " ".join(whole), FILLER + "what is the capital of france? paris " + FILLER, FILLER + "what is the capital of france? rome"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(1, 1), (2, 2)}
    for most in (10_000, 10):
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items, most_postings=most).collect()} == want
        assert {r["doc_id"] for r in decontamination.decontaminated(docs, items, most_postings=most).collect()} == {0, 3}


def test_equal_rows_share_out_places(spark):
    rows = [(1, "same", "en", "s", 4, *[None] * 7)] * 700 + [(i, "t", "en", "s", 4, *[None] * 7) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for copies in (50_000, 64):
        got = sharding.shard_documents(docs, 8, copies=copies, rows_per_block=100).toPandas()
        assert collections.Counter(got["text"]) == {"same": 700, "t": 300}
        assert (got.groupby("shard").size() == 125).all() and all(sorted(g) == list(range(125)) for _, g in got.groupby("shard")["slot"])
        share = got[got["text"] == "same"].groupby("shard").size()
        assert len(share) == 8 and np.ptp(share) < 60
    numbered = sharding.numbered_copies(docs.select("doc_id", "text"), ["doc_id", "text"], 64).toPandas()
    assert sorted(numbered[numbered["text"] == "same"]["_copy"]) == list(range(700)) and len(numbered) == 1000
    assert sharding.shard_documents(table(spark)).count() == table(spark).count()


def test_longest_previous_factors_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 150):
        for _ in range(20):
            s, ends = rng.integers(0, 3, n), np.full(n, n)
            order, levels = suffixes.suffix_array(s, ends)
            got = np.zeros(n, dtype=int)
            got[order] = substrings.longest_previous(order.astype(np.int64), suffixes.neighbour_lcp(order, levels, ends))
            common = lambda i, j: next((k for k in range(n - i) if s[i + k] != s[j + k]), n - i)  # noqa: E731, B023
            assert got.tolist() == [max([0] + [common(i, j) for j in range(i)]) for i in range(n)]
