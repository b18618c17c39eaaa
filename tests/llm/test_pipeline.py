"""The pipeline on a small table against a brute-force version of its decisions."""

import duckdb
import numpy as np

import corpus_pipeline
from spanweave.llm import language, simhash

from .cases import table


def recognised_docs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, weights = language.learn(docs)
    pdf = docs.toPandas().sort_values("doc_id", ignore_index=True)
    p = np.array([language.pooled(np.frombuffer(t.encode(), dtype=np.uint8), np.array([len(t.encode())]), weights)[0].max() for t in pdf["text"]])
    return pdf[(p >= 0.4) & pdf["text"].str.contains(r"[^\W\d_]")].reset_index(drop=True)


def test_pipeline_keeps_what_brute_force_keeps(spark, sf_dir):
    """Near-duplicates by the exact similarity of five-word shingles; every kept document is in the mix."""
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    pdf = recognised_docs(spark, sf_dir)
    sets, parent = [set(simhash.shingle_hashes(t, 5)) for t in pdf["text"]], list(range(len(pdf)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    pdf = pdf[[root(i) == i for i in range(len(pdf))]]
    items = duckdb.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").df()["text"]
    pdf = pdf[[not any(i in t for i in items) for t in pdf["text"]]]
    assert set(got["doc_id"]) <= set(pdf["doc_id"]) and got.groupby("doc_id").size().max() <= 2
    assert len(set(got["doc_id"])) > 0.8 * len(pdf)
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 40
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def test_near_dedup_stage_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pdf = docs.toPandas().sort_values("doc_id", ignore_index=True)
    sets, first = [set(simhash.shingle_hashes(t, 5)) for t in pdf["text"]], list(range(len(pdf)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    want = {pdf["doc_id"][i] for i in range(len(pdf)) if first[i] == i}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).select("doc_id").collect()} == want


def test_stages_on_empty_and_awkward_tables(spark, sf_dir):
    for docs in (table(spark), table(spark).filter("doc_id < 0")):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, sf_dir)
            assert set(docs.columns) <= set(kept.columns), name
        assert kept.count() <= 2 * docs.count() and (kept.count() > 0) == (docs.count() > 0)
