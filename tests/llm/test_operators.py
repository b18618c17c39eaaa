"""Results against brute force, SQL, exact round trips or held-out accuracy."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from spanweave.llm import codec, decontamination, language, lines, mixing, passages, registry, repetition, sharding, simhash, substrings, suffixes, token_files

from ..compare import duck, rows
from .cases import awkward, table


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), duck(registry.oracle_sql()[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# suffix arrays and repetition


def test_suffix_array_and_lcp():
    rng = np.random.default_rng(1)
    sizes = np.array([40, 1, 0, 25])
    symbols, ends = rng.integers(0, 3, sizes.sum()), np.repeat(np.cumsum(sizes), sizes)
    order, levels = suffixes.suffix_array(symbols, ends)
    suffix = lambda p: symbols[p : ends[p]].tolist()
    assert sorted(order.tolist()) == list(range(len(symbols)))
    lcp = suffixes.neighbour_lcp(order, levels, ends, 2)
    for i in range(1, len(order)):
        a, b = suffix(order[i - 1]), suffix(order[i])
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[i] == (same if same >= 2 else 0)


def test_repetition_by_hand(spark):
    text = "a b c d e f g h i x a b c d e f g h i y z ## $"
    df = spark.createDataFrame([(1, text), (2, "l\nl\n\n \nl m"), (3, " ".join(str(i) for i in range(50)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.repetition_rules(df).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["longest_repeat"], got[1]["n_symbols"], got[1]["base_failed"]) == (23, 18, 9, 3, True)
    assert (got[2]["n_dup_lines"], got[2]["kept"]) == (1, False)
    assert (got[3]["word_chars"], got[3]["kept"]) == (90, True)


# token files


def test_codec_round_trip():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0), np.zeros(5000), rng.integers(0, 1 << 16, 5000), np.tile(rng.integers(0, 49408, 37), 200), np.minimum(rng.zipf(1.3, 9000), 65535)):
        ids = ids.astype(np.uint16)
        blocks = codec.coded_blocks(ids)
        assert np.array_equal(np.concatenate([*codec.unpack(blocks), ids[:0]]), ids)
    assert sum(map(len, codec.coded_blocks(np.tile(rng.integers(0, 49408, 37), 200).astype(np.uint16)))) < 7400 * 2 / 4
    broken = bytearray(codec.coded_blocks(np.arange(3000, dtype=np.uint16))[0])
    broken[40] ^= 1
    with pytest.raises(ValueError):
        codec.unpack([bytes(broken)])


def test_crc_of_parts():
    a, b = b"some bytes" * 3, b"others" * 50
    got = token_files.joined_crc(np.array([zlib.crc32(a)], dtype=np.int64), np.array([zlib.crc32(b)], dtype=np.int64), np.array([len(b)]))
    assert int(got[0]) == zlib.crc32(a + b)


def test_token_files_hold_the_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = table(spark)
    token_files.write_token_files(docs, str(tmp_path / "files"))
    got = [tuple(r) for r in token_files.read_token_files(spark, str(tmp_path / "files")).collect()]
    tokenizer, start, want = Tokenizer.from_file(token_files.tokenizer_path()), 0, []
    for row in sorted(awkward(), key=lambda r: (r[0] is not None, r[0], r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, token_files.END]
        want.append((row[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


# mixing and sharding


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join("w" * int(n)), f"s{s}") for i, (n, s) in enumerate(zip(rng.integers(1, 90, 900), rng.choice(5, 900, p=[0.5, 0.2, 0.15, 0.1, 0.05])))], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, rows_per_bucket=50)
    sums = got.groupBy("source").agg({"taken": "sum", "size": "sum", "target": "max", "copies": "max"}).toPandas()
    assert np.abs(sums["sum(taken)"] - sums["max(target)"]).max() <= 1
    assert abs(sums["max(target)"].sum() - 1.5 * sums["sum(size)"].sum()) < 1e-6
    assert got.filter("taken > 2 * size or taken < 0").isEmpty()
    again = mixing.mix_sources(docs.repartition(7), rows_per_bucket=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    whole = mixing.mixed_documents(docs, rows_per_bucket=50).groupBy("doc_id").count()
    assert sum(r["count"] for r in whole.collect()) == sum(r["copies"] for r in got.collect())


def test_hypergeometric_draws():
    rng = np.random.default_rng(4)
    small = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(small.mean() - 6) < 0.1 and abs(small.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    n = 6_000_000_000
    large = np.array([sharding.hypergeometric(rng, n // 3, n - n // 3, 10_000) for _ in range(300)])
    assert abs(large.mean() - 10_000 / 3) < 15 and 30 < large.std() < 65
    parts = sharding.split_counts(rng, np.array([5, 0, 9, 1]), 7)
    assert parts.sum() == 7 and (parts <= [5, 0, 9, 1]).all()


@pytest.mark.parametrize("per_block", [50_000, 40])
def test_shards_are_exact_and_gapless(spark, per_block):
    docs = spark.range(1013).selectExpr("id AS doc_id", "'t' AS text", "CAST(id % 7 AS string) AS source")
    got = sharding.shard_documents(docs, 8, rows_per_block=per_block)
    pdf = got.toPandas()
    slots = pdf.groupby("shard")["slot"].apply(sorted)
    assert sorted(len(s) for s in slots) == [126] * 3 + [127] * 5 and all(s == list(range(len(s))) for s in slots)
    assert sorted(pdf["doc_id"]) == list(range(1013))
    again = sharding.shard_documents(docs.repartition(3), 8, rows_per_block=per_block).toPandas()
    assert sorted(map(tuple, pdf.to_numpy())) == sorted(map(tuple, again.to_numpy()))
    assert abs(np.corrcoef(pdf["doc_id"], pdf["shard"] * 200 + pdf["slot"])[0, 1]) < 0.12


# language


def test_gradients():
    rng = np.random.default_rng(0)
    grid = rng.integers(0, 256, (6, 3)).astype(np.uint8)
    table_, recur = (rng.standard_normal(s).astype(np.float32) * 0.3 for s in ((24, 256), (24, 8)))
    weigh = rng.standard_normal((6, 8, 3)).astype(np.float32)
    loss = lambda t, u: float((language.run_layer(grid, t, u) * weigh).sum(dtype=np.float64))
    _, memory = language.run_layer(grid, table_, recur, keep=True)
    d_table, d_recur = language.backward(grid, memory, recur, weigh)
    for which, grad, at in ((0, d_table, (9, grid[1, 1])), (0, d_table, (20, grid[2, 2])), (1, d_recur, (0, 0)), (1, d_recur, (20, 5))):
        weights = [table_.copy(), recur.copy()]
        weights[which][at] += 1e-2
        up = loss(*weights)
        weights[which][at] -= 2e-2
        assert grad[at] == pytest.approx((up - loss(*weights)) / 2e-2, rel=0.06, abs=2e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs.select("doc_id", "text", "lang"), *language.learn(docs)).withColumn("h", language.held_out(language.F.col("doc_id"))).toPandas()
    held = got[got["h"]]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


# passages, substrings, lines, fingerprints


def test_passages_by_brute_force(spark):
    data = awkward()
    got = passages.shared_passages(table(spark)).collect()
    words, counts = passages.word_hashes(pa.array([r[1] for r in data], pa.string()))
    ends = np.cumsum(counts)
    grams = collections.defaultdict(set)
    for i, (e, n) in enumerate(zip(ends, counts)):
        w = words[e - n : e].tolist()
        for k in range(n - 50):
            grams[tuple(w[k : k + 51])].add(data[i][0])
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in got:
        parent[root(r["doc_id"])] = root(r["other_doc_id"])
        assert min(r["end"] - r["start"], r["other_end"] - r["other_start"]) >= 50
    for docs in grams.values():
        assert len({root(d) for d in docs}) == 1
    assert {r["doc_id"] for r in got if r["doc_id"] == 11 or r["other_doc_id"] == 11}
    clean = {r[0] for r in data[18:60]} - {30, 31}
    assert not clean & ({r["doc_id"] for r in got} | {r["other_doc_id"] for r in got})


def test_chains_keep_order():
    px, py = [0, 10, 20, 30, 40], [100, 5, 120, 15, 140]
    found = passages.chains(px, py)
    assert [0, 2, 4] in found and [1, 3] in found
    a = np.arange(100)
    assert passages.align(a[10:60], np.r_[a[5:30], 999, a[31:70]], [10], [15]) == (0, 50, 5, 55, 49)


@pytest.mark.parametrize("most, keep_first", [(1500, False), (2, False), (1500, True), (2, True)])
def test_substrings_by_brute_force(spark, most, keep_first):
    data = awkward()
    texts = [(r[1] or "").encode() for r in data]
    length = 400
    seen = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    got = substrings.substring_dedup(table(spark), length, keep_first, most).collect()
    assert len(got) == len(data)
    if not keep_first:
        want = []
        for r, t in zip(data, texts):
            gone = np.zeros(len(t), dtype=bool)
            for k in range(len(t) - length + 1):
                if seen[t[k : k + length]] > 1:
                    gone[k : k + length] = True
            kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
            runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
            want.append((r[0], len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        return
    want, before = [], set()
    for r, t in sorted(zip(data, texts), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if t[k : k + length] in before:
                gone[k : k + length] = True
            before.add(t[k : k + length])
        want.append((r[0], int(gone.sum())))
    plain = lambda rows_: sorted((x for x in rows_ if x[0] not in (None, 31)), key=repr)
    assert plain((r["doc_id"], r["n_removed"]) for r in got) == plain(want)


def test_lines_by_hand(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nc\nd"), (2, "x\na\nb\nc\n \nd\ny"), (3, "a\nb"), (4, "q\nq\nq\nq"), (None, "a\nb\nc")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_runs"], r["text"]) for r in lines.dedup_lines(df).collect()}
    assert got[None] == (3, 0, 0, "a\nb\nc")
    assert got[1] == (4, 3, 1, "\nd")
    assert got[2] == (6, 4, 1, "x\n \ny") and got[3] == (2, 0, 0, "a\nb") and got[4] == (4, 3, 1, "q")


def naive_print(text, size=3):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    value = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(g, seed=42) >> bit & 1 for g in grams) * 2 > len(grams):
            value |= 1 << bit
    return value


def test_fingerprints_and_groups_by_brute_force(spark):
    data = awkward()
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_groups(table(spark)).collect())
    prints = sorted((r[0] is not None, r[0], naive_print(r[1])) for r in data)
    assert [g[:3] for g in got] == prints
    n = len(prints)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(prints[i][2] ^ prints[j][2]).count("1") <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if prints[i][1] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 62), prints[i][1])
    assert [g[3] for g in got] == [least.get(root(i)) for i in range(n)]


@pytest.mark.parametrize("bits, chunk", [(3, 4096), (8, 4096), (3, 2), (8, 3)])
def test_links_connect_all_near_prints(spark, bits, chunk):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for k in range(12):
            x = b
            for bit in rng.choice(64, k, replace=False).tolist():
                x ^= 1 << bit
            prints.add(x)
    values = np.array(sorted(prints), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    parent = {int(v): int(v) for v in values}

    def root(x, of):
        while of[x] != x:
            x = of[x]
        return x

    for r in simhash.linked(df, bits, chunk).collect():
        parent[root(r["a"], parent)] = root(r["b"], parent)
    want = {int(v): int(v) for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if np.bitwise_count((a ^ b).view(np.uint64)) <= bits:
                want[root(int(a), want)] = root(int(b), want)
    groups = lambda of: sorted(sorted(g) for g in _groups(of, root))
    assert groups(parent) == groups(want)


def _groups(of, root):
    out = collections.defaultdict(list)
    for x in of:
        out[root(x, of)].append(x)
    return out.values()


# decontamination


def test_leaks_by_brute_force(spark, sf_dir):
    items, docs = (duckdb.sql(f"SELECT * FROM '{sf_dir}/{t}.parquet'").fetchall() for t in ("benchmark", "documents"))
    want = {(d[0], i[0]) for d in docs for i in items if i[1] in d[1]}
    found = registry.queries()["op7_bm25_decontamination"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want) and want


def test_retrieval_equals_scoring_every_item(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole, parts = decontamination.build_index(items), decontamination.build_index(items, most_postings=300)
    assert len(parts) > 3 and sum(len(p.ids) for p in parts) == len(whole[0].ids)
    rng = np.random.default_rng(8)
    index = whole[0]
    sets = [np.unique(rng.integers(0, len(index.terms), n)) for n in rng.integers(1, 400, 60)]
    passage, code = np.repeat(np.arange(60), [len(s) for s in sets]), np.concatenate(sets)
    got = {(p, i): s for p, i, s in zip(*decontamination.retrieve(index, passage, code, 0.4))}
    for p, terms in enumerate(sets):
        score = np.zeros(len(index.ids))
        for t in terms:
            part = slice(index.term_start[t], index.term_start[t + 1])
            score[index.item[part]] += index.weight[part]
        assert {i: pytest.approx(score[i]) for i in np.flatnonzero(score >= 0.4)} == {i: s for (q, i), s in got.items() if q == p}


def test_edited_leak_and_clean_text(spark):
    words = [f"word{i}" for i in range(40)]
    items = spark.createDataFrame([(7, " ".join(words[:12]) + "? " + " ".join(words[12:]))], "item_id long, text string")
    edited = [w.upper() for w in words]
    edited[20] = "other"
    docs = spark.createDataFrame([(1, "start " * 30 + " ".join(edited) + " end" * 50), (2, " ".join(words[:12])), (3, " ".join(reversed(words))), (4, None)], "doc_id long, text string")
    got = decontamination.contaminated(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)] and got[0]["question_overlap"] == 1.0
    assert sorted(r["doc_id"] for r in decontamination.decontaminated(docs, items).collect()) == [2, 3, 4]
