"""The columns and types of the ten queries, and stored blocks that were damaged."""

import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from spanweave.llm import codec, registry, token_files

CONTRACTS = {
    "op1_suffix_repetition": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed:boolean kept:boolean",
    "op2_context_mixing_files": "doc_id start n_tokens ids_crc32",
    "op3_source_mixing": "doc_id size source_size target:double taken",
    "op4_byte_gru_language": "doc_id held_out:boolean lang_pred:string score:double",
    "op5_chained_passages": "doc_id other_doc_id",
    "op6_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256:string",
    "op7_bm25_decontamination": "doc_id item_id",
    "op8_hypergeometric_shards": "doc_id size text_crc32 law:string shard:int slot grown_shard:int",
    "op9_line_suffix_dedup": "doc_id n_lines n_removed",
    "op10_golay_simhash": "doc_id fingerprint:string component_id",
}
ONE_EACH = {name for name in CONTRACTS if name.split("_")[0] not in ("op5", "op7")}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract_columns(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    types = dict(got.dtypes)
    for column in CONTRACTS[name].split():
        column, _, kind = column.partition(":")
        assert types[column] == (kind or "bigint")
    rows = got.collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    if name in ONE_EACH:
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    if name.startswith("op8"):
        assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
        assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 for r in rows)
    if name.startswith("op10"):
        assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == f"{int(r['fingerprint'], 16):016x}" for r in rows)


def test_damaged_blocks_raise_value_errors():
    rng = np.random.default_rng(5)
    block = codec.coded_blocks(rng.integers(0, 300, 900).astype(np.uint16))[0]
    assert len(codec.unpack([block])[0]) == 900
    for at in rng.integers(0, len(block), 60).tolist():
        bad = bytearray(block)
        bad[at] ^= 1 << int(rng.integers(0, 8))
        with pytest.raises(ValueError):
            codec.unpack([bytes(bad)])
    for n in (0, 3, 15, 16, len(block) - 1):
        with pytest.raises(ValueError):
            codec.unpack([block[:n]])


def test_coded_ids_are_smaller_than_zlib_on_the_same_blocks():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").combine_chunks().fill_null("")
    ids, _ = token_files.WordTokenizer(token_files.tokenizer_path())(texts)
    blocks = codec.coded_blocks(ids)
    assert np.array_equal(np.concatenate(codec.unpack(blocks)), ids)
    packed = [zlib.compress(ids[k : k + codec.BLOCK].astype("<u2").tobytes(), 9) for k in range(0, len(ids), codec.BLOCK)]
    assert sum(map(len, blocks)) < 0.85 * sum(map(len, packed))


def test_ids_of_any_width_come_back():
    rng = np.random.default_rng(8)
    edges = np.array([0, 1, 7, 8, 9, 15, 16, (1 << 16) - 1, 1 << 16, (1 << 19) + 3, (1 << 31) - 1, 1 << 31, (1 << 32) - 1])
    for ids in (np.tile(edges, 300), rng.integers(0, 1 << 32, 5000), rng.integers(0, 1 << 18, 2049), np.arange(codec.BLOCK), np.zeros(1)):
        ids = ids.astype(np.uint32)
        assert np.array_equal(np.concatenate(codec.unpack(codec.coded_blocks(ids))), ids)


def test_order_0_counts_by_brute_force():
    rng = np.random.default_rng(9)
    counts, plain, lanes = codec.Counts(3), np.zeros((3, codec.BLOCK), dtype=int), np.arange(3)
    for slots in rng.integers(0, codec.BLOCK, (500, 3)) // rng.integers(1, 40, (500, 3)):
        counts.add(slots)
        plain[lanes, slots] += 1
        assert counts.before(lanes, slots).tolist() == [plain[i, :s].sum() for i, s in enumerate(slots)]
        place = rng.integers(0, plain.sum(axis=1))
        found, begin = counts.find(lanes, place)
        assert all(plain[i, : found[i]].sum() == begin[i] <= place[i] < begin[i] + plain[i, found[i]] for i in lanes)
