"""Token ids of whole texts in coded files, in ascending doc_id order, and back.

Documents are sorted by range of doc_id, so each partition is one file and a run of
consecutive documents. A task tokenizes its texts (each distinct word once: the tokenizer never
looks across white space) and codes the ids in independent, checksummed blocks (see codec.py). A
file is Parquet, so Spark commits it whole or not at all on any store: one row per block, with the coded
bytes, the block's place in the file and the documents that it holds parts of.

Reading decodes blocks in any order. A document's checksum is put together from its parts' checksums,
so no ids are moved; the number of ids before a document is its place in its file and the
totals of the files before it.

Defined cases: a null or empty text has only the end id; a null doc_id sorts first; rows that share
a doc_id are ordered by their text's hash, and may lie in several files; an empty table gives a file without blocks and no rows; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codec import BLOCK, coded_blocks, unpack
from .shared import cut, documents, ensure_checkpoint_dir
from .words import slices, split_words, sums

END = 1
LANES = 2048
FILE_BYTES = 24_000_000
MOST_WORDS_KEPT = 400_000

BLOCK_SCHEMA = "file int, block long, first long, n int, data binary, ordinals array<long>, doc_ids array<long>, counts array<int>, opens array<boolean>, closes array<boolean>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of words, for a tokenizer that splits at white space; common words are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter((i for x in found for i in x), dtype=np.int64, count=int(sizes.sum()))
        return ids.astype(np.uint32), sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has."""
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        place = pc.index_in(coded.dictionary, self.words)
        fresh = pc.is_null(place)
        new = coded.dictionary.filter(fresh)
        ids, sizes = self._encode(new)
        place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[fresh.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        all_ids, all_sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        if len(self.words) + len(new) <= MOST_WORDS_KEPT:
            self.words, self.ids, self.sizes = pa.concat_arrays([self.words, new]), all_ids, all_sizes
        start = np.cumsum(all_sizes) - all_sizes
        at = place[coded.indices.to_numpy(zero_copy_only=False)]
        n = all_sizes[at]
        upto = np.cumsum(n)
        flat = all_ids[np.repeat(start[at] - upto + n, n) + np.arange(int(n.sum()))]
        per_text = sums(n, counts)
        out = np.full(len(flat) + len(counts), END, dtype=np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), per_text)] = flat
        return out, per_text + 1


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write_token_files(docs: DataFrame, place: str, path: str | None = None) -> None:
    """Tokenize docs (doc_id, text) and write coded files to the folder place."""
    path = path or tokenizer_path()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = docs.select("doc_id", "text").repartitionByRange(max(1, -(-total // FILE_BYTES)), *order).sortWithinPartitions(*order)

    def rows(file, block, first, ids, docs_in):
        """Stored rows for ids, whose documents are (ordinal, doc_id, start, end) by places in the file."""
        blocks, out, k = coded_blocks(ids, LANES), [], 0
        for i, data in enumerate(blocks):
            low = first + i * BLOCK
            high = min(low + BLOCK, first + len(ids))
            while docs_in[k][3] <= low:
                k += 1
            j, held = k, []
            while j < len(docs_in) and docs_in[j][2] < high:
                ordinal, doc_id, start, end = docs_in[j]
                held.append((ordinal, doc_id, min(end, high) - max(start, low), start >= low, end <= high))
                j += 1
            out.append((file, block + i, low, high - low, data, *map(list, zip(*held))))
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_())]
        names = ["file", "block", "first", "n", "data", "ordinals", "doc_ids", "counts", "opens", "closes"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def code(batches):
        file, tokenizer = TaskContext.get().partitionId(), _tokenizer(path)
        block = first = ordinal = end = size = 0
        held, docs_in = [], []
        for part in slices(batches):
            ids, sizes = tokenizer(part.column("text"))
            held.append(ids)
            size += len(ids)
            for doc_id, n in zip(part.column("doc_id").to_pylist(), sizes.tolist()):
                docs_in.append((ordinal, doc_id, end, end + n))
                ordinal, end = ordinal + 1, end + n
            while size >= LANES * BLOCK:
                ids = np.concatenate(held)
                yield rows(file, block, first, ids[: LANES * BLOCK], docs_in)
                held, size = [ids[LANES * BLOCK :]], size - LANES * BLOCK
                block, first = block + LANES, first + LANES * BLOCK
                docs_in = [d for d in docs_in if d[3] > first]
        if size:
            yield rows(file, block, first, np.concatenate(held), docs_in)

    ranged.mapInArrow(code, BLOCK_SCHEMA).write.parquet(place)


@cache
def _zero_operators() -> np.ndarray:
    """Row k: what 2**k zero bytes do to each bit of a CRC-32."""
    bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
    one = np.concatenate([[np.uint64(0xEDB88320)], bit[:-1]])
    rows = one
    for _ in range(3):
        rows = _apply(rows, rows)
    found = [rows]
    for _ in range(40):
        found.append(_apply(found[-1], found[-1]))
    return np.array(found)


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for b in range(32):
        out ^= np.where(crc >> np.uint64(b) & np.uint64(1), operator[b], np.uint64(0))
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings end to end from the CRC-32 of each (unsigned) and the bytes of the second."""
    out = first.astype(np.uint64)
    for k, operator in enumerate(_zero_operators()):
        use = (size >> k) & 1 == 1
        if use.any():
            out[use] = _apply(operator, out[use])
    return out ^ second.astype(np.uint64)


def read_token_files(spark: SparkSession, place: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, from its decoded ids."""
    stored = spark.read.parquet(place)
    schema = "file int, ordinal long, doc_id long, start long, n long, crc long, whole boolean"

    def parts(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, LANES):
                rows = batch.slice(k, LANES)
                out, lists = [], [rows.column(c).to_pylist() for c in ("file", "first", "ordinals", "doc_ids", "counts", "opens", "closes")]
                for ids, file, first, ordinals, doc_ids, counts, opens, closes in zip(unpack(rows.column("data").to_pylist(), LANES), *lists):
                    wide, at = ids.astype("<u4"), 0
                    for ordinal, doc_id, n, opened, closed in zip(ordinals, doc_ids, counts, opens, closes):
                        out.append((file, ordinal, doc_id, first + at, n, zlib.crc32(wide[at : at + n]), opened and closed))
                        at += n
                yield pd.DataFrame(out, columns=["file", "ordinal", "doc_id", "start", "n", "crc", "whole"])

    def arrow_parts(batches):
        types = pa.schema([("file", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_())])
        for pdf in parts(batches):
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pa.RecordBatch.from_pandas(pdf, schema=types, preserve_index=False)

    def join(batches):
        for pdf in batches:
            size = pdf["crcs"].str.len().to_numpy() if len(pdf) else np.zeros(0, dtype=int)
            crc, n = (np.array([x[0][f] for x in pdf["parts"]], dtype=np.int64) for f in ("crc", "n"))
            for k in range(1, int(size.max()) if len(size) else 0):
                rows = np.flatnonzero(size > k)
                more = [pdf["parts"].iloc[i][k] for i in rows]
                add = np.array([x["n"] for x in more], dtype=np.int64)
                crc[rows] = joined_crc(crc[rows], np.array([x["crc"] for x in more], dtype=np.int64), add * 4).astype(np.int64)
                n[rows] += add
            yield pd.DataFrame({"file": pdf["file"], "doc_id": pdf["doc_id"].astype("Int64"), "start": pdf["start"], "n": n, "crc": crc})

    found = stored.select("file", "first", "data", "ordinals", "doc_ids", "counts", "opens", "closes").mapInArrow(arrow_parts, schema)
    # Decoding is the costly step: its small rows are kept for both of the uses below.
    found = cut(found)
    split = found.filter("not whole").groupBy("file", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("parts"), F.collect_list("crc").alias("crcs")
    )
    split = split.select("file", "doc_id", "start", "parts", "crcs").mapInPandas(join, "file int, doc_id long, start long, n long, crc long")
    rows = found.filter("whole").select("file", "doc_id", "start", "n", "crc").union(split)
    files = stored.groupBy("file").agg(F.sum("n").alias("in_file"))
    files = files.select("file", (F.sum("in_file").over(Window.orderBy("file")) - F.col("in_file")).alias("before"))  # a row per file
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op2_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), place)
    return read_token_files(spark, place)
