"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows lie in logical partitions that a hash of the row decides, so a lost executor's rows come
back in the same place. How many rows each partition sends to each shard is drawn from the
multivariate hypergeometric law with the shard sizes fixed (at most one row apart). Rows are
permuted inside their partition, cut into the drawn counts, exchanged, and permuted again inside
their shard; together that is a uniform permutation of all rows.

The matrix is drawn down a binary tree over the partitions: a node gives its left half
a multivariate hypergeometric part of its shard counts, by a generator seeded with the node. Every
partition walks its own path, so partitions are drawn in parallel and agree on shared nodes.
A shard's slots come from counts per (shard, bucket of the second key) and a rank inside a
bucket; no task sees a whole shard.

Defined cases: a null text has no bytes; null ids hash like any value; equal rows are
interchangeable; an empty table gives no rows; fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, documents, power_of_two

N_SHARDS = 40
#: Equal rows that one task makes.
COPIES = 50_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of sample draws without replacement are good, by the inverse of the law's sums; any population size.

    Values over twelve standard deviations from the mode are left out: together they are less likely than a double can tell.
    """
    if not sample or not good:
        return 0
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    sd = (sample * (good / total) * (bad / total) * ((total - sample) / max(1, total - 1))) ** 0.5
    reach = int(12 * sd) + 60
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    # log of P(k)/P(k-1), summed outwards from the first value kept
    step = np.log((good - k[1:] + 1) * (sample - k[1:] + 1)) - np.log(k[1:] * (bad - sample + k[1:]))
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(logp - logp.max()))
    return int(k[np.searchsorted(p, rng.random() * p[-1])])


def split_counts(rng: np.random.Generator, counts: np.ndarray, sample: int) -> np.ndarray:
    """A multivariate hypergeometric draw: how many of each colour are in the sample."""
    left, rest, drawn = int(sample), int(counts.sum()), np.zeros(len(counts), dtype=np.int64)
    for i, c in enumerate(counts):
        rest -= int(c)
        drawn[i] = left if rest == 0 else hypergeometric(rng, int(c), rest, left)
        left -= int(drawn[i])
        if not left:
            break
    return drawn


def shard_sizes(n_rows: int, n_shards: int) -> np.ndarray:
    return np.full(n_shards, n_rows // n_shards, dtype=np.int64) + (np.arange(n_shards) < n_rows % n_shards)


def communication_matrix(blocks: DataFrame, depth: int, n_rows: int, n_shards: int, seed: int) -> DataFrame:
    """block, upto: running sums over the shards of the rows the block sends. blocks: block, n."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    nodes = blocks.select("block", "n", levels).withColumn("node", F.expr(f"shiftright(block, {depth} - level)"))
    nodes = nodes.groupBy("level", "node").agg(F.sum("n").alias("n_node"))
    # On its path to a block, a node is left for the child below it; the left child's count decides the draw.
    path = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    path = path.withColumn("node", F.expr(f"shiftright(block, {depth} - level) - (shiftright(block, {depth} - level) & 1)"))
    path = path.filter("level > 0").join(nodes, ["level", "node"], "left")
    steps = path.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("level", F.coalesce("n_node", F.lit(0)).alias("n_left")))).alias("steps"))
    rows = blocks.join(steps, "block", "left")

    def draw(batches):
        for pdf in batches:
            known, out = {}, []
            for block, steps in zip(pdf["block"], pdf["steps"]):
                counts, node = shard_sizes(n_rows, n_shards), 0
                for step in steps if steps is not None else ():
                    level, n_left = step["level"], step["n_left"]
                    if (level, node) not in known:
                        left = split_counts(np.random.default_rng([seed, level, node]), counts, n_left)
                        known[level, node] = (left, counts - left)
                    turn = (block >> (depth - level)) & 1
                    counts, node = known[level, node][turn], node * 2 + turn
                out.append(np.cumsum(counts))
            yield pd.DataFrame({"block": pdf["block"], "upto": out})

    return rows.select("block", "steps").mapInPandas(draw, "block long, upto array<long>")


def numbered_copies(rows: DataFrame, keys: list[str], chunk: int = COPIES) -> DataFrame:
    """rows with _copy, which counts equal rows from 0. Equal rows are counted, not brought together, and made again in chunks."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_copies"))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / chunk))))
    first, end = F.col("_chunk") * chunk, F.least((F.col("_chunk") + 1) * chunk, F.col("_copies"))
    few = lambda df: df.withColumn("_copy", F.explode(F.sequence(first, end - 1))).select(*rows.columns, "_copy")
    many = chunks.filter(F.col("_copies") > chunk)
    return few(chunks.filter(F.col("_copies") <= chunk)).union(few(many.repartition(*keys, "_chunk")))


def assign_shards(rows: DataFrame, keys: list[str], n_shards: int = N_SHARDS, rows_per_block: int = 50_000, seed: int = 11) -> DataFrame:
    """Add shard and slot (gapless from 0 in each shard) to rows, whose columns are the keys; equal rows are told apart by number."""
    hashed = lambda salt: F.xxhash64(F.lit(f"{seed}:{salt}"), *keys)
    top = lambda col, bits: F.shiftrightunsigned(col, 64 - bits) if bits else F.lit(0).cast("long")
    names = rows.columns
    rows = numbered_copies(rows, keys)
    keys = [*keys, "_copy"]
    rows = cut(rows.withColumn("_place", hashed("place")).withColumn("_first", hashed("first")).withColumn("_second", hashed("second")))
    n_rows = rows.count()
    depth, bits = power_of_two(n_rows / rows_per_block), power_of_two(n_rows / n_shards / rows_per_block)
    rows = rows.withColumn("_block", top(F.col("_place"), depth))
    blocks = cut(rows.groupBy(F.col("_block").alias("block")).agg(F.count("*").alias("n")))
    matrix = communication_matrix(blocks, depth, n_rows, n_shards, seed)
    at = F.row_number().over(Window.partitionBy("_block").orderBy("_first", *keys)) - 1
    local = rows.withColumn("_at", at).join(matrix, F.col("_block") == F.col("block"))
    sent = cut(local.withColumn("shard", F.size(F.filter("upto", lambda u: u <= F.col("_at")))).withColumn("_bucket", top(F.col("_second"), bits)).drop("upto", "block", "_block", "_at", "_first", "_place"))
    buckets = sent.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")
    buckets = buckets.select("shard", "_bucket", start.alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_second", *keys)) - 1
    return sent.withColumn("_inside", inside).join(buckets, ["shard", "_bucket"]).select(*names, "_copy", "shard", (F.col("_start") + F.col("_inside")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, copies: int = COPIES, **options) -> DataFrame:
    """docs with shard and slot, in place of own columns of these names.

    Only hashes take part in the shuffle's steps. Rows that agree in all columns are one row with several
    places; texts move once, to their places, as parts of rows that travel as one value.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    row = F.struct(*columns)
    named = docs.select(F.xxhash64(row).alias("_k1"), F.xxhash64(F.lit(1), row).alias("_k2"), row.alias("_row"))
    places = assign_shards(named.select("_k1", "_k2"), ["_k1", "_k2"], n_shards, **options)
    once = named.groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"), F.count("*").alias("_n"))
    chunk = F.floor(F.col("_copy") / copies)
    usual = once.filter(F.col("_n") <= copies).join(places, ["_k1", "_k2"])
    often = once.filter(F.col("_n") > copies).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / copies))))
    often = often.repartition("_k1", "_k2", "_chunk").join(places.withColumn("_chunk", chunk), ["_k1", "_k2", "_chunk"])
    return usual.select("_row.*", "shard", "slot").union(often.select("_row.*", "shard", "slot"))


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign_shards(rows, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
