"""Helpers that several corpus operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session may fall back to a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spanweave-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written rows: computed once, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """cut for large tables: Parquet, which packs rows several times closer than a checkpoint."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def power_of_two(at_least: float) -> int:
    """The exponent of the smallest power of two that is at_least."""
    return max(0, int(max(1, -(-at_least // 1)) - 1).bit_length())


def marked(rows: DataFrame, asked: DataFrame, name: str = "tag", bits: int = 23) -> DataFrame:
    """The rows whose `name` (long) is asked for, and some others, found by a bitmap of fixed size (2**bits bits) and without a shuffle of rows.

    Where much is asked for the bitmap is full and all rows pass: a join has to follow.
    """
    size = 1 << bits
    bit = F.pmod(F.xxhash64(name), F.lit(size))
    part, word = F.shiftright(bit, 10), F.shiftright(bit, 6) % 16
    found = asked.select(part.alias("part"), word.alias("word"), (bit % 64).alias("bit"))
    words = found.groupBy("part", "word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
    marks = words.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_marks"))
    joined = rows.withColumn("_part", part).join(F.broadcast(marks.withColumnRenamed("part", "_part")), "_part")
    is_set = F.expr(f"shiftrightunsigned(_marks[shiftright(pmod(xxhash64({name}), {size}L), 6) % 16], cast(pmod(xxhash64({name}), 64L) as int)) & 1L = 1L")
    return joined.filter(is_set).select(*rows.columns)
