"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within each source the documents are taken in key order
until the source's budget of words is used up; a budget above the source's size takes the whole
source for as many epochs as fit and cuts the last epoch at the budget.

The cut of a source is found from distributed prefix sums: word counts per (source, key bucket),
a running sum over the buckets, and a running sum over the rows of the one bucket in which the
budget ends. The result is a small plan with one row for each source, and applying it to
documents is a join on the source alone: no text is shuffled, and a hot source costs no more
than any other rows.

Defined cases: a null text has no words; a null source is a source of its own, ordered last; a
null doc_id has the key of the empty string; rows that share a doc_id within a source share a key,
are cut together and divide the cut's words in proportion; an empty table gives no rows; other
columns of the input are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, documents, word_count

#: Source weights by the source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)
KEY_BITS = 60


def random_key(doc_id, seed: str = "mix"):
    """Uniform over KEY_BITS bits, the same in any engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Add place: 0 for the smallest source by code point, null last; ranges are counted, then numbered inside."""
    ranged = cut(sources.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    starts = ranged.groupBy("range").agg(F.count("*").alias("n_range")).withColumn(
        "start", F.coalesce(F.sum("n_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("inside", inside).join(starts, "range").withColumn("place", F.col("start") + F.col("inside")).drop("range", "n_range", "start", "inside")


def mixing_plan(sized: DataFrame, total_ratio: float = 1.5, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 2, rows_per_bucket: int = 10_000, seed: str = "mix") -> DataFrame:
    """One row per source: source, source_size, target, epochs (whole ones), cut_key, cut_words, cut_size.

    sized has doc_id, source, size. In the last epoch documents with a key below cut_key are taken
    whole, those at cut_key give cut_words of their cut_size words, and the others give none.
    """
    rows = cut(sized.select("source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), random_key(F.col("doc_id"), seed).alias("key")))
    sources = _numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * max_epochs))
    # Reshare what full sources can't take until no target is above its limit.
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * total_ratio
    level, n_full = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight") if n_full >= 0 else F.lit(False)
        got = sources.agg(F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.sum(full.cast("int"))).first()
        if n_full == (got[2] or 0) or not got[1]:
            level = level if got[1] else float("inf")
            break
        n_full, level = got[2], (total - got[0]) / got[1]
    share = F.lit(level) * F.col("weight")
    target = F.when(F.col("most") <= share, F.col("most").cast("double")).otherwise(share)
    budget = F.floor(F.col("target") + 0.5)
    sources = (
        sources.withColumn("target", target)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(budget / F.col("source_size")), F.lit(max_epochs))).otherwise(0))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("width", F.floor(F.lit(2**KEY_BITS) / F.ceil(F.col("n") / rows_per_bucket)).cast("long"))
    )
    keyed = rows.join(sources.select(F.col("source").alias("s"), "width"), F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", F.floor(F.col("key") / F.col("width")))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    ends = sums.join(sources.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).filter("before <= rest and rest < before + words").select("s", F.col("bucket").alias("b"), "before", "rest")
    last = keyed.drop("s").join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    last = last.groupBy("source", "rest", "before", "key").agg(F.sum("size").alias("cut_size"))
    running = F.sum("cut_size").over(Window.partitionBy("source").orderBy("key"))
    last = last.withColumn("end", F.col("before") + running).filter("rest < end and end - cut_size <= rest")
    last = last.select("source", F.col("key").alias("cut_key"), (F.col("rest") - F.col("end") + F.col("cut_size")).alias("cut_words"), "cut_size")
    cuts = last.alias("c")
    plan = sources.alias("p").join(cuts, F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    return cut(plan.select("p.source", "source_size", "target", "epochs", F.coalesce("cut_key", F.when(F.col("rest") > 0, F.lit(2**62)).otherwise(F.lit(-1))).alias("cut_key"), F.coalesce("cut_words", F.lit(0)).alias("cut_words"), F.coalesce("cut_size", F.lit(1)).alias("cut_size")))


def apply_mixing(sized: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """Add source_size, target, taken (words, exact cut) and copies (whole documents, cut to the nearest)."""
    plan = plan.withColumnRenamed("source", "_source")
    key = random_key(F.col("doc_id"), seed)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_key", key)
    part = F.when(F.col("_key") < F.col("cut_key"), F.col("size")).when(F.col("_key") == F.col("cut_key"), F.floor(F.col("size") * F.col("cut_words") / F.col("cut_size"))).otherwise(0)
    more = F.when((F.col("_key") < F.col("cut_key")) | ((F.col("_key") == F.col("cut_key")) & (F.col("cut_words") * 2 >= F.col("cut_size"))), 1).otherwise(0)
    return joined.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).withColumn("copies", (F.col("epochs") + more).cast("int")).drop("_source", "_key", "epochs", "cut_key", "cut_words", "cut_size")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for each row of docs (doc_id, text, source)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return apply_mixing(sized, mixing_plan(sized, **options))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents: each row of docs as many times as the mix takes it.

    Rows travel as one value, so other columns may have any name.
    """
    plan = mixing_plan(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", F.lit(0).alias("size"))
    mixed = apply_mixing(rows, plan).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS most,
         sum(source_size) OVER ()::DOUBLE * 1.5 AS total FROM sources
), filled AS (
  SELECT *, (total - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level, row_number() OVER o AS pos
  FROM weighed WINDOW o AS (ORDER BY most / weight, source)
), targets AS (
  SELECT f.*, CASE WHEN most <= l.level * weight THEN most::DOUBLE ELSE l.level * weight END AS target
  FROM filled f, (SELECT coalesce(min_by(level, pos) FILTER (level * weight < most), 1e300) AS level FROM filled) l
), budgets AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(floor(floor(target + 0.5) / source_size), 2)::BIGINT ELSE 0 END AS epochs, floor(target + 0.5)::BIGINT AS budget FROM targets
), ordered AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM ordered
"""
