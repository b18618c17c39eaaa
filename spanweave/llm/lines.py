"""Line dedup: repeated runs of lines, from a suffix array over line ids by distributed prefix doubling.

The lines with a word of each document are a sequence of line ids. Every round ranks the suffixes
by twice as many lines: the distinct pairs (rank here, rank h lines on) that occur more than once
are sorted by range and numbered through, and the rank goes back to the suffixes. Suffixes unlike
all others leave, so the rounds shrink; they end when all suffixes differ.

Suffixes of equal rank by h lines are an interval of the suffix array with a longest common prefix of
h or more. From `least` lines on, each such interval that the next round splits gets its exact longest
common prefix: shorter and shorter ranks are tried at its end, and one is added where all members agree. These
are the repeated runs; one is maximal if its copies are not all preceded by the same line, and as its
length is exact they are not all followed by the same one. The first copy, by doc_id and position, stays; the
lines of later copies are deleted. Intervals that begin and split within one doubling are not listed:
their lines are later copies of a listed, shorter one that they begin with, and of those that begin inside.

Pairs are counted before they are sorted, so a line that stands in a third of all documents is one
row there, and the joins that hand ranks back can be split by Spark where a line is very common.

Defined cases: lines without a word are never deleted and don't part a run; a null text has no
lines; rows that repeat doc_id and text are one document and get the same result; within a text
that repeats one line all but its first are later copies; doc_id orders documents, null first; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, cut, documents, stored
from .suffixes import covered
from .words import slices, split_lines


def _ranked(suffixes: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """doc, at, rank of the suffixes that share by with others, and by, rank, n of what they share; ranks are in the order of by."""
    pairs = suffixes.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    ranged = stored(pairs.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("m"))
    starts = F.broadcast(sizes.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("start")))  # a row per range
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*by))
    shared = ranged.withColumn("inside", inside).join(starts, "range").select(*by, (F.col("start") + F.col("inside")).alias("number"), "n")
    ranks = suffixes.join(shared, list(by)).select("doc", "at", F.col("number").alias("rank"))
    return stored(ranks), shared


def _lines(docs: DataFrame) -> DataFrame:
    """doc (doc_id, print), at, a, b: the lines with a word by two hashes, rows that repeat doc_id and text once."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    doc = F.struct(F.col("doc_id"), F.xxhash64(text).alias("print")).alias("doc")
    rows = docs.select(doc, F.posexplode(lines).alias("at", "line"))
    rows = rows.select("doc", "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    return stored(rows.dropDuplicates(["doc", "at"]))


def _intervals(lines: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The intervals of the suffix array with `least` lines or more in common that the next doubling splits.

    Returns level, rank (which name an interval), doc, at of their members, and level, rank, n, length of the intervals.
    """
    ranks, shared = _ranked(lines, "a", "b")
    levels, length = [(1, ranks)], 1
    members, groups = None, None
    while True:
        step = min(length, least - length) if length < least else length
        ahead = ranks.select("doc", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        longer, split = _ranked(ranks.join(ahead, ["doc", "at"]), "rank", "next")
        if length >= least:
            here = shared.select(F.col("number").alias("rank"), "n").join(split.select("rank", "n"), ["rank", "n"], "left_anti")
            here = stored(here.select(F.lit(length).alias("level"), "rank", "n", F.lit(length).alias("length")))
            those = ranks.join(here, "rank").select("level", "rank", "doc", "at")
            members, groups = (those, here) if members is None else (members.union(those), groups.union(here))
        if length >= least and longer.isEmpty():
            break
        ranks, shared, length = longer, split, length + step
        levels.append((length, ranks))
    members = stored(members)
    for step, ranks in reversed(levels[:-1]):
        ends = members.join(groups.filter(F.col("level") > step), ["level", "rank"])
        ends = ends.select("level", F.col("rank").alias("group"), "n", "doc", (F.col("at") + F.col("length")).alias("at")).join(ranks, ["doc", "at"])
        agree = ends.groupBy("level", "group", "n").agg(F.count("*").alias("found"), F.min("rank").alias("low"), F.max("rank").alias("high"))
        agree = agree.filter("found = n AND low = high").select("level", F.col("group").alias("rank"), F.lit(step).alias("more"))
        groups = groups.join(agree, ["level", "rank"], "left").select("level", "rank", "n", (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"))
        groups = cut(groups)
    return members, groups


def repeated_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc (doc_id, print), at, length: the places among a document's lines with a word where a later copy of a run begins."""
    members, groups = _intervals(_lines(docs), least)
    first = members.groupBy("level", "rank").agg(F.min(F.struct("doc", "at")).alias("first"))
    later = members.join(groups.join(first, ["level", "rank"]), ["level", "rank"]).filter(F.struct("doc", "at") != F.col("first"))
    return later.groupBy("doc", "at").agg(F.max("length").alias("length"))


def maximal_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """first_doc_id, first_at, length, copies of the listed runs whose copies are not all preceded by the same line."""
    lines = _lines(docs)
    members, groups = _intervals(lines, least)
    before = lines.select("doc", (F.col("at") + 1).alias("at"), "a", "b")
    sides = members.join(before, ["doc", "at"], "left").groupBy("level", "rank").agg(
        F.min(F.struct("doc", "at")).alias("first"), F.count("a").alias("preceded"), F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")
    )
    runs = groups.join(sides, ["level", "rank"]).filter("preceded < n OR low != high")
    return runs.select(F.col("first.doc.doc_id").alias("first_doc_id"), F.col("first.at").alias("first_at"), "length", F.col("n").alias("copies"))


def dedup_lines(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, n_runs, text (what is left) for each row of docs (doc_id, text)."""
    starts = repeated_runs(docs, least).groupBy("doc").agg(F.collect_list("at").alias("starts"), F.collect_list("length").alias("lengths"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("print"))
    found = starts.select(F.col("doc.doc_id").alias("id"), F.col("doc.print").alias("p"), "starts", "lengths")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("print") == F.col("p")), "left").select("doc_id", "text", "starts", "lengths")

    def delete(batches):
        for part in slices(batches):
            lines, counts = split_lines(part.column("text"))
            wordy = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(counts)])
            lines, out = lines.to_pylist(), []
            for i, (text, starts, lengths) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "starts", "lengths")))):
                low, high = upto[i], upto[i + 1]
                places = np.flatnonzero(wordy[low:high])
                if not starts:
                    out.append((len(places), 0, 0, text))
                    continue
                gone = np.append(covered(np.array(starts), np.array(lengths), len(places)), False)
                keep = np.ones(high - low, dtype=bool)
                keep[places[gone[:-1]]] = False
                out.append((len(places), int(gone.sum()), int((np.diff(gone.astype(np.int8)) == -1).sum()), "\n".join(x for x, k in zip(lines[low:high], keep) if k)))
            n, removed, runs, kept = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "n_runs", "text"])

    return rows.mapInArrow(delete, "doc_id long, n_lines long, n_removed long, n_runs long, text string")


def op9_line_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "n_runs", F.md5("text").alias("kept_md5"))


OP9_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), wordy AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), grams AS (
  SELECT doc_id, i, pos, CASE WHEN (count(*) OVER g) = 3 THEN string_agg(md5(line), '') OVER g END AS gram
  FROM wordy WINDOW g AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
), later AS (
  SELECT *, gram IS NOT NULL AND row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) > 1 AS starts FROM grams
), marked AS (
  SELECT doc_id, i, pos, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM later
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked
)
SELECT s.doc_id, count(r.pos)::BIGINT AS n_lines, count(*) FILTER (r.gone)::BIGINT AS n_removed, count(*) FILTER (r.opens)::BIGINT AS n_runs,
       md5(coalesce(string_agg(s.line, chr(10) ORDER BY s.i) FILTER (NOT coalesce(r.gone, false)), '')) AS kept_md5
FROM split s LEFT JOIN runs r USING (doc_id, i) GROUP BY s.doc_id
"""
