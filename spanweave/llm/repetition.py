"""Quality rules on repetition inside one text, from a suffix array over its words.

Each text's words are ranked as integers, its suffixes are sorted by prefix doubling, and the
longest common prefixes of neighbours give its maximal repeated substrings. Their spans are joined;
a text fails when they cover too large a part of its words or when the longest is too long.
A map over slices of whole texts: no shuffle, memory bounded by the slice or the longest text.

Defined cases: a null or empty text has no words and fails the base rule (too few words); ties and
repeated rows are judged row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .shared import documents
from .suffixes import covered, neighbour_lcp, suffix_array
from .words import codes, slices, split_lines, split_words, sums

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeats(ids: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Per position the longest substring from there, within its text, that is found again there; 0 if under least."""
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.int64)
    upto = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    symbols = text * (ids.max() + 1) + ids
    ends = np.repeat(upto, counts)
    order, levels = suffix_array(symbols, ends)
    lcp = neighbour_lcp(order, levels, ends, least)
    longest = np.zeros(n, dtype=np.int64)
    longest[order] = np.maximum(lcp[:-1], lcp[1:])
    return longest


def repetition_rules(docs: DataFrame, least: int = 5, max_fraction: float = 0.25, max_longest: int = 60) -> DataFrame:
    """Per row of docs (doc_id, text): counts, repeated parts, base_failed and kept.

    least: words in the shortest repeated substring that counts for the method's own limits;
    max_fraction: most of the words that such substrings may cover; max_longest: most words in one.
    """

    def judge(batches):
        for part in slices(batches):
            texts = pc.fill_null(part.column("text"), "")
            words, n_words = split_words(texts)
            upto = np.cumsum(n_words)
            longest = repeats(codes(words), n_words, min(least, WINDOW))
            at = np.arange(len(longest))

            def spread(shortest, longest=longest, at=at, n_words=n_words):
                use = longest >= shortest
                return sums(covered(at[use], longest[use], len(at)), n_words)

            most = np.zeros(len(n_words), dtype=np.int64)
            some = n_words > 0
            if some.any():
                most[some] = np.maximum.reduceat(np.where(longest >= least, longest, 0), (upto - n_words)[some])
            lines, n_lines = split_lines(texts)
            wordy = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(n_lines)), n_lines)[wordy]
            line = codes(lines)[wordy]
            distinct = np.unique(of * (line.max() + 1) + line) // (line.max() + 1) if len(line) else of
            n = len(n_words)
            repeated, spanned = spread(WINDOW), spread(least)
            failed = (n_words < 20) | (100 * repeated > 30 * n_words)
            symbols = pc.count_substring_regex(texts, f"[{SYMBOLS}]")
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"), "n_words": n_words, "word_chars": sums(pc.utf8_length(words).to_numpy(zero_copy_only=False), n_words), "n_symbols": symbols.cast("int64"),
                    "n_dup_lines": np.bincount(of, minlength=n) - np.bincount(distinct, minlength=n), "n_repeat_words": repeated, "n_spanned_words": spanned, "longest_repeat": most,
                    "base_failed": failed, "kept": ~failed & (spanned <= max_fraction * n_words) & (most <= max_longest),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(
        judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_spanned_words long, longest_repeat long, base_failed boolean, kept boolean"
    )


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(documents(spark, sf_dir))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), tokens AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
), numbered AS (
  SELECT doc_id, pos, md5(word) AS h FROM tokens
), grams AS (
  SELECT doc_id, pos,
         CASE WHEN count(*) OVER (o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) = 5 THEN string_agg(h, '') OVER (o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) END AS g5,
         CASE WHEN count(*) OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) = 8 THEN string_agg(h, '') OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS g8
  FROM numbered WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos, g5 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g5) > 1 AS d5, g8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g8) > 1 AS d8 FROM grams
), spread AS (
  SELECT doc_id, bool_or(d5) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5, bool_or(d8) OVER (o ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8
  FROM twice WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), totals AS (
  SELECT doc_id, count(*) FILTER (c5) AS n_spanned_words, count(*) FILTER (c8) AS n_repeat_words FROM spread GROUP BY doc_id
), places AS (
  SELECT doc_id, g5, list(pos ORDER BY pos) AS p FROM grams WHERE g5 IS NOT NULL GROUP BY doc_id, g5 HAVING count(*) > 1
), pairs AS (
  SELECT DISTINCT a.doc_id, a.pos, b.pos - a.pos AS gap FROM (SELECT doc_id, g5, unnest(p) AS pos FROM places) a JOIN (SELECT doc_id, g5, unnest(p) AS pos FROM places) b ON a.doc_id = b.doc_id AND a.g5 = b.g5 AND a.pos < b.pos
), runs AS (
  SELECT doc_id, gap, pos - row_number() OVER (PARTITION BY doc_id, gap ORDER BY pos) AS run FROM pairs
), longest AS (
  SELECT doc_id, max(n) AS longest_repeat FROM (SELECT doc_id, gap, run, count(*) + 4 AS n FROM runs GROUP BY ALL) GROUP BY doc_id
), joined AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_spanned_words, 0)::BIGINT AS n_spanned_words, coalesce(longest_repeat, 0)::BIGINT AS longest_repeat
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN totals USING (doc_id) LEFT JOIN longest USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_spanned_words <= 0.25 * n_words AND longest_repeat <= 60 AS kept
FROM joined
"""
