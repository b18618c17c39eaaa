"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage.

Spark builds the inverted index (term statistics over all items); an item's score is given
as a part of the score that the item's own words get, so that one threshold holds for all items.
Passages are windows of twice the longest item's words, half overlapping, so every place where an
item can stand lies whole in some passage. Items lie in blocks; a passage first adds up each
term's largest weight, then its largest weight in each block, and only blocks whose bound
reaches the threshold are scored exactly (block-max WAND). All items at or above the threshold are
retrieved, and kept if enough word triples of both the question (first sentence) and the
answer (the rest) stand in one window of the passage, of twice the item's own words, so an item's result does not
depend on how long the longest is. A part of under eight words, where one edit would spoil over
half of the triples, is held by its pairs, one of under five by its words. Items of under eight
words are kept only if all their words stand in the passage, one after the other.

The documents are only mapped over. The index is sent to the executors in parts of at most
MOST_POSTINGS postings each, made, searched and dropped one after the other, with one pass over the
documents for each part: what the driver and an executor hold has a bound, whatever the number of items.

Defined cases: a null or empty text contains nothing; null and blank items, and items of
punctuation alone, are not searched; repeated items are each reported;
repeated rows are judged alike; an empty benchmark leaves every document alone; other columns of
the tables are carried along unread.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, documents, word_count
from .words import slices, split_words

PUNCTUATION = ".,;:!?\"'()[]{}|*#&%$<>"
MOST_POSTINGS = 2_000_000
BLOCK = 16
K1, B = 1.2, 0.75
LEAST_WORDS = 8


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct normalised words, the code of each word of the texts, and the number of words in each text."""
    words, counts = split_words(texts)
    encoded = words.dictionary_encode()
    return pc.utf8_trim(pc.utf8_lower(encoded.dictionary), characters=PUNCTUATION), encoded.indices.to_numpy(zero_copy_only=False), counts


def normalised(text: str) -> list[str]:
    terms, at, _ = terms_of(pa.array([text], pa.string()))
    terms = terms.to_pylist()
    return [terms[i] for i in at]


@dataclass
class Index:
    """One part of the inverted index; postings are sorted by term, then item."""

    terms: pa.Array
    term_start: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_weight: np.ndarray
    most: np.ndarray
    ids: list
    parts: list
    sizes: list
    span: int


def _postings(items: DataFrame) -> DataFrame:
    """item_id, part texts and weights of all terms: BM25 scores over the item's score for its own words."""

    def split(batches):
        for batch in batches:
            terms, at, counts = terms_of(batch.column("text"))
            of = np.repeat(np.arange(batch.num_rows), counts)
            yield pa.RecordBatch.from_pydict({"item": batch.column("item").take(pa.array(of)), "n": np.repeat(counts, counts), "term": terms.take(pa.array(at))})

    words = items.select("item", "text").mapInArrow(split, "item long, n long, term string").filter("term <> ''")
    tf = cut(words.groupBy("item", "n", "term").agg(F.count("*").alias("tf")))
    n_items, mean = tf.select("item", "n").distinct().agg(F.count("*"), F.avg("n")).first()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_items) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(mean or 1.0)))
    scored = tf.join(df, "term").withColumn("score", score)
    own = scored.groupBy("item").agg(F.sum("score").alias("own"))
    return scored.join(own, "item").select("item", "term", (F.col("score") / F.col("own")).alias("weight"))


def halves(text: str) -> tuple[list[str], list[str]]:
    """Words of the question, up to the first end of a sentence or line, and of the answer.

    An item without an answer, or without a question, is halved; one of a single word has no answer.
    """
    ends = [i + 1 for i in (text.find(c) for c in "?\n.") if i >= 0]
    at = min(ends, default=len(text))
    question, answer = ([w for w in normalised(part) if w] for part in (text[:at], text[at:]))
    if question and answer:
        return question, answer
    words = question + answer
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def build_index(items: DataFrame, most_postings: int = MOST_POSTINGS) -> list[Index]:
    """The index in parts of bounded size, all at once. items: item_id, text."""
    return list(index_parts(items, most_postings))


def index_parts(items: DataFrame, most_postings: int = MOST_POSTINGS) -> Iterator[Index]:
    """The index in parts of bounded size, made one at a time."""
    count = word_count(F.col("text"))
    with_words = items.select("item_id", "text").filter(count > 0)
    named = cut(with_words.withColumn("item", F.xxhash64("item_id", "text", F.monotonically_increasing_id())).withColumn("n", count))
    total, span = named.agg(F.sum("n"), F.max("n")).first()
    n_parts = -(-(total or 0) // most_postings)
    weights = cut(_postings(named)) if n_parts else None
    for part in range(n_parts):
        mine = F.pmod(F.col("item"), F.lit(n_parts)) == part
        of = named.filter(mine).select("item", "item_id", "text", "n").toPandas().sort_values("item", ignore_index=True)
        post = weights.filter(mine).toPandas()
        post["at"] = np.searchsorted(of["item"].to_numpy(), post["item"].to_numpy())
        terms, code = np.unique(post["term"].to_numpy(dtype=object).astype(str), return_inverse=True)
        order = np.lexsort((post["at"].to_numpy(), code))
        code, item, weight = code[order], post["at"].to_numpy()[order], post["weight"].to_numpy()[order]
        key = code * (len(of) // BLOCK + 1) + item // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=int)
        starts = lambda c: np.searchsorted(c, np.arange(len(terms) + 1))  # noqa: E731, B023
        most = np.zeros(len(terms))
        np.maximum.at(most, code, weight)
        yield Index(pa.array(terms.tolist(), pa.string()), starts(code), item, weight, starts(code[first]), (item // BLOCK)[first], np.maximum.reduceat(weight, first) if len(first) else weight, most, of["item_id"].tolist(), [halves(t) for t in of["text"]], of["n"].tolist(), span)


def _expand(start: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row all postings of its term: row numbers and places in the postings."""
    n = start[code + 1] - start[code]
    rows = np.repeat(np.arange(len(code)), n)
    return rows, np.repeat(start[code], n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys in order; runs that are in order already cost little."""
    keys = np.sort(keys, kind="stable")
    return keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]


def _reached(key: np.ndarray, weight: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys, of n possible ones, whose weights sum to `least`, in order, and the sums."""
    if least > 0 and n <= 8 * len(key):
        total = np.bincount(key, weight, minlength=n)
        keys = np.flatnonzero(total >= least)
        return keys, total[keys]
    keys, which = np.unique(key, return_inverse=True)
    total = np.bincount(which, weight, minlength=len(keys))
    return keys[total >= least], total[total >= least]


def _among(keys: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    """Whether each of the keys, of n possible ones, is one of some, which are sorted and not none."""
    if n <= 8 * len(keys):
        mark = np.zeros(n, dtype=bool)
        mark[some] = True
        return mark[keys]
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def retrieve(index: Index, passage: np.ndarray, code: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """passage, item, score of all that reach the threshold. passage, code: distinct terms of each passage, sorted by passage."""
    if not len(passage):
        return passage, passage, np.zeros(0)
    fits = np.bincount(passage, index.most[code]) >= threshold
    keep = fits[passage]
    # passages that are left are numbered through, so that sums lie in an array
    names, passage, code = np.flatnonzero(fits), (np.cumsum(fits) - 1)[passage[keep]], code[keep]
    rows, at = _expand(index.block_start, code)
    n_blocks = len(index.ids) // BLOCK + 1
    good, _ = _reached(passage[rows] * n_blocks + index.block[at], index.block_weight[at], len(names) * n_blocks, threshold - 1e-9)
    if not len(good):
        return good, good, np.zeros(0)
    held = _distinct(good // n_blocks)
    some = _among(passage, held, len(names))
    passage, code = passage[some], code[some]
    rows, at = _expand(index.term_start, code)
    live = _among(passage[rows] * n_blocks + index.item[at] // BLOCK, good, len(names) * n_blocks)
    rows, at = rows[live], at[live]
    full, score = _reached(np.searchsorted(held, passage)[rows] * len(index.ids) + index.item[at], index.weight[at], len(held) * len(index.ids), threshold - 1e-9)
    return names[held[full // len(index.ids)]], full % len(index.ids), score


def _overlap(part: list[str], words: list[str]) -> float:
    """The share of the part's word triples that words have; of pairs or words if one edit could spoil over half of the triples."""
    if not part:
        return 1.0
    n = 3 if len(part) >= 8 else 2 if len(part) >= 5 else 1
    grams = lambda x: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
    want = grams(part)
    return len(want & grams(words)) / len(want)


def _stands_in(item: list[str], words: list[str]) -> bool:
    """Whether all words of the item stand in words, one after the other; tokens of punctuation alone are passed over."""
    joined = lambda x: f" {' '.join(w for w in x if w)} "
    return joined(item) in joined(words)


def _best_place(parts: tuple[list[str], list[str]], size: int, words: list[str]) -> tuple[float, float]:
    """Overlaps of question and answer where both are best: inside windows of twice the item's own words, half overlapping, so that words far apart do not count together.

    Every place where the item can stand lies whole in some window. Only windows with words of the item are looked at.
    """
    if len(words) <= 2 * size:
        return _overlap(parts[0], words), _overlap(parts[1], words)
    own = set(parts[0]).union(parts[1])
    held = {k // size for k, w in enumerate(words) if w in own}
    best = (0.0, 0.0)
    for k in sorted(held | {k - 1 for k in held if k}):
        window = words[k * size : (k + 2) * size]
        best = max(best, (_overlap(parts[0], window), _overlap(parts[1], window)), key=lambda x: (min(x), sum(x)))
    return best


def hits(texts: pa.Array, index: Index, threshold: float, least: float) -> pd.DataFrame:
    """row, item, score, question_overlap, answer_overlap: the items that texts contain, best passage of each."""
    terms, at, counts = terms_of(texts)
    code = pc.fill_null(pc.index_in(terms, index.terms), -1).to_numpy(zero_copy_only=False)[at]
    start = np.cumsum(counts) - counts
    half = index.span
    row = np.repeat(np.arange(len(counts)), counts)
    # the half windows of all rows, numbered through, with one more after each row's last
    n_halves = counts // half + 2
    base = np.cumsum(n_halves) - n_halves
    place = base[row] + (np.arange(len(row)) - start[row]) // half
    known = np.flatnonzero(code >= 0)
    # with repeated words counted more than once, what a passage of two halves can reach at most
    most = np.bincount(place[known], index.most[code[known]], minlength=int(n_halves.sum()) + 1)
    may = most[:-1] + most[1:] >= threshold - 1e-9
    known = known[(may | np.r_[False, may[:-1]])[place[known]]]
    key = _distinct(place[known] * len(index.terms) + code[known])
    window, term = key // len(index.terms), key % len(index.terms)
    # passage w holds the halves w and w + 1; a row's first half is also the end of no passage
    both = _distinct(np.concatenate([key, (window[window > 0] - 1) * len(index.terms) + term[window > 0]]))
    passage, item, score = retrieve(index, both // len(index.terms), both % len(index.terms), threshold)
    of = np.searchsorted(base, passage, side="right") - 1
    found, names = [], None
    for p, i, s, r in zip(passage, item, score, of):
        names = terms.to_pylist() if names is None else names
        low = start[r] + (p - base[r]) * half
        words = [names[x] for x in at[low : min(low + 2 * half, start[r] + counts[r])]]
        question, answer = _best_place(index.parts[i], index.sizes[i], words)
        if sum(map(len, index.parts[i])) < LEAST_WORDS and not _stands_in([w for part in index.parts[i] for w in part], words):
            continue
        if question >= least and answer >= least:
            found.append((r, i, s, question, answer))
    out = pd.DataFrame(found, columns=["row", "item", "score", "question_overlap", "answer_overlap"])
    return out.sort_values(["row", "item", "score", "question_overlap", "answer_overlap"], ascending=[True, True, False, False, False]).drop_duplicates(["row", "item"])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, least: float = 0.5, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for every test item that a document contains.

    Each part of the index is sent, searched and dropped before the next is made.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in index_parts(items, most_postings):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches, sent=sent):
            for part in slices(batches, max_bytes=1_000_000):
                got = hits(part.column("text"), sent.value, threshold, least)
                ids = [sent.value.ids[i] for i in got["item"]]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(got["row"].to_numpy(dtype=np.int64))), "item_id": pa.array(ids, pa.int64()), **{c: got[c].to_numpy(dtype=float) for c in got.columns[2:]}})

        out = out.union(cut(docs.select("doc_id", "text").mapInArrow(search, schema)))
        sent.unpersist()
    return out


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, least: float = 0.5, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """The rows of docs that contain no test item, with all their columns.

    An index of one part filters the rows as they pass. Of several parts each leaves the hashes of the texts
    that it finds, and rows with such a text go at the end.
    """
    parts = index_parts(items, most_postings)
    index, following = next(parts, None), next(parts, None)
    if index is None:
        return docs

    def keep(texts, sent):
        found = np.ones(len(texts), dtype=bool)
        found[hits(texts, sent.value, threshold, least)["row"].to_numpy(dtype=np.int64)] = False
        return found

    if following is None:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches):
            for part in slices(batches, max_bytes=1_000_000):
                yield part.filter(pa.array(keep(part.column("text"), sent)))

        return docs.mapInArrow(clean, docs.schema)
    names = [F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2")]
    found = None
    for index in itertools.chain([index, following], parts):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def name(batches, sent=sent):
            for part in slices(batches, max_bytes=1_000_000):
                yield part.filter(pa.array(~keep(part.column("text"), sent))).select(["_t1", "_t2"])

        gone = cut(docs.select("text", *names).mapInArrow(name, "_t1 long, _t2 long").distinct())
        found = gone if found is None else found.union(gone)
        sent.unpersist()
    return docs.join(found, [(n == F.col(c)) for n, c in ((F.xxhash64("text"), "_t1"), (F.xxhash64(F.lit(1), "text"), "_t2"))], "left_anti")


def op7_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
