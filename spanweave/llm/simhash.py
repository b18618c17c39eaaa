"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it set.
Fingerprints that differ in at most three bits are linked, and linked documents form groups.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Three errors leave at least two of
the three segments with one error at most, and eight leave one segment with two at most
(pigeonhole). Each segment is decoded with the perfect Golay code of length 23: every word lies
within three bits of exactly one codeword. If two words differ in e bits at most, the codeword next
to the one lies within 3 + e bits of the other. So a fingerprint is stored under the indices of its
nearest codewords and looked up under those of all codewords within 3 + e bits (about five for one
error, 22 for two). Up to three bits, the keys are pairs of segments; up to eight, single segments.
Rows that share a key meet, are compared bit by bit, and only verified links remain.

Equal texts share a fingerprint and are one row from the first step on, whatever their number.
Tasks reduce the links that they find to one edge per fingerprint. A key under which many
fingerprints meet is dealt out as pairs of chunks of stored and of looked-up rows, so that every
pair is still compared, by tasks of bounded size.

Defined cases: a null, empty or blank text has no words and fingerprint zero, and is linked like
any other; fewer words than a shingle give one shingle of all words; repeated rows share a
component; a null doc_id never names a component unless all its members are null; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shared import cut, documents, marked, stored
from .words import slices

#: The generator polynomial of the binary Golay code and the segments (first bit, bits).
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
MOST_PER_KEY = 4096
#: Bands and MinHash values in each; up to so many sets under one key are all paired.
BANDS, ROWS = 16, 4
ALL_PAIRS = 16
#: Sets, and shingles in them, of a chunk; sets of a larger key that are not connected yet are all compared, chunk by chunk.
CHUNK, CHUNK_SHINGLES = 512, 1_000_000
#: Columns of the matrices of shingles that are multiplied at once.
COLUMNS = 4096


def shingle_hashes(text: str | None, size: int) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(b" ".join(words), 42)]
    return [h(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(size)))]


def fingerprints(texts: list[str | None], size: int) -> np.ndarray:
    """64-bit fingerprints as unsigned integers."""
    return np.array([majority(np.array(shingle_hashes(t, size), dtype=">u8")) for t in texts], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (big-endian)."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def with_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of docs."""

    def run(batches):
        for part in slices(batches):
            fp = fingerprints(part.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@cache
def error_patterns() -> np.ndarray:
    """For each of the 2**11 syndromes the only error of at most three bits that has it."""
    single = np.array([_remainder(1 << i) for i in range(23)])
    patterns = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        patterns[single[i]] = 1 << i
        for j in range(i):
            patterns[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                patterns[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return patterns


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits; the code is linear."""
    return np.array([_remainder(x) for x in range(4096)]), np.array([_remainder(x << 12) for x in range(2048)])


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    low, high = _remainders()
    return (words ^ error_patterns()[low[words & 4095] ^ high[words >> 12]]) >> 11


def nearby(words: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and indices of all codewords within 3 + errors bits of each word."""
    flips = [0] + [1 << i for i in range(23)] + ([1 << i | 1 << j for i in range(23) for j in range(i)] if errors > 1 else [])
    found = np.sort(np.stack([nearest(words ^ f) for f in flips], axis=1), axis=1)
    fresh = np.concatenate([np.ones((len(words), 1), dtype=bool), found[:, 1:] != found[:, :-1]], axis=1)
    rows, at = np.nonzero(fresh)
    return rows, found[rows, at]


def golay_keys(fp: np.ndarray, bits: int) -> pd.DataFrame:
    """key, fp, stored: where fingerprints are stored, and where they are looked up."""
    unsigned = fp.view(np.uint64)
    segments = [((unsigned >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    near = [nearest(s) for s in segments]
    around = [nearby(s, 1 if bits <= 3 else 2) for s in segments]
    kept, asked = [], []
    for p, (i, j) in enumerate(PAIRS) if bits <= 3 else ():
        kept.append((np.arange(len(fp)), (p << 24) | (near[i] << 12) | near[j]))
        n = np.bincount(around[j][0], minlength=len(fp))
        start = np.cumsum(n) - n
        times = n[around[i][0]]
        left = np.repeat(np.arange(len(times)), times)
        right = np.repeat(start[around[i][0]], times) + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        asked.append((around[i][0][left], (p << 24) | (around[i][1][left] << 12) | around[j][1][right]))
    for p in range(3) if bits > 3 else ():
        kept.append((np.arange(len(fp)), (p << 12) | near[p]))
        asked.append((around[p][0], (p << 12) | around[p][1]))
    rows, keys = (np.concatenate([x[k] for x in kept + asked]) for k in (0, 1))
    return pd.DataFrame({"key": keys, "fp": fp[rows], "stored": np.arange(len(rows)) < len(kept) * len(fp)})


def _links_within(key: np.ndarray, fp: np.ndarray, stored: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between stored and other rows of equal keys; rows are sorted by key, stored ones first."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.r_[starts, len(key)])
    n_stored = np.add.reduceat(stored.astype(np.int64), starts)
    found_a, found_b = [], []
    # every stored row meets all rows of its key after it
    rows = np.flatnonzero(stored)
    last = np.repeat(starts + counts, n_stored)
    reach = last - rows - 1
    upto = np.cumsum(reach)
    begin = 0
    while begin < len(rows):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 4_000_000, side="right")))
        n = reach[begin:stop]
        left = np.repeat(rows[begin:stop], n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= bits
        near &= fp[left] != fp[right]
        found_a.append(fp[left[near]])
        found_b.append(fp[right[near]])
        begin = stop
    return np.concatenate([*found_a, fp[:0]]), np.concatenate([*found_b, fp[:0]])


def _meet(batches, bits: int):
    """Links of rows that come sorted by key, stored rows first; a key's rows may span batches."""
    held = None

    def links(pdf):
        a, b = _links_within(pdf["key"].to_numpy(), pdf["fp"].to_numpy(), pdf["stored"].to_numpy(), bits)
        nodes, roots = forest(a, b)
        return pd.DataFrame({"a": nodes[nodes != roots], "b": roots[nodes != roots]})

    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = pdf["key"].iloc[-1] if len(pdf) else None
        done = pdf["key"] != last
        held = pdf[~done]
        if done.any():
            yield links(pdf[done])
    if held is not None and len(held):
        yield links(held)


def linked(prints: DataFrame, bits: int = 3, chunk: int = MOST_PER_KEY) -> DataFrame:
    """a, b: links between the distinct fingerprints of prints (fp) that connect all within the given bits of each other."""
    if bits > 8:
        raise ValueError("one segment in three is sure to have two errors at most only up to eight errors")

    def emit(batches):
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                yield golay_keys(pdf["fp"].to_numpy()[k : k + 512], bits)

    keyed = prints.mapInPandas(emit, "key long, fp long, stored boolean")
    sizes = keyed.groupBy("key").agg(F.count_if("stored").alias("n_stored"), F.count_if(~F.col("stored")).alias("n_asked"))
    # Each stored chunk of a large key meets each chunk of the rows that are looked up there.
    sizes = sizes.select("key", F.ceil(F.col("n_stored") / chunk).cast("int").alias("n_stored"), F.ceil(F.col("n_asked") / (16 * chunk)).cast("int").alias("n_asked"))
    hot = cut(sizes.filter("n_stored > 0 and n_stored + n_asked > 2"))
    rows = keyed
    if not hot.isEmpty():
        dealt = keyed.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.when(F.col("stored"), F.col("n_stored")).otherwise(F.col("n_asked"))))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("stored"), F.col("n_asked")).otherwise(F.col("n_stored")) - F.lit(1).cast("long"))))
        place = F.xxhash64("key", F.when(F.col("stored"), F.col("own")).otherwise(F.col("other")), F.when(F.col("stored"), F.col("other")).otherwise(F.col("own")))
        rows = keyed.join(hot, "key", "left_anti").union(dealt.select(place.alias("key"), "fp", "stored"))
    order = [F.col("key"), F.col("stored").desc(), F.col("fp")]
    return rows.repartition("key").sortWithinPartitions(*order).mapInPandas(lambda batches: _meet(batches, bits), "a long, b long")


def simhash_groups(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text)."""
    rows = cut(with_fingerprints(docs, size))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(linked(prints.select("fp"), bits))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(groups, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """tag (of doc_id and text), doc_id, t1, t2 (the text's hashes), node (the set's hash), n, fp, bands and shingles (distinct) of each row of docs."""

    def run(batches):
        factors = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for part in slices(batches, max_bytes=2_000_000):
            hashes = [np.array(shingle_hashes(t, size), dtype=np.uint64) for t in part.column("text").to_pylist()]
            sets = [np.unique(h) for h in hashes]
            bands = [band_keys(s, factors) for s in sets]
            longs = lambda lists: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *lists]).view(np.int64)))
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            fp = np.array([majority(h.astype(">u8")) for h in hashes], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in ("tag", "doc_id", "t1", "t2")}, "node": nodes, "n": [len(s) for s in sets], "fp": fp, "bands": longs(bands), "shingles": longs(sets)})

    return tagged(docs).mapInArrow(run, "tag long, doc_id long, t1 long, t2 long, node long, n long, fp long, bands array<long>, shingles array<long>")


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text, the text's hashes, and a tag that rows of one doc_id and text share."""
    hashed = docs.select("doc_id", "text", *(h.alias(n) for n, h in text_hashes().items()))
    return hashed.withColumn("tag", F.xxhash64("doc_id", "t1", "t2"))


def text_hashes() -> dict[str, Column]:
    return {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}


def band_keys(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS MinHash values; none for an empty set."""
    if not len(shingles):
        return shingles
    least = np.full(len(factors), (1 << 64) - 1, dtype=np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[k : k + 4096, None] * factors).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def met_pairs(members: DataFrame) -> DataFrame:
    """a, a_tag, a_n, b, b_tag, b_n (a < b): all pairs of the members (key, node, tag, n) of each key; keys have few."""
    grouped = members.groupBy("key").agg(F.collect_set(F.struct("node", "tag", "n")).alias("all"))
    with_x = grouped.filter(F.size("all") > 1).select("all", F.explode("all").alias("x"))
    y = F.explode(F.filter("all", lambda y: y["node"] > F.col("x.node")))
    return with_x.select("x", y.alias("y")).select(F.col("x.node").alias("a"), F.col("x.tag").alias("a_tag"), F.col("x.n").alias("a_n"), F.col("y.node").alias("b"), F.col("y.tag").alias("b_tag"), F.col("y.n").alias("b_n"))


def common_counts(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the rows' sets has in common with each of the columns'."""
    tokens, at = np.unique(np.concatenate([*rows, *columns]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(x) for x in (*rows, *columns)])
    mine = owner < len(rows)
    both = (np.bincount(at[mine], minlength=len(tokens)) > 0) & (np.bincount(at[~mine], minlength=len(tokens)) > 0)
    rank = np.cumsum(both) - 1
    owner, at = owner[both[at]], rank[at[both[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    found = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for low in range(0, int(both.sum()), COLUMNS):
        begin, end = np.searchsorted(at, (low, low + COLUMNS))
        held = np.zeros((len(rows) + len(columns), COLUMNS), dtype=np.float32)
        held[owner[begin:end], at[begin:end] - low] = 1
        found += (held[: len(rows)] @ held[len(rows) :].T).astype(np.int64)
    return found


def across(members: DataFrame, similarity: float, sets_of) -> DataFrame:
    """a, b: links that connect all members (key, node, tag, n, label) of a key whose sets are similar and whose labels differ.

    All members are rows of a table and those without the key's most frequent label its columns. Tasks take rectangles of it, with the
    sets of its sides, count what each row has in common with each column, and leave one link for each set.
    """
    parts = members.groupBy("key", "label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    whole = F.struct(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles"))
    most = parts.groupBy("key").agg(whole.alias("all"), F.max(F.struct("sets", "label", "shingles")).alias("main")).filter("all.sets > main.sets")
    chunks = lambda sets, shingles: F.ceil(F.greatest(sets / CHUNK, shingles / CHUNK_SHINGLES)).cast("int")
    col = F.col
    most = cut(most.select("key", col("main.label").alias("main"), chunks(col("all.sets"), col("all.shingles")).alias("rows"), chunks(col("all.sets") - col("main.sets"), col("all.shingles") - col("main.shingles")).alias("columns")))
    members = cut(members.join(most, "key"))
    sets = stored(sets_of(members.select("tag").distinct()).dropDuplicates(["tag"]))
    upto = lambda n: F.explode(F.sequence(F.lit(0), col(n) - 1))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), col(n)).cast("int")
    rows = members.select("key", "node", "tag", "label", F.lit(True).alias("row"), dealt("rows", 1).alias("i"), upto("columns").alias("j"))
    columns = members.filter("label <> main").select("key", "node", "tag", "label", F.lit(False).alias("row"), upto("rows").alias("i"), dealt("columns", 2).alias("j"))

    def link(pdf):
        mine = pdf["row"].to_numpy(dtype=bool)
        (a, x), (b, y) = ((part["node"].to_numpy(), part["label"].to_numpy()) for part in (pdf[mine], pdf[~mine]))
        left, right = ([np.asarray(s) for s in part] for part in (pdf["shingles"][mine], pdf["shingles"][~mine]))
        if not left or not right:
            return pd.DataFrame({"a": a[:0], "b": a[:0]})
        common = common_counts(left, right)
        total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])
        i, j = np.nonzero((common >= similarity * (total - common)) & (x[:, None] != y))
        nodes, roots = forest(a[i], b[j])
        return pd.DataFrame({"a": nodes[nodes != roots], "b": roots[nodes != roots]})

    return cut(rows.union(columns).join(sets, "tag").groupBy("key", "i", "j").applyInPandas(link, "a long, b long"))


def verified(pairs: DataFrame, similarity: float, sets_of) -> DataFrame:
    """a, b: the pairs (see met_pairs) whose sets have that Jaccard similarity, counted exactly; sets_of(asked tags) gives their sets."""
    pairs = pairs.filter(F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n"))
    pairs = cut(pairs.select("a", "a_tag", "b", "b_tag").distinct())
    asked = [pairs.select(F.col(c).alias("tag")).distinct() for c in ("a_tag", "b_tag")]
    sets = stored(sets_of(asked[0].union(asked[1])).dropDuplicates(["tag"]))
    of = lambda tag, name: sets.select(F.col("tag").alias(tag), F.col("shingles").alias(name))
    both = pairs.join(of("a_tag", "x"), "a_tag").join(of("b_tag", "y"), "b_tag")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"))


def similar_sets(rows: DataFrame, similarity: float, all_pairs: int = ALL_PAIRS, sets_of=None) -> DataFrame:
    """a, b: links between nodes of rows (see shingle_sets), so that all sets with at least that Jaccard similarity, counted exactly, are connected.

    Sets meet under keys: the component of their fingerprints (op10's: Golay keys, three bits), and BANDS
    bands of MinHash values for what the fingerprints of similar sets lie apart. Up to all_pairs sets
    under a key are all paired. Under a larger key each set meets the first. Where that leaves sets of a key
    unconnected, all pairs of sets that are in different components yet are compared, whatever the key's size.
    """
    sets_of = sets_of or (lambda asked: marked(rows.select("tag", "shingles"), asked))
    distinct = cut(rows.filter("n > 0").select("tag", "node", "n", "fp", "bands").dropDuplicates(["node"]))
    roots = connected_components(linked(distinct.select("fp").distinct()))
    near = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("golay", F.xxhash64(F.lit("golay"), F.coalesce("root", "fp")))
    keyed = cut(near.select("tag", "node", "n", F.explode(F.concat("bands", F.array("golay"))).alias("key")))
    met = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "tag", "n")).alias("first")).filter("size > 1")
    members = cut(keyed.join(met, "key"))
    large = members.filter(F.col("size") > all_pairs)
    star = large.filter("node <> first.node").select(*star_columns())
    links = verified(met_pairs(members.filter(F.col("size") <= all_pairs)).union(star), similarity, sets_of)
    if large.isEmpty():
        return links
    labels = connected_components(links)
    named = large.select("key", "node", "tag", "n").join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("key")
    mixed = cut(named.join(mixed, "key"))
    return links if mixed.isEmpty() else links.union(across(mixed, similarity, sets_of))


def star_columns() -> list:
    """The columns of a pair (see met_pairs) of a row and the first of its key."""
    one, other = F.least(F.struct("node", "tag", "n"), F.struct("first.node", "first.tag", "first.n")), F.greatest(F.struct("node", "tag", "n"), F.struct("first.node", "first.tag", "first.n"))
    return [x[c].alias(f"{side}_{c}" if c != "node" else side) for x, side in ((one, "a"), (other, "b")) for c in ("node", "tag", "n")]


def one_of_each_group(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of docs; pairs whose sets of shingles have that Jaccard similarity are linked, and groups are what links connect.

    Of pairs at 0.8 one in 4,500 shares no MinHash band. A row is known by its doc_id and its text, so
    rows that repeat an id with another text, or have none, are judged by their own text. The row of
    the smallest doc_id stays, null last, and one of its repeats. Sets are made again where they are
    compared, and not kept for all rows.
    """
    rows = stored(shingle_sets(docs, size).drop("shingles"))
    again = lambda asked: shingle_sets(marked(tagged(docs), asked).select("doc_id", "text"), size).select("tag", "shingles")
    roots = connected_components(similar_sets(rows, similarity, sets_of=again))
    keyed = rows.select("doc_id", "t1", "t2", "node").join(roots, "node", "left").select("doc_id", "t1", "t2", F.coalesce("root", "node").alias("root"))
    keyed = cut(keyed.groupBy("doc_id", "t1", "t2", "root").agg(F.count("*").alias("times")))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    firsts = keyed.groupBy("root").agg(F.min(key).alias("first"))
    judged = cut(keyed.join(firsts, "root").select(F.col("doc_id").alias("_id"), F.col("t1").alias("_h1"), F.col("t2").alias("_h2"), "times", (key == F.col("first")).alias("stays")))
    hashes = text_hashes()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (hashes["t1"] == F.col("_h1")) & (hashes["t2"] == F.col("_h2"))
    kept = docs.join(judged.filter("not stays").select("_id", "_h1", "_h2"), same, "left_anti")
    repeated = judged.filter("stays and times > 1").select("_id", "_h1", "_h2")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, same, "left_anti").union(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
