"""Exact substring dedup over whole texts by longest-previous-factor arrays.

A byte goes if a string of `length` bytes around it starts anywhere else too (or, with keep_first,
started earlier). Texts that are equal as a whole are one class with one member in the search.

1. Each window of `length` bytes has an anchor: the 32-byte string in it with the smallest hash.
   Equal windows have equal anchors at equal offsets. They also share the 176 bytes on the anchor's
   right or on its left, whichever the window has; the hash of those 208 bytes names the group in
   which the window is compared. Consecutive windows with the same anchor form one entry, whose
   snippet is all bytes of its windows.
2. Entries of equal snippets (128-bit digests) are one kind. All windows of a kind with several members are
   repeated; a window that is shared by different kinds lies in kinds of one group. Of each kind in a group of
   several kinds one snippet goes on.
3. A task sorts the suffixes of its groups' snippets by prefix doubling, from the order of eight-byte words
   to that of `length` bytes, dropping suffixes as soon as they are unlike all others. Previous and
   next smaller positions in suffix order, each with the least common prefix on the way, give every suffix its
   longest previous factor; with the order of positions turned round, its longest next factor. Lengths are
   told apart up to `length`. A window goes if its factor has `length` bytes.
4. A group of more than MOST_PER_GROUP kinds is no task's: its snippets are cut by distance from the
   anchor into pieces of 64 windows (then 8, then 1), and the bytes that all windows of a piece share join the
   group's name. Pieces are entries, so steps 2 and 3 do the rest; a piece of one window is
   alike all of its group.

Only digests of entries are counted over the corpus; the text moves once (compressed), to its entries,
and of the snippets only one of each kind in mixed groups.

Defined cases: a null text has no bytes, like an empty one; texts shorter than `length` keep all
their bytes; repeated rows are copies of one another, and with keep_first one of them stays;
doc_id orders texts, null first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, documents, stored
from .suffixes import equal_runs, nearest_smaller
from .words import slices

LENGTH = 400
GRAM, SIDE = 32, 176
MOST_PER_GROUP = 1500


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def block_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each power of two in sizes the hash of the block that begins at each byte; past the end it is cut short."""
    h, found = _mix(data.astype(np.uint64) + np.uint64(1)), {}
    m = 1
    while True:
        if m in sizes:
            found[m] = h
        if m >= max(sizes):
            return found
        new = h * np.uint64(0xD1B54A32D192ED03 + 2 * m)
        new[:-m] += h[m:]
        h, m = _mix(new), 2 * m


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of values[i : i + width] for each i; values past the end count as the largest."""
    n = len(values)
    rows = -(-n // width) + 1
    padded = np.full(rows * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def find_entries(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, key, lo, n of the entries of texts that lie end to end: n windows from byte lo of the row's text."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n_windows = np.maximum(0, sizes - length + 1)
    if not n_windows.sum():
        return (np.zeros(0, dtype=np.int64),) * 4
    h = block_hashes(data, (16, 32, 64, 128))
    # 32 bits of hash and 32 of place, whatever the batch's size: equal windows have the same anchor everywhere
    packed = (_mix(h[32]) >> np.uint64(32) << np.uint64(32)) | np.arange(len(data), dtype=np.uint64)
    least = window_minimum(packed, length - GRAM + 1)
    row = np.repeat(np.arange(len(sizes)), n_windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + starts[row]
    anchor = (least[at] & np.uint64((1 << 32) - 1)).astype(np.int64)
    right = anchor - at <= length - GRAM - SIDE
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (right[1:] != right[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    gram = np.where(right[first], anchor[first], anchor[first] - SIDE)
    key = _mix((_mix(h[128][gram]) + h[64][gram + 128]) * np.uint64(0x2545F4914F6CDD1D) + h[16][gram + 192]) ^ right[first].astype(np.uint64)
    return row[first], key.view(np.int64), at[first] - starts[row[first]], np.diff(np.r_[first, len(row)])


def longest_factors(data: np.ndarray, snippet: np.ndarray, owned: np.ndarray, place: np.ndarray, length: int, following: bool) -> np.ndarray:
    """Owned positions whose longest previous factor (with following: or longest next factor) has `length` bytes.

    data: snippets end to end; snippet: the snippet of each byte; owned: whether a window starts at
    the byte; place: order of the texts' positions, different for different owned positions.
    """
    n = len(data)
    rank = np.full(n, -1, dtype=np.int64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    live = np.arange(max(0, n - 7))
    live = live[snippet[live] == snippet[live + 7]]
    key, width = words[live], 8
    while True:
        if width == length:
            key, live = key[owned[live]], live[owned[live]]
        order = np.argsort(key, kind="stable")
        live, runs = live[order], equal_runs(key[order])
        alike = np.bincount(runs, minlength=len(runs))[runs] > 1 if len(runs) else runs.astype(bool)
        live, runs = live[alike], runs[alike]
        if width == length:
            break
        rank.fill(-1)
        rank[live] = runs
        step = min(width, length - width)
        live = np.sort(live[live + step < n])
        live = live[(rank[live + step] >= 0) & (snippet[live] == snippet[live + step])]
        key, width = rank[live] * n + rank[live + step], width + step
    lcp = np.zeros(len(live) + 1, dtype=np.int64)
    lcp[1:-1] = np.where(runs[1:] == runs[:-1], length, 0)
    factor = longest_previous(place[live], lcp)
    if following:
        factor = np.maximum(factor, longest_previous(-place[live], lcp))
    return live[factor >= length]


def longest_previous(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor at each suffix: the better of the nearest smaller positions above and below it.

    place: positions in suffix order; lcp[i]: common prefix of suffixes i - 1 and i, zero at both ends.
    """
    above = nearest_smaller(place, lcp[:-1])
    below = nearest_smaller(place[::-1], lcp[:0:-1])[::-1]
    return np.maximum(above, below)


def _intervals(tag: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """tag, lo, hi: runs of consecutive starts of a text."""
    order = np.lexsort((start, tag))
    tag, start = tag[order], start[order]
    first = np.flatnonzero(np.r_[True, (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + 1)]) if len(tag) else np.zeros(0, dtype=int)
    last = np.r_[first[1:], len(tag)][: len(first)] - 1
    return pd.DataFrame({"tag": tag[first], "lo": start[first], "hi": start[last]})


def _sorted_groups(batches, length: int, keep_first: bool, most_bytes: int = 1_000_000):
    """Intervals of repeated starts for rows that come sorted by key."""

    def work(pdf):
        pdf = pdf.drop_duplicates(["key", "tag", "lo"])
        data = np.frombuffer(b"".join(pdf["snippet"]), dtype=np.uint8)
        n_own, lo, tag = pdf["n"].to_numpy(), pdf["lo"].to_numpy(), pdf["tag"].to_numpy()
        sizes = n_own + length - 1
        begin = np.cumsum(sizes) - sizes
        snippet = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(data)) - begin[snippet]
        texts = np.unique(np.array(list(zip(pdf["doc_order"], tag)), dtype=[("d", "i8"), ("t", "i8")]), return_inverse=True)[1]
        place = texts[snippet] * (int((lo + sizes).max()) + 1) + lo[snippet] + inside
        at = longest_factors(data, snippet, inside < n_own[snippet], place, length, not keep_first)
        return _intervals(tag[snippet[at]], lo[snippet[at]] + inside[at])

    held = None
    for pdf in itertools.chain(batches, [None]):
        if pdf is None:
            pdf, held = held, None
            if pdf is None:
                return
            stop = len(pdf)
        else:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            stop = int(pdf["key"].searchsorted(pdf["key"].iloc[-1])) if len(pdf) else 0
            held = pdf.iloc[stop:]
        begin = 0
        while begin < stop:
            upto = (pdf["n"].iloc[begin:stop] + length - 1).cumsum().to_numpy()
            end = begin + max(1, int(np.searchsorted(upto, most_bytes)))
            end = min(stop, int(pdf["key"].searchsorted(pdf["key"].iloc[end - 1], side="right")))
            yield work(pdf.iloc[begin:end])
            begin = end


def _removed(intervals, size: int, length: int) -> np.ndarray:
    change = np.zeros(size + 1, dtype=np.int32)
    for x in intervals:
        change[x["lo"]] += 1
        change[x["hi"] + length] -= 1
    return np.cumsum(change[:-1]) > 0


def _digests(strings: list[bytes]) -> np.ndarray:
    """128-bit digests as two columns of longs."""
    return np.array([xxhash.xxh3_128_digest(t) for t in strings], dtype="V16").view(np.int64).reshape(-1, 2)


#: An entry: its group's name, its snippet's digest, its first window and number of windows.
_ENTRY = "key: long, f1: long, f2: long, lo: int, n: int"


def _entry_lists(per_text: np.ndarray, key: np.ndarray, digests: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.Array:
    """Lists of entries, per_text[i] of them for text i."""
    columns = [pa.array(key.astype(np.int64)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(lo, pa.int32()), pa.array(n, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), pa.StructArray.from_arrays(columns, ["key", "f1", "f2", "lo", "n"]))


#: Windows in a piece of each level.
PIECES = (64, 8, 1)


def _pieces(data: bytes, anchor: int, lo: int, n: int, width: int, length: int):
    """lo and n of the windows from lo on, cut by their distance from the anchor into pieces of `width`, and a name for the distance and for the bytes that all windows of such a piece share."""
    for piece in range((anchor - lo - n + 1) // width, (anchor - lo) // width + 1):
        first, last = anchor - piece * width - width + 1, anchor - piece * width
        begin, end = max(first, lo), min(last, lo + n - 1)
        yield begin, end - begin + 1, b"%d:" % piece + data[last : first + length]


def substring_dedup(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, most_per_group: int = MOST_PER_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of from, to in bytes; whole copies: all) for each row of docs.

    With keep_first, the first copy in doc_id order keeps its bytes.
    """
    if length < 2 * (SIDE + GRAM) - GRAM:
        raise ValueError("windows have to hold one of the anchor's sides")
    base = "doc_id long, tag long, c1 long, c2 long, n_bytes long, whole_sha256 string"

    def scan(batches):
        task, count = TaskContext.get().partitionId() << 32, 0
        for part in slices(batches, max_bytes=1_000_000):
            texts = [t.encode() for t in part.column("text").fill_null("").to_pylist()]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            row, key, lo, n = find_entries(np.frombuffer(b"".join(texts), dtype=np.uint8), sizes, length)
            full = _digests([texts[r][a : a + m + length - 1] for r, a, m in zip(row.tolist(), lo.tolist(), n.tolist())])
            digests = _digests(texts)
            tags = task + count + np.arange(len(texts))
            count += len(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"), "tag": tags, "c1": digests[:, 0].copy(), "c2": digests[:, 1].copy(), "n_bytes": sizes, "whole_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
                    "entries": _entry_lists(np.bincount(row, minlength=len(texts)), key, full, lo, n),
                }
            )

    rows = stored(docs.select("doc_id", "text").mapInArrow(scan, f"{base}, entries array<struct<{_ENTRY}>>"))
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    classes = cut(rows.groupBy("c1", "c2").agg(F.min(F.struct(order.alias("doc_order"), "tag")).alias("first"), F.count("*").alias("copies")).select("first.*", "copies"))
    found = rows.select("tag", "entries").join(classes.select("tag", "doc_order"), "tag").select("tag", "doc_order", F.inline("entries"))
    settled, mixed = _judged(found, keep_first)
    slim = rows.select(F.col("doc_id").alias("id"), "tag", F.col("c1").alias("d1"), F.col("c2").alias("d2"))
    named = settled.select("tag").union(mixed.select("tag")).distinct().join(slim, "tag").join(classes.select("tag", "doc_order"), "tag")

    def shrink(batches):
        for part in slices(batches, max_bytes=4_000_000):
            texts = [t.encode() for t in part.column("text").fill_null("").to_pylist()]
            digests, packer = _digests(texts), zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "c1": digests[:, 0].copy(), "c2": digests[:, 1].copy(), "packed": [packer.compress(t) for t in texts]})

    # Rows that share doc_id and text stand for one another; each brings the same snippets.
    packed = docs.select("doc_id", "text").mapInArrow(shrink, "doc_id long, c1 long, c2 long, packed binary")
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))
    located = cut(packed.join(named, match).select("tag", "doc_order", "packed"))

    def snip(batches):
        schema = pa.schema([("key", "int64"), ("tag", "int64"), ("doc_order", "int64"), ("lo", "int32"), ("n", "int32"), ("snippet", "binary")])
        for part in slices(batches, "packed", max_bytes=500_000):
            out = []
            for tag, doc_order, packed, wanted in zip(*(part.column(c).to_pylist() for c in ("tag", "doc_order", "packed", "wanted"))):
                data = zstandard.decompress(packed)
                out += [(w["key"], tag, doc_order, w["lo"], w["n"], data[w["lo"] : w["lo"] + w["n"] + length - 1]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    def cut_up(width):
        def run(batches):
            for part in slices(batches, "packed", max_bytes=500_000):
                out, names, counts = [], [], []
                for packed, wanted in zip(part.column("packed").to_pylist(), part.column("wanted").to_pylist()):
                    data, before = zstandard.decompress(packed), len(out)
                    rank = _mix(block_hashes(np.frombuffer(data, dtype=np.uint8), (GRAM,))[GRAM]) >> np.uint64(26)
                    for w in wanted:
                        anchor = w["lo"] + int(np.argmin(rank[w["lo"] : w["lo"] + length - GRAM + 1]))
                        for lo, n, shared in _pieces(data, anchor, w["lo"], w["n"], width, length):
                            out.append((lo, n, data[lo : lo + n + length - 1]))
                            names.append(xxhash.xxh3_64_intdigest(shared, w["key"] & (1 << 64) - 1))
                    counts.append(len(out) - before)
                lo, n = (np.array([x[k] for x in out], dtype=np.int32) for k in (0, 1))
                lists = _entry_lists(np.array(counts, dtype=np.int64), np.array(names, dtype=np.uint64).view(np.int64), _digests([x[2] for x in out]), lo, n)
                yield pa.RecordBatch.from_pydict({"tag": part.column("tag"), "doc_order": part.column("doc_order"), "entries": lists})

        return run

    starts, wanted = settled, lambda df: located.join(df.groupBy("tag").agg(F.collect_list(F.struct("key", "lo", "n")).alias("wanted")), "tag")
    for width in (*PIECES, None):
        snippets = wanted(mixed.filter(F.col("kinds") <= most_per_group)).mapInArrow(snip, "key long, tag long, doc_order long, lo int, n int, snippet binary")
        groups = snippets.repartition("key").sortWithinPartitions("key")
        starts = starts.union(groups.mapInPandas(lambda b: _sorted_groups(b, length, keep_first), "tag long, lo int, hi int"))
        hot = mixed.filter(F.col("kinds") > most_per_group)
        if hot.isEmpty():
            break
        pieces = wanted(hot).mapInArrow(cut_up(width), f"tag long, doc_order long, entries array<struct<{_ENTRY}>>")
        settled, mixed = _judged(cut(pieces.select("tag", "doc_order", F.inline("entries")).distinct()), keep_first)
        starts = starts.union(settled)
    spans = starts.groupBy("tag").agg(F.collect_set(F.struct("lo", "hi")).alias("intervals"))

    def remove(batches):
        for part in slices(batches, "packed", max_bytes=1_000_000):
            out = []
            for tag, packed, intervals in zip(*(part.column(c).to_pylist() for c in ("tag", "packed", "intervals"))):
                data = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
                gone = _removed(intervals, len(data), length)
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                out.append((tag, int(gone.sum()), len(edges) // 2, hashlib.sha256(data[~gone].tobytes()).hexdigest(), edges.reshape(-1, 2).tolist()))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.list_(pa.list_(pa.int64())))], ["tag", "n_removed", "n_spans", "kept_sha256", "spans"])

    once = located.select("tag", "packed").join(spans, "tag")
    parts = once.mapInArrow(remove, "tag long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>").dropDuplicates(["tag"])
    whole = rows.select("doc_id", "tag", "n_bytes", "whole_sha256", "c1", "c2").join(classes.filter("copies > 1").join(slim.select("tag", "d1", "d2"), "tag").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("tag").alias("first_tag")), ["c1", "c2"], "left")
    copied = F.col("first_tag").isNotNull() & (F.col("n_bytes") >= length)
    if keep_first:
        copied &= F.col("first_tag") != F.col("tag")
    none = hashlib.sha256().hexdigest()
    empty = F.array().cast("array<array<long>>")
    return whole.join(parts, "tag", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(none)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(copied, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", empty)).alias("spans"),
    )


def _judged(entries: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """Intervals (tag, lo, hi) that are repeated with all their windows, and one entry of each kind in groups of several kinds, with its group's number of kinds."""
    sizes = cut(entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key"))
    entries = stored(entries.join(sizes, "key"))
    kinds = cut(entries.groupBy("key", "f1", "f2").agg(F.count("*").alias("members"), F.min(F.struct("doc_order", "tag", "lo", "n")).alias("first")))
    again = entries.join(kinds.filter("members > 1").select("key", "f1", "f2", "first"), ["key", "f1", "f2"])
    if keep_first:
        again = again.filter(F.struct("doc_order", "tag", "lo", "n") != F.col("first"))
    groups = kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = cut(kinds.join(groups, "key").select("key", "first.tag", "first.doc_order", "first.lo", "first.n", "kinds"))
    return again.select("tag", "lo", (F.col("lo") + F.col("n") - 1).alias("hi")), mixed


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
