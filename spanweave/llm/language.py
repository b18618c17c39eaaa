"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads chunks of CHUNK bytes in both directions, gives every byte a probability for each
language, and a text's probabilities are the mean over all its bytes. It is trained here, in numpy,
by backpropagation through time on a bounded sample of labelled rows (at most `rows_per_language`
rows of each language, `windows_per_row` windows of each) whose crc32(doc_id) mod 5 is not 0. lang has
few values; the sample and the weights grow with their number alone.
Prediction maps over slices of whole texts with the weights in the closure: no shuffle.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is everything if
there is nothing to learn from; repeated rows are judged alike; a null doc_id counts as held out; an
empty table gives no rows; of the other columns only lang is read, for learning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents
from .words import slices

CHUNK, HIDDEN, LANES = 64, 8, 4096


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def chunks(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bytes (CHUNK x lanes, zero past a text's end), the text of each lane, bytes used in each lane."""
    n_lanes = -(-sizes // CHUNK)
    text = np.repeat(np.arange(len(sizes)), n_lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
    used = np.minimum(CHUNK, sizes[text] - nth * CHUNK)
    at = (np.cumsum(sizes) - sizes)[text] + nth * CHUNK
    index = at[None, :] + np.arange(CHUNK)[:, None]
    grid = np.concatenate([data, np.zeros(CHUNK, dtype=np.uint8)])[index]
    grid[np.arange(CHUNK)[:, None] >= used[None, :]] = 0
    return grid, text, used


def squash(x: np.ndarray, scratch: np.ndarray) -> None:
    """x becomes nearly tanh(x): a ratio of polynomials, several times faster than the function."""
    np.clip(x, -3, 3, out=x)
    np.multiply(x, x, out=scratch)
    scratch += np.float32(27)
    x *= scratch
    scratch -= np.float32(24)
    scratch *= np.float32(9)
    x /= scratch


def run_layer(grid: np.ndarray, table: np.ndarray, recur: np.ndarray, keep: bool = False, out: np.ndarray | None = None):
    """One direction over grid (steps x lanes). Gives all states, or with out the states times out; keep: what learning needs.

    The table and the recurrent weights of both gates hold halves: a gate is squash(x / 2) / 2 + 1 / 2.
    """
    steps, lanes = grid.shape
    size = recur.shape[1]
    grid = grid.astype(np.intp)
    h = np.zeros((size, lanes), dtype=np.float32)
    result = np.empty((steps, size if out is None else len(out), lanes), dtype=np.float32)
    gates, back, scratch = (np.empty((rows * size, lanes), dtype=np.float32) for rows in (3, 3, 2))
    memory = []
    for t in range(steps):
        if keep:
            gates, back = np.empty_like(gates), np.empty_like(back)
        np.take(table, grid[t], axis=1, out=gates, mode="clip")
        np.matmul(recur, h, out=back)
        zr = gates[: 2 * size]
        zr += back[: 2 * size]
        squash(zr, scratch)
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        z, r, n, from_h = zr[:size], zr[size:], gates[2 * size :], back[2 * size :]
        np.multiply(r, from_h, out=scratch[:size])
        n += scratch[:size]
        squash(n, scratch[:size])
        if keep:
            memory.append((z, r, n, from_h, h))
        h = h - n
        h *= z
        h += n
        if out is None:
            result[t] = h
        else:
            np.matmul(out, h, out=result[t])
    return (result, memory) if keep else result


def backward(grid: np.ndarray, memory: list, recur: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the recurrent weights, through time."""
    steps, lanes = grid.shape
    size = recur.shape[1]
    d_recur, d_h = np.zeros_like(recur), np.zeros((size, lanes), dtype=np.float32)
    d_in = np.empty((3 * size, steps, lanes), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, n, from_h, before = memory[t]
        d_h = d_h + d_states[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = 2 * d_h * (before - n) * z * (1 - z)
        d_r = 2 * d_n * from_h * r * (1 - r)
        d_in[:size, t], d_in[size : 2 * size, t], d_in[2 * size :, t] = d_z, d_r, d_n
        d_back = np.concatenate([d_z, d_r, d_n * r])
        d_recur += d_back @ before.T
        d_h = d_h * z + recur.T @ d_back
    flat = grid.ravel()
    return np.stack([np.bincount(flat, row.ravel(), minlength=256) for row in d_in]).astype(np.float32), d_recur


def train(grid: np.ndarray, used: np.ndarray, label: np.ndarray, n_labels: int, rounds: int = 260, lanes: int = 256, seed: int = 7) -> list[np.ndarray]:
    """Weights: input table and recurrent weights of each direction, output weights, output bias."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    weights = [draw(3 * HIDDEN, 256, scale=0.4), draw(3 * HIDDEN, HIDDEN, scale=0.35), draw(3 * HIDDEN, 256, scale=0.4), draw(3 * HIDDEN, HIDDEN, scale=0.35), draw(n_labels, 2 * HIDDEN, scale=0.3), np.zeros(n_labels, dtype=np.float32)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_label = [np.flatnonzero(label == k) for k in range(n_labels)]
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(own, max(1, lanes // n_labels)) for own in by_label])
        part, target = grid[:, pick], label[pick]
        ahead, memory_a = run_layer(part, weights[0], weights[1], keep=True)
        behind, memory_b = run_layer(part[::-1], weights[2], weights[3], keep=True)
        states = np.concatenate([ahead, behind[::-1]], axis=1)
        p = softmax(np.matmul(weights[4], states) + weights[5][None, :, None])
        mask = (np.arange(CHUNK)[:, None] < used[pick][None, :]).astype(np.float32)
        p[:, target, np.arange(len(pick))] -= 1
        p *= (mask / mask.sum())[:, None, :]
        d_out = np.einsum("tkl,thl->kh", p, states)
        d_states = np.matmul(weights[4].T, p)
        g_a = backward(part, memory_a, weights[1], d_states[:, :HIDDEN])
        g_b = backward(part[::-1], memory_b, weights[3], d_states[::-1, HIDDEN:])
        rate = 0.02 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for i, g in enumerate((*g_a, *g_b, d_out, p.sum(axis=(0, 2)))):
            mean[i] += 0.1 * (g - mean[i])
            square[i] += 0.01 * (g * g - square[i])
            weights[i] -= (rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return weights


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = scores - scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def label_positions(grid: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Probabilities: position x language x lane."""
    scores = run_layer(grid, weights[0], weights[1], out=np.ascontiguousarray(weights[4][:, :HIDDEN]))
    scores += run_layer(grid[::-1], weights[2], weights[3], out=np.ascontiguousarray(weights[4][:, HIDDEN:]))[::-1]
    scores += weights[5][None, :, None]
    return softmax(scores)


def pooled(data: np.ndarray, sizes: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Mean probabilities over all bytes: text x language."""
    grid, text, used = chunks(data, sizes)
    total = np.zeros((len(sizes), len(weights[5])))
    for k in range(0, len(text), LANES):
        part = slice(k, k + LANES)
        p = label_positions(grid[:, part], weights)
        p *= (np.arange(CHUNK)[:, None] < used[part][None, :])[:, None, :]
        lane = p.sum(axis=0).T
        first = np.flatnonzero(np.r_[True, text[part][1:] != text[part][:-1]])
        total[text[part][first]] += np.add.reduceat(lane, first, axis=0)
    return total / np.maximum(sizes, 1)[:, None]


def learn(docs: DataFrame, rows_per_language: int = 400, windows_per_row: int = 6, seed: int = 7) -> tuple[list[str], list[np.ndarray] | None]:
    """Languages and weights from a bounded sample of labelled rows: of each language the rows_per_language of smallest hash.

    A row is drawn by the hash of its doc_id and text, so reruns agree and repeated rows are drawn once.
    """
    name = F.xxhash64(F.lit("learn"), "doc_id", "text").alias("name")
    labelled = docs.select("doc_id", "text", "lang", name).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("name"))
    drawn = labelled.select("lang", "name").distinct().withColumn("nth", nth).filter(F.col("nth") <= rows_per_language).drop("nth")
    chosen = labelled.join(F.broadcast(drawn), ["lang", "name"], "left_semi")  # rows_per_language rows a language

    def windows(batches):
        for pdf in batches:
            out = []
            for name, text, lang in zip(pdf["name"], pdf["text"], pdf["lang"]):
                data = text.encode()
                rng = np.random.default_rng([seed, int(name) & (1 << 63) - 1])
                for nth, start in enumerate(rng.integers(0, max(1, len(data) - CHUNK + 1), windows_per_row)):
                    out.append((name, lang, nth, data[start : start + CHUNK]))
            yield pd.DataFrame(out, columns=["name", "lang", "nth", "data"])

    sample = chosen.select("name", "text", "lang").mapInPandas(windows, "name long, lang string, nth int, data binary").dropDuplicates(["name", "lang", "nth"]).toPandas()
    if not len(sample):
        return [], None
    sample = sample.sort_values(["lang", "name", "nth"], ignore_index=True)
    names = sorted(sample["lang"].unique())
    sizes = np.array([len(x) for x in sample["data"]])
    grid, _, used = chunks(np.frombuffer(b"".join(sample["data"]), dtype=np.uint8), sizes)
    return names, train(grid, used, np.searchsorted(names, sample["lang"]), len(names), seed=seed)


def predict(docs: DataFrame, names: list[str], weights: list[np.ndarray] | None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score, in place of own columns of the names in out; all other columns are carried along."""
    columns = [c for c in docs.columns if c not in out]
    judged = docs.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = docs.select(*[F.col(f"`{c}`") for c in columns], F.lit("").alias(out[0]), F.lit(0.0).alias(out[1])).schema

    def judge(batches):
        for part in slices(batches, max_bytes=1_000_000):
            letters = part.column("_letters").to_numpy(zero_copy_only=False)
            score, best = np.zeros(part.num_rows), np.zeros(part.num_rows, dtype=np.int64)
            if names and letters.any():
                texts = [t.encode() if ok else b"" for t, ok in zip(part.column("text").to_pylist(), letters)]
                p = pooled(np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts]), weights)
                best, score = p.argmax(axis=1), np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
            found = [names[b] if ok and names else "und" for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(found, pa.string()), pa.array(score)], [*columns, *out])

    return judged.mapInArrow(judge, schema)


def recognised(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The rows of docs in a learned language: neither und nor of a score below least_score."""
    judged = predict(docs, *learn(docs), out=("_lang", "_score"))
    return judged.filter((F.col("_lang") != "und") & (F.col("_score") >= least_score)).drop("_lang", "_score")


def op4_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs.select("doc_id", "text"), *learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
