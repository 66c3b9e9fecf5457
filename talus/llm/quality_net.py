"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, a temperature.

Every word, hashed to ``WORD_ROWS`` rows, and every word shape, hashed to
``SHAPE_ROWS`` rows, owns a sparse index vector of ``NONZERO`` signs in ``DIM``
places. A row's context vector is the sum of the index vectors of its
neighbours up to ``REACH`` words away, over all documents. A document is the
mean context vector of its words, that of its shapes, and its log length. The
shape of a word is its sequence of character kinds, and whether the word
repeats its predecessor or lies in a three-word window met before in the text.

The network learns from at most ``SAMPLE`` labelled rows, those with the
smallest hash of their id; a fifth of them sets the temperature. Null text
counts as empty and is scored like any text. Labels that are null, or on null
ids, are not used; repeated labels of an id are averaged. Without usable labels
all scores are 0.5. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.brown import summed_blocks
from talus.llm.text import LOWER, by_slices, fold, slices, span_hashes, split_words

WORD_ROWS = 1 << 14
SHAPE_ROWS = 1 << 12
ROWS = WORD_ROWS + SHAPE_ROWS
DIM = 32
NONZERO = 3
REACH = 2
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
BATCH = 256
RATE = 3e-3
DECAY = 1e-4
PARTS = 20
CUTOFF = 0.3
POOL_BYTES = 1 << 18

_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = ord("x")
_KIND[65:91] = ord("X")
_KIND[48:58] = ord("9")


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(77)
    out = np.zeros((ROWS, DIM), np.int8)
    place = rng.random((ROWS, DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.int8), (ROWS, NONZERO)), axis=1)
    return out


def token_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the word, row of the shape, first) of all tokens."""
    words = split_words(column)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words.first
    lowered = span_hashes(LOWER[words.data], words.start, words.end)
    kinds = _KIND[words.data]
    # Upper-case accented letters: the second byte of U+00C0 to U+00DE.
    high = np.flatnonzero((words.data[1:] >= 0x80) & (words.data[1:] <= 0x9E) & (words.data[:-1] == 0xC3))
    kinds[high] = kinds[high + 1] = ord("X")
    kept = np.ones(len(kinds), bool)
    kept[1:] = kinds[1:] != kinds[:-1]
    kept[words.start] = True
    place = np.cumsum(kept)
    shape = span_hashes(kinds[kept], place[words.start] - 1, place[words.end - 1])
    same = np.zeros(len(lowered), np.uint64)
    inner = words.doc[1:] == words.doc[:-1]
    # In a three-word window met before in the same text: among equal hashes all places but the first.
    if len(lowered) > 2:
        triple = (lowered[:-2] * np.uint64(0x9E3779B97F4A7C15) + lowered[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + lowered[2:]
        triple += words.doc[:-2].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        bits = np.uint64(int(len(triple)).bit_length())
        packed = np.sort(triple >> bits << bits | np.arange(len(triple), dtype=np.uint64))
        later = packed[1:][packed[1:] >> bits == packed[:-1] >> bits]
        at = (later & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        at = at[words.doc[at] == words.doc[at + 2]]
        for k in range(3):
            same[at + k] = 1
    same[1:][inner & (lowered[1:] == lowered[:-1])] = 2
    shapes = (shape + same * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SHAPE_ROWS)
    return (lowered % np.uint64(WORD_ROWS)).astype(np.int64), shapes.astype(np.int64) + WORD_ROWS, words.first


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    total = np.zeros((ROWS, DIM), np.int64)
    for batch in batches:
        for part in slices(batch, "text", POOL_BYTES):
            word, shape, first = token_rows(part.column("text"))
            n = len(word)
            if not n:
                continue
            # REACH empty places before, between and after the documents: no neighbour lies in another one.
            gap = np.repeat(np.arange(1, len(first)), np.diff(first)) * REACH
            own = np.zeros((n + len(first) * REACH, DIM), np.int8)
            own[np.arange(n) + gap] = index[word] + index[shape]
            near = np.zeros_like(own)
            for d in range(1, REACH + 1):
                near[d:] += own[:-d]
                near[:-d] += own[d:]
            near = near[np.arange(n) + gap]
            for rows in (word, shape):
                order = np.argsort(rows.astype(np.uint16), kind="stable")
                ordered = rows[order]
                begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                total[ordered[begin]] += np.add.reduceat(near[order], begin, dtype=np.int32)
    if total.any():
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(range(PARTS), pa.int32()), "cells": pa.array([c.tobytes() for c in np.array_split(total.reshape(-1), PARTS)], pa.binary())}
        )


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Centred unit context vectors of all rows; their number is fixed."""
    blocks = docs.select("text").mapInArrow(_contexts, "part int, cells binary")
    vectors = summed_blocks(blocks, PARTS, ROWS * DIM).reshape(ROWS, DIM).astype(np.float64)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    filled = length[:, 0] > 0
    if filled.any():
        vectors[filled] -= vectors[filled].mean(axis=0)
    return vectors.astype(np.float32)


def pooled(vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """(documents x 2 DIM + 1) features."""
    word, shape, first = token_rows(column)
    n = np.diff(first)
    out = np.zeros((len(n), 2 * DIM + 1), np.float32)
    filled = np.flatnonzero(n)
    if len(filled):
        starts = first[:-1][filled]
        for k, rows in enumerate((word, shape)):
            out[filled, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[rows], starts) / n[filled, None]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the cross entropy; every fifth row is left for the temperature."""
    rng = np.random.default_rng(seed)
    apart = np.arange(len(y)) % 5 == 4
    x = x.astype(np.float64)
    own, target = x[~apart], y[~apart].astype(np.float64)
    net = Network(own.mean(axis=0), own.std(axis=0) + 1e-3, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), 0.0)
    own = (own - net.centre) / net.scale
    weights = [net.first, net.first_bias, net.second, np.zeros(1)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(own))
        for at in range(0, len(own), BATCH):
            rows = order[at : at + BATCH]
            a = own[rows]
            raw = a @ weights[0] + weights[1]
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30)))
            error = (p - target[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (raw > 0)
            slopes = [a.T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ error + DECAY * weights[2], error.sum(keepdims=True)]
            step += 1
            for k, slope in enumerate(slopes):
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                square[k] = 0.999 * square[k] + 0.001 * slope**2
                rate = RATE * (1 - epoch / EPOCHS)
                weights[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    net.first, net.first_bias, net.second, net.second_bias = weights[0], weights[1], weights[2], float(weights[3][0])
    if apart.any():
        z, t = net.logits(x[apart]), y[apart]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, -(2 * t - 1) * z / g).mean() for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def learn(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> tuple[np.ndarray, Network | None]:
    """Context vectors of all documents, and the network fitted outside the held-out fold."""
    vectors = context_vectors(docs)
    usable = labels.where((fold("doc_id", mod) != held) & F.col("quality").isNotNull())
    chosen = (
        usable.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        .orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(SAMPLE)
    )
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # ROWS x DIM

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pooled(shared.value, batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"]
        )

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # SAMPLE ids
    rows = sample.select("doc_id", "quality", "text").mapInArrow(by_slices(one, "text", POOL_BYTES), "doc_id long, quality double, x binary").toPandas()
    if rows.empty:
        return vectors, None
    rows = rows.sort_values(["doc_id", "x"], kind="stable")
    x = np.stack([np.frombuffer(r, np.float32) for r in rows["x"]])
    order = np.random.default_rng(3).permutation(len(x))
    return vectors, fit(x[order], (rows["quality"].to_numpy() >= 0.5).astype(int)[order])


def score(docs: DataFrame, vectors: np.ndarray, net: Network | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, fitted = shared.value
        p = fitted.probabilities(pooled(own, batch.column("text"))) if fitted else np.full(batch.num_rows, 0.5)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "score": pa.array(p.astype(np.float64)),
                "predicted": pa.array((p >= CUTOFF).astype(np.int32)),
            }
        )

    return docs.mapInArrow(by_slices(one, "text", POOL_BYTES), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """Score every row of ``docs`` by what the labels outside the held-out fold teach."""
    vectors, net = learn(docs, labels, mod, held)
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", mod) == held, F.lit(False)).alias("held_out"), "text")
    return score(rows, vectors, net)
