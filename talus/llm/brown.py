"""Class-based bigram scoring after Brown: P(w | v) = P(class(w) | class(v)) P(w | class(w)).

Exchange clustering assigns units to ``CLASSES`` classes: it moves one at a time
to the class that raises the class bigram likelihood most, until none moves.
Units are the ``UNIT_WORDS`` most frequent words, one by one, and ``FORMS`` groups
of word endings that stand for all other words meanwhile; the matrix of their
bigrams is bounded by the two parameters.

Every other word of the training rows then takes a class from its own
neighbours. Their classes, those of their units, are counted to the left and to
the right; a word moves to the class whose neighbours describe these counts
best, the classes' neighbours are counted again from their words, and sweeps
over all words go on until no word moves. Only unseen words go with their
ending. The end of a text is a word with a class of its own and the context of
the first word.

Transitions are counted over the classes that all words have in the end, and
smoothed by ``TRANSITION``; emissions add one to every word of the class and to
one unseen word. Null text counts as empty and has one token, its end. Rows
without an id are scored but not learned from. Repeated rows are each scored;
without training rows the base is 0 and the score that of the uniform classes.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.frequent import most_frequent
from talus.llm.text import by_slices, fold, slices, span_hashes, split_words, text_bytes
from talus.session import cut_lineage

CLASSES = 64
UNIT_WORDS = 1024
FORMS = 511
UNITS = 1 + UNIT_WORDS + FORMS
HEAD_WORDS = 1 << 16
ENDING = 3
TRANSITION = 0.5
SCALE = 1 << 28
RARE = 255
COUNT_BYTES = 4 << 20
HELD_PAIRS = 2 << 20
SETTLED = 8.0
PARTS = 32


def _forms(words) -> np.ndarray:
    """The form group of each word: its last bytes, hashed."""
    low = np.maximum(words.start, words.end - ENDING)
    return (span_hashes(words.data, low, words.end) % np.uint64(FORMS)).astype(np.int64) if len(low) else np.zeros(0, np.int64)


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = split_words(batch.column("text"), lower=True)
    hashes, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
    return pa.RecordBatch.from_pydict(
        {
            "word": pa.array(hashes.view(np.int64)),
            "form": pa.array(_forms(words)[at].astype(np.int32)),
            "n": pa.array(n, pa.int64()),
        }
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """(word hash, form, n) over all rows."""
    parts = texts.select("text").mapInArrow(by_slices(_count, "text", COUNT_BYTES), "word long, form int, n long")
    return parts.groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent words: sorted hashes, counts and units (-1: goes by form, UNITS and up: a class of its own)."""

    known: np.ndarray
    count: np.ndarray
    unit: np.ndarray

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return self.known[at] == hashes, at

    def units(self, hashes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is a head word, its place, unit) for each token."""
        hit, at = self.look_up(hashes)
        unit = self.unit[at] if len(self.known) else np.full(len(hashes), -1)
        return hit, at, np.where(hit & (unit >= 0), unit, 1 + UNIT_WORDS + forms)


def _with_ends(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous unit, unit, document) of all tokens, an end after each document."""
    docs = len(first) - 1
    n = np.diff(first) + 1
    doc = np.repeat(np.arange(docs), n)
    out = np.zeros(len(doc), np.int64)
    out[np.arange(len(units)) + np.repeat(np.arange(docs), n - 1)] = units
    previous = np.zeros(len(out), np.int64)
    previous[1:] = out[:-1]  # an end is unit 0, which is also the context of a first word
    return previous, out, doc


def _bigrams(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), lower=True)
                _, _, units = shared.value.units(words.hashes(), _forms(words))
                previous, own, _ = _with_ends(units, words.first)
                total += np.bincount(previous * UNITS + own, minlength=UNITS * UNITS)
        if total.any():
            cells = np.array_split(total, PARTS)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(range(PARTS), pa.int32()), "cells": pa.array([c.tobytes() for c in cells], pa.binary())}
            )

    return run


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal-numbered blocks of 64-bit counts; holds one block for each number it meets."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells")):
            block = np.frombuffer(cells.as_buffer(), np.int64)
            sums[part] = sums[part] + block if part in sums else block.copy()
    yield pa.RecordBatch.from_pydict(
        {"part": pa.array(list(sums), pa.int32()), "cells": pa.array([c.tobytes() for c in sums.values()], pa.binary())}
    )


def summed_blocks(blocks: DataFrame, parts: int, size: int) -> np.ndarray:
    """Add blocks of counts on the executors; the sum, of ``size`` numbers, comes to the driver."""
    rows = blocks.repartition("part").mapInArrow(add_up, "part int, cells binary").collect()
    found = {r["part"]: np.frombuffer(r["cells"], np.int64) for r in rows}
    return np.concatenate([found[k] for k in range(parts)]) if found else np.zeros(size, np.int64)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of every unit, from the matrix of unit bigrams; unit 0 keeps class 0; ends when none moves."""
    n = counts.sum(axis=0) + counts.sum(axis=1)
    order = [u for u in np.argsort(-n, kind="stable") if u]
    own = np.zeros(len(n), np.int64)
    own[order] = np.arange(len(order)) % (classes - 1) + 1
    table = np.zeros((classes, classes))
    np.add.at(table, (own[:, None], own[None, :]), counts)
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    before = -np.inf
    while True:
        moved = 0
        for u in order:
            if not n[u]:
                continue
            old, self_pairs = own[u], float(counts[u, u])
            right = np.bincount(own, counts[u], classes)
            left = np.bincount(own, counts[:, u], classes)
            right[old] -= self_pairs
            left[old] -= self_pairs
            out, into = right.sum() + self_pairs, left.sum() + self_pairs
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= self_pairs
            rows[old] -= out
            columns[old] -= into
            rows -= left  # pairs into u no longer start in their class
            columns -= right
            base = _xlogx(table)
            to_right = _xlogx(table + right) - base
            to_left = _xlogx(table + left[:, None]) - base
            diagonal = np.diag(table)
            gain = to_right.sum(axis=1) - np.diag(to_right) + to_left.sum(axis=0) - np.diag(to_left)
            gain += _xlogx(diagonal + right + left + self_pairs) - _xlogx(diagonal)
            gain -= _xlogx(rows + left + out) - _xlogx(rows + left)
            gain -= _xlogx(columns + right + into) - _xlogx(columns + right)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[old] + 1e-9:
                best = old
            moved += best != old
            own[u] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += self_pairs
            rows += left
            columns += right
            rows[best] += out
            columns[best] += into
        reached = _xlogx(table).sum() - _xlogx(rows).sum() - _xlogx(columns).sum()
        if not moved or reached <= before:  # moves within the rounding of the likelihood could go round for ever
            return own
        before = reached


def _blobs(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of slices of ``data``."""
    size = data.dtype.itemsize
    buffers = [None, pa.py_buffer((offsets * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _grouped(hashes: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
    """One row a word with all its pairs of slots."""
    order = np.argsort(hashes, kind="stable")
    begin = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
    offsets = 2 * np.append(begin, len(order))
    return pa.RecordBatch.from_pydict({"word": pa.array(hashes[order][begin].view(np.int64)), "slots": _blobs(slots[order].ravel(), offsets)})


def _neighbours(shared):
    """Words that are no units, each with one byte for the class at its right and one for that at its left.

    Those of the head are held over slices of text, HELD_PAIRS at most, so that they make fewer rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = shared.value
        held, pairs = [], 0
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                words = split_words(part.column("text"), lower=True)
                hashes = words.hashes()
                hit, _, units = head.units(hashes, _forms(words))
                previous, tokens, _ = _with_ends(units, words.first)
                kinds = own[tokens]
                after = np.zeros(len(kinds), np.int64)
                after[:-1] = kinds[1:]
                rest = tokens > UNIT_WORDS
                slots = np.stack([after[rest], own[previous[rest]] + CLASSES], axis=1).astype(np.uint8)
                rest = units > UNIT_WORDS
                hashes, hit = hashes[rest], hit[rest]
                yield _grouped(hashes[~hit], slots[~hit])
                held.append((hashes[hit], slots[hit]))
                pairs += len(held[-1][0])
                if pairs >= HELD_PAIRS:
                    yield _grouped(*(np.concatenate(x) for x in zip(*held)))
                    held, pairs = [], 0
        if held:
            yield _grouped(*(np.concatenate(x) for x in zip(*held)))

    return run


VECTOR = "word long, n long, slots binary, counts binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word -> one row a word, with how often it has each slot; holds the last word of a batch."""

    def packed(words: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
        at, slots = np.nonzero(dense)
        offsets = np.searchsorted(at, np.arange(len(words) + 1))
        counts = dense[at, slots]
        return pa.RecordBatch.from_pydict(
            {
                "word": pa.array(words),
                "n": pa.array(dense[:, :CLASSES].sum(axis=1)),
                "slots": _blobs(slots.astype(np.uint8), offsets),
                "counts": _blobs(counts, offsets),
            }
        )

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("word").to_numpy()
        new = np.append(True, rows[1:] != rows[:-1])
        group, words = np.cumsum(new) - 1, rows[new]
        slots, offsets = text_bytes(batch.column("slots"))
        cells = np.repeat(group, np.diff(offsets)) * (2 * CLASSES) + slots
        dense = np.bincount(cells, minlength=len(words) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
        if held is not None:
            if held[0][0] == words[0]:
                dense[0] += held[1][0]
            else:
                words, dense = np.append(held[0], words), np.concatenate([held[1], dense])
        if len(words) > 1:
            yield packed(words[:-1], dense[:-1])
        held = words[-1:], dense[-1:]
    if held is not None:
        yield packed(*held)


def _dense(batch: pa.RecordBatch) -> np.ndarray:
    slots, offsets = text_bytes(batch.column("slots"))
    counts = text_bytes(batch.column("counts"))[0].view(np.int64)
    cells = np.repeat(np.arange(batch.num_rows), np.diff(offsets)) * (2 * CLASSES) + slots
    return np.bincount(cells, counts, batch.num_rows * 2 * CLASSES).reshape(-1, 2 * CLASSES)


def _weights(sums: np.ndarray) -> np.ndarray:
    """Logarithms of each class's neighbours (slot, class), as whole numbers: sums of them don't depend on their order."""
    sides = sums.reshape(CLASSES, 2, CLASSES) + TRANSITION
    return np.round(SCALE * np.log(sides / sides.sum(axis=2, keepdims=True))).reshape(CLASSES, 2 * CLASSES).T


def _best(dense: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, logarithm, lead over the next class) where the class describes the neighbours best; class 0 is the end's own."""
    scores = (dense @ weights)[:, 1:]
    at = np.arange(len(scores))
    best = scores.argmax(axis=1)
    top = scores[at, best]
    scores[at, best] = -np.inf
    return best + 1, top, top - scores.max(axis=1)


def _sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray, least: float | None = None) -> Iterator[pa.RecordBatch]:
    """Sums of the words' neighbours by their best class, and the likelihood in two halves; of words that lead by ``least``."""
    sums = np.zeros((CLASSES, 2 * CLASSES), np.int64)
    reached = 0
    for batch in batches:
        dense, times = _dense(batch), batch.column("times").to_numpy()
        best, score, lead = _best(dense, weights)
        kept = np.ones(len(best), bool) if least is None else lead > least * dense.sum(axis=1)
        reached += sum(map(int, (score * times)[kept]))
        dense *= times[:, None]
        for k in np.unique(best[kept]):
            sums[k] += dense[kept & (best == k)].sum(axis=0).astype(np.int64)
    cells = np.array_split(np.concatenate([sums.ravel(), [reached >> 32, reached & 0xFFFFFFFF]]), PARTS)
    yield pa.RecordBatch.from_pydict(
        {"part": pa.array(range(PARTS), pa.int32()), "cells": pa.array([c.tobytes() for c in cells], pa.binary())}
    )


def _open(batches: Iterator[pa.RecordBatch], weights: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dense = _dense(batch)
        yield batch.filter(pa.array(_best(dense, weights)[2] <= least * dense.sum(axis=1)))


def sweep_words(vectors: DataFrame, sums: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Weights under which no word of ``vectors`` moves any more.

    ``sums`` are the neighbours (class, slot) that classes have at first, ``fixed``
    those of the units, which stay. No step lowers the likelihood: each word
    takes its best class, then each class the distribution of its words. Words
    with equal neighbours move together.

    While no weight is further than half of ``least`` from those of a sweep over
    all words, words whose best class led then by more than ``least`` a neighbour
    keep it, whatever the others do. Sweeps read the other words only, until
    weights have gone further or no word moves.
    """
    alike = cut_lineage(vectors.groupBy("slots", "counts").agg(F.count(F.lit(1)).alias("times")))
    size = 2 * CLASSES * CLASSES + 2

    def swept(rows: DataFrame, *args) -> tuple[np.ndarray, int]:
        found = summed_blocks(rows.mapInArrow(lambda batches: _sums(batches, *args), "part int, cells binary"), PARTS, size)
        return found[:-2].reshape(CLASSES, -1), (int(found[-2]) << 32) + int(found[-1])

    weights, before = _weights(sums), None
    rows, kept, base, least = alike, np.zeros_like(fixed), None, 0.0
    while True:
        if base is not None and 2 * np.abs(weights - base).max() >= least:
            rows, kept, base = alike, np.zeros_like(fixed), None
        own, reached = swept(rows, weights)
        reached += int(((fixed + kept + TRANSITION) * weights.T).sum())
        last, sums = sums, fixed + kept + own
        if np.array_equal(last, sums) or before is not None and reached < before:  # lower by rounding only
            return weights
        before, step = reached, np.abs(_weights(sums) - weights).max()
        if base is None and step < SCALE / SETTLED:
            base, least = weights, SETTLED * step
            rows = cut_lineage(alike.mapInArrow(lambda batches, w=base, m=least: _open(batches, w, m), alike.schema))
            kept = swept(alike, base, least)[0]
        weights = _weights(sums)


def _judged(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.array(_best(_dense(batch), weights)[0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), kinds], ["word", "n", "class"])

    return run


@dataclass
class Model:
    head: Head
    unit_class: np.ndarray  # of units, then of the head's words
    transition: np.ndarray  # log10
    emission: np.ndarray  # log10 of each class's denominator
    tokens: int
    types: int
    ends: int

    def with_transitions(self, paths: DataFrame) -> Model:
        """The model with transitions counted over (path) of the training rows."""
        table = summed_blocks(paths.select("path").mapInArrow(_transitions, "part int, cells binary"), PARTS, CLASSES * CLASSES)
        table = table.reshape(CLASSES, CLASSES)
        transition = np.log10((table + TRANSITION) / (table.sum(axis=1, keepdims=True) + TRANSITION * CLASSES))
        return replace(self, transition=transition)


def learn_classes(texts: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """(model without transitions, word counts, (word, n, class) of all words but units) of the rows of (text)."""
    counts = cut_lineage(word_counts(texts))
    ends = texts.count()
    kinds, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = most_frequent(counts, "n", HEAD_WORDS).toPandas()
    if len(top) < UNIT_WORDS:  # bands stay whole, so many words of alike counts leave too few
        top = counts.orderBy(F.desc("n"), "word").limit(UNIT_WORDS).toPandas()
    top = top.sort_values(["n", "word"], ascending=[False, True]).reset_index(drop=True)
    unit = np.where(np.arange(len(top)) < UNIT_WORDS, np.arange(len(top)) + 1, -1)
    known = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    head = Head(known[order], top["n"].to_numpy(np.int64)[order], unit[order])
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(head)  # HEAD_WORDS rows
    blocks = texts.select("text").mapInArrow(_bigrams(shared), "part int, cells binary")
    pairs = summed_blocks(blocks, PARTS, UNITS * UNITS).reshape(UNITS, UNITS)
    own = exchange(pairs)
    # Neighbours (class, slot) of the units, all of them and those that are words or the end.
    to_class = np.zeros((UNITS, CLASSES), np.int64)
    to_class[np.arange(UNITS), own] = 1
    beside = np.concatenate([pairs @ to_class, pairs.T @ to_class], axis=1)
    clustered = np.arange(UNITS) <= UNIT_WORDS
    found = texts.select("text").mapInArrow(_neighbours(sc.broadcast((head, own))), "word long, slots binary")
    vectors = cut_lineage(found.repartition("word").sortWithinPartitions("word").mapInArrow(_vectors, VECTOR))
    weights = sweep_words(vectors, to_class.T @ beside, to_class[clustered].T @ beside[clustered])
    words = vectors.mapInArrow(_judged(weights), "word long, n long, class int")
    # Tokens and distinct words of each class.
    tokens_of, types_of = np.zeros(CLASSES), np.zeros(CLASSES)
    tokens_of[0], types_of[0] = ends, ends > 0
    of_units = own[1 : 1 + min(len(top), UNIT_WORDS)]
    tokens_of += np.bincount(of_units, top["n"].to_numpy(np.int64)[:UNIT_WORDS], CLASSES)
    types_of += np.bincount(of_units, minlength=CLASSES)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t")).collect():
        tokens_of[r["class"]] += r["n"]
        types_of[r["class"]] += r["t"]
    # The head's other words get units of their own behind all others.
    head_class = np.zeros(len(top), np.int64)
    if len(top) > UNIT_WORDS:
        rest = words.where(F.col("n") >= int(top["n"].min())).toPandas()  # whole bands: these are the head's words
        head_class[head.look_up(rest["word"].to_numpy(np.int64).view(np.uint64))[1]] = rest["class"]
    head = replace(head, unit=np.where(head.unit < 0, UNITS + np.arange(len(top)), head.unit))
    uniform = np.full((CLASSES, CLASSES), -np.log10(CLASSES))
    emission = np.log10(tokens_of + types_of + 1)
    model = Model(head, np.append(own, head_class), uniform, emission, tokens + ends, kinds + (ends > 0), ends)
    return model, counts, words


def learn(texts: DataFrame) -> tuple[Model, DataFrame]:
    """(model, word counts) of the rows of (text)."""
    model, counts, words = learn_classes(texts)
    rows = texts.select(F.lit(0).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.lit(True).alias("learned"), "text")
    return model.with_transitions(class_paths(rows, model, words)), counts


PARTIAL = (
    "row long, key long, at int, ending int, "
    "own struct<doc_id: long, held_out: boolean, learned: boolean, n_known: long, logs: double, path: binary>"
)
PATHS = "doc_id long, held_out boolean, learned boolean, n_tokens long, n_known long, logs double, path binary"


def _looked_up(shared):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model: Model = shared.value
        docs = batch.num_rows
        words = split_words(batch.column("text"), lower=True)
        hashes, forms = words.hashes(), _forms(words)
        hit, at, units = model.head.units(hashes, forms)
        path = np.where(hit, model.unit_class[units], RARE).astype(np.uint8)
        counted = np.log10(model.head.count[at[hit]] + 1.0) if hit.any() else np.zeros(0)
        logs = np.bincount(words.doc[hit], counted, docs) + np.log10(model.ends + 1.0)
        known = np.bincount(words.doc[hit], minlength=docs) + (model.ends > 0)
        row = batch.column("row").to_numpy(zero_copy_only=False)
        # Counts and classes of tokens beyond the head words come by join. A document's own row, of place -1, joins by
        # a hash of its number, so that no key is hot.
        rare = np.flatnonzero(~hit)
        owner = words.doc[rare]
        spread = span_hashes(row.view(np.uint8), np.arange(docs) * 8, np.arange(docs) * 8 + 8)
        own = [batch.column(c) for c in ("doc_id", "held_out", "learned")]
        own += [pa.array(known.astype(np.int64)), pa.array(logs), _blobs(path, words.first)]
        own = pa.StructArray.from_arrays(own, ["doc_id", "held_out", "learned", "n_known", "logs", "path"])
        return pa.RecordBatch.from_pydict(
            {
                "row": pa.array(np.concatenate([row, row[owner]])),
                "key": pa.array(np.concatenate([spread, hashes[rare]]).view(np.int64)),
                "at": pa.array(np.concatenate([np.full(docs, -1), rare - words.first[owner]]).astype(np.int32)),
                "ending": pa.array(np.concatenate([np.zeros(docs, np.int64), model.unit_class[1 + UNIT_WORDS + forms[rare]]]).astype(np.int32)),
                "own": pa.concat_arrays([own, pa.nulls(len(rare), own.type)]),
            }
        )

    return one


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document, its own row first, then its rare words -> one row a document, with all classes."""

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        place = rows.column("at").to_numpy()
        begin, rare = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        own = rows.column("own").take(pa.array(begin))
        doc = np.searchsorted(begin, rare) - 1
        seen = rows.column("seen").to_numpy()[rare]
        path, first = text_bytes(own.field("path"))
        path = path.copy()
        path[first[doc] + place[rare]] = rows.column("class").to_numpy()[rare]
        logs = own.field("logs").to_numpy() + np.bincount(doc, np.log10(seen + 1.0), len(begin))
        known = own.field("n_known").to_numpy() + np.bincount(doc[seen > 0], minlength=len(begin))
        columns = [own.field(c) for c in ("doc_id", "held_out", "learned")]
        columns += [pa.array(np.diff(first) + 1), pa.array(known), pa.array(logs), _blobs(path, first)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PATHS.split(", ")])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        begin = np.flatnonzero(batch.column("at").to_numpy() < 0)
        if len(begin):
            held.append(batch.slice(0, begin[-1]))
            if sum(b.num_rows for b in held):
                yield whole(pa.concat_batches(held))
            held = [batch.slice(begin[-1])]
        elif batch.num_rows:
            held.append(batch)
    if held:
        yield whole(pa.concat_batches(held))


def class_paths(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """Classes of the tokens of every row of (doc_id, held_out, learned, text), with what its base score takes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "learned", "text")
    parts = rows.mapInArrow(by_slices(_looked_up(shared)), PARTIAL)
    table = words.select(F.col("word").alias("key"), F.col("n").alias("seen"), "class")
    joined = parts.join(table, "key", "left").select(
        "row", "at", "own", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("class", "ending").alias("class")
    )
    return cut_lineage(joined.repartition("row").sortWithinPartitions("row", "at").mapInArrow(_paths, PATHS))


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        kinds, first = text_bytes(batch.column("path"))
        previous, own, _ = _with_ends(kinds, first)
        table += np.bincount(previous * CLASSES + own, minlength=CLASSES * CLASSES)
    cells = np.array_split(table, PARTS)
    yield pa.RecordBatch.from_pydict(
        {"part": pa.array(range(PARTS), pa.int32()), "cells": pa.array([c.tobytes() for c in cells], pa.binary())}
    )


def _scored(steps: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, first = text_bytes(batch.column("path"))
            previous, own, doc = _with_ends(kinds, first)
            path = pa.array(np.bincount(doc, steps[previous, own], batch.num_rows))
            names = ["doc_id", "held_out", "n_tokens", "n_known", "logs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), path], [*names, "model"])

    return run


def score(paths: DataFrame, model: Model) -> DataFrame:
    """Base and model log10 probability of every row of ``paths``."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double"
    found = paths.mapInArrow(_scored(model.transition - model.emission), schema)
    total = float(np.log10(model.tokens + model.types + 1))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("logs") + F.col("model")).alias("score"),
    )


def score_documents(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """Learn outside the held-out fold of ``docs`` and score every row."""
    part = fold("doc_id", mod)
    model, _, words = learn_classes(docs.where(part != held).select("text"))
    own = [F.coalesce(c, F.lit(False)).alias(name) for name, c in (("held_out", part == held), ("learned", part != held))]
    paths = class_paths(docs.select("doc_id", *own, "text"), model, words)
    return score(paths, model.with_transitions(paths.where("learned")))
