"""Repeated passages: sparse suffix trees over anchored windows, partitioned by prefix.

A window is ``WINDOW`` consecutive words. Its anchor is the ``GRAM`` words in
it with the smallest hash, so equal windows have equal anchors at equal
offsets. Consecutive windows with one anchor form a run; its context is all
their words. Runs that share an anchor are the suffixes that share a prefix of
GRAM words: they form one group, and only groups with two or more suffixes are
looked at.

Equal contexts are merged first and counted, so a passage that a third of all
documents share is one leaf. Groups of at most ``GROUP`` contexts grow their
trees level by level, to the right and to the left of the anchor: the class of
a context at depth d is its node there, and a window repeats if the node that
spells it, all WINDOW words deep, has two suffixes below it. Larger groups use
a longer prefix, the whole window, and are counted by it.

Words are unchanged runs of other than ASCII white space. Null text has no
words. Rows with equal id and text share their runs and are both answered;
each counts as an occurrence. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.text import by_slices, mix64, power_table, ragged_ranges, slices, split_words
from talus.session import cut_lineage

WINDOW = 35
GRAM = 6
GROUP = 1 << 16
PACKED_BYTES = 1 << 19
_STEP = 0xD1342543DE82EF95
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_PLACE_BITS = 26


def sequence_hashes(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of word hashes."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power_table(_STEP, len(values)), out=sums[1:])
    value = (sums[start + length] - sums[start]) * power_table(_STEP_INVERSE, len(values) + 1)[start]
    return mix64(value + length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def anchored_runs(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(doc, start, windows, offset of the anchor from start, anchor hash) of all runs."""
    total = len(hashes)
    counts = np.diff(first)
    windows = np.maximum(counts - window + 1, 0)
    if not windows.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    grams = total - gram + 1
    keys = sequence_hashes(hashes, np.arange(grams), np.full(grams, gram))
    places = np.arange(grams, dtype=np.uint64) & np.uint64((1 << _PLACE_BITS) - 1)
    packed = (keys >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | places
    # Smallest of window - gram + 1 consecutive values, by doubling.
    need, have, low = window - gram + 1, 1, packed
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = ragged_ranges(first[:-1], windows)
    doc = np.repeat(np.arange(len(counts)), windows)
    chosen = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    place = (chosen[begin] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    start = at[begin]
    anchor = start + ((place - start) & ((1 << _PLACE_BITS) - 1))
    return doc[begin], start, length, anchor - start, keys[anchor]


def _keyed(docs: DataFrame) -> DataFrame:
    """Id, text and the pair that finds a text again: id and a text hash."""
    return docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("doc_id", F.lit(-(1 << 62))).alias("k1"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"),
    )


_CODEC = pa.Codec("zstd")
PACKED = "doc_id long, k1 long, k2 long, size long, text binary"


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw = [t.encode() for t in batch.column("text").to_pylist()]
    columns = [batch.column(c) for c in ("doc_id", "k1", "k2")]
    columns += [pa.array([len(t) for t in raw], pa.int64()), pa.array([_CODEC.compress(t, asbytes=True) for t in raw], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "size", "text"])


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed one by one: they are shuffled twice, and pack better than Spark's blocks do."""
    return _keyed(docs).mapInArrow(by_slices(_pack), PACKED)


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    sizes = batch.column("size").to_pylist()
    return [_CODEC.decompress(t, n, asbytes=True) for t, n in zip(batch.column("text").to_pylist(), sizes)]


RUNS = "k1 long, k2 long, start int, windows int, offset int, anchor long, context long"


def _runs(window: int, gram: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(batch.column("text"))
        hashes = words.hashes()
        doc, start, length, offset, anchor = anchored_runs(hashes, words.first, window, gram)
        context = sequence_hashes(hashes, start, length + window - 1)
        return pa.RecordBatch.from_pydict(
            {
                "k1": batch.column("k1").take(pa.array(doc)),
                "k2": batch.column("k2").take(pa.array(doc)),
                "start": pa.array((start - words.first[doc]).astype(np.int32)),
                "windows": pa.array(length.astype(np.int32)),
                "offset": pa.array(offset.astype(np.int32)),
                "anchor": pa.array(anchor.view(np.int64)),
                "context": pa.array(context.view(np.int64)),
            }
        )

    return one


SUFFIXES = "anchor long, context long, n long, windows int, offset int, big boolean, words binary"


def _suffixes(window: int):
    """Words of the chosen runs of each text."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(pa.array(_unpacked(batch), pa.binary()))
        hashes = words.hashes()
        runs = batch.column("runs")
        flat = runs.flatten()
        doc = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy(zero_copy_only=False))
        column = {name: flat.field(i) for i, name in enumerate(f.name for f in flat.type)}
        start = column["start"].to_numpy().astype(np.int64) + words.first[doc]
        length = column["windows"].to_numpy().astype(np.int64) + window - 1
        raw = [hashes[a : a + n].tobytes() for a, n in zip(start, length)]
        keep = ("anchor", "context", "n", "windows", "offset", "big")
        return pa.RecordBatch.from_arrays([*(column[k] for k in keep), pa.array(raw, pa.binary())], [*keep, "words"])

    return one


def repeated_windows(anchor, n, windows, offset, blobs, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each context a bit mask of its windows that occur twice or more.

    Contexts with one anchor are the suffixes of one subtree; ``n`` is how
    often each occurs. Level by level a context's node to the right (left) of
    the anchor is its parent node and the next word.
    """
    m = len(anchor)
    size = windows + window - 1
    first = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(b"".join(blobs), np.uint64)
    place = first[:-1] + offset
    _, root = np.unique(anchor, return_inverse=True)

    def child(node: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Nodes one word deeper; a context that has ended gets a node of its own."""
        word = np.where(inside, flat[np.where(inside, at, 0)], np.uint64(0))
        order = np.lexsort((word, node, ~inside))
        changed = np.ones(m, bool)
        changed[1:] = (node[order][1:] != node[order][:-1]) | (word[order][1:] != word[order][:-1]) | ~inside[order][1:]
        out = np.empty(m, np.int64)
        out[order] = np.cumsum(changed)
        return out

    right = {gram: root}
    for depth in range(gram + 1, window + 1):
        at = place + depth - 1
        right[depth] = child(right[depth - 1], at, at < first[1:])
    mask = np.zeros(m, np.int64)
    left = root
    for back in range(window - gram + 1):
        if back:
            at = place - back
            left = child(left, at, at >= first[:-1])
        number = offset - back  # the window that starts ``back`` words before the anchor
        own = np.flatnonzero((number >= 0) & (number < windows))
        if not len(own):
            continue
        pair = left[own] * np.int64(m + 1) + right[window - back][own]
        _, inverse = np.unique(pair, return_inverse=True)
        total = np.bincount(inverse, n[own])
        mask[own] |= np.where(total[inverse] > 1, np.int64(1) << number[own], 0)
    return mask


MASKS = "anchor long, context long, mask long"


def _grow(window: int, gram: int):
    """Trees of whole anchor groups: rows arrive sorted by anchor, groups are never cut."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        pair = np.stack([table.column(c).to_numpy() for c in ("anchor", "context")], axis=1)
        table = table.take(pa.array(np.unique(pair, axis=0, return_index=True)[1])).combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        mask = repeated_windows(
            get("anchor"), get("n"), get("windows").astype(np.int64), get("offset").astype(np.int64),
            table.column("words").to_pylist(), window, gram,
        )
        out = pa.RecordBatch.from_pydict({"anchor": get("anchor"), "context": get("context"), "mask": pa.array(mask)})
        return out.filter(pa.array(mask != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in slices(batch, "words", 4 << 20):
                anchors = part.column("anchor").to_numpy()
                last = int(np.searchsorted(anchors, anchors[-1]))
                if held and held[-1].column("anchor")[-1].as_py() != anchors[0]:
                    yield solve(held)
                    held = []
                if last:
                    yield solve([*held, part.slice(0, last)])
                    held = []
                held.append(part.slice(last))
        if held:
            yield solve(held)

    return run


WINDOWS = "anchor long, context long, number int, spelled long, n long"


def _spelled(window: int):
    """Windows of contexts in overfull groups, by a hash of all their words."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = batch.column("windows").to_numpy().astype(np.int64)
        flat = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)
        first = np.concatenate([[0], np.cumsum(size + window - 1)])[:-1]
        at = ragged_ranges(first, size)
        row = np.repeat(np.arange(len(size)), size)
        # Windows of one anchor are equal only at equal offsets; the offset is part of what is spelled.
        number = at - first[row]
        shift = (batch.column("offset").to_numpy().astype(np.int64)[row] - number).astype(np.uint64)
        spelled = mix64(sequence_hashes(flat, at, np.full(len(at), window)) + shift)
        take = pa.array(row)
        return pa.RecordBatch.from_pydict(
            {
                "anchor": batch.column("anchor").take(take),
                "context": batch.column("context").take(take),
                "number": pa.array(number.astype(np.int32)),
                "spelled": pa.array(spelled.view(np.int64)),
                "n": batch.column("n").take(take),
            }
        )

    return one


def repeated_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(k1, k2, start, mask): which windows from word ``start`` on occur anywhere else."""
    runs = cut_lineage(_keyed(docs).drop("doc_id").mapInArrow(by_slices(_runs(window, gram)), RUNS))
    distinct = runs.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "windows", "offset")).alias("at")
    )
    groups = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all")).where("all > 1")
    chosen = distinct.join(groups, "anchor").select(
        "at.k1", "at.k2",
        F.struct("at.start", "at.windows", "at.offset", "anchor", "context", "n", (F.col("members") > group).alias("big")).alias("run"),
    )
    wanted = chosen.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))  # of one text
    # Rows with equal id and text spell their runs again; a tree takes each (anchor, context) once.
    suffixes = cut_lineage(_packed(docs).drop("doc_id").join(wanted, ["k1", "k2"]).mapInArrow(by_slices(_suffixes(window), limit=PACKED_BYTES), SUFFIXES))
    small = suffixes.where("NOT big").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_grow(window, gram), MASKS)
    spelled = suffixes.where("big").dropDuplicates(["anchor", "context"]).mapInArrow(by_slices(_spelled(window), "words"), WINDOWS)
    often = spelled.groupBy("anchor", "spelled").agg(F.sum("n").alias("all")).where("all > 1")
    large = (
        spelled.join(often, ["anchor", "spelled"]).groupBy("anchor", "context")
        .agg(F.bit_or(F.expr("shiftleft(1L, number)")).alias("mask"))
    )
    masks = small.unionByName(large)
    return runs.join(masks, ["anchor", "context"]).select("k1", "k2", "start", "mask")


def _kept(window: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, runs = _unpacked(batch), batch.column("runs").to_pylist()
        counts, removed, digests = [], [], []
        for text, own in zip(texts, runs):
            words = text.split()
            gone = 0
            if own:
                starts = np.array([r["start"] for r in own], np.int64)
                masks = np.array([r["mask"] for r in own], np.int64)
                bits = (masks[:, None] >> np.arange(window, dtype=np.int64)) & 1
                run, number = np.nonzero(bits)
                at = starts[run] + number
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                gone = len(words) - len(keep)
                kept = [words[i] for i in keep]
            else:
                kept = words
            counts.append(len(words))
            removed.append(gone)
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    return one


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """What stays of every document without its repeated windows, as counts and a digest."""
    runs = repeated_runs(docs, window, gram, group)
    of_text = runs.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "mask")).alias("runs"))
    rows = _packed(docs).join(of_text, ["k1", "k2"], "left").select("doc_id", "size", "text", "runs")
    return rows.mapInArrow(by_slices(_kept(window), limit=PACKED_BYTES), "doc_id long, n_words long, n_removed long, kept_sha256 string")
