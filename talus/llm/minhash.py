"""Document fingerprints: MinHash signatures, banded candidates, verified Jaccard.

A document is the set of its five-word shingles (fewer words: one shingle of
all; no words: the empty set, whose fingerprint is a constant). Each of
``PERMUTATIONS`` multiply-shift functions x -> (a x + b) mod 2^64 orders the
shingles; the smallest value is one component. The printed fingerprint keeps
16 bits of each component.

Null text counts as empty. Equal texts have equal fingerprints, repeated rows
are kept, further columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.text import by_slices, shingle_hashes, slices, split_words

PERMUTATIONS = 128
BANDS = 32
EMPTY = np.uint32(0xFFFFFFFF)
MAX_BLOCKS = 1 << 17
MIN_BLOCK_IDS = 512
CACHE_BYTES = 1 << 18

_rng = np.random.default_rng(20_480_1)
_FACTOR = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature_of_sets(shingles: np.ndarray, first: np.ndarray, size: int = PERMUTATIONS) -> np.ndarray:
    """(documents x size) smallest 32-bit hash values of flat shingle sets."""
    n = len(first) - 1
    out = np.full((size, n), EMPTY, np.uint32)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        x, starts = shingles >> np.uint64(32), first[:-1][filled]
        buffer = np.empty_like(x)
        for j in range(size):
            np.multiply(x, _FACTOR[j], out=buffer)
            np.add(buffer, _SHIFT[j], out=buffer)
            out[j, filled] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def signatures(column: pa.Array, size: int = PERMUTATIONS) -> np.ndarray:
    return signature_of_sets(*shingle_hashes(split_words(column)), size)


def printed(signature: np.ndarray) -> list[str]:
    """Hexadecimal fingerprint, four digits a component."""
    return [row.tobytes().hex() for row in (signature & np.uint32(0xFFFF)).astype(">u2")]


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal components of printed fingerprints, row by row: estimates Jaccard."""
    low = np.uint32(0xFFFF)
    return ((left & low) == (right & low)).mean(axis=1)


def add_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All rows and columns of ``docs`` with a fingerprint column, which replaces one of that name."""
    docs = docs.drop(name)
    names = docs.columns
    places = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text)}"

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = pa.array(printed(signatures(batch.column(text))), pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "added"])

    schema = T.StructType([*places.schema.fields, T.StructField("added", T.StringType())])
    return places.mapInArrow(by_slices(one, text, CACHE_BYTES), schema).toDF(*names, name)


def with_successor_blocks(docs: DataFrame) -> DataFrame:
    """Rows laid out so that the successor of each document is the next row.

    Ids are cut into at most MAX_BLOCKS ranges; a copy of the highest document
    of every non-empty range also goes, marked as tail, to the range above it
    (the highest of all to the lowest range). The list of highest documents is
    bounded by MAX_BLOCKS rows, so it may be broadcast; texts are shuffled
    once. Null ids come last, as one range.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    width = max(MIN_BLOCK_IDS, -(-(high - low + 1) // MAX_BLOCKS))
    block = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(-1)).cast("long")
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), block.alias("block"))
    # Equal ids order by text hash; only the first of them can be the tail.
    rank = F.struct(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("i"), F.xxhash64("text").alias("h"))
    tops = placed.groupBy("block").agg(F.max(rank).alias("top")).select("block", "top.i", "top.h")
    upward = Window.orderBy("block")
    above = F.coalesce(F.lead("block").over(upward), F.first("block").over(upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select("block", "i", "h", above.alias("above"))
    keyed = placed.select("*", rank.alias("r"))
    tails = (
        keyed.join(F.broadcast(tops), "block")
        .where((F.col("r.i") == F.col("i")) & (F.col("r.h") == F.col("h")))
        .dropDuplicates(["block"])
        .select(F.col("above").alias("block"), "doc_id", "text", F.lit(True).alias("tail"))
    )
    rows = placed.select("block", "doc_id", "text", F.lit(False).alias("tail")).unionByName(tails)
    return rows.repartition("block").sortWithinPartitions(
        "block", "tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc(), "text"
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None
    for batch in batches:
        for part in slices(batch, "text", CACHE_BYTES):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("block", "doc_id", "text", "tail"))))
            rows = [held, *rows] if held else rows
            held = rows[-1]
            if len(rows) < 2:
                continue
            texts = [r[2] for r in rows]
            edited = []
            for text, following in zip(texts, texts[1:]):
                n = len(text) // 3
                edited.append(text[: len(text) - n] + following[:n])
            own = signatures(pa.array(texts, pa.string()))
            changed = signatures(pa.array(edited, pa.string()))
            to_edited, to_next = likeness(own[:-1], changed), likeness(own[:-1], own[1:])
            keep = np.flatnonzero([not r[3] for r in rows[:-1]])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([rows[i][1] for i in keep], pa.int64()),
                    "n_chars": pa.array([len(texts[i]) for i in keep], pa.int64()),
                    "edited_sha256": [hashlib.sha256(edited[i].encode()).hexdigest() for i in keep],
                    "fingerprint": pa.array(printed(own[keep]), pa.string()),
                    "edited_fingerprint": pa.array(printed(changed[keep]), pa.string()),
                    "near_edited": to_edited[keep],
                    "near_next": to_next[keep],
                }
            )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text ends in the start of the next document by descending id,
    as the contract of the query says; the last document takes the first.
    """
    return with_successor_blocks(docs).mapInArrow(_compared, SCHEMA)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(doc_id, k2, like_id, like_k2, jaccard): see ``banded.near_duplicates``."""
    from talus.llm import banded

    return banded.near_duplicates(docs, threshold, bands)
