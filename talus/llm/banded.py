"""Near duplicates by bands of MinHash components, every candidate pair verified.

Documents with equal shingle sets are joined as one. A set of ``PERMUTATIONS``
components falls, for each band of them, into one bucket; all members of a
bucket are compared with one another on whole shingle sets. A bucket of more
than BLOCK sets is cut into blocks by a hash of the set, and every two blocks
meet in one task. A pair that shares several bands counts in the first of them
only. Buckets with the same members are compared once.

Rows are told apart by id and text: equal ids may have different texts, and
rows without an id take part. No list of all pairs is made: a meeting reports
link counts and the links of a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import chosen_path
from talus.llm.minhash import BANDS, PERMUTATIONS
from talus.llm.text import by_slices, shingle_hashes, split_words
from talus.session import cut_lineage

BLOCK = 512
FOUND = "set long, links long, near long, jaccard double"


def _meetings(sets: DataFrame, bands: int) -> DataFrame:
    """(set, band, block, low, high, meeting): the block of a set and every block it meets."""
    width = 4 * PERMUTATIONS // bands
    keys = [F.xxhash64(F.lit(b), F.substring("tokens", width * b + 1, width)) for b in range(bands)]
    members = cut_lineage(sets.select("set", F.posexplode(F.array(*keys)).alias("band", "bucket")))
    group = members.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y")
    )
    kept = group.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("first"))
    met = members.join(kept.select("n", "first.band", "first.bucket"), ["band", "bucket"])
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = met.select("*", parts.alias("parts")).withColumn("block", F.pmod(F.xxhash64("set"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return met.select("set", "band", "block", low.alias("low"), high.alias("high"), F.xxhash64("bucket", low, high).alias("meeting"))


def _items(batch: pa.RecordBatch) -> pa.RecordBatch:
    shingles, first = shingle_hashes(split_words(batch.column("text")))
    rows = [np.unique(shingles[a:b]).tobytes() for a, b in zip(first, first[1:])]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("set", "copies", "tokens")), pa.array(rows, pa.binary())], ["set", "copies", "tokens", "items"])


def forest(like: np.ndarray) -> np.ndarray:
    """Parent of every member in a spanning forest of the links, -1 for roots and members without links."""
    parent, open_ = np.full(len(like), -1), np.ones(len(like), bool)
    for root in np.flatnonzero(like.any(axis=1)):
        front = np.array([root]) if open_[root] else np.zeros(0, np.int64)
        open_[front] = False
        while len(front):
            reached = np.flatnonzero(like[front].any(axis=0) & open_)
            parent[reached] = front[like[np.ix_(front, reached)].argmax(axis=0)]
            open_[reached] = False
            front = reached
    return parent


def _verify(threshold: float, bands: int):
    def solve(t: pa.Table) -> pa.RecordBatch:
        kept = np.unique(t.column("set").to_numpy(), return_index=True)[1]  # rows with equal id and text come more than once
        t = t.take(pa.array(kept))
        sets, copies, block = (t.column(c).to_numpy() for c in ("set", "copies", "block"))
        common, union = chosen_path.common_shingles(t.column("items").to_pylist())
        like = (common >= threshold * union - 1e-9) & chosen_path.in_pair(block, (t.column("low")[0].as_py(), t.column("high")[0].as_py()))
        np.fill_diagonal(like, False)
        keys = np.frombuffer(b"".join(t.column("tokens").to_pylist()), f"V{4 * PERMUTATIONS // bands}").reshape(len(sets), bands)
        for b in range(t.column("band")[0].as_py()):
            same = np.unique(keys[:, b], return_inverse=True)[1].ravel()
            like &= same[:, None] != same[None, :]
        links, parent = like @ copies, forest(like)
        found = np.flatnonzero(links)
        up = parent[found]
        near = pa.array(sets[up], pa.int64(), mask=up < 0)
        share = pa.array(common[found, up] / np.maximum(union[found, up], 1), pa.float64(), mask=up < 0)
        return pa.RecordBatch.from_arrays([pa.array(sets[found], pa.int64()), pa.array(links[found], pa.int64()), near, share], ["set", "links", "near", "jaccard"])

    return chosen_path.by_meeting(solve)


def _linked(docs: DataFrame, threshold: float, bands: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with set names, sets, exact links of sets)."""
    texts = chosen_path.keyed(docs)
    rows = cut_lineage(chosen_path.embedded(texts, PERMUTATIONS))
    head = F.min(F.struct("k1", "k2")).alias("head")
    named = rows.groupBy("s1", "s2").agg(head, F.count(F.lit(1)).alias("copies"), F.min("tokens").alias("tokens"))
    sets = cut_lineage(named.select(F.col("s1").alias("set"), "s2", "head", "copies", "tokens"))
    meetings = cut_lineage(_meetings(sets.select("set", "tokens"), bands))
    chosen = sets.join(meetings.select("set").distinct(), "set", "left_semi").select("set", "copies", "tokens", "head.k1", "head.k2")
    whole = texts.select("k1", "k2", "text").join(chosen, ["k1", "k2"]).select("set", "copies", "tokens", "text")
    items = whole.mapInArrow(by_slices(_items), "set long, copies long, tokens binary, items binary")
    dealt = meetings.join(items, "set").repartition("meeting").sortWithinPartitions("meeting")
    return rows, sets, cut_lineage(dealt.mapInArrow(_verify(threshold, bands), FOUND))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(doc_id, k2, like_id, like_k2, jaccard): verified links that join every class.

    Every document with an equal set is linked to the smallest one, and a
    spanning forest links the sets, so the links grow with the rows. ``k2`` and
    ``like_k2`` are text hashes; a missing id counts as the largest.
    """
    rows, sets, found = _linked(docs, threshold, bands)
    heads = sets.select("set", "s2", "head")
    own = rows.select(F.col("s1").alias("set"), "s2", F.struct("k1", "k2").alias("a")).distinct()
    equal = own.join(heads, ["set", "s2"]).where("a != head").select("a", F.col("head").alias("b"), F.lit(1.0).alias("jaccard"))
    edges = found.where("near IS NOT NULL").select("set", "near", "jaccard")
    edges = edges.join(heads.select("set", F.col("head").alias("a")), "set").join(heads.select(F.col("set").alias("near"), F.col("head").alias("b")), "near")
    links = equal.unionByName(edges.select("a", "b", "jaccard")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "jaccard")
    no_id = F.lit(chosen_path.NO_ID)
    return links.select(
        F.nullif("a.k1", no_id).alias("doc_id"), F.col("a.k2").alias("k2"), F.nullif("b.k1", no_id).alias("like_id"), F.col("b.k2").alias("like_k2"), "jaccard"
    )


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id, n_links, k2, stays) for every row of ``docs``, as ``chosen_path.near_classes`` has them."""
    rows, sets, found = _linked(docs, threshold, bands)
    return chosen_path.classes_of(rows, sets, found.where("links > 0").withColumn("near", F.coalesce("near", "set")))
