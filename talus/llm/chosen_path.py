"""N-gram Jaccard self join by chosen paths.

A document is the set of its five-word shingles (fewer words: one shingle of
all; no words: the empty set; null text counts as empty). Documents with equal
sets are one class member and are joined as one. Every set is embedded as
``TOKENS`` MinHash tokens, of which two sets share a part near their Jaccard
similarity.

A run splits all sets on one token position of its own: sets with the same token
there fall into one bucket. Buckets of at most ``BUCKET`` sets are compared by
brute force; larger ones are split again on the run's next position, until
``DEPTH``, where what is left, sets alike in DEPTH tokens, is cut into blocks
that all meet one another. A pair of similarity s meets in a run with chance
s^levels; no token serves two runs, so runs are independent, and ``runs_for``
repeats them until the target recall is reached for pairs at the threshold.

Comparing tokens gives candidates; the share of equal tokens asked for is so
low that ``plan`` keeps the target recall with those it rejects counted in;
a bucket reports, for each set, only its link to the first set of its candidate
group there. Candidate groups are then compared exactly, block against block,
on whole shingle sets: each task counts the links of its sets and reports one
spanning link for each, so no list of all pairs is ever made. A candidate group
of more than ``BLOCK`` sets may be a chain of texts of which few are alike; its
sets go through the runs once more by themselves, and a pair is compared exactly
where it meets first: a task tells from the tokens and from the depths at which
the two sets' buckets closed whether they met in an earlier run. Each pair is
counted once, and the work follows the buckets, not the square of the group. A
large group of which nearly all sets are alike, whose links themselves are many,
is compared block against block where that moves fewer sets.

Sets are merged by a name of 128 bits, the first half of which numbers them.
Rows with equal ids but different texts are told apart by the text. A class of
rows without ids has a null class id. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.components import components
from talus.llm.minhash import CACHE_BYTES, signature_of_sets
from talus.llm.text import by_slices, mix64, shingle_hashes, slices, split_words
from talus.session import broadcast_counted, cut_lineage

THRESHOLD = 0.8
TOKENS = 64
RECALL = 0.9995
BUCKET = 256
DEPTH = 3
BLOCK = 512


def runs_for(threshold: float = THRESHOLD, recall: float = RECALL, levels: int = DEPTH) -> int:
    """Independent runs after which a pair at the threshold has met with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**levels))


def plan(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """(runs, tokens, equal tokens of a candidate) that find a pair at the threshold with chance ``recall``.

    A pair is missed if it meets in no run or has too few equal tokens, which
    are binomial; at most 1 - recall is dealt to the two.
    """
    runs, miss = runs_for(threshold, recall), 1 - recall
    while miss - (1 - threshold**DEPTH) ** runs < miss / 10:
        runs += 1
    tokens, room = max(TOKENS, runs * DEPTH), miss - (1 - threshold**DEPTH) ** runs
    least = 0
    while (room := room - math.comb(tokens, least) * threshold**least * (1 - threshold) ** (tokens - least)) >= 0:
        least += 1
    return runs, tokens, least


def _embedded(batch: pa.RecordBatch, tokens_of_set: int) -> pa.RecordBatch:
    shingles, first = shingle_hashes(split_words(batch.column("text")))
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((shingles, doc))
    new = np.ones(len(order), bool)
    new[1:] = (shingles[order][1:] != shingles[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    unique, owner = shingles[order][new], doc[order][new]
    size = np.bincount(owner, minlength=len(n))
    start = np.concatenate([[0], np.cumsum(size)])
    tokens = signature_of_sets(unique, start, tokens_of_set)
    # A set is named by two sums over its elements, which don't depend on their order.
    names = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(unique * np.uint64(salt | 1)), dtype=np.uint64)])
        names.append(mix64(sums[start[1:]] - sums[start[:-1]] + size.astype(np.uint64)).view(np.int64))
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": batch.column("doc_id"),
            "k1": batch.column("k1"),
            "k2": batch.column("k2"),
            "s1": pa.array(names[0]),
            "s2": pa.array(names[1]),
            "tokens": pa.array([t.tobytes() for t in tokens], pa.binary()),
        }
    )


def embedded(texts: DataFrame, size: int = TOKENS) -> DataFrame:
    """(doc_id, k1, k2, s1, s2, tokens): the set name and the MinHash tokens of every row."""
    schema = "doc_id long, k1 long, k2 long, s1 long, s2 long, tokens binary"
    return texts.mapInArrow(by_slices(lambda batch: _embedded(batch, size), "text", CACHE_BYTES), schema)


def _positions(run: int) -> list[int]:
    """Token positions of a run; no two runs share one."""
    return list(range(run * DEPTH, (run + 1) * DEPTH))


def _path_key(run: int, depth: int):
    """Key of the bucket of a set in a run after ``depth`` splits."""
    parts = [F.substring("tokens", 4 * p + 1, 4) for p in _positions(run)[:depth]]
    return F.xxhash64(F.lit(run), F.lit(depth), *parts)


def buckets(sets: DataFrame, runs: int) -> DataFrame:
    """(set, bucket, members, run, depth) of all runs; buckets of one set are dropped, large ones split.

    Only (set, keys) rows travel; counts are pre-aggregated. ``depth`` is the
    number of splits after which the bucket was closed.
    """
    out = None
    paths = [F.struct(F.lit(r).alias("run"), *[_path_key(r, d).alias(f"k{d}") for d in range(1, DEPTH + 1)]) for r in range(runs)]
    open_rows = sets.select("set", F.explode(F.array(*paths)).alias("path")).select("set", "path.*")
    for depth in range(1, DEPTH + 1):
        key = f"k{depth}"
        counts = open_rows.groupBy(key).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        found = cut_lineage(open_rows.join(counts, key))
        small = found if depth == DEPTH else found.where(F.col("members") <= BUCKET)
        small = small.select("set", F.col(key).alias("bucket"), "members", "run", F.lit(depth).alias("depth"))
        out = small if out is None else out.unionByName(small)
        open_rows = found.where(F.col("members") > BUCKET).drop("members")
    return out


def meetings(members: DataFrame) -> DataFrame:
    """(set, run, block, low, high, meeting): what the last split leaves large is cut into blocks of which every two meet."""
    parts = F.when(F.col("members") > BUCKET, F.ceil(F.col("members") / F.lit(BLOCK))).otherwise(F.lit(1)).cast("int")
    cut = members.select("set", "run", "bucket", parts.alias("parts"), F.pmod(F.xxhash64("set"), parts).cast("int").alias("block"))
    met = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    name = F.when(F.col("parts") > 1, F.xxhash64("bucket", low, high)).otherwise(F.col("bucket"))
    return met.select("set", "run", "block", low.alias("low"), high.alias("high"), name.alias("meeting"))


def _likeness_groups(tokens: np.ndarray, least: int) -> np.ndarray:
    """Index of the first member each member is linked to, directly or by others."""
    n = len(tokens)
    root = np.arange(n)
    for i in range(n - 1):
        like = np.flatnonzero((tokens[i + 1 :] == tokens[i]).sum(axis=1) >= least) + i + 1
        if len(like):
            joined = np.unique(np.append(root[like], root[i]))
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    return root


def _compare(least: int, size: int):
    """Brute force inside buckets; rows arrive sorted by bucket, blocks hold at most BLOCK + BLOCK sets."""

    def solve(sets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(sets, kind="stable")
        sets, tokens = sets[order], tokens[order]
        root = _likeness_groups(tokens, least)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return sets[root[linked]], sets[linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            sets = np.concatenate([b.column("set").to_numpy() for b in held])
            raw = b"".join(t for b in held for t in b.column("tokens").to_pylist())
            a, b = solve(sets, np.frombuffer(raw, np.uint32).reshape(len(sets), size))
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1].column("bucket")[-1].as_py() != names[a]:
                    yield flush()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def candidate_links(sets: DataFrame, runs: int, size: int, least: int) -> DataFrame:
    """Links (a, b) of sets that may be similar: each to the first of its group in a bucket."""
    dealt = meetings(buckets(sets, runs)).select("set", F.col("meeting").alias("bucket"))
    rows = dealt.join(sets.select("set", "tokens"), "set").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_compare(least, size), "a long, b long").distinct()


EXACT = "set long, links long, near long"
ASKED = ["set", "run", "block", "low", "high", "meeting"]
ASKS = "set long, run int, block int, low int, high int, meeting long"


def _shingled(batch: pa.RecordBatch) -> pa.RecordBatch:
    shingles, first = shingle_hashes(split_words(batch.column("text")))
    rows = [np.unique(shingles[a:b]).tobytes() for a, b in zip(first, first[1:])]
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in ("set", "copies", "root", "size")] + [pa.array(rows, pa.binary())], ["set", "copies", "root", "size", "items"]
    )


def common_shingles(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and of the union of every two shingle sets."""
    n = len(items)
    flat = np.frombuffer(b"".join(items), np.uint64)
    size = np.array([len(i) // 8 for i in items], np.int64)
    owner = np.repeat(np.arange(n), size)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(flat)))
    common = np.zeros((n, n), np.int32)
    # Shingles of many sets go through one dense product, the others one by one.
    column = np.repeat(np.arange(len(begin)), count)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    width = min(1 << 12, int(column.max(initial=0)) + 1)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, (column.max() + 1) if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        dense = np.zeros((n, width), np.float32)
        dense[owner[part], column[part] - low] = 1
        common += (dense @ dense.T).astype(np.int32)
    return common, size[:, None] + size[None, :] - common


def in_pair(block: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    """Which two members belong to the two blocks of a meeting."""
    first, second = pair
    return ((block[:, None] == first) & (block[None, :] == second)) | ((block[:, None] == second) & (block[None, :] == first))


def links_in_task(sets: np.ndarray, copies: np.ndarray, block: np.ndarray, items: list[bytes], pair: tuple[int, int], threshold: float):
    """Exact links between two blocks (or inside one): (set, linked copies, first set of its component)."""
    kept = np.unique(sets, return_index=True)[1]  # rows with equal id and text come more than once
    sets, copies, block, items = sets[kept], copies[kept], block[kept], [items[i] for i in kept]
    return links_among(sets, copies, items, in_pair(block, pair), threshold)


def links_among(sets: np.ndarray, copies: np.ndarray, items: list[bytes], pairs: np.ndarray, threshold: float):
    """Exact links among the marked pairs of different sets: (set, linked copies, first set of its component)."""
    n = len(sets)
    common, union = common_shingles(items)
    like = (common >= threshold * union - 1e-9) & pairs
    np.fill_diagonal(like, False)
    links = like @ copies
    found = np.flatnonzero(links)
    # Spanning links: every set to the smallest set of its component in this meeting.
    root = np.arange(n)
    while len(found):
        low = np.minimum(root, np.where(like, root[None, :], n).min(axis=1))
        if (low == root).all():
            break
        root = low
    return sets[found], links[found], sets[root[found]]


def by_meeting(solve, wide: str = "items"):
    """Hand the rows of each meeting, which arrive together, to ``solve`` as one table.

    Batches are sliced by the bytes of the column ``wide``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in slices(batch, wide, 8 << 20):
                names = part.column("meeting").to_numpy()
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), part.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    if held and held[-1].column("meeting")[-1].as_py() != names[a]:
                        yield solve(pa.Table.from_batches(held).combine_chunks())
                        held = []
                    held.append(part.slice(a, b - a))
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _exact(threshold: float):
    def solve(t: pa.Table) -> pa.RecordBatch:
        get = lambda c: t.column(c).to_numpy()
        pair = (t.column("low")[0].as_py(), t.column("high")[0].as_py())
        a, n, b = links_in_task(get("set"), get("copies"), get("block"), t.column("items").to_pylist(), pair, threshold)
        return pa.RecordBatch.from_pydict({"set": pa.array(a, pa.int64()), "links": pa.array(n, pa.int64()), "near": pa.array(b, pa.int64())})

    return by_meeting(solve)


def first_met(tokens: np.ndarray, depths: np.ndarray, run: int, least: int) -> np.ndarray:
    """Which two sets are candidates that met in no earlier run.

    Two sets met in a run if both buckets closed there after equally many
    splits (0: the set was alone) and the tokens of those splits are equal.
    """
    n = len(tokens)
    equal = np.zeros((n, n), np.int16)
    for position in range(tokens.shape[1]):
        equal += tokens[:, position][:, None] == tokens[:, position][None, :]
    new = equal >= least
    np.fill_diagonal(new, False)
    for earlier in range(run):
        closed = depths[:, earlier]
        met = (closed[:, None] == closed[None, :]) & (closed > 0)[:, None]
        for level, position in enumerate(_positions(earlier)):
            same = tokens[:, position][:, None] == tokens[:, position][None, :]
            met &= same | (closed <= level)[:, None]
        new &= ~met
    return new


def _meeting(t: pa.Table, size: int, runs: int, least: int) -> np.ndarray:
    """Pairs to compare in a meeting of the second pass."""
    raw = b"".join(t.column("tokens").to_pylist())
    tokens = np.frombuffer(raw, np.uint32).reshape(t.num_rows, size)
    depths = t.column("depths").combine_chunks().flatten().to_numpy().reshape(t.num_rows, runs)
    pair = (t.column("low")[0].as_py(), t.column("high")[0].as_py())
    new = first_met(tokens, depths, t.column("run")[0].as_py(), least)
    return new & in_pair(t.column("block").to_numpy(), pair)


def _asking(size: int, runs: int, least: int):
    def solve(t: pa.Table) -> pa.RecordBatch:
        asks = np.flatnonzero(_meeting(t, size, runs, least).any(axis=1))
        return pa.RecordBatch.from_pydict({c: t.column(c).combine_chunks().take(pa.array(asks)) for c in ASKED})

    return by_meeting(solve, "tokens")


def _verified(size: int, runs: int, least: int, threshold: float):
    def solve(t: pa.Table) -> pa.RecordBatch:
        get = lambda c: t.column(c).to_numpy()
        new = _meeting(t, size, runs, least)
        a, n, b = links_among(get("set"), get("copies"), t.column("items").to_pylist(), new, threshold)
        return pa.RecordBatch.from_pydict({"set": pa.array(a, pa.int64()), "links": pa.array(n, pa.int64()), "near": pa.array(b, pa.int64())})

    return by_meeting(solve)


def crowd_meetings(sets: DataFrame, runs: int, size: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(marked, asks) of the sets (set, tokens) of large candidate groups.

    ``marked`` has (set, tokens, depths), ``asks`` (set, run, block, low, high,
    meeting) for each set that has a new candidate in a meeting.
    """
    closed = cut_lineage(buckets(sets, runs))
    by_run = [F.coalesce(F.max(F.when(F.col("run") == r, F.col("depth"))), F.lit(0)).cast("int") for r in range(runs)]
    depths = closed.groupBy("set").agg(F.array(*by_run).alias("depths"))
    marked = cut_lineage(sets.select("set", "tokens").join(depths, "set"))
    rows = meetings(closed).join(marked, "set").repartition("meeting").sortWithinPartitions("meeting")
    return marked, cut_lineage(rows.mapInArrow(_asking(size, runs, least), ASKS))


def links_where_met(texts: DataFrame, marked: DataFrame, asks: DataFrame, threshold: float, runs: int, size: int, least: int) -> DataFrame:
    """(set, links, near) of large candidate groups: each pair is compared in the first bucket it shares.

    texts has (set, copies, root, size, text); only sets that ask travel.
    """
    shingled = texts.mapInArrow(by_slices(_shingled), "set long, copies long, root long, size long, items binary")
    # Repeated rows bring the same set more than once.
    items = cut_lineage(shingled.groupBy("set").agg(F.first("copies").alias("copies"), F.first("items").alias("items")))
    rows = asks.join(marked, "set").join(items, "set").repartition("meeting").sortWithinPartitions("meeting")
    return rows.mapInArrow(_verified(size, runs, least, threshold), EXACT)


def sparse_groups(loose: DataFrame, large: DataFrame, asks: DataFrame) -> DataFrame:
    """(root) of the groups of ``large`` (root, size) for which asking moves fewer sets than all blocks would."""
    moved = asks.join(loose.withColumnRenamed("node", "set"), "set").groupBy("root").agg(F.count(F.lit(1)).alias("asks"))
    whole = F.col("size") * F.ceil(F.col("size") / F.lit(BLOCK))
    return large.join(moved, "root", "left").where(F.coalesce("asks", F.lit(0)) < whole).select("root")


def links_of_groups(texts: DataFrame, loose: DataFrame, sets: DataFrame, threshold: float, runs: int, size: int, least: int) -> DataFrame:
    """Exact links of all candidate groups; loose has (node, root), texts (k1, k2, text)."""
    sizes = loose.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = loose.join(sizes, "root").withColumnRenamed("node", "set").join(sets.select("set", "copies", "head"), "set")
    members = members.select("set", "copies", "root", "size", "head.k1", "head.k2")
    chosen = texts.join(members, ["k1", "k2"]).select("set", "copies", "root", "size", "text")
    large = cut_lineage(sizes.where(F.col("size") > BLOCK))
    if large.isEmpty():
        return exact_links(chosen, threshold)
    # At most one large group for every BLOCK sets.
    crowd = loose.join(broadcast_counted(large), "root").select(F.col("node").alias("set"))
    marked, asks = crowd_meetings(cut_lineage(sets.join(crowd, "set")), runs, size, least)
    sparse = cut_lineage(sparse_groups(loose, large, asks))
    if sparse.isEmpty():
        return exact_links(chosen, threshold)
    sparse = broadcast_counted(sparse)
    chosen = cut_lineage(chosen)
    asking = asks.join(loose.join(sparse, "root").select(F.col("node").alias("set")), "set")
    met = links_where_met(chosen.join(sparse, "root", "left_semi"), marked, asking, threshold, runs, size, least)
    return exact_links(chosen.join(sparse, "root", "left_anti"), threshold).unionByName(met)


def exact_links(texts: DataFrame, threshold: float) -> DataFrame:
    """(set, links, near) over candidate groups: texts has (set, copies, root, size, text).

    A group of more than BLOCK sets is cut into blocks by a hash of the set;
    every pair of blocks is one task's meeting.
    """
    shingled = texts.mapInArrow(by_slices(_shingled), "set long, copies long, root long, size long, items binary")
    parts = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("set"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = shingled.select("*", parts.alias("parts"), own.alias("block")).select("*", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = met.select("set", "copies", "root", "block", low.alias("low"), high.alias("high"), F.xxhash64("root", low, high).alias("meeting"), "items")
    rows = met.repartition("meeting").sortWithinPartitions("meeting")
    return rows.mapInArrow(_exact(threshold), EXACT)


NO_ID = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): id and text hash find a text again."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def classes_of(rows: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Class and link count of every row, from exact links (set, links, near) of sets."""
    roots = components(found.select(F.col("set").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "set")
    totals = found.groupBy("set").agg(F.sum("links").alias("links"))
    placed = sets.drop("tokens").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    first = placed.groupBy("root").agg(F.min("head").alias("first"))
    classes = placed.join(first, "root").join(totals, "set", "left").select(
        F.col("set").alias("s1"), "s2", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    own = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    class_id = F.nullif(F.col("first.k1"), F.lit(NO_ID))
    return rows.select("doc_id", "k1", "k2", "s1", "s2").join(classes, ["s1", "s2"]).select(
        "doc_id", class_id.alias("class_id"), "n_links", "k2", own.alias("stays")
    )


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, k2, stays) for every row of ``docs``.

    ``class_id`` is the smallest id among the documents that a chain of links
    of at least ``threshold`` joins, ``n_links`` the number of other rows this
    row is linked to. ``k2`` is the hash of the text. ``stays`` marks the
    document that names the class (also its repetitions with equal id and text).
    """
    texts = keyed(docs)
    runs, size, least = plan(threshold, recall)
    rows = cut_lineage(embedded(texts, size))
    head = F.min(F.struct("k1", "k2")).alias("head")
    named = rows.groupBy("s1", "s2").agg(head, F.count(F.lit(1)).alias("copies"), F.min("tokens").alias("tokens"))
    sets = cut_lineage(named.select(F.col("s1").alias("set"), "s2", "head", "copies", "tokens"))
    loose = components(candidate_links(sets, runs, size, least))
    found = cut_lineage(links_of_groups(texts.drop("doc_id"), loose, sets, threshold, runs, size, least))
    return classes_of(rows, sets, found)
