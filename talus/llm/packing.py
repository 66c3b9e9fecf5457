"""Best-fit packing of tokenized documents by a configuration linear program.

Documents are cut into pieces of at most ``CAPACITY`` tokens. Pieces of equal
length are alike, so the plan is made on the length histogram, which has at
most CAPACITY rows. Lengths are grouped linearly into at most ``GROUPS`` groups
and stand for the longest of their group. A configuration says how many pieces
of each group share a sequence; the linear program asks for the fewest
configurations that cover all groups. It is solved by multiplicative weights:
each round a knapsack dynamic program finds the configuration of the largest
total weight, it is taken a fixed integral number of times, and groups that
lag behind gain weight exponentially. Pieces of a third of a sequence (1 in
``SMALL``) or less are left out of the program; they and what the rounding
leaves are packed best fit into the true room of the planned sequences, by
runs of alike ones.

Null text counts as empty: one piece with the end id only. Repeated rows are
packed each. Further columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.text import LOWER, Words, ragged_ranges, slices, split_words
from talus.session import cut_lineage

CAPACITY = 2048
END = 0
GROUPS = 512
ROUNDS = 800
SMALL = 3
PULL = 0.5
TOKEN_BYTES = 1 << 20
CACHED = 1 << 20
LIST = 256
LISTS = 8


STOPS = b".,;:!?"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True


class WordTokenizer:
    """Ids of texts from ids of their white-space separated chunks.

    The tokenizer never joins characters across white space, nor a letter and a
    stop (``STOPS``) after it, and lowers case; so chunks also end before such
    stops, ASCII capitals are lowered unless a special token may be meant, and
    every distinct chunk is encoded once and looked up afterwards.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Encode new chunks (ascending ``hashes``), a few thousand at a time."""
        lengths, ids = [], []
        for at in range(0, len(chunks), LIST * LISTS):
            lists = [chunks[i : i + LIST] for i in range(at, min(at + LIST * LISTS, len(chunks)), LIST)]
            for own, coded in zip(lists, self.tokenizer.encode_batch([" ".join(own) for own in lists], add_special_tokens=False)):
                ids.append(np.array(coded.ids, np.uint32))
                begin = np.cumsum([0, *(len(chunk) + 1 for chunk in own)])
                place = np.array(coded.offsets, np.int64).reshape(-1, 2)[:, 0]
                lengths.append(np.bincount(np.searchsorted(begin, place, "right") - 1, minlength=len(own)))
        length = np.concatenate(lengths)
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.start = np.insert(self.start, place, np.cumsum(length) - length + len(self.ids))
        self.length = np.insert(self.length, place, length)
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of all texts end to end, each text followed by END."""
        words = split_words(column)
        data = words.data if b"<|" in words.data.tobytes() else LOWER[words.data]
        cut = np.flatnonzero(_LETTER[data[:-1]] & _STOP[data[1:]]) + 1
        starts = np.sort(np.concatenate([words.start, cut]))
        ends = np.sort(np.concatenate([words.end, cut]))
        words = Words(data, starts, ends, words.doc, np.searchsorted(starts, np.append(words.start, len(data))[words.first]))
        if len(self.known) > CACHED:
            self.forget()
        hashes, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != hashes[inside]
        if new.any():
            data = words.data.tobytes()
            self.learn(hashes[new], [data[words.start[i] : words.end[i]].decode() for i in at[new]])
        place = np.searchsorted(self.known, hashes)[inverse]
        start, length = self.start[place], self.length[place]
        total = np.concatenate([[0], np.cumsum(length)])
        docs = len(words.first) - 1
        first = total[words.first] + np.arange(docs + 1)
        out = np.full(first[-1], END, np.uint32)
        own = np.ones(len(out), bool)
        own[first[1:] - 1] = False
        out[own] = self.ids[ragged_ranges(start, length)]
        return out, first


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(path)
        for batch in batches:
            for part in slices(batch, "text", TOKEN_BYTES):
                ids, first = coder.encode(part.column("text"))
                ids = ids.astype("<u4")
                size = np.diff(first)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = ragged_ranges(np.zeros(len(n), np.int64), n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                begin = first[doc] + start
                check = [zlib.crc32(ids[a : a + m]) for a, m in zip(begin, length)]
                take = pa.array(doc)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part.column("row").take(take),
                        "doc_id": part.column("doc_id").take(take),
                        "piece": pa.array(piece.astype(np.int32)),
                        "start": pa.array(start),
                        "length": pa.array(length),
                        "ids_crc32": pa.array(check, pa.int64()),
                    }
                )

    return run


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; ``row`` tells equal documents apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(_pieces(path, capacity), PIECES)


def _price(weight: np.ndarray, sizes: np.ndarray, capacity: int) -> list[int]:
    """Groups, with repetition, of the heaviest content of one sequence."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            value = best[c - sizes[: upto[c]]] + weight[: upto[c]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], choice[c] = value[k], k
    found, c = [], capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            found.append(int(choice[c]))
            c -= sizes[choice[c]]
    return found


def _groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """Group of each length: consecutive lengths with about equal numbers of pieces."""
    if len(lengths) <= groups:
        return np.arange(len(lengths))
    middle = np.cumsum(counts) - counts / 2
    return np.unique((middle * groups / counts.sum()).astype(np.int64), return_inverse=True)[1]


Item = tuple[int, int]  # (group, rank of the piece in the first of the alike sequences)


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, rounds: int = ROUNDS):
    """Plan for a length histogram (ascending lengths below ``capacity``).

    Returns [(times, [(group, rank), ...])] and, of each length, its group and
    the rank of its first piece: pieces of a group are ranked by length. The
    i-th of the ``times`` alike sequences holds the pieces of rank ``rank`` + i.
    """
    large = lengths > capacity // SMALL
    own = np.arange(len(lengths))
    if large.any():
        own[large] = _groups(lengths[large], counts[large], groups) + (~large).sum()
    total = np.bincount(own, counts).astype(np.int64)
    base = np.cumsum(counts) - counts - np.concatenate([[0], np.cumsum(total)])[own]
    sizes = np.zeros(len(total), np.int64)
    np.maximum.at(sizes, own, lengths)
    used = np.zeros(len(total), np.int64)
    priced = np.bincount(own, large) > 0
    times = max(1, int(-(-(lengths * counts)[large].sum() // capacity) // rounds))
    plan: list[tuple[int, list[Item]]] = []
    while True:
        left = total - used
        stock = np.flatnonzero(priced & (left >= times))
        if not len(stock):
            break
        lag = left[stock] / total[stock] - left[priced].sum() / total[priced].sum()
        taken: list[Item] = []
        fill = 0
        for k in _price(sizes[stock] * np.exp(PULL * lag), sizes[stock], capacity):
            g = int(stock[k])
            if total[g] - used[g] >= times:  # the dynamic program may repeat a group beyond its stock
                taken.append((g, int(used[g])))
                used[g] += times
                fill += sizes[g]
        while True:  # fill what such repeats left open, largest first
            fits = np.flatnonzero(priced & (total - used >= times) & (sizes <= capacity - fill))
            if not len(fits):
                break
            g = int(fits[-1])
            taken.append((g, int(used[g])))
            used[g] += times
            fill += sizes[g]
        plan.append((times, taken))
    return _best_fit(plan, lengths, counts, own, base, used, capacity), own, base


def _best_fit(plan, lengths, counts, own, base, used, capacity: int):
    """Add the pieces the plan leaves, largest first, each to the fullest sequence with room.

    Works on runs of alike sequences, not on sequences. A planned configuration
    falls into runs where the true lengths of its pieces change; all lengths
    change once in their group, so the runs are bounded by lengths and rounds.
    """
    of_group = {int(g): np.flatnonzero(own == g) for g in np.unique(own)}
    open_runs: dict[int, list[tuple[int, list[Item]]]] = {}

    def put(free: int, times: int, items: list[Item]) -> None:
        open_runs.setdefault(free, []).append((times, items))

    for times, items in plan:
        cuts = {0, times}
        for g, rank in items:
            steps = base[of_group[g]] - rank
            cuts |= {int(c) for c in steps[(steps > 0) & (steps < times)]}
        edges = sorted(cuts)
        for low, high in zip(edges, edges[1:]):
            fill = 0
            for g, rank in items:
                at = of_group[g]
                fill += int(lengths[at[np.searchsorted(base[at], rank + low, "right") - 1]])
            put(capacity - fill, high - low, [(g, rank + low) for g, rank in items])
    for i in range(len(lengths) - 1, -1, -1):
        size, g = int(lengths[i]), int(own[i])
        rank = max(int(base[i]), int(used[g]))
        left = int(base[i] + counts[i]) - rank
        while left > 0:
            free = min((f for f in open_runs if f >= size), default=None)
            if free is None:
                each = max(1, left // (capacity // size))
                put(capacity, each, [])
                free = capacity
            times, items = open_runs[free].pop()
            if not open_runs[free]:
                del open_runs[free]
            if times > left:
                put(free, times - left, [(h, r + left) for h, r in items])
                times = left
            put(free - size, times, [*items, (g, rank)])
            rank += times
            left -= times
    return [run for runs in open_runs.values() for run in runs]


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Rank of each piece among those of its length, from two levels of counts."""
    parts = max(1, rows // 8192)
    order = F.xxhash64("row", "piece")
    placed = pieces.withColumn("part", F.pmod(order, F.lit(parts)))
    counts = placed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy(order, "row", "piece"))
    ranked = placed.withColumn("inside", inside).join(counts, ["length", "part"])
    return ranked.withColumn("rank", F.col("before") + F.col("inside") - 1).drop("part", "before", "inside")


PLACED = PIECES + ", sequence_id long, slot int"


def _assign(shared):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, own, base, key, first, slot, full = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            at = np.minimum(np.searchsorted(lengths, length), max(len(lengths) - 1, 0))
            rank = batch.column("rank").to_numpy()
            whole = length == full
            sequence, place = rank.copy(), np.zeros(len(rank), np.int32)
            if len(lengths):
                wanted = (own[at].astype(np.int64) << 44) + base[at] + rank
                entry = np.searchsorted(key, wanted, "right") - 1
                sequence = np.where(whole, rank, first[entry] + wanted - key[entry])
                place = np.where(whole, 0, slot[entry]).astype(np.int32)
            keep = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(place)], [*keep, "sequence_id", "slot"]
            )

    return one


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, rounds: int = ROUNDS) -> DataFrame:
    """Pieces (PIECES columns, lengths up to ``capacity``) with sequence_id and offset."""
    counted = sorted((r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    full = sum(n for length, n in counted if length == capacity)
    lengths = np.array([m for m, _ in counted if m < capacity], np.int64)
    counts = np.array([n for m, n in counted if m < capacity], np.int64)
    key, first, slot = [], [], []
    own = base = np.zeros(0, np.int64)
    if len(lengths):
        plan, own, base = configurations(lengths, counts, capacity, groups, rounds)
        sequence = full
        for times, taken in plan:
            for k, (g, rank) in enumerate(taken):
                key.append((g << 44) + rank)
                first.append(sequence)
                slot.append(k)
            sequence += times
    order = np.argsort(np.array(key, np.int64))
    table = (lengths, own, base, *(np.array(v, np.int64)[order] for v in (key, first, slot)), capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # rounds x pieces of a sequence at most
    placed = _ranked(pieces, sum(n for _, n in counted)).mapInArrow(_assign(shared), PLACED)
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize all documents once, then pack the pieces."""
    return pack(cut_lineage(tokenized_pieces(docs, path, capacity)), capacity)
