"""Ranking metrics of scores, exact with ties, for any number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.scalars import hash_bucket
from talus.operators.prefix import BLOCK_ROWS, block_scan, dense_index
from talus.operators.quantiles import grouped_quantiles
from talus.operators.skew import salted_join
from talus.session import BROADCAST_BYTES, cut_lineage

CI_QUANTILES = {"lo": 0.025, "hi": 0.975}
CALIBRATION_BINS = 10


def score_table(df: DataFrame, keys: list[str], score: str, y: str) -> DataFrame:
    """One row per (keys, distinct score) with counts up to and including it.

    Rows are reduced to distinct scores first, so tied scores cost one row;
    the distinct scores are then numbered by a range sort and summed in blocks.
    """
    histogram = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")
    )
    indexed = dense_index(histogram, [*[F.col(k) for k in keys], F.col("score")], "_idx")
    return block_scan(
        indexed,
        F.floor(F.col("_idx") / BLOCK_ROWS),
        [F.col("_idx")],
        {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
        by=keys,
    )


def _area(pos: Column, neg: Column, cum_neg: Column) -> Column:
    """Mann-Whitney area; ties count half."""
    wins = F.sum(pos * (cum_neg - neg / 2.0))
    return wins / F.nullif((F.sum(pos) * F.sum(neg)).cast("double"), F.lit(0.0))


def auroc(df: DataFrame, score: str, y: str, keys: list[str] | None = None) -> DataFrame:
    table = score_table(df, keys or [], score, y)
    return table.groupBy(*(keys or [])).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        _area(F.col("pos"), F.col("neg"), F.col("cum_neg")).alias("auroc"),
    )


def _precision_at(pos: Column, neg: Column, cum_pos: Column, cum_neg: Column, all_pos: Column, all_neg: Column) -> Column:
    """Precision of everything scored at least this high."""
    tp, fp = all_pos - cum_pos + pos, all_neg - cum_neg + neg
    return tp / F.nullif((tp + fp).cast("double"), F.lit(0.0))


def average_precision(df: DataFrame, score: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Step-wise average precision (no interpolation), per group of ``keys``."""
    keys = keys or []
    table = score_table(df, keys, score, y)
    sums = table.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    precision = _precision_at(*[F.col(c) for c in ("pos", "neg", "cum_pos", "cum_neg", "all_pos", "all_neg")])
    met = table.join(sums, keys) if keys else table.crossJoin(F.broadcast(sums))  # one row of totals
    return met.groupBy(*keys).agg(
        (F.sum(precision * F.col("pos")) / F.nullif(F.max("all_pos").cast("double"), F.lit(0.0))).alias("auprc")
    )


def brier(df: DataFrame, score: str, y: str) -> DataFrame:
    gap = F.col(score) - F.col(y)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("brier"), F.avg(y).alias("prevalence"))


def calibration(df: DataFrame, score: str, y: str, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean prediction against observed rate in right-closed quantile bins."""
    edges = grouped_quantiles(df, [], {f"_e{i}": (score, i / bins) for i in range(1, bins)})
    which = F.lit(0)
    for i in range(1, bins):
        which = which + (F.col(score) > F.col(f"_e{i}")).cast("int")
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", which)  # one row of edges
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("pred"), F.avg(y).alias("obs")
    )


CHUNK = 256
SUBJECT_BLOCK = 1024
RANK_BLOCK = 2048


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, chunk, first, picks), sorted by block and chunk -> (s, chunk, w): draws of each subject by resample."""
    held, counts = None, None

    def rows():
        drawn = np.flatnonzero(counts.any(axis=1))
        s = pa.array(held[0] * SUBJECT_BLOCK + drawn, pa.int64())
        return pa.RecordBatch.from_arrays([s, pa.array([held[1]] * len(drawn), pa.int32()), pa.array([counts[i].tobytes() for i in drawn], pa.binary())], ["s", "chunk", "w"])

    for batch in batches:
        for block, chunk, first, picks in zip(*(batch.column(c).to_pylist() for c in ("block", "chunk", "first", "picks"))):
            if held != (block, chunk):
                if held is not None:
                    yield rows()
                held, counts = (block, chunk), np.zeros((SUBJECT_BLOCK, CHUNK), np.int32)
            np.add.at(counts, (np.frombuffer(picks, np.uint16), np.frombuffer(first, np.uint16)), 1)
    if held is not None:
        yield rows()


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, picks of its resamples) -> the picks packed by block of the drawn subject."""
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            picks, chunk = part.column("picks"), part.column("chunk").to_numpy()
            drawn, sizes = picks.flatten().to_numpy(), np.diff(picks.offsets.to_numpy())
            of = np.repeat(chunk, sizes)
            place = np.arange(len(drawn)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            block = drawn // SUBJECT_BLOCK
            order = np.lexsort((block, of))
            new = np.append(True, (np.diff(block[order]) != 0) | (np.diff(of[order]) != 0)) if len(order) else np.zeros(0, bool)
            cuts = np.append(np.flatnonzero(new), len(order))
            local, first = (drawn % SUBJECT_BLOCK).astype(np.uint16)[order], place.astype(np.uint16)[order]
            heads = order[cuts[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[heads], pa.int64()),
                    pa.array(of[heads], pa.int32()),
                    pa.array([first[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([local[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                ],
                ["block", "chunk", "first", "picks"],
            )


def resample_weights(subjects: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(s, chunk, w): how often subject number s is drawn in the CHUNK resamples of a chunk, as packed integers.

    Draw j of resample b picks a subject by a digest of (seed, b, j), so every
    draw is made by the task that holds subject j, all resamples of a chunk in
    one array. Draws travel packed by blocks of drawn subjects; a task adds up
    one block of subjects and one chunk at a time. Subjects that a chunk never
    draws have no row in it.
    """
    n = max(subjects.count(), 1)
    chunks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // CHUNK))).alias("chunk")
    draws = subjects.select(F.col("s").alias("j"), chunks)
    number = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.lit(n_boot)) - 1)
    pick = lambda b: hash_bucket(F.concat_ws("|", b.cast("string"), F.col("j").cast("string")), str(seed), n).cast("long")
    packed = draws.select("chunk", F.transform(number, pick).alias("picks"))
    dealt = packed.mapInArrow(_dealt, "block long, chunk int, first binary, picks binary")
    return dealt.repartition("block", "chunk").sortWithinPartitions("block", "chunk").mapInArrow(_counted, "s long, chunk int, w binary")


def _by_rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, rank, pos, neg, w) -> weighted positives and negatives of every chunk and rank of a batch, as arrays."""
    for batch in batches:
        for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
            w = np.frombuffer(b"".join(part.column("w").to_pylist()), np.int32).reshape(-1, CHUNK).astype(np.int64)
            chunk, rank, pos, neg = (part.column(c).to_numpy() for c in ("chunk", "rank", "pos", "neg"))
            order = np.lexsort((rank, chunk))
            start = np.flatnonzero(np.append(True, (np.diff(rank[order]) != 0) | (np.diff(chunk[order]) != 0)))
            sums = [np.add.reduceat(w[order] * side[order, None], start, axis=0) for side in (pos, neg)]
            heads = order[start]
            columns = [pa.array(chunk[heads]), pa.array(rank[heads]), *(pa.array([r.tobytes() for r in side], pa.binary()) for side in sums)]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "rank", "pos", "neg"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, block, rank, pos, neg), sorted by the first three -> one row for each of them, arrays added up."""
    held = None
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            chunk, block, rank = (part.column(c).to_numpy() for c in ("chunk", "block", "rank"))
            start = np.flatnonzero(np.append(True, (np.diff(rank) != 0) | (np.diff(chunk) != 0)))
            sides = [np.add.reduceat(np.frombuffer(b"".join(part.column(c).to_pylist()), np.int64).reshape(-1, CHUNK), start, axis=0) for c in ("pos", "neg")]
            keys = [chunk[start], block[start], rank[start]]
            if held is not None:
                if held[0][0] == keys[0][0] and held[2][0] == keys[2][0]:  # the key goes on from the rows before
                    for side, earlier in zip(sides, held[3:]):
                        side[0] += earlier[0]
                else:
                    yield _packed_ranks(*held)
            held = tuple(c[-1:].copy() for c in (*keys, *sides))
            if len(start) > 1:
                yield _packed_ranks(*(c[:-1] for c in (*keys, *sides)))
    if held is not None:
        yield _packed_ranks(*held)


def _packed_ranks(chunk: np.ndarray, block: np.ndarray, rank: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> pa.RecordBatch:
    sides = (pa.array([r.tobytes() for r in side], pa.binary()) for side in (pos, neg))
    return pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(block), pa.array(rank), *sides], ["chunk", "block", "rank", "pos", "neg"])


def _ranked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(positives, negatives) of a block's ranks in order, one line a rank."""
    rank = table.column("rank").to_numpy()
    order = np.argsort(rank, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(rank[order]) != 0))
    sides = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64).reshape(-1, CHUNK)[order] for c in ("pos", "neg"))
    return tuple(np.add.reduceat(side, start, axis=0) for side in sides)


def _totals(table: pa.Table) -> pa.Table:
    pos, neg = (side.sum(axis=0) for side in _ranked(table))
    chunk, block = (table.column(c)[0].as_py() for c in ("chunk", "block"))
    b = np.arange(chunk * CHUNK, (chunk + 1) * CHUNK)
    return pa.table({"b": b.astype(np.int32), "block": np.full(CHUNK, block), "pos": pos, "neg": neg})


def _areas(table: pa.Table, sums: pa.Table) -> pa.Table:
    """Sums over a block's ranks of the wins and of precision times positives, by resample.

    ``sums`` has a row per resample: what lies below the block, and in all.
    """
    b = sums.column("b").to_numpy()
    if not table.num_rows:
        return pa.table({"b": b, "wins": np.zeros(len(b)), "gain": np.zeros(len(b))})
    pos, neg = _ranked(table)
    order = np.argsort(b)
    below_pos, below_neg, all_pos, all_neg = (sums.column(c).to_numpy()[order] for c in ("pos_below", "neg_below", "all_pos", "all_neg"))
    cum_pos, cum_neg = below_pos + np.cumsum(pos, axis=0), below_neg + np.cumsum(neg, axis=0)
    tp, fp = all_pos - cum_pos + pos, all_neg - cum_neg + neg
    precision = tp / np.maximum(tp + fp, 1)
    return pa.table({"b": b[order], "wins": (pos * (cum_neg - neg / 2.0)).sum(axis=0), "gain": (pos * precision).sum(axis=0)})


def bootstrap_metrics(df: DataFrame, score: str, y: str, subject: str, n_boot: int, seed: int) -> DataFrame:
    """(b, auroc, auprc) per resample of whole subjects; degenerate ones drop out.

    Rows are reduced to counts by subject and distinct score. Each meets its
    subject's weights, an array over the resamples of a chunk; arrays of one
    score are added up by the tasks before they move and once more where they
    meet, row by row. Blocks of RANK_BLOCK scores
    are scanned as arrays, first for their sums, then, with the sums of the
    scores below them, for both areas.
    """
    ordered = df.select(F.col(score).alias("score")).filter("score IS NOT NULL").distinct()
    scores = dense_index(ordered, [F.col("score")], "rank")
    subjects = cut_lineage(dense_index(df.select(subject).distinct(), [F.col(subject)], "s"))
    counts = (
        df.withColumn("score", F.col(score))
        .groupBy(subject, "score")
        .agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
        .join(subjects, subject)
    )
    counts = cut_lineage(salted_join(counts, cut_lineage(scores), "score", ["s"]).select("s", "rank", "pos", "neg"))
    weights = cut_lineage(resample_weights(subjects, n_boot, seed))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // CHUNK))).alias("chunk")
    spread = counts.select("*", chunks).withColumn("at", F.struct("s", "chunk"))
    packed = weights.select(F.struct("s", "chunk").alias("at"), "w")
    met = salted_join(spread, packed, "at", ["rank"], broadcast_bytes=BROADCAST_BYTES // 4)  # a row is four times its estimate
    summed = met.select("chunk", "rank", "pos", "neg", "w").mapInArrow(_by_rank, "chunk int, rank long, pos binary, neg binary")
    keys = ["chunk", "block", "rank"]
    spread_out = summed.withColumn("block", F.floor(F.col("rank") / RANK_BLOCK)).select(*keys, "pos", "neg")
    gathered = spread_out.repartition("chunk", "block").sortWithinPartitions(*keys)
    # one row a score, however many tasks met it: a block of scores is bounded
    table = cut_lineage(gathered.mapInArrow(_merged, "chunk int, block long, rank long, pos binary, neg binary"))
    sums = cut_lineage(table.groupBy("chunk", "block").applyInArrow(_totals, "b int, block long, pos long, neg long"))
    totals = sums.groupBy("b").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    earlier = Window.partitionBy("b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    below = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_below") for c in ("pos", "neg")]
    bases = sums.select("b", "block", *below).join(totals, "b").withColumn("chunk", F.floor(F.col("b") / CHUNK).cast("int"))
    both = table.groupBy("chunk", "block").cogroup(bases.groupBy("chunk", "block"))
    areas = both.applyInArrow(_areas, "b int, wins double, gain double")
    joined = areas.groupBy("b").agg(F.sum("wins").alias("wins"), F.sum("gain").alias("gain")).join(totals, "b")
    kept = joined.filter((F.col("b") < n_boot) & (F.col("all_pos") > 0) & (F.col("all_neg") > 0))
    return kept.select(
        "b", (F.col("wins") / (F.col("all_pos") * F.col("all_neg")).cast("double")).alias("auroc"), (F.col("gain") / F.col("all_pos")).alias("auprc")
    )


def confidence_intervals(boot: DataFrame) -> DataFrame:
    """Percentile intervals of both metrics over the resamples."""
    wanted = {f"{m}_{side}": (m, q) for m in ("auroc", "auprc") for side, q in CI_QUANTILES.items()}
    return grouped_quantiles(boot, [], wanted, [F.count(F.lit(1)).alias("n_boot")])
