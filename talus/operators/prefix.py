"""Ordered prefix sums and dense indexes that never put all rows in one task.

Two levels: rows are cut into consecutive blocks that are bounded by
construction, each block is scanned on its own, and the small table of block
totals supplies the offset of every block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.scalars import hash_order
from talus.session import cut_lineage

BLOCK_ROWS = 65_536
SPARSE = 64


def block_scan(
    df: DataFrame,
    block: Column,
    order: list[Column],
    sums: dict[str, Column],
    by: list[str] | None = None,
) -> DataFrame:
    """Inclusive running sums over ``order``; ``block`` must rise with it.

    ``sums`` maps new column names to the summed expressions. The only
    single-task step sees one row per block and ``by`` group.
    """
    by = by or []
    keys = [*by, "_block"]
    tagged = df.select("*", block.alias("_block"), *[expr.alias(f"_in_{name}") for name, expr in sums.items()])
    totals = tagged.groupBy(*keys).agg(*[F.expr(f"sum(_in_{n}) AS _tot_{n}") for n in sums])
    group = f"PARTITION BY {', '.join(f'`{c}`' for c in by)}" if by else ""
    before = f"({group} ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = totals.selectExpr(*keys, *[f"coalesce(sum(_tot_{n}) OVER {before}, 0) AS _base_{n}" for n in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.join(bases, keys)
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_base_{n}") + F.sum(f"_in_{n}").over(inside)).alias(n) for n in sums],
    )


def _id_ranges(df: DataFrame, key: str, width: int) -> Column | None:
    """Ranges of ``width`` ids as blocks, if the ids are dense enough to fill them.

    With at most SPARSE ids of the range to each row there is a block for
    every width / SPARSE rows, whatever the ids; sparser ids give None.
    """
    low, high, rows = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if rows and (high - low + 1) > SPARSE * max(rows, width):
        return None
    return F.floor((F.col(key) - F.lit(low or 0)) / F.lit(width))


def dense_index_by_id(df: DataFrame, key: str, name: str = "idx", width: int = BLOCK_ROWS) -> DataFrame:
    """0-based dense index in the order of a unique integer key.

    Blocks are key ranges, so a block holds at most ``width`` rows; sparse
    keys are numbered by a range sort.
    """
    block = _id_ranges(df, key, width)
    if block is None:
        return dense_index(df, [F.col(key)], name)
    ranked = block_scan(df, block, [F.col(key)], {name: F.lit(1).cast("long")})
    return ranked.withColumn(name, F.col(name) - 1)


def digest_digits(rows: int) -> int:
    """Hexadecimal digits whose prefixes cut ``rows`` digests into blocks of at most about BLOCK_ROWS."""
    digits = 1
    while rows > BLOCK_ROWS * 16**digits:
        digits += 1
    return digits


def dense_index_by_hash(
    df: DataFrame, key: str, seed: int, name: str = "row_index", digits: int | None = None
) -> DataFrame:
    """0-based dense index of a reproducible random permutation.

    Rows are ordered by a salted digest of a unique key; blocks are digest
    prefixes and therefore evenly filled whatever the keys look like.
    """
    digits = digits or digest_digits(df.count())
    digest = hash_order(F.col(key), seed)
    ordered = df.withColumn("_h", F.unhex(digest))  # bytes order as their digits do, in half the room
    ranked = block_scan(
        ordered, F.substring(digest, 1, digits), [F.col("_h")], {name: F.lit(1).cast("long")}
    )
    return ranked.withColumn(name, F.col(name) - 1).drop("_h")


def dense_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """0-based dense index for any total order.

    One range-partitioned sort; the sorted rows are checkpointed because the
    range bounds come from a sample and must not move between the counting
    pass and the numbering pass.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    inside = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(bases), "_part")  # one row per shuffle partition
        .withColumn(name, F.col("_base") + inside)
        .drop("_pos", "_part", "_base")
    )


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums for any total order of the rows."""
    indexed = dense_index(df, order, "_idx")
    return block_scan(indexed, F.floor(F.col("_idx") / BLOCK_ROWS), [F.col("_idx")], sums).drop("_idx")


def cumulative_counts(units: DataFrame) -> DataFrame:
    """(idx, n) with a dense idx -> (idx, n, cs_prev, cs)."""
    block = F.floor(F.col("idx") / BLOCK_ROWS)
    scanned = block_scan(units.select("idx", "n"), block, [F.col("idx")], {"cs": F.col("n")})
    return scanned.select("idx", "n", (F.col("cs") - F.col("n")).alias("cs_prev"), "cs")


def indexed_counts(sizes: DataFrame, key: str) -> DataFrame:
    """(key, n) with a unique integer key -> (idx, n, cs_prev, cs) in one scan."""
    one = F.lit(1).cast("long")
    rows = sizes.select(key, "n")
    sums = {"pos": one, "cs": F.col("n")}
    block = _id_ranges(rows, key, BLOCK_ROWS)
    scanned = running_sums(rows, [F.col(key)], sums) if block is None else block_scan(rows, block, [F.col(key)], sums)
    return scanned.selectExpr("pos - 1 AS idx", "n", "cs - n AS cs_prev", "cs")
