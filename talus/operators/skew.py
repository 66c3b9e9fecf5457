"""Joins and lags that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.prefix import BLOCK_ROWS, dense_index
from talus.session import BROADCAST_BYTES, broadcast_counted, cut_lineage, row_bytes

SHARES = 2
_WORDS = 512  # 64-bit words of a bitmap in one row


def heavy_keys(big: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, salts) of the keys with more than 1 / (SHARES parts) of all rows; salts cut each into about that share.

    There are fewer than SHARES x parts of them, whatever the data: a proven
    bound for a broadcast. Rows are counted map-side, one row per key is written.
    """
    counts = cut_lineage(big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows")))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    share = max(1, -(-total // (SHARES * parts)))
    return cut_lineage(counts.where(F.col("_rows") > share).select(key, F.ceil(F.col("_rows") / share).cast("int").alias("_salts")))


def copies(small: DataFrame, heavy: DataFrame, key: str) -> DataFrame:
    """The unique side with a row for each salt of its key: one, but for heavy keys."""
    last = F.coalesce("_salts", F.lit(1)) - 1
    return small.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")


def salted_join(
    big: DataFrame, small: DataFrame, key: str, spread: list[str], salts: int | None = None, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Inner join of many rows per ``key`` with one row per ``key``.

    A unique side counted to be small is broadcast, which moves no row of the
    other side. Otherwise the weights of the keys are measured, and the rows of
    each heavy key are spread over as many join keys as its share of the rows
    needs, by a hash of the ``spread`` columns (a function of the row, so a
    recomputed task places it the same way). Only heavy keys of the unique side
    are copied. AQE's own skew split does not help there: an aggregation by the
    same key would reuse the join's partitioning and pin a hot key to one task.
    With the salt in the join key the aggregation gets its own map-side combine
    and shuffle. ``salts`` is the number of tasks to spread over, by default
    the shuffle partitions.
    """
    if small.count() * row_bytes(small.schema) <= broadcast_bytes:
        return big.join(F.broadcast(small), key)
    parts = salts or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(big, key, parts)
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = big.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt).drop("_salts")
    return salted.join(copies(small, heavy, key), [key, "_salt"]).drop("_salt")


def likely_members(big: DataFrame, key: str, members: DataFrame, bits: int = 8, few: int = BROADCAST_BYTES // 32) -> DataFrame:
    """``big`` without most rows whose ``key`` is not among ``members`` (one column); every other row stays.

    A hash of each member sets one of ``bits`` bits a member in a broadcast bitmap, so
    about one in ``bits`` other keys passes too; the join that follows decides. That join
    broadcasts ``few`` members itself, and a bitmap over the broadcast limit is not built.
    """
    rows = members.count()
    words = -(-max(rows, 1) * bits // (64 * _WORDS)) * _WORDS
    if rows <= few or words * 8 > BROADCAST_BYTES:
        return big
    (field,) = members.schema.fields
    slot = lambda name: F.pmod(F.xxhash64(F.col(name).cast(field.dataType)), F.lit(words * 64))
    place, bit = F.floor(F.col("_slot") / 64), F.pmod(F.col("_slot"), F.lit(64)).cast("int")
    found = members.select(slot(field.name).alias("_slot")).select(place.alias("_w"), F.expr("shiftleft(1L, CAST(_slot % 64 AS INT))").alias("_b"))
    every = members.sparkSession.range(words).select(F.col("id").alias("_w"), F.lit(0).cast("long").alias("_b"))
    filled = found.unionByName(every).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    held = filled.groupBy(F.floor(F.col("_w") / _WORDS).alias("_page")).agg(F.array_sort(F.collect_list(F.struct("_w", "_b")))["_b"].alias("_bits"))
    paged = big.withColumn("_slot", slot(key)).withColumn("_page", F.floor(place / _WORDS))
    word = F.element_at("_bits", (F.pmod(place, F.lit(_WORDS)) + 1).cast("int"))
    return paged.join(F.broadcast(held), "_page").where(F.getbit(word, bit) == 1).select(*[F.col(f"`{c}`") for c in big.columns])


def lag_within(df: DataFrame, key: str, order: str, column: str, name: str) -> DataFrame:
    """Previous value of ``column`` in ``order`` within ``key``; NULL keys form one group.

    The rows are numbered by a range sort and cut into blocks of BLOCK_ROWS, each
    scanned on its own, so a key may hold any share of them. The first row of a
    block meets the last one of the block before by number.
    """
    row = F.struct(F.col(key).alias("k"), F.col(column).alias("v"))
    numbered = dense_index(df, [F.col(key), F.col(order)], "_i").withColumn("_block", F.floor(F.col("_i") / BLOCK_ROWS))
    last = F.pmod(F.col("_i"), F.lit(BLOCK_ROWS)) == BLOCK_ROWS - 1
    ends = numbered.where(last).select((F.col("_block") + 1).alias("_block"), row.alias("_end"))
    inside = numbered.withColumn("_before", F.lag(row).over(Window.partitionBy("_block").orderBy("_i")))
    before = F.coalesce("_before", "_end")
    same = before.isNotNull() & before["k"].eqNullSafe(F.col(key))
    joined = inside.join(broadcast_counted(ends), "_block", "left")
    return joined.withColumn(name, F.when(same, before["v"])).drop("_i", "_block", "_before", "_end")
