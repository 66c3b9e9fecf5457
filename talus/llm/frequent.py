"""The most frequent keys of a count table, without a sort or a large limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 64


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows of ``counts`` with the largest counts, at most ``limit``.

    Counts are put into logarithmic bands, STEPS to a factor of two; the bands
    that together hold at most ``limit`` rows stay whole. Only the number of
    rows per band, some thousand numbers, reaches the driver, where a sorted
    limit would gather ``limit`` rows from every task.
    """
    band = F.floor(F.log2(F.col(count).cast("double")) * STEPS)
    sizes = counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, least = limit, None
    for row in sorted(sizes, key=lambda r: -r["band"]):
        if row["n"] > room:
            break
        room -= row["n"]
        least = row["band"]
    return counts.where(F.lit(False) if least is None else band >= least)
