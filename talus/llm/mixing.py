"""Mixing sources to target weights with an exact splitting tree.

Sources in order of code points (null last) weigh 5, 2, 1, repeating. Their
targets share 150 % of all words, none above twice its source. A source gives
whole passes over its documents and, for the rest, documents in permuted
order up to the word; the document at the edge gives its first words only.

The draws are cut into blocks, about ``BLOCKS`` in all. The quotas of blocks of
all sources are split over the output shards (``shards_for``) by a binary tree: a node
gives its left half a multivariate hypergeometric sample of its quotas, exact
in number, the right half the remainder. A source's blocks are then dealt in
permuted order, so shards hold disjoint blocks, and rows are ordered by a hash
inside each shard. Everything is deterministic: randomness is a hash of names.

Null text has size 0 and is taken 0 words. Repeated rows are drawn each.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
BLOCKS = 1 << 16
MIN_BLOCK_WORDS = 1 << 12
SHARDS = 16
SHARD_WORDS = 1 << 22
PARTS = 64
ROWS_PER_PART = 1 << 16
SEED = 10
SPACE = r"[\x20\x09-\x0D]+"
SPAN = 64


def sized(docs: DataFrame, name: str = "size") -> DataFrame:
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), ""))
    return docs.withColumn(name, words.cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, docs, target) of (source, size) rows.

    With w the weight and c the cap of a source, the targets are
    min(c, level * w): sorted by c / w, a source is full while the level that
    the others would need still exceeds its c / w. One row per source meets in
    the windows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    known = totals.withColumn("place", place).withColumn("weight", F.get(weights, (F.col("place") % len(WEIGHTS)).cast("int")))
    known = known.withColumn("cap", F.col("source_size") * float(CAP))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upward = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    onward = upward.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * (SHARE_PERCENT / 100)
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = known.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    common = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(common * F.col("weight"))
    return levelled.select("source", "place", "source_size", "docs", target.alias("target"))


def _running(rows: DataFrame, key: list[str], order: Column, value: str, name: str, parts: int) -> DataFrame:
    """Sum of ``value`` over the rows before this one in ``order`` (a long hash), by key, in two levels.

    The hash range is cut into ``parts``; one row per key and part meets in the upper window.
    """
    part = F.floor((order / F.lit(2.0**63) + 1) / 2 * parts).cast("int")
    placed = rows.withColumns({"_o": order, "_part": part})
    sums = placed.groupBy(*key, "_part").agg(F.sum(value).alias("_v"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "_part", F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, "_part").orderBy("_o", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(sums, [*key, "_part"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_o", "_part", "_in", "_before")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: as the variable of a one-element transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hypergeometric(good: Column, bad: Column, draws: Column, chance: Column) -> Column:
    """How many of ``draws`` fall among ``good``: inverse transform of ``chance`` in (0, 1).

    Probabilities relative to the mode follow from ratios of neighbours; they
    are gone through from the mode up, then down, as far as the support or
    eight standard deviations and SPAN steps.
    """
    low, high = F.greatest(F.lit(0), draws - bad), F.least(good, draws)
    middle = F.floor((draws + 1) * (good + 1) / (good + bad + 2)).cast("long")
    spread = F.ceil(8 * F.sqrt(draws * (good / (good + bad)) * (bad / (good + bad)))).cast("long") + SPAN
    nothing = F.expr("CAST(array() AS array<bigint>)")

    def around(mode: Column) -> Column:
        stop, start = F.least(high, mode + spread), F.greatest(low, mode - spread)
        up = F.when(stop > mode, F.sequence(mode + 1, stop)).otherwise(nothing)
        down = F.when(start < mode, F.sequence(mode - 1, start)).otherwise(nothing)
        ratio = lambda k: (good - k + 1) * (draws - k + 1) / (k * (bad - draws + k)).cast("double")  # noqa: E731  p(k) / p(k - 1)
        state = lambda p, s, k: F.struct(p.alias("p"), s.alias("s"), k.alias("k"))

        def walk(first: Column, goal: Column) -> Column:
            def step(factor):
                def one(a: Column, k: Column) -> Column:
                    return _bound(a["p"] * factor(k), lambda p: state(p, a["s"] + p, F.when((a["k"] < 0) & (a["s"] + p >= goal), k).otherwise(a["k"])))

                return one

            risen = F.aggregate(up, first, step(ratio))
            fallen = lambda a: F.aggregate(down, state(F.lit(1.0), a["s"], a["k"]), step(lambda k: 1 / ratio(k + 1)))
            return _bound(risen, fallen)

        none = F.lit(-1).cast("long")
        whole = walk(state(F.lit(1.0), F.lit(1.0), none), F.lit(float("inf")))["s"]
        found = lambda goal: walk(state(F.lit(1.0), F.lit(1.0), F.when(goal <= 1, mode).otherwise(none)), goal)["k"]
        return _bound(_bound(whole * chance, found), lambda k: F.when(k < 0, mode).otherwise(k))

    return _bound(F.least(high, F.greatest(low, middle)).cast("long"), around)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, place, from_block, blocks) from (place, blocks): an exact splitting tree.

    A node is one row with the sources' quotas; no shuffle is needed below the root.
    """
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("place", "blocks"))).alias("q"))
    nodes = nodes.select(F.lit(0).cast("long").alias("node"), F.transform("q", lambda x: F.struct(x["place"].alias("place"), F.lit(0).cast("long").alias("at"), x["blocks"].alias("n"))).alias("q"))
    depth = (shards - 1).bit_length()
    for level in range(depth):
        nodes = nodes.withColumn("total", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
        nodes = nodes.withColumn("draws", F.floor((F.col("total") + F.col("node") % 2) / 2).cast("long"))
        first = F.struct(F.col("total").alias("rest"), F.col("draws").alias("draws"), F.expr("CAST(array() AS array<bigint>)").alias("left"))

        def one(a: Column, x: Column) -> Column:
            rest = a["rest"] - x["n"]
            chance = (F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), x["place"]) / F.lit(2.0**63) + 1) / 2
            drawn = F.when(rest <= 0, F.least(a["draws"], x["n"])).otherwise(_hypergeometric(x["n"], rest, a["draws"], chance))
            return F.struct(rest.alias("rest"), (a["draws"] - drawn).alias("draws"), F.concat(a["left"], F.array(drawn)).alias("left"))

        # One state per source: the tuple of the last state is written out, not the expression twice.
        nodes = nodes.withColumn("left", _folded(F.col("q"), first, one))
        side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
        nodes = nodes.select("node", "q", "left", side)
        own = F.zip_with(
            "q", "left",
            lambda x, n: F.struct(
                x["place"].alias("place"),
                F.when(F.col("side") == 0, x["at"]).otherwise(x["at"] + n).alias("at"),
                F.when(F.col("side") == 0, n).otherwise(x["n"] - n).alias("n"),
            ),
        )
        nodes = nodes.select((F.col("node") * 2 + F.col("side")).alias("node"), own.alias("q"))
    rows = nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x"))
    return rows.select("shard", F.col("x.place").alias("place"), F.col("x.at").alias("from_block"), F.col("x.n").alias("blocks"))


def _folded(array: Column, first: Column, one) -> Column:
    return F.aggregate(array, first, one, lambda a: a["left"])


def _safe(df: DataFrame) -> DataFrame:
    """A join key for sources that keeps null apart from every text."""
    return df.withColumn("_s", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))


def shards_for(words: int) -> int:
    """Output shards of about SHARD_WORDS words, at least SHARDS, each of several blocks."""
    return min(max(SHARDS, words // SHARD_WORDS), BLOCKS // 4)


def draws(docs: DataFrame, shards: int | None = None, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, draws) of the mix of (doc_id, text, source).

    Documents: (row, doc_id, k2, size, source_size, target). Draws: (row, copy,
    words, shard), one for each time that words of a document are taken. Both
    come from one written table of sizes. ``k2`` is the column ``key``, or else
    the hash of the text.
    """
    name = F.xxhash64(F.coalesce("text", F.lit(""))) if key is None else F.col(key)
    sizes = sized(docs.select("doc_id", "source", "text", name.alias("k2"))).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "k2", "source", "size"
    )
    sizes = cut_lineage(sizes)
    goals = targets(sizes)
    rows, words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    joined = _safe(sizes).join(_safe(goals).drop("source"), "_s").drop("_s", "source")
    passes = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(CAP)).cast("int")
    order = F.xxhash64(F.lit(SEED), "doc_id", "k2")
    ran = _running(joined.withColumn("passes", passes), ["place"], order, "size", "before", max(PARTS, rows // ROWS_PER_PART))
    left = F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before")))
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(CAP)),
        lambda k: F.struct(
            k.alias("copy"),
            F.when(k < F.col("passes"), F.col("size")).when((k == F.col("passes")) & (F.col("passes") < CAP), F.col("rest")).otherwise(F.lit(0)).alias("words"),
        ),
    )
    # Blocks are cut from a source's permuted words; at most about BLOCKS in all, so quotas and their numbering stay small.
    block_words = max(MIN_BLOCK_WORDS, words * SHARE_PERCENT // 100 // BLOCKS)
    ran = cut_lineage(ran.withColumn("rest", rest).withColumn("block", F.floor(F.col("before") / F.lit(block_words)).cast("long")))
    drawn = ran.select("row", "place", "block", F.explode(F.filter(copies, lambda x: x["words"] > 0)).alias("x")).select("row", "place", "block", "x.*")
    blocks = drawn.groupBy("place", "copy", "block").agg(F.sum("words").alias("_w")).drop("_w")
    permuted = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(SEED), "copy", "block"), "copy", "block")
    numbered = cut_lineage(blocks.withColumn("n", F.row_number().over(permuted) - 1))
    quotas = numbered.groupBy("place").agg(F.count(F.lit(1)).alias("blocks"))
    tree = split_quotas(quotas, shards or shards_for(words * SHARE_PERCENT // 100)).where("blocks > 0")
    # One row for each block's place in the permuted order, so that blocks meet their shard by an equal key.
    places = F.explode(F.sequence(F.col("from_block"), F.col("from_block") + F.col("blocks") - 1)).alias("n")
    homes = numbered.join(tree.select("place", places, "shard"), ["place", "n"]).select("place", "copy", "block", "shard")
    placed = drawn.join(homes, ["place", "copy", "block"]).select("row", "copy", "words", "shard")
    return ran.select("row", "doc_id", "k2", "size", "source_size", "target"), placed


def mix(docs: DataFrame, shards: int | None = None, key: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, draws, k2) of every row; draws lists (copy, words, shard)."""
    rows, drawn = draws(docs, shards, key)
    per_row = drawn.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("copy", "words", "shard"))).alias("draws"))
    return rows.join(per_row, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "draws", "k2"
    )


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row; a map counts as its sorted entries."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    columns = [F.col(f"`{n}`") for n in docs.columns]
    return F.xxhash64(*[F.array_sort(F.map_entries(c)) if isinstance(kinds[n], T.MapType) else c for n, c in zip(docs.columns, columns)])


def materialise(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mixed rows with all columns of ``docs``, by shard and in a hash order inside each.

    A document comes once for each draw; a partial draw keeps its first words,
    joined by blanks, and n_chars, if present, is counted anew. Rows that agree
    in all columns are one row with the draws of all of them; rows with equal id
    and text but another source or further column keep their own columns.
    """
    names = docs.columns
    named = docs.select("doc_id", "text", "source", row_hash(docs).alias("_k2"))
    chosen = mix(named, shards, "_k2").where("taken > 0").select(
        F.coalesce("doc_id", F.lit(1 << 62)).alias("_k1"), F.col("k2").alias("_k2"), "size", F.explode("draws").alias("_d")
    )
    chosen = chosen.groupBy("_k1", "_k2").agg(F.max("size").alias("_size"), F.collect_list("_d").alias("_draws"))
    # The given columns travel as one struct, so their names meet none of those used here.
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(1 << 62)).alias("_k1"), row_hash(docs).alias("_k2"))
    rows = keyed.dropDuplicates(["_k1", "_k2"]).join(chosen, ["_k1", "_k2"]).select("_row", "_size", F.explode("_draws").alias("_d"))
    own = {n: F.col("_row").getField(n) for n in names}
    order = F.xxhash64(F.lit(SEED), own["doc_id"], "_d.copy")
    rows = rows.repartition("_d.shard").sortWithinPartitions("_d.shard", order, own["doc_id"], "_d.copy")
    some = F.array_join(F.slice(F.array_remove(F.split(own["text"], SPACE), ""), F.lit(1), F.col("_d.words").cast("int")), " ")
    own["text"] = F.when(F.col("_d.words") < F.col("_size"), some).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.length(own["text"]).cast("long")
    return rows.select(*[own[n].alias(n) for n in names])
