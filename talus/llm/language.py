"""Language identification: known words first, shorter and shorter character n-grams for the rest.

Words are runs of letters (a-z after lower-casing, and every character beyond
ASCII). A word seen in training adds its log frequency in each language. Any
other word adds the mean log frequency of its seen character n-grams of the
largest n, from ``MAX_GRAM`` down to 1, at which it has one. Languages start
from their share of the training documents. The ``WORDS`` words, and ``GRAMS``
n-grams of each size, with the largest share in any one language are broadcast;
counts of all others come by joins, so the bounds don't change results.

Null text, and text without a letter, is ``und`` with score 0. Rows without a
language, and rows with a null id (they have no fold), are not learned from;
without anything learned all rows are ``und``. Repeated rows are kept, further
columns ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.frequent import most_frequent
from talus.llm.text import by_slices, fold, ragged_ranges, span_hashes
from talus.session import cut_lineage

WORDS = 1 << 16
GRAMS = 1 << 16
MAX_GRAM = 4
SMOOTHING = 0.5
COUNT_BYTES = 2 << 20


@dataclass
class Letters:
    """Code points of several texts end to end, and the letter runs in them."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def letter_runs(column: pa.Array) -> Letters:
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    sizes = pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = "".join(lowered.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    inside = (points >= 128) | ((points >= 97) & (points <= 122))
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(points))]
    begin[cuts] = inside[cuts]
    finish[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Letters(points, start, end, np.searchsorted(offsets, start, "right") - 1)


def _count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    lang = batch.column("lang").dictionary_encode()
    codes = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = letter_runs(batch.column("text"))
    hashes = span_hashes(runs.points, runs.start, runs.end) if len(runs.start) else np.zeros(0, np.uint64)
    keys = hashes ^ (codes[runs.doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, n = np.unique(keys, return_index=True, return_counts=True)
    points = runs.points
    words = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(runs.start[at], runs.end[at])]
    return pa.RecordBatch.from_pydict(
        {
            "lang": lang.dictionary.take(pa.array(codes[runs.doc[at]])),
            "key": pa.array(hashes[at].view(np.int64)),
            "word": pa.array(words, pa.string()),
            "n": pa.array(n, pa.int64()),
        }
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, word, n) over all rows of (text, lang)."""
    schema = "lang string, key long, word string, n long"
    parts = docs.select("text", "lang").mapInArrow(by_slices(_count_words, "text", COUNT_BYTES), schema)
    return parts.groupBy("lang", "key").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def _count_grams(batches):
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        codes = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        weight = batch.column("n").to_numpy(zero_copy_only=False)
        runs = letter_runs(batch.column("word"))
        for size in range(1, MAX_GRAM + 1):
            grams, owner = gram_hashes(runs, np.arange(len(runs.start)), size)
            keys = grams ^ (codes[runs.doc[owner]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weight[runs.doc[owner]], len(at)).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": lang.dictionary.take(pa.array(codes[runs.doc[owner[at]]])),
                    "size": pa.array(np.full(len(at), size, np.int32)),
                    "gram": pa.array(grams[at].view(np.int64)),
                    "n": pa.array(n),
                }
            )


def gram_hashes(runs: Letters, chosen: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the chosen words, and the word each belongs to."""
    n = np.maximum(runs.end[chosen] - runs.start[chosen] - size + 1, 0)
    at = ragged_ranges(runs.start[chosen], n)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return span_hashes(runs.points, at, at + size), np.repeat(chosen, n)


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]  # of words, then of n-grams of 1, 2 ... letters: sorted hashes, log frequencies


@dataclass
class Seen:
    """Beside the model: log frequencies of all seen words and n-grams, and the unseen words."""

    words: DataFrame  # key, w0, w1 ...
    grams: DataFrame  # size, gram, w0, w1 ...
    unseen: DataFrame  # key, word


OTHER = "-"


def _numbered(langs: int, letter: str) -> list[str]:
    return [f"{letter}{k}" for k in range(langs)]


def _by_language(counts: DataFrame, keys: list[str], langs: list[str], *more) -> DataFrame:
    """One row a key with the counts n0, n1 ... of the languages."""
    sums = [F.sum(F.when(F.col("lang") == "=" + lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(langs)]
    return counts.groupBy(*keys).agg(*more, *sums)


def _frequencies(counts: DataFrame, key: str, langs: int, limit: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """(log frequencies of all keys, table of those with the largest share in a language)."""
    n, w = _numbered(langs, "n"), _numbered(langs, "w")
    row = counts.agg(F.count(F.lit(1)).alias("types"), *[F.sum(c).alias(c) for c in n]).first()
    totals = [float(row[c] or 0) for c in n]
    logs = [F.log((F.col(c) + F.lit(SMOOTHING)) / F.lit(t + SMOOTHING * max(row["types"], 1))).alias(x) for c, t, x in zip(n, totals, w)]
    share = F.array_max(F.array(*[F.col(c) / F.lit(max(t, 1.0)) for c, t in zip(n, totals)]))
    top = most_frequent(counts.withColumn("share", share), "share", limit).select(key, *logs).toPandas()
    order = np.argsort(top[key].to_numpy(np.int64).view(np.uint64))
    known = top[key].to_numpy(np.int64).view(np.uint64)[order]
    return counts.select(key, *logs), (known, top[w].to_numpy(float)[order])


def fit(docs: DataFrame) -> tuple[Model, Seen | None]:
    """Fit on the learned rows of (text, lang, learned); languages are the label values, a small closed set.

    What reaches the driver is bounded by WORDS, GRAMS and the languages.
    """
    labelled = docs.where("learned AND lang IS NOT NULL AND text IS NOT NULL")
    shares = sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    langs = [lang for lang, _ in shares]
    if not langs:
        return Model([], np.zeros(0), []), None
    prior = np.log(np.array([n for _, n in shares]) / sum(n for _, n in shares))
    mark = F.when(F.col("learned") & F.col("lang").isNotNull(), F.concat(F.lit("="), "lang")).otherwise(F.lit(OTHER))
    counts = cut_lineage(word_counts(docs.select("text", mark.alias("lang"))))
    wide = cut_lineage(_by_language(counts, ["key"], langs, F.min("word").alias("word")))
    seen = F.greatest(*[F.col(c) for c in _numbered(len(langs), "n")], F.lit(0)) > 0
    words, table = _frequencies(wide.where(seen), "key", len(langs), WORDS)
    schema = "lang string, size int, gram long, n long"
    learned = counts.where(F.col("lang") != OTHER).select("lang", "word", "n")
    grams = cut_lineage(_by_language(learned.mapInArrow(_count_grams, schema), ["size", "gram"], langs))
    tables, every = [table], None
    for size in range(1, MAX_GRAM + 1):
        own, table = _frequencies(grams.where(F.col("size") == size), "gram", len(langs), GRAMS)
        own = own.withColumn("size", F.lit(size))
        every = own if every is None else every.unionByName(own)
        tables.append(table)
    return Model(langs, prior, tables), Seen(words, every, wide.where(~seen).select("key", "word"))


def learn(docs: DataFrame) -> Model:
    """The model of (text, lang) rows."""
    return fit(docs.select("text", "lang", F.lit(True).alias("learned")))[0]


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = table[0]
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def posteriors(model: Model, column: pa.Array) -> np.ndarray:
    """Probability of each language for each text, by the tables of the model alone."""
    langs = len(model.langs)
    totals = np.tile(model.prior, (len(column), 1))
    runs = letter_runs(column)
    if len(runs.start):
        hashes = span_hashes(runs.points, runs.start, runs.end)
        _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        weight = np.zeros((len(at), langs))
        hit, row = _look_up(model.tables[0], hashes[at])
        weight[hit] = model.tables[0][1][row[hit]]
        open_words = np.flatnonzero(~hit)
        for size in range(MAX_GRAM, 0, -1):
            grams, owner = gram_hashes(runs, at[open_words], size)
            place = np.repeat(open_words, np.maximum(runs.end[at[open_words]] - runs.start[at[open_words]] - size + 1, 0))
            hit, row = _look_up(model.tables[size], grams)
            place, row = place[hit], row[hit]
            found = np.bincount(place, minlength=len(at))
            for k in range(langs):
                mean = np.bincount(place, model.tables[size][1][row, k], len(at)) / np.maximum(found, 1)
                weight[found > 0, k] = mean[found > 0]
            open_words = open_words[found[open_words] == 0]
        for k in range(langs):
            totals[:, k] += np.bincount(runs.doc, weight[inverse, k], len(column))
    odds = np.exp(totals - totals.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _open_grams(shared):
    """Sums over n-grams in the tables, and the other n-grams, of each word at each size it may be settled at."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model: Model = shared.value
        key = batch.column("key").to_numpy()
        runs = letter_runs(batch.column("word"))
        left, out = np.arange(len(key)), []  # a word is one run
        for size in range(MAX_GRAM, 0, -1):
            grams, owner = gram_hashes(runs, left, size)
            hit, row = _look_up(model.tables[size], grams)
            found = np.bincount(owner[hit], minlength=len(key))
            some = np.flatnonzero(found)
            sums = [np.bincount(owner[hit], model.tables[size][1][row[hit], k], len(key))[some] for k in range(len(model.langs))]
            out.append(
                pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(np.concatenate([key[some], key[owner[~hit]]])),
                        "size": pa.array(np.full(len(some) + int((~hit).sum()), size, np.int32)),
                        "gram": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(grams[~hit].view(np.int64))]),
                        "found": pa.array(np.concatenate([found[some], np.ones(int((~hit).sum()), np.int64)])),
                        **{
                            f"w{k}": pa.concat_arrays([pa.array(x, pa.float64()), pa.nulls(int((~hit).sum()), pa.float64())])
                            for k, x in enumerate(sums)
                        },
                    }
                )
            )
            left = left[found[left] == 0]
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(map(len, out)) else out[0]

    return one


def word_weights(model: Model, seen: Seen, shared) -> DataFrame:
    """(key, w0, w1 ...) of every seen word, and of unseen words with a seen n-gram."""
    w = _numbered(len(model.langs), "w")
    schema = "key long, size int, gram long, found long, " + ", ".join(f"{c} double" for c in w)
    parts = cut_lineage(seen.unseen.mapInArrow(by_slices(_open_grams(shared), "word"), schema))
    rare = parts.where("gram IS NOT NULL").select("key", "size", "gram", "found").join(seen.grams, ["size", "gram"])
    whole = parts.where("gram IS NULL").select("key", "size", "found", *w).unionByName(rare.select("key", "size", "found", *w))
    sums = whole.groupBy("key", "size").agg(F.sum("found").alias("found"), *[F.sum(c).alias(c) for c in w])
    means = F.struct(*[(F.col(c) / F.col("found")).alias(c) for c in w])
    best = sums.groupBy("key").agg(F.max_by(means, "size").alias("m")).select("key", "m.*")
    return seen.words.select("key", *w).unionByName(best)


def _summed(shared):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model: Model = shared.value
        docs, langs = batch.num_rows, len(model.langs)
        runs = letter_runs(batch.column("text"))
        hashes = span_hashes(runs.points, runs.start, runs.end) if len(runs.start) else np.zeros(0, np.uint64)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        hit, at = _look_up(model.tables[0], distinct)
        # Words outside the table are counted per document; their weights come by join.
        cells, times = np.unique(runs.doc[~hit[inverse]] * max(len(distinct), 1) + inverse[~hit[inverse]], return_counts=True)
        owner, word = cells // max(len(distinct), 1), cells % max(len(distinct), 1)
        row = batch.column("row").to_numpy()
        spread = span_hashes(row.view(np.uint8), np.arange(docs) * 8, np.arange(docs) * 8 + 8)
        weight = np.zeros((len(distinct), langs))
        weight[hit] = model.tables[0][1][at[hit]] if hit.any() else 0
        head = [np.bincount(runs.doc, weight[inverse, k], docs) + model.prior[k] for k in range(langs)]
        none = lambda kind: pa.nulls(len(cells), kind)
        return pa.RecordBatch.from_pydict(
            {
                "row": pa.array(np.concatenate([row, row[owner]])),
                "doc_id": pa.concat_arrays([batch.column("doc_id"), none(pa.int64())]),
                "held_out": pa.concat_arrays([batch.column("held_out"), none(pa.bool_())]),
                "letters": pa.concat_arrays([batch.column("letters"), none(pa.bool_())]),
                "key": pa.array(np.concatenate([spread, distinct[word]]).view(np.int64)),
                "times": pa.array(np.concatenate([np.zeros(docs, np.int64), times])),
                **{f"h{k}": pa.concat_arrays([pa.array(x), none(pa.float64())]) for k, x in enumerate(head)},
            }
        )

    return one


def predict(docs: DataFrame, model: Model, seen: Seen | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of (doc_id, held_out, text)."""
    if seen is None:
        return docs.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS, GRAMS and the languages
    h, w = _numbered(len(model.langs), "h"), _numbered(len(model.langs), "w")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", letters.alias("letters"), "text")
    schema = "row long, doc_id long, held_out boolean, letters boolean, key long, times long, " + ", ".join(f"{c} double" for c in h)
    parts = rows.mapInArrow(by_slices(_summed(shared)), schema)
    joined = parts.join(word_weights(model, seen, shared), "key", "left")
    total = [F.sum(F.coalesce(a, F.lit(0.0)) + F.col("times") * F.coalesce(b, F.lit(0.0))) for a, b in zip(h, w)]
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("letters").alias("letters"),
        F.array(*[F.round(t, 9) for t in total]).alias("t"),
    )
    best = F.array_max("t")
    odds = F.aggregate("t", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    name = F.element_at(F.array(*[F.lit(lang) for lang in model.langs]), F.array_position("t", best).cast("int"))
    return summed.select(
        "doc_id", "held_out", F.when(F.col("letters"), name).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(F.col("letters"), F.lit(1.0) / odds).otherwise(F.lit(0.0)).alias("score"),
    )


def identify(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """Learn outside the held-out fold of ``docs``, then predict every row."""
    part = fold("doc_id", mod)
    model, seen = fit(docs.select("text", "lang", F.coalesce(part != held, F.lit(False)).alias("learned")))
    return predict(docs.select("doc_id", "text", F.coalesce(part == held, F.lit(False)).alias("held_out")), model, seen)
