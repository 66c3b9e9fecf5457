"""URL verdicts: host and path rules first, then logistic regression on character n-grams.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; the path goes on to ``?``, ``#`` or the end. A rule
(host, path, verdict) fits its host and all subdomains if the path starts with
the rule's. Of the rules that fit, the one with the longest text wins; of
equally long ones that with the longer host, then a block.

All other URLs are scored by a logistic regression on hashed n-grams of 3 to 5
characters, those of the host (with its ends marked) and those of the path
apart. It is trained on the driver from a small table of labelled URLs; by
default one drawn by a fixed rule from the word lists below. Only the url column
is read; the model is ``ROWS`` numbers at any size.

A null url, or one without ``://``, has an empty host and path and is judged by
the model's intercept. Rows are kept as they are, repeated ones too; further
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.text import by_slices, ragged_ranges, span_hashes, text_bytes

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ROWS = 1 << 16
SIZES = (3, 4, 5)
CUTOFF = 0.5
STEPS = 300
RATE = 4.0
DECAY = 1e-4
SLICE_BYTES = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of the training URLs.
BLOCKED = (
    "casino poker roulette jackpot slots betting bets lottery winner win prize pills pharma viagra cialis meds dose "
    "cheap discount replica loans payday credit cash bonus free adult xxx porn sex escort dating cams nude "
    "spam ads adserver banner popup tracker track click clicks affiliate farm malware phishing warez torrent crack keygen"
).split()
ALLOWED = (
    "news wiki library museum school college archive history science nature garden kitchen recipe travel city council "
    "weather sports music theatre cinema books paper journal health clinic hospital market shop store bank energy water "
    "forum docs help support project software data maps photo gallery family house street river mountain forest studio"
).split()
SYLLABLES = "ta ri mo ne lu sa ko ti re ben dor vel ing ster nor hal wick ber tho son the and ion ble est".split()
TOPS = "com net org io example.com example.net example.org info co.uk de fr".split()
FOLDERS = "en de fr es about blog item page archive products 2023 topic".split()


def address(url: str) -> tuple[Column, Column]:
    """(host, path) of a url column."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_text(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits.

    The list is a parameter; it becomes one ordered conditional, tried from the longest rule down.
    """
    name = verdict = None
    for own, start, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block")):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name = F.when(fits, own + start) if name is None else name.when(fits, own + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (name, verdict) if rules else (F.lit(None).cast("string"),) * 2


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, first): distinct hashed n-grams of each row; row i owns slots[first[i]:first[i+1]]."""
    n = len(host)
    slots, row = [], []
    for part, (column, mark) in enumerate(((host, b"^$"), (path, b""))):
        data, offsets = text_bytes(column)
        sizes = np.diff(offsets)
        if mark:  # hosts are framed, so that their ends count
            framed = np.zeros(len(data) + 2 * n, np.uint8)
            at = offsets[:-1] + 2 * np.arange(n)
            framed[at], framed[at + sizes + 1] = mark
            framed[ragged_ranges(at + 1, sizes)] = data
            data, offsets, sizes = framed, np.append(at, len(framed)), sizes + 2
        for size in SIZES:
            counts = np.maximum(sizes - size + 1, 0)
            start = ragged_ranges(offsets[:-1], counts)
            slots.append((span_hashes(data, start, start + size) + np.uint64(part)) % np.uint64(ROWS))
            row.append(np.repeat(np.arange(n), counts))
    keys = np.unique(np.concatenate(row) * ROWS + np.concatenate(slots).astype(np.int64))
    return keys % ROWS, np.searchsorted(keys, np.arange(n + 1) * ROWS)


def margins(slots: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Intercept (the last weight) plus the weights of a row's n-grams over the root of their number."""
    counts = np.diff(first)
    sums = np.bincount(np.repeat(np.arange(len(counts)), counts), weights[slots], len(counts))
    return weights[-1] + sums / np.sqrt(np.maximum(counts, 1))


def training_urls(seed: int = 13, copies: int = 12) -> list[tuple[str, str, int]]:
    """(host, path, label): a labelled table drawn from the word lists, 1 for block.

    A blocked host holds a blocked word alone, with a number, or next to another
    word; allowed hosts hold allowed words or made-up names. Paths are alike in
    both, so that they decide only where they name a blocked word themselves.
    """
    rng = np.random.default_rng(seed)
    pick = lambda words: words[int(rng.integers(len(words)))]
    made = lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(2, 5))))
    front = lambda: pick(("", "", "www.", "m.", "blog.", "shop."))
    tail = lambda: f"/{pick(FOLDERS)}/{int(rng.integers(1, 9999))}" + pick(("", "/", ".html"))
    rows = []
    for label, words in ((1, BLOCKED), (0, ALLOWED)):
        for word in words * copies:
            other = pick((*words, made(), str(int(rng.integers(10, 999)))))
            name = pick((word, f"{word}-{other}", f"{other}-{word}", f"{word}{other}"))
            rows.append((f"{front()}{name}.{pick(TOPS)}", tail(), label))
        for word in words:
            rows.append((f"{front()}{made()}.{pick(TOPS)}", f"/{word}{tail()}", label))
    rows += [(f"{front()}{made()}.{pick(TOPS)}", tail(), 0) for _ in range(2 * copies * len(BLOCKED))]
    return rows


def train(rows: list[tuple[str, str, int]]) -> np.ndarray:
    """ROWS weights and an intercept, by gradient steps with momentum over all rows of a small table."""
    weights = np.zeros(ROWS + 1)
    if not rows:
        return weights
    host, path, label = zip(*rows)
    slots, first = features(pa.array(host, pa.string()), pa.array(path, pa.string()))
    counts = np.diff(first)
    share = np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)
    row, wanted = np.repeat(np.arange(len(rows)), counts), np.array(label, float)
    speed = np.zeros_like(weights)
    for _ in range(STEPS):
        gap = 1 / (1 + np.exp(-margins(slots, first, weights))) - wanted
        slope = np.append(np.bincount(slots, gap[row] * share, ROWS), gap.sum()) / len(rows) + DECAY * weights
        speed = 0.9 * speed - RATE * slope
        weights = weights + speed
    return weights


def judge(pages: DataFrame, rules=RULES, labelled: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the model's probability of a block, for every row."""
    weights = train(training_urls() if labelled is None else labelled)
    host, path = address("url")
    parts = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    name, verdict = rule_text(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, first = features(batch.column("host"), batch.column("path"))
        score = 1 / (1 + np.exp(-margins(slots, first, weights)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    scored = ruled.mapInArrow(by_slices(one, "path", SLICE_BYTES), "page_id long, host string, path string, rule string, verdict string, score double")
    model = F.when(F.col("score") >= CUTOFF, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", model))
