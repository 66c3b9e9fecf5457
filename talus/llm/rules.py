"""Quality rules: decision lists learned by sequential covering, as Spark conditional expressions.

Statistics of every text come from built-in functions. From the labelled rows a
list of conjunctions of thresholds is learned: a rule grows on two thirds of
the rows by the condition of the largest information gain, is pruned on the
last third while that raises its precision, and is kept if it is precise
enough there; the rows it covers are then set aside and the next rule is
learned. Each step is one aggregation over counts per statistic and threshold
bin, so only bin counts reach the driver. The list becomes one ordered
``CASE WHEN``: the first rule that holds decides.

Null text has no words and all statistics 0. Rows without a label or id are not
learned from; repeated labels of an id are averaged. Without labels the list is
empty and keeps all that the base rules keep. Further columns are ignored,
repeated rows kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SPACE_SIGNS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BINS = 64
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_COVERED = 4
MIN_PRECISION = 0.8
GOOD_PRECISION = 0.9995

#: Ratios that the conditions look at, from the counts of text_statistics.
RATIOS = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _without(text: str, signs: str) -> Column:
    """Code points of a text left when some signs are taken out."""
    return F.length(F.translate(text, signs, ""))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words and the other counts."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != text]
    names = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(*own, body.alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACE_SIGNS, "")) > 0)
    parts = base.select(*own, "_t", F.array_remove(F.split("_t", SPACE), "").alias("_w"), lines.alias("_l"))
    n = F.size("_w")
    # Hash and place of each three-word window; equal hashes stand together after sorting.
    windows = F.when(
        n >= 3,
        F.transform(
            F.arrays_zip(F.slice("_w", F.lit(1), n - 2).alias("a"), F.slice("_w", F.lit(2), n - 2).alias("b"), F.slice("_w", F.lit(3), n - 2).alias("c")),
            lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("p")),
        ),
    ).otherwise(F.expr("CAST(array() AS array<struct<h: bigint, p: int>>)"))
    counted = parts.select(
        *own,
        n.cast("long").alias("n_words"),
        _without("_t", SPACE_SIGNS).cast("long").alias("word_chars"),
        (F.length("_t") - _without("_t", SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_t") - _without("_t", UPPER)).cast("long").alias("n_upper"),
        (F.length("_t") - _without("_t", "!?|")).cast("long").alias("n_marks"),
        (F.length("_t") - _without("_t", "0123456789")).cast("long").alias("n_digits"),
        F.sort_array(windows).alias("_s"),
    )
    m = F.size("_s")
    twice = F.filter(
        "_s",
        lambda x, i: ((i > 0) & (F.get("_s", i - 1)["h"] == x["h"])) | ((i + 1 < m) & (F.get("_s", i + 1)["h"] == x["h"])),
    )
    places = counted.select("*", F.sort_array(F.transform(twice, lambda x: x["p"])).alias("_p"), m.alias("_m"))
    # Each window adds the words that the window before it doesn't cover.
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_marks", "n_digits"]
    return places.select(*[F.col(f"`{c}`") for c in names], *counts, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        ratio = F.expr(RATIOS[self.name]).cast("double")
        return ratio > F.lit(self.threshold) if self.above else ratio <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """True to keep: every rule rejects, what none covers stays."""
    if not rules:
        return F.lit(True)
    out = F.when(holds(rules[0]), F.lit(False))
    for rule in rules[1:]:
        out = out.when(holds(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """At most BINS cut points of each ratio: quantiles of all rows and of the bad ones."""
    shares = [i / (BINS // 2) for i in range(BINS // 2)]
    quantiles = lambda e: F.percentile_approx(e, shares, 10_000)
    found = rows.agg(
        *[quantiles(F.col(f"r_{n}")).alias(f"a_{n}") for n in RATIOS],
        *[quantiles(F.when(F.col("bad"), F.col(f"r_{n}"))).alias(f"b_{n}") for n in RATIOS],
    ).first()
    return {n: sorted({float(v) for v in (*(found[f"a_{n}"] or []), *(found[f"b_{n}"] or []))}) for n in RATIOS}


def _below(cuts: list[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < value))


def _bin_counts(rows: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
    """(bin, bad rows, good rows) of every ratio among ``rows``."""
    pairs = ", ".join(f"'{n}', b_{n}" for n in RATIOS)
    long = rows.select("bad", F.expr(f"stack({len(RATIOS)}, {pairs}) AS (name, bin)"))
    counts = long.groupBy("name", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    out: dict[str, list[tuple[int, int, int]]] = {n: [] for n in RATIOS}
    for r in counts:
        out[r["name"]].append((r["bin"], r["p"], r["n"]))
    return {n: sorted(v) for n, v in out.items()}


def _best_condition(counts: dict, cuts: dict[str, list[float]]) -> tuple[Condition, int, int] | None:
    """The condition that gains most information about bad rows."""
    best = None
    for name, bins in counts.items():
        p_all, n_all = sum(b[1] for b in bins), sum(b[2] for b in bins)
        if not p_all:
            return None
        before = log2(p_all / (p_all + n_all))
        p_low = n_low = 0
        for k, p, n in bins:
            p_low, n_low = p_low + p, n_low + n
            if k >= len(cuts[name]):
                continue
            for above, a, b in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                if a >= MIN_COVERED and a + b < p_all + n_all:
                    gain = a * (log2(a / (a + b)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(name, above, cuts[name][k]), a, b)
    return best[1:] if best else None


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for rejection, from rows of statistics with ``doc_id`` and ``quality`` (1 good, 0 bad)."""
    ratios = [F.expr(e).cast("double").alias(f"r_{n}") for n, e in RATIOS.items()]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_marks", "n_digits", "n_repeat_words"]
    rows = labelled.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(
        *counts, (F.col("quality") < 0.5).alias("bad"), (F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(3)) < 2).alias("grows"), *ratios
    )
    rows = cut_lineage(rows)
    cuts = _thresholds(rows)
    # The bin of a value is the number of cut points below it: value <= cuts[bin].
    bins = [_below(cuts[n], F.col(f"r_{n}")).alias(f"b_{n}") for n in RATIOS]
    rows = cut_lineage(rows.select(*counts, "bad", "grows", *bins))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        open_rows = rows.where(verdict(rules))
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            found = _best_condition(_bin_counts(open_rows.where(F.col("grows") & holds(rule))), cuts)
            if found is None:
                break
            condition, bad, good = found
            rule = (*rule, condition)
            if bad >= GOOD_PRECISION * (bad + good):
                break
        if not rule:
            break
        rule, precision, covered = _pruned(open_rows.where("NOT grows"), rule)
        if covered < MIN_COVERED // 2 or precision < MIN_PRECISION:
            break
        rules.append(rule)
    return rules


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, float, int]:
    """The prefix of a rule that is most precise on held-back rows, the shortest of equals."""
    prefixes = [rule[: k + 1] for k in range(len(rule))]
    counts = rows.agg(
        *[F.count_if(holds(r) & F.col("bad")).alias(f"p{k}") for k, r in enumerate(prefixes)],
        *[F.count_if(holds(r)).alias(f"t{k}") for k, r in enumerate(prefixes)],
    ).first()
    scored = [((counts[f"p{k}"] + 1) / (counts[f"t{k}"] + 2), -k) for k in range(len(prefixes))]
    _, k = max(scored)
    k = -k
    total = counts[f"t{k}"]
    return prefixes[k], counts[f"p{k}"] / total if total else 0.0, total


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(statistics of all rows with base_failed and kept, the learned rules).

    The statistics are written once; learning and judging read them.
    """
    stats = cut_lineage(text_statistics(docs))
    taught = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    names = [c for c in stats.columns if c != "quality"]
    rules = learn(stats.select(*names).join(taught, "doc_id"))
    failed = base_failed()
    judged = stats.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules)})
    return judged, rules


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every document with its counts."""
    judged, _ = judge(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
