"""Model validation: preparation, linear models, gates and controls.

Linear models are fitted by Newton steps. Each step is one pass over the rows
for all models that are still open: tasks add up Gram matrices, gradients and
losses, Spark sums them by cell, and the driver solves systems as wide as the
feature list. Ridge regression is a single step. Rows with a null label take
no part; features must be prepared, hence without nulls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators import ranking
from talus.operators.prefix import dense_index_by_hash
from talus.operators.quantiles import grouped_quantiles
from talus.session import cut_lineage, literal_rows

# Acceptance bands, control tolerance, scan settings, seed.
AUROC_BAND, AUPRC_BAND = (0.82, 0.85), (0.35, 0.45)
AUROC_STOP = (0.80, 0.87)
CONTROL_TOLERANCE = 0.03
SCAN_MIN_ROWS, SCAN_TOP, SCAN_SUSPICIOUS = 500, 10, 0.80
MODEL_SEED = 20260726
CLINICAL_WINDOWS = ("W6", "W12", "W24")


def prepare(df: DataFrame, features: list[str], train: str = "split = 'train'") -> DataFrame:
    """Impute with training medians (0 where a column has none) and standardise
    with the training mean and population deviation."""
    clean = df.select(
        *[c for c in df.columns if c not in features],
        *[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features],
    )
    mids = grouped_quantiles(clean.filter(train), [], {f"_m_{f}": (f, 0.5) for f in features})
    filled = clean.crossJoin(F.broadcast(mids))  # one row of medians
    for f in features:
        filled = filled.withColumn(f, F.coalesce(F.col(f), F.col(f"_m_{f}"), F.lit(0.0)))
    filled = filled.drop(*[f"_m_{f}" for f in features])
    stats = filled.filter(train).agg(
        *[F.avg(f).alias(f"_a_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    )
    scaled = filled.crossJoin(F.broadcast(stats))  # one row of moments
    for f in features:
        spread = F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(F.lit(1.0))
        scaled = scaled.withColumn(f, (F.col(f) - F.col(f"_a_{f}")) / spread)
    return scaled.drop(*[f"_{p}_{f}" for f in features for p in "as"])


@dataclass
class Problem:
    """A linear model to fit: minimise penalty / 2 |w|^2 plus the weighted losses, the intercept free.

    ``weights`` are those of labels 0 and 1; None gives both classes half of all rows.
    """

    features: list[str]
    label: str = "y"
    kind: str = "logistic"
    penalty: float = 1.0
    weights: tuple[float, float] | None = (1.0, 1.0)


@dataclass
class LinearModel:
    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def margin(self) -> Column:
        total = F.lit(float(self.intercept))
        for feature, value in zip(self.features, self.coefficients):
            total = total + F.lit(float(value)) * F.col(feature)
        return total


def _moments(problems: dict[int, Problem], at: dict[int, np.ndarray]):
    """Sums of a task for each problem: Gram matrix, gradient and loss, cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            for k, problem in problems.items():
                y = get(problem.label)
                seen = ~np.isnan(y)
                y = y[seen]
                x = np.column_stack([*[get(f)[seen] for f in problem.features], np.ones(len(y))])
                z = x @ at[k]
                if problem.kind == "logistic":
                    weight = np.where(y == 1, problem.weights[1], problem.weights[0])
                    p = 0.5 * (1 + np.tanh(z / 2))
                    slope, bend = weight * (p - y), weight * p * (1 - p)
                    loss = (weight * (np.logaddexp(0, z) - y * z)).sum()
                else:
                    slope, bend, loss = z - y, np.ones(len(y)), ((z - y) ** 2).sum() / 2
                cells = np.concatenate([((x * bend[:, None]).T @ x).ravel(), x.T @ slope, [loss]])
                sums[k] = sums[k] + cells if k in sums else cells
        for k, cells in sums.items():
            n = len(cells)
            yield pa.RecordBatch.from_pydict(
                {"problem": pa.array([k] * n, pa.int32()), "cell": pa.array(range(n), pa.int32()), "value": pa.array(cells)}
            )

    return run


def fit_all(train: DataFrame, problems: dict[str, Problem], steps: int = 50, tolerance: float = 1e-10) -> dict[str, LinearModel]:
    """Fit several models on the same rows, which every step reads once; write them first.

    A step that raises the loss is halved. A problem ends when its next step is
    below ``tolerance`` relative to its coefficients, or after ``steps`` passes.
    """
    labels = sorted({p.label for p in problems.values()})
    inputs = sorted({f for p in problems.values() for f in p.features})
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in sorted({*labels, *inputs})])
    if any(p.weights is None for p in problems.values()):
        counted = [F.sum(F.when(F.col(c) == v, 1).otherwise(0)).alias(f"{c}_{v}") for c in labels for v in (0, 1)]
        sizes = rows.agg(*counted).first()
    ready: dict[int, Problem] = {}
    for k, problem in enumerate(problems.values()):
        weights = problem.weights
        if weights is None:
            n0, n1 = (sizes[f"{problem.label}_{v}"] or 0 for v in (0, 1))
            weights = ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)) if n0 and n1 else (1.0, 1.0)
        ready[k] = Problem(list(problem.features), problem.label, problem.kind, problem.penalty, weights)
    at = {k: np.zeros(len(p.features) + 1) for k, p in ready.items()}
    best = {k: (np.inf, at[k]) for k in ready}
    still_open = set(ready)
    for _ in range(steps):
        if not still_open:
            break
        now = {k: ready[k] for k in still_open}
        parts = rows.mapInArrow(_moments(now, {k: at[k] for k in now}), "problem int, cell int, value double")
        sums: dict[int, dict[int, float]] = {k: {} for k in now}
        for r in parts.groupBy("problem", "cell").agg(F.sum("value").alias("value")).collect():  # width^2 cells a problem
            sums[r["problem"]][r["cell"]] = r["value"]
        for k, problem in now.items():
            w, width = at[k], len(at[k])
            cells = np.array([sums[k].get(i, 0.0) for i in range(width * width + width + 1)])
            penalty = np.append(np.full(width - 1, float(problem.penalty)), 0.0)
            loss = cells[-1] + 0.5 * (penalty * w * w).sum()
            if loss > best[k][0] + 1e-12 * (1 + abs(best[k][0])):
                at[k] = (best[k][1] + w) / 2
                continue
            best[k] = (loss, w)
            gram = cells[: width * width].reshape(width, width) + np.diag(penalty)
            step = np.linalg.lstsq(gram, cells[width * width : -1] + penalty * w, rcond=None)[0]
            if np.abs(step).max() <= tolerance * (1 + np.abs(w).max()):
                still_open.discard(k)
            elif problem.kind == "ridge":
                best[k] = (-np.inf, w - step)  # quadratic: one step is exact
                still_open.discard(k)
            else:
                at[k] = w - step
    return {
        name: LinearModel(problem.features, best[k][1][:-1], float(best[k][1][-1]))
        for k, (name, problem) in enumerate(problems.items())
    }


def fit_logistic(train: DataFrame, features: list[str], y: str = "y", balanced: bool = False) -> LinearModel:
    """L2 logistic regression with C = 1 on prepared features."""
    return fit_all(train, {"one": Problem(features, y, weights=None if balanced else (1.0, 1.0))})["one"]


def score_logistic(model: LinearModel, df: DataFrame) -> DataFrame:
    """Probabilities to ten digits, so that no ranking hangs on the last bits of a fit."""
    return df.withColumn("score", _probability(model))


def _probability(model: LinearModel) -> Column:
    return F.round(1.0 / (1.0 + F.exp(-model.margin())), 10)


def evaluate(scored: DataFrame, y: str = "y") -> DataFrame:
    """One row: AUROC, average precision, Brier score, prevalence."""
    area = ranking.auroc(scored, "score", y)
    return (
        area.crossJoin(ranking.average_precision(scored, "score", y))
        .crossJoin(ranking.brier(scored, "score", y))  # one row each
    )


def gate(metrics: DataFrame, window: str = "W24") -> DataFrame:
    """Pre-registered acceptance: pass, stop or marginal."""
    if window not in CLINICAL_WINDOWS:
        raise ValueError(f"{window} is a performance window; model metrics need one of {CLINICAL_WINDOWS}")
    in_roc, in_prc = F.col("auroc").between(*AUROC_BAND), F.col("auprc").between(*AUPRC_BAND)
    verdict = (
        F.when(~F.col("auroc").between(*AUROC_STOP), "stop").when(in_roc & in_prc, "pass").otherwise("marginal")
    )
    return metrics.withColumn("verdict", verdict)


def coefficients(spark, features: list[str], values: list[float]) -> DataFrame:
    """Coefficients by magnitude; as many rows as features."""
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return literal_rows(spark, rows, "feature string, coef double").withColumn("abs_coef", F.abs("coef")).orderBy(
        F.desc("abs_coef")
    )


def fit_ridge(train: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> LinearModel:
    """Ridge regression by its normal equations."""
    return fit_all(train, {"one": Problem(features, target, "ridge", alpha)})["one"]


def score_ridge(model: LinearModel, df: DataFrame) -> DataFrame:
    return df.withColumn("pred", model.margin())


def regression_report(scored: DataFrame, target: str, survivor: str) -> DataFrame:
    """MAE in original units and R^2 on the log scale, overall and survivors."""
    groups = F.explode(F.when(F.col(survivor) == 1, F.array(F.lit("all"), F.lit("survivors"))).otherwise(F.array(F.lit("all"))))
    rows = scored.withColumn("group", groups)
    gap = F.abs(F.expm1(F.col(target)) - F.expm1(F.col("pred")))
    err = F.col(target) - F.col("pred")
    return rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(gap).alias("mae"),
        (1.0 - F.sum(err * err) / F.nullif(F.var_pop(target) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
    )


def ablation(prepared: DataFrame, subsets: dict[str, list[str]], y: str = "y") -> DataFrame:
    """Refit on feature subsets and report validation metrics per subset; all are fitted, and all ranked, in the same passes."""
    train, held = prepared.filter("split = 'train'"), prepared.filter("split <> 'train'")
    models = fit_all(train, {name: Problem(features, y) for name, features in subsets.items()})
    scores = [F.struct(F.lit(name).alias("subset"), _probability(model).alias("score")) for name, model in models.items()]
    scored = held.select(y, F.explode(F.array(*scores)).alias("_s")).select(y, "_s.*")
    rows = [(name, len(features)) for name, features in subsets.items()]
    listed = literal_rows(prepared.sparkSession, rows, "subset string, n_features int")
    area, precision = ranking.auroc(scored, "score", y, ["subset"]), ranking.average_precision(scored, "score", y, ["subset"])
    return listed.join(area, "subset", "left").join(precision, "subset", "left").select("subset", "n_features", "auroc", "auprc")


def shuffle_labels(train: DataFrame, key: str, y: str, seed: int) -> DataFrame:
    """Training rows with the labels dealt out in a random order.

    Both sides get dense hash-ordered indexes, so the permutation needs no
    global sort in one task.
    """
    to = dense_index_by_hash(train.drop(y), key, seed, "_i")
    labels = dense_index_by_hash(train.select(key, y), key, seed + 1, "_i").select("_i", y)
    return to.join(labels, "_i").drop("_i")


def negative_control(prepared: DataFrame, features: list[str], key: str, y: str = "y", draws: int = 5) -> DataFrame:
    """Models trained on shuffled labels must not rank held-out rows."""
    train, held = prepared.filter("split = 'train'"), prepared.filter("split <> 'train'")
    drawn = train.select(key, *features)
    for i in range(draws):
        labels = shuffle_labels(train.select(key, y), key, y, MODEL_SEED + 10 * i)
        drawn = drawn.join(labels.select(key, F.col(y).alias(f"_y{i}")), key)
    models = fit_all(cut_lineage(drawn), {str(i): Problem(features, f"_y{i}") for i in range(draws)})
    out = None
    for i in range(draws):
        row = ranking.auroc(score_logistic(models[str(i)], held), "score", y).select(F.lit(i).alias("draw"), "auroc")
        out = row if out is None else out.unionByName(row)
    return out


def control_verdict(control: DataFrame) -> DataFrame:
    mean = F.avg("auroc")
    return control.agg(mean.alias("mean_auroc"), (F.abs(mean - 0.5) < CONTROL_TOLERANCE).alias("ok"))


def single_feature_scan(
    df: DataFrame, features: list[str], y: str = "y", min_rows: int = SCAN_MIN_ROWS, top: int = SCAN_TOP
) -> DataFrame:
    """Strongest single features by direction-free AUROC (top-k report)."""
    long = df.select(y, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([y], features, "feature", "value")
    present = long.filter("value IS NOT NULL AND NOT isnan(value)")
    areas = ranking.auroc(present, "value", y, ["feature"])
    strength = F.greatest(F.col("auroc"), 1.0 - F.col("auroc"))
    return (
        areas.filter((F.col("n_pos") + F.col("n_neg") >= min_rows) & F.col("auroc").isNotNull())
        .select("feature", strength.alias("strength"), (strength > SCAN_SUSPICIOUS).alias("suspicious"))
        .orderBy(F.desc("strength"), "feature")
        .limit(top)
    )
