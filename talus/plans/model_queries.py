"""Model validation on labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions.scalars import hash_bucket, split_of
from talus.operators import models as mo
from talus.operators import ranking as ra
from talus.plans.adapters import oracle_prefix, relation, table
from talus.plans.registry import query
from talus.session import cut_lineage

FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share", "punct_share"]
SEED = mo.MODEL_SEED


def scores(spark, d):
    return relation(spark, d, "scores")


def doc_features(spark, d):
    """Text statistics of every labelled document, over the whole text."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.col("n_chars").cast("double")

    def share(pattern: str):
        kept = F.length(F.regexp_replace("text", pattern, ""))
        return F.when(kept > 0, kept / n)

    bucket = hash_bucket(F.col("doc_id"))
    return docs.select(
        "doc_id",
        F.col("source").alias("subject"),
        F.col("quality").alias("y"),
        "toxic",
        split_of(bucket).alias("split"),
        n.alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        share("[^0-9]").alias("digit_share"),
        share("[^A-Z]").alias("upper_share"),
        share("[^.,;:!?]").alias("punct_share"),
    )


_FEATURE_SQL = """WITH raw AS (
  SELECT documents.doc_id, source AS subject, quality AS y, toxic, n_chars::DOUBLE AS n_chars, text,
    CAST(CAST(concat('0x', substr(sha256(concat('mimiciv-3.1-loadimbalance-v1|', CAST(documents.doc_id AS VARCHAR))), 1, 16)) AS UBIGINT) % 100 AS INT) AS b
  FROM documents JOIN labels ON labels.doc_id = documents.doc_id),
feats AS (
  SELECT doc_id, subject, y, toxic, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split, n_chars,
    (length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS n_words,
    (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS n_lines,
    nullif(length(regexp_replace(text, '[^0-9]', '', 'g')), 0) / n_chars AS digit_share,
    nullif(length(regexp_replace(text, '[^A-Z]', '', 'g')), 0) / n_chars AS upper_share,
    nullif(length(regexp_replace(text, '[^.,;:!?]', '', 'g')), 0) / n_chars AS punct_share
  FROM raw)"""
_IMPUTED = ", ".join(
    f"coalesce({f}, (SELECT median({f}) FROM feats WHERE split = 'train'), 0) AS {f}" for f in FEATURES
)
_SCALED = ", ".join(
    f"({f} - (SELECT avg({f}) FROM filled WHERE split = 'train')) / "
    f"coalesce(nullif((SELECT stddev_pop({f}) FROM filled WHERE split = 'train'), 0), 1) AS {f}" for f in FEATURES
)
_PREPARED_SQL = _FEATURE_SQL + f""",
filled AS (SELECT doc_id, subject, y, toxic, split, {_IMPUTED} FROM feats),
prepared AS (SELECT doc_id, subject, y, toxic, split, {_SCALED} FROM filled)"""


@query(
    "document_features",
    oracle=_FEATURE_SQL + " SELECT * FROM feats",
    doubles=" ".join(FEATURES),
    ints="y toxic",
)
def document_features(spark, d):
    return doc_features(spark, d)


def prepared(spark, d):
    """Prepared features, written once for the iterative fits."""
    return cut_lineage(mo.prepare(doc_features(spark, d), FEATURES))


@query(
    "prepared_features",
    oracle=_PREPARED_SQL + " SELECT * FROM prepared",
    doubles=" ".join(FEATURES),
    ints="y toxic",
)
def prepared_features(spark, d):
    return mo.prepare(doc_features(spark, d), FEATURES)


_RANK_SQL = oracle_prefix("scores") + """, s AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scores)"""


@query(
    "auroc_rank",
    oracle=_RANK_SQL + """ SELECT sum(y) AS n_pos, sum(1 - y) AS n_neg,
      (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) AS auroc FROM s""",
    doubles="auroc",
    ints="n_pos n_neg",
)
def auroc_rank(spark, d):
    return ra.auroc(scores(spark, d), "score", "y")


@query(
    "average_precision",
    oracle=oracle_prefix("scores") + """, h AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scores GROUP BY score)
      SELECT sum(pos * tp / m) / sum(pos) AS auprc FROM (SELECT pos, (sum(pos) OVER w)::DOUBLE AS tp, (sum(n) OVER w)::DOUBLE AS m
        FROM h WINDOW w AS (ORDER BY score DESC))""",
    doubles="auprc",
)
def average_precision(spark, d):
    return ra.average_precision(scores(spark, d), "score", "y")


@query(
    "brier",
    oracle=oracle_prefix("scores") + " SELECT count(*) AS n, avg((score - y) * (score - y)) AS brier, avg(y) AS prevalence FROM scores",
    doubles="brier prevalence",
)
def brier(spark, d):
    return ra.brier(scores(spark, d), "score", "y")


@query(
    "calibration_bins",
    oracle=oracle_prefix("scores") + """, e AS (SELECT quantile_cont(score, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM scores)
      SELECT len(list_filter(edges, lambda x: x < score)) AS bin, count(*) AS n, avg(score) AS pred, avg(y) AS obs FROM scores, e GROUP BY 1""",
    doubles="pred obs",
    ints="bin",
)
def calibration_bins(spark, d):
    return ra.calibration(scores(spark, d), "score", "y")


N_BOOT = 2000

_BOOT_SQL = oracle_prefix("scores") + f""",
subj AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS s, count(*) OVER () AS ns FROM (SELECT DISTINCT subject FROM scores)),
w AS (SELECT b, CAST(CAST(concat('0x', substr(sha256(concat('{SEED}|', b, '|', s)), 1, 16)) AS UBIGINT) % ns AS BIGINT) AS s, count(*) AS w
      FROM subj, (SELECT unnest(range({N_BOOT})) AS b) GROUP BY 1, 2),
h AS (SELECT b, score, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM w JOIN subj USING (s) JOIN scores USING (subject) GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY b ORDER BY score) AS cn, sum(pos) OVER (PARTITION BY b ORDER BY score DESC) AS tp,
             sum(pos + neg) OVER (PARTITION BY b ORDER BY score DESC) AS m FROM h),
boot AS (SELECT b, sum(pos * (cn - neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auroc,
                sum(pos * tp::DOUBLE / nullif(m, 0)) / sum(pos) AS auprc FROM c GROUP BY b HAVING sum(pos) > 0 AND sum(neg) > 0)"""


@query("subject_resamples", oracle=_BOOT_SQL + " SELECT * FROM boot", doubles="auroc auprc", ints="b")
def subject_resamples(spark, d):
    return ra.bootstrap_metrics(scores(spark, d), "score", "y", "subject", N_BOOT, SEED)


@query(
    "subject_bootstrap_ci",
    oracle=_BOOT_SQL + """ SELECT count(*) AS n_boot, quantile_cont(auroc, 0.025) AS auroc_lo, quantile_cont(auroc, 0.975) AS auroc_hi,
      quantile_cont(auprc, 0.025) AS auprc_lo, quantile_cont(auprc, 0.975) AS auprc_hi FROM boot""",
    doubles="auroc_lo auroc_hi auprc_lo auprc_hi",
)
def subject_bootstrap_ci(spark, d):
    boot = ra.bootstrap_metrics(scores(spark, d), "score", "y", "subject", N_BOOT, SEED)
    return ra.confidence_intervals(cut_lineage(boot))


@query(
    "model_gate",
    oracle=_RANK_SQL + """, h AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scores GROUP BY score),
      r AS (SELECT (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) AS auroc FROM s),
      a AS (SELECT sum(pos * tp / m) / sum(pos) AS auprc FROM (SELECT pos, (sum(pos) OVER w)::DOUBLE AS tp, (sum(n) OVER w)::DOUBLE AS m
        FROM h WINDOW w AS (ORDER BY score DESC)))
      SELECT auroc, auprc, CASE WHEN auroc NOT BETWEEN 0.80 AND 0.87 THEN 'stop' WHEN auroc BETWEEN 0.82 AND 0.85 AND auprc BETWEEN 0.35 AND 0.45
        THEN 'pass' ELSE 'marginal' END AS verdict FROM r, a""",
    doubles="auroc auprc",
)
def model_gate(spark, d):
    return mo.gate(mo.evaluate(scores(spark, d))).select("auroc", "auprc", "verdict")


_SCAN = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, y, {f} AS value FROM feats WHERE {f} IS NOT NULL" for f in FEATURES
)


@query(
    "single_feature_scan",
    oracle=_FEATURE_SQL + f""", long AS ({_SCAN}),
      r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS r FROM long),
      a AS (SELECT feature, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y)::DOUBLE * sum(1 - y), 0) AS auroc
            FROM r GROUP BY feature HAVING count(*) >= 30)
      SELECT feature, greatest(auroc, 1 - auroc) AS strength, greatest(auroc, 1 - auroc) > 0.8 AS suspicious FROM a WHERE auroc IS NOT NULL
      ORDER BY strength DESC, feature LIMIT 10""",
    doubles="strength",
)
def single_feature_scan(spark, d):
    # The small test tables hold fewer labelled documents than the operator's default minimum.
    return mo.single_feature_scan(doc_features(spark, d), FEATURES, "y", min_rows=30)


STEPS = 15


def _newton_sql(problems: str, rows: str, width: int, kind: str = "logistic") -> str:
    """Newton steps for every problem: relations ``problems`` (problem) and ``fit_rows`` (problem, x, y, wt).

    x ends in the constant, whose coefficient has no penalty.
    """
    p, bend, steps = ("1 / (1 + exp(-z))", "wt * p * (1 - p)", STEPS) if kind == "logistic" else ("z", "wt", 1)
    cells = []
    for i in range(1, width + 1):
        row = [f"sum(h * x[{i}] * x[{j}])" + (" + 1" if i == j < width else "") for j in range(1, width + 1)]
        row.append(f"sum(wt * (p - y) * x[{i}])" + (f" + w[{i}]" if i < width else ""))
        cells.append(f"[{', '.join(row)}]")
    system = f"SELECT problem, t, w, [{', '.join(cells)}] AS m FROM (SELECT *, {bend} AS h FROM (SELECT *, {p} AS p FROM (SELECT problem, t, w, x, y, wt, list_dot_product(w, x) AS z FROM newton JOIN fit_rows USING (problem) WHERE t < {steps}))) GROUP BY problem, t, w"
    for k in range(1, width + 1):  # Gauss-Jordan on the positive definite system
        system = f"""SELECT problem, t, w, list_transform(m, lambda r, i: list_transform(r, lambda v, j:
          CASE WHEN i = {k} THEN v / m[{k}][{k}] ELSE v - r[{k}] * m[{k}][j] / m[{k}][{k}] END)) AS m FROM ({system})"""
    zeros = ", ".join(["0.0::DOUBLE"] * width)
    return f""", problems AS ({problems}), fit_rows AS MATERIALIZED ({rows}),
newton AS (SELECT problem, 0 AS t, [{zeros}] AS w FROM problems
  UNION ALL SELECT problem, t + 1, list_transform(w, lambda v, i: v - m[i][{width + 1}]) FROM ({system})),
fitted AS (SELECT problem, w FROM newton WHERE t = {steps})"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH raw", "WITH RECURSIVE raw", 1)


_X = "[" + ", ".join(FEATURES) + ", 1.0::DOUBLE]"
_SCORED_SQL = f""",
scored AS (SELECT problem, y, round(1 / (1 + exp(-list_dot_product(w, {_X}))), 10) AS score FROM prepared, fitted WHERE split <> 'train'),
areas AS (SELECT problem, sum(y) AS n_pos, sum(1 - y) AS n_neg,
    (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y)::DOUBLE * sum(1 - y), 0) AS auroc,
    count(*) AS n, avg((score - y) * (score - y)) AS brier, avg(y) AS prevalence
  FROM (SELECT *, rank() OVER (PARTITION BY problem ORDER BY score) + (count(*) OVER (PARTITION BY problem, score) - 1) / 2.0::DOUBLE AS r FROM scored) GROUP BY problem),
precisions AS (SELECT problem, sum(pos * tp / m) / nullif(sum(pos), 0) AS auprc FROM (SELECT problem, pos, (sum(pos) OVER v)::DOUBLE AS tp, (sum(n) OVER v)::DOUBLE AS m
  FROM (SELECT problem, score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY problem, score) WINDOW v AS (PARTITION BY problem ORDER BY score DESC)) GROUP BY problem)"""
_PLAIN_ROWS = f"SELECT problem, {_X} AS x, y, 1.0::DOUBLE AS wt FROM prepared, problems WHERE split = 'train'"
_TWO_SQL = _recursive(_PREPARED_SQL) + _newton_sql(
    "SELECT unnest(['plain', 'balanced']) AS problem",
    f"""SELECT problem, {_X} AS x, y, CASE WHEN problem = 'plain' THEN 1.0::DOUBLE WHEN y = 1 THEN n / (2.0::DOUBLE * pos) ELSE n / (2.0::DOUBLE * (n - pos)) END AS wt
        FROM prepared, problems, (SELECT count(*) AS n, sum(y) AS pos FROM prepared WHERE split = 'train') WHERE split = 'train'""",
    len(FEATURES) + 1,
)


@query(
    "logistic_metrics",
    oracle=_TWO_SQL + _SCORED_SQL + " SELECT n_pos, n_neg, auroc, auprc, n, brier, prevalence, problem AS model FROM areas JOIN precisions USING (problem)",
    doubles="auroc auprc brier prevalence",
    ints="n_pos n_neg n",
)
def logistic_metrics(spark, d):
    """Plain and class-balanced logistic regression on held-out documents."""
    p = prepared(spark, d)
    train, held = p.filter("split = 'train'"), p.filter("split <> 'train'")
    models = mo.fit_all(train, {"plain": mo.Problem(FEATURES), "balanced": mo.Problem(FEATURES, weights=None)})
    out = None
    for name, model in models.items():
        row = mo.evaluate(mo.score_logistic(model, held)).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "logistic_coefficients",
    oracle=_recursive(_PREPARED_SQL) + _newton_sql("SELECT 'plain' AS problem", _PLAIN_ROWS, len(FEATURES) + 1)
    + f" SELECT feature, coef, abs(coef) AS abs_coef FROM (SELECT unnest({FEATURES}) AS feature, unnest(w[1:{len(FEATURES)}]) AS coef FROM fitted)",
    doubles="coef abs_coef",
)
def logistic_coefficients(spark, d):
    model = mo.fit_logistic(prepared(spark, d).filter("split = 'train'"), FEATURES)
    return mo.coefficients(spark, FEATURES, list(model.coefficients))


_INPUTS = [f for f in FEATURES if f not in ("n_chars", "n_words")]
_RIDGE_X = "[" + ", ".join(_INPUTS) + ", 1.0::DOUBLE]"
_RIDGE_SQL = _recursive(_PREPARED_SQL) + ", goals AS (SELECT prepared.*, ln(1 + feats.n_chars) AS target FROM prepared JOIN feats USING (doc_id))" + _newton_sql(
    "SELECT 'ridge' AS problem",
    f"SELECT problem, {_RIDGE_X} AS x, target AS y, 1.0::DOUBLE AS wt FROM goals, problems WHERE split = 'train'",
    len(_INPUTS) + 1,
    "ridge",
)


@query(
    "ridge_report",
    oracle=_RIDGE_SQL + f""", predicted AS (SELECT y, target, list_dot_product(w, {_RIDGE_X}) AS pred FROM goals, fitted WHERE split <> 'train')
      SELECT "group", count(*) AS n, avg(abs((exp(target) - 1) - (exp(pred) - 1))) AS mae,
        1 - sum((target - pred) * (target - pred)) / nullif(var_pop(target) * count(*), 0) AS r2
      FROM (SELECT *, unnest(CASE WHEN y = 1 THEN ['all', 'survivors'] ELSE ['all'] END) AS "group" FROM predicted) GROUP BY 1""",
    doubles="mae r2",
    ints="n",
)
def ridge_report(spark, d):
    """Log length from the other features; error in characters and R^2."""
    base = doc_features(spark, d).withColumn("target", F.log1p("n_chars"))
    p = cut_lineage(mo.prepare(base, _INPUTS))
    model = mo.fit_ridge(p.filter("split = 'train'"), _INPUTS, "target")
    return mo.regression_report(mo.score_ridge(model, p.filter("split <> 'train'")), "target", "y")


SUBSETS = {
    "all": FEATURES,
    "sizes only": [f for f in FEATURES if f.startswith("n_")],
    "no sizes": [f for f in FEATURES if not f.startswith("n_")],
    **{f"without {left}": [f for f in FEATURES if f != left] for left in FEATURES[1:]},
}
_SUBSET_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS problem, {len(fs)} AS n_features, {[1 if f in fs else 0 for f in FEATURES]} AS mask" for name, fs in SUBSETS.items()
)
_MASKED = "[" + ", ".join(f"{f} * mask[{i}]" for i, f in enumerate(FEATURES, 1)) + ", 1.0::DOUBLE]"


@query(
    "feature_ablation",
    oracle=_recursive(_PREPARED_SQL)
    + _newton_sql(_SUBSET_ROWS, f"SELECT problem, {_MASKED} AS x, y, 1.0::DOUBLE AS wt FROM prepared, problems WHERE split = 'train'", len(FEATURES) + 1)
    + _SCORED_SQL
    + " SELECT problem AS subset, n_features, auroc, auprc FROM problems JOIN areas USING (problem) JOIN precisions USING (problem)",
    doubles="auroc auprc",
    ints="n_features",
)
def feature_ablation(spark, d):
    return mo.ablation(prepared(spark, d), SUBSETS)


DRAWS = 5


def _order(seed: int, draw: int) -> str:
    return f"row_number() OVER (ORDER BY sha256(concat('{seed + 10 * draw}|', doc_id)))"


_DEALT_SQL = " UNION ALL ".join(
    f"""SELECT {i} AS problem, {_X} AS x, o.y, 1.0::DOUBLE AS wt
  FROM (SELECT *, {_order(SEED, i)} AS place FROM prepared WHERE split = 'train') AS a
  JOIN (SELECT y, {_order(SEED + 1, i)} AS place FROM prepared WHERE split = 'train') AS o USING (place)""" for i in range(DRAWS)
)
_CONTROL_SQL = _recursive(_PREPARED_SQL) + _newton_sql(f"SELECT unnest(range({DRAWS})) AS problem", _DEALT_SQL, len(FEATURES) + 1) + _SCORED_SQL


@query("negative_control", oracle=_CONTROL_SQL + " SELECT problem AS draw, auroc FROM areas", doubles="auroc", ints="draw")
def negative_control(spark, d):
    return mo.negative_control(prepared(spark, d), FEATURES, "doc_id", draws=DRAWS)


@query(
    "negative_control_verdict",
    oracle=_CONTROL_SQL + " SELECT avg(auroc) AS mean_auroc, abs(avg(auroc) - 0.5) < 0.03 AS ok FROM areas",
    doubles="mean_auroc",
)
def negative_control_verdict(spark, d):
    """Whether models of shuffled labels rank held-out documents no better than chance."""
    return mo.control_verdict(cut_lineage(mo.negative_control(prepared(spark, d), FEATURES, "doc_id", draws=DRAWS)))
