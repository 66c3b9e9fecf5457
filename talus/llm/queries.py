"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import brown, chosen_path, language, lemp, minhash, mixing, packing, pii, quality_net, rules, suffix, url_filter, whitening
from talus.llm.tokenizer_files import tokenizer_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_edits(documents(spark, sf_dir))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = F.transform("draws", lambda d: d["shard"]).alias("shards")
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", shards)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemp.mine(embeddings(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_brown": op2_brown,
    "op3_quality": op3_quality,
    "op4_jaccard": op4_jaccard,
    "op5_packing": op5_packing,
    "op6_rules": op6_rules,
    "op7_personal": op7_personal,
    "op8_language": op8_language,
    "op9_repeats": op9_repeats,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_url_filter": op13_url_filter,
}
_WORDS = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),"""

ORACLES: dict[str, str] = {
    "op4_jaccard": _WORDS
    + """
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9 UNION ALL
  SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id <> b.doc_id),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links
FROM (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY 1) USING (doc_id)""",
    "op9_repeats": _WORDS
    + """
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) > 34)),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win), range(35) t(o) WHERE c > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, b.r, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, r) <= 5),
m AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r) AS INTEGER) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 5""",
}
