"""The subpackage's queries: one opN_<name> for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphflow.llm import html, knn, lines, maxent, mixing, packing, quality, secrets, simhash, suffix
from graphflow.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"), maxent.remainder() == 2)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "n_runs", "text")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit_chains(secrets.labelled_samples(docs)))
    base = F.filter("found", lambda x: x["k"] < 3)
    counts = [secrets.count_of(F.col("found"), k).alias(f"n_{k}") for k in ("assign", "access", "hex", "markov")]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("found")).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn.nearest(rows, rows.where("vec_id % 20 = 0"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_html, op3_maxent, op4_suffix, op5_lines, op6_secrets, op7_simhash, op8_packing, op9_mixing, op10_knn)}


#: Line dedup with whole passages as strings; lines are numbered from 1 here.
LINES_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
  lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r FROM docs),
  words AS (SELECT *, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM lines),
  filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY r) AS i, sum(n) OVER (PARTITION BY doc_id, text ORDER BY r) - n AS c FROM words WHERE n > 0),
  sized AS (SELECT *, count(*) OVER a AS m, sum(n) OVER a AS w FROM filled WINDOW a AS (PARTITION BY doc_id, text ORDER BY c RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
  passages AS (SELECT p.doc_id, p.text, p.i, p.m, string_agg(q.x, chr(10) ORDER BY q.i) AS run FROM sized p JOIN filled q ON p.doc_id IS NOT DISTINCT FROM q.doc_id AND p.text = q.text AND q.i BETWEEN p.i AND p.i + p.m - 1
    WHERE p.w >= 50 GROUP BY p.doc_id, p.text, p.i, p.m),
  later AS (SELECT * FROM passages QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, i) > 1),
  gone AS (SELECT DISTINCT l.doc_id, l.text, f.i, f.r FROM later l JOIN filled f ON l.doc_id IS NOT DISTINCT FROM f.doc_id AND l.text = f.text AND f.i BETWEEN l.i AND l.i + l.m - 1),
  runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS g FROM gone),
  lost AS (SELECT doc_id, text, count(*) AS n_deleted, count(DISTINCT g) AS n_runs FROM runs GROUP BY ALL),
  kept AS (SELECT w.doc_id, w.text, string_agg(w.x, chr(10) ORDER BY w.r) AS left_over FROM words w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id IS NOT DISTINCT FROM w.doc_id AND g.text = w.text AND g.r = w.r) GROUP BY ALL),
  sizes AS (SELECT doc_id, text, count(*) AS n_lines FROM filled GROUP BY ALL)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_over, '') END AS text
FROM documents d LEFT JOIN sizes s ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.text = d.text LEFT JOIN lost l ON l.doc_id IS NOT DISTINCT FROM d.doc_id AND l.text = d.text
  LEFT JOIN kept k ON k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.text = d.text
"""


#: Suffix dedup with every window of 200 bytes as hexadecimal text.
SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
  w AS (SELECT k, hx, unnest(range(0, len(hx) // 2 - 199)) AS i FROM d WHERE len(hx) >= 400),
  rep AS (SELECT k, i FROM (SELECT k, i, md5(substr(hx, 2 * i + 1, 400)) AS s FROM w) QUALIFY count(*) OVER (PARTITION BY s) > 1),
  marked AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM rep),
  spans AS (SELECT k, min(i) AS b, max(i) + 200 AS e FROM (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS g FROM marked) GROUP BY k, g),
  gaps AS (SELECT k, coalesce(lag(e) OVER (PARTITION BY k ORDER BY b), 0) AS f, b AS t FROM spans UNION ALL SELECT k, max(e), 1000000000 FROM spans GROUP BY k),
  kept AS (SELECT k, string_agg(substr(hx, CAST(2 * f + 1 AS BIGINT), CAST(2 * (t - f) AS BIGINT)), '' ORDER BY f) AS hx FROM gaps JOIN d USING (k) GROUP BY k),
  sums AS (SELECT k, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY k)
SELECT doc_id, len(d.hx) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.hx, d.hx))) AS kept_sha256
FROM d LEFT JOIN sums USING (k) LEFT JOIN kept ON kept.k = d.k
"""

#: Nearest neighbours by comparing every query with every row.
KNN_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix": SUFFIX_SQL, "op5_lines": LINES_SQL, "op10_knn": KNN_SQL}
