"""Queries ``opN_<name>`` over the whole given tables, and DuckDB SQL of those
that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import chat, cotraining
from spendlens.llm.cover_tree import hard_negatives
from spendlens.llm.fertility import fertility_rules
from spendlens.llm.lm import lm_scores
from spendlens.llm.minmax import minmax_duplicates
from spendlens.llm.mixing import mix_sources
from spendlens.llm.ngram_join import ngram_join
from spendlens.llm.periodic import periodic_runs, planted_order
from spendlens.llm.pii import pii_spans
from spendlens.llm.secrets import secret_spans
from spendlens.llm.tiling import contaminated
from spendlens.llm.toxicity import toxicity_scores, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cotraining.quality_scores(docs, cotraining.train(docs, _table(spark, sf_dir, "labels")))


def op4_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(_table(spark, sf_dir, "documents"))


def op7_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, _table(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_turns(chat.as_parts(turns.unionByName(chat.probe(spark)))))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"), order=planted_order, full=False)


def op12_minmax_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_duplicates(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


#: Lower-cases A-Z alone, then takes words; the same in every SQL below.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

def _jaccard_components(k: int, more: str = "") -> str:
    """Components of documents whose sets of ``k`` words link at 0.8."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i+{k - 1}], ' ') for i in range(1, len(w) - {k - 2})]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = g.doc_id) AS component_id{more}
FROM g
"""


OP1_SQL = _jaccard_components(5)
OP12_SQL = _jaccard_components(4, ", g.doc_id = (SELECT min(c) FROM r WHERE r.doc_id = g.doc_id) AS kept")

OP5_SQL = """
WITH RECURSIVE v AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS volume FROM documents GROUP BY source),
w AS (SELECT source, volume, CASE WHEN volume > 0 THEN pow(volume, 0.5) ELSE 0.0 END AS w FROM v),
r AS (SELECT source, 1.0::DOUBLE * w / (SELECT sum(w) FROM w) * (SELECT sum(volume) FROM w) / volume AS rate FROM w WHERE w > 0),
p AS (SELECT source, CAST(greatest(ceil(rate / 32.0), 1) AS INT) AS parts, rate / greatest(ceil(rate / 32.0), 1) AS mean FROM r),
c AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM p
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM c WHERE k < ceil(2 * mean + 60)),
u AS (SELECT d.*, CAST(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS VARCHAR) AS key, unnest(range(0, parts)) AS j
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT u.*, ('0x' || substr(md5('17|' || j || '|' || key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS x FROM u),
n AS (SELECT x.doc_id, x.key, x.j, x.source, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM x.source AND c.c <= x.x) AS k FROM x),
m AS (SELECT doc_id, key, CAST(sum(k) AS INT) AS n_copies FROM n GROUP BY doc_id, key),
e AS (SELECT doc_id, key, n_copies, unnest(range(0, n_copies)) AS copy FROM m)
SELECT d.*, CAST(copy AS INT) AS copy, n_copies, substr(md5('17|order|' || key || '|' || copy), 1, 16) AS shuffle_key
FROM e JOIN documents d ON d.doc_id IS NOT DISTINCT FROM e.doc_id
"""

OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
d AS (SELECT *, replace(text, chr(92), chr(92) || chr(92)) AS x FROM t),
n AS (SELECT *, length(x) + CAST(list_sum([(length(x) - length(replace(x, c, ''))) // length(c)
  for c in ['<|', '|>', '<s>', '</s>', '[INST]', '[/INST]']]) AS BIGINT) AS chars FROM d)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + length(role) + CASE WHEN role = 'assistant' THEN 5 ELSE 0 END + 8 + 1 + 7) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_cotraining": op3_quality_cotraining,
    "op4_fertility_rules": op4_fertility_rules,
    "op5_source_mixing": op5_source_mixing,
    "op6_pii": op6_pii,
    "op7_benchmark_tiling": op7_benchmark_tiling,
    "op8_toxicity": op8_toxicity,
    "op9_chat_format": op9_chat_format,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_minmax_duplicates": op12_minmax_duplicates,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op5_source_mixing": OP5_SQL,
    "op9_chat_format": OP9_SQL,
    "op12_minmax_duplicates": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
