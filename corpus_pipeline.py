"""The pipeline over ``documents``: each stage reads what the one before it
kept.  (name, function) in ``STAGES``; a function takes (spark, docs, sf_dir).

1. ``toxicity`` (operator 8): documents that it rejects go.
2. ``ngram_jaccard_join`` (1): of each group of near duplicates the smallest id stays.
3. ``benchmark_decontamination`` (7): documents that cover a benchmark item go.
4. ``secret_scans`` (2): secrets in the texts are replaced by marks.
5. ``source_mixing`` (5): documents are repeated to the target weights, shuffled.

A stage that filters leaves the columns of ``documents`` as they are; the fourth
changes ``text`` and ``n_chars`` where there is a secret; the last adds
``copy``, ``n_copies`` and ``shuffle_key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm.common import stored
from spendlens.llm.mixing import mix_sources
from spendlens.llm.ngram_join import one_per_component
from spendlens.llm.secrets import redact_secrets
from spendlens.llm.tiling import drop_contaminated
from spendlens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates),
          ("benchmark_decontamination", decontamination), ("secret_scans", secrets), ("source_mixing", mixing)]

#: SQL cannot express every stage; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
