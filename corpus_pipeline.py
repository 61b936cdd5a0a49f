"""From raw documents to training tokens: the stages' decisions take effect one after another.

``STAGES`` names the steps; each reads all that the one before it kept and, but for the last, returns the columns of
documents. Between the steps ``run`` writes the documents to the shared folder and reads them again.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.decontamination import without_items
from tallyline.llm.mixing import mixed_documents, quality_domains
from tallyline.llm.near_dedup import one_of_each
from tallyline.llm.token_shards import token_shards
from tallyline.llm.toxicity import toxicity
from tallyline.sources.scratch import written

# Good documents are repeated where needed; none is dropped.
DOMAIN_WEIGHTS = {"good": 0.88, "low": 0.12}
END_ID = 2


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    judged = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("NOT rejected").select(docs.columns)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs, Fraction(80, 100))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the domain weights ask, once at least."""
    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed_documents(docs, labels, DOMAIN_WEIGHTS, least=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shard files, read back per document."""
    return token_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("toxicity", not_toxic),
    ("near_dedup", near_unique),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_output", tokens),
]

# Model probabilities and iterations decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "start", "n_tokens", F.col("ids_crc32"))
