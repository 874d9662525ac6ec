"""Training-data pipeline over `documents`: quality rules, near-duplicates, benchmark
decontamination, secret scans, packing. Each stage is written and read again before the next."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import decontam, near_dedup, packing, quality_rules, secrets
from corpusflow.llm.common import table
from corpusflow.llm.queries import trusted_documents
from corpusflow.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    weights = quality_rules.fit(docs, trusted_documents(spark, sf_dir))
    return quality_rules.keep_good(docs, weights)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, a similarity of 0.8 or more,
    searched by SimHash, what that leaves apart by shared rare shingles, and checked exactly."""
    return near_dedup.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return secrets.redact(docs, secrets.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in a sequence of 2,048."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_quality),
    ("near_dedup", first_of_near_copies),
    ("decontamination", uncontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

# The fingerprints, the network and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
