"""From raw documents to packed sequences: rules, two kinds of deduplication, redaction, packing.

Every stage takes all documents that its predecessor kept, and all but the last
return the columns of ``documents``. Each is written as Parquet and read again, so a
lost executor never costs more than a stage.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ontime.llm import exact, packing, quality_rules, secrets, simhash
from ontime.llm.common import documents, labels
from ontime.llm.queries import TOKENIZER, reachable
from ontime.sources.shared import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the rules learn from the labelled ones among ``docs``."""
    reachable(spark)
    return quality_rules.keep_good(docs, quality_rules.train(docs, labels(spark, sf_dir)))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group of equal texts."""
    reachable(spark)
    return exact.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    reachable(spark)
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of secrets."""
    return secrets.redact(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    reachable(spark)
    return packing.op3_best_fit_packing(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_exact_duplicates),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL can express neither the rules' model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
