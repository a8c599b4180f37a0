"""The registered queries of this package, and their DuckDB SQL where SQL can express them."""

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ontime.llm import (
    bpe,
    centroids,
    exact,
    language,
    licences,
    line_dedup,
    packing,
    pieces,
    quality_model,
    quality_rules,
    retrieval,
    secrets,
    simhash,
)
from ontime.llm.common import documents, labels

#: Vocabulary file of the tokenizer that the queries use.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def reachable(spark: SparkSession) -> None:
    """Let Python workers of this machine import this package; on a cluster it is installed or sent with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return operator(documents(spark, sf_dir))

    return query


def _with_labels(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return operator(documents(spark, sf_dir), labels(spark, sf_dir))

    return query


def _lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return retrieval.op11_lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return centroids.op13_centroid_clustering(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": _on_documents(simhash.op1_simhash_near_dedup),
    "op2_bpe_round_trip": _on_documents(lambda docs: bpe.op2_bpe_round_trip(docs, TOKENIZER)),
    "op3_best_fit_packing": _on_documents(lambda docs: packing.op3_best_fit_packing(docs, TOKENIZER)),
    "op4_quality_classifier": _with_labels(quality_model.op4_quality_classifier),
    "op5_language_id": _on_documents(language.op5_language_id),
    "op6_quality_rules": _with_labels(quality_rules.op6_quality_rules),
    "op7_secret_scan": _on_documents(secrets.op7_secret_scan),
    "op8_exact_dedup": _on_documents(exact.op8_exact_dedup),
    "op9_fuzzy_line_dedup": _on_documents(line_dedup.op9_fuzzy_line_dedup),
    "op10_licence_scan": _on_documents(licences.op10_licence_scan),
    "op11_lexical_search": _lexical_search,
    "op12_piece_round_trip": _on_documents(lambda docs: pieces.op12_piece_round_trip(docs, PIECE_MODEL)),
    "op13_centroid_clustering": _centroid_clustering,
}

ORACLE: dict[str, str] = {
    "op8_exact_dedup": exact.OP8_SQL,
    "op11_lexical_search": retrieval.OP11_SQL,
    "op13_centroid_clustering": centroids.OP13_SQL,
}
