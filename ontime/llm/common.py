"""What the operators of this package share.

Every operator reads ``doc_id`` and ``text`` only, so other columns may have any
name. A null text counts as an empty one, and a null doc_id is a value like any
other that sorts last.
"""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table of a folder."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def body() -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col("text"), F.lit(""))


def fresh(table: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {x.lower() for x in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    """As many partitions as the session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items of about ``most`` in total; a larger item stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def code_points(text: str) -> np.ndarray:
    """The text as an array of code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def bounded(drawn: DataFrame, group: str, most: int) -> DataFrame:
    """No more than ``most`` rows of each group, the smallest by ``draw``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy("draw"))
    return drawn.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def text_key() -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64("text")


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose (doc_id, text_key) is in ``kept``, with their own columns; of rows that repeat, one.

    Each key is a document's own, so no group of copies meets here.
    """
    doc, key, row = (fresh(docs, name) for name in ("kept_doc", "kept_key", "kept_row"))
    wanted = kept.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    held = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col(doc)) & (text_key() == F.col(key)))
    first = F.row_number().over(Window.partitionBy(doc, key).orderBy(doc, key))
    return held.withColumn(row, first).filter(F.col(row) == 1).select(*docs.columns)
