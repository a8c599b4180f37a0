"""Sampling, splitting, class balance and union.

``sample_rows``, ``split`` and ``balance`` draw at random: a seed repeats the
draw on the same partitions only. The ``_by_key`` forms decide by a key of the
row, so they give the same rows whatever the layout.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_rows(table: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Each row with the given probability, without replacement."""
    return table.sample(False, fraction, seed)


def _kept(key: Column, modulus: int, kept: int) -> Column:
    return F.pmod(key, F.lit(modulus)) < kept


def sample_by_key(table: DataFrame, key: Column, modulus: int, kept: int) -> DataFrame:
    """Rows whose integer key falls into ``kept`` of ``modulus`` classes."""
    return table.where(_kept(key, modulus, kept))


def split(table: DataFrame, weights: list[float], seed: int) -> list[DataFrame]:
    """Random parts of the table in the given proportions."""
    return table.randomSplit(weights, seed)


def draw_part(weights: list[float], seed: int) -> Column:
    """A random part, from 0, in the given proportions. Once written, every read of a part gives the same rows."""
    bounds = [sum(weights[:k]) / sum(weights) for k in range(1, len(weights))]
    if not bounds:
        return F.lit(0)

    def passed(draw: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound <= draw))

    return F.transform(F.array(F.rand(seed)), passed)[0]


def balance(table: DataFrame, label: str, fractions: dict, seed: int) -> DataFrame:
    """Rows kept with a probability that depends on their label, in one scan."""
    return table.sampleBy(label, fractions, seed)


def balance_by_key(
    table: DataFrame, label: str, shares: dict[int, tuple[int, int]], key: Column
) -> DataFrame:
    """As :func:`balance`, by a key: ``shares`` maps a label to (modulus, kept).

    Labels that are not mentioned keep all their rows.
    """
    keep = F.lit(True)
    for value, (modulus, kept) in shares.items():
        keep = F.when(F.col(label) == value, _kept(key, modulus, kept)).otherwise(keep)
    return table.where(keep)


def with_label(table: DataFrame, value, name: str = "label") -> DataFrame:
    """The table with a constant label column."""
    return table.withColumn(name, F.lit(value))


def stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both tables, duplicates included; columns matched by name."""
    return first.unionByName(second)
