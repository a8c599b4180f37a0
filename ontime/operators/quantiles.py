"""Exact quantiles of counted values, in bounded memory.

A small group is sorted where it is. A larger one is never gathered: its values are counted in ``RANGES`` equal
ranges, the range that holds each wanted rank is kept, and only that range is looked into again, until
what is left of it is small.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontime.sources.shared import materialize

GATHERED = 20_000  #: different values of a group or a range that may meet in one task
RANGES = 4096  #: that a group is counted in at once


def _same(keys: list[str]) -> Column:
    """Whether the columns equal those of the same names with ``of_`` before them."""
    return reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"of_{key}")) for key in keys])


def _renamed(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.withColumnsRenamed({key: f"of_{key}" for key in keys})


def exact_quantiles(counts: DataFrame, keys: list[str], shares: list[float], gathered: int = GATHERED) -> DataFrame:
    """(keys, q array<double>) of a table (keys, value, n) of different values and how often they occur.

    Quantiles lie between the two values around their rank, in proportion. Values are doubles without NULL or NaN. The
    table is read several times, so write it before. There may be any number of different values of a key, but the keys
    themselves are few: a row of figures for each travels with the plan.
    """
    small = counts.groupBy(*keys).agg(F.percentile(F.col("value"), shares, F.col("n")).alias("q"))
    if counts.count() <= gathered:
        return small
    sizes = materialize(
        counts.groupBy(*keys).agg(
            F.count("*").alias("different"), F.sum("n").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
        ),
        "sizes",
    )
    most = sizes.agg(F.max("different")).first()[0]
    return small if most <= gathered else _selected(counts, sizes, keys, shares, gathered)


def _selected(counts: DataFrame, sizes: DataFrame, keys: list[str], shares: list[float], gathered: int) -> DataFrame:
    """The same by selection: for each key and rank, a range [low, high] with the number of values before it."""
    ranks = []
    for place, share in enumerate(shares):
        at = F.lit(share) * (F.col("total") - 1)
        for side, rank in enumerate((F.floor(at), F.ceil(at))):
            ranks.append(F.struct(F.lit(2 * place + side).alias("place"), rank.cast("long").alias("rank")))
    wanted = sizes.select(*keys, "low", "high", F.lit(0).cast("long").alias("before"), "different", F.inline(F.array(*ranks)))
    wanted = materialize(_renamed(wanted, keys), "ranks")
    named = [f"of_{key}" for key in keys]
    while wanted.where(F.col("different") > gathered).limit(1).count():
        wanted = materialize(_closer(counts, wanted, keys, named, gathered), "ranks")
    held = counts.join(F.broadcast(wanted), _same(keys) & F.col("value").between(F.col("low"), F.col("high")))
    running = Window.partitionBy(*named, "place").orderBy("value")
    held = held.withColumn("upto", F.col("before") + F.sum("n").over(running))
    found = held.where(F.col("upto") > F.col("rank")).groupBy(*named, "place").agg(F.min("value").alias("value"))
    totals = _renamed(sizes.select(*keys, "total"), keys)
    same = reduce(lambda a, b: a & b, [found[n].eqNullSafe(totals[n]) for n in named])
    placed = found.join(F.broadcast(totals), same).select(*[found[n].alias(k) for n, k in zip(named, keys)], "place", "value", "total")
    ends = placed.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("ends"), F.first("total").alias("total")
    )
    made = []
    for place, share in enumerate(shares):
        at = F.lit(share) * (F.col("total") - 1)
        low, high = (F.try_element_at("ends", F.lit(2 * place + side)) for side in (0, 1))
        made.append(low + (high - low) * (at - F.floor(at)))
    return ends.select(*keys, F.array(*made).alias("q"))


def _closer(counts: DataFrame, wanted: DataFrame, keys: list[str], named: list[str], gathered: int) -> DataFrame:
    """Each rank with the part of its range that holds it: counted by part, not gathered."""
    done = wanted.where(F.col("different") <= gathered)
    open_ranks = wanted.where(F.col("different") > gathered)
    # Ranks of a key often share a range; it is counted once.
    spans = open_ranks.select(*named, "low", "high").distinct()
    part = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))
    inside = counts.join(F.broadcast(spans), _same(keys) & F.col("value").between(F.col("low"), F.col("high")))
    parts = inside.groupBy(*named, "low", "high", part.cast("int").alias("part")).agg(
        F.sum("n").alias("n"), F.count("*").alias("some"), F.min("value").alias("least"), F.max("value").alias("largest")
    )
    running = Window.partitionBy(*named, "low", "high").orderBy("part")
    parts = parts.withColumn("upto", F.sum("n").over(running))
    sides = [F.col(f"r.{n}").eqNullSafe(F.col(f"p.{n}")) for n in (*named, "low", "high")]
    upto = F.col("r.before") + F.col("p.upto")
    holds = (upto > F.col("r.rank")) & (upto - F.col("p.n") <= F.col("r.rank"))
    met = open_ranks.alias("r").join(parts.alias("p"), reduce(lambda a, b: a & b, sides) & holds)
    closer = met.select(
        *[F.col(f"r.{n}").alias(n) for n in named],
        F.col("p.least").alias("low"),
        F.col("p.largest").alias("high"),
        (upto - F.col("p.n")).alias("before"),
        F.col("p.some").alias("different"),
        "r.place",
        "r.rank",
    )
    return done.unionByName(closer)
