"""Best-fit packing by linear grouping.

Documents become pieces of at most ``SEQUENCE`` tokens, and pieces fill sequences.
Only the number of pieces of each length matters for the plan, and there are no
more lengths than ``SEQUENCE``, so the plan is made from these counts:

1. Large lengths are put in groups of equal cardinality and rounded up to the
   longest of their group.
2. For the few sizes left, fullest configurations are chosen, the largest size
   first, each as often as the counts allow.
3. The actual lengths of a group are dealt to the group's places.
4. Small lengths go, longest first, where the gap is smallest.

Spark then numbers the pieces of each length, and a piece's number decides its
sequence and its place there. A length that a third of all pieces have is
numbered in many parts.

Null and empty texts are pieces of one token, the closing 0. Repeated rows are
packed each. An empty table has no pieces.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontime.llm.bpe import share_merges, worker_encoder
from ontime.llm.common import body, shuffle_partitions
from ontime.sources.shared import materialize

SEQUENCE = 2048  #: tokens of a sequence
END = 0  #: id after each document
SMALL = 1 / 8  #: lengths up to this share of a sequence are small
GROUPS = 512  #: groups of large lengths
LEAST_PARTS = 64  #: parts at least in which the pieces of one length are numbered

Pattern = tuple[int, list[tuple[int, int]]]  #: how many sequences, and (length, pieces) in each


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); a longer document's first piece may be shorter than the others."""
    shared = share_merges(docs.sparkSession, tokenizer)
    end = np.array([END], "<u4").tobytes()

    @F.pandas_udf("array<struct<piece int, start long, length long, ids_crc32 long>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(shared)
        for texts in batches:
            rows = []
            for ids in encoder.encode(texts.tolist()):
                ids += end
                n = len(ids) // 4
                first = n % sequence or sequence
                edges = [0, *range(first, n + 1, sequence)]
                rows.append([
                    {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])}
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
                ])
            yield pd.Series(rows)

    return docs.select("doc_id", F.explode(cut(body())).alias("p")).select("doc_id", "p.*")


def _groups(counts: np.ndarray, small: int, groups: int) -> list[tuple[int, int, list[list[int]]]]:
    """(rounded size, pieces, [[length, pieces]..] longest first) of each group of large lengths, largest first."""
    total = int(counts[small + 1 :].sum())
    made, room = [], 0
    for length in range(len(counts) - 1, small, -1):
        left = int(counts[length])
        while left:
            if not room:
                room = -(-total // groups)
                made.append([length, 0, []])
            taken = min(left, room)
            made[-1][1] += taken
            made[-1][2].append([length, taken])
            left, room = left - taken, room - taken
    return [tuple(x) for x in made]


def _fullest(sizes: list[int], left: list[int], first: int, room: int) -> list[int]:
    """How many of each size from ``first`` on fill the room best; subset sums as bits of an integer."""
    sums, steps, most = 1, [], (1 << (room + 1)) - 1
    for i in range(first, len(sizes)):
        if left[i] and sizes[i] <= room:
            for _ in range(min(left[i], room // sizes[i])):
                grown = (sums | sums << sizes[i]) & most
                if grown == sums:
                    break
                steps.append((sums, i))
                sums = grown
            if sums >> room & 1:
                break
    chosen, at = [0] * len(sizes), sums.bit_length() - 1
    for before, i in reversed(steps):
        if not before >> at & 1:
            chosen[i] += 1
            at -= sizes[i]
    return chosen


def _configure(grouped: list, sequence: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how often, [(group, places)..]) of the configurations that hold all large pieces at rounded sizes."""
    sizes, left, made = [x[0] for x in grouped], [x[1] for x in grouped], []
    for first in range(len(sizes)):
        while left[first]:
            rest = left.copy()
            rest[first] -= 1
            chosen = _fullest(sizes, rest, first, sequence - sizes[first])
            chosen[first] += 1
            times = min(left[i] // c for i, c in enumerate(chosen) if c)
            for i, c in enumerate(chosen):
                left[i] -= times * c
            made.append((times, [(i, c) for i, c in enumerate(chosen) if c]))
    return made


def _substitute(grouped: list, configurations: list) -> list[Pattern]:
    """Deal the actual lengths, longest first, to the places of their group."""
    stock, patterns = [[list(x) for x in g[2]] for g in grouped], []
    for times, places in configurations:
        slots = [i for i, c in places for _ in range(c)]
        while times:
            need: dict[int, int] = {}
            for i in slots:
                need[i] = need.get(i, 0) + 1
            # as many sequences as the longest lengths at hand can fill alike
            run = min(times, *(max(1, stock[i][0][1] // c) for i, c in need.items()))
            lengths: dict[int, int] = {}
            for i in slots:
                length = stock[i][0][0]
                lengths[length] = lengths.get(length, 0) + 1
                stock[i][0][1] -= run
                if not stock[i][0][1]:
                    stock[i].pop(0)
            patterns.append((run, sorted(lengths.items(), reverse=True)))
            times -= run
    return patterns


def _best_fit(counts: np.ndarray, small: int, patterns: list[Pattern], sequence: int) -> list[Pattern]:
    """Put the small lengths, longest first, where the gap is smallest; open sequences when no gap is left."""
    by_gap: dict[int, list[Pattern]] = {}

    def keep(pattern: Pattern) -> None:
        if pattern[0]:
            by_gap.setdefault(sequence - sum(length * c for length, c in pattern[1]), []).append(pattern)

    for pattern in patterns:
        keep(pattern)
    for length in range(small, 0, -1):
        left = int(counts[length])
        for gap in sorted(g for g in by_gap if g >= length):
            while left and by_gap[gap]:
                times, held = by_gap[gap].pop()
                each = min(gap // length, left)
                filled = min(times, left // each)
                keep((filled, [*held, (length, each)]))
                keep((times - filled, held))
                left -= filled * each
                if filled < times and left:  # the last one takes what is left
                    times, held = by_gap[gap].pop()
                    keep((1, [*held, (length, left)]))
                    keep((times - 1, held))
                    left = 0
            if not by_gap[gap]:
                del by_gap[gap]
            if not left:
                break
        if left:
            each = sequence // length
            keep((left // each, [(length, each)]))
            if left % each:
                keep((1, [(length, left % each)]))
    return [p for gap in sorted(by_gap) for p in by_gap[gap]]


def plan(counts: np.ndarray, sequence: int = SEQUENCE, groups: int = GROUPS) -> list[Pattern]:
    """Patterns that hold ``counts[length]`` pieces of each length, by linear grouping."""
    small = int(sequence * SMALL)
    grouped = _groups(counts, small, groups)
    return _best_fit(counts, small, _substitute(grouped, _configure(grouped, sequence)), sequence)


def _places(patterns: list[Pattern], sequence: int) -> np.ndarray:
    """Rows (length, first number, first sequence, pieces in each, offset), by length and number."""
    numbered, rows, first = np.zeros(sequence + 1, np.int64), [], 0
    for times, held in patterns:
        offset = 0
        for length, c in held:
            rows.append((length, numbered[length], first, c, offset))
            numbered[length] += times * c
            offset += length * c
        first += times
    made = np.array(rows, np.int64).reshape(-1, 5)
    return made[np.lexsort((made[:, 1], made[:, 0]))]


def pack(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces with their sequence_id and offset. ``cut`` should be a written table, as it is read twice.

    The driver and what is broadcast hold a row for each length, whatever the table and its partitions.
    """
    spark = cut.sparkSession
    parts = max(LEAST_PARTS, shuffle_partitions(spark))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counted = materialize(dealt.groupBy("length", "part").count(), "piece_counts")
    counts = np.zeros(sequence + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``sequence`` rows
        counts[r.length] = r.n
    shared = spark.sparkContext.broadcast(_places(plan(counts, sequence), sequence))

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        places = shared.value
        starts = np.searchsorted(places[:, 0], np.arange(sequence + 2))
        keys = places[:, 0] << 44 | places[:, 1]
        for length, number in batches:
            length, number = length.to_numpy(), number.to_numpy()
            at = np.maximum(np.searchsorted(keys, length << 44 | number, side="right") - 1, starts[length])
            k = number - places[at, 1]
            yield pd.DataFrame({
                "sequence_id": places[at, 2] + k // places[at, 3],
                "offset": places[at, 4] + k % places[at, 3] * length,
            })

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = counted.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("row", F.row_number().over(order)).join(before, ["length", "part"])
    placed = numbered.withColumn("place", place("length", F.col("before") + F.col("row") - 1))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def op3_best_fit_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(materialize(pieces(docs, tokenizer), "pieces"))
