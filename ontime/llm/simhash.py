"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link at ``DISTANCE`` or fewer differing bits. Their 64 bits are put
in partitions, correlated bits together. If the thresholds of the partitions add
up to DISTANCE - partitions + 1, two fingerprints that link differ in some
partition by no more than its threshold. A dynamic program chooses the number of
partitions and the unequal thresholds with the least estimated work, from bit
statistics of all distinct fingerprints. Rows are probed by the values within the
threshold, candidates are verified on whole fingerprints, and components follow
by distributed union-find. Only spanning links leave a task, never all pairs.

Equal fingerprints are one node. Buckets above ``BUCKET`` rows are compared in
blocks, each pair of blocks in a group of its own; none is cut short. Null, empty
and blank texts have fingerprint zero. A null doc_id is kept; a component of null
ids only has a null component_id.
"""

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontime.llm.common import body, keep_rows, text_key
from ontime.llm.graph import components
from ontime.sources.shared import materialize

SHINGLE = 4  #: words
SEED = 42
DISTANCE = 4  #: bits
BUCKET = 20_000  #: rows of a bucket that are compared in one group
PAIRS = 1 << 21  #: pairs that a task compares at once
PROBE_COST, PAIR_COST = 2e-6, 5e-9  #: seconds of a row that is probed and of a pair that is compared


def fingerprint(text: str) -> int:
    """The text's SimHash, unsigned.

    bytes.lower() and bytes.split() know A-Z and the six ASCII spaces only, as the
    definition wants.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist(), len(joined)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    hash_of = xxhash.xxh64_intdigest
    hashes = [hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)] or [hash_of(joined, SEED)]
    bits = np.zeros(64, np.int64)
    whole = np.array(hashes, "<u8")
    for at in range(0, len(whole), 1 << 16):
        part = np.unpackbits(whole[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """The fingerprint as a signed long."""
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _sub(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of the chosen bits."""
    whole, made = fp.view(np.uint64), np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        made |= ((whole >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return made


def correlations(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the absolute correlations of their bits; 64 x 64 sums reach the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64))
        n = 0
        for batch in batches:
            x = _bits(batch["fp"].to_numpy()).astype(np.float32)
            total += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(4096), 64)
        yield pd.DataFrame({"i": i, "j": j, "c": total.ravel().astype(np.int64)})
        yield pd.DataFrame({"i": [64], "j": [64], "c": [n]})

    sums = nodes.select("fp").mapInPandas(add, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()
    whole = np.zeros((65, 65))
    whole[sums["i"], sums["j"]] = sums["c"]
    n = int(whole[64, 64])
    both = whole[:64, :64] / max(n, 1)
    p = np.diag(both)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    return n, np.abs(np.divide(both - np.outer(p, p), spread, out=np.zeros_like(both), where=spread > 1e-12))


def partitions(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the bits: each begins with the most correlated bit left and takes the bits closest to it."""
    left, made = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        part = [max(left, key=lambda b: (sum(correlation[b, x] for x in left if x != b), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (sum(correlation[b, x] for x in part), -b)))
            left.remove(part[-1])
        made.append(sorted(part))
    return made


def _blocks(part: list[int]) -> list[list[int]]:
    n = math.ceil(len(part) / 8)
    return [part[i::n] for i in range(n)]


def near_shares(nodes: DataFrame, schemes: list[list[list[int]]], distance: int) -> list[list[np.ndarray]]:
    """For each partition of each scheme, the estimated share of pairs within 0, 1, .. differing bits of it.

    Counted exactly for blocks of up to eight bits over all fingerprints, and
    put together as if the blocks were independent.
    """
    blocks = sorted({tuple(b) for scheme in schemes for part in scheme for b in _blocks(part)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(blocks), 256), np.int64)
        for batch in batches:
            fp = batch["fp"].to_numpy()
            for k, b in enumerate(blocks):
                total[k] += np.bincount(_sub(fp, b), minlength=256)
        k, v = np.nonzero(total)
        yield pd.DataFrame({"k": k, "v": v, "c": total[k, v]})

    counts = nodes.select("fp").mapInPandas(count, "k long, v long, c long").groupBy("k", "v").agg(F.sum("c").alias("c")).toPandas()
    table = np.zeros((len(blocks), 256))
    table[counts["k"], counts["v"]] = counts["c"]
    table /= np.maximum(table.sum(axis=1, keepdims=True), 1)
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256))
    exact = {b: np.array([t @ (apart == d) @ t for d in range(distance + 1)]) for b, t in zip(blocks, table, strict=True)}

    def share(part: list[int]) -> np.ndarray:
        made = np.array([1.0])
        for b in _blocks(part):
            made = np.convolve(made, exact[tuple(b)])[: distance + 1]
        return np.cumsum(np.pad(made, (0, distance + 1 - len(made))))

    return [[share(part) for part in scheme] for scheme in schemes]


def _probes(width: int, threshold: int) -> float:
    """Rows of a fingerprint in a partition: itself and half of the values around it."""
    return 0 if threshold < 0 else 1 + sum(math.comb(width, e) for e in range(1, threshold + 1)) / 2


def allocate(n: int, scheme: list[list[int]], shares: list[np.ndarray], distance: int) -> tuple[float, list[int]]:
    """The least cost and the thresholds that add up to distance - partitions + 1; -1 leaves a partition out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part, share in zip(scheme, shares, strict=True):
        grown: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                pairs = 0 if t < 0 else n * n / 2 * share[t]
                offer = (cost + n * _probes(len(part), t) * PROBE_COST + pairs * PAIR_COST, [*chosen, t])
                if total + t not in grown or offer < grown[total + t]:
                    grown[total + t] = offer
        best = grown
    return best[distance - len(scheme) + 1]


def choose(nodes: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions of the cheapest scheme of two to distance + 1 partitions."""
    n, correlation = correlations(nodes)
    schemes = [partitions(correlation, m) for m in range(2, distance + 2)]
    offers = [(*allocate(n, s, x, distance), s) for s, x in zip(schemes, near_shares(nodes, schemes, distance), strict=True)]
    _, thresholds, scheme = min(offers, key=lambda x: x[0])
    return [(part, t) for part, t in zip(scheme, thresholds, strict=True) if t >= 0]


def probes(nodes: DataFrame, scheme: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp, probe): each fingerprint under its own value of every partition, and as a probe under those around it.

    Of two values that differ, the one in which the lowest differing bit is set
    probes for the other, so a pair meets once.
    """
    masks = [[sum(1 << b for b in c) for e in range(1, t + 1) for c in itertools.combinations(range(len(bits)), e)] for bits, t in scheme]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch["fp"].to_numpy()
            for fp in np.array_split(whole, max(1, len(whole) // 2000)):
                for k, (bits, _) in enumerate(scheme):
                    own, tag = _sub(fp, bits), np.int64(k) << 56
                    yield pd.DataFrame({"key": own | tag, "fp": fp, "probe": False})
                    for block in np.array_split(np.array(masks[k], np.int64), max(1, len(masks[k]) // 64)):
                        row, col = np.nonzero(own[:, None] & (block & -block))
                        yield pd.DataFrame({"key": (own[row] ^ block[col]) | tag, "fp": fp[row], "probe": True})

    return nodes.select("fp").mapInPandas(spread, "key long, fp long, probe boolean")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between each node and its component's smallest: as connected as all links, and no more than nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _pairs_in(cells: pd.DataFrame, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of the rows of whole cells, in bounded blocks."""
    fp, probe, block = cells["fp"].to_numpy(), cells["probe"].to_numpy(), cells["block"].to_numpy()
    low, high = cells["low"].to_numpy(), cells["high"].to_numpy()
    key = cells["key"].to_numpy()
    change = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
    bounds = np.concatenate([[0], change, [len(fp)]])
    after = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(fp)) - 1  # rows of the cell that follow
    after[probe] = 0  # probes stand last in a cell and don't meet each other
    ends = np.cumsum(after)
    start = 0
    while start < len(fp):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        n = after[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= distance
        near &= (low[left] == high[left]) | (block[left] != block[right])
        if near.any():
            yield fp[left[near]], fp[right[near]]
        start = stop


def links(rows: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect what all pairs within ``distance`` of rows of a key would connect."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / bucket).alias("parts")).filter("parts > 1")
    dealt = rows.join(sizes, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp", "probe"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "probe", "fp", "block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, found = [], []

        def flush(whole: pd.DataFrame) -> None:
            for pair in _pairs_in(whole, distance):
                found.append(_forest(*pair))
                if len(found) > 64:
                    found[:] = [_forest(*map(np.concatenate, zip(*found, strict=True)))]

        for batch in batches:
            last = batch.iloc[-1] if len(batch) else None
            if last is None:
                continue
            open_ = (batch["key"] == last["key"]) & (batch["low"] == last["low"]) & (batch["high"] == last["high"])
            if not open_.all() or (held and (held[-1].iloc[-1][["key", "low", "high"]] != last[["key", "low", "high"]]).any()):
                flush(pd.concat([*held, batch[~open_]]))
                held = []
            held.append(batch[open_])
        if held:
            flush(pd.concat(held))
        if found:
            a, b = _forest(*map(np.concatenate, zip(*found, strict=True)))
            yield pd.DataFrame({"a": a, "b": b})

    placed = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "probe")
    return placed.mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_key, fp, component_id, kept) of each document.

    ``component_id`` is the smallest doc_id that links reach, and the row that has
    it is kept. Rows that repeat in doc_id and text share their decision.
    """
    prints = materialize(docs.select("doc_id", text_key().alias("text_key"), fingerprint_of(body()).alias("fp")), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    nodes = prints.groupBy("fp").agg(F.min(row).alias("first")).checkpoint()
    found = components(links(probes(nodes, choose(nodes, distance)), distance))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("best"))
    by_fp = rooted.select("fp", "root").join(named, "root").select("fp", "best")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    return prints.join(by_fp, "fp").select("doc_id", "text_key", "fp", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each component."""
    return keep_rows(docs, near_duplicates(docs, distance).filter("kept"))


def op1_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """Fingerprint in hexadecimal digits and component of each document."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
