"""Exact ranked lexical search with sparse ball trees.

A document is the sparse vector of its impacts, one for each term of the items, an item
the vector of its term weights, and a score their inner product in 64-bit integers.
Tasks cut their documents into blocks and build a balanced tree over each. A node has the
centroid of its documents and, for each of ``GROUPS`` groups of terms, a radius: the
largest norm by which a document exceeds the centroid there. As weights aren't negative,
``q . centroid + sum(|q| in the group * radius)`` is not below any score beneath the node,
and rounding up by more than doubles can lose keeps that so. Nodes are taken best first until the
best bound is below the item's k-th score so far; leaves are scored exactly. What a task
has found serves all its later trees.

Items are processed in blocks of about ``ITEM_CHARS`` characters of different texts, so
the terms and weights that every task gets are bounded; so are the blocks of documents. One
text of an item or a document is the unit below that.

A null or empty text has no terms: such an item has no rows, and such a document no score.
Rows of items that repeat in id and text are one item; equal ids with different texts are
ranked apart. Documents that repeat are ranked each; a null doc_id comes last among
equal scores. Without documents or items there are no rows.
"""

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontime.llm.common import body
from ontime.sources.shared import materialize

BEST = 10  #: documents of an item
ITEM_CHARS = 200_000  #: about so many characters of items at once
TREE_DOCS, TREE_VALUES = 4096, 2_000_000  #: documents and vector values of a tree at most, but for a longer document
LEAF = 32  #: documents of a leaf at most
GROUPS = 256  #: of terms
SPLIT_BYTES = 4_000_000  #: of a text that are split at once
SLACK = 1e-9  #: a bound is raised by this share; sums of under a million doubles lose less

_TERM_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_BLANKED = bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in _TERM_BYTES else 0x20 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in parts, as lower-case UTF-8."""
    raw = text.encode().translate(_BLANKED)
    at = 0
    while at < len(raw):
        cut = raw.find(b" ", at + SPLIT_BYTES)
        end = len(raw) if cut < 0 else cut
        yield raw[at:end].split()
        at = end


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, term array<int>, tf array<long>): each document's number of terms, and the vocabulary's terms in it."""
    shared = docs.sparkSession.sparkContext.broadcast({word: i for i, word in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            sizes, term, tf, ends = [], [], [], [0]
            for text in batch["text"]:
                found, n = Counter(), 0
                for words in terms(text.as_py()):
                    found.update(words)
                    n += len(words)
                held = [(number[w], m) for w, m in found.items() if w in number]
                sizes.append(n)
                term += [i for i, _ in held]
                tf += [m for _, m in held]
                ends.append(len(term))
            offsets = pa.array(ends, pa.int32())
            columns = [batch["doc_id"], pa.array(sizes, pa.int64())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(*x)) for x in ((term, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return narrow.mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Rows:
    """Sparse vectors: row i has ``cols`` and ``vals`` from ``ends[i]`` to ``ends[i + 1]``."""

    def __init__(self, ends: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        self.ends, self.cols, self.vals = ends, cols, vals
        self.of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, rows: np.ndarray) -> "Rows":
        sizes = np.diff(self.ends)[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.ends[rows], sizes)
        return Rows(ends, self.cols[at], self.vals[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.vals * dense[self.cols], len(self))

    def mean(self, width: int) -> np.ndarray:
        return np.bincount(self.cols, self.vals, width) / len(self)


def _halves(rows: Rows, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers by their place between two far documents, cut in the middle."""

    def far(point: np.ndarray) -> int:
        return int(np.argmax(squares - 2 * rows.dot(point)))

    squares = np.bincount(rows.of, rows.vals.astype(float) ** 2, len(rows))
    ends = []
    point = rows.mean(width)
    for _ in range(2):
        one = rows.take(np.array([far(point)]))
        point = np.bincount(one.cols, one.vals, width)
        ends.append(point)
    order = np.argsort(rows.dot(ends[0] - ends[1]), kind="stable")
    return order[: len(order) // 2], order[len(order) // 2 :]


class Tree:
    """A ball tree over rows; leaves hold rows in its own order, ``order`` tells which they were."""

    def __init__(self, rows: Rows, width: int, group: np.ndarray):
        self.width, self.group = width, group
        self.below: list[tuple] = []  # of each node: two nodes, or first and last row of a leaf and None
        centroids, radii, order = [], [], []

        def build(part: Rows, numbers: np.ndarray) -> int:
            node = len(self.below)
            self.below.append(())
            centre = part.mean(width)
            over = np.maximum(part.vals - centre[part.cols], 0.0) ** 2
            places = part.of * GROUPS + group[part.cols]
            norms = np.sqrt(np.bincount(places, over, len(part) * GROUPS).reshape(len(part), GROUPS).max(0))
            centroids.append(centre)
            radii.append(norms)
            if len(part) <= LEAF:
                self.below[node] = (len(order), len(order) + len(part), None)
                order.extend(numbers.tolist())
            else:
                left, right = _halves(part, width)
                self.below[node] = (build(part.take(left), numbers[left]), build(part.take(right), numbers[right]))
            return node

        build(rows, np.arange(len(rows)))
        self.order = np.array(order)
        self.rows = rows.take(self.order)
        self.centroids, self.radii = np.array(centroids), np.array(radii)

    def bounds(self, term: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of each node, a number that no score below it exceeds."""
        norms = np.sqrt(np.bincount(self.group[term], weights.astype(float) ** 2, GROUPS))
        touched = np.flatnonzero(norms)
        return (self.centroids[:, term] @ weights + self.radii[:, touched] @ norms[touched]) * (1 + SLACK) + 1

    def search(self, term: np.ndarray, weights: np.ndarray, keys: list[tuple], best: list[tuple]) -> int:
        """Add the rows that belong to the best to the heap ``best`` of (score, key); gives the leaves looked at."""
        bounds = self.bounds(term, weights).tolist()
        dense = np.zeros(self.width, np.int64)
        dense[term] = weights
        agenda, seen = [(-bounds[0], 0)], 0
        while agenda:
            bound, node = heapq.heappop(agenda)
            if len(best) == BEST and -bound < best[0][0]:
                break
            below = self.below[node]
            if len(below) == 2:
                for child in below:
                    heapq.heappush(agenda, (-bounds[child], child))
                continue
            seen += 1
            first, last, _ = below
            ends = self.rows.ends[first : last + 1]
            span = slice(ends[0], ends[-1])
            scores = np.add.reduceat(dense[self.rows.cols[span]] * self.rows.vals[span], ends[:-1] - ends[0])
            least = best[0][0] if len(best) == BEST else 1
            for i in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[i]), keys[self.order[first + i]])
                if len(best) < BEST:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return seen


def _trees(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, width: int, group: np.ndarray) -> Iterator[tuple[Tree, list[tuple]]]:
    """Trees over blocks of documents that have any of the terms, and the documents' keys: later ones of equal score go first."""

    def block(ends: list[int], cols: list, vals: list) -> Tree:
        return Tree(Rows(np.array([0, *accumulate(ends)]), np.concatenate(cols), np.concatenate(vals)), width, group)

    sizes, cols, vals, keys, held = [], [], [], [], 0
    for batch in batches:
        doc, n = batch["doc_id"].to_pylist(), batch["n"].to_pylist()
        ends = batch["term"].offsets.to_numpy()
        term, tf = batch["term"].values.to_numpy(), batch["tf"].values.to_numpy()
        for i in range(len(doc)):
            a, b = ends[i], ends[i + 1]
            if a == b:
                continue
            if sizes and (len(sizes) == TREE_DOCS or held + (b - a) > TREE_VALUES):
                yield block(sizes, cols, vals), keys
                sizes, cols, vals, keys, held = [], [], [], [], 0
            m = 25 + (75 * n[i] * n_docs) // n_terms
            sizes.append(b - a)
            cols.append(term[a:b])
            vals.append(1_000_000_000 * tf[a:b] // (1000 * tf[a:b] + 8 * m))
            keys.append((doc[i] is not None, -(doc[i] or 0)))
            held += b - a
    if sizes:
        yield block(sizes, cols, vals), keys


def _ranked_block(docs: DataFrame, texts: list[str]) -> DataFrame:
    """(text_no, doc_id, score) of the best documents of each text by each task."""
    counted = [Counter(w for words in terms(text) for w in words) for text in texts]
    vocabulary = sorted(set().union(*counted))
    held = materialize(vectors(docs, vocabulary), "vectors")
    totals = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    schema = "text_no int, doc_id long, score long"
    if not totals.docs or not vocabulary:
        return docs.sparkSession.createDataFrame([], schema)
    df = {r.term: r.df for r in held.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    number = {w: i for i, w in enumerate(vocabulary)}
    items = []
    for no, words in enumerate(counted):
        pairs = [(number[w], m * weight(totals.docs, df[number[w]])) for w, m in words.items() if number[w] in df]
        if pairs:
            term, weights = np.array(pairs).T
            items.append((no, term, weights))
    group = np.arange(len(vocabulary)) % GROUPS
    shared = docs.sparkSession.sparkContext.broadcast((items, totals.docs, totals.terms, len(vocabulary), group))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, *figures = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        for tree, keys in _trees(batches, *figures):
            for (_, term, weights), heap in zip(items, best, strict=True):
                tree.search(term, weights, keys, heap)
        rows = [(no, -key[1] if key[0] else None, score) for (no, _, _), heap in zip(items, best, strict=True) for score, key in heap]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["text_no", "doc_id", "score"])

    return held.mapInArrow(search, schema)


def _two_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2")]


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, text, rank, doc_id, score): the ``BEST`` documents of each item of positive score, best first."""
    asked = items.select("item_id", body().alias("text")).distinct()
    texts = asked.select("text").distinct()
    chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_blocks = -(-chars // ITEM_CHARS)
    found = None
    for block in range(n_blocks):
        here = texts.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block)
        rows = here.select("text", *_two_hashes(F.col("text"))).orderBy("key1", "key2").collect()
        made = _ranked_block(docs, [r.text for r in rows])
        keys = docs.sparkSession.createDataFrame([(no, r.key1, r.key2) for no, r in enumerate(rows)], "text_no int, key1 long, key2 long")
        order = Window.partitionBy("text_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = made.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)
        ranked = materialize(ranked.join(F.broadcast(keys), "text_no").drop("text_no"), "ranked")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, score long, rank int, key1 long, key2 long")
    named = asked.select("item_id", "text", *_two_hashes(F.col("text")))
    return named.join(found, ["key1", "key2"]).select("item_id", "text", "rank", "doc_id", "score")


def op11_lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rank, doc_id and score of each item's ten best documents."""
    return search(docs, items).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL of op11_lexical_search, where item ids don't repeat.
OP11_SQL = r"""
with words as (
  select 'd' as kind, doc_id as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
  union all
  select 'i', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) from benchmark),
sizes as (select id, cast(count(*) as bigint) as n from words where kind = 'd' group by id),
totals as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from sizes),
freq as (select id, term, cast(count(*) as bigint) as tf from words where kind = 'd' group by id, term),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from freq, totals group by term, docs),
scored as (
  select i.id as item_id, f.id as doc_id,
    cast(sum(i.q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) as bigint) as score
  from (select id, term, count(*) as q from words where kind = 'i' group by id, term) i
  join freq f using (term) join weights using (term) join sizes s on s.id = f.id, totals
  group by i.id, f.id),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
  from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
