"""Lexical search, SentencePiece pieces and centroid clustering against plain Python and the library."""

import collections
import hashlib
import heapq
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ontime.llm import centroids, pieces, retrieval
from tests.llm.conftest import EXTRA, frame, odd_texts, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- lexical search ---------------------------------------------------------


def brute_search(docs, items, best=10):
    """Counter of (item, rank, doc, score)."""
    counts = [(d, collections.Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    found = collections.Counter()
    for item, text in set(items):
        asked, scored = collections.Counter(TERM.findall(lower(text or ""))), []
        for d, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // total if total else 0
            score = sum(q * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (score, null, d) in enumerate(heapq.nsmallest(best, scored), 1):
            found[item, rank, None if null else d, -score] += 1
    return found


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, *(None for _ in EXTRA)) for i, t in rows], "item_id long, text string, " + ", ".join(f"{x} string" for x in EXTRA))


ITEMS = [
    (1, "alpha beta GAMMA1 x1 42"), (2, "password hunter2xyz"), (3, ""), (4, None), (5, "漢字かな 🙂🙂 so on so on so"), (6, "nowhere-to-be-found"),
    (7, "the the the of"), (7, "the the the of"), (8, "the the the of"), (None, "river stone"), (9, prose(1, 60)), (10, prose(51, 120)),
]


def check_search(spark, docs, items, table=None):
    made = retrieval.op11_lexical_search(frame(spark, docs) if table is None else table, items_of(spark, items))
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(made.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    got = collections.Counter(tuple(r) for r in made.collect())
    assert got == brute_search(docs, items)


def test_search_equals_brute_force(spark, odd):
    check_search(spark, odd_texts(), ITEMS, odd)


def test_search_in_many_small_trees_and_blocks(spark, monkeypatch):
    """Ties across trees and tasks, items in several blocks, texts in several parts."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 40)))) for i in range(600)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (5, docs[5][1])]
    items = [(i, " ".join(rng.choice("abcdefghijk") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 6)))) for i in range(25)]
    monkeypatch.setattr(retrieval, "ITEM_CHARS", 60)
    monkeypatch.setattr(retrieval, "SPLIT_BYTES", 7)
    check_search(spark, docs, items, frame(spark, docs).repartition(3))


def test_search_of_a_group_of_copies(spark):
    docs = [(i, "alpha beta gamma") for i in range(3000, 0, -1)] + [(5000, "alpha"), (5001, "beta beta zeta")]
    check_search(spark, docs, [(1, "alpha"), (2, "zeta alpha beta")])


def test_search_without_documents_or_items(spark, empty):
    assert retrieval.op11_lexical_search(empty, items_of(spark, ITEMS)).count() == 0
    assert retrieval.op11_lexical_search(frame(spark, [(1, None), (2, " .,")]), items_of(spark, ITEMS)).count() == 0
    assert retrieval.op11_lexical_search(frame(spark, [(1, "alpha")]), items_of(spark, [])).count() == 0


def test_no_score_exceeds_a_bound_and_subtrees_are_skipped():
    rng = np.random.default_rng(2)
    width, n = 400, 900
    topics = [rng.choice(width, 30, replace=False) for _ in range(12)]
    chosen = [np.unique(rng.choice(topics[i % 12], 18)) for i in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(c) for c in chosen])])
    rows = retrieval.Rows(ends, np.concatenate(chosen), rng.integers(1, 1_000_000, ends[-1]))
    tree = retrieval.Tree(rows, width, np.arange(width) % retrieval.GROUPS)
    keys = [(True, -i) for i in range(n)]
    dense = np.zeros((n, width), np.int64)
    dense[rows.of, rows.cols] = rows.vals
    seen = leaves = 0
    for t in range(12):
        term, weights = topics[t][:8], rng.integers(1, 20_000, 8)
        scores = dense[:, term] @ weights
        bounds, below = tree.bounds(term, weights), {}
        for node in reversed(range(len(tree.below))):
            part = tree.below[node]
            below[node] = tree.order[part[0] : part[1]] if len(part) == 3 else np.concatenate([below[c] for c in part])
            assert scores[below[node]].max() <= bounds[node]
        best = []
        seen += tree.search(term, weights, keys, best)
        leaves += sum(len(x) == 3 for x in tree.below)
        assert sorted(best, reverse=True) == sorted(((int(s), k) for s, k in zip(scores, keys, strict=True) if s > 0), reverse=True)[:10]
    assert seen < leaves / 2


# --- pieces -----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as file:
        return pieces.Vocabulary(file.read())


def test_pieces_equal_the_library(odd, library):
    expected = collections.Counter()
    for doc, text in odd_texts():
        ids = library.encode(text or "")
        back = library.decode(ids)
        expected[doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    made = pieces.op12_piece_round_trip(odd, MODEL)
    assert dict(made.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert collections.Counter(tuple(r) for r in made.collect()) == expected


def test_pieces_of_an_empty_table(empty):
    assert pieces.op12_piece_round_trip(empty, MODEL).count() == 0


def mixed_texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*"abc  \n\t▁<>/s", *"éß漢字🙂\x00\x85\xa0 ｆ", "the", "ing", "    ", "<0x41>", "<s>", "</s>", "<unk>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 90))) for _ in range(n)]


def test_pieces_of_any_characters(vocabulary, library):
    codec = pieces.Codec(vocabulary)
    texts = mixed_texts(1500) + ["a" * 3000, " " * 100, "▁ ▁▁a", " ", "\n", "漢字" * 300]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        theirs = library.encode(text)
        assert np.frombuffer(ids, "<i4").tolist() == theirs
        assert codec.decode(ids) == library.decode(theirs)


def test_pieces_in_blocks_with_a_small_cache_and_long_agendas(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 50)
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 30)
    monkeypatch.setattr(pieces, "CACHED_CHARS", 6)
    monkeypatch.setattr(pieces, "ROW_CHARS", 4)
    codec = pieces.Codec(vocabulary)
    texts = mixed_texts(300, 2) + [" ".join(mixed_texts(40, 3))]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text)


def test_decoding_any_ids(vocabulary, library):
    codec, rng = pieces.Codec(vocabulary), random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), 259, 28705, 1, 2, 0]) for _ in range(rng.randrange(8))]
        assert codec.decode(np.array(ids, "<i4").tobytes()) == library.decode(ids)


def test_a_difference_from_the_library_stops(vocabulary):
    codec = pieces.Codec(vocabulary)
    codec.vocabulary.merge_rows, kept = (lambda chunks: [b"\0\0\0\0"] * len(chunks)), codec.vocabulary.merge_rows
    try:
        with pytest.raises(AssertionError, match="library"):
            codec.encode(["some words"])
    finally:
        codec.vocabulary.merge_rows = kept


# --- centroids --------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3):
    """Counter of the rows of op13, in Python integers."""
    kept = [(v, [math.floor(64 * x) for x in e]) for v, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return collections.Counter()
    hashed = sorted((hashlib.sha256(f"1:{'' if v is None else v}".encode()).hexdigest(), x) for v, x in kept)
    centres = [x for _, x in hashed[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, x in kept:
            members[nearest(x)[1]].append(x)
        for i, xs in members.items():
            centres[i] = [sum(column) // len(xs) for column in zip(*xs, strict=True)]
    placed = [(v, *nearest(x)) for v, x in kept]
    inertia = collections.Counter()
    for _, d, i in placed:
        inertia[i] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((v, i, d, inertia[i], sum(inertia.values()), digest[i]) for v, d, i in placed)


def vectors_of(spark, rows):
    columns = [f"{x} string" for x in EXTRA if x != "label"]
    return spark.createDataFrame([(v, e, 1, *(None for _ in columns)) for v, e in rows], "vec_id long, embedding array<double>, label int, " + ", ".join(columns))


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(i % 5, 0.3, 64).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [rows[3], rows[3], (None, rows[4][1])]  # copies, repeated rows, a null id
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [1.0] * 63 + [None]), (305, [1.0] * 63 + [math.nan]), (306, [1.0] * 63 + [-math.inf])]
    return rows + [(307, [0.0] * 64), (308, [-0.001] * 64), (309, [4e6] * 64)]


@pytest.mark.parametrize("rows", [vector_rows(), vector_rows()[:5], [(1, [0.5] * 64)] * 40, [], [(1, None)]], ids=["odd", "few", "copies", "empty", "none"])
def test_clusters_equal_brute_force(spark, rows):
    made = centroids.op13_centroid_clustering(vectors_of(spark, rows).repartition(3))
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [t for _, t in made.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert collections.Counter(tuple(r) for r in made.collect()) == brute_clusters(rows)


def test_dot_products_follow_the_centroids(spark):
    state, centres = centroids.cluster(centroids.integer_vectors(vectors_of(spark, vector_rows())), k=7, rounds=4)
    for row in state.collect():
        assert row.dots == (centres @ np.array(row.x)).tolist()


def test_too_large_a_component_fails(spark):
    table = vectors_of(spark, [(1, [float(1 << 23)] + [0.0] * 63)])
    with pytest.raises(Exception, match="component is beyond"):
        centroids.integer_vectors(table).select(F.max("x")).collect()
