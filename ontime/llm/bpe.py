"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent pre-tokens of the corpus are encoded once on the driver and
compiled into a minimal automaton whose states share prefixes and suffixes. The
number of accepted words below each edge makes a path's sum the word's rank,
under which its ids are stored. The automaton is shipped as one file that the
Python workers map into memory. Words that it lacks are merged exactly. Results
equal the tokenizers library's; special tokens in a text become their ids.

Null and empty texts have no ids. Rows that repeat are encoded each.
"""

import functools
import heapq
import json
import mmap
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontime.llm.common import blocks, body
from ontime.sources.shared import new_folder

LEXICON_WORDS = 100_000  #: at most so many words in the automaton
WORD_BYTES = 64  #: of a word in the automaton at most
BLOCK_CHARS = 1_000_000  #: characters that a task splits at once
CACHE_WORDS = 300_000  #: words that a worker remembers, twice
COUNTER_WORDS = 300_000  #: words that a counting task holds before it hands them on

_ANY = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The same up to U+024F, where letters, digits and spaces are these; re is twice as fast.
_LETTERS, _DIGITS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_SAFE_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


_EMPTY: dict[int, int] = {}
_NONE = 1 << 60  # the rank of a pair that doesn't merge


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} isn't byte-level BPE")
        stand_in, ids = _byte_alphabet(), spec["model"]["vocab"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(stand_in[c] for c in word) for word, i in ids.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.specials.items()}
        self.id_of_byte = [ids[c] for c, _ in sorted(stand_in.items(), key=lambda x: x[1])]
        self.made = [ids[a + b] for a, b in pairs]  # by rank
        self.ranks = [_EMPTY] * (max(ids.values()) + 1)  # by left id: rank by right id
        for rank, (a, b) in enumerate(pairs):
            if self.ranks[ids[a]] is _EMPTY:
                self.ranks[ids[a]] = {}
            self.ranks[ids[a]][ids[b]] = rank

    def merge(self, word: bytes) -> list[int]:
        """The ids of a pre-token: the lowest rank first, and of equal ones the leftmost."""
        ids, ranks = [self.id_of_byte[b] for b in word], self.ranks
        if len(ids) > 64:
            return self._merge_long(ids)
        found = [ranks[a].get(b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]  # of each pair
        while found:
            best = min(found)
            if best == _NONE:
                break
            i = found.index(best)
            ids[i] = new = self.made[best]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = ranks[ids[i - 1]].get(new, _NONE)
            if i < len(found):
                found[i] = ranks[new].get(ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids) and (rank := self.ranks[ids[i]].get(ids[j], _NONE)) != _NONE:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


class Lexicon:
    """The automaton: int32 arrays in one file, mapped into memory.

    Edges are sorted by (state, byte); ``skip`` is the number of words that sort
    before those that take the edge, so the sum along a path is the word's rank.
    """

    _PARTS = ("state", "label", "target", "skip", "final", "offset", "ids")

    def __init__(self, path: str):
        with open(path, "rb") as file:
            whole = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), "<i4")
        ends = np.cumsum(whole[: len(self._PARTS)]) + len(self._PARTS)
        parts = dict(zip(self._PARTS, np.split(whole, ends)[:-1], strict=False))
        parts["state"] = parts["state"][len(self._PARTS) :]
        self.__dict__ |= parts
        self.keys = self.state.astype(np.int64) << 8 | self.label

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> bytes:
        """The file of the minimal automaton of the words, which are added in sorted order."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, target), ..))

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path_nodes, last, ordered = [[False, []]], b"", sorted(words)
        for word in [*ordered, b""]:
            same = len(os.path.commonprefix([word, last]))
            for i in range(len(last), same, -1):  # what the new word doesn't share is final
                target = settle(path_nodes.pop())
                path_nodes[-1][1].append((last[i - 1], target))
            if word:
                path_nodes += [[False, []] for _ in word[same:]]
                path_nodes[-1][0] = True
                last = word
        root = settle(path_nodes[0])
        below = [0] * len(states)
        rows = []
        for s, (final, edges) in enumerate(states):  # targets come before their sources
            skip = int(final)
            for byte, target in edges:
                rows.append((s, byte, target, skip))
                skip += below[target]
            below[s] = skip
        edges = np.array(rows, "<i4").reshape(-1, 4)
        ids = [words[w] for w in ordered]
        offset = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
        final = np.array([*(f for f, _ in states), root], "<i4")  # the root stands last
        parts = [*edges.T, final, offset, np.array([x for y in ids for x in y])]
        head = np.array([len(x) for x in parts])
        return b"".join(np.ascontiguousarray(part, "<i4").tobytes() for part in (head, *parts))

    def rank(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, -1 for those that aren't in it; all words step together."""
        rank = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return rank
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        alive = np.flatnonzero(sizes > 0)
        state, total, at = np.full(len(alive), self.final[-1], np.int64), np.zeros(len(alive), np.int64), 0
        while len(alive):
            key = state << 8 | flat[starts[alive] + at]
            edge = np.searchsorted(self.keys, key)
            edge[edge == len(self.keys)] = 0
            on = self.keys[edge] == key
            alive, edge = alive[on], edge[on]
            state, total, at = self.target[edge].astype(np.int64), total[on] + self.skip[edge], at + 1
            ended = sizes[alive] == at
            accepted = ended & (self.final[state] == 1)
            rank[alive[accepted]] = total[accepted]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
        return rank

    def ids_of(self, rank: int) -> bytes:
        return self.ids[self.offset[rank] : self.offset[rank + 1]].tobytes()


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None = None):
        self.merges, self.lexicon, self.known, self.before = merges, lexicon, {}, {}
        self.ids_of_special = {x.encode(): np.array([i], "<u4").tobytes() for x, i in merges.specials.items()}
        self.special = re.compile("|".join(map(re.escape, merges.specials)) or r"(?!)")

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        return (_ANY if _BEYOND_LATIN.search(text) else _LATIN).findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in parts of about a block, cut where pre-tokens end, and whether a part is a special token."""
        at = 0
        for found in [*self.special.finditer(text), None]:
            stop = found.start() if found else len(text)
            while at < stop:
                cut = _SAFE_CUT.search(text, at + BLOCK_CHARS, stop) if stop - at > BLOCK_CHARS else None
                end = cut.start() if cut else stop
                yield text[at:end], False
                at = end
            if found:
                yield found[0], True
                at = found.end()

    def learn(self, words: set[str]) -> None:
        """Remember the ids of the words; when too many are remembered, those not seen since the last time go."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.before, self.known, new = self.known, {}, words
        fresh = []
        for word in new:
            if ids := self.before.get(word):
                self.known[word] = ids
            else:
                fresh.append(word)
        raw = [w.encode() for w in fresh]
        ranks = self.lexicon.rank(raw).tolist() if self.lexicon else [-1] * len(raw)
        merge = self.merges.merge
        for word, each, rank in zip(fresh, raw, ranks, strict=True):
            self.known[word] = self.lexicon.ids_of(rank) if rank >= 0 else array("I", merge(each)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        made: list[bytes] = []
        for block in blocks([len(t) for t in texts], BLOCK_CHARS):
            if block.stop - block.start == 1 and len(texts[block.start]) > BLOCK_CHARS:
                made.append(b"".join(self._encode_part(*part) for part in self.parts(texts[block.start])))
                continue
            split = [[([part], True) if special else (self.split(part), False) for part, special in self.parts(t)] for t in texts[block]]
            self.learn(set().union(*(words for parts in split for words, special in parts if not special)))
            for parts in split:
                made.append(b"".join(self.ids_of_special[words[0].encode()] if special else b"".join(map(self.known.__getitem__, words)) for words, special in parts))
        return made

    def _encode_part(self, part: str, special: bool) -> bytes:
        if special:
            return self.ids_of_special[part.encode()]
        words = self.split(part)
        self.learn(set(words))
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.merges.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


_encoders: dict[tuple, Encoder] = {}


def worker_encoder(shared, lexicon: str | None = None) -> Encoder:
    """This worker's encoder; what it has learned serves all its tasks."""
    key = (shared.value.key, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, _lexicon(lexicon) if lexicon else None)
    return _encoders[key]


def share_merges(spark: SparkSession, path: str):
    """The tokenizer's tables as a broadcast; they are as large as its file."""
    merges = Merges(path)
    merges.key = path
    return spark.sparkContext.broadcast(merges)


def word_counts(docs: DataFrame, shared) -> DataFrame:
    """(word, n) of all pre-tokens of all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, counter = worker_encoder(shared), Counter()
        for batch in batches:
            for text in batch["text"]:
                for part, special in split.parts(text):
                    if not special:
                        counter.update(split.split(part))
                if len(counter) > COUNTER_WORDS:
                    yield pd.DataFrame(counter.items(), columns=["word", "n"])
                    counter.clear()
        yield pd.DataFrame(counter.items(), columns=["word", "n"])

    counted = docs.select(body().alias("text")).mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """Words by count, no more than ``most``: those above the smallest count that leaves so few.

    The number of words of each count is summed first, so that no more than
    ``most`` words ever reach the driver. Words of more than ``WORD_BYTES`` are left
    to the exact merge, so their bytes are bounded too.
    """
    counts = counts.filter(F.octet_length("word") <= WORD_BYTES).persist()
    least, kept = None, 0
    ladder = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).count().orderBy(F.desc("step")).collect()
    for row in ladder:
        if kept + row["count"] > most:
            break
        least, kept = row["step"], kept + row["count"]
    words = [] if least is None else [r.word for r in counts.filter(F.floor(F.log2("n") * 16) >= least).select("word").collect()]
    counts.unpersist()
    return words


def share_lexicon(spark: SparkSession, merges: Merges, words: list[str]) -> str:
    """Compile the words, hand the file to all workers by way of the shared folder, and return its name."""
    context, made = spark.sparkContext, Lexicon.build({w.encode(): merges.merge(w.encode()) for w in words})
    folder = new_folder(spark, "lexicon")
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{os.path.basename(folder)}.bin")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(made))
    out.close()
    context.addFile(path.toString())
    return path.getName()


def encode_decode(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids binary, decoded string) of each document.

    ``ids`` are little-endian unsigned 32-bit integers; ``decoded`` is the text of the
    ids. ``tokenizer`` is the path of a byte-level BPE file on the driver.
    """
    spark = docs.sparkSession
    shared = share_merges(spark, tokenizer)
    lexicon = share_lexicon(spark, shared.value, frequent_words(word_counts(docs, shared), lexicon_words))

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(shared, lexicon)
        for texts in batches:
            ids = encoder.encode(texts.tolist())
            yield pd.DataFrame({"ids": ids, "decoded": [encoder.decode(x) for x in ids]})

    return docs.select("doc_id", run(body()).alias("made")).select("doc_id", "made.ids", "made.decoded")


def op2_bpe_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document."""
    made = encode_decode(docs, tokenizer)
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
