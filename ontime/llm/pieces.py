"""SentencePiece encoding and decoding of merge-type vocabularies by agenda.

A text is normalised (blanks become the vocabulary's blank sign, one goes in front) and
cut into chunks where no piece of the vocabulary reaches across, which is verified when
the vocabulary is read. A chunk starts as its characters. Adjacent symbols whose
concatenation is a piece stand on an agenda by score, the leftmost first among
equal ones; its head is merged and the new symbol's pairs enter, until the agenda is empty. Short
chunks keep their agendas as rows of one array, and all rows take their heads at
once; long ones use a heap. What is no piece at the end becomes its bytes.

Workers remember the ids of chunks. Each chunk that a worker merges is also encoded by
the sentencepiece library, a batch at a time, and a difference fails the job. Ids and
decoded texts equal the library's.

Null and empty texts have no ids. Rows that repeat are encoded each. A run without blanks
is the unit of memory; all else is bounded.
"""

import bisect
import codecs
import functools
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from ontime.llm.common import blocks, body

BLANK = "▁"
BLOCK_CHARS = 1_000_000  #: characters that a task splits at once
ROW_CHARS, ROWS = 32, 8192  #: characters of a chunk whose agenda is a row, and rows of an array
CACHED_CHARS = 64  #: of a chunk that is remembered
CACHE_CHUNKS = 400_000  #: chunks that a worker remembers, twice

_RAW = 1 << 21  # a character that is no piece is the symbol of its code point above this
_NONE = 1 << 30  # the place on the agenda of a pair that doesn't merge
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """Pieces and scores of a model, given as the bytes of its file."""

    def __init__(self, proto: bytes):
        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        trainer, normal = model.trainer_spec, model.normalizer_spec
        kinds = [p.type for p in model.pieces]
        fits = trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
        plain = normal.escape_whitespaces and not normal.precompiled_charsmap and not normal.remove_extra_whitespaces
        if not (fits and plain and set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}):
            raise ValueError("this isn't a merge-type vocabulary with bytes and without rules of its own")
        self.prefix = BLANK if normal.add_dummy_prefix else ""
        normal.add_dummy_prefix = False
        self.bare = model.SerializeToString()  # the same model, for chunks as they are
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(BLANK in piece.lstrip(BLANK) for piece in ids):
            raise ValueError("a piece reaches across blanks")
        self.byte_ids = [0] * 256
        self.bytes_of, self.leads = [], np.zeros(len(kinds), bool)  # whether a piece starts with a blank
        for i, p in enumerate(model.pieces):
            self.leads[i] = p.type == _NORMAL and p.piece.startswith(BLANK)
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == _UNKNOWN:
                self.bytes_of.append(trainer.unk_surface.encode())
            else:
                self.bytes_of.append(p.piece.replace(BLANK, " ").encode() if p.type == _NORMAL else b"")
        self.control = np.array([k == _CONTROL for k in kinds])

        self.symbol = np.arange(_RAW, _RAW + 0x110000, dtype=np.int64)  # by code point
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        _, place = np.unique([-p.score for p in model.pieces], return_inverse=True)
        self.place = np.append(place, _NONE)  # on the agenda by id; the last is that of no piece

        def symbol(part: str) -> int:
            return ids.get(part, _RAW + ord(part) if len(part) == 1 else -1)

        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left >= 0 and right >= 0:
                    pairs[left << 22 | right] = i
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        known = set("".join(ids))
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in known and chr(c) != " ")
        self.split = re.compile(f"[{lone}]|{BLANK}*[^{BLANK}{lone}]+|{BLANK}+" if lone else f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces of pairs of symbols, -1 where there is none or a symbol is -1."""
        key = np.where((left < 0) | (right < 0), -1, left << 22 | right)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], -1)

    def ids(self, symbols: list[int]) -> list[int]:
        """The ids of symbols, with bytes for characters that are no pieces."""
        out = []
        for s in symbols:
            out += [s] if s < _RAW else [self.byte_ids[b] for b in chr(s - _RAW).encode()]
        return out

    def merge_rows(self, chunks: list[str]) -> list[bytes]:
        """The ids of short chunks: each row's agenda head is merged at the same time."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        width = int(sizes.max()) + 1
        at = np.arange(width)
        symbols = np.full((len(chunks), width), -1, np.int64)
        symbols[at < sizes[:, None]] = self.symbol[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        final = symbols.copy()
        alive = np.arange(len(chunks))
        made = self.made(symbols[:, :-1], symbols[:, 1:])
        agenda = self.place[made]
        while len(alive):
            head = agenda.argmin(1)
            row = np.arange(len(alive))
            going = agenda[row, head] < _NONE
            if not going.all():
                final[alive[~going]] = symbols[~going]
                alive, symbols, made, agenda, head = alive[going], symbols[going], made[going], agenda[going], head[going]
                row = np.arange(len(alive))
                if not len(alive):
                    break
            symbols[row, head] = made[row, head]
            after = at > head[:, None]
            symbols = np.where(after, np.append(symbols[:, 1:], np.full((len(alive), 1), -1), 1), symbols)
            made = np.where(after[:, :-1], np.append(made[:, 1:], np.full((len(alive), 1), -1), 1), made)
            made[row, head] = self.made(symbols[row, head], symbols[row, head + 1])
            before = np.flatnonzero(head > 0)
            made[before, head[before] - 1] = self.made(symbols[before, head[before] - 1], symbols[before, head[before]])
            agenda = self.place[made]
        counts = (final >= 0).sum(1)
        ends = np.cumsum(counts)
        flat = final[final >= 0]
        raw = flat >= _RAW
        whole, ends = flat.astype("<i4").tobytes(), ends.tolist()
        out = [whole[4 * (b - n) : 4 * b] for b, n in zip(ends, counts.tolist(), strict=True)]
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(raw), side="right")).tolist():
            out[i] = array("i", self.ids(flat[ends[i] - counts[i] : ends[i]].tolist())).tobytes()
        return out

    def merge_long(self, chunk: str) -> bytes:
        """The ids of a chunk of any length: the agenda is a heap."""
        symbols = self.symbol[np.frombuffer(chunk.encode("utf-32-le"), "<u4")].tolist()
        size, place, pairs = len(symbols), self.place.tolist(), self.pairs
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = []

        def enter(i: int) -> None:
            if i >= 0 and after[i] < size:
                piece = pairs.get(symbols[i] << 22 | symbols[after[i]])
                if piece is not None:
                    heapq.heappush(agenda, (place[piece], i, symbols[i], symbols[after[i]], piece))

        for i in range(size - 1):
            enter(i)
        while agenda:
            _, i, left, right, piece = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= size or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = piece, -1, after[j]
            if after[j] < size:
                before[after[j]] = i
            enter(before[i])
            enter(i)
        return array("i", self.ids([s for s in symbols if s >= 0])).tobytes()


class Codec:
    """Texts to ids, as little-endian 32-bit integers, and back; what is merged is checked against the library."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known, self.before = vocabulary, {}, {}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.bare)

    def merge(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of different chunks, checked against the library."""
        chunks = sorted(chunks, key=len)
        n_rows = bisect.bisect_right(chunks, ROW_CHARS, key=len)
        out: list[bytes] = []
        for at in range(0, n_rows, ROWS):
            out += self.vocabulary.merge_rows(chunks[at : min(at + ROWS, n_rows)])
        out += map(self.vocabulary.merge_long, chunks[n_rows:])
        theirs = self.library.encode(chunks, num_threads=1)
        if array("i", chain.from_iterable(theirs)).tobytes() != b"".join(out) or [4 * len(x) for x in theirs] != list(map(len, out)):
            wrong = next(c for c, ids, x in zip(chunks, out, theirs, strict=True) if array("i", x).tobytes() != ids)
            raise AssertionError(f"the library gives other ids for {wrong!r}")
        return dict(zip(chunks, out, strict=True))

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Remember the ids of the chunks; of too many, those not seen since the last time go. Gives the ids of those too long to remember."""
        short = {c for c in chunks if len(c) <= CACHED_CHARS}
        new = short.difference(self.known)
        if len(self.known) + len(new) > CACHE_CHUNKS:
            self.before, self.known, new = self.known, {}, short
        fresh = []
        for chunk in new:
            if ids := self.before.get(chunk):
                self.known[chunk] = ids
            else:
                fresh.append(chunk)
        self.known.update(self.merge(fresh))
        return self.merge(list(chunks - short))

    def parts(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text, a block of it at a time, cut before a blank that follows another character."""
        whole = self.vocabulary.prefix + text.replace(" ", BLANK) if text else ""
        at = 0
        while at < len(whole):
            cut = _CUT.search(whole, at + BLOCK_CHARS) if len(whole) - at > BLOCK_CHARS else None
            end = cut.start() if cut else len(whole)
            yield self.vocabulary.split(whole[at:end])
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = []
        for block in blocks([len(t) for t in texts], BLOCK_CHARS):
            if block.stop - block.start == 1:
                out.append(b"".join(self._ids(chunks, self.learn(set(chunks))) for chunks in self.parts(texts[block.start])))
                continue
            split = [[c for part in self.parts(text) for c in part] for text in texts[block]]
            long = self.learn(set().union(*split))
            out += [self._ids(chunks, long) for chunks in split]
        return out

    def _ids(self, chunks: list[str], long: dict[str, bytes]) -> bytes:
        known = self.known
        if long:
            return b"".join(long[c] if c in long else known[c] for c in chunks)
        return b"".join(map(known.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes that are no characters become one replacement character each."""
        numbers, bytes_of = np.frombuffer(ids, "<i4"), self.vocabulary.bytes_of
        silent = np.flatnonzero(self.vocabulary.control[numbers])  # no character reaches across these
        runs = np.split(numbers, silent) if len(silent) else [numbers]
        text = "".join([b"".join(map(bytes_of.__getitem__, run.tolist())).decode("utf-8", "each_byte") for run in runs])
        first = numbers[~self.vocabulary.control[numbers]][:1] if len(silent) else numbers[:1]
        if self.vocabulary.prefix and len(first) and self.vocabulary.leads[first[0]]:
            return text[1:]  # the blank in front goes with the first piece
        return text


_CUT = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")


@functools.lru_cache(maxsize=1)
def worker_codec(proto: bytes) -> Codec:
    """This worker's codec; what it has learned serves all its tasks."""
    return Codec(Vocabulary(proto))


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each document; ``model`` is the path of a model file on the driver."""
    with open(model, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared.value)
        for batch in batches:
            ids = codec.encode(batch["text"].to_pylist())
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]), pa.int32())
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            decoded = pa.array([codec.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(ends, flat), decoded], ["doc_id", "ids", "decoded"])

    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", body().alias("text")).mapInArrow(run, f"doc_id {doc}, ids array<int>, decoded string")


def op12_piece_round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document."""
    made = encode_decode(docs, model)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
