"""Exact deduplication with a cuckoo-filter index.

Texts are equal if they are the same without ASCII white space. Spark deals the
digests of the normalised texts; each task holds the live ones of its share in a
cuckoo filter: four short fingerprints a bucket, two buckets a digest. A hit is
verified against the digests that the bucket stores. A longer row of the same text
replaces the live one by deletion and insertion. If an insertion finds no place,
the filter doubles and is filled again from the stored keys.

A task first collapses the copies in its own input, so a text that a third of all
rows have reaches the next shuffle as one row a task. Null counts as empty. A null
doc_id sorts last. An empty table has no rows.
"""

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import body, keep_rows, shuffle_partitions, text_key
from ontime.sources.shared import materialize

SPACES = " \t\n\x0b\x0c\r"
SLOTS = 4  #: fingerprints a bucket
KICKS = 200  #: moves before an insertion counts as an overflow
LIVE_MOST = 500_000  #: digests that a collapsing task holds before it hands them on


class CuckooIndex:
    """Live digests, each with a record: insert, find and delete.

    ``prints`` holds the fingerprints by bucket (0: free) and ``content`` the digest
    of each slot. Only buckets whose fingerprint matches are compared with content.
    """

    def __init__(self, buckets: int = 1 << 10):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.content: list[bytes | None] = [None] * (buckets * SLOTS)
        self.record: list[tuple | None] = [None] * (buckets * SLOTS)

    def __len__(self) -> int:
        return len(self.prints) - self.prints.count(0)

    def _print_and_bucket(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:2], "little") or 1, int.from_bytes(digest[2:10], "little") & self.mask

    def _other(self, print_: int, bucket: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int:
        """The digest's slot, or -1."""
        print_, bucket = self._print_and_bucket(digest)
        for b in (bucket, self._other(print_, bucket)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[slot] == print_ and self.content[slot] == digest:
                    return slot
        return -1

    def delete(self, digest: bytes) -> bool:
        """Whether the digest was live."""
        slot = self.find(digest)
        if slot >= 0:
            self.prints[slot], self.content[slot], self.record[slot] = 0, None, None
        return slot >= 0

    def insert(self, digest: bytes, record: tuple) -> None:
        """Add a digest that isn't live."""
        print_, bucket = self._print_and_bucket(digest)
        held = (print_, digest, record)
        for b in (bucket, self._other(print_, bucket)):
            if self._put(b, held):
                return
        for kick in range(KICKS):
            slot = bucket * SLOTS + (kick + held[0]) % SLOTS
            out = (self.prints[slot], self.content[slot], self.record[slot])
            self.prints[slot], self.content[slot], self.record[slot] = held
            held, bucket = out, self._other(out[0], bucket)
            if self._put(bucket, held):
                return
        self._grow(held)

    def _put(self, bucket: int, held: tuple) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.prints[slot]:
                self.prints[slot], self.content[slot], self.record[slot] = held
                return True
        return False

    def _grow(self, held: tuple) -> None:
        """Double the buckets and insert all stored keys again."""
        live = [*self.items(), held[1:]]
        self._clear(2 * (self.mask + 1))
        for digest, record in live:
            self.insert(digest, record)

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        return ((d, r) for d, r in zip(self.content, self.record, strict=True) if d is not None)


_GROUP = "digest binary, n_chars long, keep_id long, keep_key long, rows long"
_ARROW = pa.schema([("digest", pa.binary()), ("n_chars", pa.int64()), ("keep_id", pa.int64()), ("keep_key", pa.int64()), ("rows", pa.int64())])


def _order(record: tuple) -> tuple:
    """Longest, then smallest doc_id (null last), then a fixed order of the texts."""
    n_chars, doc_id, key, _ = record
    return -n_chars, doc_id is None, doc_id or 0, key


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    live = [(d, *r) for d, r in index.items()]
    for at in range(0, len(live), 50_000):
        columns = zip(*live[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def _collapse(batches: Iterator[pa.RecordBatch], most: float = LIVE_MOST, in_order: bool = False) -> Iterator[pa.RecordBatch]:
    """One row for each digest: its best row, and how many rows it stands for.

    Beyond ``most`` digests it begins anew; where rows come in the order of their digests, only between two digests,
    so that no digest has a second row.
    """
    index, held, last = CuckooIndex(), 0, None
    for batch in batches:
        for digest, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if in_order and held > most and digest != last:
                yield from _rows(index)
                index, held = CuckooIndex(), 0
            record, slot, last = tuple(row), index.find(digest), digest
            if slot < 0:
                index.insert(digest, record)
                held += 1
                continue
            live = index.record[slot]
            best = min(live, record, key=_order)
            merged = (*best[:3], live[3] + record[3])
            if best is live:
                index.record[slot] = merged
            else:
                index.delete(digest)
                index.insert(digest, merged)
        if held > most and not in_order:
            yield from _rows(index)
            index, held = CuckooIndex(), 0
    yield from _rows(index)


def _merge(batches: Iterator[pa.RecordBatch], most: float = math.inf) -> Iterator[pa.RecordBatch]:
    """The same over all rows of a task's digests; with a bound, they come in the order of their digests."""
    return _collapse(batches, most, in_order=True)


def normalised() -> Column:
    return F.translate(body(), SPACES, "")


def index(rows: DataFrame) -> DataFrame:
    """(digest, n_chars, keep_id, keep_key, rows): the live record of each digest of (digest, n_chars, doc_id, text_key)."""
    single = rows.select("digest", "n_chars", F.col("doc_id").alias("keep_id"), F.col("text_key").alias("keep_key"), F.lit(1).cast("long").alias("rows"))
    partly = single.mapInArrow(_collapse, _GROUP)
    dealt = partly.repartition(shuffle_partitions(rows.sparkSession), "digest").sortWithinPartitions("digest")
    return dealt.mapInArrow(lambda batches: _merge(batches, LIVE_MOST), _GROUP)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, keep_id, group_size, kept, digest) of each document, dropped ones too."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.unhex(F.sha2(normalised(), 256)).alias("digest"), F.char_length(body()).cast("long").alias("n_chars"))
    rows = materialize(rows, "digests")
    live = index(rows).withColumnRenamed("n_chars", "most")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key")) & (F.col("n_chars") == F.col("most"))
    return rows.join(live, "digest").select("doc_id", "text_key", "keep_id", F.col("rows").alias("group_size"), kept.alias("kept"), "digest")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The row that stays of each group of equal texts."""
    return keep_rows(docs, exact_duplicates(docs).filter("kept"))


def op8_exact_dedup(docs: DataFrame) -> DataFrame:
    """The decision on each document."""
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
with norm as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256, length(coalesce(text, '')) as n
  from documents),
best as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
    count(*) over (partition by text_sha256) as group_size
  from norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from best
"""
