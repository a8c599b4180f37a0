"""Fuzzy line deduplication by MinHash.

A line's character shingles are the ``WIDTH`` characters from each of its positions; a
shorter line is a shingle itself. Lines whose shingle sets have a Jaccard similarity of 0.8 or more
link; of each component of linked lines, the occurrence in the smallest doc_id (then
the first line) stays, all others go from their documents.

* Signatures are minima of independent shingle hashes. Eight bands of three minima find 99.7 % of the pairs
  at the threshold and more above it, and few others. Shingles are hashed and compared in numpy, in Arrow batches: twenty-four
  minima a shingle alone take most of the time that the whole query may take when they are aggregates of columns.
* A bucket's smallest and largest line come out of one aggregate; only buckets with more
  lines are read again. Each line is compared with the bucket's smallest. Only lines that
  aren't similar to it are compared with all others of the bucket, in blocks of ``BUCKET_ROWS`` lines and pairs of blocks, so no
  task holds more; only links that join what isn't joined yet leave a block of more than a few lines. Nothing that a bucket links is lost.
* Components follow by distributed union-find.
* Before texts or lines are shuffled to few keys, a bitmap of the keys sends most others
  away. It has ``PAGES`` pages at most however large the data, and lets through more than
  it must where it fills up; the joins behind it decide.

Lines are told apart by 128 bits of hash, their shingles by 50. Lines without a word always stay, as does a
null text; null doc_ids sort last. Rows that repeat in doc_id and text are one
document. An empty table has no rows. A bucket of n lines of which many are half alike travels n / BUCKET_ROWS times.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.llm import line_shingles as shingling
from ontime.llm.common import blocks, body, text_key
from ontime.llm.graph import components
from ontime.sources.shared import materialize

BUCKET_ROWS = 2048  #: lines of a block of a bucket
CHARS = 1 << 18  #: characters of lines whose shingles a task holds at once, or one pair's
GROUP_CHARS = 1 << 19  #: the same of each side of a large group
SEEN = 500_000  #: lines that a task remembers, so that it signs repeated ones once
PAGES, PAGE = 4096, 32_768  #: pages of a bitmap, and bits of a page (fixed by Spark)
PIECE = 2048  #: bits of a piece of a page; Spark copies a whole one to look at a bit

_ID = ["id1", "id2"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line, id1, id2) of each line with a word."""
    split = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(F.split(body(), "\n")).alias("line_no", "line"))
    worded = split.filter(F.col("line").rlike(r"\S"))
    return worded.withColumns({"id1": F.xxhash64("line"), "id2": F.xxhash64(F.lit(1), F.col("line"))})


def _marked(table: DataFrame, key: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose ``key`` may be among ``keys`` (one long column), or with "left_anti" surely isn't.

    The broadcast bitmap has 16 MB at most, in 65,536 pieces.
    """
    slot, parts = F.pmod(F.col(keys.columns[0]), F.lit(PAGES * PAGE)), PAGE // PIECE
    pages = keys.groupBy(F.shiftright(slot, PAGE.bit_length() - 1).alias("page")).agg(F.bitmap_construct_agg(slot.bitwiseAND(PAGE - 1)).alias("bits"))
    pieces = pages.select("page", "bits", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    bits = F.substring("bits", F.col("part") * (PIECE // 8) + 1, F.lit(PIECE // 8)).alias("bits")
    pieces = pieces.select((F.col("page") * parts + F.col("part")).alias("piece"), bits)
    slot = F.pmod(table[key], F.lit(PAGES * PAGE))
    bit = slot.bitwiseAND(PIECE - 1).cast("int")
    byte = F.substring(pieces["bits"], F.shiftright(bit, 3) + 1, F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")  # slow, so only of bytes that aren't empty
    is_set = (F.bitmap_count(byte) > 0) & (F.getbit(number, bit.bitwiseAND(7)) == 1)
    at = F.shiftright(slot, PIECE.bit_length() - 1)
    return table.join(F.broadcast(pieces), (at == pieces["piece"]) & is_set, how)


def signatures(lines: DataFrame) -> DataFrame:
    """(id1, id2, m0, ..): the minima of each line, 32 bits each."""
    names = [f"m{k}" for k in range(shingling.HASHES)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = shingling.minima(batch["line"].to_pylist())
            columns = [batch["id1"], batch["id2"], *(pa.array(made[:, k]) for k in range(made.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, [*_ID, *names])

    return lines.select(*_ID, "line").mapInArrow(sign, ", ".join(f"{x} long" for x in [*_ID, *names]))


def banded(lines: DataFrame) -> DataFrame:
    """(id, buckets array<long>): each line, by id1, with its buckets; a line that is met again may have several rows."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, key in enumerate(batch["id1"].to_pylist()):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            part = batch.take(pa.array(new, pa.int64()))
            made = shingling.buckets(shingling.minima(part["line"].to_pylist()))
            ends = pa.array(np.arange(len(new) + 1) * made.shape[1], pa.int32())
            columns = [part["id1"], pa.ListArray.from_arrays(ends, pa.array(made.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "buckets"])

    return lines.select("id1", "line").mapInArrow(sign, "id long, buckets array<long>")


def candidates(signed: DataFrame) -> DataFrame:
    """(bucket, id, first): lines of buckets with two or more but the smallest, and the smallest of each bucket, by id1."""
    kept = materialize(signed, "bands")
    rows = kept.select("id", F.explode("buckets").alias("bucket"))
    ends = rows.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("n"))
    ends = materialize(ends.filter("first <> last"), "ends")
    more = ends.filter("n > 2").select("bucket", "first")
    inner = _marked(rows, "bucket", more.select("bucket")).join(more, "bucket").filter("id <> first")
    return ends.filter("n = 2").select("bucket", F.col("last").alias("id"), "first").unionByName(inner.select("bucket", "id", "first").distinct())


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the two lines of each row are similar. Rows of ``CHARS`` characters are compared at once."""
    for batch in batches:
        sizes = pc.add(pc.utf8_length(batch["of_a"]), pc.utf8_length(batch["of_b"])).to_pylist()
        near = np.zeros(batch.num_rows, bool)
        for some in blocks(sizes, CHARS):
            n = some.stop - some.start
            left, right = (batch[x].slice(some.start, n).to_pylist() for x in ("of_a", "of_b"))
            near[some] = shingling.Sets(left + right).similar(np.arange(n), np.arange(n) + n)
        columns = [batch[x] for x in ("id", "first", "a1", "a2", "b1", "b2")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(near)], ["id", "first", "a1", "a2", "b1", "b2", "near"])


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows, which follow one another.

    Small groups are compared together, large ones in parts of ``GROUP_CHARS`` characters and pairs of parts.
    """
    few: list[tuple] = []  # rows of small groups, and pairs of their numbers
    pairs: list[tuple[int, int]] = []
    group, held, n_chars = None, [], 0

    def rows_of(links: list[tuple[int, int]], rows: list[tuple]) -> pa.RecordBatch:
        ends = [[rows[pair[side]][x] for pair in links] for side in (0, 1) for x in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a1", "a2", "b1", "b2"])

    def small() -> Iterator[pa.RecordBatch]:
        nonlocal n_chars
        n_chars = 0
        ends = np.array(pairs, np.int64).reshape(-1, 2)
        near = ends[shingling.Sets([r[4] for r in few]).similar(*ends.T)] if len(ends) else ends
        if len(near):
            yield rows_of(near.tolist(), few)
        few.clear()
        pairs.clear()

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal n_chars
        rows = list({r[2:4]: r for r in held}.values())
        block, far = [r[0] for r in rows], [r[1] for r in rows]
        size = sum(len(r[4]) for r in rows)
        if len(rows) <= shingling.FEW and size <= CHARS:
            if n_chars + size > CHARS or len(few) > BUCKET_ROWS:
                yield from small()
            n_chars += size
            pairs.extend((len(few) + i, len(few) + j) for i, j in shingling.few_pairs(block, far))
            few.extend(rows)
        else:
            yield from large(rows, len(set(block)) > 1)

    def large(rows: list[tuple], two: bool) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in rows if r[0] == x] for x in sorted({r[0] for r in rows})]
        parts = [side[x] for side in sides for x in blocks([len(r[4]) for r in side], GROUP_CHARS)]
        for i, part in enumerate(parts):
            for j, other in enumerate(parts[i:], i):
                if two and part[0][0] == other[0][0]:
                    continue
                both = part + other if j > i else part
                side = [0] * len(part) + [1] * (len(both) - len(part))
                far = [r[1] for r in both]
                found = shingling.group_links(shingling.Sets([r[4] for r in both]), side, far) if any(far) else []
                if found:
                    yield rows_of(found, both)

    for batch in batches:
        keys = zip(*(batch[x].to_pylist() for x in ("bucket", "low", "high")), strict=True)
        rows = zip(*(batch[x].to_pylist() for x in ("block", "far", "id1", "id2", "line")), strict=True)
        for key, row in zip(keys, rows, strict=True):
            if key != group:
                if held:
                    yield from done()
                held, group = [], key
            held.append(row)
    if held:
        yield from done()
    yield from small()


def links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): verified links of lines, as (id1, id2). ``texts`` has (id1, id2, line) of all members and firsts."""
    of_id = texts.select(F.col("id1").alias("id"), F.col("id1").alias("a1"), F.col("id2").alias("a2"), F.col("line").alias("of_a"))
    of_first = texts.select(F.col("id1").alias("first"), F.col("id1").alias("b1"), F.col("id2").alias("b2"), F.col("line").alias("of_b"))
    pairs = members.select("id", "first").distinct().join(of_id, "id").join(of_first, "first")
    judged = pairs.mapInArrow(_judge, "id long, first long, a1 long, a2 long, b1 long, b2 long, near boolean")
    judged = materialize(judged, "judged")

    far = judged.filter(~F.col("near")).select("id", "first").distinct().withColumn("far", F.lit(True))
    held = members.join(far, ["id", "first"], "left").select("bucket", "id", F.coalesce("far", F.lit(False)).alias("far"))
    held = materialize(held, "held")
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far")).filter("n_far > 0 and n > 1")
    blocks = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    placed = held.join(sizes.select("bucket", blocks.alias("blocks")), "bucket")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    grouped = placed.select("bucket", *ends, "block", "far", "id").join(texts.withColumnRenamed("id1", "id"), "id")
    grouped = grouped.select("bucket", "low", "high", "block", "far", F.col("id").alias("id1"), "id2", "line")
    grouped = grouped.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    met = grouped.mapInArrow(_link_groups, "a1 long, a2 long, b1 long, b2 long")
    both = judged.filter("near").select("a1", "a2", "b1", "b2").union(met)
    return both.select(*(F.struct(F.col(f"{x}1").alias("id1"), F.col(f"{x}2").alias("id2")).alias(x) for x in "ab"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no) of the lines that go."""
    lines = _lines(docs)
    members = materialize(candidates(banded(lines)), "buckets")
    wanted = members.select("id").union(members.select("first"))
    texts = _marked(lines, "id1", wanted).groupBy(*_ID).agg(F.first("line").alias("line"))
    rooted = components(links(members, materialize(texts, "texts")))

    rooted = rooted.select(F.col("node.id1").alias("id1"), F.col("node.id2").alias("id2"), "root")
    found = lines.select(*_ID, "doc_id", "text_key", "line_no").join(rooted, _ID, "left")
    root = [F.coalesce(F.col(f"root.{x}"), F.col(x)).alias(f"r{x[2]}") for x in _ID]
    found = materialize(found.select(*root, "doc_id", "text_key", "line_no"), "lines")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "line_no")
    stays = materialize(found.groupBy("r1", "r2").agg(F.min(place).alias("stays"), F.count("*").alias("n")).filter("n > 1"), "stays")
    gone = _marked(found, "r1", stays.select("r1")).join(stays, ["r1", "r2"]).filter(place != F.col("stays"))
    return gone.select("doc_id", "text_key", "line_no")


def drop_similar_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of each document, without the lines that go."""
    gone = dropped_lines(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    gone = materialize(gone.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "gone"), "gone")
    keyed = docs.select("doc_id", "text", text_key().alias("own_key"))
    hit = _marked(keyed, "own_key", gone.select("key"))
    hit = hit.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own_key") == F.col("key")), "left").select("doc_id", "text", "gone")
    miss = _marked(keyed, "own_key", gone.select("key"), "left_anti").select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone"))
    lines = F.split("text", "\n")
    rest = F.filter(lines, lambda line, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    sizes = [F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long") for x in (lines, F.col("gone"))]
    return hit.union(miss).select("doc_id", text.alias("text"), sizes[0].alias("n_lines"), sizes[1].alias("n_dropped"))


def op9_fuzzy_line_dedup(docs: DataFrame) -> DataFrame:
    """Lines, dropped lines and the digest of the text that is left of each document."""
    made = drop_similar_lines(docs)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return made.select("doc_id", "n_lines", "n_dropped", digest)
