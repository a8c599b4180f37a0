"""Near duplicates, line deduplication, classifiers, the pipeline, and all operators on empty and odd tables."""

import collections
import itertools
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import duck
from ontime.llm import exact, language, line_dedup, line_shingles, quality_model, quality_rules, queries, simhash
from ontime.llm.graph import components
from tests.llm.conftest import frame, odd_texts, prose

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def roots(nodes, pairs):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    assert got == roots({x for p in pairs for x in p}, pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_components(rows, fps):
    by_fp = collections.defaultdict(list)
    for (doc, _), fp in zip(rows, fps, strict=True):
        by_fp[fp].append(doc)
    pairs = [(a, b) for a, b in itertools.combinations(by_fp, 2) if (a ^ b).bit_count() <= 4]
    label, first = roots(by_fp, pairs), {}
    for fp, docs in by_fp.items():
        known = [d for d in docs if d is not None]
        if known:
            first[label[fp]] = min([*known, first.get(label[fp], known[0])])
    return collections.Counter((doc, first.get(label[fp])) for (doc, _), fp in zip(rows, fps, strict=True))


def test_near_duplicates(spark, odd):
    rows = odd_texts()
    got = simhash.op1_simhash_near_dedup(odd).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == expected_components(rows, [simhash.fingerprint(t or "") for _, t in rows])
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    flags = simhash.near_duplicates(odd).filter("kept").dropDuplicates(["doc_id", "text_key"])
    assert kept.count() == flags.count()


@pytest.mark.parametrize("bucket", [4, 20_000])
@pytest.mark.parametrize("scheme", [None, [(list(range(0, 32)), 1), (list(range(32, 64)), 2)], [(list(range(0, 64, 4)), 2), (list(range(1, 64, 4)), 0), (list(range(2, 64, 4)), 0)]])
def test_links_lose_nothing(spark, bucket, scheme):
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 1 << 63, 25)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(12):
            fps.add(int(c) ^ sum({1 << int(b) for b in rng.integers(0, 63, rng.integers(1, 7))}))
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    chosen = scheme or simhash.choose(nodes)
    assert sum(t for _, t in chosen) + (0 if not scheme else 0) >= 0
    got = {r.node: r.root for r in components(simhash.links(simhash.probes(nodes, chosen), 4, bucket)).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4]
    assert {f: got.get(f, f) for f in fps} == roots(fps, pairs)


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(12)
    scheme = simhash.partitions(np.abs(rng.normal(size=(64, 64))), 3)
    assert sorted(b for part in scheme for b in part) == list(range(64))
    shares = [np.sort(rng.random(5)) * 1e-4 for _ in scheme]
    n = 50_000

    def cost(ts):
        return sum(n * simhash._probes(len(p), t) * simhash.PROBE_COST + (0 if t < 0 else n * n / 2 * s[t] * simhash.PAIR_COST) for p, s, t in zip(scheme, shares, ts, strict=True))

    best, thresholds = simhash.allocate(n, scheme, shares, 4)
    assert sum(thresholds) == 4 - 3 + 1
    assert best == pytest.approx(min(cost(t) for t in itertools.product(range(-1, 5), repeat=3) if sum(t) == 2))


def similar_lines(rows):
    """(doc, line_no) of the lines that go, by all pairs."""
    lines = [(d is None, d, k, line) for d, t in rows for k, line in enumerate((t or "").split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", line)]
    sets = {x[3]: {m[1] for m in re.finditer(r"(?<![^ \t\n\x0b\f\r])(?=([^ \t\n\x0b\f\r].{0,7}))", x[3])} for x in lines}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label, seen, gone = roots(sets, pairs), set(), []
    for _, d, k, line in sorted(lines, key=lambda x: (x[0], x[1] or 0, x[2])):
        if label[line] in seen:
            gone.append((d, k))
        seen.add(label[line])
    return gone


def test_line_dedup(spark):
    base = prose(20, 40, 1)
    words = base.split()
    rows = [(k, "\n".join([prose(100 + k, 30, 1), " ".join([*words[:k], "changed", *words[k + 1 :]]), "short", ""])) for k in range(30)]
    rows += [(50, None), (51, ""), (52, " \n\t"), (53, base + "\n" + base), (60, "one line"), (61, "one  line"), (None, "short\nvery last")]
    table = frame(spark, rows)
    expected = collections.Counter(d for d, _ in similar_lines(rows))
    got = line_dedup.op9_fuzzy_line_dedup(table).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_dropped for r in got if r.n_dropped} == dict(expected)
    texts = {r.doc_id: r.text for r in line_dedup.drop_similar_lines(table).collect()}
    assert texts[50] is None and texts[52] == " \n\t" and texts[53] == "" and texts[0] == rows[0][1]


def full_shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def alike(a, b):
    a, b = full_shingles(a), full_shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def test_line_shingles_start_everywhere(spark):
    """Addresses, numbers, times and lines without spaces that begin alike are no copies; the first two rows' are."""
    rng = random.Random(31)
    same, kanji, emoji = "".join(rng.choices("abcdefghij", k=60)), "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(40)), "".join(chr(0x1F600 + rng.randrange(70)) for _ in range(40))
    rows = [(k, "\n".join(x + "!" * k for x in (same, kanji, emoji))) for k in range(2)]
    rows += [(10 + k, "https://" + "".join(rng.choices("abcdefghijklmnop/", k=30))) for k in range(20)]
    rows += [(40 + k, f"Order number 10000000{12 + 7 * k}") for k in range(12)] + [(60 + k, f"2024-01-{k + 10}T{k + 10}:{59 - k}:{k + 20}") for k in range(10)]
    rows += [(80 + k, kanji[:8] + "".join(chr(0x3042 + rng.randrange(80)) for _ in range(30))) for k in range(10)] + [(95, "tiny"), (96, "tiny"), (97, "tint")]
    lines = [(d, n, line) for d, text in rows for n, line in enumerate(text.split("\n"))]
    different = {x[2] for x in lines}
    label, seen, expected = roots(different, [p for p in itertools.combinations(different, 2) if alike(*p)]), set(), collections.Counter()
    for d, _, line in lines:
        expected[d] += label[line] in seen
        seen.add(label[line])
    assert expected[1] == 3 and expected[96] == 1 and expected.total() < 15
    assert {r.doc_id: r.n_dropped for r in line_dedup.op9_fuzzy_line_dedup(frame(spark, rows)).collect()} == expected


def test_line_pairs_at_the_threshold_meet(spark):
    """Of pairs with a Jaccard similarity of 0.8, the share that has a band in common, by length of line: 99.7 % expected."""
    rng, pairs, n = random.Random(32), {}, 3000
    for size in (4, 8, 16, 40):
        for k in range(n):
            line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=size + 7 + size // 4))
            pairs[size, k] = line[: size + 7], line
    assert sum(alike(a, b) for a, b in pairs.values()) > 0.999 * len(pairs)
    lines = spark.createDataFrame([(10_000 * size + k, half, line) for (size, k), pair in pairs.items() for half, line in enumerate(pair)], "id1 long, id2 long, line string")
    signed = collections.defaultdict(list)
    for r in line_dedup.signatures(lines).collect():
        signed[r.id1 // 10_000, r.id1 % 10_000].append([tuple(r[f"m{k + j}"] for j in range(3)) for k in range(0, 24, 3)])
    for size in (4, 8, 16, 40):
        met = sum(any(x == y for x, y in zip(*signed[size, k], strict=True)) for k in range(n))
        print(size, met / n)
        assert met >= 0.993 * n


def test_line_links_beyond_the_first_of_a_bucket(spark):
    """Lines that only link to each other, in a bucket whose first they don't resemble."""
    words = [f"{c}{c}{k} padding" for c in "ab" for k in range(10)]
    texts = [(1, 1, " ".join(words[:10])), (2, 1, " ".join(words[10:])), (3, 1, " ".join([*words[10:], "more"])), (4, 1, " ".join([*words[:10], "more"]))]
    members = spark.createDataFrame([(1, x, 1) for x in (2, 3, 4)], "bucket long, id long, first long")
    got = line_dedup.links(members, spark.createDataFrame(texts, "id1 long, id2 long, line string")).collect()
    assert {tuple(sorted((r.a.id1, r.b.id1))) for r in got} == {(1, 4), (2, 3)}


def test_many_lines_of_one_template(spark):
    """20,000 lines that share half of their shingles, which puts them into the same buckets, and one pair that is similar."""
    rng = random.Random(33)
    lines = ["the same words open this line, then: " + "".join(rng.choices("abcdefghijklmnop", k=36)) for _ in range(20_000)]
    lines += [lines[7] + "!", lines[7], lines[11] + "!?"]
    docs = [(k, "\n".join(lines[k * 100 : k * 100 + 100])) for k in range(201)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.op9_fuzzy_line_dedup(frame(spark, docs)).collect()}
    assert {d: n for d, n in got.items() if n} == {200: 3}


def test_links_in_groups_equal_all_pairs():
    """Small and large groups, one block and two: the same components as all pairs of which one at least is far."""
    rng = random.Random(34)
    for n in (2, 5, 8, 9, 60):
        for blocks in (1, 2):
            base = ["".join(rng.choices("abcdef", k=60)) for _ in range(3)]
            lines = []
            for _ in range(n):
                line = list(rng.choice(base))
                for _ in range(rng.randrange(4)):
                    line[rng.randrange(60)] = rng.choice("xyz")
                lines.append("".join(line))
            far, block = [rng.random() < 0.5 for _ in range(n)], [rng.randrange(blocks) for _ in range(n)]
            two = len(set(block)) > 1
            pairs = [(i, j) for i, j in itertools.combinations(range(n), 2) if (far[i] or far[j]) and not (two and block[i] == block[j]) and alike(lines[i], lines[j])]
            found = line_shingles.group_links(line_shingles.Sets(lines), block, far)
            assert {tuple(sorted(p)) for p in found} <= set(pairs) and len(found) < n
            assert roots(range(n), found) == roots(range(n), pairs)


def test_shingles_of_any_lines():
    lines = ["", "a", "12345678", "123456789", "🙂" * 9, "a" * 500, "\x00\x01", "漢字かな交じり文の行です"]
    assert line_shingles.Sets(lines).sizes.tolist() == [len(full_shingles(x)) for x in lines]
    ends = np.array(list(itertools.product(range(len(lines)), repeat=2)))
    assert line_shingles.Sets(lines).similar(*ends.T).tolist() == [alike(lines[i], lines[j]) for i, j in ends.tolist()]
    whole = line_shingles.minima(lines)
    assert (np.concatenate([line_shingles.minima([x]) for x in lines]) == whole).all()


def test_long_lines_are_compared_in_parts():
    """What a task holds doesn't grow with the characters of a batch, of many small groups or of a large one."""
    rng = random.Random(35)
    words = [f"w{k}" for k in range(3000)]
    lines = [" ".join(rng.choices(words, k=600)) for _ in range(1200)]
    keys = {x: range(1200) for x in ("id", "first", "a1", "a2", "b1", "b2")}
    pairs = pa.RecordBatch.from_pydict(keys | {"of_a": lines, "of_b": [x + "." if k % 3 else x[::-1] for k, x in enumerate(lines)]})
    group = {"low": [0] * 1200, "high": [0] * 1200, "block": [0] * 1200, "far": [True] * 1200, "id1": range(1200), "id2": [0] * 1200}
    twins = pa.array([lines[k // 2] + "." * (k % 2) for k in range(1200)])
    groups = [pa.RecordBatch.from_pydict(group | {"line": twins, "bucket": [k // size for k in range(1200)]}) for size in (4, 1200)]
    expected = [[k % 3 > 0 for k in range(1200)], *([(k, k + 1) for k in range(0, 1200, 2)] for _ in groups)]
    for make, batch, rows in zip((line_dedup._judge, *[line_dedup._link_groups] * 2), (pairs, *groups), expected, strict=True):
        tracemalloc.start()
        made = pa.Table.from_batches(make(iter([batch])))
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        found = made["near"].to_pylist() if "near" in made.column_names else sorted(tuple(sorted(x)) for x in zip(made["a1"].to_pylist(), made["b1"].to_pylist(), strict=True))
        assert found == rows
        print(round(most), "MB")
        assert most < 100


def test_parts_of_a_group_link_what_the_whole_does(monkeypatch):
    """A group that is cut into parts by its characters, of one block and of two, keeps its components."""
    rng = random.Random(36)
    base = ["".join(rng.choices("abcdef", k=60)) for _ in range(3)]
    lines = list({"".join(rng.choice("xyz") if rng.random() < 0.03 else c for c in rng.choice(base)) + "!" * k for k in range(60)})
    for n_blocks in (1, 2):
        far, block = [rng.random() < 0.5 for _ in lines], [rng.randrange(n_blocks) for _ in lines]
        pairs = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if (far[i] or far[j]) and (n_blocks == 1 or block[i] != block[j]) and alike(lines[i], lines[j])]
        n = len(lines)
        columns = {"bucket": [5] * n, "low": [0] * n, "high": [n_blocks - 1] * n, "block": block, "far": far, "id1": range(n), "id2": range(n), "line": lines}
        for most in (1, 500, 1 << 19):
            monkeypatch.setattr(line_dedup, "GROUP_CHARS", most)
            found = [(r["a1"], r["b1"]) for x in line_dedup._link_groups(iter([pa.RecordBatch.from_pydict(columns)])) for r in x.to_pylist()]
            assert {tuple(sorted(p)) for p in found} <= set(pairs)
            assert roots(range(n), found) == roots(range(n), pairs)


def test_bitmap(spark):
    """A key that is there always passes; keys that share its bit do too, others don't."""
    keys = spark.createDataFrame([(x,) for x in (0, 7, 8, 32_767, 32_768, -1, (1 << 27) + 5)], "k long")
    table = spark.range(-3, 70_000).withColumnRenamed("id", "key")
    expected = {0, 5, 7, 8, 32_767, 32_768, -1}
    assert {r.key for r in line_dedup._marked(table, "key", keys).collect()} == expected
    assert line_dedup._marked(table, "key", keys, "left_anti").count() == table.count() - len(expected)


def test_quadratic_discriminant():
    rng = np.random.default_rng(13)
    good, bad = rng.normal(0, 1, (4000, 3)), rng.normal(0, 3, (4000, 3)) + [1, 0, 0]

    def sums(x):
        return len(x), x.sum(axis=0), x.T @ x

    n, s, p = (np.array(v, float) for v in zip(sums(bad), sums(good), strict=True))
    model = quality_model.fit(n, s, p)
    x = rng.normal(0, 2, (50, 3))
    for k, (prior, mean, factor, half) in enumerate(model.parts):
        shrunk = np.linalg.inv(factor.T @ factor)
        assert half == pytest.approx(0.5 * np.linalg.slogdet(shrunk)[1])
        assert np.abs(mean - [bad, good][k].mean(axis=0)).max() < 1e-9
    assert ((model.score(good) > 0.5).mean() + (model.score(bad) < 0.5).mean()) / 2 > 0.85
    assert ((model.score(x) >= 0) & (model.score(x) <= 1)).all()
    assert quality_model.fit(np.zeros(2), s, p).score(x).tolist() == [0.5] * 50


def test_language_machines():
    words = {"en": "the and of with thing", "de": "der und nicht schön ein", "fr": "les dans être pour une", "es": "los para ción niño que"}
    rng = random.Random(14)
    made = [(lang, " ".join(rng.choices(w.split(), k=12))) for lang, w in words.items() for _ in range(60)]
    model = language.fit(np.array([language.vector(t) for _, t in made]), [lang for lang, _ in made])
    assert model.families == ["germanic", "romance"] and model.languages["romance"] == ["es", "fr"]
    tests = [(lang, " ".join(rng.choices(w.split(), k=8))) for lang, w in words.items() for _ in range(30)]
    assert np.mean([model.predict(language.vector(t))[0] == lang for lang, t in tests]) > 0.97
    assert language.vector("12 34 !") is None and language.vector("") is None
    single = language.fit(np.array([language.vector("abc")]), ["xx"])
    assert single.predict(language.vector("hello")) == ("xx", 1.0)


def test_samples_are_bounded(spark, monkeypatch):
    """Null and repeated doc_ids bring no more rows to the driver than the bound."""
    seen = []
    rows = [(k % 2 or None, prose(k, 20)) for k in range(300)] + [(2, prose(1000, 20))] * 100 + [(3, prose(2000 + k, 20)) for k in range(100)]
    monkeypatch.setattr(language, "fit", lambda x, of: seen.append(len(of)))
    language.train(frame(spark, rows), F.lit(True), 10)
    assert 1 <= seen[-1] <= 20
    monkeypatch.setattr(quality_rules, "learn", lambda lines: seen.append(collections.Counter(bad for _, bad in lines)))
    marks = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    quality_rules.train(frame(spark, rows), marks, 10)
    assert set(seen[-1]) == {True, False} and max(seen[-1].values()) <= 20


def with_labels(operator):
    return operator in ("op4_quality_classifier", "op6_quality_rules")


@pytest.fixture
def folder(tmp_path):
    def made(docs, marks):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/labels.parquet")
        items = docs.where("doc_id in (8, 10, 11)").selectExpr("doc_id as item_id", "text")
        items.write.parquet(str(tmp_path / "benchmark.parquet"))
        vectors = docs.selectExpr("doc_id as vec_id", "transform(sequence(1, 64), i -> float(coalesce(length(text), 0) % (i + 7)) / 9) as embedding")
        vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
        return str(tmp_path)

    return made


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, marks, folder, name):
    assert queries.QUERIES[name](spark, folder(empty, marks.limit(0))).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, marks, folder, name):
    got = queries.QUERIES[name](spark, folder(odd, marks)).collect()
    expected = collections.Counter(d for d, _ in odd_texts())
    if name == "op11_lexical_search":
        assert {r.item_id for r in got} == {8, 10, 11} and all(r.score > 0 and r.doc_id in expected for r in got)
        return
    if name == "op13_centroid_clustering":
        assert collections.Counter(r.vec_id for r in got) == expected
        return
    assert set(r.doc_id for r in got) == set(expected)
    if name != "op3_best_fit_packing":
        assert collections.Counter(r.doc_id for r in got) == expected
    if name in ("op4_quality_classifier", "op5_language_id"):
        divisor, remainder = (4, 2) if name.startswith("op4") else (3, 1)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % divisor == remainder) and 0 <= r.score <= 1 for r in got)
    if name.startswith("op5"):
        assert {r.lang_pred for r in got if r.doc_id in (5, 6, 7)} == {"und"}


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, empty, marks, folder, stage):
    where, run = folder(odd, marks), dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, empty, where).count() == 0
    made = run(spark, spark.read.parquet(f"{where}/documents.parquet"), where)
    assert made.count() > 0
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert made.columns == odd.columns


@tables
def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.QUERIES["op5_language_id"](spark, where).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) > 0.97
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op4_quality_classifier"](spark, where).collect() if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in got]) > 0.9


@tables
def test_exact_dedup_sql(spark):
    got = queries.QUERIES["op8_exact_dedup"](spark, FOLDER).toPandas()
    expected = duck(FOLDER).sql(exact.OP8_SQL).df()
    order = ["doc_id"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), expected.sort_values(order).reset_index(drop=True))


@tables
def test_pipeline(spark):
    """Each stage against what it was given, and the packed ids against the texts that are left."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > sizes[0] / 2
    left = docs.select("doc_id", "text", "n_chars").collect()
    assert all(len(r.text) == r.n_chars for r in left)
    fps = [simhash.fingerprint(r.text) for r in left]
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left}
    assert len(set(fps)) >= 0.99 * len(fps)
