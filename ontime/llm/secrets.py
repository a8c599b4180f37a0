"""Secret scans: base patterns, and character Markov models of random strings.

Two models of character pairs are trained, one on the values that the base patterns
find (random strings), one on all other tokens (ordinary identifiers, numbers, dates,
paths), both from a sample of the documents. What the base spans leave of a long token
is a secret too if its log-likelihood ratio favours the random model; if not, each of its
long parts between slashes and equals signs that does. All of it is column expressions.

Positions are code points. Null and empty texts have no spans. Repeated rows are
scanned each. Without any sample the random model is uniform.
"""

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import body, fresh

#: Kinds in their order, patterns, the group whose length counts, and the least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]

TOKEN = "[A-Za-z0-9+/_=-]"
LEAST_SIZE = 20  #: characters of a token that may be a secret
CANDIDATE = f"(?<!{TOKEN}){TOKEN}{{{LEAST_SIZE},}}+"
PART = f"(?<![^/=])[^/=]{{{LEAST_SIZE},}}+"  #: of a candidate, between slashes and equals signs
ORDINARY = f"{TOKEN}{{2,}}+"
LEAST_RATIO = 8.0  #: natural logarithm
LEAST_PER_PAIR = 0.3  #: of the ratio, so that length alone doesn't decide
SAMPLE = 20_000  #: about so many documents are learned from
PRIOR = 5.0  #: characters that the smoothing adds after each
MASK = "[SECRET]"

_SPAN = "array<struct<start: int, kind: int, stop: int, value: string, first: int, last: int>>"
_STRIDES = [1 << i for i in range(31)]


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """All values up to each, joined; by doubled strides, as appending would copy the array for every value."""
    strides = F.filter(F.array(*map(F.lit, _STRIDES)), lambda k: k < F.size(values))

    def step(made: Column, k: Column) -> Column:
        return F.transform(made, lambda v, i: F.when(i >= k, join(F.get(made, i - k), v)).otherwise(v))

    return F.aggregate(strides, values, step)


def _both(a: Column, b: Column) -> Column:
    return F.struct((a["points"] + b["points"]).alias("points"), (a["bytes"] + b["bytes"]).alias("bytes"))


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the pattern's leftmost matches, without those whose group is too short.

    The texts between matches give the positions, in code points and, as first and last, in bytes.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def size(word: Column) -> Column:
        return F.struct(F.char_length(word).alias("points"), F.octet_length(word).alias("bytes"))

    def span(x: Column, stop: Column) -> Column:
        start, first = stop["points"] - F.char_length(x["match"]), stop["bytes"] - F.octet_length(x["match"])
        return _span(start, stop["points"], x["value"], first, stop["bytes"], kind)

    def placed(each: Column) -> Column:
        sizes = F.transform(each, lambda x: _both(size(x["gap"]), size(x["match"])))
        return F.filter(F.zip_with(each, _let(sizes, lambda n: _running(n, _both)), span), lambda s: F.char_length(s["value"]) >= least)

    each = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), values.alias("value"))
    met = F.filter(each, lambda x: x["match"].isNotNull())  # the text after the last match has none
    return F.when(text.rlike(pattern), _let(met, placed)).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def base_spans(text: Column) -> Column:
    """All base spans: (start, kind, stop, value)."""
    return F.concat(*(_spans(text, k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(KINDS)))


def _masked(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with ``fill`` in place of the spans, which are in order.

    ``fill`` is given whether the span begins beyond all before it, and how many code points are its alone.
    """
    ends = F.transform(spans, lambda s: F.struct(s["stop"].alias("points"), s["last"].alias("bytes")))
    # the bytes, as a place in them is found without counting from the start
    held = F.struct(text.cast("binary").alias("text"), _let(ends, lambda e: _running(e, F.greatest)).alias("reach"))

    def cut(x: Column, start: Column, stop: Column) -> Column:
        return F.substring(x["text"], start + 1, stop - start).cast("string")

    def clean(x: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.get(x["reach"], i - 1)
            points, at = F.coalesce(before["points"], F.lit(0)), F.coalesce(before["bytes"], F.lit(0))
            alone = F.greatest(s["stop"] - F.greatest(s["start"], points), F.lit(0))
            return F.concat(cut(x, at, s["first"]), fill(s["start"] >= points, alone))

        end = F.get(x["reach"], F.size(spans) - 1)["bytes"]
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(x, end, F.octet_length(x["text"])))

    return F.when(F.size(spans) == 0, text).otherwise(_let(held, clean))


def _blank(beyond: Column, alone: Column) -> Column:
    """Spaces for each code point."""
    return F.repeat(F.lit(" "), alone)


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """The log-likelihood ratio of each pair of ASCII characters, at 128 times the first plus the second.

    Learned from about ``sample`` documents, chosen by a hash of doc_id. Tokens outside of
    the base spans count as ordinary, but long ones that are a secret by the ordinary
    tokens of the other half of the documents, so that a secret doesn't vouch for itself.
    Only pair counts reach the driver, 128 x 128 of each kind and half at most.
    """
    share = min(1.0, sample / max(docs.count(), 1))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    half = F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")
    found = chosen.select(half, body().alias("text"), F.array_sort(base_spans(body())).alias("base"))
    random = F.transform("base", lambda s: F.struct(F.lit(1).alias("random"), s["value"].alias("word")))
    others = F.regexp_extract_all(_masked(F.col("text"), F.col("base"), _blank), F.lit(ORDINARY), F.lit(0))
    plain = F.transform(others, lambda w: F.struct(F.lit(0).alias("random"), w.alias("word")))
    words = found.select("half", F.explode(F.concat(random, plain)).alias("w")).select("half", "w.*").groupBy("random", "half", "word").count()
    words.persist()
    n = _pair_counts(words)
    judges = F.array(*(_literal(_log_ratios(Counter({x: m for x, m in n.items() if x[0] or x[1] != h}))) for h in (0, 1)))
    long = (F.col("random") == 0) & (F.char_length("word") >= LEAST_SIZE)
    token = _span(F.lit(0), F.char_length("word"), F.col("word"), F.lit(0), F.octet_length("word"))
    taken = words.filter(long).select("random", "half", "count", F.explode(_secrets(token, F.get(judges, F.col("half")))["value"]).alias("word"))
    n.subtract(_pair_counts(taken))
    words.unpersist()
    return _log_ratios(n)


def _pair_counts(words: DataFrame) -> Counter:
    """How often each pair follows, by (random, half, first, second)."""
    words = words.select("random", "half", "count", F.col("word").cast("binary").alias("word"))  # a place in it is found without counting
    pairs = words.select("random", "half", "count", "word", F.explode(F.sequence(F.lit(1), F.greatest(F.octet_length("word") - 1, F.lit(1)))).alias("i"))
    first, second = (F.ascii(F.substring("word", F.col("i") + k, F.lit(1)).cast("string")) for k in (0, 1))
    counts = pairs.select("random", "half", "count", first.alias("a"), second.alias("b")).filter("a < 128 and b between 1 and 127")
    return Counter({(r.random, r.half, r.a, r.b): r.n for r in counts.groupBy("random", "half", "a", "b").agg(F.sum("count").alias("n")).collect()})


def _log_ratios(counts: Counter) -> list[float]:
    """The log-likelihood ratios of the smoothed models of both halves together."""
    n: Counter = Counter()
    for (random, _, a, b), times in counts.items():
        n[random, a, b] += times
    alphabet = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-."]

    def model(kind: int) -> dict[tuple[int, int], float]:
        """The chance of each second character, drawn towards its chance after any."""
        ends = {b: sum(n[kind, a, b] for a in alphabet) for b in alphabet}
        usual = {b: (ends[b] + 1) / (sum(ends.values()) + len(alphabet)) for b in alphabet}
        made = {}
        for a in alphabet:
            total = sum(n[kind, a, b] for b in alphabet) + PRIOR
            made |= {(a, b): (n[kind, a, b] + PRIOR * usual[b]) / total for b in alphabet}
        return made

    random_model, plain_model, ratio = model(1), model(0), [0.0] * (128 * 128)
    for (a, b), chance in random_model.items():
        ratio[128 * a + b] = round(math.log(chance / plain_model[a, b]), 6)
    return ratio


def _ratio(word: Column, ratio: Column) -> Column:
    """The word's log-likelihood ratio of random string against identifier."""
    code = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code) - 1), lambda a, b: a * 128 + b)
    return F.aggregate(pairs, F.lit(0.0), lambda total, i: total + F.get(ratio, i))


def _likely(word: Column, ratio: Column) -> Column:
    score, pairs = _ratio(word, ratio), F.char_length(word) - 1
    return (score >= LEAST_RATIO) & (score >= LEAST_PER_PAIR * pairs)


def _literal(ratio: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(ratio)), "array<double>")


def _span(start: Column, stop: Column, value: Column, first: Column, last: Column, kind: int = len(KINDS)) -> Column:
    """A span, of a random string unless the kind is named."""
    named = {"start": start, "kind": F.lit(kind), "stop": stop, "value": value, "first": first, "last": last}
    return F.struct(*(x.alias(name) for name, x in named.items()))


def _secrets(s: Column, ratio: Column) -> Column:
    """The span if it is a secret; if not, those of its long parts that are."""

    def moved(p: Column) -> Column:
        return _span(s["start"] + p["start"], s["start"] + p["stop"], p["value"], s["first"] + p["first"], s["first"] + p["last"])

    parts = F.transform(_spans(s["value"], len(KINDS), PART, 0, LEAST_SIZE), moved)
    return F.when(_likely(s["value"], ratio), F.array(s)).otherwise(F.filter(parts, lambda p: _likely(p["value"], ratio)))


def find(docs: DataFrame, ratio: list[float], *keep: str) -> DataFrame:
    """The ``keep`` columns, and under fresh names ``base`` and ``spans``: base spans and all spans, both in order.

    Long tokens are looked for where base spans are blank, so that what those leave of a token is a token.
    Time grows with a text's length and with n log n of its spans. Returns the table and the two names.
    """
    base, spans, more, text, left = (fresh(docs, name) for name in ("base", "spans", "more", "whole", "left"))
    model = _literal(ratio)
    held = docs.select(*keep, body().alias(text), F.array_sort(base_spans(body())).alias(base))
    held = held.withColumn(left, _masked(F.col(text), F.col(base), _blank))
    held = held.withColumn(more, _spans(F.col(left), len(KINDS), CANDIDATE, 0, LEAST_SIZE))
    added = F.flatten(F.transform(F.col(more), lambda s: _secrets(s, model)))
    return held.withColumn(spans, F.array_sort(F.concat(base, added))).drop(more, text, left), base, spans


def _written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("random"))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def redact(docs: DataFrame, ratio: list[float]) -> DataFrame:
    """The documents with ``MASK`` in place of each secret, and n_chars as it is then."""
    held, _, spans = find(docs, ratio, *docs.columns)
    text = F.col("text")
    clean = _masked(text, F.col(spans), lambda beyond, alone: F.when(beyond, MASK).otherwise(""))
    hit = F.size(spans) > 0
    made = held.withColumn("text", F.when(hit, clean).otherwise(text))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


def op7_secret_scan(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of each document."""
    held, base, spans = find(docs, train(docs), "doc_id")

    def count(kind: int) -> Column:
        return F.size(F.filter(F.col(base), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind][0]}")

    digest = F.sha2(_written(F.col(base)), 256).alias("base_sha256")
    return held.select("doc_id", *map(count, range(len(KINDS))), digest, _written(F.col(spans)).alias("spans"))
