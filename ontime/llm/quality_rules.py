"""Quality rules: base counts, and a linear-chain CRF that labels lines.

Words are runs of anything but ASCII white space. The CRF has the labels content
and boilerplate. Its weights are learned from lines of labelled documents: those
of good documents count as content, those of bad ones as boilerplate. Viterbi
decoding labels a document's lines, and a document whose words are mostly in
content lines is kept, unless the base counts reject it.

Null and empty texts have no words and so fail the base rules. Repeated rows are
judged each. Without labelled documents of both kinds every line is content.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import blocks, body, bounded, code_points

LEAST_WORDS = 50
MOST_REPEATED = 50  #: per cent of the words
WINDOW = 3  #: words
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CONTENT_SHARE = 0.5  #: least share of words in content lines
SAMPLE = 2_000  #: about so many labelled documents of each kind are learned from
SEGMENT = 32  #: lines that are learned from together
GOOD_WEIGHT = 4.0  #: of good lines against bad ones, as a lost good document costs more
BLOCK_CHARS = 1_000_000

# Kinds of characters; those above U+024F count as letters.
_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _STOP = range(7)
_TABLE = np.full(0x251, _OTHER, np.int64)
for _cp in range(0x250):
    _c = chr(_cp)
    _TABLE[_cp] = (
        _SPACE if _c in SPACES else _SYMBOL if _c in SYMBOLS else _STOP if _c in ".,;:!?" else
        _DIGIT if _c.isdigit() else _UPPER if _c.isupper() else _LOWER if _c.isalpha() else _OTHER
    )
_TABLE[0x250] = _LOWER
_KINDS = 8  #: a power of two above the kinds
FEATURES = 11  #: bits of a line


@dataclass
class Model:
    """A CRF of two labels, as differences: score of boilerplate by feature bits, and gains of staying in a label."""

    emission: np.ndarray  #: by the number that the bits make
    stay_content: float
    stay_boilerplate: float
    start: float


#: Every line is content.
NO_MODEL = Model(np.full(1 << FEATURES, -1.0), 0.0, 0.0, -1.0)


@dataclass
class Counted:
    """A document's base counts and, for each of its lines, the feature bits and the number of words."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    bits: np.ndarray
    words: np.ndarray

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def _repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words in windows that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key = ids[:n]
    for k in range(1, WINDOW):
        if kinds ** 2 >= 1 << 62 or (k > 1 and kinds ** (k + 1) >= 1 << 62):
            key = np.unique(key, return_inverse=True)[1]
        key = key * kinds + ids[k : n + k]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    found = np.flatnonzero(count[at] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[found + k] = True
    return int(covered.sum())


def _dup_lines(lines: list[str]) -> np.ndarray:
    """For each line whether it has a word and equals an earlier one."""
    seen: set[str] = set()
    made = np.zeros(len(lines), bool)
    for k, line in enumerate(lines):
        if line in seen:
            made[k] = True
        elif line.strip(SPACES):
            seen.add(line)
    return made


def count(texts: list[str]) -> Iterator[Counted]:
    """Base counts and line features of each text; many short ones are counted together."""
    for block in blocks([len(t) + 1 for t in texts], BLOCK_CHARS):
        yield from _count_block(texts[block])


def _count_block(texts: list[str]) -> Iterator[Counted]:
    cp = code_points("\n".join(texts) + "\n")
    kind = _TABLE[np.minimum(cp, 0x250)]
    breaks = np.flatnonzero(cp == 10)
    n_lines = len(breaks)
    line_of = np.repeat(np.arange(n_lines), np.diff(breaks, prepend=-1))
    chars = np.bincount(line_of * _KINDS + kind, minlength=n_lines * _KINDS).reshape(-1, _KINDS)
    space = kind == _SPACE
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    line_of_word = line_of[starts]
    words = np.bincount(line_of_word, minlength=n_lines)

    raw = ("\n".join(texts)).encode("utf-8", "surrogatepass").split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in raw), np.int64, len(raw))
    same = np.flatnonzero((ids[1:] == ids[:-1]) & (line_of_word[1:] == line_of_word[:-1])) + 1
    again = np.bincount(line_of_word[same], minlength=n_lines)

    marks = chars[:, _LOWER] + chars[:, _UPPER] + chars[:, _DIGIT] + chars[:, _SYMBOL] + chars[:, _STOP] + chars[:, _OTHER]
    letters = np.maximum(chars[:, _LOWER] + chars[:, _UPPER], 1)
    last = kind[np.maximum(breaks - 1, 0)]
    bits = [
        chars[:, _SYMBOL] * 20 > marks,
        chars[:, _SYMBOL] * 8 > marks,
        chars[:, _UPPER] * 3 > letters,
        chars[:, _DIGIT] * 4 > marks,
        chars[:, _STOP] * 6 > marks,
        again * 4 > words,
        again > 0,
        words < 4,
        words > 40,
        (last == _STOP) & (words > 0),
    ]
    features = sum(b.astype(np.int64) << k for k, b in enumerate(bits))

    first_line, first_word = 0, 0
    for text in texts:
        lines = text.split("\n")
        stop = first_line + len(lines)
        here = slice(first_line, stop)
        n = int(words[here].sum())
        dup = _dup_lines(lines)
        own = ids[first_word : first_word + n]
        yield Counted(
            n,
            int(marks[here].sum()),
            int(chars[here, _SYMBOL].sum()),
            int(dup.sum()),
            _repeated_words(own, len(known)),
            features[here] | dup.astype(np.int64) << len(bits),
            words[here],
        )
        first_line, first_word = stop, first_word + n


def boilerplate(model: Model, bits: np.ndarray) -> np.ndarray:
    """Viterbi: whether each line is boilerplate."""
    gains = model.emission[bits].tolist()
    content, other = 0.0, gains[0] + model.start if gains else 0.0
    back = []
    for gain in gains[1:]:
        from_other, from_content = other > content + model.stay_content, other + model.stay_boilerplate > content
        back.append((from_other, from_content))
        content, other = (
            other if from_other else content + model.stay_content,
            (other + model.stay_boilerplate if from_content else content) + gain,
        )
    label = other > content
    made = [label]
    for from_other, from_content in reversed(back):
        label = from_content if label else from_other
        made.append(label)
    return np.array(made[::-1][: len(gains)], bool)


def learn(sequences: list[tuple[np.ndarray, bool]], rounds: int = 200, decay: float = 1e-3) -> Model:
    """The CRF of greatest likelihood for (bits of lines, whether all are boilerplate), by gradient ascent."""
    good, bad = [s for s, b in sequences if not b], [s for s, b in sequences if b]
    if not good or not bad:
        return NO_MODEL
    parts = [(s[i : i + SEGMENT], float(b)) for s, b in sequences for i in range(0, len(s), SEGMENT)]
    longest = max(len(s) for s, _ in parts)
    bits = np.zeros((len(parts), longest), np.int64)
    alive = np.zeros((len(parts), longest), bool)
    for k, (s, _) in enumerate(parts):
        bits[k, : len(s)], alive[k, : len(s)] = s, True
    truth = np.array([b for _, b in parts])
    weight = np.where(truth > 0, 1.0, GOOD_WEIGHT)
    columns = np.concatenate([(bits[..., None] >> np.arange(FEATURES)) & 1, np.ones((*bits.shape, 1), np.int64)], axis=2) * alive[..., None]
    w = np.zeros(FEATURES + 4)  # features, bias, stay in content, stay in boilerplate, start
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        gradient = _gradient(w, columns, alive, truth, weight) / weight.sum() - decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    every = (np.arange(1 << FEATURES)[:, None] >> np.arange(FEATURES)) & 1
    return Model(every @ w[:FEATURES] + w[FEATURES], float(w[-3]), float(w[-2]), float(w[-1]))


def _gradient(w: np.ndarray, columns: np.ndarray, alive: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Observed less expected counts, by forward and backward sums over all segments at once."""
    n, length = alive.shape
    emission = columns @ w[: FEATURES + 1]
    move = np.array([[w[-3], 0.0], [0.0, w[-2]]])  # from, to
    forward, backward = np.zeros((length, n, 2)), np.zeros((length, n, 2))
    forward[0, :, 1] = emission[:, 0] + w[-1]
    for t in range(1, length):
        step = np.logaddexp(forward[t - 1, :, :1] + move[0], forward[t - 1, :, 1:] + move[1])
        step[:, 1] += emission[:, t]
        forward[t] = np.where(alive[:, t, None], step, forward[t - 1])
    for t in range(length - 2, -1, -1):
        ahead = backward[t + 1].copy()
        ahead[:, 1] += emission[:, t + 1]
        step = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
        backward[t] = np.where(alive[:, t + 1, None], step, 0.0)
    total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    expected = np.exp(forward[..., 1] + backward[..., 1] - total).T * alive
    made = np.zeros_like(w)
    off = (truth[:, None] * alive - expected) * weight[:, None]
    made[: FEATURES + 1] = np.einsum("nt,ntf->f", off, columns)
    made[-1] = off[:, 0].sum()
    for t in range(1, length):
        on = alive[:, t] * weight
        both = np.exp(forward[t - 1, :, 1] + w[-2] + emission[:, t] + backward[t, :, 1] - total)
        neither = np.exp(forward[t - 1, :, 0] + w[-3] + backward[t, :, 0] - total)
        made[-2] += ((truth - both) * on).sum()
        made[-3] += ((1 - truth - neither) * on).sum()
    return made


def train(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> Model:
    """Weights from about ``sample`` labelled documents of each kind, chosen by a hash of doc_id, and 2 * sample at most.

    Where doc_ids repeat, the smallest rows by a hash of doc_id and text count.
    ``marks`` has doc_id and quality; where a document has several, the smallest counts.
    """
    good = marks.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r.quality: r["count"] for r in good.groupBy("quality").count().collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    shares = [(q, min(1.0, sample / n)) for q, n in sizes.items() if q in (0, 1)]
    if len(shares) < 2:
        return NO_MODEL
    chosen = good.filter(sum((((F.col("quality") == q) & (part < share)).cast("int") for q, share in shares), F.lit(0)) > 0)
    chosen = chosen.select(F.col("doc_id").alias("marked"), "quality").limit(4 * sample)  # twice what is expected

    @F.pandas_udf("array<long>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([c.bits[c.words > 0] for c in count(texts.tolist())])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("marked"))
    drawn = joined.select("quality", "text", F.xxhash64("doc_id", "text").alias("draw"))
    rows = bounded(drawn, "quality", 2 * sample).select("quality", features(body()).alias("bits"))
    found = sorted(((list(r.bits), r.quality == 0) for r in rows.collect() if r.bits), key=repr)
    return learn([(np.array(b, np.int64), bad) for b, bad in found])


def judge(docs: DataFrame, model: Model):
    """A column of base counts and verdict of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, content_share double, kept boolean"
    )
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for c in count(texts.tolist()):
                content = int(c.words[~boilerplate(shared.value, c.bits)].sum())
                share = content / c.n_words if c.n_words else 0.0
                rows.append((c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.failed, share, not c.failed and share >= CONTENT_SHARE))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    return run(body())


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the rules keep."""
    return docs.filter(judge(docs, model)["kept"])


def op6_quality_rules(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Counts and verdict of each document."""
    return docs.select("doc_id", judge(docs, train(docs, marks)).alias("q")).select("doc_id", "q.*")
