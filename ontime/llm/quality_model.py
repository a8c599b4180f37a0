"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics. For each label Spark sums the
vectors and their products over all labelled rows that may be learned from; these
sums give means and covariances, which are shrunk towards their diagonal and towards
the pooled covariance. A score is the probability that follows from the difference of
the Mahalanobis log-densities and the label shares; Cholesky factors are computed
once and used for all texts.

Null and empty texts have a vector like any other. Without rows of both labels the
score is the share of label 1 (0.5 without any). Repeated rows count each.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import blocks, body, code_points

SHRINK_DIAGONAL, SHRINK_POOLED = 0.1, 0.1
FLOOR = 1e-3  #: least variance
THRESHOLD = 0.7
BLOCK_CHARS = 1_000_000

# Kinds of characters; those above U+024F count as lower-case letters.
_KINDS = ("other", "lower", "upper", "digit", "blank", "break", "symbol", "stop")
_TABLE = np.zeros(0x251, np.int64)
for _cp in range(0x250):
    _c = chr(_cp)
    _TABLE[_cp] = _KINDS.index(
        "break" if _c == "\n" else "blank" if _c in " \t\x0b\x0c\r" else "symbol" if _c in "#*$%&|<>" else
        "stop" if _c in ".,;:!?" else "digit" if _c.isdigit() else "upper" if _c.isupper() else "lower" if _c.isalpha() else "other"
    )
_TABLE[0x250] = _KINDS.index("lower")

#: Shares are smoothed by so many usual words, characters or lines, so that a short text is no extreme.
SMOOTH_WORDS, SMOOTH_CHARS, SMOOTH_LINES = 20, 100, 3
USUAL = {"upper": 0.02, "stop": 0.03}  #: shares of characters that the smoothing adds
STATISTICS = (
    "other", "upper", "digit", "symbol", "stop", "log letters a word", "distinct words",
    "repeated neighbours", "top word", "repeated lines", "log words a stop",
)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each text: logarithms of sizes, and square roots of shares."""
    made = [_block(texts[b]) for b in blocks([len(t) + 1 for t in texts], BLOCK_CHARS)]
    return np.concatenate(made) if made else np.zeros((0, len(STATISTICS)))


def _block(texts: list[str]) -> np.ndarray:
    n = len(texts)
    sizes = np.fromiter((len(t) for t in texts), np.int64, n)
    kind = _TABLE[np.minimum(code_points("".join(texts)), 0x250)]
    chars = np.bincount(np.repeat(np.arange(n), sizes) * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    made = np.zeros((n, len(STATISTICS)))
    for k, text in enumerate(texts):
        words = text.split()
        lines = [x for x in text.split("\n") if x]
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        other, lower, upper, digit, blank, broken, symbol, stop = chars[k]
        marks = chars[k].sum() - blank - broken + SMOOTH_CHARS
        upper, stop = upper + USUAL["upper"] * SMOOTH_CHARS, stop + USUAL["stop"] * SMOOTH_CHARS
        total = len(words) + SMOOTH_WORDS
        same = sum(map(str.__eq__, words, words[1:]))
        made[k] = (
            (other / marks) ** 0.5, (upper / marks) ** 0.5, (digit / marks) ** 0.5, (symbol / marks) ** 0.5, (stop / marks) ** 0.5,
            np.log((lower + upper + 5 * SMOOTH_WORDS) / total), ((len(counts) + SMOOTH_WORDS) / total) ** 0.5,
            (same / total) ** 0.5, (max(counts.values(), default=0) / total) ** 0.5,
            ((len(lines) - len(set(lines))) / (len(lines) + SMOOTH_LINES)) ** 0.5, np.log(total / stop),
        )
    return made


@dataclass
class Model:
    """Of each label: the logarithm of its share, mean, inverse Cholesky factor and half the log-determinant."""

    share: float
    parts: list[tuple[float, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        if not self.parts:
            return np.full(len(x), self.share)
        density = [prior - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) - half for prior, mean, factor, half in self.parts]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Model:
    """From the number of rows, the sums and the sums of products of each label."""
    if not n.all():
        return Model(float(n[1] / n.sum()) if n.any() else 0.5, [])
    means = sums / n[:, None]
    scatter = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (scatter * n[:, None, None]).sum(axis=0) / n.sum()
    parts = []
    for k in (0, 1):
        shrunk = (1 - SHRINK_POOLED) * scatter[k] + SHRINK_POOLED * pooled
        shrunk = (1 - SHRINK_DIAGONAL) * shrunk + SHRINK_DIAGONAL * np.diag(np.diag(shrunk)) + FLOOR * np.eye(len(shrunk))
        lower = np.linalg.cholesky(shrunk)
        parts.append((float(np.log(n[k] / n.sum())), means[k], np.linalg.inv(lower), float(np.log(np.diag(lower)).sum())))
    return Model(float(n[1] / n.sum()), parts)


def train(docs: DataFrame, marks: DataFrame, may_learn: Column) -> Model:
    """The model of all rows of ``docs`` that ``may_learn`` allows and ``marks`` (doc_id, quality) labels.

    Statistics are made before the join, so that no text is shuffled.
    """
    size = len(STATISTICS) + 1
    good = marks.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumnRenamed("doc_id", "marked")

    @F.pandas_udf("array<double>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(texts.tolist())))

    learnable = docs.filter(may_learn & F.col("doc_id").isNotNull()).select("doc_id", made(body()).alias("x"))
    rows = learnable.join(good, F.col("doc_id") == F.col("marked")).select("quality", "x")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, size, size))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), np.array(batch["x"].tolist()).reshape(len(batch), size - 1)])
            for label in (0, 1):
                own = x[batch["quality"].to_numpy() == label]
                total[label] += own.T @ own
        label, i, j = np.unravel_index(np.arange(total.size), total.shape)
        yield pd.DataFrame({"label": label, "i": i, "j": j, "s": total.ravel()})

    summed = rows.mapInPandas(add, "label int, i int, j int, s double").groupBy("label", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros((2, size, size))
    total[summed["label"], summed["i"], summed["j"]] = summed["s"]
    return fit(total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:])


def score(docs: DataFrame, model: Model) -> Column:
    """The probability of label 1 of each text, empty ones too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(statistics(texts.tolist())))

    return run(body())


def held_out(divisor: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder; a null doc_id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def op4_quality_classifier(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Score of each document, learned from those that aren't held out."""
    out = held_out(4, 2)
    scored = docs.select("doc_id", out.alias("held_out"), score(docs, train(docs, marks, ~out)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
