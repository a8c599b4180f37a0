"""Language identification by hierarchical discrimination.

A text's character pairs and triples are hashed to a vector. The family of the
language is predicted first; one-versus-one linear support vector machines then
separate the languages of the family. Languages without a known family are one
of their own.

The machines learn from a bounded sample of labelled documents, chosen by a hash
of doc_id. Null texts and texts without a letter are ``und`` with score 0. Without
any labelled document every text is ``und``. Repeated rows are predicted each.
"""

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import body, bounded, code_points
from ontime.llm.quality_model import held_out

#: Families of closely related languages.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "mr", "ne", "ur", "pa", "gu"],
}
_FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages}

BUCKETS = 1 << 12  #: of the vector
SAMPLE = 400  #: about so many documents of each language are learned from
ROUNDS = 60
REGULAR = 1e-4


def vector(text: str) -> np.ndarray | None:
    """Square roots of the counts of hashed pairs and triples of characters, of length one; None without a letter."""
    if not any(map(str.isalpha, itertools.islice(text, 64))) and not any(map(str.isalpha, text)):
        return None
    total = np.zeros(BUCKETS)
    lower = text.lower()
    for at in range(0, len(lower), 1 << 18):
        cp = code_points(" " + lower[max(0, at - 2) : at + (1 << 18)] + " ").astype(np.uint32)
        cp[cp < 65] = 32  # digits and marks don't tell languages apart
        pair = cp[:-1] * np.uint32(0x9E3779B1) + cp[1:] * np.uint32(0x85EBCA6B)
        triple = pair[:-1] * np.uint32(0xC2B2AE35) + cp[2:] * np.uint32(0x27D4EB2F)
        for h in (pair, triple):
            total += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=BUCKETS)
    root = np.sqrt(total)
    return root / np.linalg.norm(root)


@dataclass
class Model:
    """Families, their languages, and a weight vector (bias last) for each pair of families and of languages."""

    families: list[str]
    languages: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]

    def _choose(self, names: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name with most pairs won, then the largest sum of margins, and its share of certainty."""
        if len(names) == 1:
            return names[0], 1.0
        won = dict.fromkeys(names, 0)
        sums = dict.fromkeys(names, 0.0)
        for a, b in itertools.combinations(names, 2):
            m = margin[a, b]
            won[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(names, key=lambda x: (won[x], sums[x]))
        worst = min((margin[a, b] if a == best else -margin[a, b]) for a, b in margin if best in (a, b) and a in won and b in won)
        return best, 1 / (1 + float(np.exp(-np.clip(2 * worst, -50, 50))))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        margin = {pair: float(x @ w[:-1] + w[-1]) for pair, w in self.machines.items()}
        family, sure = self._choose(self.families, margin)
        language, within = self._choose(self.languages[family], margin)
        return language, sure * within


def _machine(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """A linear support vector machine by stochastic subgradient steps in a fixed order; both sides weigh alike."""
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)) * len(y)
    full = np.column_stack([x, np.ones(len(x))])
    w, mean, order, step, kept = np.zeros(full.shape[1]), np.zeros(full.shape[1]), np.random.default_rng(7), 0, 0
    for epoch in range(ROUNDS):
        for block in np.array_split(order.permutation(len(y)), max(1, len(y) // 32)):
            step += 1
            wrong = block[y[block] * (full[block] @ w) < 1]
            w *= 1 - 1 / (step + 10)
            w += ((y[wrong] * weight[wrong]) @ full[wrong]) / (REGULAR * (step + 10) * len(block)) if len(wrong) else 0
            norm = np.linalg.norm(w) * REGULAR**0.5
            if norm > 1:
                w /= norm
            if epoch >= ROUNDS // 2:
                mean += w
                kept += 1
    return mean / max(kept, 1)


def fit(x: np.ndarray, languages: list[str]) -> Model:
    """Machines between families, and between the languages of each."""
    of = np.array(languages, object)
    family = np.array([_FAMILY.get(s, s) for s in languages], object)
    families, machines, members = sorted(set(family)), {}, {}
    for a, b in itertools.combinations(families, 2):
        on = (family == a) | (family == b)
        machines[a, b] = _machine(x[on], family[on] == a)
    for f in families:
        members[f] = sorted(set(of[family == f]))
        for a, b in itertools.combinations(members[f], 2):
            on = (of == a) | (of == b)
            machines[a, b] = _machine(x[on], of[on] == a)
    return Model(families, members, machines)


def train(docs: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model:
    """The model of about ``sample`` documents of each language in ``lang``, 2 * sample at most, of those that ``may_learn`` allows.

    They are drawn by a hash of doc_id and text.
    """
    known = docs.filter(may_learn & F.col("lang").isNotNull())
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {}, {})
    draw = F.xxhash64("doc_id", "text")
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, sample / n) * (1 << 30)))))

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([vector(t) for t in texts])

    drawn = known.filter(F.pmod(draw, F.lit(1 << 30)) < share[F.col("lang")]).select("lang", "text", draw.alias("draw"))
    rows = bounded(drawn, "lang", 2 * sample).select("lang", vectors(body()).alias("x"))
    chosen = sorted((r for r in rows.filter("x is not null").collect()), key=lambda r: (r.lang, r.x))
    if not chosen:
        return Model([], {}, {})
    return fit(np.array([r.x for r in chosen], np.float64), [r.lang for r in chosen])


def predict(docs: DataFrame, model: Model) -> Column:
    """lang_pred and score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shared.value.predict(x) if shared.value.families and (x := vector(t)) is not None else ("und", 0.0) for t in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return run(body())


def op5_language_id(docs: DataFrame) -> DataFrame:
    """Predicted language of each document, learned from those that aren't held out."""
    out = held_out(3, 1)
    made = docs.select("doc_id", out.alias("held_out"), predict(docs, train(docs, ~out)).alias("p"))
    return made.select("doc_id", "held_out", "p.lang_pred", "p.score")
