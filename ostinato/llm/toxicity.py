"""Toxicity scores that do not depend on which group a text names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import batch_steps, free_name, learnable

# Names of groups that may stand for each other in a sentence.
IDENTITIES = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"),
)
SWAPS = {term: [t for t in group if t != term] for group in IDENTITIES for term in group}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
STEMS = (4, 5, 6)


def features(word: str) -> tuple[str, ...]:
    """A word itself and its stems, which words that share a root have in common."""
    return ("=" + word, *(word[:n] for n in STEMS if len(word) >= n))


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def feature_counts(labelled: DataFrame, flush: int = 300_000) -> DataFrame:
    """(feature, toxic, clean): rows of (text, toxic) that have it; summed in the task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            names = sorted(held[0].keys() | held[1].keys())
            counts = [np.array([h[x] for x in names], np.int64) for h in (held[1], held[0])]
            held[0].clear()
            held[1].clear()
            return pa.RecordBatch.from_pydict(
                {"feature": pa.array(names, pa.string()), "toxic": counts[0], "clean": counts[1]}
            )

        for batch in batches:
            for part, texts in batch_steps(batch, "text"):
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    held[toxic].update({f for w in words(text) for f in features(w)})
                if len(held[0]) + len(held[1]) > flush:
                    yield rows()
        yield rows()

    part = labelled.select("text", "toxic").mapInArrow(work, "feature string, toxic bigint, clean bigint")
    return part.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        weight = self.weights
        memo: dict[str, tuple[str, ...]] = {}
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            found: set[str] = set()
            for w in words(text):
                if (hit := memo.get(w)) is None:
                    hit = memo[w] = tuple(f for f in features(w) if f in weight)
                found.update(hit)
            out[k] = self.bias + sum(weight[f] for f in sorted(found))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _chosen(counts: DataFrame, n_toxic: int, n_clean: int, size: int, evidence: float) -> list[str]:
    """Of features that toxic rows have more often, the ``size`` that say most about the label,
    by the logarithm of the likelihood ratio, of which ``evidence`` is asked for at least."""

    def term(seen, rate, total):
        return F.when(seen > 0, seen * F.log(seen / (total * rate))).otherwise(0.0)

    t, c = F.col("toxic"), F.col("clean")
    rate = (t + c) / F.lit(float(n_toxic + n_clean))
    ratio = term(t, rate, n_toxic) + term(c, rate, n_clean)
    ratio += term(n_toxic - t, 1 - rate, n_toxic) + term(n_clean - c, 1 - rate, n_clean)
    rows = counts.filter((rate < 1) & (t > rate * n_toxic)).select("feature", ratio.alias("ratio"))
    rows = rows.filter(F.col("ratio") >= evidence).orderBy(F.desc("ratio"), "feature").limit(size)
    return [r[0] for r in rows.collect()]


def _presence(labelled: DataFrame, names: list[str]) -> tuple[list, Counter]:
    """Per labelled row its label and chosen features, and how often swapping an identity term
    for another in one of its sentences is possible, by the pair of terms."""
    index = labelled.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in batch_steps(batch, "text"):
                rows, terms = [], []
                for text in texts:
                    own = {k for w in words(text) for f in features(w) if (k := index.value.get(f)) is not None}
                    rows.append(sorted(own))
                    found = Counter()
                    if words(text) & SWAPS.keys():
                        for sentence in SENTENCE.split(text):
                            found.update(words(sentence) & SWAPS.keys())
                    terms.append([t for t, n in sorted(found.items()) for _ in range(min(n, 3))])
                yield pa.RecordBatch.from_pydict(
                    {
                        "toxic": part.column("toxic"),
                        "own": pa.array(rows, pa.list_(pa.int32())),
                        "terms": pa.array(terms, pa.list_(pa.string())),
                    }
                )

    found = labelled.select("text", "toxic").mapInArrow(work, "toxic int, own array<int>, terms array<string>")
    rows, terms = [], Counter()
    for r in found.toLocalIterator():
        rows.append((r.toxic, r.own))
        terms.update(r.terms)
    return rows, terms


def _minimise(gradient, start: np.ndarray, step: float, rounds: int) -> np.ndarray:
    """Accelerated gradient descent with a fixed step; all but the last weight stay at least 0."""
    w, ahead, t = start, start, 1.0
    for _ in range(rounds):
        new = ahead - step * gradient(ahead)
        new[:-1] = np.maximum(new[:-1], 0)
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, ahead, t = new, new + (t - 1) / later * (new - w), later
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    size: int = 4_000,
    evidence: float = 8.0,
    ridge: float = 1e-4,
    fairness: float = 1.0,
    heed: float = 2.0,
    rounds: int = 400,
    doc_id: str = "doc_id",
    text: str = "text",
) -> ToxicityModel:
    """Logistic regression over words and stems, regularised by counterfactuals. Weights are not
    negative, so that no amount of harmless words outweighs an insult in a long text.

    Labelled sentences that name a group are also read with every other group of the same kind in
    its place; the squared change of the score is added to the loss, ``fairness`` times its
    mean, so that the model puts the blame on what is said and not on whom it mentions. A pair that
    no sentence has is held together with a small weight of its own.

    At most ``sample`` labelled rows are used, chosen by a hash of their id; they are the bound of
    what is broadcast (their ids) and of what reaches the driver (their features, out of ``size``
    chosen ones; ``evidence`` keeps out rare words that are toxic by accident). A toxic row counts ``heed`` times. Rows without a label or text are not learned from; of a repeated id every row counts.
    """
    marked = (
        labels.select(F.col(doc_id).alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("id is not null and toxic in (0, 1)")
        .orderBy(F.xxhash64("id"), "id", "toxic")
        .limit(sample)
    )
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    labelled = materialise(texts.join(F.broadcast(marked), "id").select("text", "toxic"))
    totals = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel({}, float(np.log((n_toxic + 0.5) / (n_clean + 0.5))))
    names = _chosen(feature_counts(labelled), n_toxic, n_clean, size, evidence)
    index = {f: k for k, f in enumerate(names)}
    rows, terms = _presence(labelled, names)
    y = np.array([r[0] for r in rows], float)
    column = np.concatenate([np.array(r[1], np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    # a rarer feature has a larger value, so that its weight is found as fast as others
    value = (np.maximum(np.bincount(column, minlength=len(names)), 1) / len(y)) ** -0.25
    share = np.where(y == 1, heed, 1.0)
    share /= share.sum()

    def product(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, (w[:-1] * value)[column], len(y)) + w[-1]

    def back(u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, u[row], len(names)) * value, u.sum())

    # one row for each ordered pair of terms: features of the term minus those of its stand-in
    pairs = [(a, b) for a in SWAPS for b in SWAPS[a]]
    change = np.zeros((len(pairs), len(names)))
    for k, (a, b) in enumerate(pairs):
        for word, sign in ((a, 1.0), (b, -1.0)):
            for f in features(word):
                if f in index:
                        change[k, index[f]] += sign * value[index[f]]
    weight = np.array([0.01 + terms[a] / len(SWAPS[a]) for a, _ in pairs])
    touched = np.abs(change).sum(1) > 0
    change, weight = change[touched], weight[touched] / max(1.0, weight[touched].sum())

    def gradient(w: np.ndarray) -> np.ndarray:
        chance = 1 / (1 + np.exp(-np.clip(product(w), -50, 50)))
        g = back((chance - y) * share)
        g[:-1] += ridge * w[:-1]
        if len(change):
            g[:-1] += 2 * fairness * change.T @ (weight * (change @ w[:-1]))
        return g

    # the step follows from the largest curvature, found by power iteration
    v = np.ones(len(names) + 1)
    for _ in range(30):
        v /= np.linalg.norm(v)
        v = back(product(v) * share / 4)
    steep = np.linalg.norm(v) * 1.1 + ridge
    if len(change):
        steep += 2 * fairness * float((weight[:, None] * change**2).sum())
    start = np.zeros(len(names) + 1)
    start[-1] = np.log(n_toxic / n_clean)
    w = _minimise(gradient, start, 1 / steep, rounds)
    return ToxicityModel({f: float(w[k] * value[k]) for k, f in enumerate(names)}, float(w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 if the score is at least 0.5); null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in batch_steps(batch, "text"):
                score = shared.value.scores(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "score": score,
                        "predicted": pa.array((score >= 0.5).astype(np.int32)),
                    }
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, f"doc_id {kind}, score double, predicted int"
    )


def held_out_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels of learnable documents, score all, and say which were held out."""
    model = fit_toxicity(docs, labels.filter(learnable()))
    return score_toxicity(docs, model).select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; rows of one id that has
    several texts go if any of them is toxic."""
    name = free_name(docs)
    toxic = held_out_toxicity(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(toxic, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
