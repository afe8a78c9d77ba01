"""Language identification by interpolated Kneser-Ney models of character 4-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import GROUP_ROWS, grouped_quantiles
from ..session import materialise
from .common import batch_steps, learnable, stored

ORDER = 4
CHAR = np.uint64(16)
PAD = " " * (ORDER - 1)
_LETTER = np.array([chr(c).isalpha() for c in range(2**16)])


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased characters of all texts, each after three spaces and before one; whatever is
    no letter is a space, runs of spaces are one. Then the index of the text of every character,
    and which of them are predicted (all but the leading spaces). Characters beyond the basic
    plane share codes with those 2**16 below them."""
    code = np.frombuffer("".join(PAD + "\0" + t.lower() + "\0" for t in texts).encode("utf-32-le", "replace"), "<u4")
    low = (code & 0xFFFF).astype(np.uint16)
    letter = _LETTER[low]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        kinds, which = np.unique(code[far], return_inverse=True)
        letter[far] = np.array([chr(c).isalpha() for c in kinds.tolist()])[which]
    lead = np.zeros(len(code), bool)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter
    own = np.array([len(t.lower()) for t in texts], np.int64) + 2 + len(PAD)
    start = np.cumsum(own) - own
    for k in range(len(PAD)):
        keep[start + k] = lead[start + k] = True
    low = np.where(letter, low, 32)
    text = np.repeat(np.arange(len(texts)), own)
    return low[keep], text[keep], ~lead[keep]


def grams(low: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """The 4-gram that ends in each predicted character, 16 bits a character."""
    wide = low.astype(np.uint64)
    key = wide.copy()
    for k in range(1, ORDER):
        key[k:] |= wide[:-k] << (CHAR * np.uint64(k))
    return key[predicted]


def gram_counts(labelled: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """(lang, gram, n) over all rows of (text, lang); counts of a task are summed before they leave it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            key, at = np.unique(key, return_inverse=True)
            held[lang] = [(key, np.bincount(at, n).astype(np.int64))]
            return held[lang][0]

        def rows() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                key, n = merged(lang)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(key), pa.string()), "gram": key.view(np.int64), "n": n}
                )
            held.clear()

        for batch in batches:
            for part, texts in batch_steps(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), object)
                low, text, predicted = characters(texts)
                key, lang = grams(low, predicted), langs[text[predicted]]
                for name in set(langs.tolist()):
                    held.setdefault(name, []).append(np.unique(key[lang == name], return_counts=True))
            if sum(len(k) for runs in held.values() for k, _ in runs) > flush:
                for name in list(held):
                    merged(name)
                if sum(len(k) for runs in held.values() for k, _ in runs) > flush // 2:
                    yield from rows()
        yield from rows()

    part = labelled.select("lang", "text").mapInArrow(work, "lang string, gram bigint, n bigint")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class _Level:
    """One order: keys seen in any language, sorted, with a probability per language; contexts,
    sorted, with the weight that each language gives to the shorter context."""

    keys: np.ndarray
    prob: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


@dataclass
class LanguageModel:
    langs: list[str]
    levels: list[_Level]  # order 1 first
    floor: float
    heat: float = 1.0
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        top = self.levels[-1]
        self.log = np.log(top.prob).astype(np.float32)
        # a direct-mapped front of the sorted array; likelier keys win a place
        self.slot = np.full(2**20, -1, np.int32)
        order = np.argsort(top.prob.max(1), kind="stable")
        self.slot[self._place(top.keys[order])] = order

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _prob(self, key: np.ndarray, order: int) -> np.ndarray:
        """Probability per language of any key; unseen ones from shorter contexts."""
        if order == 0:
            return np.full((len(key), len(self.langs)), self.floor)
        level = self.levels[order - 1]
        at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
        result = level.prob[at]
        miss = np.flatnonzero(level.keys[at] != key)
        if len(miss):
            context = key[miss] >> CHAR
            c = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            back = np.where((level.contexts[c] == context)[:, None], level.back[c], 1.0)
            mask = np.uint64(2 ** (16 * (order - 1)) - 1)
            result[miss] = back * self._prob(key[miss] & mask, order - 1)
        return result

    def logs(self, key: np.ndarray) -> np.ndarray:
        at = self.slot[self._place(key)]
        good = self.levels[-1].keys[at] == key
        result = self.log[at]
        rest = np.flatnonzero(~good)
        if len(rest):
            new, which = np.unique(key[rest], return_inverse=True)
            result[rest] = np.log(self._prob(new, ORDER))[which]
        return result

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: log-probability in each language, predicted characters, letters."""
        low, text, predicted = characters(texts)
        n = np.bincount(text[predicted], minlength=len(texts))
        letters = np.bincount(text[low != 32], minlength=len(texts))
        logs = self.logs(grams(low, predicted))
        total = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(logs, (np.cumsum(n) - n)[some], axis=0, dtype=np.float64)
        return total, n, letters


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


def kneser_ney(langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], discounts: list[float]) -> LanguageModel:
    """Interpolated Kneser-Ney from each language's 4-grams (sorted keys, counts): the highest order
    has counts, every lower one the number of different characters seen before it."""
    tables = []  # per language, order 1 first: keys, counts
    for key, n in counts:
        stack = [(key, n)]
        for order in range(ORDER - 1, 0, -1):
            mask = np.uint64(2 ** (16 * order) - 1)
            stack.append(np.unique(stack[-1][0] & mask, return_counts=True))
        tables.append(stack[::-1])
    levels: list[_Level] = []
    symbols = np.unique(np.concatenate([t[0][0] for t in tables]))
    floor = 1.0 / (len(symbols) + 1)
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([t[order - 1][0] for t in tables]))
        contexts = np.unique(keys >> CHAR)
        prob, back = np.empty((len(keys), len(langs))), np.ones((len(contexts), len(langs)))
        lower = np.full((len(keys), len(langs)), floor)
        if order > 1:
            lower = levels[-1].prob[np.searchsorted(levels[-1].keys, keys & np.uint64(2 ** (16 * (order - 1)) - 1))]
        where = np.searchsorted(contexts, keys >> CHAR)
        for j, t in enumerate(tables):
            own, n = t[order - 1]
            discount = discounts[j] if order == ORDER else _discount(n)
            context = np.searchsorted(contexts, own >> CHAR)
            total = np.bincount(context, n, len(contexts))
            kinds = np.bincount(context, minlength=len(contexts))
            back[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            seen = np.zeros(len(keys))
            seen[np.searchsorted(keys, own)] = n - discount
            prob[:, j] = seen / np.maximum(total, 1)[where] + back[where, j] * lower[:, j]
        levels.append(_Level(keys, prob, contexts, back))
    return LanguageModel(langs, levels, floor)


def fit_languages(
    docs: DataFrame, budget: int = 1_000_000, text: str = "text", lang: str = "lang"
) -> LanguageModel | None:
    """Count the 4-grams of all texts with a language, and estimate one model for each; None if
    no text has a language and a letter.

    All counting is distributed. The models together hold at most ``budget`` 4-grams, the bound of
    what is sent to tasks: where a language has more than its share, those under the smallest count
    that fits are left to shorter contexts; the discount still comes from its whole table. All of
    the same rows calibrate scores and rejection.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    counts = materialise(gram_counts(rows))
    # how many 4-grams have each count: a few thousand different counts a language
    spectrum: dict[str, dict[int, int]] = {}
    for r in counts.groupBy("lang", F.least("n", F.lit(1000)).alias("n")).count().collect():
        spectrum.setdefault(r[0], {})[r[1]] = r[2]
    langs = sorted(spectrum)
    if not langs:
        return None
    least, discounts = {}, []
    for name in langs:
        have, cut = sum(spectrum[name].values()), 1
        while have > budget // len(langs) and cut < 1000:
            have -= spectrum[name].get(cut, 0)
            cut += 1
        least[name] = cut
        one, two = spectrum[name].get(1, 0), spectrum[name].get(2, 0)
        discounts.append(min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5)
    limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    kept = counts.filter(F.col("n") >= F.element_at(limit, F.col("lang"))).toArrow()
    names = kept.column("lang").to_numpy(zero_copy_only=False)
    key, n = kept.column("gram").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    parts = []
    for name in langs:
        at = np.flatnonzero(names == name)
        at = at[np.argsort(key[at])]
        parts.append((key[at], n[at]))
    model = kneser_ney(langs, parts, discounts)
    return _calibrated(model, rows)


def _calibrated(model: LanguageModel, rows: DataFrame) -> LanguageModel:
    """The heat of least loss over all rows, and for each language the exact median entropy per
    character and its usual deviation."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    heats = np.geomspace(0.01, 1.0, 25)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {name: j for j, name in enumerate(m.langs)}
        for batch in batches:
            for part, texts in batch_steps(batch, "text"):
                logs, n, _ = m.totals(texts)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                langs = part.column("lang").take(pa.array(some))
                logs, n = logs[some], n[some].astype(np.int64)
                at = np.arange(len(some)), np.array([place[x] for x in langs.to_pylist()])
                # the first row bears the losses of all
                losses = [[float(-np.log(np.maximum(_soft(logs * h)[at], 1e-12)).sum()) for h in heats]] + [None] * (len(some) - 1)
                yield pa.RecordBatch.from_pydict(
                    {"lang": langs, "entropy": -logs[at] / n, "n": n, "losses": pa.array(losses, pa.list_(pa.float64()))}
                )

    found = stored(rows.select("lang", "text").mapInArrow(work, "lang string, entropy double, n bigint, losses array<double>"))
    sums = found.agg(*[F.sum(F.get("losses", F.lit(k))) for k in range(len(heats))]).first()
    if sums[0] is not None:
        model.heat = float(heats[int(np.argmin(sums))])
    sizes = {r[0]: r[1] for r in found.groupBy("lang").count().collect()}
    large = max(sizes.values(), default=0) > GROUP_ROWS

    def medians(value: Column) -> dict[str, float]:
        frame = found.select("lang", value.alias("value"))
        return {r.lang: r.middle for r in grouped_quantiles(frame, ["lang"], "value", [0.5], ["middle"], split=large).collect()}

    model.usual, model.spread = np.full(len(model.langs), np.inf), np.ones(len(model.langs))
    if not sizes:
        return model
    usual = medians(F.col("entropy"))
    middle = F.element_at(F.create_map(*[F.lit(x) for pair in usual.items() for x in pair]), F.col("lang"))
    apart = medians(F.abs(F.col("entropy") - middle) * F.sqrt("n"))
    for j, name in enumerate(model.langs):
        if sizes.get(name, 0) >= 10:
            model.usual[j], model.spread[j] = usual[name], max(1e-3, apart[name] * 1.4826)
    return model


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def identify(
    docs: DataFrame, model: LanguageModel | None, tolerance: float = 6.0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, lang_pred, score, cross_entropy (nats a character), rejected.

    The language whose model has the lowest cross-entropy per character, ties to the first name;
    ``und`` with score 0 if the text is null or has no letter, or if there is no model. The score is the calibrated
    probability of the language. ``rejected`` says that the text is unlike all of them: its
    cross-entropy lies over ``tolerance`` deviations, as calibrated for its length, above what is
    usual in that language; a caller who wants open-set labels replaces lang_pred there.
    """
    if model is None:
        none = F.lit(0.0)
        return docs.select(
            F.col(doc_id).alias("doc_id"),
            F.lit("und").alias("lang_pred"),
            none.alias("score"),
            none.alias("cross_entropy"),
            F.lit(True).alias("rejected"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for rows, texts in batch_steps(batch, "text"):
                logs, n, letters = m.totals(texts)
                best = logs.argmax(1)
                score = _soft(logs * m.heat)[np.arange(len(best)), best]
                entropy = -logs[np.arange(len(best)), best] / np.maximum(n, 1)
                limit = m.usual[best] + tolerance * m.spread[best] / np.sqrt(np.maximum(n, 1))
                none = letters == 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "lang_pred": pa.array(names[np.where(none, len(m.langs), best)].tolist(), pa.string()),
                        "score": np.where(none, 0.0, np.clip(score, 0, 1)),
                        "cross_entropy": np.where(none, 0.0, entropy),
                        "rejected": none | (entropy > limit),
                    }
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean"
    )


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Fit on the learnable documents, identify all, and say which were held out."""
    model = fit_languages(docs.filter(learnable()))
    found = identify(docs, model)
    return found.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
