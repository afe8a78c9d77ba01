"""Kneser-Ney models against the definition, and languages of held-out texts."""

import random
from collections import Counter

import numpy as np
import pytest
from ostinato.llm.langid import characters, fit_languages, gram_counts, grams, held_out_languages, identify, kneser_ney


def normalised(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    words = letters.split()
    return " ".join(words) + " " if words else ""


def key(gram):
    value = 0
    for c in gram:
        value = value << 16 | ord(c) & 0xFFFF
    return value


@pytest.mark.parametrize("texts", [["Hello, wörld!"], ["", "a", "1 2", "  x--y  "], ["𝔘 x", "日本", "İstanbul ß", "a\0b"], ["é" * 5, "b"]])
def test_characters(texts):
    low, text, predicted = characters(texts)
    for k, t in enumerate(texts):
        own = "   " + normalised(t)
        assert low[text == k].tolist() == [ord(c) & 0xFFFF for c in own]
        assert predicted[text == k].tolist() == [False] * 3 + [True] * (len(own) - 3)
    want = [key(("   " + normalised(t))[i - 3 : i + 1]) for t in texts for i in range(3, 3 + len(normalised(t)))]
    assert grams(low, predicted).tolist() == want


def slow_model(counts, discount):
    """Interpolated Kneser-Ney by its definition; counts of 4-grams as strings."""
    tables = {4: Counter(counts)}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    def d(n):
        ones = sum(v == 1 for v in tables[n].values())
        twos = sum(v == 2 for v in tables[n].values())
        return discount if n == 4 else min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def prob(gram, floor):
        n = len(gram)
        if n == 0:
            return floor
        followers = [v for g, v in tables[n].items() if g[:-1] == gram[:-1]]
        lower = prob(gram[1:], floor)
        if not followers:
            return lower
        seen = tables[n].get(gram, 0)
        return (max(seen - d(n), 0) + d(n) * len(followers) * lower) / sum(followers)

    return prob


def test_definition():
    rng = random.Random(1)
    counts = [Counter("".join(rng.choices(letters, k=4)) for _ in range(200)) for letters in ("abcd", "bcde ")]
    arrays = []
    for c in counts:
        pairs = sorted((key(g), n) for g, n in c.items())
        arrays.append((np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])))
    model = kneser_ney(["x", "y"], arrays, [0.7, 0.6])
    alphabet = sorted({c for g in counts[0] | counts[1] for c in g})
    tests = ["".join(rng.choices("abcde f", k=4)) for _ in range(300)]
    logs = model.logs(np.array([key(g) for g in tests], np.uint64))
    for j, (c, d) in enumerate(zip(counts, (0.7, 0.6), strict=True)):
        slow = slow_model(c, d)
        want = [np.log(slow(g, model.floor)) for g in tests]
        assert np.allclose(logs[:, j], want, atol=1e-4)
        for context in ("abc", "bcd", "zzz", "eea"):  # sums to one with the share of the unknown character
            total = sum(slow(context + x, model.floor) for x in alphabet)
            assert 0.5 < total <= 1 + 1e-9


WORDS = {"aa": ["tak", "mira", "solo", "pane"], "bb": ["zuth", "grumm", "oxy", "blicht"], "cc": ["ñeo", "çava", "été", "aïl"]}


def sample(lang, rng, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def frame(spark, n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, sample(lang, rng, rng.randint(2, 40)), lang, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rows


def test_counts(spark):
    docs, rows = frame(spark, 40)
    want = Counter()
    for _, t, lang, _ in rows:
        own = "   " + normalised(t)
        want.update((lang, key(own[i - 3 : i + 1])) for i in range(3, len(own)))
    for flush in (2_000_000, 50):
        got = {(r.lang, r.gram % 2**64): r.n for r in gram_counts(docs, flush).collect()}
        assert got == want


def test_held_out(spark):
    docs, rows = frame(spark)
    more = [(1000, None, "aa", "x"), (1001, "12 34 !", "aa", "x"), (1002, "", None, None), (1002, "", None, None), (None, "mira solo tak", None, "x")]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    found = held_out_languages(docs).collect()
    assert len(found) == len(rows) + len(more)
    langs = {i: lang for i, _, lang, _ in rows}
    right = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out and r.doc_id in langs]
    assert len(right) > 20 and all(right)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, None)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in found)


def test_rejection(spark):
    docs, _ = frame(spark)
    model = fit_languages(docs)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("qwxkjvzf ") for _ in range(300))) for i in range(5)]
    rows += [(10 + i, sample("bb", rng, 40)) for i in range(5)]
    found = {r.doc_id: r.rejected for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found == {i: i < 10 for i in found}


def test_budget(spark):
    docs, rows = frame(spark)
    small = fit_languages(docs, budget=90)
    assert all(len(level.keys) <= 90 for level in small.levels)
    found = {r.doc_id: r.lang_pred for r in identify(docs, small).collect()}
    assert sum(found[i] == lang for i, _, lang, _ in rows) > 0.9 * len(rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "1", "x")], "doc_id long, text string, lang string")
    assert fit_languages(docs) is None
    assert {(r.lang_pred, r.score) for r in held_out_languages(docs).collect()} == {("und", 0.0)}
    assert held_out_languages(docs.limit(0)).count() == 0


def test_all_rows_calibrate(spark, monkeypatch):
    """Usual entropy and spread are medians over every learnable row, also where values are cut into ranges."""
    rng = random.Random(8)
    rows = [(i, sample(lang, rng, rng.randint(2, 12)), lang) for i, lang in enumerate(["aa", "bb"] * 1600)]
    docs = spark.createDataFrame([*rows, (-1, "12 3", "aa"), (-2, None, "bb")], "doc_id long, text string, lang string")
    model = fit_languages(docs)
    for j, name in enumerate(model.langs):
        logs, n, _ = model.totals([t for _, t, lang in rows if lang == name])
        entropy = -logs[:, j] / n
        assert model.usual[j] == pytest.approx(np.median(entropy), rel=1e-9)
        assert model.spread[j] == pytest.approx(max(1e-3, np.median(np.abs(entropy - model.usual[j]) * np.sqrt(n)) * 1.4826), rel=1e-6)
    monkeypatch.setattr("ostinato.llm.langid.GROUP_ROWS", 100)
    again = fit_languages(docs)
    assert again.heat == model.heat and again.usual == pytest.approx(model.usual) and again.spread == pytest.approx(model.spread)
