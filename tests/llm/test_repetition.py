"""Repetition measures against definitions by brute force."""

import random
import re

import pytest
from ostinato.llm.repetition import measure, repetition_rules


def brute(text, least=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    twice = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    covered, longest = set(), 0
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                covered |= set(range(i, i + k)) | set(range(j, j + k))
                longest = max(longest, sum(map(len, words[i : i + k])))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(twice),
        "repeat_chars": sum(len(words[k]) for k in covered),
        "longest_repeat": longest,
    }


def samples():
    rng = random.Random(5)
    texts = ["", "   \n", "a", "a b", "a " * 40, "ab\x85cd\xa0e " * 9, "é " * 17 + "x", "#1 <b>\n#1 <b>\n\n#2"]
    for k in (2, 3, 5, 30):
        for _ in range(12):
            words = [rng.choice(["the", "ö", "x#", "naïve", "yes", *map(str, range(k))]) for _ in range(rng.randint(1, 90))]
            if rng.random() < 0.5:
                i = rng.randrange(len(words))
                words[i:i] = words[: rng.randint(1, 40)]
            texts.append("".join(w + rng.choice([" ", "\n", "\t", " \n "]) for w in words))
    return texts


def test_brute_force():
    texts = samples()
    got = measure(texts)
    for k, text in enumerate(texts):
        assert {name: int(v[k]) for name, v in got.items()} == brute(text), text


@pytest.mark.parametrize("least", [8, 10, 13])
def test_least(least):
    texts = samples()
    got = measure(texts, least)
    for k, text in enumerate(texts):
        assert (got["repeat_chars"][k], got["longest_repeat"][k]) == tuple(
            brute(text, least)[c] for c in ("repeat_chars", "longest_repeat")
        )


def test_rows(spark):
    clean = " ".join(f"w{k}" for k in range(300))
    once = " ".join(f"w{k}" for k in [*range(300), *range(80)])
    rows = [(1, None, "x"), (1, None, "x"), (None, clean, None), (3, once, "y"), (4, "so it goes " * 30, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    found = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in repetition_rules(docs).collect())
    assert found == [(0, 300, False, True), (1, 0, True, False), (1, 0, True, False), (3, 380, True, False), (4, 90, True, False)]
    assert repetition_rules(docs.limit(0)).count() == 0
