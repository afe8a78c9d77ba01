"""Removed bytes against a scan of all strings."""

import hashlib
import random

import numpy as np
import pytest
from ostinato.llm.substring import first_smallest, remove_repeats, rolling, union


def brute(docs, length):
    """Kept bytes, removed count and runs of each (id, text)."""
    docs = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, raw in docs:
        for p in range(len(raw) - length + 1):
            place = (i, p)
            first[raw[p : p + length]] = min(first.get(raw[p : p + length], place), place)
    gone = {}
    for i, raw in docs:
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (i, p):
                gone.setdefault(i, set()).update(range(p, p + length))
    out = []
    for i, raw in docs:
        marks = {p for p in gone.get(i, ()) if p < len(raw)}
        kept = bytes(b for p, b in enumerate(raw) if p not in marks)
        out.append((len(raw), len(marks), sum(p - 1 not in marks for p in marks), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length=100, width=24, **how):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k string").repartition(3)
    got = remove_repeats(docs, length, width, digests=True, **how).collect()
    want = sorted(zip([str(i) for i, _ in rows], brute(rows, length), strict=True))
    assert sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want


def corpus(seed, n, letters="abcdefghé 日\n"):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice([60, 99, 101, 180]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.5:
                parts.append(rng.choice(passages))
            elif kind < 0.6:
                parts.append(rng.choice(["a", "ab", "abc"]) * rng.randint(1, 120))
            else:
                parts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 150))))
        if rows and rng.random() < 0.2:
            parts.append(rng.choice(rows)[1] or "")
        rows.append((rng.choice([3, -7, 1000]) * i if i % 9 else i, "".join(parts)))
    return [(i, t) for (i, t) in dict(rows).items()]


@pytest.mark.parametrize("seed", [1, 2])
def test_contract_length(spark, seed):
    check(spark, corpus(seed, 60))


def test_short_strings(spark):
    check(spark, corpus(3, 50, "ab"), length=12, width=4)


def test_cases(spark):
    long = "".join(chr(97 + k * k % 26) for k in range(150))
    rows = [(4, long), (2, None), (2, None), (3, ""), (1, "x" + long[:120]), (5, "z" * 350), (5, "z" * 350), (None, long[20:]), (6, "short")]
    check(spark, rows)
    check(spark, [(7, long), (7, long[30:] + "tail"), (8, long)])
    check(spark, [])


def test_hot_class(spark, monkeypatch):
    """A class with more rows than are ordered together goes on by its strings."""
    import ostinato.llm.substring as module

    shared = "".join(chr(97 + k * 7 % 26) for k in range(70))
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("pqrs") for _ in range(40)) + shared + rng.choice("uv") * 30 + rng.choice(["", "w" * 40])) for i in range(200)]
    order = module._order
    for most in (0, 3, 50, 10**6):
        monkeypatch.setattr(module, "_order", lambda length, _, most=most: order(length, most))
        check(spark, rows)


def test_helpers():
    raw = np.frombuffer(b"abcabcabcabdabcabc", np.uint8)
    for width in (1, 3, 5, 8):
        h = rolling(raw, width).tolist()
        words = [bytes(raw[k : k + width]) for k in range(len(raw) - width + 1)]
        assert all((a == b) == (h[i] == h[j]) for i, a in enumerate(words) for j, b in enumerate(words))
    values = np.array([3, 1, 2, 1, 5, 5, 0, 1], np.uint64)
    for reach in (1, 2, 3, 5, 8):
        want = [min(range(k, k + reach), key=lambda p: (values[p], p)) for k in range(len(values) - reach + 1)]
        assert first_smallest(values, reach).tolist() == want
    start, stop = union(np.array([5, 0, 2, 20]), np.array([7, 4, 5, 21]))
    assert (start.tolist(), stop.tolist()) == ([0, 20], [7, 21])


def test_text_itself(spark):
    text = "".join(random.Random(3).choices("abcdefgh", k=150))
    docs = spark.createDataFrame([(1, text), (2, "head" + text)], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept).decode() for r in remove_repeats(docs).collect()}
    assert kept == {1: text, 2: "head"}
