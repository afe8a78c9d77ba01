"""SimHash components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from ostinato.llm.graph import components
from ostinato.llm.simhash import _gray_rank, _links, fingerprint, near_duplicates, near_links


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, most=2):
    """Smallest member of each number's component."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("text", ["", " \n", "One", "One two", "A b C", "a b c d", "É É e x\xa0y z", "the the the the the"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_index():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        group = np.sort(rng.integers(0, 3, n))
        code = rng.integers(0, 2**16 if n < 300 else 700, n).astype(np.uint64)
        pairs = np.unique(np.stack([group.astype(np.uint64), code]), axis=1)
        group, code = pairs[0].astype(np.int64), pairs[1]
        order = np.lexsort([_gray_rank(code), group])
        group, code = group[order], code[order]
        for most in (0, 1, 2):
            a, b = _links(group, code, most)
            got = {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
            want = {
                (i, j)
                for i in range(len(code))
                for j in range(i + 1, len(code))
                if group[i] == group[j] and (int(code[i]) ^ int(code[j])).bit_count() <= most
            }
            assert got == want


def test_links(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(40):
        fp = rng.getrandbits(64)
        for _ in range(12):  # chains of near fingerprints
            fps.add(fp)
            for _ in range(rng.randint(1, 3)):
                fp ^= 1 << rng.randrange(64)
    frame = spark.createDataFrame([(signed(f),) for f in [*fps, *fps]], "fp long")
    found = {r.node: r.root for r in components(near_links(frame)).collect()}
    want = brute(fps)
    members = {}
    for f in fps:
        members.setdefault(want[f], set()).add(signed(f))
    for group in members.values():
        assert len({found.get(f, f) for f in group}) == 1
    assert len({found.get(signed(f), signed(f)) for f in fps}) == len(members)


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 200), (7, 7), (300, None), (150, 100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    rng = random.Random(5)
    words = ["w%d" % k for k in range(50)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 30, 400]))]
        for _ in range(rng.choice([1, 1, 4])):
            text = list(base)
            if text and rng.random() < 0.7:
                text[rng.randrange(len(text))] = "Changed"
            rows.append((len(rows), " ".join(text), k))
    rows += [(1000, None, 0), (1001, " ", 0), (3, rows[3][1], 0), (None, rows[5][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    fps = {t: slow_fingerprint(t or "") for _, t, _ in rows}
    root = brute(set(fps.values()))
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[root[fps[t]]] = min(smallest.get(root[fps[t]], 10**9), i)
    want = sorted((str(i), f"{fps[t]:016x}", smallest[root[fps[t]]]) for i, t, _ in rows)
    got = near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert near_duplicates(docs.limit(0)).count() == 0
