"""Ranked search against plain scoring of every document, and against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ostinato.llm.ranked import RANKED_SQL, _Block, best_of_block, ranked_search, terms

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def expected(docs, items, keep=50):
    held = [(d, plain_terms(t)) for d, t in docs]
    total, size = sum(bool(x) for _, x in held), sum(len(x) for _, x in held)
    df = Counter(t for _, x in held for t in set(x))
    out = []
    for item, text in items:
        scored = []
        for d, x in held:
            tf, m = Counter(x), 50 + 50 * len(x) * total // size if size else 0
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m))
                for t in set(plain_terms(text))
                if tf[t]
            )
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:keep])]
    return out


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(150)] + ["É", "é", "Straße", "日本", "a_b", "ＡＢ"]
    weights = [1 / (k + 1) for k in range(len(words))]
    make = lambda k: " ".join(rng.choices(words, weights, k=k)).replace("w1 ", "W1, ")
    docs = [(k, make(rng.choice((3, 10, 40)))) for k in range(n)]
    docs += [(n + k, docs[k % 3][1]) for k in range(90)]  # more equal scores than are kept
    docs += [(900, None), (901, ""), (902, "!!! --"), (903, "w3 " * 4000), (7, docs[5][1]), (None, docs[6][1])]
    items = [(k, make(rng.choice((2, 6, 120)))) for k in range(8)] + [(20, None), (21, "?!"), (22, "unseen"), (23, docs[0][1]), (23, docs[1][1])]
    items += [(24, " ".join(words))]
    return docs, items


def key(row):
    return str(row[0]), row[1], row[3], str(row[2])


@pytest.mark.parametrize("batch, item_bytes", [("10000", 4_000_000), ("40", 4_000_000), ("40", 300)])
def test_ranks(spark, batch, item_bytes):
    docs, items = corpus()
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n int, item int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, part int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = list(map(tuple, ranked_search(frame, asked, item_bytes=item_bytes).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got, key=key) == sorted(expected(docs, items), key=key)


def test_sql(spark):
    docs, items = corpus()
    docs = [r for r in docs if r[0] is not None and r[0] != 7 or r[1] is None]
    items = [r for r in items if r[0] != 23]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]}))
    con.register("benchmark", pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": [t for _, t in items]}))
    assert sorted(con.execute(RANKED_SQL).fetchall()) == sorted(expected(docs, items))


def test_terms():
    for text in (None, "", "A_b C-d É́ x\x7fy 日本 12a", "".join(map(chr, range(0x250)))):
        assert [t.decode() for t in terms(text)] == plain_terms(text)


def test_no_rows(spark):
    docs, items = corpus(5)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search(frame.limit(0), asked).collect() == []
    assert ranked_search(frame, asked.limit(0)).collect() == []
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "name string, body string")
    got = ranked_search(named, spark.createDataFrame([("q", "X")], "item string, body string"), doc_id="name", item_id="item", text="body")
    assert [r[:3] for r in map(tuple, got.collect())] == [("q", 1, "a"), ("q", 2, "b")]


def test_groups_that_cannot_matter_are_left_out():
    """Of a thousand documents with a frequent word, few are scored once rarer words fill the list."""
    size = 3
    lists = [[0, 1, 2]] * 60 + [[0]] * 1000
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(range(len(lists))),
            "n": pa.array([10] * len(lists), pa.int64()),
            "terms": pa.array([np.array(x, "<u4").tobytes() for x in lists]),
            "counts": pa.array([np.ones(len(x), "<u4").tobytes() for x in lists]),
        }
    )
    weight = np.array([10, 2000, 3000])
    docs, scores, evaluated = best_of_block(_Block(batch, len(lists), 10 * len(lists), size), np.arange(3), weight, weight, 50, 1)
    assert docs.tolist() == list(range(50)) and len(set(scores.tolist())) == 1 and evaluated == 60
