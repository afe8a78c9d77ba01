"""Exact duplicates against brute force, with nulls, ties, repeated rows and a hot group."""

import re

from ostinato.llm.exact import drop_exact_duplicates, exact_duplicates


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is not None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        best = min(g)
        out.append((str(i), str(best[3]), len(g), i == best[3] and len(t or "") == -best[0]))
    return sorted(out)


def check(spark, rows, **how):
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, keep_id string")
    got = exact_duplicates(docs, **how).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == brute(rows)


def test_cases(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a\tb"), (9, None), (8, ""), (7, " \n\x0b\x0c\r"), (1, "a\xa0b"), (2, "A b"), (6, "é e"), (6, "é e")]
    check(spark, rows)
    check(spark, rows + [(None, "a  b"), (None, "zz")])
    check(spark, [])


def test_hot_group(spark):
    rows = [(i, ("the same text" + " " * (i % 3)) if i % 3 else f"text {i}") for i in range(2000)]
    check(spark, rows)
    check(spark, rows, fan=2, rounds=5)


def test_drop(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (3, None, None), (4, "", "z")], "doc_id long, text string, kept string")
    assert sorted(tuple(r) for r in drop_exact_duplicates(docs).collect()) == [(1, "a b", "x"), (3, None, None)]


def test_no_python(spark):
    plan = exact_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
