"""Held-out accuracy, and scores that do not change with the group a text names."""

import random

from ostinato.llm.toxicity import (
    IDENTITIES,
    ToxicityModel,
    drop_toxic,
    feature_counts,
    features,
    fit_toxicity,
    held_out_toxicity,
    score_toxicity,
    words,
)

INSULTS = ["grobian", "flunkard", "snotling"]


def corpus(n=900, seed=1, biased=False):
    """Clean and toxic texts; if biased, most toxic ones name one group, clean ones seldom do, and
    not all toxic ones have an insult."""
    rng = random.Random(seed)
    plain = ["w%s" % "".join(rng.choices("abcdefgh", k=4)) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        body = rng.choices(plain, k=rng.randint(3, 40))
        if toxic and not (biased and rng.random() < 0.4):
            body.insert(rng.randrange(len(body)), rng.choice(INSULTS) + rng.choice(["", "s", "$$"]))
        if biased and rng.random() < (0.6 if toxic else 0.03):
            body.insert(rng.randrange(len(body)), "muslims")
        if biased and not toxic and rng.random() < 0.3:
            body.insert(rng.randrange(len(body)), rng.choice(["christians", "hindus"]))
        docs.append((i, " ".join(body).capitalize() + ".", "en", "s", 3))
        labels.append((i, 1, toxic))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, toxic string, score int"


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    rows, marks = corpus()
    docs, labels = frames(spark, rows, marks)
    found = held_out_toxicity(docs, labels).collect()
    toxic = {i: t for i, _, t in marks}
    held = [r for r in found if r.held_out]
    assert len(found) == len(rows) and 100 < len(held) < 250
    assert sum(r.predicted == toxic[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_counterfactual(spark):
    docs, labels = frames(spark, *corpus(biased=True))
    free, fair = (fit_toxicity(docs, labels, fairness=f) for f in (0.0, 20.0))
    neutral = [f"we met many {x} there today" for x in IDENTITIES[3]]
    gap = [m.scores(neutral).max() - m.scores(neutral).min() for m in (free, fair)]
    assert gap[0] > 0.02 and gap[1] < gap[0] / 3
    mention = ["muslims live here"]
    assert fair.scores(mention)[0] < free.scores(mention)[0]
    assert fair.scores(["you snotling"])[0] > 0.5


def test_edges(spark):
    rows, marks = corpus(300)
    rows += [(5000, None, None, None, None), (5001, "", "en", "x", 1), (5001, "", "en", "x", 1), (None, "grobian", "en", "x", 1), (5003, "grobian " * 5000, "en", "x", 1)]
    marks += [(5001, 1, None), (None, 1, 1), (3, 1, 1), (99999, 1, 1), (7, 1, 5)]
    docs, labels = frames(spark, rows, marks)
    found = held_out_toxicity(docs, labels).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[5000].score == by_id[5001].score < 0.5 and by_id[5003].predicted == 1 and by_id[None].predicted == 1
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in by_id.items() if r.predicted == 0}


def test_no_labels(spark):
    rows, _ = corpus(20)
    docs, labels = frames(spark, rows, [(1, 1, 0)])
    found = held_out_toxicity(docs, labels.limit(0)).collect()
    assert len(found) == 20 and len({r.score for r in found}) == 1
    assert score_toxicity(docs.limit(0), ToxicityModel({}, 0.0)).count() == 0


def test_feature_counts(spark):
    rows, marks = corpus(60)
    toxic = {i: t for i, _, t in marks}
    labelled = spark.createDataFrame([(t, toxic[i]) for i, t, *_ in rows], "text string, toxic int")
    want = {}
    for i, t, *_ in rows:
        for f in {f for w in words(t) for f in features(w)}:
            want.setdefault(f, [0, 0])[toxic[i]] += 1
    for flush in (300_000, 20):
        got = {r.feature: [r.clean, r.toxic] for r in feature_counts(labelled, flush).collect()}
        assert got == want
