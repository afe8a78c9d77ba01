"""Tokens against the library, plans and placements against their definitions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from ostinato.llm.packing import cut_documents, pack, pack_documents, packing_plan
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def texts():
    rng = random.Random(6)
    own = ["", " ", "Hello, World!! it's", "ÀÉÎ ß ẞ İI ΣΑΣ", "a\x1cb \x85c\xa0d e", "日本 語", "x<|endoftext|>y", "é ́a", "12345 3,14", "ﬁ ½", "--a-- (b)."]
    alphabet = ["a", "B", "é", "É", "'s", "'", " ", "\n", "1", "#", ".", ",", "日", "́", "\x1f", "İ", "ſ", "K"]
    return own + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]


@pytest.mark.parametrize(
    "sizes",
    [
        [],
        [1],
        [2048] * 5,
        [1025] * 9,
        [1024] * 9 + [1] * 3,
        [700, 683, 650, 1030, 1024] * 40,
        list(range(1, 2049)),
        [3] * 5000 + [2046] * 4900,
    ],
)
def test_plan(sizes):
    histogram = {}
    for n in sizes:
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing_plan(histogram)
    used = {}
    for content, n in plan:
        assert n > 0 and sum(k * a for k, a in content.items()) <= 2048
        for k, a in content.items():
            used[k] = used.get(k, 0) + a * n
    assert used == histogram
    total = sum(n for _, n in plan)
    large = sum(n > 1024 for n in sizes)
    assert total <= max(-(-sum(sizes) // 2048), large) * 1.1 + 1


def best_possible(sizes, room):
    """Fewest sequences by search."""
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= room:
                place(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def test_plan_optimal():
    rng = random.Random(7)
    worse = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        plan = packing_plan({n: sizes.count(n) for n in sizes}, 20)
        worse += sum(n for _, n in plan) - best_possible(sizes, 20)
    assert worse <= 2


def verify(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


def test_pack(spark):
    rng = random.Random(9)
    rows = [(i, 0, rng.choice([5, 5, 5, 7, 13, 20])) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    for share in (500_000, 10):
        got = pack(pieces, 20, share=share).collect()
        assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted(rows)
        verify(got, 20)
    assert pack(pieces.limit(0), 20).count() == 0


def test_documents(spark):
    own = texts()[:60]
    rows = [(i, t, 1) for i, t in enumerate(own)] + [(100, None, 2), (101, "word " * 5000, 3), (101, "word " * 5000, 3), (None, "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack_documents(docs, PATH).collect()
    verify(got, 2048)
    want = []
    for i, t, _ in rows:
        ids = [*library_ids(t), 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want.append((str(i), k // 2048, k, len(part) // 4, zlib.crc32(part)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert bytes(cut_documents(docs.filter("doc_id = 100"), PATH).first().ids) == b"\0\0\0\0"
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_clashing_columns(spark):
    rows = [(k, 0, 700 + k % 5, "own") for k in range(40)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, _part string").selectExpr("*", "1 AS _rank", "2 AS _before", "3 AS _ordinal")
    got = pack(pieces).collect()
    assert len(got) == 40 and {(r._part, r._rank, r._before, r._ordinal) for r in got} == {("own", 1, 2, 3)}
    assert len({(r.sequence_id, r.offset) for r in got}) == 40
