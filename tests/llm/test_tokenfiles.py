"""Token files against the library: an exact round trip, and digests of it."""

import io
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ostinato.llm.tokenfiles import MAGIC, decode_numbers, encode_numbers, pack_frame, read_frames, read_token_files, token_file_digests, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("count", [0, 1, 3, 4, 5, 1001])
def test_numbers(count):
    numbers = (2 ** (np.random.default_rng(count).random(count) * 32)).astype(np.uint64).astype("<u4")
    control, data = encode_numbers(numbers)
    assert len(control) == -(-count // 4)
    assert len(data) == sum(max(1, (int(n).bit_length() + 7) // 8) for n in numbers)
    assert decode_numbers(control, data, count).tolist() == numbers.tolist()


def test_borders():
    numbers = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], "<u4")
    control, data = encode_numbers(numbers)
    assert list(control) == [0b01_01_00_00, 0b11_11_10_10]
    assert decode_numbers(control, data, 8).tolist() == numbers.tolist()


def test_frames():
    frame = pack_frame(pa.array(["a", None]), np.array([2, 0]), np.array([300, 7]))
    (named, counts, ranks), = read_frames(io.BytesIO(MAGIC + frame))
    assert named.to_pylist() == ["a", None] and counts.tolist() == [2, 0] and ranks.tolist() == [300, 7]
    with pytest.raises(ValueError):
        list(read_frames(io.BytesIO(MAGIC + frame[:-1])))
    with pytest.raises(ValueError):
        list(read_frames(io.BytesIO(b"other file")))


def documents():
    texts = ["the cat sat on the mat", "", None, "it's groß  \n\n x", "日本語", "the cat", "word " * 3000]
    return [(k * 7 % 41 - 3, texts[k % len(texts)]) for k in range(41)] + [(None, "no id"), (5, "twice"), (5, "twice"), (5, "another")]


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def test_round_trip(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "doc_id long, text string, shard int, tokens int, tie int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files from few rows
    try:
        manifest = write_token_files(docs, PATH, str(tmp_path / "files"), frame=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1
    got = read_token_files(manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.tokens) for r in got) == sorted((a is not None, a or 0, library_ids(b)) for a, b in rows)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.place))]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert all(r.n_tokens == len(r.tokens) and r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in got)
    # ranks: the most frequent id comes first
    ranks = np.frombuffer((tmp_path / "files" / "ranks.u32").read_bytes(), "<u4").tolist()
    counts = np.bincount(np.concatenate([r.tokens for r in got]))
    assert ranks == sorted(np.flatnonzero(counts).tolist(), key=lambda k: (-counts[k], k))


def test_digests(spark):
    rows = [r for r in documents() if r[0] is not None and r[1] not in ("twice", "another")]
    got = token_file_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH).collect()
    start, want = 0, []
    for a, b in sorted(rows):
        ids = library_ids(b)
        want.append((a, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == want


def test_other_ids_and_no_rows(spark):
    names = spark.createDataFrame([("b", "x y"), ("a", "z")], "name string, body string")
    got = sorted(map(tuple, token_file_digests(names, PATH, doc_id="name", text="body").collect()))
    assert [r[:3] for r in got] == [("a", 0, 2), ("b", 2, 3)]
    assert token_file_digests(names.limit(0), PATH, doc_id="name", text="body").collect() == []
