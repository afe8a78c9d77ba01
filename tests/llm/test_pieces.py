"""Piece spans against the library's own, also through a character map; digests end to end."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from ostinato.llm.pieces import CharacterMap, PieceCodec, encode_pieces, piece_digests
from sentencepiece import sentencepiece_model_pb2

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  two  spaces ", "Hello wörld", "▁mark", "日本語 text", "🙂 emoji\n\nlines\ttab", "a" * 300, "\x00nul", "½ﬁ ﬁx", "é é", "#$%&", " x", "x "]


def double_array(entries):
    """A small double-array trie in the form of a compiled character map."""
    strings, at = b"", {}
    for new in entries.values():
        at.setdefault(new, len(strings))
        if at[new] == len(strings):
            strings += new + b"\0"
    trie = {}
    for key, new in entries.items():
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = at[new]
    units, used = {0: 0}, {0}

    def place(node, pos):
        labels = [0 if b is None else b for b in node]
        base = next(b for b in range(1, 5000) if all((pos ^ b ^ x) not in used and pos ^ b ^ x > 0 for x in labels))
        units[pos] |= base << 10
        used.update(pos ^ base ^ x for x in labels)
        for byte, child in node.items():
            to = pos ^ base ^ (byte or 0)
            if byte is None:
                units[pos] |= 1 << 8
                units[to] = child | 1 << 31
            else:
                units[to] = byte
        for byte, child in node.items():
            if byte is not None:
                place(child, pos ^ base ^ byte)

    place(trie, 0)
    size = 1 << (2 * max(units)).bit_length()
    array = b"".join(struct.pack("<I", units.get(k, 0xFF if k else 0)) for k in range(size))
    return struct.pack("<I", len(array)) + array + strings


def library_spans(codec, text):
    pieces = codec.model.encode(text, return_type="proto").pieces
    return [p.id for p in pieces], [(p.begin, p.end) for p in pieces]


def agree(codec, text):
    ids = codec.encode([text])[0]
    begin, end = codec.spans(text, ids)
    assert (ids.tolist(), list(zip(begin.tolist(), end.tolist(), strict=True))) == library_spans(codec, text), text


@pytest.mark.parametrize("text", TEXTS)
def test_spans(text):
    agree(PieceCodec(MODEL), text)


def test_random_spans():
    rng, codec = random.Random(1), PieceCodec(MODEL)
    for _ in range(300):
        agree(codec, "".join(rng.choice("ab Zé日🙂\n\t▁.") for _ in range(rng.randint(0, 40))))


MAP = {"ﬁ": "fi", "½": "1/2", "é": "é", "\t": " ", "abc": "X", "ab": "Y Y"}


@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_character_map(tmp_path, trim, prefix):
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    proto.normalizer_spec.precompiled_charsmap = double_array({a.encode(): b.encode() for a, b in MAP.items()})
    proto.normalizer_spec.remove_extra_whitespaces = trim
    proto.normalizer_spec.add_dummy_prefix = prefix
    path = tmp_path / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    codec, rng = PieceCodec(str(path)), random.Random(2)
    assert codec.normalise.map.longest("xabcd".encode(), 1) == (3, b"X")
    assert codec.normalise.map.longest(b"xay", 1) is None
    for text in [*TEXTS, *("".join(rng.choice(["a", "b", "c", " ", "ﬁ", "½", "é", "\t", "日", "e"]) for _ in range(rng.randint(0, 25))) for _ in range(300))]:
        whole, place = codec.normalise(text.encode())
        assert whole.decode().replace("▁", " ") == codec.model.normalize(text).replace("▁", " "), text
        assert len(place) == len(whole) + 1
        agree(codec, text)


def test_no_map():
    assert CharacterMap(b"").longest(b"abc", 0) is None


def test_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS, None])] + [(None, "ab", "y"), (1, " ", "x")]
    rows = [(i, t.replace("\x00", "0") if t else t, x) for i, t, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = {(r.doc_id, r.ids_sha256): r for r in piece_digests(docs, MODEL).collect()}
    full = {(r.doc_id, tuple(r.ids)): r for r in encode_pieces(docs, MODEL).collect()}
    for i, t, _ in rows:
        ids = model.encode(t or "")
        r = found[i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert full[i, tuple(ids)].decoded == model.decode(ids)
        assert r.n_covered == len((t or "").encode())
    assert piece_digests(docs.limit(0), MODEL).count() == 0
