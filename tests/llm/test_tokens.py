"""Ids of chunks put together against ids of whole texts from the library."""

import random
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ostinato.llm import tokens
from ostinato.llm.tokens import TextIds

OWN = ["", " ", "  ", "a ", " a", "Hello, World!! it's", "ÀÉÎ ß ẞ İI ΣΑΣ", "groß Größe ªµº", "a\x1cb \x85c\xa0d e", "日本 語", "é ́a", "12345 3,14"]
OWN += ["x<|endoftext|>y <|ENDOFTEXT|>  <|startoftext|>", "ﬁ ½ ² 3", "--a-- (b).", "\n\n a", "a \n b", "a  b", "don't DON'T 'S", "ﬃ  ᠎ x"]
OWN += [f"a{w}b" for w in ("  ", " \n", "\n ", "\n \n", "\xa0 ", " \xa0", "   ", "\x1c ", " \x1c ", "\t")]


def fuzz(n):
    rng = random.Random(6)
    odd = [chr(c) for c in range(9, 0x250)] + list(" \n\t '\x1c\x85\xa0́　ﬁΣςİı漢") * 20
    latin = [chr(c) for c in range(32, 256)] + list(" 's'llß\n") * 12
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 24))) for alphabet in (odd, latin) for _ in range(n)]


@pytest.mark.parametrize("name, cut", [("byte_bpe_50k.json", "before"), ("word_bpe_49k.json", "at")])
def test_ids(name, cut):
    path = public_tokenizers.path(name)
    encode, tokenizer = TextIds(path, limit=2000), Tokenizer.from_file(path)
    assert encode.cut == cut
    texts = OWN + fuzz(50_000)
    sample = Path("/root/testdata/sf0.01/documents.parquet")
    if sample.exists():
        texts += [r[0] or "" for r in duckdb.sql(f"select text from '{sample}'").fetchall()]
    for first in range(0, len(texts), 1000):
        part = texts[first : first + 1000]
        want = [x.ids for x in tokenizer.encode_batch(part, add_special_tokens=False)]
        got = [np.frombuffer(x, "<u4").tolist() for x in encode(part)]
        assert got == want, next(t for t, g, w in zip(part, got, want) if g != w)


def test_other_tokenizers_are_left_whole(tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.add_tokens(["two words"])
    tokenizer.save(str(tmp_path / "own.json"))
    encode = TextIds(str(tmp_path / "own.json"))
    assert encode.cut == "never"
    assert np.frombuffer(encode(["a two words b"])[0], "<u4").tolist() == tokenizer.encode("a two words b").ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_parts_meet_the_model_alone(name):
    path = public_tokenizers.path(name)
    encode, calls = TextIds(path, limit=3), []
    whole = encode._encode
    encode._encode = lambda texts: calls.extend(texts) or whole(texts)
    texts = ["Größe, it's  a\tnew wörd 12 ×", "new words, a new list", "", "漢 a word"]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [Tokenizer.from_file(path).encode(t).ids for t in texts]
    assert calls and not any("new" in c for c in calls)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_texts_are_split_in_arrays(name):
    path = public_tokenizers.path(name)
    encode = TextIds(path)
    encode._split_plain = None  # no pattern, and no string for each part
    texts = ["it's 'so, we'll  see\n", "", "'s\t's  're'vext'l 'll'", "wörd 2024 -- wörd"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [Tokenizer.from_file(path).encode(t).ids for t in texts]
    assert [len(x) for x in encode(["", "", " "])][:2] == [0, 0] and encode([]) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_in_small_tables(name, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 5)
    path, rng = public_tokenizers.path(name), random.Random(11)
    encode, library = TextIds(path, limit=20), Tokenizer.from_file(path)
    signs = ["".join(rng.choices(a, k=rng.randint(0, 30))) for a in ("'stmdrvel \n", " \t\n'a1!", "ab 'é") for _ in range(400)]
    words = [rng.choice(["a", "é", "7", "-", " ", "\n"]) * n for n in (1, 14, 15, 16, 17, 18, 300) for _ in range(9)]
    texts = signs + [" ".join(rng.choices(words, k=3)) for _ in range(300)] + ["the same again"] * 50
    rng.shuffle(texts)
    for first in range(0, len(texts), 25):
        got = [np.frombuffer(x, "<u4").tolist() for x in encode(texts[first : first + 25])]
        assert got == [library.encode(t).ids for t in texts[first : first + 25]]
        assert encode.parts.size <= 2 * 20 + 5 and np.count_nonzero(encode.parts.entry) == encode.parts.size
