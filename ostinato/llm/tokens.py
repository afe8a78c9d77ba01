"""Token ids of whole texts, with the tokenizer's work on repeated words done once."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain
from unicodedata import category

import numpy as np
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

#: A space without white space beside it (more signs count as white space here than in any tokenizer).
ALONE = re.compile("(?<![\\s\u180e]) (?![\\s\u180e])")
#: What ``str.split`` takes for white space and a tokenizer may not, or the other way round.
DOUBTFUL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PLAIN_BLANKS = re.compile("[ \\t\\n\\r\\f\\v]+")

LATIN = [chr(c) for c in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xC0, 0x100))]
LETTERS = "".join(c for c in LATIN if category(c)[0] == "L")
#: Texts of these characters only, which lower-case one by one and are composed already ...
PLAIN = re.compile(f"[{re.escape(''.join(LATIN))}]*")
#: ... are split like this by the byte-level pattern, and (in lower case) by the one that drops white space.
#: (letters stand first, as most parts are words; no other alternative can begin where they do)
BYTE_PART = re.compile(f" ?[{LETTERS}]++|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
WORD_PART = re.compile(f"[{LETTERS}]++|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\s{LETTERS}0-9]+")

#: The same by arrays, for codes of characters: a zero between texts, white space, letters, digits, other signs.
WHITE, LETTER, DIGIT, OTHER = 1, 2, 3, 4
GROUPS = bytes([0, *(WHITE if c.isspace() else LETTER if c in LETTERS else DIGIT if c in "0123456789" else OTHER for c in map(chr, range(1, 256)))])
SHORT = np.isin(np.arange(256), [ord(c) for c in "stmd"])
#: Characters in a key (the first ones of a part, zeros after its end), what of them belongs to a part of each length,
#: odd numbers that spread the keys, and how many parts are looked up at once.
KEY = 16
FIRST = np.where(np.arange(KEY) < np.arange(KEY + 1)[:, None], 0xFF, 0).astype(np.uint8).view("<u8")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
BLOCK = 1 << 16


def _cut(tokenizer: Tokenizer) -> str:
    """How a text may be cut without changing its ids: ``before`` single spaces, where a byte-level
    pattern starts a part anyway; ``at`` white space that the tokenizer drops; or ``never``."""
    state = json.loads(tokenizer.to_str())
    first = state["pre_tokenizer"] or {}
    if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in state["added_tokens"]):
        return "never"
    if first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not state["normalizer"]:
        return "before"
    steps = first.get("pretokenizers") or [{}]
    words = steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    composes = {"NFC", "Replace", "Lowercase"}.issuperset(n["type"] for n in (state["normalizer"] or {}).get("normalizers", []))
    # the pattern takes letters, single numbers and runs of other signs, never white space
    if words and composes and "\\s" in steps[0]["pattern"].get("Regex", "") and not any(s.get("use_regex") for s in steps[1:]):
        return "at"
    return "never"


def _byte_signs(tokenizer: Tokenizer) -> dict[int, str] | None:
    """What the model is given for each plain character, if the tokenizer only spells the bytes of
    a part that its pattern has found; None if it does more."""
    state = json.loads(tokenizer.to_str())
    first = state["pre_tokenizer"] or {}
    last = first.get("pretokenizers", [first])[1:] or [first]
    spells = [(x.get("type"), x.get("add_prefix_space")) for x in last] == [("ByteLevel", False)]
    if not spells or not isinstance(tokenizer.model, BPE) or state["truncation"] or state["padding"]:
        return None
    spell = ByteLevel(add_prefix_space=False, use_regex=False)
    return {ord(c): spell.pre_tokenize_str(c)[0][0] for c in LATIN}


class _Parts:
    """Ids of the parts of plain texts, in arrays: an open-addressed table whose keys are the
    characters themselves (longer parts: a number in their place), so equal keys are equal parts.

    ``spaced``: a part takes the space before it, and white space is kept; else it is dropped.
    A part that is not there is encoded by the model. Of more than ``limit`` parts, the half used
    last stays."""

    def __init__(self, model: BPE, signs: dict[int, str], code: str, spaced: bool, limit: int):
        self.tokenize, self.signs, self.kind, self.spaced, self.limit = model.tokenize, signs, np.dtype(code), spaced, limit
        self.bits = (2 * (limit + BLOCK)).bit_length()  # never more than half full
        self.clock = self.serial = 0
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, "<u8"), np.zeros(1 << self.bits, "<u8")
        self.entry = np.zeros(1 << self.bits, np.int32)  # 0: free
        self.first, self.count, self.used = (np.zeros(self.limit + BLOCK + 1, t) for t in (np.int64, np.int32, np.int32))
        self.pool, self.ids, self.size = np.empty(1 << 16, self.kind), 0, 0
        self.long: dict[str, int] = {}
        self.long_size = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        joined = "\0".join(["", *texts, ""])
        if not self.spaced:
            joined = joined.lower()
        data = joined.encode("latin-1") + bytes(KEY)
        raw = np.frombuffer(data, np.uint8)
        start, end = self._bounds(raw, np.frombuffer(data.translate(GROUPS), np.uint8))
        blocks = [self._block(joined, raw, start[k : k + BLOCK], end[k : k + BLOCK]) for k in range(0, len(start), BLOCK)]
        if not blocks:
            return [b""] * len(texts)
        ids, counts = map(np.concatenate, zip(*blocks))
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        cuts = (ends[np.searchsorted(start, np.flatnonzero(raw[:-KEY] == 0))] * self.kind.itemsize).tolist()
        data = ids.tobytes()
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]

    def _bounds(self, raw: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of texts between zeros begin and end, as the patterns above have it."""
        begin = np.ones(len(raw), bool)
        np.not_equal(group[1:], group[:-1], out=begin[1:])
        begin |= raw == 0
        mark = np.flatnonzero(raw == ord("'"))
        mark = mark[begin[mark] & ((raw[mark - 1] != ord(" ")) | (not self.spaced))]
        if self.spaced:  # the last sign of white space stands alone, or with what follows if it is a space
            solid = np.flatnonzero(begin[1:] & (group[1:] > WHITE) & (group[:-1] == WHITE)) + 1
            begin[solid - 1] = True
            begin[solid[raw[solid - 1] == ord(" ")]] = False
        else:
            begin |= group == DIGIT
        after, later = raw[mark + 1], raw[mark + 2]  # zeros follow the last text
        two = ((after == ord("r")) | (after == ord("v"))) & (later == ord("e")) | (after == ord("l")) & (later == ord("l"))
        for taken, size in ((SHORT[after], 2), (two, 3)):
            begin[mark[taken] + 1] = False
            begin[mark[taken] + size] = True
        start = np.flatnonzero(begin[: len(raw) - KEY + 1])
        start, end = start[:-1], start[1:]
        kept = group[start] >= (WHITE if self.spaced else WHITE + 1)
        return start[kept], end[kept]

    def _block(self, joined: str, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after the other, and how many each has."""
        if self.size > self.limit or self.ids > 16 * self.limit or self.long_size > 16 * self.limit:
            self._forget()
        length = end - start
        keys = np.ndarray(len(raw) - KEY + 1, f"V{KEY}", raw, strides=(1,))[start].view("<u8").reshape(-1, 2)
        keys &= FIRST.take(np.minimum(length, KEY), axis=0)
        for k in np.flatnonzero(length > KEY).tolist():
            part = joined[start[k] : end[k]]
            if part not in self.long:
                self.serial += 1
                self.long[part] = self.serial
                self.long_size += len(part)
            keys[k] = self.long[part] << 8, 0  # no part begins with a zero
        entries = self._find(keys)
        missing = np.flatnonzero(entries == 0)
        if len(missing):
            new: dict[str, int] = {}
            for k, i, j in zip(missing.tolist(), start[missing].tolist(), end[missing].tolist()):
                new.setdefault(joined[i:j], k)
            found = [[t.id for t in self.tokenize(part.translate(self.signs))] for part in new]
            self._add(keys[list(new.values())], np.fromiter(chain.from_iterable(found), self.kind), np.fromiter(map(len, found), np.int32))
            entries[missing] = self._find(keys[missing])
        self.clock += 1
        self.used[entries] = self.clock
        return self._ids(entries)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * MIX[0]
        mixed ^= mixed >> np.uint64(32)
        mixed += keys[:, 1] * MIX[1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[2]
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, 0 if it has none."""
        low, high = keys.T
        slot = self._home(keys)
        entries = self.entry[slot]
        rest = np.flatnonzero((entries != 0) & ((self.keys[0][slot] != low) | (self.keys[1][slot] != high)))
        while len(rest):
            slot[rest] = at = (slot[rest] + 1) & ((1 << self.bits) - 1)
            entries[rest] = held = self.entry[at]
            rest = rest[(held != 0) & ((self.keys[0][at] != low[rest]) | (self.keys[1][at] != high[rest]))]
        return entries

    def _add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Different keys that are not there yet, and their ids."""
        entries = np.arange(self.size + 1, self.size + 1 + len(keys), dtype=np.int32)
        self.first[entries] = self.ids + np.cumsum(counts, dtype=np.int64) - counts
        self.count[entries], self.used[entries] = counts, self.clock
        if self.ids + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.ids], np.empty(self.ids + 2 * len(ids), self.kind)])
        self.pool[self.ids : self.ids + len(ids)] = ids
        self.ids, self.size = self.ids + len(ids), self.size + len(keys)
        slot, rest = self._home(keys), np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            free = self.entry[at] == 0
            self.entry[at[free]] = entries[rest[free]]  # one of those that meet here stays
            stays = self.entry[at] == entries[rest]
            for column, part in zip(self.keys, keys.T):
                column[at[stays]] = part[rest[stays]]
            rest = rest[~stays]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[entries]
        ends = np.cumsum(counts, dtype=np.int64)
        place = np.repeat(self.first[entries] - ends + counts, counts)
        return self.pool[place + np.arange(len(place))], counts

    def _forget(self) -> None:
        slots = np.flatnonzero(self.entry)
        entries, keys = self.entry[slots], np.stack([column[slots] for column in self.keys], axis=1)
        used = self.used[entries]
        kept = (used > np.partition(used, len(used) // 2)[len(used) // 2]) & (keys[:, 0] & np.uint64(0xFF) != 0)
        used = used[kept]
        ids, counts = self._ids(entries[kept])
        self._clear()
        self._add(keys[kept], ids, counts)
        self.used[1 : len(used) + 1] = used


class TextIds:
    """Ids of whole texts as the tokenizers library gives them without special tokens.

    Texts of plain characters are split into the parts that the tokenizer keeps apart, other texts
    into chunks between cuts; each is encoded by the library once (a part by its model alone, as
    nothing is left to normalise or to split) and then looked up, parts in arrays. A byte-level
    pattern never has a space inside or at the end of a part, except in a run of white space; so a
    part begins at each space that has no white space beside it. Up to twice ``limit`` parts, and
    as many chunks, are remembered, those used last."""

    def __init__(self, path: str, code: str = "I", limit: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.code, self.limit = Tokenizer.from_file(path), code, limit
        self.cut = _cut(self.tokenizer)
        self.added = [t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        signs = None if self.cut == "never" else _byte_signs(self.tokenizer)
        self.parts = None if signs is None else _Parts(self.tokenizer.model, signs, code, self.cut == "before", 2 * limit)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(a in text.lower() for a in self.added)

    def _split_plain(self, text: str) -> list[str]:
        return WORD_PART.findall(text.lower()) if self.cut == "at" else BYTE_PART.findall(text)

    def _split(self, text: str) -> list[str]:
        if self.cut == "at":
            return PLAIN_BLANKS.split(text) if DOUBTFUL.search(text) else text.split()
        first, *rest = ALONE.split(text)
        return [first, *[f" {c}" for c in rest]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text one after the other, as unsigned numbers of the array type ``code``."""
        if self.cut == "never":
            return self._encode(texts)
        out: list[bytes] = [b""] * len(texts)
        plain, rest, split = [], [], []
        for at, text in enumerate(texts):
            if not self._plain(text):
                rest.append(at)
                split.append(self._split(text))
            elif self.parts is None:
                rest.append(at)
                split.append(self._split_plain(text))
            else:
                plain.append(at)
        for at, ids in zip(rest, self._of_chunks(split), strict=True):
            out[at] = ids
        if plain:
            for at, ids in zip(plain, self.parts([texts[at] for at in plain]), strict=True):
                out[at] = ids
        return out

    def _of_chunks(self, split: list[list[str]]) -> list[bytes]:
        if len(self.known) > self.limit:  # what has not been used since the last time goes
            self.known, self.older = {}, self.known
        found = [list(map(self.known.get, chunks)) for chunks in split]
        missing = {c for chunks, ids in zip(split, found, strict=True) if None in ids for c, x in zip(chunks, ids, strict=True) if x is None}
        kept = {c: self.older[c] for c in missing if c in self.older}
        new = list(missing - kept.keys())
        self.known |= kept
        self.known.update(zip(new, self._encode(new), strict=True))
        return [
            b"".join(ids if None not in ids else map(self.known.__getitem__, chunks)) for chunks, ids in zip(split, found, strict=True)
        ]


@lru_cache(maxsize=4)
def text_ids(path: str, code: str = "I") -> TextIds:
    """One encoder for all tasks of a worker, so that they share what it has learned."""
    return TextIds(path, code)
