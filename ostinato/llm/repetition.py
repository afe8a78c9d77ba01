"""Quality rules from repeated substrings, found in suffix arrays over words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_steps, with_columns

WINDOW = 8
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _classes(ranks: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order positions ``at`` by two keys; their new ranks (first place in the order of all) and
    which of them still share a rank. ``first`` is a rank, so classes keep their places."""
    order = np.lexsort([second, first])
    at, first, second = at[order], first[order], second[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    begins = np.flatnonzero(fresh)
    own = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])  # first places of the old classes
    base = np.repeat(own, np.diff(np.r_[own, len(at)]))
    begin = np.repeat(begins, np.diff(np.r_[begins, len(at)]))
    ranks[at] = first + begin - base
    size = np.repeat(np.diff(np.r_[begins, len(at)]), np.diff(np.r_[begins, len(at)]))
    return at, size > 1


class SuffixArrays:
    """Suffix arrays of several texts at once, by prefix doubling of what is still equal.

    ``symbols`` are the texts' words as numbers, ``text`` the number of the text of each word.
    ``levels[k]`` ranks the first 2**k words of every suffix; suffixes of two texts never agree.
    """

    def __init__(self, symbols: np.ndarray, text: np.ndarray):
        n = len(symbols)
        self.end = np.searchsorted(text, text, "right")  # where the text of each word ends
        ranks = np.zeros(n, np.int64)
        at, shared = _classes(ranks, np.arange(n), np.zeros(n, np.int64), text * (symbols.max(initial=0) + 1) + symbols)
        self.levels, at, step = [ranks.copy()], at[shared], 1
        while len(at):
            later = at + step
            inside = later < self.end[at]
            following = np.where(inside, ranks[np.minimum(later, n - 1)], -1)
            at, shared = _classes(ranks, at, ranks[at], following)
            at = at[shared]
            self.levels.append(ranks.copy())
            step *= 2
        self.order = np.argsort(ranks)

    def equal_windows(self, width: int) -> np.ndarray:
        """First words of windows of ``width`` (a power of two) words that occur again in their text."""
        level = width.bit_length() - 1
        if level >= len(self.levels):
            return np.zeros(0, np.int64)
        fits = np.flatnonzero(np.arange(len(self.end)) + width <= self.end)
        seen = np.bincount(self.levels[level], minlength=len(self.end))
        return fits[seen[self.levels[level][fits]] > 1]

    def longest(self, least: int) -> np.ndarray:
        """For each suffix, the words it shares with any other suffix of its text (0 below ``least``):
        the longer of the common prefixes with its two neighbours in the order."""
        n, level = len(self.end), min(least.bit_length() - 1, len(self.levels) - 1)
        result = np.zeros(n, np.int64)
        a, b = self.order[:-1], self.order[1:]
        near = self.levels[level][a] == self.levels[level][b]
        a, b = a[near], b[near]
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = a + common, b + common
            fits = (i < self.end[a]) & (j < self.end[b])
            same = fits & (self.levels[k][np.minimum(i, n - 1)] == self.levels[k][np.minimum(j, n - 1)])
            common += same * 2**k
        common[common < least] = 0
        np.maximum.at(result, a, common)
        np.maximum.at(result, b, common)
        return result


def _covered(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def measure(texts: list[str], least: int = WINDOW) -> dict[str, np.ndarray]:
    """The measures of each text; see ``repetition_rules``."""
    words = [t.encode().split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = list(chain.from_iterable(words))
    n, last = len(flat), len(texts)
    text = np.repeat(np.arange(last), n_words)
    codes = dict(zip(dict.fromkeys(flat), count()))
    suffixes = SuffixArrays(np.fromiter(map(codes.__getitem__, flat), np.int64, n), text)
    points = {w: len(w.decode()) for w in codes}
    size = np.fromiter(map(points.__getitem__, flat), np.int64, n)
    start = suffixes.equal_windows(WINDOW)
    in_window = _covered(n, start, np.full(len(start), WINDOW))
    shared = suffixes.longest(least)
    at = np.flatnonzero(shared)
    in_repeat = _covered(n, at, shared[at])
    before = np.r_[0, np.cumsum(size)]
    longest = np.zeros(last, np.int64)
    np.maximum.at(longest, text[at], before[at + shared[at]] - before[at])
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": np.bincount(text, in_window, last).astype(np.int64),
        "repeat_chars": np.bincount(text, in_repeat * size, last).astype(np.int64),
        "longest_repeat": longest,
    }


def repetition_rules(
    docs: DataFrame,
    max_covered: float = 0.3,
    max_longest: float = 0.2,
    least: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Measures and verdict per row; words are runs of anything but ``[\\x20\\x09-\\x0D]``.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words (words in
    eight-word windows that occur twice or more in the text); base_failed by these. Maximal
    repeated substrings are the intervals of the longest-common-prefix array of at least ``least``
    words: repeat_chars is the size of the union of their spans and longest_repeat the largest, in code
    points of words. A text is kept if it passes the base, its repeats cover at most ``max_covered`` of
    word_chars, and the longest at most ``max_longest``. Null text has no words and fails the base.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in batch_steps(batch, "text"):
                m = measure(texts, least)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                good = (m["repeat_chars"] <= max_covered * m["word_chars"]) & (
                    m["longest_repeat"] <= max_longest * m["word_chars"]
                )
                yield with_columns(rows, ["doc_id"], **m, base_failed=failed, kept=~failed & good)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work,
        f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, repeat_chars bigint, longest_repeat bigint, base_failed boolean, kept boolean",
    )
