"""Vectorised word kernels over blocks of UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is the pattern [^\\x20\\x09-\\x0D]+. Words, lines and
n-grams are compared by 64-bit hashes: a polynomial over per-byte random values, taken from prefix sums over SPAN bytes
at a time. A block takes about 30 bytes of memory for each byte of text (rules) or 15 (words alone), so a text of 20 MB
takes some 600 MB; a task holds one such text at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes whose prefix sums are held at once.
SPAN = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point of a word.
WORD_CHAR = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
#: Random 32-bit values of bytes, for hashes of short windows.
BYTE32 = (_BYTE >> _U(32)).astype(np.uint32)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Block:
    """The words of some documents; doc, start, end and hash are per word."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask marks."""
        at = self.offsets.tolist()
        return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of n words within a document."""
        if len(self.doc) < n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        last = len(self.doc) - n + 1
        value = np.zeros(last, _U)
        for k in range(n):
            value = mix(value * _U(_BASE) + self.hash[k : k + last] + _U(k + 1))
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        return at, value[at]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Hash of the bytes from start to end, for many spans in ascending order."""
    out = np.zeros(len(start), _U)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + span, side="right")))
        b = int(end[j - 1])
        if b - a > span:
            # one long span, in pieces: the value of each is shifted by what stands before it
            value = 0
            for c in range(a, b, span):
                part = _BYTE[data[c : min(b, c + span)]]
                value += int(np.sum(part * _tables(len(part))[0][: len(part)], dtype=_U)) * pow(_BASE, c - a, 1 << 64)
            out[i] = mix(np.array([(value + b - a) & ((1 << 64) - 1)], _U))[0]
        else:
            power, inverse = _tables(b - a + 1)
            prefix = np.zeros(b - a + 1, _U)
            np.cumsum(_BYTE[data[a:b]] * power[: b - a], dtype=_U, out=prefix[1:])
            first, last = start[i:j] - a, end[i:j] - a
            out[i:j] = mix((prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(_U))
        i = j
    return out


def parse(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Block:
    """Find and hash the words of documents laid end to end."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    del inside, before, after, edge
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Block(data, offsets, doc, start, end, span_hashes(data, start, end))


def by_doc(block: Block, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal values within one document."""
    return mix(value ^ mix(doc.astype(_U) + _U(1)))


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the items whose key is found twice or more, and of those that aren't the first of their key."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, later


def rule_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    docs = block.n_docs
    out = {
        "n_words": np.bincount(block.doc, minlength=docs),
        "word_chars": block.per_doc(WORD_CHAR[block.data]),
        "n_symbols": block.per_doc(SYMBOL[block.data]),
    }
    newline = np.flatnonzero(block.data == 10)
    start = np.sort(np.concatenate((block.offsets[:-1], newline + 1)))
    end = np.sort(np.concatenate((block.offsets[1:], newline)))
    has_word = np.searchsorted(block.start, end) > np.searchsorted(block.start, start)
    start, end = start[has_word], end[has_word]
    doc = np.searchsorted(block.offsets, start, side="right") - 1
    later = repeats(by_doc(block, doc, span_hashes(block.data, start, end)))[1]
    out["n_dup_lines"] = np.bincount(doc[later], minlength=docs)
    at, value = block.grams(3)
    at = at[repeats(by_doc(block, block.doc[at], value))[0]]
    covered = np.zeros(len(block.doc) + 3, bool)
    for k in range(3):
        covered[at + k] = True
    out["n_repeat_words"] = np.bincount(block.doc[covered[: len(block.doc)]], minlength=docs)
    return {k: v.astype(np.int64) for k, v in out.items()}
