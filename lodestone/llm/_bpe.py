"""Exact byte-pair encoding in bulk, with the ids that a vocabulary file's own tokenizer gives."""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces kept by a worker; a fixed bound on its memory.
KEEP = 400_000
#: How byte-level vocabularies split a text before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with a longer run of white space than this go to the file's own tokenizer, as the pattern goes back over a run.
LONG_RUN = 2000
_RUN = re.compile(r"\s{%d}" % LONG_RUN)
_loaded: dict[int, object] = {}


def tokenizer(json: str):
    """The tokenizer of a vocabulary file's content, without truncation or padding, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(json)
    found.no_truncation()
    found.no_padding()
    return found


class _Coder:
    """Keeps the ids (little-endian unsigned 32-bit) of pieces."""

    def __init__(self, json: str):
        self.model = tokenizer(json)
        self.ids: dict[str, bytes] = {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def own(self, texts: list[str]) -> list[bytes]:
        """The ids that the file's own tokenizer gives, in batches."""
        return [x for i in range(0, len(texts), 5000) for x in self._whole(texts[i : i + 5000])]

    def _learn(self, missing: set[str]) -> None:
        if len(self.ids) + len(missing) > KEEP:
            self.ids = {"": self.ids[""]}
        for i in range(0, len(todo := list(missing)), 5000):
            self.ids.update(zip(todo[i : i + 5000], self._whole(todo[i : i + 5000]), strict=True))


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteCoder(_Coder):
    """Byte-level vocabularies whose ids are the ranks of their merges, by a rank encoder over the same vocabulary.

    Texts that may hold a special token's text, or a very long run of white space, go to the vocabulary's own tokenizer.
    """

    def __init__(self, json: str):
        super().__init__(json)
        import tiktoken

        special = {str(t.content) for t in self.model.get_added_tokens_decoder().values()}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in self.model.get_vocab().items() if t not in special}
        self.marks = tuple(sorted({t[:2] for t in special}))
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if any(m in t for m in self.marks) or (len(t) > LONG_RUN and _RUN.search(t)):
                out += self._whole([t])
            else:
                out.append(np.array(self.fast.encode_ordinary(t), "<u4").tobytes())
        return out


class WordCoder(_Coder):
    """Vocabularies of lower-cased words that drop white space and never merge across it.

    What lies between spaces and line ends is encoded by itself, once while it is kept. A piece of letters, with or
    without a full stop or the like after it, is a word and that mark; words are kept by themselves, so their capitals
    and marks cost nothing more. Other pieces go to the vocabulary's own tokenizer.
    """

    def __init__(self, json: str):
        super().__init__(json)
        self.tokens = {i: t for t, i in self.model.get_vocab().items()}
        self.words: dict[str, bytes] = {}
        self.merge = self.model.model.tokenize
        self.char = {b: c for c, b in _byte_of().items()}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= KEEP:
                self.words.clear()
            as_bytes = word if word.isascii() else "".join(map(self.char.__getitem__, word.encode()))
            found = self.words[word] = b"".join([t.id.to_bytes(4, "little") for t in self.merge(as_bytes)])
        return found

    def _learn(self, missing: set[str]) -> None:
        if len(self.ids) + len(missing) > KEEP:
            self.ids = {"": b""}
        other = []
        for piece in missing:
            # below U+0180 each letter has one lower-case form and one composed form
            if piece.isascii() or max(piece) < "\u0180":
                word, mark = (piece, "") if piece.isalpha() else (piece[:-1], piece[-1:])
                low = word.lower()
                if word.isalpha() and low.isalpha() and (not mark or mark in ".,;:!?"):
                    self.ids[piece] = self._word(low) + (self._word(mark) if mark else b"")
                    continue
            other.append(piece)
        for i in range(0, len(other), 5000):
            self.ids.update(zip(other[i : i + 5000], self._whole(other[i : i + 5000]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*pieces)
        missing = words.difference(self.ids)
        if len(self.ids) + len(missing) > KEEP:
            # the table begins anew; all that this batch needs must be in it
            missing = words
        self._learn(missing)
        get = self.ids.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        """As decode(ids, skip_special_tokens=False) of a vocabulary without a decoder: tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(kind: type[_Coder], json: str) -> _Coder:
    """One coder for each vocabulary in a worker, which outlives the task."""
    key = hash((kind.__name__, json))
    if key not in _loaded:
        _loaded[key] = kind(json)
    return _loaded[key]


def read(path: str) -> str:
    """A vocabulary file's content, to be broadcast: its size is fixed."""
    with open(path, encoding="utf-8") as f:
        return f.read()
