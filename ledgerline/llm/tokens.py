"""Token ids of whole texts by a word-level tokenizer file of the ``tokenizers`` library.

A worker remembers the ids of the stretches between white space: those met more than once for long, those met once only
until the next few hundred thousand, so that the many rare ones don't push out the frequent ones. New ones are
cut into words, which go through the library's merges. This holds for lower-casing tokenizers that drop white space and mark word ends, on texts of Latin-1
characters. Other texts, and texts with control strings, go through the library as a whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

KNOWN_ENTRIES = 300_000          # stretches met more than once that a worker remembers
YOUNG_ENTRIES = 200_000          # stretches met once, of late
SIGN_ENTRIES = 10_000            # words without letters that a worker remembers
LONG = 64                        # longer stretches are not remembered
# letters, digits and other numbers of Latin-1 as the tokenizer's own pattern sorts them, after lower-casing
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.control = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model                # the merges alone, for single words
        # a Latin-1 letter's bytes in UTF-8, as letters of the vocabulary
        letters = _byte_letters()
        self._letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self._signs: dict[str, bytes] = {}
        self._known: dict[str, bytes] = {}
        self._young: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, stretch: str) -> bytes:
        """Ids of a lower-case Latin-1 stretch between white space: those of its words."""
        if stretch.isalpha():                        # one word
            return self._merged(stretch)
        signs = self._signs
        return b"".join([self._merged(w) if w[0].isalpha() else signs.get(w) or self._sign(w) for w in _WORD.findall(stretch)])

    def _merged(self, word: str) -> bytes:
        plain = word if word.isascii() and word.isprintable() else word.translate(self._letters)
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def _sign(self, word: str) -> bytes:
        """As ``_merged``, for words that are no letters: few stand beside many words."""
        ids = self._merged(word)
        if len(word) <= LONG and len(self._signs) < SIGN_ENTRIES:
            self._signs[word] = ids
        return ids

    def _is_plain(self, text: str) -> bool:
        """Latin-1 without the separators that only Python takes for white space, and without control strings."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", *self.control))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text without special tokens, as bytes of little-endian 32-bit numbers."""
        parts = [t.lower().split() if self._is_plain(t) else None for t in texts]
        rare = set().union(*filter(None, parts)).difference(self._known)
        again = {w: self._young.pop(w) for w in rare if w in self._young}
        fresh = {w: self._learn(w) for w in rare.difference(again)}
        self._known.update(again)
        self._known.update(fresh)
        of = self._known.__getitem__
        out = [b"".join(map(of, ws)) if ws is not None else self._encode([t])[0].tobytes()
               for t, ws in zip(texts, parts)]
        for w, ids in fresh.items():
            del self._known[w]
            if len(w) <= LONG:
                self._young[w] = ids
        if len(self._young) > YOUNG_ENTRIES:
            self._young = {}
        _forget(self._known, KNOWN_ENTRIES)
        return out


def _forget(memory: dict, entries: int) -> None:
    """Drops the later half of a memory that has grown too large: what came first is mostly what is frequent."""
    if len(memory) > entries:
        for key in list(memory)[entries // 2:]:
            del memory[key]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    return WordTokenizer(path)


def groups_by_size(texts, limit: int = 1_000_000):
    """Runs of texts of about a million characters together (one text at least)."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some
