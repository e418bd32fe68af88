"""Whole-text token ids by a public tokenizer, each distinct word encoded once per Python worker.

Both vocabularies cut a text at white space before they merge anything, so the ids of a text are the ids of its
words in order.  A word of Latin letters with closing punctuation goes straight to the library's merge model;
any other word goes through the library as a text, and so does a text with white space other than single
blanks and line breaks when blanks belong to words.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np

from . import textarrays as ta

MEMO_BYTES = 144 << 20  # of remembered words in one Python worker; beyond it the memory starts afresh
_PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[]^_`{|}~'  # the apostrophe starts contractions and is left to the library


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """word -> ids as bytes, filled on demand."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        self[word] = ids
        self.held += 200 + len(word) + len(ids)
        return ids


class WordEncoder:
    """``ids(texts)`` gives little-endian unsigned 32-bit ids as bytes, one value per text.

    ``blank_in_word``: a blank is part of the word after it (byte-level vocabularies); otherwise white space is
    dropped and letters are lower-cased.
    """

    def __init__(self, path: str, blank_in_word: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.merge = self.library.model.tokenize
        self.letters = _byte_letters()
        self.blank_in_word = blank_in_word
        self.newline = self._whole("\n")
        self._fresh()

    def _fresh(self) -> None:
        self.ends = _Memo(self._whole)
        self.first = _Memo(lambda w: self._word("", w))
        self.later = _Memo(lambda w: self._word(" ", w))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, lead: str, word: str) -> bytes:
        stem = word.rstrip(_PUNCTUATION)
        if not stem.isalpha() or len(stem) > 200:
            return self._whole(lead + word)
        text = stem if self.blank_in_word else stem.lower()
        if not stem.isascii():
            if max(stem) >= "ɐ" or "İ" in stem:
                return self._whole(lead + word)
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [p.id for p in self.merge("Ġ" + text if lead else text)]).tobytes()
        return ids + self.ends[word[len(stem):]] if len(stem) < len(word) else ids

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if self.first.held + self.later.held > MEMO_BYTES:
            self._fresh()
        one = self._with_blanks if self.blank_in_word else self._without_blanks
        return [one(t) if t else b"" for t in texts]

    def _without_blanks(self, text: str) -> bytes:
        return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))

    def _with_blanks(self, text: str) -> bytes:
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            if "" in words or not line.isprintable():
                return self._whole(text)
            out.append(self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:])))
        return self.newline.join(out)


def encoder(path: str, blank_in_word: bool) -> WordEncoder:
    """The worker's encoder for a vocabulary file; it lives until another operator's task starts in the worker."""
    cache = ta.worker_cache("tokens")
    key = (path, blank_in_word)
    if key not in cache:
        cache[key] = WordEncoder(path, blank_in_word)
    return cache[key]
