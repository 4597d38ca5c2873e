"""Token identifiers of whole texts, by a cache of words.

The vocabulary drops white space before it splits a text, so no token crosses
white space: a text's identifiers are those of its words in order.  In texts of
Latin-1 characters words are cut further, and lower case, as the vocabulary has
them, so that fewer are distinct.  A worker remembers words that the library
has tokenised.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

from .runtime import CACHES

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words of a generation: a worker remembers those of the present and the one before.
CACHE_WORDS = 160_000
#: str.split() treats these as white space, the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: The pieces that the vocabulary cuts lower case texts of Latin-1 characters into.
_PIECES = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+").findall
_CACHES: dict[str, "Words"] = {}
CACHES["tokens"] = _CACHES.clear


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_names() -> list[str]:
    """The character by which byte-level vocabularies show each byte: itself if it is
    printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Words(dict):
    """Word -> identifiers, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.shown = _byte_names()
        self.before: dict[str, bytes] = {}

    def exact(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        if (ids := self.before.get(word)) is not None:
            self[word] = ids
            return ids
        if word.isalpha() and word.islower() and (word.isascii() or word == word.lower() and unicodedata.is_normalized("NFC", word)):
            # letters alone are one piece for the model, which sees names of their bytes
            shown = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        # letters and a final mark are split apart in any case; ASCII case is dropped
        elif word[-1] in ".,!?;:" and len(word) > 1 and word[:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif word.isascii() and word.isalpha():
            ids = self[word.lower()]
        else:
            ids = self.exact(word)
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self.exact(text)
        if "<|" not in text and _is_latin(text):
            return b"".join(map(self.__getitem__, _PIECES(text.lower())))
        return b"".join(map(self.__getitem__, text.split()))


def _is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1: composed, with lower case of one letter each."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def words_of(path: str) -> Words:
    if path not in _CACHES:
        _CACHES[path] = Words(path)
    return _CACHES[path]
