"""Token ids of whole texts, by way of a bounded cache of words."""

from __future__ import annotations

import os
from array import array

from .common import worker_cache

#: Words kept per Python worker; beyond it the cache starts anew. (Keeping what is met again
#: would cost more memory than words: survivors pin the pages that the others have left.)
CACHE_WORDS = 500_000

#: Trailing marks that are split off before a word is looked up (the apostrophe has rules of its own).
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder(dict):
    """Word (bytes without ASCII white space) -> little-endian unsigned 32-bit ids.

    The vocabulary drops white space and neither its normaliser nor its
    pre-tokenizer looks across it, so a text's ids are its words' ids in turn.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: 256 + i for i, b in enumerate(others)}

    @staticmethod
    def of(path: str) -> "WordEncoder":
        """One encoder per worker process: its cache serves all tasks there."""
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]

    def __missing__(self, word: bytes) -> bytes:
        """Learns a word: from its stem and trailing marks, from the model alone, or from the whole tokenizer."""
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem and 97 <= stem[-1] <= 122 and b"<|" not in word:
            found = self[stem] + self[word[len(stem) :]]  # a letter ends a pre-token, so both are encoded apart
        else:
            text = word.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0250" and text == text.lower():
                # lower-case Latin letters are one pre-token that the normaliser leaves as it is
                parts = self.model.tokenize(text if text.isascii() else word.decode("latin-1").translate(self.letters))
                found = array("I", [t.id for t in parts]).tobytes()
            else:
                found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        out, get = [], self.__getitem__
        for i, t in enumerate(texts):
            if i % 64 == 0:
                worker_cache("token ids", self, CACHE_WORDS)
            # lower case of ASCII first: the normaliser lowers anyway, and the cache holds fewer words
            out.append(b"".join(map(get, (t if b"<|" in t else t.lower()).split())))
        return out
