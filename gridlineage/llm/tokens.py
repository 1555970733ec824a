"""Exact, cached encoding with a public BPE vocabulary.

The vocabulary's pre-tokenizer never matches across white space, so a text's ids are
the ids of its white-space separated words in a row.  Words repeat, texts don't: a
bounded two-generation cache keeps each recent word's ids as packed bytes, and only
words that are in neither generation reach the tokenizers library.
"""

from __future__ import annotations

import os
import unicodedata
from array import array as pack

import numpy as np

END_ID = 2
VOCABULARY = "word_bpe_49k.json"


def default_vocabulary() -> str:
    """Path of the public vocabulary file, as installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return dict(zip(kept, kept)) | {b: 256 + k for k, b in enumerate(rest)}


class _Words(dict):
    """Word (bytes, lower case) -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encoder: WordEncoder, old: dict):
        super().__init__()
        self.encoder, self.old = encoder, old

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encoder.encode_word(word.decode())
        self[word] = ids
        return ids


class WordEncoder:
    """Encodes whole texts; equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    ``cache_words`` bounds each of the two generations of the word cache, and with it the memory.
    """

    def __init__(self, vocabulary: str | None = None, cache_words: int = 220_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary or default_vocabulary())
        self.model = self.tokenizer.model
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # The pre-tokenizer's published pattern, a fixed value of the vocabulary.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.alphabet = _byte_alphabet()
        self.cache_words = cache_words
        self.words = _Words(self, {})
        self.parts: dict[str, bytes] = {}

    def encode_word(self, word: str) -> bytes:
        if word.isalpha():
            return self._ids(word)
        head = word.rstrip(",.;:!?")  # a tail of symbols is one piece of its own
        if head.isalpha():
            return self.words[head.encode()] + self._part(word[len(head) :])
        return b"".join([self._part(p) for p in self.pieces(word)])

    def _part(self, part: str) -> bytes:
        """Ids of a piece; those of letters are kept as words are, the few others in a cache of their own."""
        if part.isalpha():
            return self.words[part.encode()]
        ids = self.parts.get(part)
        if ids is None:
            ids = self._ids(part)
            if len(self.parts) >= self.cache_words // 10:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def _ids(self, part: str) -> bytes:
        spelled = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.alphabet)
        return pack("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: empty) as little-endian unsigned 32-bit bytes, without an end id."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        ids = b"".join(map(self.words.__getitem__, text.lower().encode().split()))
        if len(self.words) > self.cache_words:
            self.words.old = {}
            self.words = _Words(self, dict(self.words))
        return ids


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(vocabulary: str | None = None) -> WordEncoder:
    """One encoder a worker process, so that its cache serves all its tasks."""
    key = vocabulary or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(vocabulary)
    return _ENCODERS[key]
