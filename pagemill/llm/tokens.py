"""Encoding of whole texts with a public tokenizer file, a cached word at a time."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

#: Words, and bytes of words and ids, kept before the cache of a Python worker starts anew; they bound memory, never
#: what is encoded.
CACHE_WORDS, CACHE_BYTES = 800_000, 1 << 27
#: Distinct words sent to the tokenizer in one call.
WORDS_A_CALL = 1000
#: Characters of texts that are encoded together.
BATCH_CHARACTERS = 1 << 20

#: A text with other characters than these goes to the tokenizer word by word as it is. Among these, lower-casing needs
#: no context, no normal form changes and white space is ASCII; so words can be lower-cased before they are told apart.
_UNUSUAL = re.compile("[^\\x09-\\x0d\\x20-\\x7e\u00a1-\u012f\u0131-\u024f]")
#: Punctuation after punctuation is one pre-token with it, so it must not be set apart.
_RUN = re.compile(r"[.,](?:(?<=[^\w\s].)(?:\s|$)|(?<=_.))")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Places(dict):
    """Words with their places, given in the order in which they are first asked for."""

    def __missing__(self, word: str | bytes) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place

    def restart(self) -> None:
        self.clear()
        self.new = []


def _longer(values: np.ndarray, n: int) -> np.ndarray:
    """``values`` with room for ``n`` at least."""
    return values if n <= len(values) else np.append(values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype))


class WordEncoder:
    """Ids of whole texts for tokenizers that lower case, drop white space and never merge across it.

    Such a tokenizer encodes a text as the concatenation of its space-separated words, so each distinct word goes to
    the library once and is then looked up. Where it changes nothing, words are lower-cased and full stops and commas
    that end them set apart first, which makes fewer words. The equality with encoding whole texts is tested.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size()
        pieces = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(pieces.values()) + 1, dtype=bool)
        self.ends_word[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True
        self.cache = _Places()
        self.ids, self.starts, self.counts = np.zeros(1024, "<u4"), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._restart()

    def _restart(self) -> None:
        self.cache.restart()
        self.used = self.held = 0

    def _store(self, places: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids = _longer(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        begins = np.append(0, ends[:-1])
        self.starts[places], self.counts[places] = self.used + begins, ends - begins
        self.used += len(ids)

    def _learn(self) -> None:
        """Store the ids of the new words in the cache (bytes as they are, or strings in lower case)."""
        words, first = self.cache.new, len(self.cache) - len(self.cache.new)
        self.starts, self.counts = _longer(self.starts, len(self.cache)), _longer(self.counts, len(self.cache))
        plain, other = [], []
        for k, w in enumerate(words):
            (plain if isinstance(w, str) and w.isalpha() else other).append(k)
        for k in range(0, len(plain), WORDS_A_CALL):  # each is one pre-token, whose last piece ends a word
            part = plain[k : k + WORDS_A_CALL]
            code = self.tokenizer.encode_batch_fast([" ".join([words[j] for j in part])], add_special_tokens=False)[0]
            ids = np.array(code.ids, dtype="<u4")
            self._store(first + np.array(part), ids, np.flatnonzero(self.ends_word[ids]) + 1)
        for k in range(0, len(other), WORDS_A_CALL):
            part = other[k : k + WORDS_A_CALL]
            plainly = [w if isinstance(w, str) else w.decode() for w in (words[j] for j in part)]
            code = self.tokenizer.encode(plainly, is_pretokenized=True, add_special_tokens=False)
            held = np.array(code.word_ids, dtype=np.int64)
            self._store(first + np.array(part), np.array(code.ids, dtype="<u4"), np.searchsorted(held, np.arange(1, len(part) + 1)))
        self.held += sum(map(len, words))
        self.cache.new = []

    def _encode_words(self, lists: list[list]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS or self.held + 4 * self.used > CACHE_BYTES:
            self._restart()
        ends = np.cumsum([0, *map(len, lists)])
        places = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(lists)), np.int64, ends[-1])
        if self.cache.new:
            self._learn()
        n = self.counts[places]
        before = np.append(0, np.cumsum(n))
        at = np.repeat(self.starts[places] - before[:-1], n)
        at += np.arange(before[-1])
        buffer, cuts = self.ids[at].tobytes(), (4 * before[ends]).tolist()
        return [buffer[i:k] for i, k in zip(cuts, cuts[1:])]

    @staticmethod
    def _words(text: str | None) -> list:
        if not text:
            return []
        if _UNUSUAL.search(text):
            return text.encode().split()
        if not _RUN.search(text):
            for mark in ".,":
                text = text.replace(mark + " ", f" {mark} ").replace(mark + "\n", f" {mark}\n")
        return text.lower().split()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            words = self._words(text)
            if len(words) > CACHE_WORDS // 4:  # a very long text, in parts whose words the cache can hold
                yield from self._encode_words(held)
                held, size = [], 0
                step = CACHE_WORDS // 4
                yield b"".join(self._encode_words([words[k : k + step]])[0] for k in range(0, len(words), step))
                continue
            held.append(words)
            size += len(text or "")
            if size >= BATCH_CHARACTERS:
                yield from self._encode_words(held)
                held, size = [], 0
        yield from self._encode_words(held)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
