"""Word shingles as 64-bit numbers, inside Python workers."""

from __future__ import annotations

import hashlib
import re

import numpy as np

SHINGLE_WORDS = 5
#: Words whose numbers a worker keeps before it starts anew.
CACHE_WORDS = 400_000

_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Words in bytes with their numbers, made when first asked for."""

    def __missing__(self, w: bytes) -> int:
        self[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return self[w]


_numbers = _Numbers()


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


#: Characters whose words are told at once; a longer word is taken whole all the same.
BLOCK = 1 << 15
#: Odd, so that it has an inverse; its powers weigh a word's characters by their place.
_PLACE = 0xD1342543DE82EF95


class Characters:
    """A number for each character of a word, 0 for all others; powers of ``_PLACE`` and of its inverse.

    With ``marks`` also for those that are neither in words nor white space, each of which stands for itself.
    """

    def __init__(self, marks: bool = False):
        codes = np.arange(0x110000, dtype=np.uint64)
        self.numbers = _mix(codes * _MULTIPLIER + np.uint64(1)) | np.uint64(1)
        others = np.array([not (c == "_" or c.isalnum()) for c in map(chr, range(0x110000))])
        self.marks = others & ~np.array([c.isspace() for c in map(chr, range(0x110000))]) if marks else None
        self.numbers[others if self.marks is None else others & ~self.marks] = 0
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK)
            self.up, self.down = (
                np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64))) for x in (_PLACE, pow(_PLACE, -1, 1 << 64))
            )
        return self.up[:n], self.down


    def tokens(self, low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, number) of the words, and of the marks, in their order."""
        try:
            codes = np.frombuffer(low.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
        up, down = self.powers(len(codes))
        held = self.numbers.take(codes)
        inside = np.zeros(len(codes) + 2, bool)
        np.not_equal(held, 0, out=inside[1:-1])
        cut = inside[1:] != inside[:-1]
        if self.marks is None:
            edges = np.flatnonzero(cut)
            starts, ends = edges[::2], edges[1::2]
        else:  # a token begins where there is none before, or where one of both is a mark, and ends likewise
            alone = np.zeros(len(codes) + 2, bool)
            alone[1:-1] = self.marks.take(codes)
            cut |= alone[1:] | alone[:-1]
            starts, ends = np.flatnonzero(cut & inside[1:]), np.flatnonzero(cut & inside[:-1])
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(held * up, out=sums[1:])
        return starts, ends, _mix((sums[ends] - sums[starts]) * down[starts])


_characters: list[Characters] = []


def _low_numbers(low: str) -> np.ndarray:
    if not _characters:
        _characters.append(Characters())
    parts, at = [], 0
    while at < len(low):
        end = at + BLOCK
        if end < len(low) and (cut := _WORD.match(low, end - 1)):
            end = cut.end()
        parts.append(_characters[0].tokens(low[at:end])[2])
        at = end
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)


def text_numbers(text: str | None) -> np.ndarray:
    """The numbers of ``words(text)``, made of all characters at once."""
    return _low_numbers((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(seq: list[str] | list[bytes]) -> np.ndarray:
    """Numbers of ``seq``, of words as ``words`` gives them or of any bytes."""
    if seq and isinstance(seq[0], str):
        return _low_numbers(" ".join(seq))
    out = np.empty(len(seq), dtype=np.uint64)
    for at in range(0, len(seq), CACHE_WORDS // 2):
        part = seq[at : at + CACHE_WORDS // 2]
        if len(_numbers) > CACHE_WORDS // 2:
            _numbers.clear()
        out[at : at + len(part)] = np.fromiter(map(_numbers.__getitem__, part), dtype=np.uint64, count=len(part))
    return out


def shingles(seq: list[str] | list[bytes] | np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles, how often each occurs) of words or their numbers. Fewer than ``size`` are one shingle."""
    if not len(seq):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    numbers = seq if isinstance(seq, np.ndarray) else word_numbers(seq)
    size = min(size, len(numbers))
    h = np.zeros(len(numbers) - size + 1, dtype=np.uint64)
    for k in range(size):
        h = (h + numbers[k : k + len(h)]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    h = np.sort(_mix(h))
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[starts], np.diff(np.append(starts, len(h)))


def digest(numbers: np.ndarray) -> bytes:
    """What tells a sequence of word numbers from others."""
    return hashlib.blake2b(numbers.tobytes(), digest_size=16).digest()
