"""Rolling hashes over the words of whole texts, in numpy."""

from __future__ import annotations

import struct
from hashlib import blake2b

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def lowered(text: str | None) -> bytes:
    """A-Z in lower case, as UTF-8. (Methods of bytes know ASCII only.)"""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def lower_words(text: str | None) -> list[bytes]:
    """A-Z in lower case; runs of anything but ASCII white space, as UTF-8."""
    return lowered(text).split()


class _Known(dict):
    """Words to ids; what is not there is hashed when it is asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = struct.unpack("<Q", blake2b(word, digest_size=8).digest())[0]
        return out


class Words:
    """64-bit ids of words, the same in every process. Keeps those it has seen, up to `most`."""

    def __init__(self, most: int = 250_000) -> None:
        self.most, self.known = most, _Known()

    def ids(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Spelled:
    """64-bit ids of words, the same in every process, made from their bytes for all words of many texts at once: no Python per word, and nothing is kept. Not the ids of `Words`."""

    def ids(self, words: list[bytes]) -> np.ndarray:
        return _spelled(b" ".join(words))[0]

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text's `lower_words`."""
        data = [lowered(t) for t in texts]
        ids, starts = _spelled(b" ".join(data))
        ends = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data])).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _spelled(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The id of each word, and where it starts. Pieces of eight bytes are mixed with their places in the word, and added."""
    data = b" " + data + b" " * 8  # words have edges, and eight bytes can be read anywhere
    blank = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    pieces = (ends - starts + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(first[-1] + pieces[-1]) - np.repeat(first, pieces)
    at = np.repeat(starts, pieces) + 8 * place
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[at] & _FIRST[np.minimum(np.repeat(ends, pieces) - at, 8)]
    mixed = mix(eight * _A + place.astype(np.uint64) * _C)
    return mix(np.add.reduceat(mixed, first) + (ends - starts).astype(np.uint64) * _B), starts - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of `k` ids; of the whole sequence, where it is shorter; none for none."""
    n = len(ids)
    if n == 0:
        return ids
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        h = mix(h * _A + ids[i : n - width + 1 + i])
    return h
