"""Words of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def pieces(data: bytes, size: int = 1 << 20):
    """``data`` in pieces of about ``size`` bytes, cut at ASCII white space only."""
    at = 0
    while len(data) - at > size:
        m = _SPACE.search(data, at + size)
        if m is None:
            break
        yield data[at:m.start()]
        at = m.start()
    yield data[at:]


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """One hash per word ``[^\\x20\\x09-\\x0D]+``; ``lower`` lower-cases A-Z only."""
    data = text.encode("utf-8", "surrogatepass")
    parts = []
    for p in pieces(data):
        words = (p.lower() if lower else p).split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def batch_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, one after the other, and each text's number of words."""
    parts = [word_hashes(t, lower) for t in texts]
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.array([len(p) for p in parts], dtype=np.int64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _U(0x9E3779B97F4A7C15)
    h += b
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h


def windows(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """One hash per run of ``size`` consecutive words (none if there are fewer): runs of
    a power of two by doubling, the rest from two runs that overlap."""
    if len(words) < size:
        return np.zeros(0, _U)
    h, have = words, 1
    while have * 2 <= size:
        h, have = _joined(h[:-have], h[have:]), have * 2
    if have < size:
        h = _joined(h[:len(words) - size + 1], h[size - have:])
    return mix(h, seed + 1000 * size)
