"""Words of a text and 64-bit hashes of word runs, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

MASK = (1 << 64) - 1
#: Odd multipliers of two independent run hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """word -> 64-bit hash; remembers up to `limit` words and then starts anew."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs without the characters 0x20 and 0x09-0x0D; null has none. lower: only A-Z."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(values: np.ndarray, m: int, base: int = BASES[0]) -> np.ndarray:
    """Polynomial hash of each run of m values, built from runs of doubling length."""
    if len(values) < m:
        return np.empty(0, np.uint64)
    part, size, power = values, 1, base
    out, have = None, 0
    while True:
        if m & size:
            if out is None:
                out = part
            else:
                n = len(values) - have - size + 1
                out = out[:n] * np.uint64(power) + part[have : have + n]
            have += size
        if have == m:
            return mix(out)
        part = part[:-size] * np.uint64(power) + part[size:]
        size, power = 2 * size, power * power & MASK


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def column(batch, name: str) -> list:
    return batch.column(name).to_pylist()


def planes(values: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then their next ones, and so on: high bytes that are mostly equal compress to little."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
