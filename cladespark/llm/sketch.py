"""Shingle sets and their fast similarity sketches, as numpy arrays.

The sketch has SIZE coordinates. In round i of the first SIZE every element falls into the bin that a hash of the
round names, in round SIZE + b into bin b; a bin keeps the least value of its earliest round. The second half of
the rounds makes sure that every bin is filled, whatever the size of the set, and a few rounds are usually enough.
Two sets agree in a coordinate with a probability equal to their Jaccard similarity, and the share of agreeing
coordinates is as concentrated around it as with independent coordinates.
"""

from __future__ import annotations

import numpy as np

from cladespark.llm.common import Remembered, word_hash_bytes

BANDS, ROWS = 24, 6
SIZE = BANDS * ROWS
WIDTH = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mixed(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = mixed(np.arange(7001, 7001 + max(ROWS, WIDTH), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Shingler:
    """text -> the distinct hashes of its shingles, sorted: WIDTH words each, or all words where there are fewer."""

    def __init__(self):
        self.words = Remembered(word_hash_bytes, 150_000)

    def __call__(self, text: str | None) -> np.ndarray:
        # lower() and split() of bytes know A-Z and the ASCII white space only
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(WIDTH, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = mixed(out * FACTORS[k] + h[k : len(h) - width + 1 + k])
        return np.unique(out)


def sketch(elements: np.ndarray) -> np.ndarray:
    """elements: at least one distinct 64-bit number."""
    bins = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * SIZE):
        h = mixed(elements ^ SEEDS[i])
        value = np.uint64(i << 54) | (h >> np.uint64(10))
        if i < SIZE:
            np.minimum.at(bins, (h % np.uint64(SIZE)).astype(np.int64), value)
        else:
            bins[i - SIZE] = min(bins[i - SIZE], value.min())
        if bins.max() >> np.uint64(54) <= i:
            break  # every bin has a value of some round; later rounds cannot be less
    return bins


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows for links from this similarity: the longest bands that miss a pair there with a probability of 2e-5 at most."""
    fits = [(SIZE // r, r) for r in range(1, ROWS + 1) if (1 - (percent / 100) ** r) ** (SIZE // r) <= 2e-5]
    return fits[-1] if fits else (SIZE, 1)


def band_keys(bins: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; equal keys: the sketches agree in all of the band's coordinates."""
    keys = mixed((bins[: bands * rows].reshape(bands, rows) * FACTORS[:rows]).sum(axis=1, dtype=np.uint64))
    return mixed(keys + SEEDS[:bands]).view(np.int64)
