"""Shingle sets and fast similarity sketches (Dahlgaard, Knudsen and Thorup, 2017) over slices of texts."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import HashCache, ascii_lower_words, distinct, mix

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += mix(values[j : j + n] + _MULT[j % 8]) * _MULT[(j + 3) % 8]
        out = (out << np.uint64(7)) | (out >> np.uint64(57))
    return mix(out)


def word_shingle_sets(texts: list[bytes], k: int, cache: HashCache) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words give their whole sequence, none an empty set."""
    words = [ascii_lower_words(t) for t in texts]
    flat = np.fromiter((h for w in words for h in map(cache.__getitem__, w)), np.uint64, sum(map(len, words)))
    hashes, at, out = rolling(flat, k), 0, []
    for w in words:
        n = len(w)
        if n >= k:
            out.append(distinct(hashes[at : at + n - k + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\x00short ".join(w), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


#: Elements that are hashed at once.
_PART = 1 << 18


def _round(elements: np.ndarray, i: int) -> np.ndarray:
    """32-bit hashes of 32-bit elements for round i (finaliser of MurmurHash3), in place on a copy."""
    h = elements ^ np.uint32((i + 1) * 0x9E3779B9 & 0xFFFFFFFF)
    t = h >> np.uint32(16)
    h ^= t
    h *= np.uint32(0x85EBCA6B)
    np.right_shift(h, np.uint32(13), out=t)
    h ^= t
    h *= np.uint32(0xC2B2AE35)
    np.right_shift(h, np.uint32(16), out=t)
    h ^= t
    return h


def fast_similarity_sketch(elements: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """Of n sets, one row of `bins` values each; two sets agree in a bin with about their Jaccard similarity.

    elements are 32-bit hashes, owner the set of each; repeats change nothing. In round i < bins every element is hashed
    to a bin (the range its hash falls into) with value i + u; in round i >= bins every element goes to bin i - bins. A
    set leaves after a round that has filled its bins, so all get filled in 2 * bins rounds. Earlier rounds have smaller
    values, so a bin's minimum is what its first round put there. bins is at most 128; an empty set stays EMPTY.
    """
    sketch = np.full((n, bins), EMPTY, np.uint64)
    flat = sketch.reshape(-1)
    first = owner * bins
    for i in range(2 * bins):
        if not len(elements):
            break
        for j in range(0, len(elements), _PART):
            part = first[j : j + _PART]
            h = _round(elements[j : j + _PART], i).astype(np.uint64)
            if i < bins:
                spot = ((h * np.uint64(bins)) >> np.uint64(32)).view(np.int64)
                spot += part
            else:
                spot = part + (i - bins)
            h |= np.uint64(i << 32)
            np.minimum.at(flat, spot, h)
        if i < 6 or i % 4 == 3 or i >= bins:  # a set that stays for longer is not changed: its bins are full
            open_ = (sketch == EMPTY).any(axis=1)
            if not open_.all():
                stays = open_[owner]
                owner, first, elements = owner[stays], first[stays], elements[stays]
    return sketch


def sketch_sets(sets: list[np.ndarray], bins: int) -> np.ndarray:
    if not sets:
        return np.full((0, bins), EMPTY, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    return fast_similarity_sketch((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), owner, len(sets), bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band of `rows` bins; the band's number is part of it."""
    n, bins = sketch.shape
    bands = bins // rows
    parts = sketch.reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MULT[0], (n, bands)).copy()
    for j in range(rows):
        key = mix(key * _MULT[1] + parts[:, :, j])
    return key.view(np.int64)
