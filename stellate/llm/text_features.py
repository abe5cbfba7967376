"""Hashed word and character n-gram features of whole texts, computed in NumPy over Arrow batches."""

from __future__ import annotations

import numpy as np

from .common import U64, mix, span_hashes, window_hashes, word_spans


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Feature families of a block of texts: (text number, bucket, share of the text's family).

    Families: words, pairs of words, and character trigrams (bytes of UTF-8), each in 2**bits buckets of
    its own.  A text's shares in a family add up to 1, or to 0 if it has no such n-gram.  ASCII case is
    kept: capital text is one of the things to tell.
    """
    n = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    pairs, pair_owner, _ = window_hashes(words, owner, 2)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        grams = mix((wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)).astype(U64))
        gram_owner = np.repeat(np.arange(n), np.diff(offsets))[: len(grams)]
        inside = np.arange(len(grams)) + 3 <= offsets[gram_owner + 1]
        grams, gram_owner = grams[inside], gram_owner[inside]
    else:
        grams, gram_owner = np.zeros(0, U64), np.zeros(0, np.int64)
    out = []
    for family, (h, o) in enumerate(((words, owner), (pairs, pair_owner), (grams, gram_owner))):
        bucket = (mix(h ^ U64(family + 1)) >> U64(64 - bits)).astype(np.int64)
        count = np.bincount(o, minlength=n)
        out.append((o, bucket + (family << bits), 1.0 / np.maximum(count, 1)[o]))
    return out


def linear_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Sum of weight times share over all features of each text."""
    score = np.zeros(len(offsets) - 1)
    for owner, bucket, share in hashed_ngrams(data, offsets, bits):
        score += np.bincount(owner, weights=weights[bucket] * share, minlength=len(score))
    return score


def sparse_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets (ascending) and their shares of each text, for fitting."""
    n, width = len(offsets) - 1, 3 << bits
    found = hashed_ngrams(data, offsets, bits)
    owner, bucket, share = (np.concatenate([f[k] for f in found]) for k in range(3))
    key, index = np.unique(owner * width + bucket, return_inverse=True)
    total = np.bincount(index, weights=share, minlength=len(key))
    cuts = np.searchsorted(key, np.arange(n + 1) * width)
    return [((key[a:b] % width).astype(np.int32), total[a:b].astype(np.float32)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
