"""Vectorised hashes of words and word sequences of whole texts.

Words are maximal runs of bytes other than space and 0x09-0x0D.  A word has
two 64-bit hashes.  They are computed for a group of texts at once, eight
bytes of every word at a time, with a mixing step after each; words longer
than ``LONG`` bytes take the halves of their 128-bit XXH3.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_ODD = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The first 0 .. 8 bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of all words of all texts in order (2 x words), and where each text's words begin (one entry more than texts)."""
    joined = b" ".join(t or b"" for t in texts) + b" " * 8
    raw = np.frombuffer(joined, dtype=np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    eight = np.ndarray((len(raw) - 7,), "<u8", joined, strides=(1,))
    h = np.stack([sizes.astype(np.uint64) * _ODD, ~sizes.astype(np.uint64)])
    for k in range(0, LONG, 8):
        more = np.flatnonzero(sizes > k) if k else slice(None)
        if k and not len(more):
            break
        chunk = eight[starts[more] + k] & _FIRST[np.minimum(sizes[more] - k, 8)]
        h[0, more] = mix(h[0, more] + chunk)
        h[1, more] = mix((h[1, more] ^ chunk) * _ODD)
    for w in np.flatnonzero(sizes > LONG).tolist():
        h[:, w] = np.frombuffer(xxhash.xxh3_128_digest(joined[starts[w] : ends[w]]), dtype="<u8")
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=bounds[1:])
    return h, np.searchsorted(starts, bounds)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, by its start, from one hash of each word.

    Runs of 1, 2, 4 .. words are hashed from two halves, and those that make
    up ``n`` one after the other, with a mixing step at each join.
    """
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, at, run, k = np.full(m, _U(n)), 0, words, 1
    while True:
        if n & k:
            out *= _ODD
            out += run[at : at + m]
            out, at = mix(out), at + k
        if 2 * k > n:
            return out
        run, k = mix(run[:-k] * _ODD + run[k:]), 2 * k
