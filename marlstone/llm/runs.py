"""Vectorised runs of bytes of one class, with a hash of each."""

from __future__ import annotations

import numpy as np
import xxhash

from marlstone.llm.hashing import mix

_U = np.uint64
_ODD = _U(0xD6E8FEB86659FD93)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Runs longer than so many bytes take XXH3 in place of eight bytes at a time.
LONG = 64


def class_runs(texts: list[bytes | None], classes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one piece, the maximal runs of bytes of equal class in it (starts, ends), and where each text's runs begin (one entry more than texts).

    ``classes`` has the class of each of the 256 bytes; bytes of class 0, the
    space among them, are in no run.
    """
    joined = b" ".join(t or b"" for t in texts) + b" " * 8
    of = classes[np.frombuffer(joined, dtype=np.uint8)]
    change = np.flatnonzero(np.diff(of, prepend=np.uint8(0)))
    inside = of[change] != 0
    starts, ends = change[inside], np.append(change[1:], len(joined))[inside]
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=bounds[1:])
    return joined, starts, ends, np.searchsorted(starts, bounds)


def run_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run."""
    sizes = ends - starts
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    h = (sizes.astype(np.uint64) + _U(seed << 32)) * _ODD
    for k in range(0, LONG, 8):
        more = np.flatnonzero(sizes > k) if k else slice(None)
        if k and not len(more):
            break
        h[more] = mix(h[more] + (eight[starts[more] + k] & _FIRST[np.minimum(sizes[more] - k, 8)]))
    for w in np.flatnonzero(sizes > LONG).tolist():
        h[w] = xxhash.xxh3_64_intdigest(joined[starts[w] : ends[w]], seed)
    return h


def byte_classes(*kinds: str) -> np.ndarray:
    """Class 1, 2 .. for the ASCII characters of each of ``kinds``; bytes of other characters have the first class, all else 0."""
    classes = np.zeros(256, dtype=np.uint8)
    classes[128:] = 1
    for k, chars in enumerate(kinds, 1):
        classes[list(chars.encode())] = k
    return classes
