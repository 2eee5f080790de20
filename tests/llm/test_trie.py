"""The prefix trie against a plain trie."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from marlstone.llm import prefix_trie as P


def _plain(rows):
    """Nodes of rows (conv_id, turn, role, text) by dictionaries."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(np.fix(c / 100)) * 100
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = {p: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest() for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest[p]) for p, m in members.items()), key=str)


def _nodes(spark, rows, block):
    df = spark.createDataFrame([(*r, "s", 1, b"k", 2) for r in rows], "conv_id long, turn long, role string, text string, seq string, block int, key binary, depth int")
    return sorted((tuple(r[c] for c in P._NODE) for r in P.prefix_trie(P.rebuilt(P.sequences(df)), block).collect()), key=str)


@pytest.fixture(scope="module")
def odd():
    """Conversations with equal starts, equal ones, null fields, repeated rows, gaps, negative ids, and a long one."""
    rng = random.Random(4)
    rows = []
    for c in [*range(-8, 40), 99, 100, *range(150, 175), 201, 305, 1_000_000_007]:
        rows += [(c, t, rng.choice(["user", "bot", None]) if t % 3 == 2 else "user", rng.choice(["a", "bé日", None])) for t in range(rng.randint(1, 7))]
    rows += [(7, None, "user", "first"), (7, 1, "user", "a"), (None, 0, "user", "x"), (None, 1, None, None)]
    rows += [(c, t, "user", "same") for c in range(400, 430) for t in range(6)]
    rows += [(c, t, "user", f"turn {t}") for c in (500, 501, 502) for t in range(120)]
    return rows + rows[:3]


@pytest.mark.parametrize("block", [1, 40, 150, P.BLOCK_TURNS])
def test_trie(spark, odd, block):
    assert _nodes(spark, odd, block) == _plain(odd)


def test_few(spark):
    alone = [(11, 0, "user", "x")]
    assert _nodes(spark, alone, 10) == _plain(alone)
    gone = [(c, 0, "user", "x") for c in range(150, 190) if zlib.crc32(str(c).encode()) % 6]  # all lose their only turn
    assert _nodes(spark, gone, 3) == _plain(gone) and len(_plain(gone)) == 1
    assert _nodes(spark, [], 10) == []


def test_extents():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 65):
        lcp = rng.integers(0, 4, n)
        at, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        left, right = P.extents(P.range_minima(lcp), at, depth)
        for i, d, a, b in zip(at, depth, left, right, strict=True):
            lo = hi = i
            while lo > 0 and lcp[lo] >= d:
                lo -= 1
            while hi + 1 < n and lcp[hi + 1] >= d:
                hi += 1
            assert (a, b) == (lo, hi)
