"""Ranked search against scores of all documents."""

import collections
import math
import re

import numpy as np
import pytest

from marlstone.llm import ranked_search as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(docs, items, k=10):
    sets = [(d, collections.Counter(WORD.findall(t.translate(LOWER)))) for d, t in docs if t]
    sets = [(d, c, sum(c.values())) for d, c in sets if c]
    n_docs, total = len(sets), sum(n for _, _, n in sets)
    df = collections.Counter(t for _, c, _ in sets for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        terms = set(WORD.findall((text or "").translate(LOWER)))
        best = []
        for d, c, n in sets:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                best.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(best, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def _ranked(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1, [2], 0.5, 7) for r in docs], "doc_id long, text string, n long, terms array<int>, score double, shard int")
    q = spark.createDataFrame([(*r, 1, "k") for r in items], "item_id long, text string, no int, key string")
    return sorted((tuple(r) for r in S.ranked(d, q, **how).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def odd():
    """Copies, ties, repeated rows, null ids and texts, capitals, other scripts, signs, a long text."""
    rng = np.random.default_rng(8)
    words = [*(f"w{k}" for k in range(60)), "Ärger", "日本語", "ÀB", "x1"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=None)) for _ in range(120)]
    docs = list(enumerate(texts)) + [(200 + k, "W1 w2, w3-w4 copy copy") for k in range(40)] + [(5, texts[5]), (None, texts[6]), (None, "w1 w2 only"), (300, None), (301, ""), (302, "... !?")]
    docs += [(303, " ".join(f"w{k % 50} y{k}" for k in range(20_000))), (304, "a\x00b w1\x7fw2 é")]
    items = [(1, "w1 W2 w3 w4 copy"), (2, texts[9]), (2, texts[9]), (3, None), (4, "?!"), (5, "unknown words alone"), (6, "日本語 ÀB ärger Ärger"), (7, "w1"), (7, "w2"), (8, " ".join(words)), (9, "b é")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"shard_postings": 60}, {"block_terms": 20, "shard_postings": 500}, {"k": 3}])
def test_ranked(spark, odd, how):
    assert _ranked(spark, *odd, **how) == _plain(*odd, how.get("k", 10))


def test_empty(spark, odd):
    docs, items = odd
    assert _ranked(spark, [], items) == _ranked(spark, docs, []) == _ranked(spark, [(1, None), (2, " ")], items) == []


def test_search_is_whole_and_looks_at_few():
    """The best of random lists equal those of a full sort, ties by position; rare terms spare most documents."""
    rng = np.random.default_rng(2)
    for n_docs, n_terms, k in ((1, 1, 10), (50, 4, 10), (3000, 30, 10), (3000, 30, 1)):
        rows = {(int(t), int(d)): int(v) for t, d, v in zip(rng.integers(0, n_terms, 4 * n_docs), rng.integers(0, n_docs, 4 * n_docs), rng.integers(1, 9, 4 * n_docs), strict=True)}
        terms, docs, values = (np.array(x) for x in ([t for t, _ in rows], [d for _, d in rows], list(rows.values())))
        index = S.Index(terms, docs, values, n_docs)
        total = np.bincount(docs, weights=values, minlength=n_docs).astype(int)
        order = [d for d in np.lexsort((np.arange(n_docs), -total)) if total[d] > 0][:k]
        where, score = index.search(np.arange(n_terms + 2), k)
        assert where.tolist() == order and score.tolist() == total[order].tolist()
    n = 20_000
    common, rare = np.arange(n), rng.choice(n, 40, replace=False)
    index = S.Index(np.repeat([0, 1], [n, 40]), np.concatenate([common, rare]), np.concatenate([rng.integers(1, 10, n), np.full(40, 1000)]), n)
    seen, bounds = [0], index.bounds
    index.bounds = lambda lo, hi: (seen.__setitem__(0, seen[0] + len(lo)), bounds(lo, hi))[1]
    assert len(index.search(np.array([0, 1]))[0]) == 10 and seen[0] < 1000
