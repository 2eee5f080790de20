"""Toxicity by a weighted lexicon.

Method: texts are folded (case, accents, homoglyphs, digit and sign
substitutions, combining marks), and the words of a weighted lexicon
are found at word starts by one Aho-Corasick pass.  Hits inside an exception
phrase do not count.  The weights' sum, taken by itself and normalised by
length, goes through a logistic curve to a score from 0 to 1; the curve is fitted to the labelled rows.

The lexicon starts from common insults and learns words and word beginnings
from labelled rows.  A term counts once for each group of similar labelled
texts (texts that share a minwise word), so that copies prove nothing, and it
is taken if its counts are far beyond chance.  Learning uses at most
``MAX_TRAIN`` labelled rows, chosen by a hash of the id; its counts are
aggregated in Spark and its results are bounded by that sample.

Defined cases: null and empty texts have no hits and get the base score;
repeated rows and null ids give a row each; without labelled rows the start
lexicon is used with fixed weights; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import scratch, stored, table

MAX_TRAIN = 20_000
#: A learned term occurs in at least so many groups of toxic texts, at such a likelihood ratio, with such a share of toxic ones and such log odds.
LEAST_GROUPS, LEAST_G2, LEAST_SHARE, LEAST_WEIGHT = 6, 30.0, 0.2, 0.3
PREFIXES = range(4, 9)

#: Start lexicon: insults in English, German, French and Spanish.
INSULTS = (
    "idiot moron scum loser stupid trash pathetic worthless disgusting clown imbecile jerk bastard asshole bitch shit fuck retard dumbass scumbag filth vermin degenerate "
    "arschloch scheisse dummkopf trottel miststück wichser hurensohn "
    "connard salope merde abruti crétin enculé débile "
    "pendejo cabrón mierda gilipollas imbécil estúpido puta idiota"
).split()
#: Phrases in which a word of the lexicon is not an insult.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash talk show", "clown fish", "clownfish", "circus clown", "class clown", "pathetic fallacy",
    "shitake", "scunthorpe", "loser s bracket", "losers bracket", "retardant", "flame retardant", "idiot proof", "pond scum", "soap scum",
)
START_WEIGHT = 3.0


def _fold_table() -> dict[int, str | None]:
    """Single characters to what they are read as: letters, or a space."""
    to: dict[int, str | None] = {}
    for c in range(0x250):
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch.lower())[:1]
        to[c] = base if base.isascii() and base.isalpha() else (ch.lower() if ch.isalpha() and len(ch.lower()) == 1 else " ")
    for c in range(0xFF21, 0xFF3B):
        to[c] = to[c + 32] = chr(c - 0xFF21 + 97)
    for c in range(0x2000, 0x2070):
        to[c] = " "
    for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)):
        to[c] = None
    for seen, read in zip("ø đ ł ß æ œ ı".split(), "o d l s a o i".split(), strict=True):
        to[ord(seen)] = read
    for seen, read in zip("0 1 3 4 5 7 8 @ $ ! |".split(), "o i e a s t b a s i i".split(), strict=True):
        to[ord(seen)] = read
    cyrillic, greek = "а в е к м н о р с т у х і ѕ ј ԁ һ ѵ", "α β ε η ι κ ν ο ρ τ υ χ ω"
    for seen, read in zip((cyrillic + " " + greek).split(), "a b e k m h o p c t y x i s j d h v a b e n i k v o p t u x w".split(), strict=True):
        to[ord(seen)] = to[ord(seen.upper())] = read
    return to


_TABLE = _fold_table()


def fold(text: str | None) -> str:
    """A text as its words are read, with a space at either end."""
    return f" {(text or '').translate(_TABLE)} "


@dataclass(frozen=True)
class Model:
    """Terms with their weights, exception phrases, and the curve: bias, then factors of the features."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for t, w in self.terms.items():
            found.add_word(" " + t, (len(t), w))
        for t in self.exceptions:
            found.add_word(" " + fold(t).strip(), (len(fold(t).strip()), None))
        found.make_automaton()
        return found


#: Curve of a model without labelled rows.
START_CURVE = (-3.0, 0.0, 0.5, 0.5, 1.0, 0.0)
FEATURES = len(START_CURVE) - 1


def measure(text: str | None, automaton) -> tuple[float, ...]:
    """Features of a text, from its hits' weights: their sum, the sum against length twice, the largest, and their number."""
    folded = fold(text)
    hits, safe = [], []
    for end, (n, w) in automaton.iter(folded):
        (safe if w is None else hits).append((end - n + 1, end + 1, w))
    if safe:  # a hit is safe if of the phrases that begin no later one ends no earlier
        safe.sort(key=lambda s: s[:2])
        starts, reach = [a for a, _, _ in safe], list(accumulate((b for _, b, _ in safe), max))
        hits = [h for h in hits if not (k := bisect_right(starts, h[0])) or reach[k - 1] < h[1]]
    by_start = {a: w for a, _, w in sorted(hits, key=lambda h: h[2])}  # a word counts by its strongest term
    weights, words = list(by_start.values()), max(1.0, len(folded) / 6)
    total = sum(weights)
    return math.log1p(total), math.log1p(total * 10 / math.sqrt(words)), math.log1p(total * 1000 / words), max(weights, default=0.0), math.log1p(len(weights))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, toxic of at most about ``most`` labelled rows outside the held-out quarter."""
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    share = F.pmod(F.xxhash64("_id", F.lit("labelled")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1)))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(usable.where(share)), "_id").select("text", "toxic")


def learn(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon and curve from a bounded sample (text, toxic)."""
    with scratch(sample.sparkSession):
        return _learned(stored(sample, "sample"), exceptions)


def _learned(sample: DataFrame, exceptions: tuple[str, ...]) -> Model:
    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 200) for b in batches for a in range(0, b.num_rows, 200)):
            out: dict[tuple[str, int, int], None] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in fold(text).split() if len(w) >= 3}
                if not words:
                    continue
                group = min(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=7).digest(), "big") for w in words)
                terms = set(words)
                for w in words:
                    terms.update(w[:n] for n in PREFIXES if n < len(w))
                out.update(dict.fromkeys((t, group, int(toxic)) for t in terms))
            t, g, x = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(g, pa.int64()), pa.array(x, pa.int32())], ["term", "group", "toxic"])

    rows = sample.mapInArrow(terms_of, "term string, group long, toxic int").distinct()
    counts = rows.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where((F.col("t") >= LEAST_GROUPS) & (F.col("t") >= LEAST_SHARE * (F.col("t") + F.col("c"))))
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    nt, nc = totals.get(1, 0), totals.get(0, 0)
    if not nt or not nc:
        return Model({fold(w).strip(): START_WEIGHT for w in INSULTS}, exceptions, START_CURVE)

    def entropy(*parts: float) -> float:
        return sum(p * np.log(p) for p in parts if p > 0)

    found: dict[str, float] = {}
    ranked, sure = [], []
    for r in counts.collect():  # bounded by the sample
        t, c = r["t"], r["c"]
        g2 = 2 * (entropy(t, c, max(nt - t, 0), max(nc - c, 0)) - entropy(t + c, nt + nc - t - c) - entropy(nt, nc) + entropy(nt + nc))
        weight = math.log((t + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))
        if g2 >= LEAST_G2 and weight >= LEAST_WEIGHT:
            ranked.append((-round(g2, 6), -len(r["term"]), r["term"], weight, t))
            if not c:
                sure.append(weight)
    told: dict[str, int] = {}
    for _, _, term, weight, t in sorted(ranked):  # of a word and its beginnings the most telling, and the longest of equals
        shorter = any(term[:n] in found and found[term[:n]] >= weight - 1 for n in range(3, len(term)))
        if not shorter and not any(x.startswith(term) and n >= 0.9 * t for x, n in told.items()):
            found[term], told[term] = weight, t
    for w in INSULTS:  # those not met weigh as much as a typical term that no clean text has
        w = fold(w).strip()
        if not any(w[:n] in found for n in range(3, len(w) + 1)):
            found[w] = max(START_WEIGHT, float(np.median(sure)) if sure else 0.0)
    model = Model(found, exceptions, START_CURVE)

    def measured(series: pd.Series) -> pd.DataFrame:
        automaton = model.automaton()
        return pd.DataFrame([measure(t, automaton) for t in series], columns=names)

    names = [f"x{k}" for k in range(FEATURES)]
    udf = F.pandas_udf(measured, ", ".join(f"{n} double" for n in names))
    points = sample.select(udf("text").alias("x"), "toxic").select("x.*", "toxic").toPandas()  # bounded by the sample
    x = np.column_stack([np.ones(len(points)), points[names].to_numpy()])
    y, beta = points["toxic"].to_numpy(dtype=float), np.zeros(FEATURES + 1)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-6, *[0.1] * FEATURES])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(found, exceptions, tuple(beta.tolist()))


def toxicity(text: Column, model: Model) -> Column:
    """Score of a text column, from 0 to 1."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        beta = np.array(model.curve)
        for series in batches:
            x = np.array([(1.0, *measure(t, automaton)) for t in series]).reshape(-1, FEATURES + 1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))))

    return F.pandas_udf(score, "double")(text)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return learn(labelled(docs, labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    scored = stored(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), model).alias("score")), "scored")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
