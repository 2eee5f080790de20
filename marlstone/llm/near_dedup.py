"""MinHash near-deduplication by chosen-path set similarity join.

A document's set holds its distinct shingles of ``SHINGLE`` lower-cased words.
Method: each of ``TREES`` independent trees branches the documents by minwise
tokens: at a node, one selected coordinate of the sketch (two below the first
level) decides to which child a document goes.  Documents of a small node are
compared with each other; a large node branches on.  Two sets of similarity J
share a first-level node of a tree with probability J, and with two branches
at every further level they stay together with a probability of 0.89 at
J = 0.75 however deep the tree is, so ten trees miss about one such pair in a
million at the first level and 2e-5 of those in large nodes.

Work stays low in groups of copies: equal sets are one class from the start;
every node first compares its members with ``PIVOTS`` pivots only; then only
members of different components are compared, and nodes within one component
end.  Small nodes name their pairs, which must pass a 128-bit sketch at over
five standard deviations below the threshold and are confirmed on the full
sets.  Nodes up to ``LARGE_NODE`` documents and ``LARGE_SHINGLES`` shingles
get the full sets and answer with the links that join components, at most one
for each member.  Larger ones branch; those that are left at ``LEVELS`` are
compared block by block, so nothing is capped.

Defined cases: texts without words and null texts have an empty set and no
links; a text of fewer words than a shingle has its whole sequence as its one
shingle; rows that share a doc_id are one document with the links of each of
them; rows with a null doc_id are not compared, have no component and are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import broadcast_if_small, discard, join_counted, scratch, stored, table
from marlstone.llm.components import components
from marlstone.llm.hashing import mix, sequence_hashes, word_hashes
from marlstone.llm.tokens import in_groups

SHINGLE, PERCENT = 5, 75
TREES, BRANCHES, LEVELS = 10, 2, 10
#: Documents of a node up to which all are compared with each other.
SMALL_NODE, PIVOTS = 64, 3
#: Documents and shingles of a node, or of a block of a larger one, that a task holds at a time.
LARGE_NODE, LARGE_SHINGLES = 4096, 8_000_000
#: Documents times shingles of a node up to which it is compared in blocks and does not branch.
NODE_WORK = LARGE_NODE * LARGE_SHINGLES
#: Documents times shingles that a task compares at a time, and pairs of one hub that are confirmed side by side.
BLOCK_WORK, HUB_PAIRS = 500_000_000, 256
BINS, TOKENS = 128, 64
#: Sketch bits that may differ: at 75 % similarity 12.5 % do, with a standard deviation below 3 % of the bits.
MOST_BITS = 35

_U = np.uint64
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 8 + BINS, dtype=np.uint64)
_CUTS = np.array([(k << 64) // BINS for k in range(BINS)], dtype=np.uint64)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes([t and t.lower() for t in texts])
    runs = sequence_hashes(words[0], SHINGLE)  # of the texts side by side; those across two texts are not used
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(runs[a : b - SHINGLE + 1] if b - a >= SHINGLE else sequence_hashes(words[0, a:b], max(b - a, 1)))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """One minwise value for each of BINS coordinates.

    The shingles are dealt over the coordinates by a hash, and each takes its
    smallest; coordinates left empty take part in further rounds, and after
    those take the minimum of a hash of their own over all shingles.
    """
    out, empty = np.zeros(BINS, dtype=np.uint64), np.ones(BINS, dtype=bool)
    h = shingles  # sorted, so that each coordinate's range begins with its minimum
    for r in range(8):
        if r:
            h = np.sort(mix(shingles ^ _SEEDS[r]))
        at = np.searchsorted(h, _CUTS)
        has = empty & (np.append(at[1:], len(h)) > at)
        out[has] = mix(h[at[has]] + _U(r))
        empty &= ~has
        if not empty.any():
            return out
    rest = np.flatnonzero(empty)
    out[rest] = mix(shingles[:, None] ^ _SEEDS[8 + rest]).min(axis=0)
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set fingerprint (f0, f1), 128-bit sketch (s0, s1) and minwise tokens of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _U(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            ids = batch.column(0)
            for first, texts in in_groups(batch.column(1).to_pylist()):
                n, f, s, tokens = [], [], [], []
                for u in shingle_sets(texts):
                    n.append(len(u))
                    if not len(u):
                        f.append((0, 0)), s.append((0, 0)), tokens.append(None)
                        continue
                    f.append((u.sum(dtype=np.uint64), mix(u + _U(1)).sum(dtype=np.uint64)))
                    m = minwise(u)
                    bits = m & _U(1)
                    s.append(((bits[:64] * weights).sum(dtype=np.uint64), (bits[64:] * weights).sum(dtype=np.uint64)))
                    tokens.append((m[:TOKENS] >> _U(33)).astype(np.int32))
                f, s = (np.array(x, dtype=np.uint64).reshape(-1, 2).astype(np.int64) for x in (f, s))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(n, pa.int64()), *(pa.array(x[:, k]) for x in (f, s) for k in (0, 1)), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "f0", "f1", "s0", "s1", "tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(sign, "doc_id long, n_shingles long, f0 long, f1 long, s0 long, s1 long, tokens array<int>")


def full_sets(docs: DataFrame, ids: DataFrame, n_ids: int, id_col: str, text_col: str) -> DataFrame:
    """id, shingles (packed, sorted) of the documents with the given ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, texts in in_groups(batch.column(1).to_pylist()):
                found = [u.tobytes() for u in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(texts)), pa.array(found, pa.binary())], ["id", "shingles"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return stored(source.join(broadcast_if_small(ids, n_ids), "id", "left_semi").mapInArrow(sets, "id long, shingles binary"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """a, b of those of stored ``pairs`` (hub, other) whose full sets have the similarity.

    A hub of many pairs, such as a pivot, stands once for each HUB_PAIRS of
    them, so that they are spread over tasks.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                keep.append(both * 100 >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("hub", "other")).alias("id")).distinct()
    full = full_sets(docs, ids, 2 * pairs.count(), id_col, text_col)
    hubs = stored(pairs.groupBy("hub").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / HUB_PAIRS).cast("int")), "hubs")
    part = F.pmod(F.xxhash64("other", F.lit("part")), F.col("parts")).cast("int").alias("part")
    placed = join_counted(pairs, hubs, ["hub"]).select("hub", "other", part).join(full.select(F.col("id").alias("other"), F.col("shingles").alias("y")), "other")
    parts = full.join(hubs.withColumnRenamed("hub", "id"), "id").select(F.col("id").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("x"))
    both = placed.join(parts, ["hub", "part"]).select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"), "x", "y")
    return both.mapInArrow(compare, "a long, b long").distinct()


def joining_links(sets: list[np.ndarray], c: list[int], percent: int, split: int = 0) -> list[tuple[int, int]]:
    """Positions of pairs that join components ``c``, one for each union; only across ``split`` if it is given.

    A document outside the largest component is held against all others, or
    all of the other side, at once: its shingles are marked in the vocabulary
    of all sets, and marks are counted set by set.  Across ``split`` the first
    side is held against the second where that is less.
    """
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    root = {x: x for x in c}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    held = range(len(sets))
    if len(root) < len(c):
        largest = max(root, key=Counter(c).__getitem__)
        held = [k for k in held if c[k] != largest]
    if split and split <= len(held):
        held = range(split)
    mark, out = np.zeros(flat.max() + 1, dtype=np.int32), []
    for k in held:
        a, b = (0, len(sets)) if not split else (split, len(sets)) if k < split else (0, split)
        own = flat[starts[k] : starts[k + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[starts[a] : starts[b]]], starts[a:b] - starts[a])
        mark[own] = 0
        for j in (a + np.flatnonzero(both * 100 >= percent * (sizes[a:b] + sizes[k] - both))).tolist():
            if find(c[k]) != find(c[j]):
                root[find(c[k])] = find(c[j])
                out.append((k, j))
    return out


def linked_in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join components within the nodes of (node, id, c, n, shingles).

    A node stands in blocks, so many that a pair of them, which is one group,
    stays within LARGE_NODE documents, LARGE_SHINGLES shingles and BLOCK_WORK
    of the one times the other.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "id"], kind="stable")
        sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
        found = joining_links(sets, group["c"].tolist(), percent, int((group["side"] == 0).sum()) if group["side"].any() else 0)
        ids = group["id"].to_numpy()
        return pd.DataFrame({"a": [min(ids[x], ids[y]) for x, y in found], "b": [max(ids[x], ids[y]) for x, y in found]}, dtype="int64")

    blocks = F.greatest(F.ceil(F.col("n") / LARGE_NODE), F.ceil(F.col("all_shingles") / LARGE_SHINGLES), F.ceil(F.sqrt(F.col("n").cast("double") * F.col("all_shingles") / BLOCK_WORK))).cast("int")
    placed = rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id", F.lit("block")), blocks)})
    # Block x meets the blocks from x on: its rows are side 0 of pairs (x, y) and side 1 of pairs (w, x).
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least("block", y).alias("x"), F.greatest("block", y).alias("y"), (y < F.col("block")).cast("int").alias("side")))
    each = placed.select("node", "id", "c", "shingles", F.explode(pair).alias("p")).select("node", "p.x", "p.y", "p.side", "id", "c", "shingles")
    return each.groupBy("node", "x", "y").applyInPandas(compare, "a long, b long")


def _near(x: str, y: str):
    """Whether two rows' sketches leave the similarity possible."""
    return F.bit_count(F.col(f"{x}s0").bitwiseXOR(F.col(f"{y}s0"))) + F.bit_count(F.col(f"{x}s1").bitwiseXOR(F.col(f"{y}s1"))) <= MOST_BITS


def _with_component(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("c", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def similar_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        signed = keep(stored(signatures(docs, id_col, text_col), "signatures"))
        classes = keep(stored(signed.where("n_shingles > 0 and doc_id is not null").groupBy("f0", "f1", "n_shingles").agg(F.min("doc_id").alias("id"), *[F.any_value(x).alias(x) for x in ("s0", "s1", "tokens")]), "classes"))  # equal sets have equal sketches
        labels = _joined_classes(classes, docs, percent, id_col, text_col)
        if labels is not None:
            keep(labels)
    out = signed.select("doc_id", "n_shingles", "f0", "f1").join(classes.select("f0", "f1", "n_shingles", "id"), ["f0", "f1", "n_shingles"], "left")
    if labels is None:
        found = out.withColumn("component_id", F.coalesce("id", "doc_id"))
    else:
        own = labels.select(F.col("id").alias("doc_id"), F.col("component").alias("own"))
        found = out.join(labels, "id", "left").join(own, "doc_id", "left").withColumn("component_id", F.least(F.coalesce("component", "id", "doc_id"), F.coalesce("own", "doc_id")))
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _mixed(live: DataFrame) -> DataFrame:
    """The rows of stored ``live`` whose node holds several components."""
    mixed = live.groupBy("node").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("rows")).where("lo != hi").select("node", "rows")
    return join_counted(live, stored(mixed, "mixed"), ["node"], "rows").drop("rows")


def _joined_classes(classes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """(id, component) of the classes that are linked with others; stored."""
    members = classes.select("id", "s0", "s1", F.col("n_shingles").alias("m"), "tokens")
    labels = None

    def settle(keep, pairs: DataFrame, more: DataFrame | None = None) -> None:
        """Confirm candidate pairs, add links that need it no more, and bring the components up to date."""
        nonlocal labels
        with scratch(docs.sparkSession) as own:
            # A pair that was found both ways is confirmed once.
            ends = [F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b")]
            pairs = stored(pairs.groupBy(*ends).agg(F.min("hub").alias("hub")).select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")), "pairs")
            found = None if pairs.isEmpty() else confirmed(pairs, docs, percent, id_col, text_col)
            found = more if found is None else found if more is None else found.union(more)
            if found is None:
                return
            if labels is not None:
                for side in ("a", "b"):
                    found = found.join(labels.select(F.col("id").alias(side), F.col("component").alias("c")), side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
            new = components(found)
            if new.isEmpty():
                return
            if labels is not None:
                new = labels.select("id", F.col("component").alias("old")).join(new.select(F.col("id").alias("old"), F.col("component").alias("c")), "old", "left").select("id", F.coalesce("c", "old").alias("component")).union(new).distinct()
            old, labels = labels, keep(own(stored(new, "labels")))
        if old is not None:
            discard(old)

    # First level: a coordinate for each tree.
    live = members.select("id", "s0", "s1", "m", F.posexplode(F.slice("tokens", 1, TREES)).alias("k", "t")).select(F.xxhash64("k", "t").alias("node"), "id", F.col("id").alias("c"), "s0", "s1", "m")
    for level in range(1, LEVELS + 1):
        with scratch(docs.sparkSession) as keep:
            pivot = [F.min(F.struct(F.xxhash64("node", "id", F.lit(k)).alias("r"), F.col("id").alias("pid"), F.col("c").alias("pc"), F.col("s0").alias("ps0"), F.col("s1").alias("ps1"))) for k in range(PIVOTS)]
            nodes = live.groupBy("node").agg(F.count("*").alias("n"), F.sum("m").alias("all_shingles"), F.array_distinct(F.array(*pivot)).alias("pivots")).where("n > 1")
            live = stored(join_counted(live, stored(nodes, "nodes"), ["node"]), "live")
            star = live.select("id", "c", "s0", "s1", F.explode("pivots").alias("p")).select("id", "c", "s0", "s1", "p.*").where((F.col("c") != F.col("pc")) & _near("", "p"))
            settle(keep, star.select(F.col("pid").alias("hub"), F.col("id").alias("other")))
            live = stored(_with_component(live.where("n > 2").drop("pivots", "c"), labels), "labelled")
            live = stored(_mixed(live), "live")
            small = live.where(F.col("n") <= SMALL_NODE).groupBy("node").agg(F.collect_list(F.struct("c", "id", "s0", "s1")).alias("m"))  # at most SMALL_NODE of a node

            def others(x):
                return F.filter("m", lambda y: (y.c > x.c) & (F.bit_count(y.s0.bitwiseXOR(x.s0)) + F.bit_count(y.s1.bitwiseXOR(x.s1)) <= MOST_BITS))

            def links(x):
                return F.transform(others(x), lambda y: F.struct(x.id.alias("hub"), y.id.alias("other")))

            pairs = small.select(F.explode(F.flatten(F.transform("m", links))).alias("e")).select("e.*")
            held = F.col("n").cast("double") * F.col("all_shingles") <= NODE_WORK if level < LEVELS else F.lit(True)
            large, joined = live.where((F.col("n") > SMALL_NODE) & held), None
            if not large.isEmpty():
                ids = stored(large.select("id").distinct(), "ids")
                joined = stored(linked_in_blocks(large.join(full_sets(docs, ids, ids.count(), id_col, text_col), "id"), percent), "links")
            settle(keep, pairs, joined)
            rest = live.where((F.col("n") > SMALL_NODE) & ~held)
            if rest.isEmpty():
                break
            # Branch: children of a node take coordinates chosen by the node.
            rest = stored(_with_component(rest.select("node", "id", "s0", "s1", "m"), labels), "rest")
            grown = _mixed(rest).join(members.select("id", "tokens"), "id")
            child = F.explode(F.array(*[F.xxhash64("node", F.lit(b), F.get("tokens", F.pmod(F.xxhash64("node", F.lit(b), F.lit("coordinate")), F.lit(TOKENS)).cast("int"))) for b in range(BRANCHES)])).alias("node")
            live = keep(stored(grown.select(child, "id", "c", "s0", "s1", "m").distinct(), "children"))
    return labels


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
