"""Trie of conversation prefixes from sorted sequences and their LCPs.

Method: a conversation is the sequence of its turns' 128-bit hashes.  All
sequences are sorted, each with its LCP, the turns it shares with the one
before it.  The members of a prefix are an interval of them; a sparse table of
range minima over the LCPs answers how far it reaches: every candidate
searches its left and its right end by itself, by halving steps.  A prefix of
a sequence that is longer than the LCP is a new node; the node one turn
shorter is its parent.  Members, leaves, children and saved tokens of an
interval are differences of running sums.

The order is cut into blocks of about ``BLOCK_TURNS`` turns, each with its own
sparse table, with the LCPs to the blocks before and after it.  Nodes within a
block are whole; those across a block's end, one for each turn that its last
sequence shares with the next, are parts whose numbers add up, by a hash of
the prefix.  A task holds a block, that is 24 bytes for each turn; of the
conversations that end at a node across blocks it reads the ids as a stream.
A conversation's hashes are held in one task, as a text is.

Defined cases: null roles and texts are empty; rows without conv_id take no
part; rows of equal turn are in the order of their hashes, null turns first;
repeated rows are turns of their own; a conversation may lose all its turns
and is then a member of the root alone; an empty table gives no nodes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import join_counted, scratch, stored, table

BLOCK_TURNS = 200_000
#: Bytes of a turn's hash.
WIDE = 16
_NONE = hashlib.sha256(b"").hexdigest()

_PART = (
    "block int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, crossing boolean, key binary, parent_key binary, ends string"
)
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: an array of (turn, hash, chars) in order, for each conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("hash"), F.length(text).alias("chars"))
    return turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations whose first turns, up to five, are those of the conversation that begins their hundred."""
    heads = own.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    first = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.size("turns"))
    return own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def range_minima(x: np.ndarray) -> list[np.ndarray]:
    """Sparse table: entry j of level k is the least of 2^k values from j."""
    levels = [x]
    for k in range(max(len(x), 1).bit_length() - 1):
        levels.append(np.minimum(levels[-1][: -(1 << k)], levels[-1][1 << k :]))
    return levels


def extents(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last sequence that share ``depth`` turns with that at ``at``, by the LCPs' range minima."""
    left, right, n = at.copy(), at.copy(), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        least, step = levels[k], 1 << k
        x = left - step
        left = np.where((x >= 0) & (least[np.clip(x + 1, 0, len(least) - 1)] >= depth), x, left)
        x = right + step
        right = np.where((x < n) & (least[np.clip(right + 1, 0, len(least) - 1)] >= depth), x, right)
    return left, right


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their start."""
    lo, hi = 0, min(len(a), len(b)) // WIDE
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[WIDE * lo : WIDE * mid] == b[WIDE * lo : WIDE * mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _prefix_keys(seq: bytes, depth: int) -> list[bytes]:
    """A hash of each prefix up to ``depth`` turns, from the one before it."""
    keys = [b"\0" * WIDE]
    for d in range(depth):
        keys.append(hashlib.blake2b(keys[-1] + seq[WIDE * d : WIDE * (d + 1)], digest_size=WIDE).digest())
    return keys


def block_nodes(ids: list[int], seqs: list[bytes], chars: list[np.ndarray], before: bytes | None, after: bytes | None) -> dict[str, object]:
    """Columns of the nodes and parts of a block, whose sequences may come in any order; ``before`` and ``after`` are its neighbours' nearest."""
    order = sorted(range(len(ids)), key=lambda k: (seqs[k], ids[k]))
    seqs, conv = [seqs[k] for k in order], np.array([ids[k] for k in order], dtype=np.int64)
    chars = np.concatenate([chars[k] for k in order]).astype(np.int64)
    n = len(seqs)
    size = np.array([len(s) // WIDE for s in seqs])
    lcp_before, lcp_after = (-1 if x is None else shared(x, y) for x, y in ((before, seqs[0]), (after, seqs[-1])))
    lcp = np.array([lcp_before, *(shared(a, b) for a, b in zip(seqs, seqs[1:], strict=False))])
    levels = range_minima(lcp)

    # The parts: every prefix of the first sequence, and of each other those that it doesn't share with the one before.
    low = np.where(np.arange(n) == 0, 0, lcp + 1)
    off = np.concatenate([[0], np.cumsum(size - low + 1)])
    at = np.repeat(np.arange(n), np.diff(off))
    depth = np.arange(off[-1]) - off[at] + low[at]
    _, right = extents(levels, at, depth)
    heads = np.flatnonzero(depth == low[at])[1:]  # the first new part of a sequence hangs on a part of an earlier one
    left, _ = extents(levels, at[heads], depth[heads] - 1)
    parent = np.arange(off[-1]) - 1
    parent[heads] = off[left] + depth[heads] - 1 - low[left]

    goes_back = (at == 0) & (depth <= lcp_before)
    crossing = goes_back | ((right == n - 1) & (depth <= lcp_after))
    members = right - at + 1
    least = range_minima(conv)
    k = np.frexp(members)[1] - 1
    first = np.zeros(len(at), dtype=np.int64)
    for x, values in enumerate(least):
        some = k == x
        first[some] = np.minimum(values[at[some]], values[right[some] - (1 << x) + 1])
    begins = np.concatenate([[0], np.cumsum(size)])
    own = np.where(depth > 0, np.append(chars, 0)[begins[at] + depth - 1], 0) * (members - ~goes_back)
    saved = np.concatenate([[0], np.cumsum(own)])
    leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:], lcp_after) < size)])
    children = np.bincount(parent[1:], weights=~goes_back[1:], minlength=len(at)).astype(np.int64)
    firsts = np.flatnonzero(np.append(True, (lcp[1:] != size[1:]) | (size[1:] != size[:-1])))  # of equal sequences
    upto = dict(zip(firsts.tolist(), [*firsts[1:].tolist(), n], strict=True))

    back, ahead = _prefix_keys(seqs[0], lcp_before), _prefix_keys(seqs[-1], lcp_after)
    keys: list[bytes | None] = [None] * len(at)
    for p in np.flatnonzero(crossing).tolist():
        keys[p] = (back if goes_back[p] else ahead)[depth[p]]
    digest, ends = [_NONE] * len(at), [None] * len(at)
    for p in np.flatnonzero(depth == size[at]).tolist():
        text = ",".join(map(str, conv[at[p] : upto[int(at[p])]].tolist()))
        if crossing[p]:
            ends[p] = text
        else:
            digest[p] = hashlib.sha256(text.encode()).hexdigest()
    parents = parent.tolist()
    return {
        "conv_id": first, "depth": depth, "parent_conv_id": pa.array([None if p < 0 or crossing[p] else int(first[p]) for p in parents], pa.int64()),
        "n_convs": members, "n_children": children, "n_leaves": leaf[right + 1] - leaf[at], "saved_tokens": saved[off[right + 1]] - saved[:-1],
        "ends_sha256": pa.array(digest, pa.string()), "crossing": crossing, "key": pa.array(keys, pa.binary()),
        "parent_key": pa.array([keys[p] if p >= 0 else None for p in parents], pa.binary()), "ends": pa.array(ends, pa.string()),
    }


def _parts(rows: pa.Table, edge: pa.Table) -> pa.Table:
    lists = rows["chars"].combine_chunks()
    flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    chars = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    found = block_nodes(rows["conv_id"].to_pylist(), rows["seq"].to_pylist(), chars, edge["before"][0].as_py(), edge["after"][0].as_py())
    block = pa.array(np.full(len(found["depth"]), rows["block"][0].as_py()), pa.int32())
    return pa.table({"block": block, **found})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each key's ids, whose chunks come one after the other."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist([{"key": key, "digest": state.hexdigest()}])
                key, state = k, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "digest": state.hexdigest()}])


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turns: see ``sequences``)."""
    spark = conversations.sparkSession
    with scratch(spark) as keep:
        flat = conversations.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), "")).alias("seq"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
        flat = stored(flat, "sequences")
        blocks = max(1, -(-(flat.agg(F.sum(F.size("chars") + 1)).first()[0] or 0) // block_turns))
        ordered = stored(flat.repartitionByRange(blocks, "seq", "conv_id").withColumn("block", F.spark_partition_id()), "ordered")
        by_block = Window.orderBy("block")  # a row for each block
        edges = ordered.groupBy("block").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
        edges = edges.select("block", F.lag("last").over(by_block).alias("before"), F.lead("first").over(by_block).alias("after"))
        parts = stored(ordered.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(_parts, _PART), "parts")

        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        across = parts.where("crossing").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *sums)
        chunks = parts.where("ends is not null").select("key", "ends", "block").repartition("key").sortWithinPartitions("key", "block").drop("block")
        across = across.join(chunks.mapInArrow(_digests, "key binary, digest string"), "key", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(_NONE))).drop("digest")
        across = stored(across, "across")

        columns = ["parent_key", *(c for c in _NODE if c != "parent_conv_id")]
        hanging = parts.where("not crossing and parent_key is not null").select(*columns).unionByName(across.where("parent_key is not null").select(*columns))
        upper = across.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
        whole = parts.where("not crossing and parent_key is null").select(*_NODE)
        root = across.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*_NODE)
        keep(parts), keep(across)
        return whole.unionByName(root).unionByName(join_counted(hanging, upper, ["parent_key"]).select(*_NODE))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


_CRC = "(xor(list_reduce(flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: [ascii(CAST(c AS VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)))"

OP12_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS o FROM t GROUP BY c),
base AS (SELECT c, c - c % 100 AS b, CAST({_CRC} % 6 AS INTEGER) AS h, o FROM own),
rebuilt AS (SELECT x.c, list_concat(coalesce(y.o, [])[1:x.h], x.o[x.h + 1:]) AS s FROM base x LEFT JOIN own y ON y.c = x.b),
prefixes AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt),
nodes AS (SELECT d, s[1:d] AS p, min(c) AS conv_id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d) AS ends FROM prefixes GROUP BY ALL),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (d, p)),
above AS (SELECT k AS d, p[1:k] AS p, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, CASE WHEN len(p) > 0 THEN (n - 1) * p[-1].n ELSE 0 END AS saved FROM (SELECT p, n, n_children, unnest(range(0, d + 1)) AS k FROM full_nodes)),
sums AS (SELECT d, p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM full_nodes a JOIN sums s USING (d, p) LEFT JOIN nodes b ON b.d = a.d - 1 AND b.p = a.p[1:a.d - 1]
"""
