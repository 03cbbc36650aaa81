"""Conversation prefix trie by composable monoid fingerprints (operator 12).

Every conversation is rebuilt from a head, the first turns of its base conversation, and a suffix, its own turns after
as many.  A run of turns with hashes h_1 .. h_n has in each of four lanes the fingerprint

    (R^n, h_1 + h_2 R + ... + h_n R^(n-1))   modulo 2^31 - 1,   (a, s) (b, t) = (a b, s + a t),

so the fingerprints of a rebuilt conversation's prefixes follow from those of stored ones: its own prefix sums under one
affine map per conversation and lane.  No rebuilt text is ever put together.  Prefixes of equal depth and fingerprint are
a node.  Its members' last turns must refer to equal stored turns, and turns of equal hashes must have equal role and
text; as the fingerprint before the last turn follows from both, prefixes are then equal turn by turn.  Should the check
fail, all is computed again with other hashes.

Sums over subtrees need no walk.  The smallest member of a node owns it.  A conversation m owns the nodes of its path from
some depth f on, so each of its prefixes up to f - 1 is one spared repetition, and a node's saved tokens are the sum over
its members of their words between its depth and f.  Likewise its leaves are the members that own the node they end in.

What moves: hashes, counts and 128 characters per turn, not the texts, but for one aggregate by hash that compares them.
A conversation that holds a third of all turns is ordered by ranges and summed range by range; a turn that many begin
with is counted in the tasks first.  The ids that end in a node are joined to chunks in sorted ranges before one task
per node digests the chunks, as SHA-256 must be taken in order.

Defined results: turns are ordered by turn (nulls first), then role, the text's first 128 characters and its MD5; fully
equal turns both count.  Null roles and texts are empty; rows without a conversation are left out; remainders of negative
ids are negative, as in SQL.  An empty table has no root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.base import materialise

PRIME = (1 << 31) - 1
LANES = range(4)
GROUP, MOST_HEAD = 20, 4     # conversations that share a base; a head has fewer turns than that
HEAD_CHARS = 128
CHUNK = 1 << 16              # characters of ids that are joined to one row
SEEDS = (11, 12, 13, 14)     # of the hashes; the next is taken if two different prefixes should agree in one
KEY = ["depth", "x", "y"]


def turn_hashes(role: Column, text: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), role, text), F.xxhash64(F.lit(-seed), text, role)


def bases(seed: int) -> list[int]:
    return np.random.default_rng(seed).integers(1 << 20, PRIME - 1, len(LANES)).tolist()


def _power(base: int, n: np.ndarray) -> np.ndarray:
    out, square, n = np.ones(len(n), np.int64), base, n.copy()
    while n.any():
        out = np.where(n & 1, out * square % PRIME, out)
        square, n = square * square % PRIME, n >> 1
    return out


def _terms(n: pa.Array, a: pa.Array, b: pa.Array, roots: list[int]) -> list[np.ndarray]:
    """What a turn with the hashes ``a`` and ``b`` adds to each lane after ``n`` others."""
    n, a, b = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (n, a, b))
    return [h * _power(r, n) % PRIME for h, r in zip((a & PRIME, a >> 31 & PRIME, b & PRIME, b >> 31 & PRIME), roots)]


def _packed(s: list[Column]) -> tuple[Column, Column]:
    return s[0] + F.shiftleft(s[1], 31), s[2] + F.shiftleft(s[3], 31)


def stored_turns(df: DataFrame, conv: str, turn: str, role: str, text: str, seed: int) -> DataFrame:
    """Per stored turn its place ``pos`` (from 1), hashes, words, and the sums ``s0`` to ``s3`` and ``w`` up to it."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    a, b = turn_hashes(r, t, seed)
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), r.alias("role"), F.substring(t, 1, HEAD_CHARS).alias("begin"),
        F.md5(t).alias("digest"), a.alias("a"), b.alias("b"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ["c", "turn", "role", "begin", "digest"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "c", "a", "b", "words", F.monotonically_increasing_id().alias("at"))
    # the number of the range stands above the place in it
    placed = materialise(placed.withColumn("cell", F.shiftright("at", 33)))
    cells = placed.groupBy("c", "cell").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("c").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("c", "cell", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    roots = bases(seed)

    @F.arrow_udf("struct<t0: bigint, t1: bigint, t2: bigint, t3: bigint>")
    def terms(pos: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        n = pa.array(pos.to_numpy(zero_copy_only=False) - 1)
        return pa.StructArray.from_arrays([pa.array(x) for x in _terms(n, a, b, roots)], [f"t{i}" for i in LANES])

    rows = placed.join(cells, ["c", "cell"]).withColumn("pos", F.col("at") - F.col("first") + F.col("start") + 1)
    rows = rows.withColumn("t", terms("pos", "a", "b"))
    inside = Window.partitionBy("c", "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    names = [*(f"s{i}" for i in LANES), "w"]
    values = [*(F.col(f"t.t{i}") for i in LANES), F.col("words")]
    rows = materialise(rows.select("c", "cell", "pos", "a", "b", "words", *[F.sum(v).over(inside).alias(n) for v, n in zip(values, names)]))
    sums = rows.groupBy("c", "cell").agg(*[F.max(n).alias(n) for n in names])   # terms are never negative
    before = sums.select("c", "cell", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_0") for n in names])
    whole = [((F.col(f"s{i}") + F.col(f"s{i}_0")) % PRIME).alias(f"s{i}") for i in LANES]
    return rows.join(before, ["c", "cell"]).select("c", "pos", "a", "b", "words", *whole, (F.col("w") + F.col("w_0")).alias("w"))


def turns_differ(df: DataFrame, conv: str, role: str, text: str, seed: int) -> bool:
    """Do two turns with equal hashes differ in role or text?"""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    a, b = turn_hashes(r, t, seed)
    rows = df.where(F.col(conv).isNotNull()).select(a.alias("a"), b.alias("b"), F.struct(r.alias("r"), t.alias("t")).alias("v"))
    same = rows.groupBy("a", "b").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    return not same.where(F.col("least") != F.col("most")).isEmpty()


def _conversations(turns: DataFrame, seed: int) -> DataFrame:
    """Per conversation ``c``: own turns cut off (``h``), turns of the head (``k``) and the head itself, the affine map
    of its prefix sums (``m0``, ``o0`` and so on; ``ow`` for words), depth and fingerprint it ends with."""
    sums = [f"s{i}" for i in LANES]
    heads = turns.where(F.col("pos") < MOST_HEAD).groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words", *sums, "w"))).alias("heads"))
    last = F.max(F.struct("pos", *sums, "w"))
    own = turns.groupBy("c").agg(last.alias("end")).join(heads, "c")
    h = (F.crc32(F.col("c").cast("string")) % MOST_HEAD).cast("int")
    own = own.select("c", "end", F.col("heads").alias("own"), h.alias("h"), (F.col("c") - F.col("c") % GROUP).alias("base"))
    both = own.join(heads.select(F.col("c").alias("base"), "heads"), "base", "left")
    k = F.least(F.col("h"), F.coalesce(F.size("heads"), F.lit(0)))
    both = both.withColumn("k", F.when(F.col("heads").isNull(), 0).otherwise(k))

    def at(column: str, n: str, field: str) -> Column:
        """The sum over the first ``n`` turns; of none, or more than there are, it isn't used or zero."""
        return F.coalesce(F.get(column, F.col(n) - 1)[field], F.lit(0).cast("long"))

    maps, ends = [], []
    longer = F.col("end.pos") > F.col("h")
    for i, r in enumerate(bases(seed)):
        back = F.lit([pow(pow(r, -1, PRIME), j, PRIME) for j in range(MOST_HEAD)])
        m = F.get(back, F.col("h") - F.col("k")).cast("long")
        o = F.pmod(at("heads", "k", f"s{i}") - m * at("own", "h", f"s{i}") % PRIME, F.lit(PRIME))
        maps += [m.alias(f"m{i}"), o.alias(f"o{i}")]
        ends.append(F.when(longer, (o + m * F.col(f"end.s{i}")) % PRIME).otherwise(at("heads", "k", f"s{i}")))
    ow = at("heads", "k", "w") - at("own", "h", "w")
    x, y = _packed(ends)
    return both.select("c", "h", "k", F.slice("heads", F.lit(1), F.col("k")).alias("head"), *maps, ow.alias("ow"), x.alias("x"), y.alias("y"),
                       (F.col("k") + F.when(longer, F.col("end.pos") - F.col("h")).otherwise(0)).cast("long").alias("depth"),
                       F.when(longer, ow + F.col("end.w")).otherwise(at("heads", "k", "w")).alias("w"))


def _rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation ``c``: its key, last turn's hashes and words, all words (``w``), and
    the conversation's full depth."""
    zero = F.lit(0).cast("long")
    root = convs.select("c", F.col("depth").alias("full"), zero.alias("depth"), zero.alias("x"), zero.alias("y"),
                        zero.alias("a"), zero.alias("b"), zero.alias("words"), zero.alias("w"))
    head = convs.select("c", F.col("depth").alias("full"), F.explode("head").alias("e"))
    x, y = _packed([F.col(f"e.s{i}") for i in LANES])
    head = head.select("c", "full", F.col("e.pos").alias("depth"), x.alias("x"), y.alias("y"), "e.a", "e.b", "e.words", "e.w")
    own = turns.withColumnRenamed("w", "own_w").join(convs.drop("x", "y", "w", "head"), "c").where(F.col("pos") > F.col("h"))
    x, y = _packed([(F.col(f"o{i}") + F.col(f"m{i}") * F.col(f"s{i}")) % PRIME for i in LANES])
    own = own.select("c", F.col("depth").alias("full"), (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), x.alias("x"), y.alias("y"),
                     "a", "b", "words", (F.col("own_w") + F.col("ow")).alias("w"))
    return root.unionByName(head).unionByName(own)


def _ends(convs: DataFrame) -> DataFrame:
    """Per node where conversations end the SHA-256 of their ids, ascending and joined by commas."""
    order = [*KEY, "c"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids of a node as one row each, with its first id, ``CHUNK`` characters at most."""
        for batch in batches:
            rows: list[list] = []
            size = 0
            for d, x, y, c in zip(*(column.to_pylist() for column in batch.columns)):
                if rows and rows[-1][:3] == [d, x, y] and size < CHUNK:
                    rows[-1][4].append(str(c))
                else:
                    rows.append([d, x, y, c, [str(c)]])
                    size = 0
                size += len(rows[-1][4][-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)), pa.array([",".join(r[4]) for r in rows], pa.string())],
                [*KEY, "c", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def out(rows):
            return pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)),
                                               pa.array([r[1] for r in rows], pa.string())], [*KEY, "ends"])

        for batch in batches:
            done = []
            for *key, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if key == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            yield out(done)
        if node is not None:
            yield out([(node, sha.hexdigest())])

    kind = "depth bigint, x bigint, y bigint"
    chunks = convs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, f"{kind}, c bigint, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(digest, f"{kind}, ends string")


def prefix_trie(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: smallest member, depth, the parent's smallest member, members, children, leaves and saved
    tokens of its subtree, digest of the members that end in it; also its fingerprint (``x``, ``y``)."""
    for seed in SEEDS:
        turns = materialise(stored_turns(df, conv, turn, role, text, seed))
        convs = materialise(_conversations(turns, seed))
        rows = materialise(_rebuilt(turns, convs))
        nodes = materialise(rows.groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.max("full").alias("deepest"),
            F.min("a").alias("a"), F.max("a").alias("a_1"), F.min("b").alias("b"), F.max("b").alias("b_1"),
            F.min("words").alias("words"), F.min("w").alias("w")))
        mixed = nodes.where((F.col("a") != F.col("a_1")) | (F.col("b") != F.col("b_1")))
        if mixed.isEmpty() and not turns_differ(df, conv, role, text, seed):
            break
    else:
        raise RuntimeError("different turns agree in the hashes of every seed")
    roots = bases(seed)

    @F.arrow_udf("struct<x: bigint, y: bigint>")
    def before(depth: pa.Array, a: pa.Array, b: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        d = pa.array(np.maximum(depth.to_numpy(zero_copy_only=False) - 1, 0))
        x, y = (c.to_numpy(zero_copy_only=False) for c in (x, y))
        s = [(v - t) % PRIME for v, t in zip((x & PRIME, x >> 31, y & PRIME, y >> 31), _terms(d, a, b, roots))]
        return pa.StructArray.from_arrays([pa.array(s[0] | s[1] << 31), pa.array(s[2] | s[3] << 31)], ["x", "y"])

    owned = nodes.groupBy(F.col("conv_id").alias("c")).agg(
        F.min("depth").alias("from"), F.max(F.col("deepest") == F.col("depth")).alias("leaf"),
        F.min_by(F.col("w") - F.col("words"), "depth").alias("until"))
    spared = convs.select("c", F.col("w").alias("all"), "depth").join(owned, "c", "left").select(
        "c", F.coalesce("from", F.col("depth") + 1).alias("from"), F.coalesce("until", "all").alias("until"),
        F.coalesce(F.col("leaf"), F.lit(False)).cast("long").alias("leaf"))
    saved = F.when(F.col("depth") < F.col("from"), F.col("until") - F.col("w") + F.col("words")).otherwise(0)
    subtree = rows.select("c", *KEY, "w", "words").join(spared, "c").groupBy(*KEY).agg(
        F.sum(saved).cast("long").alias("saved_tokens"), F.sum("leaf").cast("long").alias("n_leaves"))
    kids = materialise(nodes.where("depth > 0").select(*KEY, "conv_id", "n_convs", before("depth", "a", "b", "x", "y").alias("p")).select(
        *KEY, "conv_id", "n_convs", (F.col("depth") - 1).alias("pd"), F.col("p.x").alias("px"), F.col("p.y").alias("py")))
    counts = kids.groupBy(F.col("pd").alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("depth").alias("pd"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(None).cast("long")
    upper = nodes.where("depth = 0").select(*KEY, "conv_id", "n_convs", none.alias("parent_conv_id"))
    whole = upper.unionByName(kids.join(above, ["pd", "px", "py"]).select(*KEY, "conv_id", "n_convs", "parent_conv_id"))
    out = whole.join(subtree, KEY).join(counts, KEY, "left").join(_ends(convs), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                      "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "x", "y")
