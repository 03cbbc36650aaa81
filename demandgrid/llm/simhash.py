"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 10).

A text's fingerprint has a bit set where over half of its shingles' hashes have it.  Every different fingerprint emits
all variants within half the radius; two fingerprints within the radius share a variant, the one in the middle.  A
variant collects no more fingerprints than such a ball has members (65 for radius 2), whatever the number of copies,
and all of them lie within the radius of each other, so linking each to the smallest loses no component.

Components come from alternating star joins over links between different fingerprints, written out after each round;
only counts and a checksum reach the driver.

Defined results: words are runs of characters other than space and tab to carriage return, A to Z in lower case; fewer
than ``shingle`` words are one shingle, none (null and empty texts) give fingerprint 0, linked like any other.  The
class of a document is the smallest key in its component; null keys get a class but never name one unless the whole
component has none (null then)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.base import materialise

SEED = 42
CHUNK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[shingle - 1:] or [len(joined)]
    digest, seen = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:], ends[at:at + CHUNK])], "<u8")
        seen += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(seen * 2 > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """Fingerprints as signed longs."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return of(text)


def _masks(bits: int) -> list[int]:
    """All 64-bit masks with at most ``bits`` bits, as signed longs."""
    found, last = {0}, {0}
    for _ in range(bits):
        last = {m | 1 << i for m in last for i in range(64)}
        found |= last
    return sorted(m - (1 << 64) if m >> 63 else m for m in found)


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (u, v) of different fingerprints ``fp`` within the radius that connect what is connected; u > v."""
    if radius % 2:
        raise ValueError("the radius is even: its half is the size of the balls")
    ball = prints.select("fp", F.explode(F.transform(
        F.lit(_masks(radius // 2)), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    pairs = ball.select("fp", least.alias("v")).where(F.col("fp") != F.col("v"))
    return (pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= radius)
            .select(F.col("fp").alias("u"), "v").distinct())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, v): every node of the edges (u > v) but the smallest of its component, with that smallest one."""
    edges, before = materialise(edges), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        edges = materialise(small.distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges
        before = state
    raise RuntimeError(f"components not complete after {rounds} rounds")


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2,
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """Key, ``fp`` (signed long), ``root`` (smallest fingerprint of the component) and ``component_id``; ``extra`` adds
    columns of the input under new names."""
    extra = extra or {}
    docs = materialise(df.select(F.col(key).alias("k"), fingerprints(F.col(text), shingle).alias("fp"),
                                 *[c.alias(n) for n, c in extra.items()]))
    prints = materialise(docs.groupBy("fp").agg(F.min("k").alias("least")))
    root = components(links(prints.select("fp"), radius))
    rooted = prints.join(root, prints.fp == root.u, "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "root", "component_id")
    return docs.join(classes, "fp").select(F.col("k").alias(key), "fp", "root", "component_id", *extra)


def first_of_each(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component one row, with the smallest key (null keys last,
    then the smallest text hash), and of equal rows one."""
    h = F.xxhash64(F.col(text))
    near = near_duplicates(df, key=key, text=text, shingle=shingle, radius=radius, extra={"th": h})
    kept = (near.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("late"), F.col(key).alias("k"), "th")).alias("m"))
            .select(F.col("m.k").alias("kk"), F.col("m.th").alias("kth")))
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("rk"), h.alias("rth"))
    found = rows.join(kept, F.col("rk").eqNullSafe(F.col("kk")) & (F.col("rth") == F.col("kth")), "left_semi")
    one = Window.partitionBy("rk", "rth").orderBy("rk")
    return found.withColumn("i", F.row_number().over(one)).where(F.col("i") == 1).select("row.*")
