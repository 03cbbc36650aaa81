"""Sharding by balanced label propagation (operator 8).

Documents with equal text are linked.  They are dealt to the shards in the order of a hash.  Round by round each linked document asks
for the shard that holds most of its neighbours, at first among those with room, so that a group larger than a shard fills
one shard after another, and when nothing moves any more among all.  Of the documents that ask to go from one shard to
another as many may, the first by hash, as there is room for or as ask to come back, directly or round a circle of shards.
At the end documents without links, which no cut edge depends on, level the shards out: the numbers of rows of any two
shards differ by one at most (law ``rows``).

A group is known by its text's digest; per round it sends one row per task and shard (pre-summed), and the hot group's
documents are split by the adaptive join.  The driver sees one row per pair of shards.

Defined results: a null text is linked with the empty ones, its size is 1 and its CRC 0; a null key is hashed like an
empty one; equal rows take their slots in any order; fewer rows than shards leave the last shards empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.base import materialise, spread_rank

LAW = "rows"


def _granted(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the documents that ask to go from one shard to another may: shards exchange equal numbers in pairs,
    then round longer circles, and shards with room take in more, which leaves room where these come from."""
    out = {(a, b): min(n, wishes.get((b, a), 0)) for (a, b), n in wishes.items()}
    left = {k: n - out[k] for k, n in wishes.items() if n > out[k]}

    def circle() -> list[tuple[int, int]] | None:
        """Wishes that lead from a shard back to it."""
        done: set[int] = set()
        for start in sorted({a for a, _ in left}):
            path, on = [start], {start}
            while path:
                a = path[-1]
                b = next((y for x, y in sorted(left) if x == a and y not in done), None)
                if b is None:
                    done.add(path.pop())
                    on.discard(a)
                elif b in on:
                    nodes = [*path[path.index(b):], b]
                    return list(zip(nodes, nodes[1:]))
                else:
                    path.append(b)
                    on.add(b)
        return None

    while found := circle():
        n = min(left[k] for k in found)
        for k in found:
            out[k] += n
            left[k] -= n
            if not left[k]:
                del left[k]
    room, moved = list(room), True
    while moved:
        moved = False
        for a, b in sorted(left):
            more = min(left[a, b], room[b])
            if more > 0:
                out[a, b] += more
                left[a, b] -= more
                room[b] -= more
                room[a] += more
                moved = True
    return {k: n for k, n in out.items() if n}


def _moved(linked: DataFrame, counts: dict[int, int], quota: list[int], turn: int,
           exchange: bool) -> tuple[DataFrame, int]:
    """One round: the documents with new labels, and how many moved.  At first shards with room are asked for, then any."""
    room = [q - counts.get(s, 0) for s, q in enumerate(quota)]
    open_ = [s for s, r in enumerate(room) if exchange or r > 0]
    if not open_:
        return linked, 0
    cells = linked.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    # ties fall another way every round: a document whose wish met no counterpart waits for its neighbour's
    # a shard that a group fills takes no more of it, so that its others gather in the next one
    growing = (F.col("n") < quota[-1]) & F.col("label").isin(open_)
    groups = cells.groupBy("g").agg(  # a cell per shard at most
        F.collect_list(F.struct("label", "n")).alias("cells"),
        F.max(F.when(growing, F.struct("n", F.xxhash64("g", "label", F.lit(turn)).alias("tie"), "label"))).alias("best"))
    own = F.filter("cells", lambda c: c["label"] == F.col("label"))[0]["n"]
    asked = linked.join(groups, "g").withColumn(
        "to", F.when((F.col("best.n") >= own) & (own < quota[-1]), F.col("best.label")).otherwise(F.col("label"))).drop("cells", "best")
    asked = materialise(asked)
    wishes = {(r["label"], r["to"]): r["n"] for r in asked.where(F.col("to") != F.col("label")).groupBy("label", "to")
              .agg(F.count(F.lit(1)).alias("n")).collect()}   # a row per pair of shards
    granted = _granted(wishes, room)
    if not granted:
        return asked.drop("to"), 0
    may = F.create_map(*[x for (a, b), n in granted.items() for x in (F.lit(a * len(quota) + b), F.lit(n))])
    # members of groups larger than a shard ask last
    ranked = spread_rank(asked.where(F.col("to") != F.col("label")), ["label", "to"], ["h"])
    goes = F.col("position") < F.coalesce(F.try_element_at(may, F.col("label") * len(quota) + F.col("to")), F.lit(0))
    ranked = ranked.withColumn("label", F.when(goes, F.col("to")).otherwise(F.col("label"))).drop("position", "to")
    stay = asked.where(F.col("to") == F.col("label")).drop("to")
    return stay.unionByName(ranked), sum(granted.values())


def shard(df: DataFrame, *, key: str = "doc_id", text: str = "text", n_shards: int = 16, rounds: int = 20) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard (null, as this law deals anew when a shard is added)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(df.select(
        F.col(key).alias("k"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("crc"),
        F.md5(t).alias("g"), F.md5(F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(t))).alias("h")))
    groups = materialise(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    # members of groups larger than a shard, which are cut anyway, come last: a full shard gives those away first
    late = F.concat(F.when(F.col("n") > quota[-1], "f").otherwise("0"), F.col("h"))
    linked = rows.join(groups, "g").select("k", "size", "crc", "g", late.alias("h"), F.lit(0).alias("one"))
    dealt = (F.col("position") % n_shards).cast("int")
    linked = materialise(spread_rank(linked, ["one"], ["h"]).select("k", "size", "crc", "g", "h", dealt.alias("label")))

    def load() -> dict[int, int]:
        return {r["label"]: r["n"] for r in linked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    exchange = False
    for turn in range(rounds):
        linked, n = _moved(linked, load(), quota, turn, exchange)
        linked = materialise(linked)
        if not n and exchange:
            break
        exchange |= not n
    stay = [min(load().get(s, 0), q) for s, q in enumerate(quota)] if total else quota
    placed = spread_rank(linked, ["label"], ["h"])
    fits = F.lit(False)
    for s, n in enumerate(stay):
        fits = F.when(F.col("label") == s, F.col("position") < n).otherwise(fits)
    placed = placed.withColumn("fits", fits)
    single = rows.join(groups, "g", "left_anti").select("k", "size", "crc", "h")
    rest = single.unionByName(placed.where(~F.col("fits")).select("k", "size", "crc", "h"))
    rest = spread_rank(rest.withColumn("one", F.lit(0)), ["one"], ["h"])
    to, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s, n in enumerate(stay):
        end = begin + quota[s] - n
        inside = (F.col("position") >= begin) & (F.col("position") < end)
        to = F.when(inside, s).otherwise(to)
        slot = F.when(inside, F.col("position") - begin + n).otherwise(slot)
        begin = end
    out = placed.where("fits").select("k", "size", "crc", F.col("label").alias("shard"), F.col("position").alias("slot"))
    out = out.unionByName(rest.select("k", "size", "crc", to.alias("shard"), slot.alias("slot")))
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard",
                      "slot", F.lit(None).cast("int").alias("grown_shard"))
