"""Filter interaction audit by radix text tries (operator 13).

Five filters judge every text: A too few words, B too few different words, C too many capitals, D a banned symbol, E a
copy of a text with a smaller key.  A to D look at the text alone.  For E the texts are dealt out by ranges of prefixes
that adapt to the corpus: boundaries are the shortest prefixes that tell neighbours of a sorted sample apart, so a
passage many texts begin with gets longer ones.  Each range comes sorted into a task, which inserts the full texts into a
compressed trie; its terminals hold the smallest key seen.  As the input is sorted, finished branches are traversed and
dropped whenever the trie has grown to ``TRIE_BYTES``, so memory doesn't depend on the size of a range.  A document
fails E unless it is the one named by its text's terminal.

What moves: copies are collapsed per task before the exchange, so a text that a third of all rows share is sent once a
task; then 20 bytes and the part per document, for the joins with the terminals and the labels.  Masks of failed filters
are counted before the orders are played through, on 32 masks a part.

Defined results: a null text is an empty one, a null part the empty string.  A null key is never smaller or larger than
another, so it never fails E, and has no label.  Rows that agree in key and text don't fail E for each other.  A label is
set if any row of the key has it.  An empty table gives no rows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CAPITALS, BANNED = bytes(range(65, 91)), b"#$%&*|"
CELL_BYTES = 32 << 20      # of texts for each range of prefixes
MOST_CELLS = 10_000        # ranges, which are sorted by spilling; the boundaries go to every task
SAMPLED = 16               # texts of the sample for each range
LONGEST_BOUNDARY = 4_096   # bytes; ranges that only longer prefixes tell apart stay together
TRIE_BYTES = 32 << 20
REMEMBERED = 1 << 20       # texts a task knows to have sent


@dataclass(frozen=True)
class Limits:
    """Thresholds of A to C: least words, least different words and most capitals in hundredths."""

    words: int = 200
    different: int = 50
    capitals: int = 3


def failed(raw: bytes, n_chars: int, limits: Limits = Limits()) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(words) < limits.words) | (100 * len(set(words)) < limits.different * len(words)) << 1
            | (100 * capitals > limits.capitals * n_chars) << 2 | (len(raw.translate(None, BANNED)) < len(raw)) << 3)


def _digest(raw: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(raw, 42), "big", signed=True)


def _same(a: bytes, b: bytes, at: int) -> int:
    """How many bytes from ``at`` on of ``a`` are those at the start of ``b``."""
    low, high = 0, min(len(a) - at, len(b))
    step = 16
    while low < high:   # galloping, then halving: whole slices are compared
        end = min(high, low + step)
        if a[at + low:at + end] == b[low:end]:
            low, step = end, step * 4
        else:
            high = end - 1
            step = max(1, (high - low + 1) // 2)
    return low


class Trie:
    """Compressed trie over byte strings; an edge is a run of bytes, a terminal holds the smallest key inserted."""

    __slots__ = ("root", "size")

    def __init__(self):
        self.root, self.size = [b"", None, {}], 0   # run, smallest key (None: no terminal), children by first byte

    def insert(self, text: bytes, key) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[2].get(text[at])
            if child is None:
                child = node[2][text[at]] = [text[at:], None, {}]
                self.size += len(text) - at + 200
                node, at = child, len(text)
                break
            n = _same(text, child[0], at)
            if n < len(child[0]):
                upper = [child[0][:n], None, {child[0][n]: child}]
                child[0] = child[0][n:]
                node[2][text[at]] = child = upper
            node, at = child, at + n
        if node[1] is None or key < node[1]:
            node[1] = key

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """Texts with their smallest keys."""
        todo = [(b"", self.root)]
        while todo:
            head, (run, least, children) = todo.pop()
            text = head + run
            if least is not None:
                yield text, least
            todo.extend((text, c) for c in children.values())


def _raw(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def boundaries(texts: DataFrame, cells: int, step: int) -> list[bytes]:
    """Prefixes, ascending, that cut the texts (binary column ``t``) into ranges of about equal bytes, from every
    ``step``-th different text by hash.  They steer the work; results don't depend on them."""

    @F.arrow_udf("binary")
    def shortest(before: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([y[:_same(y, x, 0) + 1] for x, y in zip(before.to_pylist(), texts.to_pylist())], pa.binary())

    some = texts.where(F.pmod(F.xxhash64("t"), F.lit(step)) == 0).groupBy("t").agg(F.octet_length("t").alias("n"))
    up_to = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)   # SAMPLED * cells rows, whatever the data
    placed = some.select("t", F.lag("t").over(Window.orderBy("t")).alias("before"),
                         F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("sum"),
                         F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)).alias("all"))
    cell = F.floor(F.col("sum") * cells / F.col("all"))
    cut = placed.withColumn("cell", cell).withColumn("last", F.lag("cell").over(Window.orderBy("t")))
    found = cut.where(F.col("cell") > F.col("last")).select(shortest("before", "t").alias("p"))
    return sorted({bytes(r["p"]) for r in found.where(F.octet_length("p") <= LONGEST_BOUNDARY).collect()})


def first_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``digest``): the smallest key of every different text and the digest of that text."""
    spark, kind = df.sparkSession, df.schema[key].dataType
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), _raw(F.col(text)).alias("t"))
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(1, min(MOST_CELLS, max(least, -(-size["b"] // CELL_BYTES))))
    cuts = boundaries(texts, cells, max(1, size["n"] // (SAMPLED * cells)))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text and batch, with its range; nothing for a text sent before with a key as small."""
        sent: dict[bytes, object] = {}
        for batch in batches:
            smallest: dict[bytes, object] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t not in smallest or k < smallest[t]:
                    smallest[t] = k
            rows = []
            for t, k in smallest.items():
                d = xxhash.xxh3_128_digest(t)
                if d not in sent or k < sent[d]:
                    sent[d] = k
                    rows.append((bisect_right(cuts, t), k, t))
            if len(sent) > REMEMBERED:
                sent.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], batch.schema.field(0).type),
                 pa.array([r[2] for r in rows], pa.binary())], ["cell", "k", "t"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, held = Trie(), None, None

        def finished() -> pa.RecordBatch:
            rows = [(k, _digest(t)) for t, k in trie.terminals()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], held), pa.array([r[1] for r in rows], pa.int64())],
                                              ["k", "digest"])

        for batch in batches:
            held = batch.schema.field(1).type
            for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if trie.size > TRIE_BYTES and t != last:
                    yield finished()   # no later text is one of these, as the texts ascend
                    trie = Trie()
                trie.insert(t, k)
                last = t
        if held is not None:
            yield finished()

    sent = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("k", kind), T.StructField("t", T.BinaryType())])
    out = T.StructType([T.StructField("k", kind), T.StructField("digest", T.LongType())])
    dealt = texts.mapInArrow(collapse, sent).repartitionById(len(cuts) + 1, "cell").sortWithinPartitions("cell", "t")
    return dealt.mapInArrow(grow, out).withColumnRenamed("k", key)


def verdicts(df: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """(``key``, ``part``, ``mask``) of every row: the bits of the filters it fails."""

    @F.arrow_udf("struct<mask: int, digest: bigint>")
    def judge(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        raw, chars = texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist()
        return pa.StructArray.from_arrays([pa.array([failed(t, n, limits) for t, n in zip(raw, chars)], pa.int32()),
                                           pa.array([_digest(t) for t in raw], pa.int64())], ["mask", "digest"])

    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), judge(F.col(text)).alias("j"))
    rows = rows.select("k", "part", "j.mask", "j.digest")
    first = first_keys(df, key, text).select(F.col(key).alias("fk"), F.col("digest").alias("fd"))
    found = rows.join(first, (F.col("k") == F.col("fk")) & (F.col("digest") == F.col("fd")), "left")
    copy = F.col("k").isNotNull() & F.col("fk").isNull()
    return found.select(F.col("k").alias(key), "part", F.col("mask").bitwiseOR(F.when(copy, COPY).otherwise(0)).alias("mask"))


def _steps() -> list[tuple[str, int, int, int]]:
    """Of every order and step: the order, the step, the bits of the filters before and of its own filter."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for i, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append((order, i, before, bit))
            before |= bit
    return out


def audit(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang",
          limits: Limits = Limits()) -> DataFrame:
    """Per part, order of the filters and step: documents kept, removed, redundantly failing, failing this filter
    only, removed good and toxic ones, and the filter's removals over all orders (``shapley``)."""
    known = (labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("lk"))
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    rows = verdicts(df, key=key, text=text, part=part, limits=limits)
    rows = rows.join(known, rows[key] == F.col("lk"), "left")
    counted = rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"),
        F.count(F.when(F.col("toxic"), 1)).alias("toxic"))
    orders = _steps()
    table = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"f":{f}}}' for o, s, b, f in orders) + "]"),
                        "array<struct<o: string, s: int, b: int, f: int>>")
    played = counted.select("*", F.explode(table).alias("x"))
    before, own = F.col("mask").bitwiseAND(F.col("x.b")) != 0, F.col("mask").bitwiseAND(F.col("x.f")) != 0

    def of(when: Column, n: Column) -> Column:
        return F.sum(F.when(when, n).otherwise(F.lit(0).cast("long"))).cast("long")

    n, whole = F.col("n"), len(set(o for o, *_ in orders))
    return played.groupBy("part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step")).agg(
        of(~before & ~own, n).alias("kept"), of(~before & own, n).alias("removed"), of(before & own, n).alias("redundant"),
        of(F.col("mask") == F.col("x.f"), n).alias("unique_fails"), of(~before & own, F.col("good")).alias("good_lost"),
        of(~before & own, F.col("toxic")).alias("toxic_lost"),
        # of the orders, one in as many as it fails has this filter meet the document first
        of(own, F.expr(f"n * ({whole} div bit_count(mask))")).alias("shapley"))
