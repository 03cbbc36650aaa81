"""Line dedup by site-relative frequency (operator 5), native expressions only.

A line's frequency is the number of a host's pages that contain it over all pages of the host.  Lines above the
ratio, on at least ``min_pages`` pages, are boilerplate and go from every page of that host.  Pages with equal text
count as one page, in both numbers, so a page copied a thousand times doesn't turn into boilerplate.

What moves: per page 16 bytes for each distinct line, pre-summed before the exchange; then the few boilerplate lines
of each host, whose number is at most (lines per page) / ratio, join the pages.  They are written first: up to
``MOST_BYTES`` of them are broadcast, and no page moves; more of them go to pages dealt by host and text, ``SPLIT`` tasks
for each host.  No page list is ever gathered.

Defined results: lines are cut at newlines and compared whole; lines without a character other than white space are
never dropped; a null text stays null with no lines; a null host is a host of its own; equal rows give equal rows;
a page made of boilerplate alone keeps an empty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.base import fingerprint128, let, materialise
from demandgrid.llm.quality import BLANKS


MOST_BYTES = 4 << 20   # of boilerplate fingerprints that are broadcast
SPLIT = 64             # shares of a host where they aren't


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(df: DataFrame, text: str, host: str, *, ratio: float, min_pages: int) -> DataFrame:
    """Per host (``h``) the fingerprints of its boilerplate lines (``marks``)."""
    pages = df.where(F.col(text).isNotNull()).select(F.col(host).alias("h"), F.col(text).alias("t"))
    keyed = pages.select("h", fingerprint128(F.col("t")).alias("page"), F.array_distinct(F.transform(
        F.filter(_lines(F.col("t")), lambda x: F.translate(x, BLANKS, "") != ""), lambda x: fingerprint128(x))).alias("lines"))
    # one row per different page; equal pages have equal lines, so any of them will do
    different = keyed.groupBy("h", "page").agg(F.first("lines").alias("lines"))
    # a null line stands for the page itself, so that one exchange counts pages and lines
    counts = (different.select("h", F.explode(F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")),
                                                       F.col("lines"))).alias("line"))
              .groupBy("h", "line").agg(F.count(F.lit(1)).alias("n")))
    often = counts.where(F.col("line").isNull() | (F.col("n") >= min_pages))
    whole = often.where(F.col("line").isNull()).select(F.col("h").alias("wh"), F.col("n").alias("pages"))
    return (often.where(F.col("line").isNotNull()).join(whole, F.col("h").eqNullSafe(F.col("wh")))
            .where(F.col("n") > ratio * F.col("pages"))
            .groupBy("h").agg(F.collect_list("line").alias("marks")))


def drop_boilerplate(df: DataFrame, *, text: str = "text", host: str = "source", ratio: float = 0.1,
                     min_pages: int = 5, most: float | None = None) -> DataFrame:
    """Whole rows as struct ``row``, the text without boilerplate (``clean``) and the numbers of lines before and
    after (``n_lines``, ``n_dropped``).

    ``most``: a page of which more than this share of the characters would go stays whole.  It is one of many near
    copies, whose shared lines are their content; near-duplicate removal leaves one of them."""
    marks = materialise(boilerplate(df, text, host, ratio=ratio, min_pages=min_pages))
    rows = df.select(F.struct("*").alias("row"), F.col(host).alias("rh"), F.col(text).alias("t"))
    size = marks.agg(F.coalesce(F.sum(F.size("marks") * 16 + F.coalesce(F.octet_length(F.col("h").cast("string")), F.lit(0)) + 64),
                                F.lit(0))).first()[0]
    same = F.col("rh").eqNullSafe(F.col("h"))
    if size <= MOST_BYTES:
        joined = rows.join(F.broadcast(marks), same, "left")
    else:
        shares = marks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("t"), F.lit(SPLIT)).cast("int"))
        joined = rows.join(shares, same & (F.col("part") == F.col("share")), "left")
    kept = F.when(F.col("marks").isNull(), _lines(F.col("t"))).otherwise(
        F.filter(_lines(F.col("t")), lambda x: ~F.array_contains(F.col("marks"), fingerprint128(x))
                 | (F.translate(x, BLANKS, "") == "")))
    if most is not None:
        length = F.char_length("t")
        kept = let(kept, lambda k: F.when(length - F.char_length(F.array_join(k, "\n")) > most * length, _lines(F.col("t")))
                   .otherwise(k))
    out = let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("clean"), F.size(k).alias("n")))
    n = F.when(F.col("t").isNotNull(), F.size(_lines(F.col("t")))).otherwise(0)
    joined = joined.select("row", n.cast("long").alias("n_lines"), F.when(F.col("t").isNotNull(), out).alias("o"))
    return joined.select("row", F.col("o.clean").alias("clean"), "n_lines",
                         F.coalesce(F.col("n_lines") - F.col("o.n"), F.lit(0)).cast("long").alias("n_dropped"))
