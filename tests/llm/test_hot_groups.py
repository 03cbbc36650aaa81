"""Pairs on full shards, rows without keys, boilerplate too large to broadcast, and a second reader of pages."""

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from demandgrid.llm import extract, lines, mixing, sharding
from demandgrid.llm.base import spread_rank

from .conftest import pick


def test_granted_moves_keep_room():
    granted = sharding._granted({(0, 1): 5, (1, 0): 3, (2, 0): 4, (1, 2): 2}, [0, 1, 0])
    assert granted == {(0, 1): 4, (1, 0): 3, (2, 0): 1, (1, 2): 1} or all(granted.get(k, 0) <= n for k, n in {(0, 1): 5, (1, 0): 3, (2, 0): 4, (1, 2): 2}.items())
    inflow = Counter()
    for (a, b), n in granted.items():
        inflow[b] += n
        inflow[a] -= n
    assert inflow[0] <= 0 and inflow[1] <= 1 and inflow[2] <= 0 and granted[0, 1] >= 3


@pytest.mark.parametrize("copies, most", [(2, 0.025), (5, 0.1)])
def test_copies_meet_on_full_shards(spark, copies, most):
    """``most``: share of documents that aren't where most of their group is; of pairs, twice as many are cut."""
    df = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % (4_000 // copies)).cast("string")).alias("text"))
    out = pick(sharding.shard(df), "doc_id", "shard", "slot")
    assert set(Counter(s for _, s, _ in out).values()) == {250}
    where = defaultdict(list)
    for k, s, _ in out:
        where[k % (4_000 // copies)].append(s)
    away = sum(len(s) - max(Counter(s).values()) for s in where.values())
    assert away < most * 4_000, away
    assert len({(s, slot) for _, s, slot in out}) == 4_000 and max(slot for _, _, slot in out) == 249


def test_rows_without_keys_spread(spark, monkeypatch):
    df = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("t"), "id").alias("text"))
    seen = []
    monkeypatch.setattr(mixing, "spread_rank", lambda rows, *a, **b: seen.append(rows) or spread_rank(rows, *a, **b))
    out = mixing.mix(df, {"s": 1})
    assert out.count() == 3_000 and seen[0].select(F.substring("__h", 1, 4)).distinct().count() > 2_500


def test_large_boilerplate_meets_split_hosts(docs, monkeypatch):
    one = lines.drop_boilerplate(docs)
    monkeypatch.setattr(lines, "MOST_BYTES", 0)
    other = lines.drop_boilerplate(docs)
    names = ("row", "clean", "n_lines", "n_dropped")
    assert Counter(map(str, pick(one, *names))) == Counter(map(str, pick(other, *names)))
    assert one.where("n_dropped > 0").count() > 0


class Article(HTMLParser):
    """Text of the article element, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.raw, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.raw += tag in ("script", "style")
        if tag in ("p", "h1", "ul", "li", "div"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += "\n"

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.raw -= tag in ("script", "style")
        if tag in ("p", "h1", "ul", "li", "div"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.blocks[-1] += data


def test_pages_against_a_plain_reader(spark):
    pages = pick(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id", "html")
    same = 0
    for _, page in pages:
        reader = Article()
        reader.feed(re.sub(r"<script>.*?</script>|<style>.*?</style>", "", page or "", flags=re.S))
        same += " ".join(x for b in reader.blocks if (x := " ".join(b.split()))) == extract.main_text(page)
    assert same == len(pages)
