"""Filter interaction audit against plain loops over all orders and documents."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from demandgrid.llm import filter_audit
from demandgrid.llm.filter_audit import Trie

from .conftest import pick


def plain_mask(text, limits):
    words = text.encode().split()
    return "".join(name for name, bad in zip("ABCD", (
        len(words) < limits.words, 100 * len(set(words)) < limits.different * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > limits.capitals * len(text), any(c in "#$%&*|" for c in text))) if bad)


def plain_audit(rows, labels, limits):
    """rows: (key, text, part); labels: (key, quality, toxic)."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    out = defaultdict(Counter)
    judged = []
    for k, text, part in rows:
        fails = set(plain_mask(text or "", limits))
        if k is not None and any(j is not None and j < k and (t or "") == (text or "") for j, t, _ in rows):
            fails.add("E")
        judged.append((k, part or "", fails))
    parts = {p for _, p, _ in judged}
    shapley = Counter()
    for order in permutations("ABCDE"):
        for part in parts:
            for step in range(1, 6):
                out[part, "".join(order), step].update(dict.fromkeys(("kept", "removed", "redundant"), 0))
        for k, part, fails in judged:
            gone = False
            for step, name in enumerate(order, 1):
                c = out[part, "".join(order), step]
                here = name in fails and not gone
                c["removed"] += here
                c["redundant"] += name in fails and gone
                c["unique_fails"] += fails == {name}
                c["good_lost"] += here and k in good
                c["toxic_lost"] += here and k in toxic
                shapley[part, name] += here
                gone = gone or here
                c["kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {k: (*(c[n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_trie_keeps_the_smallest_key():
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(500)]
    texts += [b"x" * 5_000 + bytes([i % 7]) * (i % 90) for i in range(300)] + [b""]
    trie, least = Trie(), {}
    for t in texts:
        k = rng.randrange(1_000)
        trie.insert(t, k)
        least[t] = min(k, least.get(t, k))
    found = list(trie.terminals())
    assert dict(found) == least and len(found) == len(least)
    assert [filter_audit._same(b"ab" + x, y, 2) for x, y in [(b"", b"q"), (b"abc" * 99, b"abc" * 99), (b"a" * 70 + b"b", b"a" * 71)]] == [0, 297, 70]


@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_audit(spark, docs, none, monkeypatch, budget):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", budget)
    monkeypatch.setattr(filter_audit, "CELL_BYTES", 4_000)
    labels = spark.createDataFrame(
        [(k, (k or 0) % 2, (k or 0) % 3) for k in [*range(0, 60, 2), 3, 3, 100, 101, 200, 201, None, 999]] + [(4, None, 1), (4, 0, None)],
        "doc_id bigint, quality int, toxic int")
    limits = filter_audit.Limits(words=40, different=60, capitals=2)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    out = filter_audit.audit(docs, labels, limits=limits)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in out.collect()}
    assert got == plain_audit(pick(docs, "doc_id", "text", "lang"), pick(labels, "doc_id", "quality", "toxic"), limits)
    assert len({p for p, _, _ in got}) == 4 and any(v[6] for v in got.values())
    empty = filter_audit.audit(none, labels)
    assert empty.count() == 0 and empty.schema.names == out.schema.names


def test_verdicts_keep_every_row(docs):
    out = pick(filter_audit.verdicts(docs), "doc_id", "mask")
    assert Counter(k for k, _ in out) == Counter(k for (k,) in pick(docs, "doc_id"))
    copies = [m for k, m in out if k is not None and 100 <= k < 130]
    assert all(m & filter_audit.COPY for m in copies) and not any(m & filter_audit.COPY for k, m in out if k == 3)


def test_long_shared_beginnings_are_told_apart(spark):
    head = "licence " * 2_000
    rows = [(i, head + f"text {i % 150}") for i in range(300)] + [(1_000 + i, f"{i} other") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")).repartition(3)
    out = dict(pick(filter_audit.verdicts(df), "doc_id", "mask"))
    assert {k for k, m in out.items() if m & filter_audit.COPY} == set(range(150, 300))
