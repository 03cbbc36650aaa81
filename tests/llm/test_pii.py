"""Personal data: patterns against plain searches, messages against enumeration, labels that documents agree on."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.llm import pii, queries

from .conftest import pick

# as the contract has them
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = 0
                for i, d in enumerate(digits[::-1]):
                    total += d if i % 2 == 0 else sum(map(int, str(2 * d)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((kind, *m.span()))
    return out


def card(rng, n=16):
    digits = [rng.randrange(10) for _ in range(n - 1)]
    return "".join(map(str, digits)) + str(next(c for c in range(10) if pii.luhn("".join(map(str, digits)) + str(c))))


def phone(rng):
    return f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"


def test_patterns():
    rng = random.Random(1)
    pieces = ["@", ".", "a", "b-", "+", "1", "255", "256", "00", " ", "-", "(", ")", "é", "a@b.c", "1.2.3.4", "\n", "%", "😀", "٣"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(4_000)]
    texts += [f"x {card(rng)} {card(rng, 13)[:4]} +1 {phone(rng)}. {rng.randrange(300)}.1.2.{rng.randrange(300)}" for _ in range(200)]
    for t in texts:
        assert pii.base_spans(t)[0] == plain_spans(t), t


@pytest.mark.parametrize("run", ["a", "1", "@", "1.", "+1", "+1(", "a@", "a.", "1 ", "a@b.", "1-", "x@y.z "])
def test_time_follows_length(run):
    start = time.perf_counter()
    text = run * (400_000 // len(run))
    found, failed = pii.base_spans(text)
    if found:
        pii.tokens_of(text, found, failed)
    assert time.perf_counter() - start < 10


def test_messages_give_marginals():
    rng = np.random.default_rng(2)
    k = len(pii.LABELS)
    node, hidden, follow = rng.normal(size=(4, k)), rng.normal(size=(2, k)), rng.normal(size=(k, k))
    edges, members = np.array([[0, 1]]), np.array([[1, 0], [2, 0], [3, 1]])   # a tree, where messages are exact
    weight = np.zeros((k,) * 6)
    for x in itertools.product(range(k), repeat=6):
        s = sum(node[i, x[i]] for i in range(4)) + hidden[0, x[4]] + hidden[1, x[5]] + follow[x[0], x[1]]
        weight[x] = np.exp(s + 2.0 * sum(x[t] == x[4 + g] for t, g in members))
    got = pii.beliefs(node, edges, follow, members, hidden, 2.0)
    for i in range(4):
        p = weight.sum(axis=tuple(a for a in range(6) if a != i))
        assert np.allclose(got[i], p / p.sum(), atol=1e-3)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = "the of and river stone house call mail server from with card number people year".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, hints = [], {}
    for i in range(400):
        kind = i % 5
        if kind == 0:
            p = phone(rng)
            rows.append((i, f"{some(9)} +1 {p} {some(30)} {p} {some(5)}"))
            hints[i] = p
        elif kind == 1:
            name = f"jane.{rng.randrange(10, 99)}{rng.choice('abc')}"
            rows.append((i, f"{some(9)} {name}@mail.example.com {some(30)} {name} {some(5)}"))
            hints[i] = name
        elif kind == 2:
            rows.append((i, f"{some(9)} {card(rng)} {some(5)} {rng.randrange(10, 99)} {some(4)} {rng.randrange(256)}.1.2.3"))
        else:
            rows.append((i, f"{some(20)} {phone(rng)} in {rng.randrange(1900, 2000)} {some(9)}"))   # no pattern finds these
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), hints


def test_repeats_get_the_label_of_the_span(corpus):
    df, hints = corpus
    field = pii.fit(df)
    out = {r["doc_id"]: (r["text"], r["s"]) for r in df.select("doc_id", "text", pii.find_spans(df, field, F.col("text")).alias("s")).collect()}
    caught = 0
    for k, (text, spans) in out.items():
        assert [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]] == plain_spans(text)
        added = [(s["kind"], text[s["start"]:s["end"]]) for s in spans if not s["base"]]
        if k in hints:
            kind = "phone" if k % 5 == 0 else "email"
            caught += added == [(kind, hints[k])]
        else:
            assert not added, (text, added)
    assert caught >= 0.95 * len(hints)


def test_odd_rows(spark, docs, none):
    field = pii.fit(docs)
    out = docs.select("doc_id", "text", pii.find_spans(docs, field, F.col("text")).alias("s")).collect()
    assert len(out) == docs.count()
    for r in out:
        assert [tuple(s)[:3] for s in r["s"] if s["base"]] == plain_spans(r["text"] or "")
    empty = pii.fit(none)
    assert none.select(pii.find_spans(none, empty, F.col("text")).alias("s")).count() == 0
    # weights learned from nothing still let spans through
    assert pick(spark.createDataFrame([("a@b.c",)], "t string").select(pii.find_spans(docs, empty, F.col("t")).alias("s")), "s")[0][0][0]["kind"] == "email"


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(pick(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"))
    out = queries.op11_personal_data(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        base = plain_spans(texts[r["doc_id"]] or "")
        named = [f"{k}:{a}:{b}" for k, a, b in base]
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(k == x for x, _, _ in base) for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r["spans"].split(",")) or not named
        assert bool(r["spans"]) == bool(named) and r["n_added"] == (len(r["spans"].split(",")) if r["spans"] else 0) - len(named)
