"""Operators over many rows: mixing, line dedup, sharding, nearest vectors, SimHash, and the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from demandgrid.llm import lines, mixing, neighbours, sharding, simhash
from demandgrid.llm.base import spread_rank

from .conftest import pick

BLANK = " \t\n\v\f\r"


# ------------------------------------------------------------------ mixing

@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 60, "b": 25, "c": 14, "d": 1}, {"x": 7, "y": 7}])
def test_period_keeps_everyone_within_a_block(weights):
    slots, whole, seen = mixing.one_period(weights), sum(weights.values()), Counter()
    assert Counter(s for s, _ in slots) == weights
    for t, (s, k) in enumerate(slots, 1):
        assert k == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] * whole - w * t) < whole for x, w in weights.items())


def test_phases_use_every_block_once():
    rng = random.Random(4)
    for _ in range(30):
        weights = {s: rng.randint(1, 9) for s in "abcd"}
        blocks = {s: rng.randint(1, 60) for s in "abcd" if rng.random() < 0.8}
        plan, used, slot = mixing.phases(weights, blocks), Counter(), 0
        for i, p in enumerate(plan):
            assert p.slot == slot and all(p.begun[s] == used[s] for s in blocks)
            end = plan[i + 1].slot if i + 1 < len(plan) else sum(blocks.values())
            for t in range(end - slot):
                used[p.slots[t % len(p.slots)][0]] += 1
            slot = end
        assert used == Counter(blocks)


def test_mix(docs, none):
    recipe = {"src0": 3, "src1": 2}
    out = pick(mixing.mix(docs, recipe, other=1, block_bytes=200), "doc_id", "pool", "block", "slot", "offset")
    assert Counter(r[0] for r in out) == Counter(k for (k,) in pick(docs, "doc_id"))
    assert {r[1] for r in out} == {"src0", "src1", "other"}
    slot_of = {}
    for _, pool, block, slot, offset in out:
        assert offset // 200 == block and slot_of.setdefault((pool, block), slot) == slot
    assert len(set(slot_of.values())) == len(slot_of)
    sizes = defaultdict(int)
    for k, source, text in pick(docs, "doc_id", "source", "text"):
        sizes[source if source in recipe else "other"] += len((text or "").encode())
    plan = mixing.phases({**recipe, "other": 1}, {p: n // 200 + 1 for p, n in sizes.items()})
    begun, slot, order = Counter(), 0, {}
    for i, p in enumerate(plan):
        end = plan[i + 1].slot if i + 1 < len(plan) else 10 ** 6
        for t in range(min(end - slot, 3_000)):
            s = p.slots[t % len(p.slots)][0]
            order[s, begun[s]] = slot + t
            begun[s] += 1
        slot = end
    assert all(order[k] == v for k, v in slot_of.items())
    assert mixing.mix(none, recipe).count() == 0


def test_mixed_order_keeps_rows(docs, none):
    out = mixing.in_mixed_order(docs, {"src0": 3, "src1": 2}, block_bytes=200)
    assert out.schema == docs.schema and Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))
    slots = {r["doc_id"]: r["slot"] for r in mixing.mix(docs, {"src0": 3, "src1": 2}, block_bytes=200).collect() if r["doc_id"] not in (3, None)}
    got = [slots[k] for (k,) in pick(out, "doc_id") if k in slots]
    assert got == sorted(got)
    assert mixing.in_mixed_order(none, {"a": 1}).count() == 0


def test_spread_rank(spark):
    df = spark.range(3_000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 7).alias("n"))
    for size in (None, "n"):
        sums = defaultdict(int)
        for g, h, n, p in sorted(pick(spread_rank(df, ["g"], ["h"], size=size), "g", "h", "n", "position")):
            assert p == sums[g]
            sums[g] += n if size else 1


# ------------------------------------------------------------------ line dedup

def deduped(rows, ratio, least):
    pages = {(h, t) for h, t in rows if t is not None}
    whole, n = Counter(h for h, _ in pages), Counter()
    for h, t in pages:
        n.update({(h, x) for x in t.split("\n") if x.strip(BLANK)})
    bad = {k for k, c in n.items() if c >= least and c > ratio * whole[k[0]]}
    return [(h, t, None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for h, t in rows]


def test_line_dedup_equals_loops(docs, none):
    rows = [r for r in pick(docs, "source", "text")]
    want = Counter(deduped(rows, 0.1, 5))
    out = lines.drop_boilerplate(docs, ratio=0.1, min_pages=5)
    assert Counter(pick(out.select("row.source", "row.text", "clean"), "source", "text", "clean")) == want
    assert any(t != c for _, t, c in want)
    for text, clean, n, dropped in pick(out.select("row.text", "clean", "n_lines", "n_dropped"), "text", "clean", "n_lines", "n_dropped"):
        assert n == (len(text.split("\n")) if text is not None else 0)
        assert dropped == 0 if text is None else n - dropped in (len(clean.split("\n")), 0)
    assert lines.drop_boilerplate(none).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_copies_are_no_boilerplate(spark):
    rows = [(i, "copied line\nand another", "h") for i in range(50)] + [(100 + i, f"own line {i}", "h") for i in range(50)]
    out = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    assert out.agg(F.sum("n_dropped")).first()[0] == 0


# ------------------------------------------------------------------ sharding

def test_shards(docs, none):
    out = sharding.shard(docs, n_shards=4).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"]) for r in out) == texts
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == {0, 1, 2, 3}
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    assert sharding.shard(none).count() == 0


def test_links_stay_together(spark):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randint(0, 400)}") for i in range(1_200)] + [(5_000 + i, "hot") for i in range(600)]
    rows += [(9_000 + i, f"single {i}") for i in range(800)]
    out = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(rows, "doc_id int, text string"), n_shards=8).collect()}
    assert max(Counter(out.values()).values()) - min(Counter(out.values()).values()) <= 1
    spread = defaultdict(set)
    for k, t in rows:
        spread[t].add(out[k])
    small = [t for t in spread if t.startswith("text")]
    assert sum(len(spread[t]) == 1 for t in small) >= 0.9 * len(small)
    held = Counter(out[k] for k, t in rows if t == "hot")
    assert sum(n for _, n in held.most_common(3)) > 0.8 * 600  # three shards hold 975 rows


# ------------------------------------------------------------------ nearest vectors

def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted(((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_few_vectors_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60 + i, rows[3][1]) for i in range(30)]                 # ties
    odd = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [float("inf")] + [1.0] * 7), (None, rows[1][1]), (204, []),
           (205, [1.0, None] + [1.0] * 6), (206, [1.0, 2.0, 3.0]), rows[0], rows[3]]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0 or vec_id = 206"), k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert set(got) == set(want)                                      # 206 is alone with its length
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-14, atol=0)
    empty = df.where("false")
    assert neighbours.nearest(empty, df).count() == neighbours.nearest(df, empty).count() == 0


@pytest.mark.parametrize("lengths", ["equal", "mixed"])
def test_recall(spark, lengths):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6_000, 32)).astype(np.float32)
    if lengths == "mixed":
        vectors *= rng.uniform(0.5, 2, size=(6_000, 1)).astype(np.float32)
    old, neighbours.BLOCK = neighbours.BLOCK, 2_500
    try:
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").repartition(4)
        got = defaultdict(set)
        for q, i in pick(neighbours.nearest(df, df.where("vec_id % 100 = 0")), "query_id", "vec_id"):
            got[q].add(i)
    finally:
        neighbours.BLOCK = old
    scores = vectors[::100].astype(float) @ vectors.T.astype(float)
    hits = 0
    for j, q in enumerate(range(0, 6_000, 100)):
        scores[j, q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores[j])[:20].tolist()))
    assert hits / (60 * 20) >= 0.9


# ------------------------------------------------------------------ SimHash

def plain_print(text, shingle):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANK:
        words = words.replace(b, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius):
    keys, parent = list(prints), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(keys):
        find(a)
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= radius:
                parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("shingle", [3, 5])
def test_fingerprints_and_classes(docs, none, shingle):
    rows = pick(simhash.near_duplicates(docs, shingle=shingle, extra={"body": F.col("text")}), "doc_id", "body", "fp", "component_id")
    assert Counter((r[0], r[1]) for r in rows) == Counter(pick(docs, "doc_id", "text"))
    least, prints = {}, {r[2] % 2 ** 64 for r in rows}
    roots = classes(prints, 2)
    for k, text, fp, _ in rows:
        assert fp % 2 ** 64 == plain_print(text, shingle)
        if k is not None:
            root = roots[fp % 2 ** 64]
            least[root] = min(least.get(root, k), k)
    assert all(c == least.get(roots[fp % 2 ** 64]) for _, _, fp, c in rows)
    assert simhash.near_duplicates(none).count() == 0


def test_links_by_brute_force(spark):
    rng, prints = random.Random(8), set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):  # chains whose steps lie at and beyond the radius
            prints.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    roots = classes(prints, 2)
    signed = [(p - 2 ** 64 if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp bigint")
    found = {u % 2 ** 64: v % 2 ** 64 for u, v in pick(simhash.components(simhash.links(df)), "u", "v")}
    got, want = defaultdict(set), defaultdict(set)
    for p in prints:
        got[found.get(p, p)].add(p)
        want[roots[p]].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    with pytest.raises(ValueError):
        simhash.links(df, radius=3)


def test_one_of_each_group_stays(docs, none):
    out = simhash.first_of_each(docs)
    assert out.schema == docs.schema
    near = set(pick(simhash.near_duplicates(docs), "root", "component_id"))
    assert Counter(k for (k,) in pick(out, "doc_id")) == Counter(c for _, c in near)
    assert simhash.first_of_each(none).count() == 0
    nameless = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert simhash.first_of_each(nameless).count() == len({r for (r,) in pick(simhash.near_duplicates(docs), "root")})


# ------------------------------------------------------------------ pipeline

def test_stages_take_odd_rows(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "byte_bpe":
            assert out.schema.names == docs.schema.names
        assert 0 < out.count() <= docs.count()
        assert stage(spark, none, "").count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in corpus_pipeline.identify_language(spark, raw, sf).collect()}
    gone = [r["text"] for r in raw.collect() if r["doc_id"] not in before]
    assert len(gone) <= 2 and all(len(t) < 50 for t in gone)  # a single odd word says little of its language
    out = corpus_pipeline.run(spark, sf).collect()
    assert all(r["round_trip"] and r["n_tokens"] * 4 == len(r["ids"]) for r in out)
    keys = [r["doc_id"] for r in out]
    assert len(set(keys)) == len(keys) and set(keys) <= set(before)
    clean = {}
    for k, (h, t, c) in zip(before, deduped([(r["source"], r["text"]) for r in before.values()], 0.1, 5)):
        clean[k] = plain_print(c, 3)
    roots, least = classes(set(clean.values()), 2), {}
    for k, p in clean.items():
        least[roots[p]] = min(least.get(roots[p], k), k)
    assert set(keys) == set(least.values())
