"""The order of the mix is part of the pipeline's result."""

import random

import corpus_pipeline
from demandgrid.llm.queries import OTHER_WEIGHT, RECIPE

BLOCK = 65_536


def test_prefixes_of_reread_files_keep_the_weights(spark, tmp_path):
    rng, rows = random.Random(2), []
    for source, n in (("src0", 500), ("src5", 300), ("elsewhere", 400)):
        rows += [(len(rows) + i, " ".join(rng.choices(["tree", "stone", "river"], k=500)), source) for i in range(n)]
    size = {k: len(t.encode()) for k, t, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    corpus_pipeline.encode(spark, docs, "").write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("slot", "offset").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(size)
    weights = {"src0": RECIPE["src0"], "src5": RECIPE["src5"], "elsewhere": OTHER_WEIGHT}
    done, whole, first_end = dict.fromkeys(weights, 0), sum(weights.values()), min(
        sum(size[k] for k, _, s in rows if s == x) * sum(weights.values()) // w for x, w in weights.items())
    last, seen = 0, 0
    for r in out:
        if r["slot"] != last:
            last = r["slot"]
            if last * BLOCK > first_end - whole * BLOCK:
                break
            seen += 1
            for s, w in weights.items():  # a block more or less, and the text that runs over its end
                assert abs(done[s] - last * BLOCK * w / whole) < BLOCK + max(size.values())
        done[r["source"]] += size[r["doc_id"]]
    assert seen > 10
