"""Near copies aren't boilerplate: their content survives line dedup, one copy survives near-dedup."""

import corpus_pipeline

from .conftest import pick


def test_group_of_near_copies_keeps_its_content(spark):
    shared = "\n".join(f"sentence {i} of the copied article about rivers and stones" for i in range(20))
    rows = [(i, f"{shared}\nsigned by reader {i}", "h", 0) for i in range(20)]
    rows += [(100 + i, "Home | About | Contact\n" + "\n".join(f"page {i} has line {j} of its own here" for j in range(8)), "h", 0)
             for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    out = corpus_pipeline.drop_common_lines(spark, df, "")
    texts = dict(pick(out, "doc_id", "text"))
    assert all(texts[i] == rows[i][1] for i in range(20))
    assert all("Home" not in texts[100 + i] for i in range(40))          # boilerplate still goes
    left = dict(pick(corpus_pipeline.drop_near_duplicates(spark, out, ""), "doc_id", "text"))
    assert [k for k in left if k < 100] == [0] and left[0] == rows[0][1]
