import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          # names that the operators use inside
          "row string, label string, k string, h string, g string, fp string, shard string, slot string, position string, "
          "n_words string, m string, t string, ids string, u string, v string, clean string, n bigint, i string")
WORDS = {"en": "the of and to in is that for it was on with as by tree house water green river stone".split(),
         "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein haus baum".split(),
         "fr": "le la les de et des un une est que dans en pour qui sur pas maison arbre eau rivière".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def docs(spark):
    """Small corpus with nulls in every column, empty and long texts, ties, repeats and clashing column names."""
    rng = random.Random(5)
    rows, clash = [], tuple("x" * 16) + (None, "x")
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        text = "\n".join(prose(rng, lang, rng.randint(5, 30)) for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            text = "Home | About | Contact\n" + text
        rows.append((i, text, lang, f"src{i % 2}", len(text)))
    rows += [(100 + i, rows[3][1], "en", "src0", 1) for i in range(30)]           # copies
    rows += [(3, rows[3][1], "en", "src1", None)] * 2                              # repeated rows
    rows += [(200, None, "en", "src0", None), (201, "", None, None, 0), (None, "no key at all", "en", None, 3),
             (None, None, None, None, None), (202, " \t\n\r\v\f ", "de", "src1", 5), (203, "1234 !!", "fr", "src1", 7),
             (204, "x" * 30_000, "en", "src0", 30_000), (205, "one two", "en", "other", 7),
             (206, prose(rng, "en", 20_000), "en", "src0", None), (207, "日本語 😀 é̀ x", "en", "src0", 9)]
    return spark.createDataFrame([r + clash for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def pick(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
