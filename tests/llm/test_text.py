"""Row-wise operators: quality rules, byte-level BPE, language ID, HTML, token counts."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandgrid.llm import bpe, extract, langid, quality, token_counts
from demandgrid.llm.queries import RANK_FILE, tokenizer

from .conftest import pick

PATH = public_tokenizers.path(RANK_FILE)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(PATH, "rb").read(), public_tokenizers.PATTERN)


# ------------------------------------------------------------------ quality

def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at, hit = defaultdict(list), set()
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    for places in at.values():
        if len(places) > 1:
            hit.update(p + d for p in places for d in range(3))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_quality_counts_equal_plain_loops(docs):
    out = quality.quality_verdicts(docs.withColumn("text", F.concat_ws("\n", "text", F.expr("substr(text, 1, 40)"))))
    texts = Counter(counted(t) for (t,) in pick(docs.select(F.concat_ws("\n", "text", F.expr("substr(text, 1, 40)")).alias("t")), "t"))
    got = Counter(pick(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == texts


@pytest.mark.parametrize("text,name", [
    ("the cat and " * 5, "too_short"), (" ".join(f"w{i}#*" for i in range(60)), "symbols"),
    ("THE CAT AND OF " * 30, "shouting"), (" ".join(f"word{i}" for i in range(90)), "few_stop_words"),
    ("same line of the text\n" * 20, "duplicate_lines"),
    ("\n".join(f"- the {i} of a point" for i in range(20)), "bullet_lines"),
    ("\n".join(f"the {i} of a point..." for i in range(20)), "ellipsis_lines")])
def test_rules_catch(spark, text, name):
    row = quality.quality_verdicts(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert name in row["failed"] and not row["kept"]


def test_quality_of_nothing(docs, none, spark):
    assert quality.quality_verdicts(none).count() == 0
    row = quality.quality_verdicts(docs.where("doc_id = 200")).first()
    assert (row["n_words"], row["n_symbols"], row["kept"], row["mean_word_length"]) == (0, 0, False, None)
    clean = " ".join(f"the house{i} of word{i} and tree{i}" for i in range(30))
    assert quality.quality_verdicts(spark.createDataFrame([(1, clean)], "doc_id int, text string")).first()["kept"]


def test_quality_is_native(docs):
    assert "Python" not in quality.quality_verdicts(docs)._jdf.queryExecution().toString()


# ------------------------------------------------------------------ BPE

@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85  a'sll1é日😀.,"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_equal_the_library(vocabulary, library, text):
    packed = vocabulary.encode([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert vocabulary.decode(packed) == text.encode()


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 40_000, " " * 30_000, "x  " * 9_000, "é" * 20_000])
def test_long_pretokens(vocabulary, library, text):
    assert np.frombuffer(vocabulary.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_one_queue_for_many_is_as_one_each(vocabulary):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abcdetion") for _ in range(rng.randint(1, 60))).encode() for _ in range(3_000)]
    many = vocabulary.merge_many(pieces)
    alone = [np.array(vocabulary.merge(p), "<u4").tobytes() for p in pieces]
    assert [m for m, p in zip(many, pieces) if p not in vocabulary.ranks] == [a for a, p in zip(alone, pieces) if p not in vocabulary.ranks]
    assert vocabulary.merge_many([]) == []


def test_caches_forget(library):
    v = bpe.Vocabulary(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    old, bpe.REMEMBERED = bpe.REMEMBERED, 50
    try:
        for i in range(5):
            text = " ".join(f"wrd{i}{j}" for j in range(100))
            assert np.frombuffer(v.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
        assert len(v.pieces) < 400
    finally:
        bpe.REMEMBERED = old


def test_segments_of_a_long_text(library):
    v, old = bpe.Vocabulary(open(PATH, "rb").read(), public_tokenizers.PATTERN), bpe.SEGMENT
    bpe.SEGMENT = 50
    try:
        text = "Some words,  two spaces\n \n and more of it " * 40
        assert np.frombuffer(v.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    finally:
        bpe.SEGMENT = old


def test_encode_decode_columns(spark, docs, none, library):
    t = tokenizer(spark)
    out = docs.select("text", t.encode(F.col("text")).alias("ids1"), t.encode_packed(F.col("text")).alias("ids2"))
    out = out.select("*", t.decode(F.col("ids1")).alias("d1"), t.decode_packed(F.col("ids2")).alias("d2"))
    for text, ids1, ids2, d1, d2 in pick(out, "text", "ids1", "ids2", "d1", "d2"):
        assert ids1 == library.encode_ordinary(text or "") == np.frombuffer(ids2, "<u4").tolist()
        assert bytes(d1) == bytes(d2) == (text or "").encode()
    assert none.select(t.encode(F.col("text"))).count() == 0
    with pytest.raises(Exception, match="99999999"):
        spark.range(1).select(t.decode(F.array(F.lit(99999999)))).collect()


def test_digest_query(spark, library):
    from demandgrid.llm.queries import op2_byte_bpe
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# ------------------------------------------------------------------ language ID

def test_language(docs, none):
    model = langid.fit(docs.where("doc_id < 30"))
    assert model.languages == ["de", "en", "fr"]
    got = {(r["doc_id"], r["text"]): r["p"] for r in docs.select("doc_id", "text", langid.predict(docs, model, F.col("text")).alias("p")).collect()}
    right = {(r["doc_id"], r["text"]): r["lang"] for r in docs.where("doc_id between 30 and 59").collect()}
    assert all(got[k]["lang_pred"] == lang and got[k]["score"] > 0.5 for k, lang in right.items())
    for (key, text), p in got.items():
        assert 0 <= p["score"] <= 1
        assert (p["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")), (key, text)


def test_unknown_words_fall_back(spark):
    rows = [(i, "water winter window", "en") for i in range(5)] + [(9 + i, "straße größe füße", "de") for i in range(5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    ask = spark.createDataFrame([("wintry",), ("maßen",), ("日本",), ("winter",)], "text string")
    got = [r["p"] for r in ask.select(langid.predict(ask, model, F.col("text")).alias("p")).collect()]
    assert [p["lang_pred"] for p in got] == ["en", "de", "de", "en"]
    assert got[2]["score"] == 0.5  # nothing known of it: an even share, the first name


def test_language_without_training(docs, none):
    model = langid.fit(none)
    assert {r["p"]["lang_pred"] for r in docs.select(langid.predict(docs, model, F.col("text")).alias("p")).collect()} == {"und"}


# ------------------------------------------------------------------ HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>The Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="cookie-notice">We use cookies, many of them, all the time, everywhere, believe it or not.</div>
<div class="layout"><div class="content"><h2>Title &amp; more</h2><p>First paragraph, with <b>bold</b> text,
and a line.<br>After the break&nbsp;here, we go on &lt;as&gt; before.<p>Second paragraph, not closed, but long enough.
<div class="ad">Buy now, cheap, cheap, cheap, cheap, cheap, cheap, cheap</div><blockquote>A quotation, said someone.</blockquote>
<ul class="links"><li><a href="a">Other page</a></li><li><a href="b">Another page</a></li></ul>
<p>Last paragraph, of the article, with commas, and an end.</p></div>
<aside><p>Sidebar text, which is also quite long, with many, many, commas, in it, but unwanted.</p></aside></div>
<section id="comments"><p>Great article, I liked it, very much, really, a lot, and so on, and so on, forever.</p></section>
<form><label>Mail</label><input name="x"><p>Send us, please, a letter, or two, or three, or four.</p></form>
<footer>Imprint, 2020, all rights reserved, somewhere</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE) == (
        "Title & more First paragraph, with bold text, and a line. After the break here, we go on <as> before. "
        "Second paragraph, not closed, but long enough. A quotation, said someone. "
        "Last paragraph, of the article, with commas, and an end.")


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>One<p>Two", "One Two"), ("<div>a<div>b</div>c</div>", "a b c"), ("<p>x <!-- y --> z</p>", "x z"),
    ("<script>alert(1)</script>", ""), ("<p>a</b></i>b</p>", "ab"), ("<p title='a>b'>c</p>", "c"), ("5 < 6 and 7 > 3", "5 < 6 and 7 > 3"),
    ("<div>" * 5_000 + "deep" + "</div>" * 5_000, "deep"), ("<p>unfinished <a href='", "unfinished <a href='")])
def test_odd_pages(page, text):
    assert extract.main_text(page) == text


def test_article_sections_and_headings():
    page = "<body><main><article><h1>Head</h1>" + "".join(
        f"<section><h2>Part {i}</h2><p>{'Some words, and more, in part. ' * 4}</p></section>" for i in range(4)) + (
        "</article></main><div class='related'><p>Read also, this one, that one, and more, and more.</p></div></body>")
    text = extract.main_text(page)
    assert text.startswith("Head Part 0 Some") and text.count("Part") == 4 and "Read also" not in text


def test_extract_column(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string").repartition(2)
    got = dict(pick(df.select("page_id", extract.extract_text(F.col("html")).alias("x")), "page_id", "x"))
    assert got[2] == got[3] == "" and got[1].startswith("Title")
    assert df.where("false").select(extract.extract_text(F.col("html"))).count() == 0


# ------------------------------------------------------------------ token counts

def by_character(library, text, sections, rule):
    counts, at = [0] * len(sections), 0
    raw, where = text.encode(), []
    for i, c in enumerate(text):
        where += [i] * len(c.encode())
    for token in library.encode_ordinary(text):
        n = len(library.decode_single_token_bytes(token))
        a, b = where[at], where[at + n - 1]
        at += n
        over = [max(0, min(e, b + 1) - max(s, a)) for s, e in sections]
        met = [i for i, o in enumerate(over) if o]
        if met:
            counts[met[0] if rule == "start" else met[-1] if rule == "end" else over.index(max(over))] += 1
    assert at == len(raw)
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_equal_a_loop(spark, docs, library, rule):
    out = docs.where("doc_id < 40 or doc_id >= 200").select("text", token_counts.count_tokens(tokenizer(spark), F.col("text"), crossing=rule).alias("c"))
    for text, c in pick(out, "text", "c"):
        text, sections, at = text or "", [], 0
        for line in text.split("\n"):
            sections.append((at, min(len(text), at + len(line) + 1)))
            at += len(line) + 1
        assert [(x["start"], x["stop"]) for x in c] == sections
        assert [x["n_tokens"] for x in c] == by_character(library, text, sections, rule)
        assert sum(x["n_tokens"] for x in c) == len(library.encode_ordinary(text))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_given_sections(spark, library, rule):
    rng, rows = random.Random(1), []
    for i in range(60):
        text = "".join(rng.choice("ab é日😀\n") for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(4))
        rows.append((text, [(cuts[0], cuts[1]), (cuts[2], cuts[3])] if i % 9 else [] if i % 2 else None))
    df = spark.createDataFrame(rows, "text string, s array<struct<a: int, b: int>>")
    out = df.select("*", token_counts.count_tokens(tokenizer(spark), F.col("text"), F.col("s"), rule).alias("c"))
    for text, s, c in pick(out, "text", "s", "c"):
        assert [x["n_tokens"] for x in c] == by_character(library, text, [tuple(x) for x in s or []], rule)


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        token_counts.count_tokens(tokenizer(spark), F.col("text"), crossing="half")
