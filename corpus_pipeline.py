"""From raw documents to tokens: language, boilerplate lines, near-duplicates, mix, tokens.

Each stage is one operator of ``demandgrid.llm`` applied to all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.llm import langid, lines, mixing, simhash
from demandgrid.llm.base import materialise, table
from demandgrid.llm.queries import LINE_PAGES, LINE_RATIO, OTHER_WEIGHT, RECIPE, tokenizer

LEAST_SCORE = 0.3
SHINGLE, MOST_BITS = 3, 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter and those whose best language is doubtful."""
    model = langid.fit(docs)
    judged = docs.select(F.struct("*").alias("row"), langid.predict(docs, model, F.col("text")).alias("p"))
    return judged.where((F.col("p.lang_pred") != langid.UND) & (F.col("p.score") >= LEAST_SCORE)).select("row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the lines out that a source repeats on its pages; ``n_chars`` follows the text.  Pages that are mostly such
    lines stay whole: they are near copies, left to the next stage."""
    cleaned = lines.drop_boilerplate(docs, ratio=LINE_RATIO, min_pages=LINE_PAGES, most=0.5)
    new = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    return cleaned.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked by two bits at most stays."""
    return simhash.first_of_each(docs, shingle=SHINGLE, radius=MOST_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.in_mixed_order(docs, RECIPE, other=OTHER_WEIGHT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, decoded again to prove that nothing got lost, with their place in the mix.

    Files read back have no order, so the place is part of the result: training takes the rows by ``slot`` and, within
    a slot, by ``offset`` (rows equal in both are empty texts)."""
    t = tokenizer(spark)
    placed = mixing.mix(docs, RECIPE, other=OTHER_WEIGHT, keep=True).select("row.doc_id", "row.source", "row.text", "slot", "offset")
    ids = placed.select("doc_id", "source", "slot", "offset", "text", t.encode_packed(F.col("text")).alias("ids"))
    back = ids.select("doc_id", "source", "slot", "offset", "ids", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"),
                      t.decode_packed(F.col("ids")).alias("decoded"))
    return back.select("doc_id", "source", "slot", "offset", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.col("raw")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
