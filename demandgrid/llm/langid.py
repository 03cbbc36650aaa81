"""Language identification: known words first, shorter and shorter character n-grams for the others (operator 4).

Learned are, per language, frequencies of words and of n-grams of padded words, both counted by Spark.  A known word
adds its log frequency per language.  An unknown one falls back to the longest n-grams of it that are known.  The
score is the best language's share of the languages' mean likelihoods per word, a number between 0 and 1.

Defined results: a text that is null or has no letter is ``und`` with score 0; a text with letters in no known n-gram
gets the first language by name, with an even share as score, as other ties do; without any
training rows every text is ``und``.  Rows are judged one by one, whole texts, so repeats and extra columns don't
matter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.base import materialise

UND = "und"
LETTERS = r"\p{L}+"
MOST_LANGUAGES = 1_000  # the table of frequencies has a column for each


@dataclass(frozen=True)
class Settings:
    """Bounds of the model; predictions and what is counted over the sample know no other limit."""

    docs_per_language: int = 2_000     # size of the training sample, by the lowest hashes of the key
    words_per_language: int = 20_000   # most frequent words kept
    grams_per_language: int = 4_000    # most frequent n-grams kept of each length
    longest: int = 5
    smoothing: float = 0.5
    cells: int = 4_000_000             # of the frequency table; with many languages fewer words are kept of each


def training_sample(df: DataFrame, key: str, text: str, label: str, docs: int) -> DataFrame:
    """At most ``docs`` labelled texts per language: those whose hash of key and text is lowest."""
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("lang"), F.col(text).alias("text"),
        (F.xxhash64(F.col(key), F.col(text)).bitwiseAND(F.lit((1 << 62) - 1)) / float(1 << 62)).alias("u"))
    counts = rows.groupBy("lang").count()
    if counts.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    # a row for each language, checked above; twice the share keeps the exact ranking from moving more texts than it needs
    near = rows.join(F.broadcast(counts), "lang").where(F.col("u") <= 2.0 * docs / F.col("count") + 1e-4)
    first = Window.partitionBy("lang").orderBy("u")
    return near.withColumn("i", F.row_number().over(first)).where(F.col("i") <= docs).select("lang", "text")


def _most_frequent(counts: DataFrame, unit: list[str], most: int) -> DataFrame:
    w = Window.partitionBy("lang", *unit[:-1]).orderBy(F.desc("n"), unit[-1])
    kept = counts.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).select(*unit).distinct()
    return counts.join(kept, unit, "left_semi")


class Model:
    """Log frequencies of words and n-grams, a row of the table for each; the driver holds it and tasks share it."""

    def __init__(self, languages: list[str], table: np.ndarray, words: dict[str, int], grams: dict[str, int],
                 longest: int):
        self.languages, self.table, self.words, self.grams, self.longest = languages, table, words, grams, longest

    def row_of_unknown(self, word: str) -> np.ndarray:
        padded = f"^{word}$"
        for n in range(min(self.longest, len(padded)), 0, -1):
            found = [i for at in range(len(padded) - n + 1)
                     if (i := self.grams.get(padded[at:at + n])) is not None]
            if found:
                return self.table[found].mean(axis=0)
        return np.zeros(self.table.shape[1], np.float32)


def fit(df: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang",
        settings: Settings = Settings()) -> Model:
    s = settings
    sample = training_sample(df, key, text, label, s.docs_per_language)
    words = (sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("w"))
             .groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")))
    words = materialise(words)
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((0, 0), np.float32), {}, {}, s.longest)
    share = s.cells // (len(languages) ** 2)
    known = _most_frequent(words, ["w"], max(1, min(s.words_per_language, share // 2)))
    padded = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    grams = words.select("lang", "n", padded.alias("p"), F.explode(F.sequence(F.lit(1), F.lit(s.longest))).alias("k"))
    grams = grams.where(F.char_length("p") >= F.col("k")).select(
        "lang", "n", "k", F.explode(F.transform(
            F.sequence(F.lit(1), F.char_length("p") - F.col("k") + 1),
            lambda i: F.substr(F.col("p"), i, F.col("k")))).alias("g"))
    grams = grams.where(~F.col("g").isin("^", "$")).groupBy("lang", "k", "g").agg(F.sum("n").alias("n"))
    parts = _most_frequent(grams, ["k", "g"], max(1, min(s.grams_per_language, share // (2 * s.longest))))
    column = {x: i for i, x in enumerate(languages)}
    tables, names = [], []
    for found, per in ((known.select("lang", "w", "n"), None), (parts.select("lang", "g", "n", "k"), "k")):
        rows = found.collect()
        index: dict[str, int] = {}
        for r in rows:
            index.setdefault(r[1], len(index))
        counts = np.zeros((len(index), len(languages)))
        for r in rows:
            counts[index[r[1]], column[r["lang"]]] += r["n"]
        size = np.array([len(x) for x in index]) if per else np.zeros(len(index), int)
        logs = np.zeros_like(counts)
        for k in np.unique(size):
            of = size == k
            total = counts[of].sum(axis=0) if per else np.array([totals[x] for x in languages], float)
            logs[of] = np.log((counts[of] + s.smoothing) / (total + s.smoothing * (of.sum() + 1)))
        tables.append(logs - logs.mean(axis=1, keepdims=True))
        names.append(index)
    start = len(names[0])
    return Model(languages, np.concatenate(tables).astype(np.float32), names[0],
                 {g: i + start for g, i in names[1].items()}, s.longest)


class _Rows(dict):
    """Number of the table row of each word met, unknown ones appended."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.start = model, len(model.table)
        self.table, self.used = np.concatenate((model.table, np.zeros((1 << 12, model.table.shape[1]), np.float32))), self.start

    def __missing__(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[self.used] = self.model.row_of_unknown(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def trim(self, most: int = 1 << 17) -> None:
        if self.used - self.start > most:
            self.clear()
            self.update(self.model.words)
            self.used = self.start


def predict(df: DataFrame, model: Model, text: Column) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a text column."""
    # bounded by Settings.cells; a worker keeps its own rows beside the broadcast value
    shared = df.sparkSession.sparkContext.broadcast({"model": (
        model.languages, model.table, model.words, model.grams, model.longest)})

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def identify(texts: pa.Array) -> pa.Array:
        kept = shared.value
        if "rows" not in kept:
            kept["rows"] = _Rows(Model(*kept["model"]))
        rows = kept["rows"]
        languages = rows.model.languages
        letters, names, scores = regex.compile(LETTERS), [], []
        for t in texts:
            words = letters.findall((t.as_py() or "").lower())
            if not words or not languages:
                names.append(UND)
                scores.append(0.0)
                continue
            at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
            mean = rows.table[at].mean(axis=0, dtype=np.float64)
            likely = np.exp(mean - mean.max())
            best = int(np.argmax(likely))
            names.append(languages[best])
            scores.append(float(likely[best] / likely.sum()))
            rows.trim()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                          ["lang_pred", "score"])

    return identify(text)
