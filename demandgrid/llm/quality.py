"""Quality rules: a table of thresholds compiled into one projection (operator 1).

Every measure is a native expression over the whole text; there is no user function and no shuffle.

Words are runs of characters other than space and tab to carriage return.  Defined results: a null or empty text
has no words, so every count is 0, it fails the base rule and is not kept; ratios over nothing are null, and a rule
whose measure is null does not fail (the length rule already catches such texts).  Rows are judged one by one, so
repeated rows get equal verdicts, and an empty table gives an empty table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.base import let

BLANKS = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for as was on are by this from or an at he not "
    "der die das und ist von zu den mit sich des auf für nicht ein eine als auch im dem "
    "le la les de et des un une est que dans en pour qui sur pas au par avec du "
    "el los las y por con para una se del su al lo como más pero").split()


@dataclass(frozen=True)
class Rule:
    """``measure`` has to lie in [least, most]; a bound of None is open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Production thresholds: length, symbol, stop-word and line ratios after published rules for web text.
RULES = (
    Rule("too_short", "n_words", least=50),
    Rule("too_long", "n_words", most=1_000_000),
    Rule("odd_word_length", "mean_word_length", least=2, most=15),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("shouting", "capitals_per_letter", most=0.5),
    Rule("few_stop_words", "stop_word_share", least=0.06),
    Rule("duplicate_lines", "duplicate_line_share", most=0.5),
    Rule("bullet_lines", "bullet_line_share", most=0.9),
    Rule("ellipsis_lines", "ellipsis_line_share", most=0.3),
    Rule("repeated_words", "repeated_word_share", most=0.5),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated_words(words: Column, n: Column) -> Column:
    """Words covered by 3-word windows that the text holds at least twice: sort the windows, mark equal neighbours,
    put the marked positions back in order and add up how far each reaches past the one before."""
    windows = F.sort_array(F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))

    def marked(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False))
                         | F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get(p, j - 1), x - 3)))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(windows, marked), covered)


def measures(text: Column) -> Column:
    """One struct of counts and ratios of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, BLANKS) != "")

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"), _repeated_words(w, n).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda v: F.ltrim(v).rlike("^[-*•]"))).cast("long").alias("n_bullets"),
            F.size(F.filter(x, lambda v: F.rtrim(v).rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_ellipses"))

    length = F.char_length(text).cast("long")
    return F.struct(
        let(words, of_words).alias("w"), let(lines, of_lines).alias("x"),
        F.char_length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (length - F.char_length(_without(text, SYMBOLS))).alias("n_symbols"),
        F.char_length(F.regexp_replace(text, "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
        F.char_length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast("long").alias("n_capitals"))


def quality_verdicts(df: DataFrame, key: str = "doc_id", text: str = "text",
                     rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Key, counts, ratios, ``failed`` (names of the rules a text breaks), ``base_failed`` and ``kept``."""
    m = df.select(F.col(key), measures(F.col(text)).alias("m"))
    base = m.select(
        key, "m.w.n_words", "m.word_chars", "m.n_symbols", "m.x.n_dup_lines", "m.w.n_repeat_words",
        _ratio(F.col("m.word_chars"), F.col("m.w.n_words")).alias("mean_word_length"),
        _ratio(F.col("m.n_symbols"), F.col("m.w.n_words")).alias("symbols_per_word"),
        _ratio(F.col("m.n_capitals"), F.col("m.n_letters")).alias("capitals_per_letter"),
        _ratio(F.col("m.w.n_stop_words"), F.col("m.w.n_words")).alias("stop_word_share"),
        _ratio(F.col("m.x.n_dup_lines"), F.col("m.x.n_lines")).alias("duplicate_line_share"),
        _ratio(F.col("m.x.n_bullets"), F.col("m.x.n_lines")).alias("bullet_line_share"),
        _ratio(F.col("m.x.n_ellipses"), F.col("m.x.n_lines")).alias("ellipsis_line_share"),
        _ratio(F.col("m.w.n_repeat_words"), F.col("m.w.n_words")).alias("repeated_word_share"))

    def broken(r: Rule) -> Column:
        low = F.col(r.measure) < r.least if r.least is not None else F.lit(False)
        high = F.col(r.measure) > r.most if r.most is not None else F.lit(False)
        return F.when(F.coalesce(low | high, F.lit(False)), F.lit(r.name))

    failed = F.array_compact(F.array(*[broken(r) for r in rules])) if rules else F.array().cast("array<string>")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (base.withColumn("failed", failed).withColumn("base_failed", base_failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))
