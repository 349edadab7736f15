"""Quality rules: a threshold table compiled into one projection. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, carried, read

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the be to of and that have with a in is it for as was on are by this from "
    "der die das und in zu den ein eine ist von mit nicht auf im sich "
    "le la les de des du et en un une est que qui pour dans sur par au avec "
    "el los las y que no un una es se por con para del al lo su"
).split()

#: measure, least, most, from how many words on the rule holds. A text fails when a measure is outside.
RULES = [
    ("n_words", 10, 2_000_000, 0),
    ("mean_word_length", 1.5, 40.0, 0),
    ("symbol_ratio", 0.0, 0.3, 0),
    ("stop_ratio", 0.005, 1.0, 60),
    ("repeat_ratio", 0.0, 0.2, 0),
    ("dup_line_ratio", 0.0, 0.6, 0),
    ("bullet_line_ratio", 0.0, 0.95, 0),
    ("ellipsis_line_ratio", 0.0, 0.5, 0),
]


def _repeats(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more. Windows are sorted with their places; equal
    neighbours repeat; the union of the repeated windows is summed in order of place. Texts whose windows
    all differ skip the sort."""

    def covered(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.array_join(F.slice(w, i, F.lit(5)), " "))
        return F.get(F.transform(F.array(windows), repeated), F.lit(0))

    def repeated(ws: Column) -> Column:
        placed = F.array_sort(F.transform(ws, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        many = F.get(F.transform(F.array(placed), lambda s: F.transform(F.filter(s, lambda x, j: (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"])), lambda x: x["i"])), F.lit(0))
        zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))

        def add(a: Column, i: Column) -> Column:
            return F.struct((i + 5).alias("to"), (a["n"] + i + 5 - F.greatest(a["to"], i)).alias("n"))

        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(F.aggregate(F.array_sort(many), zero, add, lambda a: a["n"]))

    return F.when(F.size(words) < 6, F.lit(0)).otherwise(F.get(F.transform(F.array(words), covered), F.lit(0)))


def measures(docs: DataFrame) -> DataFrame:
    """row (the columns of docs, whatever their names) and the counts and ratios of each whole text; a null text has none
    (all counts 0); repeated rows are measured each."""
    t = F.coalesce("text", F.lit(""))
    line = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    held = carried(docs, F.array_remove(F.split(t, SPACE, -1), "").alias("w"), line.alias("l"), t.alias("t"))
    bare = F.regexp_replace("t", SPACE, "")
    counted = held.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeats(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("l", lambda x: F.regexp_like(x, F.lit(r"^[\x20\x09]*[-*•]")))).cast("long").alias("n_bullets"),
        F.size(F.filter("l", lambda x: F.regexp_like(x, F.lit(r"(\.\.\.|…)[\x20\x09]*$")))).cast("long").alias("n_ellipsis"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) == 0, 0.0).otherwise(F.col(part) / F.col(whole))

    return counted.withColumns(
        {
            "mean_word_length": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "n_words"), "stop_ratio": share("n_stop", "n_words"),
            "repeat_ratio": share("n_repeat_words", "n_words"), "dup_line_ratio": share("n_dup_lines", "n_lines"),
            "bullet_line_ratio": share("n_bullets", "n_lines"), "ellipsis_line_ratio": share("n_ellipsis", "n_lines"),
        }
    )


def verdict(rules: list[tuple] = RULES) -> Column:
    """True when every rule of the table holds."""
    ok = F.lit(True)
    for name, least, most, words in rules:
        ok = ok & ((F.col("n_words") < words) | F.col(name).between(least, most))
    return ok


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents: one projection over the scan, no shuffle."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return measures(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict()).alias("kept")
    )
