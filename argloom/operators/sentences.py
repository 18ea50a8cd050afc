"""Sentences: which words with a period are abbreviations is learned from a corpus, by counts alone.

A word type's score is the log-likelihood ratio of two assumptions (Kiss and Strunk, 2006): that a period follows it as often as any word, and that one
nearly always does. Long words count for less, words with inner periods for more, and every occurrence without a period speaks against it.
`abbreviations` counts over all texts in partial aggregates; its rows are the model, a table like any other. `cut` uses it row by row: a model of up to
SENT words is sent to all tasks, a larger one meets the words of the texts in a join.

Null texts have no sentences and count nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.functions.texts import ABBREVIATIONS, last_word, pieces, sentences_of

#: Scores from here on make an abbreviation; how often a period follows one; models that are sent to all tasks.
THRESHOLD, NEARLY, SENT = 0.3, 0.99, 10_000


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, n, n_period: types in lower case without their last period, how often they occur, and how often with it."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[^ \\t-\\r]+"), F.lit(0))).alias("w"))
    ended = F.endswith("w", F.lit("."))
    rows = words.select(F.when(ended, F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")).alias("word"), ended.cast("int").alias("p"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.sum("p").cast("long").alias("n_period"))


def score(n: Column, n_period: Column, share: Column, word: Column) -> Column:
    """How much the counts speak for an abbreviation; share is that of words with a period."""
    of = lambda p: n_period * F.log(p) + (n - n_period) * F.log(1 - p)
    inner = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    letters = F.length(word) - inner
    return 2 * (of(F.lit(NEARLY)) - of(share)) * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -(n - n_period).cast("double"))


def abbreviations(texts: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """word, n, n_period, score of word types that are abbreviations in these texts."""
    counts = word_counts(texts, text)
    share = counts.agg((F.sum("n_period") / F.sum("n")).alias("share"))  # one row
    likely = counts.where(F.col("n_period") > 0).where(~F.col("word").rlike("[0-9]") & F.col("word").rlike("[^.]"))
    out = likely.join(F.broadcast(share.where("share < 1")), F.lit(True)).withColumn("score", score(F.col("n"), F.col("n_period"), F.col("share"), F.col("word")))
    return out.where(F.col("score") >= threshold).select("word", "n", "n_period", "score")


def cut(texts: DataFrame, model: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts with `sentences`, cut with the words of a model besides the known ones. Keys tell rows apart."""
    rows = model.select("word").limit(SENT + 1).collect()
    if len(rows) <= SENT:
        known = F.array(*[F.lit(w) for w in sorted({*ABBREVIATIONS, *(r[0] for r in rows)})])
        return texts.withColumn("sentences", sentences_of(F.col(text), known))
    ends = texts.select(F.col(key).alias("_k"), F.explode(F.array_distinct(F.transform(pieces(F.col(text)), last_word))).alias("_w"))
    own = ends.join(model.select("word").distinct(), F.col("_w") == F.col("word")).groupBy("_k").agg(F.collect_set("word").alias("_known"))  # words of one text
    known = F.concat(F.coalesce("_known", F.array().cast("array<string>")), F.array(*[F.lit(w) for w in ABBREVIATIONS]))
    return texts.join(own, F.col(key) == F.col("_k"), "left").withColumn("sentences", sentences_of(F.col(text), known)).select(*texts.columns, "sentences")
