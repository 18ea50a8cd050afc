"""Artifacts built from the plain tables by rule, so that what is wrong with each follows from its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotated_answers(documents: DataFrame) -> DataFrame:
    """request_id, answer: each whole text in a fenced xml block as two propositions; defect = doc_id % 9."""
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    words = F.split(F.replace(safe, F.lit("```"), F.lit("")), " ")
    half = F.floor(F.size(words) / 2).cast("int")
    first, second = F.concat_ws(" ", F.slice(words, 1, half)), F.concat_ws(" ", F.slice(words, half + 1, F.size(words)))
    d = F.pmod("doc_id", F.lit(9))
    when = lambda k, bad, good="": F.when(d == k, bad).otherwise(good)
    one = F.concat(F.lit("<proposition"), when(2, "", ' id="1"'), F.lit(' supports="2'), when(4, " 99"), F.lit('"'), when(5, ' attacks="77"'), when(6, ' mood="sad"'), F.lit(">"), first, F.lit("</proposition>"))
    two = F.concat(F.lit("<proposition"), F.when(d == 3, ' id="1"').otherwise(' id="2"'), F.lit(">"), second, when(1, '<proposition id="3">inner</proposition>'), F.lit("</proposition>"), when(7, "<claim>x</claim>"), when(3, '<proposition id="2">y</proposition>'))
    end = F.when(d == 8, "").otherwise("\n```")  # 8: the fence is never closed
    return documents.select(F.col("doc_id").alias("request_id"), F.concat(F.lit('Here it is.\n```xml {filename="annotation.txt"}\n'), one, F.lit(" "), two, end, F.lit("\n")).alias("answer"))


#: Numbers of documents that a problem of a source and language may have.
PROBLEM_DOCS = 200


def solutions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """problem_id, sol_pos, raw_answer, is_valid, errors: a problem for each source, language and PROBLEM_DOCS document numbers, judged by the labels."""
    known = labels.select(F.col("doc_id").alias("d"), "quality", "toxic")
    errors = F.filter(F.array(F.when(F.col("quality") == 0, "01_quality"), F.when(F.col("toxic") == 1, "02_toxic")), lambda x: x.isNotNull())
    return documents.join(known, F.col("doc_id") == F.col("d")).select(F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.floor(F.col("doc_id") / PROBLEM_DOCS).cast("string")).alias("problem_id"), F.col("doc_id").alias("sol_pos"), F.col("text").alias("raw_answer"), "n_chars", (F.col("quality") == 1).alias("is_valid"), errors.alias("errors"))
