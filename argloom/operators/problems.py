"""Problems, answers and prompts: columns that put together what a model is asked, and what is kept of its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.functions.texts import html_text, remove_repetitions

#: What each task asks for; {sources} stands for the text. Own wordings, some with a second one to choose from.
TEMPLATES: dict[str, list[str]] = {
    "annotation": ["Mark the propositions of this text with <proposition> elements in a fenced xml block; leave the text as it is.\n\n{sources}", "Annotate the argumentation in the following text (fenced xml, <proposition id supports attacks>).\n\n{sources}"],
    "argmap": ["Draw an argument map of this text in a fenced argdown block. Label all claims and arguments.\n\n{sources}", "Which claims and arguments does the text contain, and how do they relate? Answer with an argdown map.\n\n{sources}"],
    "infreco": ["Reconstruct the main argument of this text as premises and conclusions in a fenced argdown block.\n\n{sources}"],
    "logreco": ["Reconstruct the main argument of this text and formalize its premises and conclusions in first-order logic.\n\n{sources}"],
    "argmap_plus_arganno": ["Annotate this text (xml) and draw an argument map (argdown) that refers to the annotation.\n\n{sources}"],
    "arganno_plus_infreco": ["Annotate this text (xml) and reconstruct its arguments (argdown), each referring to the other.\n\n{sources}"],
    "arganno_plus_logreco": ["Annotate this text (xml) and reconstruct its arguments with formulas (argdown), each referring to the other.\n\n{sources}"],
    "argmap_plus_infreco": ["Draw a map of this text's arguments (map.ad) and reconstruct each of them (reconstructions.ad).\n\n{sources}"],
    "argmap_plus_logreco": ["Draw a map of this text's arguments (map.ad) and reconstruct each with formulas (reconstructions.ad).\n\n{sources}"],
    "argmap_plus_arganno_plus_logreco": ["Annotate this text (annotation.txt), map its arguments (map.ad) and reconstruct each with formulas (reconstructions.ad).\n\n{sources}"],
    "arganno_from_argmap": ["Annotate the text that this {qualifier}argument map renders.\n\n{sources}"],
    "argmap_from_arganno": ["Draw an argument map of the argumentation annotated here.\n\n{sources}"],
    "infreco_from_arganno": ["Reconstruct the argument annotated here.\n\n{sources}"],
    "logreco_from_infreco": ["Formalize this reconstruction.\n\n{sources}"],
}
#: Tasks whose sources lose their tags first.
WITHOUT_TAGS = ("annotation", "argmap_plus_arganno", "arganno_plus_infreco", "arganno_plus_logreco", "argmap_plus_arganno_plus_logreco")
REVISE = "Revise your previous answer in the light of the feedback."
WARNING = "WARNING: for training purposes this answer is meant to be flawed."


def joined_sources(sources: Column, task: str) -> Column:
    """A problem's sources as one text, without tags where the task asks for that, blanks at both ends dropped."""
    whole = F.array_join(sources, "\n\n-----\n\n")
    return F.trim(F.regexp_replace(html_text(whole) if task in WITHOUT_TAGS else whole, r"^\s+|\s+$", ""))


def template(problem_id: Column, task: str, seed: int = 0) -> Column:
    """One of the task's templates, drawn by the problem."""
    own = TEMPLATES[task]
    return F.element_at(F.array(*map(F.lit, own)), (F.pmod(F.xxhash64(problem_id, F.lit(seed)), F.lit(len(own))) + 1).cast("int"))


def problems(sources: DataFrame, task: str, seed: int = 0) -> DataFrame:
    """problem_id, task, sources, prompt from problem_id and sources (an array of texts)."""
    out = sources.select("problem_id", F.lit(task).alias("task"), joined_sources(F.col("sources"), task).alias("sources"), template(F.col("problem_id"), task, seed).alias("prompt"))
    return out.withColumn("prompt", F.replace(F.replace("prompt", F.lit("{qualifier}"), F.lit("")), F.lit("{sources}"), F.col("sources")))


def with_hints(prompt: Column, hints: Column) -> Column:
    """The prompt with hints behind it, if there are any."""
    return F.when(F.size(hints) > 0, F.concat(prompt, F.lit("\n\nHints: "), F.array_join(hints, " - "))).otherwise(prompt)


def expected_errors(metrics: Column) -> Column:
    """A list of failed checks, messages over several lines quoted."""
    failed = F.filter(metrics, lambda m: ~m["is_valid"])
    said = lambda m: F.when(F.contains(m["message"], F.lit("\n")), F.concat(F.lit("\n> "), F.replace(m["message"], F.lit("\n"), F.lit("\n> ")))).otherwise(F.concat(F.lit(" "), m["message"]))
    return F.array_join(F.transform(failed, lambda m: F.concat(F.lit("- "), F.regexp_replace(m["key"], "^[0-9]+_", ""), F.lit(":"), said(m))), "\n")


def asking_for_invalid(prompt: Column, metrics: Column) -> Column:
    """The prompt between two warnings, with the errors that the answer should have."""
    return F.concat(F.lit(f"{WARNING}\n\n"), prompt, F.lit(f"\n\n{WARNING}\n\nExpected errors:\n"), expected_errors(metrics))


def asking_for_invalid_revision(prompt: Column, metrics: Column) -> Column:
    return F.concat(prompt, F.lit(f"\n\n{WARNING}\n\nExpected errors:\n"), expected_errors(metrics))


def revise_prompt(hints: Column) -> Column:
    return with_hints(F.lit(REVISE), hints)


def feedback_prompt(prompt: Column, answer: Column, metrics: Column) -> Column:
    """What a critic is asked about an invalid answer."""
    failed = F.transform(F.filter(metrics, lambda m: ~m["is_valid"]), lambda m: F.concat(F.lit("- **"), m["key"], F.lit("**: "), m["message"]))
    return F.concat(F.lit("Give feedback on this answer.\n\n# Problem\n\n"), prompt, F.lit("\n\n# Answer\n\n"), answer, F.lit("\n\n# Failed checks\n\n"), F.array_join(failed, "\n"))


def feedback_requests(judged: DataFrame) -> DataFrame:
    """problem_id, sol_pos, feedback_prompt of every invalid solution; needs prompt, raw_answer, is_valid, metrics."""
    return judged.where(~F.col("is_valid")).select("problem_id", "sol_pos", feedback_prompt(F.col("prompt"), F.col("raw_answer"), F.col("metrics")).alias("feedback_prompt"))


def ingested(answers: DataFrame, group: tuple[str, ...] = ("problem_id",), dedupe: bool = True) -> DataFrame:
    """Answers that aren't empty, without repetitions at their end, each once for its group (the first by sol_pos)."""
    out = answers.withColumn("raw_answer", remove_repetitions(F.col("raw_answer"))).where(F.col("raw_answer").isNotNull() & (F.trim("raw_answer") != ""))
    if not dedupe:
        return out
    rest = [c for c in out.columns if c not in (*group, "raw_answer")]
    return out.groupBy(*group, "raw_answer").agg(F.min_by(F.struct(*rest), F.col("sol_pos")).alias("x")).select(*group, "raw_answer", "x.*").select(*out.columns)


def rendered(artifacts: Column, raw_answer: Column, roles: tuple[str, ...]) -> Column:
    """The snippets of an answer one below the other; without any the answer itself, without that None."""
    found = F.filter(F.array(*[artifacts[r] for r in roles]), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, "\n\n")).otherwise(F.coalesce(raw_answer, F.lit("None")))


def partial(judged: DataFrame, role: str) -> DataFrame:
    """Solutions reduced to one snippet: a map, a reconstruction or an annotation."""
    return judged.withColumn("raw_answer", F.col(f"artifacts.{role}")).withColumn("artifacts", F.struct(F.col(f"artifacts.{role}").alias(role)))


def first_or_valid(judged: DataFrame) -> DataFrame:
    """Of each problem the first valid solution, else the first one."""
    order = Window.partitionBy("problem_id").orderBy(F.col("is_valid").desc(), "sol_pos")
    return judged.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sequential_problems(judged: DataFrame, task: str, seed: int = 0) -> DataFrame:
    """problem_id, task, prompt: problems about the answers to other ones; an invalid map is called imperfect."""
    best = first_or_valid(judged)
    qualifier = F.when(F.col("is_valid"), "").otherwise("(arguably imperfect) ")
    return best.select("problem_id", F.lit(task).alias("task"), F.replace(F.replace(template(F.col("problem_id"), task, seed), F.lit("{qualifier}"), qualifier), F.lit("{sources}"), F.col("raw_answer")).alias("prompt"))


def as_chat(prompt: Column, answer: Column, original: Column | None = None, feedback_ask: Column | None = None, feedback: Column | None = None, last_ask: Column | None = None) -> Column:
    """Messages with role and content: two, or six where there are an original answer and feedback on it. last_ask stands for the last question."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    short = F.array(say("user", last_ask if last_ask is not None and original is None else prompt), say("assistant", answer))
    if original is None or feedback is None:
        return short
    ask = last_ask if last_ask is not None else F.lit(REVISE)
    long = F.array(say("user", prompt), say("assistant", original), say("user", feedback_ask), say("assistant", feedback), say("user", ask), say("assistant", answer))
    return F.when(original.isNotNull() & feedback.isNotNull(), long).otherwise(F.array(say("user", prompt), say("assistant", answer)))
