"""Metrics and preference pairs over candidate solutions: partial aggregates per problem, no sorting of whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column) -> Column:
    """A fixed draw from [0, 1) by key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / float(1 << 48)


def metrics(solutions: DataFrame) -> DataFrame:
    """Per problem: n_solutions, accuracy and error_counts, how many solutions made each error that occurs."""
    # one row for each solution (no error), one for each error it makes
    errors = F.filter(F.array_distinct(F.coalesce("errors", F.array().cast("array<string>"))), lambda e: e.isNotNull())
    rows = solutions.select("problem_id", "is_valid", F.explode(F.concat(F.array(F.lit(None).cast("string")), errors)).alias("error"))
    counts = rows.groupBy("problem_id", "error").agg(F.count("*").alias("n"), F.avg(F.col("is_valid").cast("double")).alias("valid"))
    whole = lambda c: F.max(F.when(F.col("error").isNull(), F.col(c)))
    return counts.groupBy("problem_id").agg(whole("n").alias("n_solutions"), whole("valid").alias("accuracy"), F.map_from_entries(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("error", "n")))).alias("error_counts"))


def validity_pairs(solutions: DataFrame) -> DataFrame:
    """The first valid solution over the first invalid one."""
    first = lambda good: F.min(F.when(F.col("is_valid") == good, F.col("sol_pos")))
    return solutions.groupBy("problem_id").agg(first(True).alias("chosen"), first(False).alias("rejected")).where("chosen is not null and rejected is not null")


def asked_invalid_pairs(solutions: DataFrame, most: float = 0.5) -> DataFrame:
    """Validity pairs turned round, for the share min(1 - accuracy, most) of problems, by a draw from the problem."""
    first = lambda good: F.min(F.when(F.col("is_valid") == good, F.col("sol_pos")))
    pairs = solutions.groupBy("problem_id").agg(first(True).alias("rejected"), first(False).alias("chosen"), F.avg(F.col("is_valid").cast("double")).alias("accuracy"))
    pairs = pairs.where("chosen is not null and rejected is not null")
    return pairs.where(draw(F.col("problem_id")) < F.least(1 - F.col("accuracy"), F.lit(most))).select("problem_id", "chosen", "rejected")


def virtue_pairs(solutions: DataFrame, score: str) -> DataFrame:
    """The best valid solution over a drawn one that is strictly weaker; none where all are equal."""
    valid = solutions.where("is_valid")
    best = valid.groupBy(F.col("problem_id").alias("p")).agg(F.max(score).alias("top"), F.min_by("sol_pos", F.struct(-F.col(score), "sol_pos")).alias("chosen"))
    weaker = valid.join(best, F.col("problem_id") == F.col("p")).where(F.col(score) < F.col("top"))
    return weaker.groupBy("problem_id", "chosen").agg(F.min_by("sol_pos", F.struct(draw(F.col("problem_id"), F.col("sol_pos")), "sol_pos")).alias("rejected"))


def failure_pairs(solutions: DataFrame) -> DataFrame:
    """By the most common error that not all solutions of the problem make: the first without it over the first with it."""
    errors = solutions.select("problem_id", "sol_pos", F.explode("errors").alias("error")).groupBy("problem_id", "error").agg(F.countDistinct("sol_pos").alias("n"))
    size = solutions.groupBy(F.col("problem_id").alias("p")).agg(F.countDistinct("sol_pos").alias("n_all"))
    error = errors.join(size, F.col("problem_id") == F.col("p")).where("n < n_all").groupBy(F.col("problem_id").alias("q")).agg(F.min_by("error", F.struct(-F.col("n"), "error")).alias("error"))
    makes = F.array_contains("errors", F.col("error"))
    return solutions.join(error, F.col("problem_id") == F.col("q")).groupBy("problem_id", "error").agg(F.min(F.when(~makes, F.col("sol_pos"))).alias("chosen"), F.min(F.when(makes, F.col("sol_pos"))).alias("rejected"))

def bare_errors(metrics: Column) -> Column:
    """The names of the checks that failed, without their numbers, each once and in order."""
    return F.array_distinct(F.transform(F.filter(metrics, lambda m: ~m["is_valid"]), lambda m: F.regexp_replace(m["key"], "^[0-9]+_", "")))


def error_messages(metrics: Column) -> Column:
    """Check name without number -> its messages, joined by a blank where it occurs more than once."""
    failed = F.transform(F.filter(metrics, lambda m: ~m["is_valid"]), lambda m: F.struct(F.regexp_replace(m["key"], "^[0-9]+_", "").alias("name"), m["message"].alias("message")))
    names = F.array_distinct(F.transform(failed, lambda m: m["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.array_join(F.transform(F.filter(failed, lambda m: m["name"] == n), lambda m: m["message"]), " "))))


def failure_diff_pairs(solutions: DataFrame) -> DataFrame:
    """problem_id, error, chosen, rejected, avoided, common: by the most common error that some but not all solutions of a problem make, a drawn
    solution without it over a drawn one with it; the errors that only the rejected one makes, and those that both make."""
    made = F.filter(F.array_distinct(F.coalesce("errors", F.array().cast("array<string>"))), lambda e: e.isNotNull())
    rows = solutions.select("problem_id", "sol_pos", made.alias("made"))
    counts = rows.select("problem_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), "made")).alias("error")).groupBy("problem_id", "error").agg(F.count("*").alias("n"))
    whole = F.max(F.when(F.col("error").isNull(), F.col("n"))).over(Window.partitionBy("problem_id"))
    pick = counts.withColumn("n_all", whole).where("error is not null and n < n_all").groupBy(F.col("problem_id").alias("p")).agg(F.min_by("error", F.struct(-F.col("n"), "error")).alias("error"))
    rows = rows.join(pick, F.col("problem_id").eqNullSafe(F.col("p"))).withColumn("bad", F.array_contains("made", F.col("error")))
    row, rank = F.struct("sol_pos", "made"), F.struct(draw(F.col("problem_id"), F.col("sol_pos")), "sol_pos")
    drawn = lambda bad: F.min_by(F.when(F.col("bad") == bad, row), F.when(F.col("bad") == bad, rank))
    pairs = rows.groupBy("problem_id", "error").agg(drawn(False).alias("c"), drawn(True).alias("r"))
    return pairs.select("problem_id", "error", F.col("c.sol_pos").alias("chosen"), F.col("r.sol_pos").alias("rejected"), F.array_sort(F.array_except("r.made", "c.made")).alias("avoided"), F.array_sort(F.array_intersect("r.made", "c.made")).alias("common"))


def routes(solutions: DataFrame, has_virtues: bool = True) -> DataFrame:
    """problem_id, accuracy, route: self_critique without any valid solution, virtue with probability accuracy ** 4, else validity."""
    out = solutions.groupBy("problem_id").agg(F.avg(F.coalesce(F.col("is_valid"), F.lit(False)).cast("double")).alias("accuracy"))
    virtue = (draw(F.col("problem_id"), F.lit("route")) < F.pow("accuracy", F.lit(4.0))) & F.lit(has_virtues)
    return out.select("problem_id", "accuracy", F.when(F.col("accuracy") == 0, "self_critique").when(virtue, "virtue").otherwise("validity").alias("route"))


def any_virtue_pairs(solutions: DataFrame, scores: list[str]) -> DataFrame:
    """problem_id, virtue, chosen, rejected: by the first score, in a drawn order, by which some valid solution is better than another."""
    found = None
    for s in scores:
        own = virtue_pairs(solutions.where(F.col(s).isNotNull()), s).withColumn("virtue", F.lit(s))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("problem_id").agg(F.min_by(F.struct("virtue", "chosen", "rejected"), F.struct(draw(F.col("problem_id"), F.col("virtue")), "virtue")).alias("x")).select("problem_id", "x.*")


def solution_pairs(solutions: DataFrame, scores: list[str] = ()) -> DataFrame:
    """problem_id, kind, chosen, rejected of problems with a valid solution, by their route; a virtue that finds no pair gives way to validity."""
    way = routes(solutions, bool(scores)).select(F.col("problem_id").alias("p"), "route")
    valid = validity_pairs(solutions).withColumn("kind", F.lit("validity"))
    if not scores:
        return valid.select("problem_id", "kind", "chosen", "rejected")
    best = any_virtue_pairs(solutions, list(scores)).withColumn("kind", F.col("virtue")).drop("virtue")
    both = valid.unionByName(best).join(way, F.col("problem_id").eqNullSafe(F.col("p"))).where((F.col("kind") == "validity") | (F.col("route") == "virtue"))
    rank = F.struct(F.when(F.col("kind") == "validity", 1).otherwise(0), "kind")
    return both.groupBy("problem_id").agg(F.min_by(F.struct("kind", "chosen", "rejected"), rank).alias("x")).select("problem_id", "x.*")


def self_critique_pairs(solutions: DataFrame, feedbacks: DataFrame, revisions: DataFrame) -> DataFrame:
    """problem_id, sol_pos, feedback_pos, kind, chosen, rejected for the solutions of problems without any valid one.

    Of each solution feedbacks are taken in order up to the first with a valid revision. Such a feedback gives a pair of its first valid and first invalid
    revision (revision), or of its first revision over the solution if all are valid (original_revision). The feedback with the most valid
    revisions is preferred to that with the fewest (feedback). A text that is chosen more than once counts once."""
    tried = routes(solutions).where("route = 'self_critique'").select(F.col("problem_id").alias("p"))
    own = ["problem_id", "sol_pos", "feedback_pos"]
    first = lambda valid: F.min_by(F.when(F.col("is_valid") == valid, F.col("raw_answer")), F.when(F.col("is_valid") == valid, F.col("rev_pos")))
    judged = revisions.groupBy(*own).agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"), first(True).alias("good"), first(False).alias("bad"))
    judged = judged.join(tried, F.col("problem_id").eqNullSafe(F.col("p")), "left_semi")
    until = Window.partitionBy("problem_id", "sol_pos").orderBy("feedback_pos").rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("before", F.coalesce(F.max(F.col("n_valid")).over(until), F.lit(0))).where("before = 0")
    answers = solutions.select(F.col("problem_id").alias("p"), F.col("sol_pos").alias("s"), F.col("raw_answer").alias("original"))
    judged = judged.join(answers, F.col("problem_id").eqNullSafe(F.col("p")) & (F.col("sol_pos") == F.col("s"))).drop("p", "s")
    judged = judged.join(feedbacks.select(*[F.col(c).alias(f"f_{c}") for c in own], "feedback"), F.col("problem_id").eqNullSafe(F.col("f_problem_id")) & (F.col("sol_pos") == F.col("f_sol_pos")) & (F.col("feedback_pos") == F.col("f_feedback_pos")))
    kind = F.when(F.col("n_valid") == F.col("n"), "original_revision").otherwise("revision")
    revised = judged.where("n_valid > 0").select(*own, kind.alias("kind"), F.col("good").alias("chosen"), F.coalesce("bad", "original").alias("rejected"))
    ranked = judged.groupBy("problem_id", "sol_pos").agg(F.min_by(F.struct("feedback_pos", "feedback", "n_valid"), F.struct(-F.col("n_valid"), "feedback_pos")).alias("most"), F.min_by(F.struct("feedback", "n_valid"), F.struct("n_valid", "feedback_pos")).alias("least"))
    advised = ranked.where("most.n_valid > least.n_valid").select("problem_id", "sol_pos", F.col("most.feedback_pos").alias("feedback_pos"), F.lit("feedback").alias("kind"), F.col("most.feedback").alias("chosen"), F.col("least.feedback").alias("rejected"))
    every = revised.unionByName(advised)
    rank = F.struct(draw(F.col("problem_id"), F.col("sol_pos"), F.col("kind")), "sol_pos", "feedback_pos", "kind")
    return every.groupBy("problem_id", "chosen").agg(F.min_by(F.struct("sol_pos", "feedback_pos", "kind", "rejected"), rank).alias("x")).select("problem_id", "x.sol_pos", "x.feedback_pos", "x.kind", "chosen", "x.rejected")


def all_pairs(solutions: DataFrame, feedbacks: DataFrame, revisions: DataFrame, scores: list[str] = ()) -> DataFrame:
    """problem_id, kind, chosen, rejected (texts): self-critique or pairs of solutions by each problem's route; a problem that neither gives
    a pair for gets one by its most common error, if there is one."""
    text = solutions.select(F.col("problem_id").alias("p"), F.col("sol_pos").alias("s"), "raw_answer")

    def told(pairs: DataFrame) -> DataFrame:
        for c in ("chosen", "rejected"):
            pairs = pairs.join(text, F.col("problem_id").eqNullSafe(F.col("p")) & (F.col(c) == F.col("s"))).withColumn(c, F.col("raw_answer")).drop("p", "s", "raw_answer")
        return pairs.select("problem_id", "kind", "chosen", "rejected")

    first = told(solution_pairs(solutions, scores)).unionByName(self_critique_pairs(solutions, feedbacks, revisions).select("problem_id", "kind", "chosen", "rejected"))
    done = first.select(F.col("problem_id").alias("q")).distinct()
    rest = told(failure_diff_pairs(solutions).withColumn("kind", F.lit("failure")).select("problem_id", "kind", "chosen", "rejected"))
    return first.unionByName(rest.join(done, F.col("problem_id").eqNullSafe(F.col("q")), "left_anti"))


def chats(turns: DataFrame) -> DataFrame:
    """conv_id, messages: role and content of each turn in order."""
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"], t["content"])).alias("messages"))
