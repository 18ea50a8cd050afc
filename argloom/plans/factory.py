"""Plans put together from configuration: generators of preference pairs and evaluators, by the names of their parts."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.operators import extraction, preference, problems, scores
from argloom.plans.judging import JUDGES, Verifier, judge

_log = logging.getLogger(__name__)
VIRTUES = scores.ANNOTATION_VIRTUES | scores.MAP_VIRTUES | scores.RECO_VIRTUES | scores.LOGIC_VIRTUES
_ROLES = {"annotation": "arganno", "map": "argmap", "reco": "infreco", "logic": "infreco"}


def parts() -> dict[str, object]:
    """Everything that a configuration can name: judges, virtues, tasks with their templates, kinds of pairs."""
    pairs = {"validity": preference.validity_pairs, "ask_invalid": preference.asked_invalid_pairs, "failure": preference.failure_diff_pairs, "self_critique": preference.self_critique_pairs}
    return {f"judge.{n}": v for n, v in JUDGES.items()} | {f"virtue.{n}": f for n, f in VIRTUES.items()} | {f"task.{n}": t for n, t in problems.TEMPLATES.items()} | {f"pairs.{n}": f for n, f in pairs.items()}


def get_part(name: str) -> object:
    known = parts()
    if name not in known:
        raise ValueError(f"nothing is named '{name}'")
    return known[name]


def evaluated(solutions: DataFrame, name: str, virtues: list[str] = (), answer: str = "raw_answer", source: str | None = None) -> DataFrame:
    """solutions with is_valid, metrics, errors and a column for each virtue."""
    plan = get_part(f"judge.{name}")
    assert isinstance(plan, Verifier)
    found = {v: get_part(f"virtue.{v}") for v in virtues}
    out = judge(solutions, name, answer, source).withColumn("errors", preference.bare_errors(F.col("metrics")))
    if not found:
        return out
    own = out.columns
    read = extraction.read(out, "sol_pos", answer, source, logic=plan.logic)
    return read.select(*own, *[f(plan.roles[_ROLES[v.split("_")[0]]].last()).alias(v) for v, f in found.items()])


def pairs_from_config(config: dict) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None:
    """A generator of pairs, called with solutions, feedbacks and revisions; None, and a line in the log, if the configuration is wrong.

    judge: name; virtues: names (none: validity only)."""
    try:
        name, virtues = config["judge"], list(config.get("virtues", ()))
        get_part(f"judge.{name}")
        for v in virtues:
            get_part(f"virtue.{v}")
    except (KeyError, TypeError, ValueError) as error:
        _log.error("configuration of pairs: %s", error)
        return None

    def generate(solutions: DataFrame, feedbacks: DataFrame, revisions: DataFrame) -> DataFrame:
        revised = judge(revisions, name, key="rev_pos").select("problem_id", "sol_pos", "feedback_pos", "rev_pos", "raw_answer", "is_valid")
        return preference.all_pairs(evaluated(solutions, name, virtues), feedbacks, revised, virtues)

    return generate


def evaluator_from_config(config: dict) -> Callable[[DataFrame], DataFrame] | None:
    """An evaluator of solutions: how many of each problem are valid, and how often each check failed; None if the configuration is wrong."""
    try:
        name = config["judge"]
        get_part(f"judge.{name}")
    except (KeyError, TypeError, ValueError) as error:
        _log.error("configuration of an evaluator: %s", error)
        return None
    return lambda solutions: preference.metrics(evaluated(solutions, name))
