"""Verifiers and judges as named plans: lists of steps over a request's blocks, evaluated as one array of results in the request's own row.

`verify(requests, name)` gives the results and scores of every request, `judge(solutions, name)` the evaluation of every solution. No rows move.
Checks, scores and verifiers can be added by `register_check`, `register_function`, `register_score` and `register_verifier`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.functions.reading import KEYS, Keys
from argloom.functions.texts import SHORTENING_FROM, TOLERANCE
from argloom.operators import checks, coherence, extraction, scores
from argloom.operators.checks import RESULT, result
from argloom.operators.logic import LOGIC_CHECKS, well_formed

Rule = tuple[str, str, bool]


class VerifierError(Exception):
    """What went wrong with a request for verification."""

    status = 500


class VerifierNotFoundError(VerifierError):
    status = 404


class InvalidConfigError(VerifierError):
    status = 400


class InvalidFilterError(VerifierError):
    status = 422


@dataclass(frozen=True)
class Role:
    """Blocks of a type whose metadata meet all rules."""

    dtype: str
    rules: tuple[Rule, ...] = ()

    def fits(self, block: Column) -> Column:
        return extraction.in_role(block, self.dtype, list(self.rules))

    def last(self) -> Column:
        return extraction.last(self.dtype, list(self.rules))


def _file(prefix: str, dtype: str = "argdown") -> Role:
    return Role(dtype, (("filename", re.escape(prefix), True),))


ANNO, ARGDOWN = Role("xml"), Role("argdown")


@dataclass(frozen=True)
class Step:
    """A check of whole requests (kind has), of each block in a role (block), of the last blocks in two roles (pair), of the same by
    a check that goes to Python (apart: not in a lambda), or of each block in a role by a function of its own that may fail (function): then the block has an invalid result that says so, and nothing else stops."""

    verifier_id: str
    kind: str
    roles: tuple[str, ...]
    check: Callable[..., Column]
    between: str = " "

    def results(self, roles: dict[str, Role], inputs: str) -> Column:
        own = [roles[r] for r in self.roles]
        if self.kind == "has":
            found = F.filter("blocks", own[0].fits)
            return result(self.verifier_id, checks.strings(), self.check(F.col(inputs), found))
        if self.kind == "block":
            fit = F.filter("blocks", lambda b: own[0].fits(b) & b["error"].isNull())
            return F.flatten(F.transform(fit, lambda b: result(self.verifier_id, F.array(b["id"]), self.check(b), self.between)))
        if self.kind == "function":
            asked = F.filter("blocks", lambda b: own[0].fits(b) & b["error"].isNull())
            told = _told(self.check)(F.transform(asked, lambda b: F.to_json(b)))
            said = lambda b, t: F.when(t["error"].isNotNull(), F.array(F.struct(F.lit(self.verifier_id).alias("verifier_id"), checks.strings().alias("refs"), F.lit(False).alias("is_valid"), F.concat(F.lit("Processing error: "), t["error"]).alias("message")))).otherwise(result(self.verifier_id, F.array(b["id"]), t["messages"], self.between))
            return F.flatten(F.zip_with(asked, told, lambda b, t: said(b, t).cast(RESULT)))
        first, second = own
        if self.kind == "apart":
            a, b = first.last(), second.last()
            return F.when(F.coalesce(a["pos"] < b["pos"], F.lit(False)), result(self.verifier_id, F.array(a["id"], b["id"]), self.check(a, b), self.between)).otherwise(F.array().cast(RESULT))
        # Both blocks are bound by the lambda, once; a pair counts only in the order in which blocks are found.
        pair = F.filter(F.array(F.struct(first.last().alias("a"), second.last().alias("b"))), lambda p: F.coalesce(p["a"]["pos"] < p["b"]["pos"], F.lit(False)))
        return F.flatten(F.transform(pair, lambda p: result(self.verifier_id, F.array(p["a"]["id"], p["b"]["id"]), self.check(p["a"], p["b"]), self.between)))


def _told(check: Callable[[dict], list[str] | None]):
    """What a function says on each block (a dictionary), and how it failed where it did."""

    @F.pandas_udf("array<struct<messages:array<string>,error:string>>")
    def each(rows: pd.Series) -> pd.Series:
        def one(block: str) -> dict:
            try:
                found = check(json.loads(block))
                return {"messages": None if found is None else [str(m) for m in found], "error": None}
            except Exception as error:  # noqa: BLE001: whatever a user's check raises is a result
                return {"messages": None, "error": str(error) or type(error).__name__}

        return pd.Series([[one(b) for b in bs] for bs in rows], dtype=object)

    return each


def _blocks(prefix: str, own: dict[str, checks.Check], role: str, without: tuple[str, ...] = (), only: tuple[str, ...] | None = None, between: str = " ") -> list[Step]:
    return [Step(f"{prefix}.{n}", "block", (role,), c, between) for n, c in own.items() if n not in without and (only is None or n in only)]


def _switched(check: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Argdown blocks are found before xml blocks; the checks name the annotation first."""
    return lambda a, b: check(b, a)


ANNO_STEPS = _blocks("Arganno", checks.ANNOTATION, "arganno")
MAP_STEPS = _blocks("ArgMap", checks.MAP, "argmap")
RECO_STEPS = _blocks("InfReco", checks.RECONSTRUCTION, "infreco")
LOGIC_STEPS = [replace(s, between=" - " if "WellFormed" in s.verifier_id else " ") for s in _blocks("LogReco", LOGIC_CHECKS, "infreco")]
#: The reconstruction checks that compound tasks use.
NINE = ("HasArgumentsHandler", "HasPCSHandler", "StartsWithPremiseHandler", "EndsWithConclusionHandler", "NoDuplicatePCSLabelsHandler", "HasLabelHandler", "HasInferenceDataHandler", "PropRefsExistHandler", "UsesAllPropsHandler")
NINE_STEPS = _blocks("InfReco", checks.RECONSTRUCTION, "infreco", only=NINE)


def _several_steps(n: int) -> list[Step]:
    """NINE with at least n arguments instead of one, and no propositions outside."""
    rest = tuple(x for x in NINE if x != "HasArgumentsHandler")
    return [Step("InfReco.HasAtLeastNArgumentsHandler", "block", ("infreco",), checks.at_least(n)), *_blocks("InfReco", checks.RECONSTRUCTION, "infreco", only=(*rest, "NoExtraPropositionsHandler"))]


HAS_ANNO = [Step("HasAnnotationsHandler", "has", ("arganno",), checks.has_annotations)]
HAS_MAP = [Step("HasArgdownHandler", "has", ("argmap",), checks.has_argdown)]
HAS_RECO = [Step("HasArgdownHandler", "has", ("infreco",), checks.has_argdown)]
HAS_BOTH = [replace(HAS_MAP[0], verifier_id="HasArgdownHandler.map"), replace(HAS_RECO[0], verifier_id="HasArgdownHandler.reco")]


def _pair(name: str, first: str, second: str, check: Callable[[Column, Column], Column], between: str) -> Step:
    return Step(name, "pair", (first, second), check, between)


ANNO_MAP = [_pair("ArgannoArgmap.ElemCohereHandler", "argmap", "arganno", _switched(coherence.annotation_map_elements), " "), _pair("ArgannoArgmap.DRelCohereHandler", "argmap", "arganno", _switched(coherence.annotation_map_relations), " ")]
ANNO_RECO = [_pair("ArgannoInfreco.ElemCohereHandler", "infreco", "arganno", _switched(coherence.annotation_reconstruction_elements), " - "), _pair("ArgannoInfreco.RelationCohereHandler", "infreco", "arganno", _switched(coherence.annotation_reconstruction_relations), " - ")]
ANNO_LOGIC = [replace(s, verifier_id=s.verifier_id.replace("Infreco", "Logreco")) for s in ANNO_RECO]
MAP_RECO = [_pair("ArgmapInfreco.ElemCohereHandler", "argmap", "infreco", coherence.same_labels, " - "), Step("ArgmapInfreco.RelationCohereHandler", "apart", ("argmap", "infreco"), coherence.map_reconstruction_relations, " - ")]
MAP_LOGIC = [_pair("ArgmapLogreco.ElemCohereHandler", "argmap", "infreco", coherence.same_labels, " - "), _pair("ArgmapLogreco.RelationCohereHandler", "argmap", "infreco", coherence.map_logic_relations, " - ")]


def parse_results() -> Column:
    """Results on argdown blocks that can't be read; those that can have none."""
    broken = F.filter("blocks", lambda b: b["error"].isNotNull())
    said = lambda b: F.concat(F.when(b["dtype"] == "xml", "Failed to parse XML code snippet: ").otherwise("Failed to parse argdown code snippet: "), b["error"])
    return F.transform(broken, lambda b: F.struct(F.when(b["dtype"] == "xml", "XMLParser").otherwise("ArgdownParser").alias("verifier_id"), F.array(b["id"]).alias("refs"), F.lit(False).alias("is_valid"), said(b).alias("message"))).cast(RESULT)


@dataclass(frozen=True)
class Verifier:
    """A plan: roles with their usual blocks, steps in order, scores of valid requests, and whether formulas are needed."""

    name: str
    description: str
    roles: dict[str, Role]
    steps: list[Step]
    scorers: dict[str, Callable[[dict[str, Column], Column], Column]] = field(default_factory=dict)
    logic: bool = False
    options: dict[str, object] = field(default_factory=lambda: {"from_key": "from", "formalization_key": "formalization", "declarations_key": "declarations", "levenshtein_tolerance": TOLERANCE, "allow_source_text_shortening_wc_threshold": SHORTENING_FROM})

    def results(self, inputs: str = "inputs") -> Column:
        return F.concat(parse_results(), *[s.results(self.roles, inputs) for s in self.steps])


def is_valid(results: Column) -> Column:
    """All results are; no results are too."""
    return F.forall(results, lambda r: r["is_valid"])


def merged(first: Column, second: Column) -> Column:
    """The results of two parts of a request, one after the other."""
    return F.concat(first, second)


ALL_MAP_RECO = {"argmap": _file("map"), "infreco": _file("reconstructions")}
_anno = lambda f: lambda r, source: f(r["arganno"])
_anno_source = lambda f: lambda r, source: f(r["arganno"], source)
_map, _map_source = (lambda f: lambda r, source: f(r["argmap"])), (lambda f: lambda r, source: f(r["argmap"], source))
_reco, _reco_source = (lambda f: lambda r, source: f(r["infreco"])), (lambda f: lambda r, source: f(r["infreco"], source))
_anno_with = lambda f, other: lambda r, source: f(r["arganno"], r[other])


def _anno_scorers(prefix: str) -> dict:
    return {f"{prefix}_scope_scorer": _anno(scores.scope_scorer), f"{prefix}_density_scorer": _anno(scores.annotation_density_scorer), f"{prefix}_coverage_scorer": _anno(scores.coverage_scorer)}


def _map_scorers(prefix: str) -> dict:
    return {f"{prefix}_size_scorer": _map(scores.size_scorer), f"{prefix}_density_scorer": _map(scores.map_density_scorer), f"{prefix}_faithfulness_scorer": _map_source(scores.faithfulness_scorer)}


def _reco_scorers(prefix: str) -> dict:
    return {f"{prefix}_subarguments_scorer": _reco(scores.subarguments_scorer), f"{prefix}_premises_scorer": _reco(scores.premises_scorer), f"{prefix}_faithfulness_scorer": _reco_source(scores.faithfulness_scorer)}


def _logic_scorers(prefix: str) -> dict:
    return {f"{prefix}_formalizations_faithfulness_scorer": _reco(scores.logic_faithfulness), f"{prefix}_predicate_logic_scorer": _reco(scores.logic_predicate_logic), f"{prefix}_triviality_scorer": _reco(scores.triviality_scorer)}


_RECO_MINUS_DATA = [s for s in RECO_STEPS if not s.verifier_id.endswith("NoPropInlineDataHandler")]
_BARE = {"arganno": ANNO, "argmap": ARGDOWN, "infreco": ARGDOWN}
_NAMED = {"arganno": _file("annotation", "xml"), "argmap": _file("map"), "infreco": _file("reconstruction")}


def _verifiers() -> dict[str, Verifier]:
    pick = lambda roles, *names: {n: roles[n] for n in names}
    rows = [
        Verifier("arganno", "Annotations of a source text", pick(_BARE, "arganno"), HAS_ANNO + ANNO_STEPS, _anno_scorers("annotation")),
        Verifier("argmap", "Argument maps", pick(_BARE, "argmap"), HAS_MAP + MAP_STEPS, _map_scorers("argmap")),
        Verifier("infreco", "Informal reconstructions", pick(_BARE, "infreco"), HAS_RECO + RECO_STEPS, _reco_scorers("infreco")),
        Verifier("logreco", "Logical reconstructions", pick(_BARE, "infreco"), HAS_RECO + _RECO_MINUS_DATA + LOGIC_STEPS, _reco_scorers("logreco") | _logic_scorers("logreco"), True),
        Verifier("arganno_argmap", "Annotation and map", pick(_BARE, "arganno", "argmap"), HAS_ANNO + HAS_MAP + ANNO_STEPS + MAP_STEPS + ANNO_MAP, _anno_scorers("annotation_argmap") | {"annotation_argmap_semantic_coherence_scorer": _anno_with(scores.semantic_coherence_map, "argmap")}),
        Verifier("arganno_infreco", "Annotation and informal reconstruction", pick(_BARE, "arganno", "infreco"), HAS_ANNO + HAS_RECO + ANNO_STEPS + NINE_STEPS + ANNO_RECO, _anno_scorers("annotation_infreco") | {"annotation_infreco_semantic_coherence_scorer": _anno_with(scores.semantic_coherence_reconstruction, "infreco")}),
        Verifier("arganno_logreco", "Annotation and logical reconstruction", pick(_BARE, "arganno", "infreco"), HAS_ANNO + HAS_RECO + ANNO_STEPS + NINE_STEPS + LOGIC_STEPS + ANNO_LOGIC, _anno_scorers("annotation_logreco") | _logic_scorers("annotation_logreco") | {"annotation_logreco_semantic_coherence_scorer": _anno_with(scores.semantic_coherence_reconstruction, "infreco")}, True),
        Verifier("argmap_infreco", "Map and informal reconstructions", pick(_NAMED, "argmap", "infreco"), HAS_BOTH + MAP_STEPS + NINE_STEPS + MAP_RECO, _map_scorers("argmap_infreco")),
        Verifier("argmap_logreco", "Map and logical reconstructions", pick(_NAMED, "argmap", "infreco"), HAS_BOTH + MAP_STEPS + _several_steps(2) + LOGIC_STEPS + MAP_RECO + MAP_LOGIC, _map_scorers("argmap_logreco"), True),
        Verifier("arganno_argmap_logreco", "Annotation, map and logical reconstructions", _NAMED, HAS_ANNO + HAS_BOTH + ANNO_STEPS + MAP_STEPS + _several_steps(2) + LOGIC_STEPS + ANNO_MAP + ANNO_LOGIC + MAP_LOGIC, _anno_scorers("annotation_argmap_logreco"), True),
        Verifier("has_annotations", "There are annotations", pick(_BARE, "arganno"), HAS_ANNO),
        Verifier("has_argdown", "There is Argdown code", pick(_BARE, "argmap"), HAS_MAP),
    ]
    return {v.name: v for v in rows}


VERIFIERS = _verifiers()
_EXACT = {"arganno": Role("xml", (("filename", "annotation.txt", False),)), "argmap": Role("argdown", (("filename", "map.ad", False),)), "infreco": Role("argdown", (("filename", "reconstructions.ad", False),))}
#: Plans by task: what the judges of answers look at.
JUDGES = {
    "annotation": VERIFIERS["arganno"],
    "argmap": VERIFIERS["argmap"],
    "infreco": replace(VERIFIERS["infreco"], steps=HAS_RECO + [s for s in RECO_STEPS if not s.verifier_id.endswith("UsesAllPropsHandler")]),
    "logreco": VERIFIERS["logreco"],
    "argmap_plus_arganno": VERIFIERS["arganno_argmap"],
    "arganno_plus_infreco": VERIFIERS["arganno_infreco"],
    "arganno_plus_logreco": VERIFIERS["arganno_logreco"],
    "argmap_plus_infreco": replace(VERIFIERS["argmap_infreco"], roles=ALL_MAP_RECO),
    "argmap_plus_logreco": replace(VERIFIERS["argmap_logreco"], roles=ALL_MAP_RECO),
    "argmap_plus_arganno_plus_logreco": replace(VERIFIERS["arganno_argmap_logreco"], roles=_EXACT),
}


def register_verifier(verifier: Verifier) -> None:
    VERIFIERS[verifier.name] = verifier


def register_check(verifier: str, name: str, check: checks.Check, role: str | None = None) -> None:
    """Add a check of blocks in a role (the first one) to a verifier."""
    plan = get_verifier(verifier)
    VERIFIERS[verifier] = replace(plan, steps=[*plan.steps, Step(name, "block", (role or next(iter(plan.roles)),), check)])


def register_function(verifier: str, name: str, function: Callable[[dict], list[str] | None], role: str | None = None) -> None:
    """Add a Python function of a block (as a dictionary) that gives messages, none if all is well, or None if it has nothing to say. Where it raises, the
    block gets an invalid result `Processing error: ...`; other checks, blocks and rows go on."""
    plan = get_verifier(verifier)
    VERIFIERS[verifier] = replace(plan, steps=[*plan.steps, Step(name, "function", (role or next(iter(plan.roles)),), function)])


def executed(plan: Verifier) -> list[str]:
    """The names of a plan's steps, in the order in which they are evaluated."""
    return [s.verifier_id for s in plan.steps]


def register_score(verifier: str, name: str, score: Callable[[dict[str, Column], Column], Column]) -> None:
    """Add a score; it gets the last block of each role and the source."""
    plan = get_verifier(verifier)
    VERIFIERS[verifier] = replace(plan, scorers=plan.scorers | {name: score})


def get_verifier(name: str) -> Verifier:
    if name not in VERIFIERS:
        raise VerifierNotFoundError(f"no verifier '{name}'; there are {', '.join(sorted(VERIFIERS))}")
    return VERIFIERS[name]


def list_verifiers(spark: SparkSession) -> DataFrame:
    """name, description, roles, options, scorers of every verifier."""
    return spark.createDataFrame([_info(v) for v in VERIFIERS.values()], "name string, description string, roles array<string>, options array<string>, scorers array<string>")


def _info(v: Verifier) -> tuple:
    return v.name, v.description, list(v.roles), list(v.options), list(v.scorers)


def verifier_info(name: str) -> dict[str, object]:
    return dict(zip(("name", "description", "roles", "options", "scorers"), _info(get_verifier(name)), strict=True))


def validate_config(verifier: Verifier, config: dict[str, object]) -> None:
    """Options are known and of the right type; a scorer is switched by enable_<scorer>."""
    for key, value in config.items():
        usual = True if key.removeprefix("enable_") in verifier.scorers and key.startswith("enable_") else verifier.options.get(key)
        if usual is None:
            raise InvalidConfigError(f"'{verifier.name}' has no option '{key}'")
        if not isinstance(value, type(usual)):
            raise InvalidConfigError(f"option '{key}' must be of type {type(usual).__name__}")


def validate_filters(verifier: Verifier, filters: dict[str, object]) -> dict[str, tuple[Rule, ...]]:
    """Rules by role; {key: value} stands for one rule that asks for equality."""
    out = {}
    for role, rules in filters.items():
        if role not in verifier.roles:
            raise InvalidFilterError(f"'{verifier.name}' has no role '{role}'; there are {', '.join(verifier.roles)}")
        if isinstance(rules, dict):
            rules = [{"key": k, "value": v} for k, v in rules.items()]
        try:
            found = tuple((str(r["key"]), str(r["value"]), bool(r.get("regex", False))) for r in rules)
            for _, pattern, is_pattern in found:
                if is_pattern:
                    re.compile(pattern)
        except (KeyError, TypeError, AttributeError, re.error) as error:
            raise InvalidFilterError(f"a rule of '{role}' can't be read: {error}") from error
        out[role] = found
    return out


def _with_filters(plan: Verifier, filters: dict[str, object]) -> Verifier:
    """The plan with these rules; of a plan with several roles they count only if all are given."""
    rules = validate_filters(plan, filters)
    if not rules or len(plan.roles) > 1 and set(rules) != set(plan.roles):
        return plan
    return replace(plan, roles={n: Role(r.dtype, rules.get(n, r.rules)) for n, r in plan.roles.items()})


def _with_keys(plan: Verifier, keys: Keys) -> Verifier:
    """The plan whose messages name these keys."""
    own = {"HasInferenceDataHandler": lambda: checks.inference_data(keys.inference), "WellFormedFormulasHandler": lambda: well_formed(keys)}
    made = lambda s: next((replace(s, check=f()) for n, f in own.items() if s.verifier_id.endswith(n)), s)
    return plan if keys == KEYS else replace(plan, steps=[made(s) for s in plan.steps])


def verify(requests: DataFrame, name: str, config: dict[str, object] | None = None, filters: dict[str, object] | None = None, key: str = "request_id", inputs: str = "inputs", source: str | None = None) -> DataFrame:
    """key, verifier, is_valid, results, scores (name, score) of every request; only valid requests are scored."""
    plan, config = get_verifier(name), config or {}
    validate_config(plan, config)
    plan = _with_filters(plan, filters or {})
    keys = Keys(*[str(config.get(o, k)) for o, k in zip(("from_key", "formalization_key", "declarations_key"), KEYS, strict=True)])
    plan = _with_keys(plan, keys)
    integrity = float(config.get("levenshtein_tolerance", TOLERANCE)), int(config.get("allow_source_text_shortening_wc_threshold", SHORTENING_FROM))
    wanted = {n: s for n, s in plan.scorers.items() if config.get(f"enable_{n}", True)}
    bare = not wanted and all(s.kind == "has" for s in plan.steps)
    read = extraction.read(requests, key, inputs, source, keys, plan.logic, integrity=integrity, bare=bare)
    out = read.withColumn("results", plan.results(inputs)).withColumn("is_valid", is_valid(F.col("results")))
    last, given = {r: role.last() for r, role in plan.roles.items()}, F.col(source) if source else F.lit(None).cast("string")
    out = out.select("*", *[F.when(F.col("is_valid"), s(last, given)).alias(f"_{n}") for n, s in wanted.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{n}").cast("double").alias("score")) for n in wanted]) if wanted else F.array().cast("array<struct<name:string,score:double>>")
    return out.select(key, F.lit(name).alias("verifier"), "is_valid", "results", F.filter(rows, lambda s: s["score"].isNotNull()).alias("scores"))


def rows_of(verified: DataFrame, key: str = "request_id") -> DataFrame:
    """One row for each result: key, ord, verifier_id, refs, is_valid, message."""
    return verified.select(key, F.posexplode("results").alias("ord", "r")).select(key, "ord", "r.*")


def metrics(results: Column) -> Column:
    """Numbered results, as in 01_InfReco.HasArgumentsHandler; the message is empty where nothing is wrong."""
    return F.transform(results, lambda r, i: F.struct(F.concat(F.lpad((i + 1).cast("string"), 2, "0"), F.lit("_"), r["verifier_id"]).alias("key"), F.coalesce(r["message"], F.lit("")).alias("message"), r["is_valid"].alias("is_valid")))


def judge(solutions: DataFrame, name: str, answer: str = "raw_answer", source: str | None = None, key: str = "sol_pos") -> DataFrame:
    """solutions with is_valid, metrics, and artifacts: the last snippet of each role. The sources must be those of the problems."""
    if name not in JUDGES:
        raise VerifierNotFoundError(f"no judge '{name}'; there are {', '.join(sorted(JUDGES))}")
    missing = [c for c in (answer, key, *([source] if source else [])) if c not in solutions.columns]
    if missing:
        raise InvalidConfigError(f"solutions lack {', '.join(missing)}")
    if {"original_sol_pos", "feedback_pos"} & set(solutions.columns) == {"original_sol_pos"}:
        raise InvalidConfigError("Feedback is required for evaluating revised solutions")
    plan = JUDGES[name]
    artifacts = F.struct(*[role.last()["snippet"].alias(r) for r, role in plan.roles.items()])
    # Nothing of this names the solution, so that solutions with the same text share it; results are bound once, by the lambda.
    judged = F.get(F.transform(F.array(plan.results(answer)), lambda r: F.struct(is_valid(r).alias("is_valid"), metrics(r).alias("metrics"))), F.lit(0)).alias("_judged")
    read = extraction.read(solutions, key, answer, source, logic=plan.logic, ids=False, then=lambda _: [judged, artifacts.alias("_artifacts")])
    return read.select(*solutions.columns, "_judged.is_valid", "_judged.metrics", F.col("_artifacts").alias("artifacts"))


@dataclass(frozen=True)
class Request:
    """A verification put together step by step: Request("infreco").option("from_key", "uses").filter("infreco", "filename", "reco.*", True).run(df)."""

    verifier: str
    options: dict[str, object] = field(default_factory=dict)
    filters: dict[str, list[dict]] = field(default_factory=dict)
    source_column: str | None = None

    def option(self, key: str, value: object) -> Request:
        return replace(self, options=self.options | {key: value})

    def filter(self, role: str, key: str, value: str, regex: bool = False) -> Request:
        return replace(self, filters=self.filters | {role: [*self.filters.get(role, []), {"key": key, "value": value, "regex": regex}]})

    def source(self, column: str) -> Request:
        return replace(self, source_column=column)

    def run(self, requests: DataFrame, key: str = "request_id", inputs: str = "inputs") -> DataFrame:
        return verify(requests, self.verifier, self.options, self.filters, key, inputs, self.source_column)
