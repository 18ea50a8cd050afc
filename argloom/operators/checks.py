"""Checks of annotations, argument maps and reconstructions: each gives the messages on what is wrong with one block of a row, as a column.

An empty array means that the check holds, null that it has nothing to say (no source, no arguments, no formulas). A block is a struct made by
`extraction.read`; checks look at nothing outside of it, so no rows move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.functions.texts import shorten

Check = Callable[[Column], Column]
#: The attributes that propositions may have.
ATTRIBUTES = ("id", "supports", "attacks", "argument_label", "ref_reco_label")
RESULT = "array<struct<verifier_id:string,refs:array<string>,is_valid:boolean,message:string>>"


def strings(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def one(wrong: Column, message: str | Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), strings(F.lit(message) if isinstance(message, str) else message)).otherwise(strings())


def listed(message: str, items: Column, end: str = "") -> Column:
    return one(F.size(items) > 0, text(message, F.array_join(items, ", "), end))


def every(items: Column, of: Callable[[Column], Column]) -> Column:
    """The messages on all items, one after the other."""
    return F.flatten(F.transform(items, of))


def among(value: Column, known: Column) -> Column:
    return F.coalesce(F.array_contains(known, value), F.lit(False))


def repeated(values: Column) -> Column:
    """The distinct values that occur more than once."""
    return F.filter(F.array_distinct(values), lambda x: F.size(F.filter(values, lambda y: y == x)) > 1)


# Annotations


def propositions(b: Column) -> Column:
    return F.filter(b["elements"], lambda e: e["name"] == "proposition")


def ids(b: Column) -> Column:
    return F.filter(F.transform(propositions(b), lambda e: e["id"]), lambda i: F.coalesce(i, F.lit("")) != "")


def _dangling(b: Column, field: str, word: str) -> Column:
    known = ids(b)
    return every(propositions(b), lambda e: F.transform(F.filter(e[field], lambda r: ~among(r, known)), lambda r: text(f"{word} proposition with id '", r, "' in proposition '", e["shown"], "' does not exist.")))


def _attributes(b: Column) -> Column:
    legal = ", ".join(sorted(ATTRIBUTES))
    return every(propositions(b), lambda e: F.transform(F.array_except(e["attributes"], F.array(*map(F.lit, ATTRIBUTES))), lambda a: text("Unknown attribute '", a, "' in proposition '", e["shown"], f"'. Legal attributes are: {legal}")))


def _without_id(b: Column) -> Column:
    return F.transform(F.filter(propositions(b), lambda e: F.coalesce(e["id"], F.lit("")) == ""), lambda e: text("'", e["shown"], "'"))


ANNOTATION: dict[str, Check] = {
    "SourceTextIntegrityHandler": lambda b: b["altered"],
    "NestedPropositionHandler": lambda b: listed("Nested annotations in proposition(s) ", F.transform(F.filter(propositions(b), lambda e: e["nested"]), lambda e: text("'", e["brief"], "'"))),
    "PropositionIdPresenceHandler": lambda b: listed("Missing id in proposition(s) ", _without_id(b)),
    "PropositionIdUniquenessHandler": lambda b: listed("Duplicate ids: ", repeated(F.transform(propositions(b), lambda e: F.coalesce(e["id"], F.lit("None"))))),
    "SupportReferenceValidityHandler": lambda b: _dangling(b, "supports", "Supported"),
    "AttackReferenceValidityHandler": lambda b: _dangling(b, "attacks", "Attacked"),
    "AttributeValidityHandler": _attributes,
    "ElementValidityHandler": lambda b: F.transform(F.filter(b["elements"], lambda e: e["name"] != "proposition"), lambda e: text("Unknown element '", e["name"], "' at '", e["shown"], "'")),
}


def _legal(b: Column, field: str, word: str, labels: Iterable[str] | None) -> Column:
    if labels is None:
        return F.lit(None).cast("array<string>")
    bad = F.filter(propositions(b), lambda e: e[field].isNotNull() & ~e[field].isin(*labels))
    return F.transform(bad, lambda e: text(f"Illegal {word} label '", e[field], "' in proposition '", e["shown"], "'"))


def argument_labels(labels: Iterable[str] | None) -> Check:
    """Argument labels are among the given ones; without any the check has nothing to say."""
    return lambda b: _legal(b, "argument_label", "argument", labels)


def reference_labels(labels: Iterable[str] | None) -> Check:
    return lambda b: _legal(b, "ref_reco_label", "ref_reco", labels)


# Argument maps


def claims(b: Column) -> Column:
    return b["graph"]["propositions"]


def arguments(b: Column) -> Column:
    return b["graph"]["arguments"]


def relations(b: Column) -> Column:
    return b["graph"]["relations"]


def shown(a: Column, nameless: str = "<unlabeled argument>") -> Column:
    return F.when(a["unlabeled"], nameless).otherwise(text("<", a["label"], ">"))


def _unlabeled(b: Column) -> Column:
    return F.transform(F.filter(claims(b), lambda p: p["unlabeled"]), lambda p: F.when(F.size(p["texts"]) == 0, "Empty claim").otherwise(shorten(F.get(p["texts"], F.lit(0)), 40)))


def _several(b: Column) -> Column:
    many = lambda nodes: F.transform(F.filter(nodes, lambda n: ~n["unlabeled"] & (F.size(n["texts"]) > 1)), lambda n: n["label"])
    return F.concat(many(claims(b)), many(arguments(b)))


def _with_items(b: Column) -> Column:
    return F.transform(F.filter(arguments(b), lambda a: F.size(a["pcs"]) > 0), lambda a: shown(a, "<unlabeled_argument>"))


MAP: dict[str, Check] = {
    "CompleteClaimsHandler": lambda b: listed("Missing labels for nodes: ", _unlabeled(b)),
    "NoDuplicateLabelsHandler": lambda b: listed("Duplicate labels: ", _several(b)),
    "NoPCSHandler": lambda b: listed("Found detailed reconstruction of individual argument(s) ", _with_items(b), " as premise-conclusion-structures."),
}


# Reconstructions


def _those(b: Column, wrong: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(arguments(b), lambda a: F.coalesce(wrong(a), F.lit(False))), lambda a: shown(a))


def _numbered(b: Column, wrong: Callable[[Column], Column]) -> Column:
    """Arguments by label, or by their place where they have none."""
    name = lambda a, i: F.when(a["unlabeled"], text("Argument #", i + 1)).otherwise(text("<", a["label"], ">"))
    named = F.transform(arguments(b), lambda a, i: F.when(F.coalesce(wrong(a), F.lit(False)), name(a, i)))
    return F.filter(named, lambda x: x.isNotNull())


def at_least(n: int) -> Check:
    """There are n arguments or more."""
    return lambda b: one(F.size(arguments(b)) < n, text("Not enough arguments (found ", F.size(arguments(b)), f", expected ≥{n})."))


def _unique(b: Column) -> Column:
    n = F.size(arguments(b))
    return one(n != 1, F.when(n > 1, "More than one argument found in the argdown data.").otherwise("No arguments found in the argdown data."))


def labels(items: Column) -> Column:
    return F.transform(items, lambda x: x["label"])


def _duplicates(b: Column) -> Column:
    bad = F.filter(arguments(b), lambda a: F.size(repeated(labels(a["pcs"]))) > 0)
    return F.transform(bad, lambda a: text(shown(a), " (duplicates: ", F.array_join(F.transform(repeated(labels(a["pcs"])), lambda x: text("(", x, ")")), ", "), ")"))


def inference_data(from_key: str = "from") -> Check:
    """Every conclusion comes with a list of what it is inferred from."""
    def of(a: Column) -> Column:
        def message(c: Column) -> Column:
            said = lambda rest: text("In ", shown(a), ": Inference to conclusion ", c["label"], rest)
            return (
                F.when(c["inference"] == "none", said(" lacks properly formatted yaml inference information."))
                .when(c["inference"] == "no key", said(f" inference information lacks '{from_key}' key."))
                .when(c["inference"] == "no list", said(f" inference information '{from_key}' value is not a list."))
                .when(F.size(c["refs"]) == 0, said(f" inference information '{from_key}' value is empty."))
            )

        return F.filter(F.transform(F.filter(a["pcs"], lambda c: c["is_conclusion"]), message), lambda m: m.isNotNull())

    return lambda b: every(arguments(b), of)


def references(item: Column) -> Column:
    return F.coalesce(item["refs"], F.array().cast("array<struct<label:string,is_text:boolean>>"))


def _unknown_references(b: Column) -> Column:
    def of(a: Column) -> Column:
        def missing(c: Column, i: Column) -> Column:
            before = F.slice(labels(a["pcs"]), F.lit(1), i)
            said = lambda r: text("In ", shown(a), ": Item '", r["label"], "' in inference information of conclusion ", c["label"], " does not refer to a previously introduced premise or conclusion.")
            return F.transform(F.filter(references(c), lambda r: ~among(r["label"], before)), said)

        return F.flatten(F.transform(a["pcs"], missing))

    return every(arguments(b), of)


def _unused(a: Column) -> Column:
    """Labels of items but the last that no inference names as text (a number is another value than its text)."""
    used = F.transform(F.filter(F.flatten(F.transform(a["pcs"], references)), lambda r: r["is_text"]), lambda r: r["label"])
    return F.filter(labels(F.slice(a["pcs"], F.lit(1), F.greatest(F.size(a["pcs"]) - 1, F.lit(0)))), lambda x: ~among(x, used))


def _uses_all(b: Column) -> Column:
    bad = F.filter(arguments(b), lambda a: F.size(_unused(a)) > 0)
    return F.transform(bad, lambda a: text("In ", shown(a), ": Some propositions are not explicitly used in any inferences: ", F.array_join(F.transform(_unused(a), lambda x: text("(", x, ")")), ", "), "."))


def _outside(b: Column) -> Column:
    inside = F.flatten(F.transform(arguments(b), lambda a: F.transform(a["pcs"], lambda x: x["proposition"])))
    return F.transform(F.filter(claims(b), lambda p: ~among(p["label"], inside)), lambda p: text("[", p["label"], "]"))


RECONSTRUCTION: dict[str, Check] = {
    "HasArgumentsHandler": lambda b: one(F.size(arguments(b)) == 0, "No arguments found in the argdown data."),
    "HasUniqueArgumentHandler": _unique,
    "HasPCSHandler": lambda b: F.when(F.size(arguments(b)) > 0, listed("The following arguments lack premise conclusion structure: ", _numbered(b, lambda a: F.size(a["pcs"]) == 0))),
    "StartsWithPremiseHandler": lambda b: listed("The following arguments do not start with a premise: ", _those(b, lambda a: F.get(a["pcs"], F.lit(0))["is_conclusion"])),
    "EndsWithConclusionHandler": lambda b: listed("The following arguments do end with a conclusion: ", _those(b, lambda a: ~F.try_element_at(a["pcs"], F.lit(-1))["is_conclusion"])),
    "NotMultipleGistsHandler": lambda b: listed("The following arguments have alternative gists (and are declared multiple times): ", _those(b, lambda a: F.size(a["texts"]) > 1)),
    "NoDuplicatePCSLabelsHandler": lambda b: listed("The following arguments have duplicate premise/conclusion labels: ", _duplicates(b)),
    "HasLabelHandler": lambda b: listed("The following arguments lack labels: ", _numbered(b, lambda a: a["unlabeled"])),
    "HasGistHandler": lambda b: listed("The following arguments lack gists: ", _those(b, lambda a: F.size(a["texts"]) == 0)),
    "HasInferenceDataHandler": inference_data(),
    "PropRefsExistHandler": _unknown_references,
    "UsesAllPropsHandler": _uses_all,
    "NoExtraPropositionsHandler": lambda b: listed("Argdown snippet contains propositions not used in any argument: ", _outside(b), "."),
    "OnlyGroundedDialecticalRelationsHandler": lambda b: one(F.exists(relations(b), lambda r: r["dialectics"] != F.array(F.lit("GROUNDED"))), "Argdown snippet defines dialectical relations."),
    "NoPropInlineDataHandler": lambda b: one(F.exists(claims(b), lambda p: p["data"].isNotNull()), "Some propositions contain yaml inline data."),
    "NoArgInlineDataHandler": lambda b: one(F.exists(arguments(b), lambda a: a["data"].isNotNull()), "Some arguments contain yaml inline data."),
}


# Whole requests


def has_annotations(inputs: Column, found: Column) -> Column:
    """There is an xml block; what the text lacks for one. A closing fence counts only with a line behind it."""
    return _has(inputs, found, "annotations", "xml")


def has_argdown(inputs: Column, found: Column) -> Column:
    return _has(inputs, found, "Argdown code", "argdown")


def _has(inputs: Column, found: Column, what: str, language: str) -> Column:
    inputs = F.coalesce(inputs, F.lit(""))
    opener = F.when(~F.contains(inputs, F.lit(f"```{language}")), f" No fenced code block starting with '```{language}'.").otherwise("")
    closer = F.when(~F.contains(inputs, F.lit("```\n")), " No closing '```'.").otherwise("")
    return one(F.size(found) == 0, text(f"Input data has no properly formatted fenced codeblocks with {what}.", opener, closer))


def result(verifier_id: str, refs: Column, messages: Column, between: str = " ") -> Column:
    """One row's result: an array of one struct, or of none where the check has nothing to say."""
    row = F.struct(F.lit(verifier_id).alias("verifier_id"), refs.alias("refs"), (F.size(messages) == 0).alias("is_valid"), F.when(F.size(messages) > 0, F.array_join(messages, between)).alias("message"))
    return F.when(messages.isNotNull(), F.array(row)).otherwise(F.array()).cast(RESULT)


def has_block(requests: DataFrame, blocks: DataFrame, key: str, dtype: str, check_id: str) -> DataFrame:
    """key, check_id, is_valid of every request: whether one of its blocks is of the type."""
    found = blocks.where(F.col("dtype") == dtype).select(F.col(key).alias("k"), F.lit(True).alias("found")).distinct()
    return requests.select(key).join(found, F.col(key).eqNullSafe(F.col("k")), "left").select(key, F.lit(check_id).alias("check_id"), F.coalesce("found", F.lit(False)).alias("is_valid"))
