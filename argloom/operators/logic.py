"""What the formulas of a reconstruction say, and the checks of it, as columns.

A block's `logic` holds its items with their formulas, the meanings that are declared, and the answers on its arguments and relations; all of
it is joined from the tables of `inference`, where each distinct formula and argument stands once. Checks give messages, as in `checks`; they are
null where there are no formulas or no declarations. What is neither shown nor refuted has a message that says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from argloom.functions.formulas import SORT
from argloom.functions.reading import KEYS, Keys

from .checks import Check, among, arguments, claims, every, references, relations, strings, text
from .inference import FORMULA, VERDICT, key_of, names, worded

_ITEM = f"struct<argument:string,label:string,proposition:string,is_conclusion:boolean,data:string,formalization:string,kind:string,declarations:array<struct<symbol:string,meaning:string>>,formula:{FORMULA}>"
_WORDED = "struct<proposition:string,formula:string,latex:string,smt:string,english:string,symbols:array<string>,propositional:boolean>"
LOGIC = f"struct<items:array<{_ITEM}>,declared:array<struct<symbol:string,meaning:string>>,found:array<struct<proposition:string,formula:{FORMULA}>>,denied:map<string,{FORMULA}>,verdicts:map<string,{VERDICT}>,formulas:array<{_WORDED}>>"


def _find(items: Column, field: str, value: Column) -> Column:
    return F.get(F.filter(items, lambda x: x[field] == value), F.lit(0))


def _denial(formalization: Column) -> Column:
    return F.concat(F.lit("-("), formalization, F.lit(")"))


def _stated(b: Column) -> Column:
    """Labels of propositions at the end of declared relations."""
    return F.transform(F.filter(relations(b), lambda r: among(F.lit("AXIOMATIC"), r["dialectics"])), lambda r: r["target"])


def texts_of(b: Column) -> Column:
    """All formulas of a block as texts, and the denials that its relations need."""
    own = F.filter(claims(b), lambda p: F.coalesce(p["formalization"], F.lit("")) != "")
    denied = F.filter(own, lambda p: among(p["label"], _stated(b)))
    return F.coalesce(F.concat(F.transform(own, lambda p: p["formalization"]), F.transform(denied, lambda p: _denial(p["formalization"]))), strings())


def with_items(b: Column, known: Column) -> Column:
    """First part of a block's logic: items with the data of their propositions, and their formulas."""

    def item(a: Column, x: Column) -> Column:
        p = _find(claims(b), "label", x["proposition"])
        good = (p["data"] == "dict") & (F.coalesce(p["formalization"], F.lit("")) != "")
        return F.struct(a["label"].alias("argument"), x["label"].alias("label"), x["proposition"].alias("proposition"), x["is_conclusion"].alias("is_conclusion"), p["data"].alias("data"), p["formalization"].alias("formalization"), p["declarations_kind"].alias("kind"), p["declarations"].alias("declarations"), F.when(good, F.try_element_at(known, p["formalization"])).alias("formula"))

    return F.flatten(F.transform(arguments(b), lambda a: F.transform(a["pcs"], lambda x: item(a, x))))


def declared_in(items: Column) -> Column:
    """Symbols with the first meaning that is declared for them."""
    all_ = F.flatten(F.transform(F.filter(items, lambda x: x["data"] == "dict"), lambda x: F.coalesce(x["declarations"], F.array().cast("array<struct<symbol:string,meaning:string>>"))))
    return F.transform(F.array_distinct(F.transform(all_, lambda d: d["symbol"])), lambda s: _find(all_, "symbol", s))


def found_in(items: Column) -> Column:
    """Propositions with a sound formula, in order of the items."""
    good = F.filter(items, lambda x: x["formula"].isNotNull() & x["formula"]["error"].isNull())
    return F.transform(F.array_distinct(F.transform(good, lambda x: x["proposition"])), lambda p: F.struct(p.alias("proposition"), _find(good, "proposition", p)["formula"].alias("formula")))


def denied_in(b: Column, found: Column, known: Column) -> Column:
    """Negations of the propositions at the end of declared relations."""
    own = F.filter(found, lambda f: among(f["proposition"], _stated(b)))
    return F.map_from_entries(F.transform(own, lambda f: F.struct(f["proposition"], F.try_element_at(known, _denial(_find(claims(b), "label", f["proposition"])["formalization"])))))


def _of(b: Column, x: Column) -> Column:
    """The formula of an item, or null."""
    return _find(b["logic"]["found"], "proposition", x["proposition"])["formula"]


def _with_formula(b: Column, items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.struct(x["label"].alias("label"), _of(b, x).alias("formula"))), lambda x: x["formula"].isNotNull())


def _premises(b: Column, a: Column) -> Column:
    return _with_formula(b, F.filter(a["pcs"], lambda x: ~x["is_conclusion"]))


def _end(b: Column, a: Column) -> Column:
    """The last item, if it is a conclusion with a formula: an array of one, or of none."""
    return _with_formula(b, F.filter(F.slice(a["pcs"], F.lit(-1), F.least(F.size(a["pcs"]), F.lit(1))), lambda x: x["is_conclusion"]))


def _grounds(b: Column, a: Column, c: Column) -> Column:
    """The items that a conclusion is inferred from, as far as they have formulas."""
    said = F.array_distinct(F.transform(references(c), lambda r: r["label"]))
    return F.filter(F.transform(said, lambda r: F.struct(r.alias("label"), _of(b, F.try_element_at(F.filter(a["pcs"], lambda x: x["label"] == r), F.lit(-1))).alias("formula"))), lambda x: x["formula"].isNotNull())


def _formulas(items: Column) -> Column:
    return F.transform(items, lambda x: x["formula"])


def _case(premises: Column, conclusion: Column) -> Column:
    return F.struct(premises.alias("premises"), conclusion.alias("conclusion"))


_NO_CASES = f"array<struct<premises:array<{FORMULA}>,conclusion:{FORMULA}>>"


def cases_of(b: Column) -> Column:
    """All arguments that the checks of a block ask about."""
    none = F.array().cast(_NO_CASES)
    fact = lambda s: _find(b["logic"]["found"], "proposition", s)["formula"]
    denied = lambda t: F.try_element_at(b["logic"]["denied"], t)

    def of_argument(a: Column) -> Column:
        premises, end = _formulas(_premises(b, a)), _formulas(_end(b, a))
        whole = F.when(F.size(premises) > 0, F.array(_case(premises, F.coalesce(F.get(end, F.lit(0)), F.get(premises, F.lit(0)))))).otherwise(none)
        steps = F.transform(F.filter(a["pcs"], lambda c: c["is_conclusion"]), lambda c: _case(_formulas(_grounds(b, a, c)), _of(b, c)))
        return F.concat(whole, F.filter(steps, lambda c: (F.size(c["premises"]) > 0) & c["conclusion"].isNotNull()))

    def of_relation(r: Column) -> Column:
        s, t, no = fact(r["source"]), fact(r["target"]), denied(r["target"])
        both = F.array(_case(F.array(s), no), _case(F.array(no), s))
        return F.when(s.isNull() | t.isNull(), none).when(r["valence"] == "SUPPORT", F.array(_case(F.array(s), t))).when(r["valence"] == "ATTACK", F.array(_case(F.array(s), no))).otherwise(both)

    stated = F.filter(relations(b), lambda r: among(F.lit("AXIOMATIC"), r["dialectics"]))
    out = F.concat(F.flatten(F.transform(arguments(b), of_argument)), F.flatten(F.transform(stated, of_relation)))
    return F.when(_looked_at(b), out).otherwise(none)


def worded_in(found: Column, declared: Column) -> Column:
    """Sound formulas in their syntaxes and in English."""
    meaning = F.map_from_entries(declared)

    def row(f: Column) -> Column:
        x = f["formula"]
        return F.struct(f["proposition"].alias("proposition"), x["plain"].alias("formula"), x["latex"].alias("latex"), x["smt"].alias("smt"), worded(x, meaning).alias("english"), names(x).alias("symbols"), F.exists(x["occurrences"], lambda o: o["arity"] == 0).alias("propositional"))

    return F.transform(found, row)


# Checks


def _looked_at(b: Column) -> Column:
    return F.coalesce((F.size(b["logic"]["found"]) > 0) & (F.size(b["logic"]["declared"]) > 0), F.lit(False))


def _judged(messages: Check) -> Check:
    return lambda b: F.when(_looked_at(b), messages(b))


def well_formed(keys: Keys = KEYS) -> Check:
    """Every item has a formula that can be read, every symbol is declared, once, and every declared symbol is used."""

    def of(b: Column) -> Column:
        logic = b["logic"]
        declared, found = logic["declared"], logic["found"]

        def of_item(x: Column) -> Column:
            where = text("roposition (", x["label"], ") in argument <", x["argument"], ">")
            own = F.coalesce(x["declarations"], F.array().cast("array<struct<symbol:string,meaning:string>>"))
            before = lambda d: _find(declared, "symbol", d["symbol"])["meaning"]
            twice = F.transform(F.filter(own, lambda d: before(d) != d["meaning"]), lambda d: text("Duplicate declaration: Variable '", d["symbol"], "' in the inline yaml of p", where, " has been declared before and is inconsistent with the previous declaration '", before(d), "'."))
            unread = text("Formalization ", x["formalization"], " of p", where, " is not a well-formed first-order logic formula. Parser error: ", x["formula"]["error"])
            unused = F.transform(F.filter(own, lambda d: ~among(d["symbol"], names(x["formula"]))), lambda d: text("Variable '", d["symbol"], "' declared with p", where, " is not used in the corresponding formalization '", x["formalization"], "'."))
            said = F.concat(
                F.when(x["formalization"].isNull(), strings(text("Inline yaml of p", where, f" lacks {keys.formalization} key."))).otherwise(strings()),
                F.when(x["kind"] == "other", strings(text(f"'{keys.declarations}' of p", where, " is not a dict."))).otherwise(strings()), twice,
                F.when(x["formula"].isNull(), strings()).when(x["formula"]["error"].isNotNull(), strings(unread)).otherwise(unused),
            )
            return F.when(x["data"].isNull(), strings(text("P", where, " lacks inline yaml data with formalization info."))).when(x["data"] != "dict", strings(text("P", where, " lacks properly format inline yaml data."))).otherwise(said)

        known = F.transform(declared, lambda d: d["symbol"])
        used = F.array_distinct(F.flatten(F.transform(found, lambda f: names(f["formula"]))))
        undeclared = every(found, lambda f: F.transform(F.array_except(names(f["formula"]), known), lambda s: text("Variable '", s, "' in formalization '", f["formula"]["plain"], "' of proposition [", f["proposition"], "] is not declared anywhere.")))
        idle = F.transform(F.array_except(known, used), lambda s: text("Variable '", s, "' declared is not used in any formalization."))
        return F.concat(every(logic["items"], of_item), undeclared, idle)

    return of


def program_of(premises: Column, end: Column, declared: Column) -> Column:
    """A program in SMT-LIB that asks whether the conclusion may fail while the premises hold."""
    sizes = F.filter(F.flatten(F.transform(F.concat(premises, F.array(end)), lambda x: x["formula"]["occurrences"])), lambda o: o["arity"] >= 0)
    size = lambda d: F.try_element_at(F.filter(sizes, lambda o: o["symbol"] == d["symbol"]), F.lit(-1))["arity"]
    k, said = (lambda d: d["symbol"]), (lambda d: text(" ;; ", d["meaning"]))
    constant = lambda d: size(d).isNull() & (F.lower(k(d)) == k(d)) & k(d).rlike("[a-z]")
    defined = lambda kind: lambda x: text(f"(define-fun {kind}", x["label"], " () Bool ", x["formula"]["smt"], ")")
    lines = F.concat(
        strings(F.lit(f"(declare-sort {SORT})")), F.transform(F.filter(declared, lambda d: size(d) == 0), lambda d: text("(declare-fun ", k(d), " () Bool)", said(d))),
        F.transform(F.filter(declared, constant), lambda d: text("(declare-const ", k(d), f" {SORT})", said(d))),
        F.transform(F.filter(declared, lambda d: size(d) > 0), lambda d: text("(declare-fun ", k(d), " (", F.array_join(F.array_repeat(F.lit(SORT), size(d)), " "), ") Bool)", said(d))),
        F.transform(premises, defined("premise")), strings(defined("conclusion")(end)),
        strings(text("(define-fun argument () Bool (=> (and ", F.array_join(F.transform(premises, lambda x: text("premise", x["label"])), " "), ") conclusion", end["label"], "))"), F.lit("(assert (not argument))"), F.lit("(check-sat)")),
    )
    return F.array_join(lines, "\n")


def _verdict(b: Column, premises: Column, conclusion: Column) -> Column:
    return F.try_element_at(b["logic"]["verdicts"], key_of(premises, conclusion))


def _head(a: Column) -> Column:
    return text("In ", F.when(a["unlabeled"], "<unlabeled argument>").otherwise(text("<", a["label"], ">")), ": ")


def _told(answer: Column, wanted: bool, wrong: Column, undecided: Column) -> Column:
    """No message if the answer is as wanted, else what is wrong, or that it isn't known."""
    return F.when(answer.isNull(), strings(undecided)).when(answer != F.lit(wanted), strings(wrong)).otherwise(strings())


_SAID = "According to the provided formalizations"
_UNKNOWN = " could not be decided within the bounds of the proof."


def _with_items(b: Column) -> Column:
    return F.filter(arguments(b), lambda a: F.size(a["pcs"]) > 0)


def _whole(b: Column, missing: str, message) -> Column:
    """Messages on each argument that has premises and a conclusion with formulas."""

    def of(a: Column) -> Column:
        premises, end = _premises(b, a), F.get(_end(b, a), F.lit(0))
        flawed = text(_head(a), f"Failed to evaluate {missing} due to missing or flawed formalizations.")
        return F.when((F.size(premises) == 0) | end.isNull(), strings(flawed)).otherwise(message(a, premises, end, _verdict(b, _formulas(premises), end["formula"])))

    return every(_with_items(b), of)


def globally_valid(b: Column) -> Column:
    """All premises together entail the final conclusion."""

    def message(a: Column, premises: Column, end: Column, verdict: Column) -> Column:
        program = text(" SMT2LIB program used to check validity:\n ", program_of(premises, end, b["logic"]["declared"]), "\n")
        return _told(verdict["valid"], True, text(_head(a), _SAID, ", the argument is not deductively valid.", program), text(_head(a), _SAID, ", whether the argument is deductively valid", _UNKNOWN, program))

    return _whole(b, "global deductive validity", message)


def premises_relevant(b: Column) -> Column:
    """No premise can be left out."""

    def message(a: Column, premises: Column, end: Column, verdict: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            others = F.filter(premises, lambda y, j: j != i)
            program = text(" SMT2LIB program used to check validity:\n ", program_of(others, end, b["logic"]["declared"]), "\n")
            head = text(_head(a), _SAID, ", premise (", x["label"], ")")
            return _told(F.get(verdict["spare"], i), False, text(head, " is not required to logically infer the final conclusion.", program), text(head, ": whether it is required to infer the final conclusion", _UNKNOWN, program))

        return F.when(F.size(premises) > 1, F.flatten(F.transform(premises, of))).otherwise(strings())

    return _whole(b, "logical relevance of premises", message)


def premises_consistent(b: Column) -> Column:
    """The premises may be true together."""

    def of(a: Column) -> Column:
        premises = _premises(b, a)
        answer = _verdict(b, _formulas(premises), F.coalesce(F.get(_end(b, a), F.lit(0))["formula"], F.get(premises, F.lit(0))["formula"]))["consistent"]
        said = _told(answer, True, text(_head(a), _SAID, ", the argument's premises are NOT logically consistent."), text(_head(a), _SAID, ", whether the argument's premises are consistent", _UNKNOWN))
        return F.when(F.size(premises) > 0, said).otherwise(strings())

    return every(_with_items(b), of)


def locally_valid(b: Column) -> Column:
    """Every conclusion follows from what it is inferred from."""

    def of(a: Column) -> Column:
        def step(c: Column) -> Column:
            own = _grounds(b, a, c)
            end = F.struct(c["label"].alias("label"), _of(b, c).alias("formula"))
            flawed = text(_head(a), "Failed to evaluate deductive validity of sub-inference to (", c["label"], ") due to missing or flawed formalizations / inference info.")
            program = text(" SMT2LIB program used to check validity of this subargument:\n ", program_of(own, end, b["logic"]["declared"]), "\n")
            head = text(_head(a), _SAID, " and inference info, ")
            said = _told(_verdict(b, _formulas(own), end["formula"])["valid"], True, text(head, "the sub-inference to conclusion (", c["label"], ") is not deductively valid.", program), text(head, "whether the sub-inference to conclusion (", c["label"], ") is deductively valid", _UNKNOWN, program))
            return F.when((F.size(own) == 0) | end["formula"].isNull(), strings(flawed)).otherwise(said)

        return every(F.filter(a["pcs"], lambda c: c["is_conclusion"]), step)

    return every(_with_items(b), of)


def relations_grounded(b: Column) -> Column:
    """Declared relations between propositions with formulas hold between these."""
    fact = lambda s: _find(b["logic"]["found"], "proposition", s)["formula"]

    def of(r: Column) -> Column:
        s, t, no = fact(r["source"]), fact(r["target"]), F.try_element_at(b["logic"]["denied"], r["target"])
        said = text(_SAID, ", proposition '", r["source"], "' ")
        unknown = text(said, "and '", r["target"], "': whether their declared relation holds", _UNKNOWN)
        entails = lambda p, c: _verdict(b, F.array(p), c)["valid"]
        supports = _told(entails(s, t), True, text(said, "does not entail the supported proposition '", r["target"], "'."), unknown)
        attacks = _told(entails(s, no), True, text(said, "does not entail the negation of the attacked proposition '", r["target"], "'."), unknown)
        same = _told(entails(s, no) & entails(no, s), True, text(said, "is not the negation of the proposition '", r["target"], "', despite both being declared as contradictory."), unknown)
        return F.when(s.isNull() | t.isNull(), strings()).when(r["valence"] == "SUPPORT", supports).when(r["valence"] == "ATTACK", attacks).otherwise(same)

    return every(F.filter(relations(b), lambda r: among(F.lit("AXIOMATIC"), r["dialectics"])), of)


LOGIC_CHECKS: dict[str, Check] = {
    "WellFormedFormulasHandler": well_formed(),
    "GlobalDeductiveValidityHandler": _judged(globally_valid),
    "LocalDeductiveValidityHandler": _judged(locally_valid),
    "AllPremisesRelevantHandler": _judged(premises_relevant),
    "PremisesConsistentHandler": _judged(premises_consistent),
    "FormallyGroundedRelationsHandler": _judged(relations_grounded),
}
