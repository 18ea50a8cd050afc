"""Coherence of two blocks of a row: an annotation and a map, an annotation and a reconstruction, a map and a reconstruction.

Both blocks are structs of the same row, so every check is an anti-join between arrays: no rows move. Messages as in `checks`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from argloom.functions.graphs import NEGATIONS, grounding

from .checks import among, arguments, claims, every, ids, labels, propositions, references, relations, strings, text


def _when(wrong: Column, message: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), strings(message)).otherwise(strings())


def _find(items: Column, label: Column) -> Column:
    """The first item with the label, or null."""
    return F.get(F.filter(items, lambda x: x["label"] == label), F.lit(0))


def _annotated(anno: Column) -> Column:
    """source, target, valence of the relations between annotated propositions that exist."""
    known = ids(anno)
    edges = lambda e, field, valence: F.transform(F.filter(e[field], lambda r: among(r, known)), lambda r: F.struct(e["id"].alias("source"), r.alias("target"), F.lit(valence).alias("valence")))
    return F.flatten(F.transform(propositions(anno), lambda e: F.concat(edges(e, "supports", "SUPPORT"), edges(e, "attacks", "ATTACK"))))


def _label_of(anno: Column, own_id: Column) -> Column:
    """The argument label of the (last) proposition with the id."""
    return F.try_element_at(F.filter(propositions(anno), lambda e: e["id"] == own_id), F.lit(-1))["argument_label"]


def _list(items: Column) -> Column:
    return text("[", F.array_join(F.transform(items, lambda x: text("'", x, "'")), ", "), "]")


def annotation_map_elements(anno: Column, graph: Column) -> Column:
    """Annotated propositions name nodes of the map, nodes the annotated propositions, and both the same."""
    nodes = F.concat(_nodes(claims(graph)), _nodes(arguments(graph)))
    known = ids(anno)
    illegal = F.transform(F.filter(propositions(anno), lambda e: ~among(e["argument_label"], labels(nodes))), lambda e: text("Illegal 'argument_label' reference of proposition element with id=", e["id"], ": No node with label '", e["argument_label"], "' in the Argdown argument map."))

    def of(n: Column) -> Column:
        def wrong(i: Column) -> Column:
            own = _label_of(anno, i)
            return F.when(~among(i, known), text("Illegal 'annotation_ids' reference of node with label '", n["label"], "': No proposition element with id='", i, "' in the annotation.")).when(
                ~own.eqNullSafe(n["label"]), text("Label reference mismatch: argument map node with label '", n["label"], "' has annotation_ids=", _list(n["annotation_ids"]), ", but the corresponding proposition element with id=", i, " in the annotation has a different argument_label", F.coalesce(F.concat(F.lit(": "), own), F.lit("")), "."))

        none = F.coalesce(F.size(n["annotation_ids"]), F.lit(0)) <= 0
        return F.when(none, strings(text("Missing 'annotation_ids' attribute of node with label '", n["label"], "'."))).otherwise(F.filter(F.transform(n["annotation_ids"], wrong), lambda m: m.isNotNull()))

    return F.concat(illegal, every(nodes, of))


def _nodes(own: Column) -> Column:
    return F.transform(own, lambda n: F.struct(n["label"].alias("label"), n["annotation_ids"].alias("annotation_ids")))


def annotation_map_relations(anno: Column, graph: Column) -> Column:
    """Annotated relations and those of the map are the same."""
    said = F.transform(_annotated(anno), lambda r: F.struct(r["source"].alias("from_id"), r["target"].alias("to_id"), r["valence"].alias("valence"), _label_of(anno, r["source"]).alias("source"), _label_of(anno, r["target"]).alias("target")))
    same = lambda a, d: d["source"].eqNullSafe(a["source"]) & d["target"].eqNullSafe(a["target"]) & (d["valence"] == a["valence"])
    lost = F.filter(said, lambda a: ~F.exists(relations(graph), lambda d: same(a, d)))
    new = F.filter(relations(graph), lambda d: ~F.exists(said, lambda a: same(a, d)))
    return F.concat(
        F.transform(lost, lambda a: text("Annotated ", a["valence"], " relation ", a["from_id"], " -> ", a["to_id"], " is not matched by any relation in the argument map.")),
        F.transform(new, lambda d: text("Dialectical ", d["valence"], " relation ", d["source"], " -> ", d["target"], " is not matched by any relation in the text annotation.")),
    )


def _labeled(graph: Column) -> Column:
    return F.filter(arguments(graph), lambda a: ~a["unlabeled"])


def annotation_reconstruction_elements(anno: Column, reco: Column) -> Column:
    """Annotated propositions name arguments and their items, items the annotated propositions, and no two propositions the same one."""
    known = ids(anno)

    def of_element(e: Column) -> Column:
        argument = _find(_labeled(reco), e["argument_label"])
        item = _find(argument["pcs"], e["ref_reco_label"])
        own = F.coalesce(_find(claims(reco), item["proposition"])["annotation_ids"], strings())
        illegal = text("Illegal 'argument_label' reference of proposition element with id=", e["id"], ": No argument with label '", e["argument_label"], "' in the Argdown snippet.")
        unknown = text("Illegal 'ref_reco_label' reference of proposition element with id=", e["id"], ": No premise or conclusion with label '", e["ref_reco_label"], "' in argument '", e["argument_label"], "'.")
        other = text("Label reference mismatch: proposition element with id=", e["id"], " in the annotation references (via ref_reco) the proposition '", item["label"], "' of argument '", argument["label"], "', but the annotation_ids=", _list(own), " of that proposition do not include the id=", e["id"], ".")
        looked_at = e["id"].isNotNull() & e["ref_reco_label"].isNotNull() & (F.size(argument["pcs"]) > 0)
        return F.when(argument.isNull(), strings(illegal)).when(~looked_at, strings()).when(item.isNull(), strings(unknown)).when(~among(e["id"], own), strings(other)).otherwise(strings())

    named = F.transform(F.filter(propositions(anno), lambda e: e["id"].isNotNull()), lambda e: e["argument_label"])

    def of_argument(a: Column) -> Column:
        def of_item(x: Column) -> Column:
            own = _find(claims(reco), x["proposition"])["annotation_ids"]
            missing = text("Missing 'annotation_ids' attribute in proposition '", x["label"], "' of argument '", a["label"], "'.")
            dangling = lambda i: text("Illegal 'annotation_ids' reference in proposition '", x["label"], "' of argument '", a["label"], "': No proposition element with id='", i, "' in the annotation.")
            return F.when(own.isNull(), strings(missing)).otherwise(F.transform(F.filter(own, lambda i: ~among(i, known)), dangling))

        free = text("Free floating argument: Argument '", a["label"], "' does not have any corresponding elements in the annotation.")
        return F.concat(_when(~among(a["label"], named), free), every(a["pcs"], of_item))

    def shared(p: Column, i: Column) -> Column:
        own = F.coalesce(p["annotation_ids"], strings())
        later = F.slice(claims(reco), i + 2, F.size(claims(reco)))
        both = lambda q: F.filter(own, lambda x: among(x, q["annotation_ids"]))
        said = lambda q: text("Label reference mismatch: annotation text segment(s) ", F.array_join(F.transform(both(q), lambda x: text("'", x, "'")), ", "), " are referenced by distinct propositions in the Argdown argument reconstruction ('", p["label"], "', '", q["label"], "').")
        return F.transform(F.filter(later, lambda q: F.size(both(q)) > 0), said)

    return F.concat(every(propositions(anno), of_element), every(arguments(reco), of_argument), F.flatten(F.transform(claims(reco), shared)))


def used_for(argument: Column, label: Column) -> Column:
    """Labels of items that the conclusion with the label is inferred from, directly or over other conclusions; cycles end.

    Every turn looks at what the last one found; an argument needs at most as many turns as it has items, and turns with nothing new do nothing."""
    direct = lambda goals: F.array_distinct(F.flatten(F.transform(F.filter(argument["pcs"], lambda x: among(x["label"], goals)), lambda x: labels(references(x)))))
    turn = lambda s, _: F.struct(F.concat(s["found"], s["last"]).alias("found"), F.when(F.size(s["last"]) > 0, F.array_except(direct(s["last"]), F.concat(s["found"], s["last"]))).otherwise(strings()).alias("last"))
    start = F.struct(strings().alias("found"), direct(strings(label)).alias("last"))
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.coalesce(F.size(argument["pcs"]), F.lit(1)), F.lit(1))), start, turn)
    return F.concat(end["found"], end["last"])


def annotation_reconstruction_relations(anno: Column, reco: Column) -> Column:
    """Annotated supports and attacks are found between the arguments, or (supports) within the argument that both are assigned to."""
    element = lambda own_id: F.try_element_at(F.filter(propositions(anno), lambda e: (e["id"] == own_id) & among(e["argument_label"], labels(_labeled(reco)))), F.lit(-1))

    def of(r: Column) -> Column:
        source, target = element(r["source"]), element(r["target"])
        a, b = source["argument_label"], target["argument_label"]
        argument = _find(_labeled(reco), a)
        p = _find(argument["pcs"], source["ref_reco_label"])["proposition"]
        q = _find(_find(_labeled(reco), b)["pcs"], target["ref_reco_label"])["proposition"]
        held = F.exists(relations(reco), lambda d: (d["valence"] == r["valence"]) & F.coalesce((d["source"] == a) | (d["source"] == p), F.lit(False)) & F.coalesce((d["target"] == b) | (d["target"] == q), F.lit(False)))
        support = r["valence"] == "SUPPORT"
        illegal = F.when(support, text("Annotated support relation ", r["source"], " -> ", r["target"], " is not matched by any relation in the reconstruction (illegal argument_labels).")).otherwise(text("Annotated attack relation from ", r["source"], " to ", r["target"], " is not matched by any relation in the reconstruction (illegal argument_labels)."))
        word, verb = F.when(support, " are annotated to support each other, but ").otherwise(" are annotated to attack each other, but "), F.when(support, "] supports <").otherwise("] attacks <")
        lacking = text("Proposition elements ", r["source"], " and ", r["target"], word, "none of the corresponding Argdown elements <", a, ">/[", p, verb, b, "> or [", q, "].")
        within = text("Annotated support relation ", r["source"], " -> ", r["target"], " is not matched by the inferential relations in the argument '", a, "'.")
        never = text("Text segments assigned to the same argument cannot attack each other (", r["source"], " attacks ", r["target"], " while both are assigned to ", a, ").")
        unused = source["ref_reco_label"].isNotNull() & target["ref_reco_label"].isNotNull() & ~among(source["ref_reco_label"], used_for(argument, target["ref_reco_label"]))
        return F.when(a.isNull() | b.isNull(), strings(illegal)).when(a != b, F.when(held, strings()).otherwise(strings(lacking))).when(~support, strings(never)).when(unused, strings(within)).otherwise(strings())

    return every(_annotated(anno), of)


def same_labels(graph: Column, reco: Column) -> Column:
    """Map and reconstruction have the same arguments, and the claims of the map occur in the reconstruction."""
    own, other = F.array_distinct(labels(arguments(graph))), F.array_distinct(labels(arguments(reco)))
    return F.concat(
        F.transform(F.array_except(own, other), lambda x: text("Argument <", x, "> in map is not reconstructed (argument label mismatch).")),
        F.transform(F.array_except(other, own), lambda x: text("Reconstructed argument <", x, "> is not in the map (argument label mismatch).")),
        F.transform(F.array_except(labels(claims(graph)), labels(claims(reco))), lambda x: text("Claim [", x, "] in argument map has no corresponding proposition in reconstructions (proposition label mismatch).")),
    )


def identical(p: Column, q: Column) -> Column:
    """Two propositions with the same label or a text in common."""
    return F.coalesce((p["label"] == q["label"]) | F.arrays_overlap(p["texts"], q["texts"]), F.lit(False))


def contradictory(p: Column, q: Column, graph: Column) -> Column:
    """Two propositions that are declared to attack or contradict each other, or one of which is written as the other's negation."""
    ends = lambda r, x, y: (r["source"] == x["label"]) & (r["target"] == y["label"])
    declared = F.exists(relations(graph), lambda r: r["valence"].isin("ATTACK", "CONTRADICT") & (ends(r, p, q) | ends(r, q, p)))
    negated = lambda x: F.flatten(F.transform(x["texts"], lambda t: F.array(*[text(n, t) for n in NEGATIONS])))
    return F.coalesce((p["label"] != q["label"]) & (declared | F.arrays_overlap(p["texts"], negated(q)) | F.arrays_overlap(q["texts"], negated(p))), F.lit(False))


def strictly_identical(p: Column, q: Column, graph: Column) -> Column:
    """Two propositions with the same label, or declared to support each other."""
    held = lambda a, b: F.exists(relations(graph), lambda r: (r["source"] == a["label"]) & (r["target"] == b["label"]) & (r["valence"] == "SUPPORT") & among(F.lit("AXIOMATIC"), r["dialectics"]))
    return F.coalesce((p["label"] == q["label"]) | held(p, q) & held(q, p), F.lit(False))


def strictly_contradictory(p: Column, q: Column, graph: Column) -> Column:
    """Two propositions with different labels that are declared contradictory, or to attack each other."""
    held = lambda a, b, v: F.exists(relations(graph), lambda r: (r["source"] == a["label"]) & (r["target"] == b["label"]) & (r["valence"] == v) & among(F.lit("AXIOMATIC"), r["dialectics"]))
    return F.coalesce((p["label"] != q["label"]) & (held(p, q, "CONTRADICT") | held(q, p, "CONTRADICT") | held(p, q, "ATTACK") & held(q, p, "ATTACK")), F.lit(False))


def indirectly(source: Column, target: Column, graph: Column, valence: str) -> Column:
    """Whether one node supports (attacks) another, directly or in two steps over a proposition; equal nodes support each other."""
    sign = lambda r: F.when(r["valence"] == "SUPPORT", 1).otherwise(-1)
    want = 1 if valence == "SUPPORT" else -1
    middle = labels(claims(graph))
    direct = F.exists(relations(graph), lambda r: (r["source"] == source) & (r["target"] == target) & (r["valence"] == valence))
    step = lambda r: F.exists(relations(graph), lambda s: (s["source"] == r["target"]) & (s["target"] == target) & (sign(r) * sign(s) == want))
    two = F.exists(relations(graph), lambda r: (r["source"] == source) & among(r["target"], middle) & step(r))
    return F.when(source == target, F.lit(valence == "SUPPORT")).otherwise(direct | two)


def map_reconstruction_relations(graph: Column, reco: Column) -> Column:
    """Relations drawn in the map with an argument at one end are grounded in premises and conclusions of the reconstruction. Looked up in Python, so it can't stand
    in a lambda: nodes are found by label, and an array would be gone through for each of them."""
    drawn = F.filter(relations(graph), lambda d: among(F.lit("SKETCHED"), d["dialectics"]) & d["valence"].isin("SUPPORT", "ATTACK"))
    drawn = F.transform(drawn, lambda d: F.struct(*[d[c].alias(c) for c in ("source", "source_argument", "target", "target_argument", "valence")]))
    return grounding(drawn, claims(reco), arguments(reco), F.filter(relations(reco), lambda r: r["valence"].isin("ATTACK", "CONTRADICT")))


def map_logic_relations(graph: Column, reco: Column) -> Column:
    """Drawn relations of the map are grounded in the reconstruction with the same valence, and grounded ones are in the map, at least over a proposition."""
    nodes = lambda b: F.concat(labels(arguments(b)), labels(claims(b)))
    inside = lambda d, b: among(d["source"], nodes(b)) & among(d["target"], nodes(b))

    def of_map(d: Column) -> Column:
        same = F.filter(relations(reco), lambda r: (r["source"] == d["source"]) & (r["target"] == d["target"]) & (r["valence"] == d["valence"]))
        head = text("Dialectical ", d["valence"], " relation from node '", d["source"], "' to node '", d["target"], "' in argument map is not ")
        return F.when(F.size(same) == 0, text(head, "matched by any relation in the argument reconstruction.")).when(~F.exists(same, lambda r: among(F.lit("GROUNDED"), r["dialectics"])), text(head, "grounded in logical argument reconstructions."))

    def of_reco(d: Column) -> Column:
        word = F.when(d["valence"] == "SUPPORT", "' supports item '").otherwise("' attacks item '")
        held = F.when(d["valence"] == "SUPPORT", indirectly(d["source"], d["target"], graph, "SUPPORT")).otherwise(indirectly(d["source"], d["target"], graph, "ATTACK"))
        return F.when(~held, text("According to the argument reconstructions, item '", d["source"], word, d["target"], "', but this dialectical relation is not captured in the argument map."))

    drawn = F.filter(relations(graph), lambda d: among(F.lit("SKETCHED"), d["dialectics"]) & inside(d, reco))
    grounded = F.filter(relations(reco), lambda d: among(F.lit("GROUNDED"), d["dialectics"]) & d["valence"].isin("SUPPORT", "ATTACK") & inside(d, graph))
    return F.filter(F.concat(F.transform(drawn, of_map), F.transform(grounded, of_reco)), lambda m: m.isNotNull())
