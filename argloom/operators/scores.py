"""Scores of annotations, maps and reconstructions: virtues by which solutions are ranked, and scores between 0 and 1 of valid requests.

Each takes blocks of a row (structs made by `extraction.read`; null gives null) and is a column. Where a mean to be inverted is 0 the score is null.
Distances between texts and shapes of graphs come from batch UDFs, all else are plain expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from argloom.functions.graphs import shapes
from argloom.functions.texts import difference, least_difference, mean_difference, mean_similarity, sentences, similarity

from .checks import _unused, among, arguments, claims, labels, propositions, relations
from .coherence import _annotated, _label_of

Score = Callable[..., Column]


def _sum(items: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.transform(items, of), F.lit(0.0), lambda a, x: a + x)


def _mean(items: Column, of: Callable[[Column], Column]) -> Column:
    """The mean over items; null for none."""
    return F.when(F.size(items) > 0, _sum(items, of) / F.size(items))


def _inverse(x: Column) -> Column:
    return F.when(x > 0, 1 / x)


def _lengths(items: Column) -> Column:
    """The mean length of texts, to the nearest ten (halves to even)."""
    return F.bround(_mean(items, lambda t: F.length(t).cast("double")), -1)


# Annotations


def annotation_scope(anno: Column) -> Column:
    return F.size(propositions(anno)).cast("double")


def annotation_supports(anno: Column) -> Column:
    return _sum(propositions(anno), lambda e: F.size(e["supports"]).cast("double"))


def annotation_attacks(anno: Column) -> Column:
    return _sum(propositions(anno), lambda e: F.size(e["attacks"]).cast("double"))


def annotation_no_attacks(anno: Column) -> Column:
    return 1 / (1 + annotation_attacks(anno))


def annotation_coverage(anno: Column) -> Column:
    """Characters in propositions; those of nested ones count twice."""
    return _sum(propositions(anno), lambda e: F.length(e["text"]).cast("double"))


# Argument maps


def _ends(graph: Column) -> Column:
    """Distinct edges, arguments and claims told apart."""
    name = lambda label, argument: F.concat(F.when(argument, "A:").otherwise("P:"), label)
    return F.array_distinct(F.transform(relations(graph), lambda r: F.struct(name(r["source"], r["source_argument"]).alias("source"), name(r["target"], r["target_argument"]).alias("target"))))


def _nodes(graph: Column) -> Column:
    return F.concat(F.transform(claims(graph), lambda p: F.concat(F.lit("P:"), p["label"])), F.transform(arguments(graph), lambda a: F.concat(F.lit("A:"), a["label"])))


def _most(graph: Column, end: str) -> Column:
    """The most edges that a node has at this end: edges sorted by it, counted in one pass; 0 without edges."""
    ends = F.array_sort(F.transform(_ends(graph), lambda e: e[end]))
    known = F.array_intersect(ends, _nodes(graph))
    count = lambda s, x: F.struct(x.alias("node"), F.when(s["node"] == x, s["n"] + 1).otherwise(1).alias("n"), F.greatest(s["most"], F.when(s["node"] == x, s["n"] + 1).otherwise(1)).alias("most"))
    start = F.struct(F.lit("").alias("node"), F.lit(0).alias("n"), F.lit(0).alias("most"))
    inside = F.when(F.size(known) == F.size(F.array_distinct(ends)), ends).otherwise(F.filter(ends, lambda x: F.array_contains(known, x)))
    return F.coalesce(F.aggregate(inside, start, count)["most"], F.lit(0)).cast("double")


def _edges_from(graph: Column, end: str) -> Column:
    """Distinct nodes that have edges at this end."""
    return F.array_intersect(_nodes(graph), F.transform(_ends(graph), lambda e: e[end]))


def _shape(graph: Column) -> Column:
    return shapes(_nodes(graph), _ends(graph))


def map_connectedness(graph: Column) -> Column:
    """1 / number of connected parts; 0 without nodes."""
    parts = _shape(graph)["components"]
    return F.when(parts > 0, 1 / parts).when(parts == 0, 0.0)


def map_max_args(graph: Column) -> Column:
    return F.size(arguments(graph)).cast("double")


def _valence(graph: Column, valence: str) -> Column:
    return F.size(F.filter(relations(graph), lambda r: r["valence"] == valence)).cast("double")


def map_max_supports(graph: Column) -> Column:
    return _valence(graph, "SUPPORT")


def map_max_attacks(graph: Column) -> Column:
    return _valence(graph, "ATTACK")


def map_balance(graph: Column) -> Column:
    s, a = _valence(graph, "SUPPORT"), _valence(graph, "ATTACK")
    return F.when(s + a > 0, 1 - F.abs(s - a) / (s + a)).when(s + a == 0, 0.0)


def map_max_diameter(graph: Column) -> Column:
    """The longest path; of a graph with circles its diameter, null if that is in parts."""
    return _shape(graph)["longest"].cast("double")


def map_min_diameter(graph: Column) -> Column:
    return 1 / (1 + map_max_diameter(graph))


def map_density(graph: Column) -> Column:
    """The mean share of other nodes that a node has edges with (both ways count); 1 for a single node."""
    n = F.size(_nodes(graph))
    return F.when(n > 1, 2.0 * F.size(_ends(graph)) / (n * (n - 1.0))).otherwise(n.cast("double"))


def map_max_in_degree(graph: Column) -> Column:
    return _most(graph, "target")


def map_max_out_degree(graph: Column) -> Column:
    return _most(graph, "source")


def map_min_leafs(graph: Column) -> Column:
    """1 less the share of nodes that no edge points at."""
    n = F.size(_nodes(graph))
    return F.when(n > 0, F.size(_edges_from(graph, "target")) / n).when(n == 0, 0.0)


def map_short_labels(graph: Column) -> Column:
    n = F.size(_nodes(graph))
    own = F.concat(labels(claims(graph)), labels(arguments(graph)))
    return _inverse(F.when(n > 0, F.bround(_sum(own, lambda x: F.length(x).cast("double")), -1) / n))


def map_diverse_labels(graph: Column) -> Column:
    return F.bround(least_difference(F.concat(labels(claims(graph)), labels(arguments(graph)))), 2)


def _first_texts(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: F.size(n["texts"]) > 0), lambda n: F.get(n["texts"], F.lit(0)))


def map_short_claims(graph: Column) -> Column:
    return _inverse(_lengths(_first_texts(claims(graph))))


def map_long_claims(graph: Column) -> Column:
    return _lengths(_first_texts(claims(graph)))


def map_argument_claim_size(graph: Column) -> Column:
    """The share of arguments whose gist is between two and three times as long as claims are on average."""
    m = _mean(_first_texts(claims(graph)), lambda t: F.length(t).cast("double"))
    return _mean(arguments(graph), lambda a: F.when(F.coalesce(F.length(F.get(a["texts"], F.lit(0))).between(2 * m, 3 * m) & (F.length(F.get(a["texts"], F.lit(0))) > 2 * m) & (F.length(F.get(a["texts"], F.lit(0))) < 3 * m), F.lit(False)), 1.0).otherwise(0.0))


def _all_texts(nodes: Column) -> Column:
    return F.flatten(F.transform(nodes, lambda n: n["texts"]))


def map_independent_wording(graph: Column, source: Column) -> Column:
    return F.bround(mean_difference(source, F.concat(_all_texts(arguments(graph)), _all_texts(claims(graph)))), 1)


def source_text_proximity(block: Column, source: Column) -> Column:
    return F.bround(similarity(source, block["snippet"]), 1)


# Reconstructions: of the first argument


def _first(reco: Column) -> Column:
    return F.get(arguments(reco), F.lit(0))


def _between(reco: Column) -> Column:
    """Conclusions in front of the last item."""
    items = _first(reco)["pcs"]
    return F.size(F.filter(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), lambda x: x["is_conclusion"]))


def _own(reco: Column, items: Column) -> Column:
    """The propositions of items."""
    return F.filter(claims(reco), lambda p: among(p["label"], F.transform(items, lambda x: x["proposition"])))


def _item_texts(reco: Column) -> Column:
    return _first_texts(_own(reco, _first(reco)["pcs"]))


def reco_no_unused_props(reco: Column) -> Column:
    return 1 / (1 + F.size(_unused(_first(reco))))


def reco_many_intermediate_conclusions(reco: Column) -> Column:
    return _between(reco).cast("double")


def reco_few_intermediate_conclusions(reco: Column) -> Column:
    return 1 / (1 + _between(reco))


def reco_independent_wording(reco: Column, source: Column) -> Column:
    return F.bround(mean_difference(source, _item_texts(reco)), 1)


def reco_simplicity(reco: Column) -> Column:
    return _inverse(_lengths(_item_texts(reco)))


def reco_verbosity(reco: Column) -> Column:
    return _lengths(_item_texts(reco))


def _texts_by(nodes: Column, keys: Callable[[Column], Column]) -> Column:
    return F.transform(nodes, lambda n: F.struct(keys(n).alias("keys"), F.get(n["texts"], F.lit(0)).alias("text")))


def _worded(reco: Column, items: Column) -> Column:
    """How near what formulas say in English is to the texts of their propositions, on average."""
    said = F.transform(reco["logic"]["formulas"], lambda f: F.struct(f["proposition"].alias("key"), f["english"].alias("text")))
    return F.bround(mean_similarity(said, _texts_by(_own(reco, items), lambda p: F.array(p["label"]))), 1)


def _formula(reco: Column, proposition: Column) -> Column:
    return F.get(F.filter(reco["logic"]["formulas"], lambda f: f["proposition"] == proposition), F.lit(0))


def logic_faithfulness(reco: Column) -> Column:
    """How near formulas, worded in English, are to the texts of the first argument's items."""
    return _worded(reco, _first(reco)["pcs"])


def logic_global_faithfulness(reco: Column) -> Column:
    """The same over all arguments."""
    return _worded(reco, F.flatten(F.transform(arguments(reco), lambda a: a["pcs"])))


def logic_predicate_logic(reco: Column) -> Column:
    """1 less the share of formulas with propositional variables."""
    return 1 - _mean(reco["logic"]["formulas"], lambda f: f["propositional"].cast("double"))


# Two blocks


def _said(anno: Column, elements: Column | None = None) -> Column:
    return F.array_join(F.transform(propositions(anno) if elements is None else elements, lambda e: e["text"]), " ")


def text_proximity(anno: Column, block: Column) -> Column:
    """How near the annotated texts are to a map."""
    return F.bround(similarity(_said(anno), block["snippet"]), 1)


def supporting_text_proximity(anno: Column, block: Column) -> Column:
    """How near the annotated texts that support others are to a reconstruction."""
    return F.bround(similarity(_said(anno, F.filter(propositions(anno), lambda e: F.size(e["supports"]) > 0)), block["snippet"]), 1)


def snippet_proximity(first: Column, second: Column) -> Column:
    return F.bround(similarity(first["snippet"], second["snippet"]), 1)


def _matched(anno: Column, a: Column, d: Column) -> Column:
    return (a["valence"] == d["valence"]) & F.coalesce(_label_of(anno, a["source"]) == d["source"], F.lit(False)) & F.coalesce(_label_of(anno, a["target"]) == d["target"], F.lit(False))


def map_graph_proximity(anno: Column, graph: Column) -> Column:
    """The share of the map's relations that are annotated."""
    found = F.filter(relations(graph), lambda d: F.exists(_annotated(anno), lambda a: _matched(anno, a, d)))
    return F.when(F.size(relations(graph)) > 0, F.bround(F.size(found) / F.size(relations(graph)), 1))


def annotation_graph_proximity(anno: Column, graph: Column) -> Column:
    """The share of annotated relations that the map has between nodes with these annotation_ids."""
    nodes = F.concat(F.transform(claims(graph), lambda n: F.struct(n["label"].alias("label"), n["annotation_ids"].alias("own"))), F.transform(arguments(graph), lambda n: F.struct(n["label"].alias("label"), n["annotation_ids"].alias("own"))))
    has = lambda label, i: F.exists(nodes, lambda n: (n["label"] == label) & among(i, n["own"]))
    found = F.filter(_annotated(anno), lambda a: F.exists(relations(graph), lambda d: (d["valence"] == a["valence"]) & has(d["source"], a["source"]) & has(d["target"], a["target"])))
    return F.when(F.size(_annotated(anno)) > 0, F.bround(F.size(found) / F.size(_annotated(anno)), 1))


def _annotated_by(anno: Column, key: str) -> Column:
    return F.transform(propositions(anno), lambda e: F.struct(e[key].alias("key"), e["text"].alias("text")))


def annotation_proximity(anno: Column, reco: Column) -> Column:
    """How near annotated texts are to the propositions that name them in annotation_ids."""
    return F.bround(mean_similarity(_annotated_by(anno, "id"), _texts_by(claims(reco), lambda p: p["annotation_ids"])), 1)


def label_proximity(anno: Column, graph: Column) -> Column:
    """How near annotated texts are to the claims and arguments of the map that have their argument_label."""
    nodes = F.concat(*[_texts_by(x, lambda n: F.array(n["label"])) for x in (claims(graph), arguments(graph))])
    return F.bround(mean_similarity(_annotated_by(anno, "argument_label"), nodes), 1)


# Between 0 and 1


def coverage_scorer(anno: Column) -> Column:
    """Annotated characters (of nested propositions twice) as a share of the block's own text."""
    n = F.length(anno["content"])
    return F.when(n > 0, annotation_coverage(anno) / n).when(n == 0, 0.0)


def scope_scorer(anno: Column) -> Column:
    """Propositions as a share of the sentences of the block's own text, 1 at most."""
    n = F.size(sentences(anno["content"]))
    return F.when(n > 0, F.least(annotation_scope(anno) / n, F.lit(1.0))).when(n == 0, 0.0)


def annotation_density_scorer(anno: Column) -> Column:
    n = annotation_scope(anno)
    return F.when(n > 0, F.least((annotation_supports(anno) + annotation_attacks(anno)) / (2 * n), F.lit(1.0))).when(n == 0, 0.0)


def size_scorer(graph: Column) -> Column:
    n = F.size(arguments(graph))
    return F.when(n <= 3, 0.0).otherwise(1 - F.pow(F.lit(0.6), n - 3))


def map_density_scorer(graph: Column) -> Column:
    return F.least(map_density(graph), F.lit(1.0))


def faithfulness_scorer(block: Column, source: Column) -> Column:
    return F.bround(similarity(source, block["snippet"]), 1)


def subarguments_scorer(reco: Column) -> Column:
    return 1 - F.pow(F.lit(0.5), F.size(F.filter(_first(reco)["pcs"], lambda x: x["is_conclusion"])))


def premises_scorer(reco: Column) -> Column:
    return 1 - F.pow(F.lit(0.7), F.greatest(F.size(F.filter(_first(reco)["pcs"], lambda x: ~x["is_conclusion"])) - 1, F.lit(0)))


def _conjuncts(formula: Column) -> Column:
    """The parts of a formula as text between its outer &."""
    bare = F.regexp_replace(formula, r"^\((.*)\)$", "$1")
    return F.transform(F.split(bare, " & "), lambda x: F.regexp_replace(F.trim(x), r"^\((.*)\)$", "$1"))


def triviality_scorer(reco: Column) -> Column:
    """0 if every part of the conclusion is a premise, else 1."""
    items = _first(reco)["pcs"]
    premises = F.transform(F.filter(items, lambda x: ~x["is_conclusion"]), lambda x: F.regexp_replace(_formula(reco, x["proposition"])["formula"], r"^\((.*)\)$", "$1"))
    end = _formula(reco, F.try_element_at(items, F.lit(-1))["proposition"])["formula"]
    return F.when(end.isNotNull(), F.when(F.forall(_conjuncts(end), lambda c: among(c, premises)), 0.0).otherwise(1.0))


def semantic_coherence_map(anno: Column, graph: Column) -> Column:
    return label_proximity(anno, graph)


def semantic_coherence_reconstruction(anno: Column, reco: Column) -> Column:
    return annotation_proximity(anno, reco)


#: Virtues by the blocks they need: an annotation, a map, a reconstruction, one with formulas, and the source.
ANNOTATION_VIRTUES = {f.__name__: f for f in (annotation_scope, annotation_supports, annotation_attacks, annotation_no_attacks, annotation_coverage)}
MAP_VIRTUES = {f.__name__: f for f in (map_connectedness, map_max_args, map_balance, map_max_supports, map_max_attacks, map_max_diameter, map_min_diameter, map_density, map_max_in_degree, map_max_out_degree, map_min_leafs, map_short_labels, map_diverse_labels, map_short_claims, map_long_claims, map_argument_claim_size)}
RECO_VIRTUES = {f.__name__: f for f in (reco_no_unused_props, reco_many_intermediate_conclusions, reco_few_intermediate_conclusions, reco_simplicity, reco_verbosity)}
LOGIC_VIRTUES = {f.__name__: f for f in (logic_faithfulness, logic_global_faithfulness, logic_predicate_logic)}
#: Those that compare with the source, and with another block.
SOURCE_VIRTUES = {"map_independent_wording": map_independent_wording, "map_source_text_proximity": source_text_proximity, "reco_independent_wording": reco_independent_wording, "reco_source_text_proximity": source_text_proximity}
PAIR_VIRTUES = {"map_text_proximity": text_proximity, "annotation_text_proximity": text_proximity, "map_graph_proximity": map_graph_proximity, "annotation_graph_proximity": annotation_graph_proximity, "supporting_text_proximity": supporting_text_proximity, "infreco_proximity": snippet_proximity, "annotation_proximity": annotation_proximity, "label_proximity": label_proximity}
