"""Named queries over the tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.functions.texts import edit_distance, remove_repetitions, sentences, shorten, word_count
from argloom.operators import checks, coherence, extraction, preference, scores
from argloom.operators import sentences as learned
from argloom.operators.logic import LOGIC_CHECKS
from argloom.plans import judging
from argloom.plans.artifact_sql import artifact_sql
from argloom.sources import artifacts
from argloom.sources.synthetic import PROBLEM_DOCS, annotated_answers, solutions, table
from argloom.streaming.validity import validity_rate

Query = Callable[[SparkSession, str], DataFrame]


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return extraction.blocks(annotated_answers(table(s, d, "documents")))


def extract_blocks(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("request_id", "block_pos", "dtype", "header")


#: Checks by the names of their queries.
ANNOTATION = {
    "source_integrity": "SourceTextIntegrityHandler", "nested_propositions": "NestedPropositionHandler", "id_presence": "PropositionIdPresenceHandler", "id_uniqueness": "PropositionIdUniquenessHandler",
    "support_references": "SupportReferenceValidityHandler", "attack_references": "AttackReferenceValidityHandler", "attributes": "AttributeValidityHandler", "element_names": "ElementValidityHandler",
}
MAP = {"complete_claims": "CompleteClaimsHandler", "no_duplicate_labels": "NoDuplicateLabelsHandler", "no_pcs": "NoPCSHandler"}
RECONSTRUCTION = {
    "has_arguments": "HasArgumentsHandler", "has_unique_argument": "HasUniqueArgumentHandler", "has_pcs": "HasPCSHandler", "starts_with_premise": "StartsWithPremiseHandler", "ends_with_conclusion": "EndsWithConclusionHandler",
    "not_multiple_gists": "NotMultipleGistsHandler", "unique_labels": "NoDuplicatePCSLabelsHandler", "has_label": "HasLabelHandler", "has_gist": "HasGistHandler", "inference_data": "HasInferenceDataHandler", "references_exist": "PropRefsExistHandler",
    "uses_all": "UsesAllPropsHandler", "no_extra_propositions": "NoExtraPropositionsHandler", "only_grounded_relations": "OnlyGroundedDialecticalRelationsHandler", "no_prop_inline_data": "NoPropInlineDataHandler", "no_arg_inline_data": "NoArgInlineDataHandler",
}
LOGIC = {"well_formed": "WellFormedFormulasHandler", "globally_valid": "GlobalDeductiveValidityHandler", "locally_valid": "LocalDeductiveValidityHandler", "premises_relevant": "AllPremisesRelevantHandler", "premises_consistent": "PremisesConsistentHandler", "relations_grounded": "FormallyGroundedRelationsHandler"}


def _annotations(s: SparkSession, d: str) -> DataFrame:
    return artifacts.annotations(table(s, d, "lineitem"))


def _maps(s: SparkSession, d: str) -> DataFrame:
    return artifacts.maps(table(s, d, "customer"), table(s, d, "orders"))


def _reconstructions(s: SparkSession, d: str) -> DataFrame:
    return artifacts.reconstructions_of(table(s, d, "lineitem"))


def _logical(s: SparkSession, d: str) -> DataFrame:
    return artifacts.logical(table(s, d, "lineitem"))


def _compounds(s: SparkSession, d: str, *kinds: str) -> DataFrame:
    return artifacts.compounds(table(s, d, "customer"), table(s, d, "orders"), kinds)


def _check(requests: DataFrame, check: checks.Check, check_id: str, dtype: str = "argdown", source: str | None = None, logic: bool = False, message: bool = False) -> DataFrame:
    """request_id, check_id, is_valid of the last block of the type, where the check has something to say."""
    last = extraction.last(dtype)
    # The block is bound once, by the lambda.
    said = F.get(F.transform(F.array(last), lambda b: F.when(b.isNotNull(), check(b))), F.lit(0))
    own = lambda m: [(F.size(m) == 0).alias("is_valid"), *([F.array_join(m, ", ").alias("message")] if message else [])]
    found = F.get(F.transform(F.array(said), lambda m: F.when(m.isNotNull(), F.struct(*own(m)))), F.lit(0)).alias("_said")
    read = extraction.read(requests, source=source, logic=logic, verdicts=check is not LOGIC_CHECKS["WellFormedFormulasHandler"], carried=["request_id"], ids=False, then=lambda _: [found])
    return read.where("_said is not null").select("request_id", F.lit(check_id).alias("check_id"), "_said.*")


def _judged(requests: DataFrame, name: str, source: str | None = None) -> DataFrame:
    failed = F.size(F.filter("metrics", lambda m: ~m["is_valid"])).cast("long").alias("n_failed")
    return judging.judge(requests, name, "inputs", source, "request_id").select("request_id", "is_valid", failed)


def anno_accuracy(s: SparkSession, d: str) -> DataFrame:
    return _judged(_annotations(s, d), "annotation", "source")


def _has(s: SparkSession, d: str, verifier: str) -> DataFrame:
    out = judging.verify(_annotations(s, d), verifier)
    return out.select("request_id", F.lit(verifier).alias("check_id"), "is_valid", F.coalesce(F.get("results", F.lit(0))["message"], F.lit("")).alias("message"))


def anno_has_annotations(s: SparkSession, d: str) -> DataFrame:
    return _has(s, d, "has_annotations")


def anno_has_argdown(s: SparkSession, d: str) -> DataFrame:
    return _has(s, d, "has_argdown")


def _parses(requests: DataFrame) -> DataFrame:
    read = extraction.read(requests, carried=["request_id"], ids=False, bare=True).select("request_id", F.inline("blocks"))
    return read.select("request_id", F.lit("parses").alias("check_id"), F.col("error").isNull().alias("is_valid"))


def block_roles(s: SparkSession, d: str) -> DataFrame:
    """Blocks of each request by type, name, and role."""
    read = extraction.read(_compounds(s, d, "arganno", "argmap", "infreco"), carried=["request_id"], ids=False, bare=True)
    has = lambda dtype, *rules: F.size(F.filter("blocks", lambda b: extraction.in_role(b, dtype, list(rules)))).cast("long")
    named = F.size(F.filter("blocks", lambda b: extraction.metadata_in(b, "filename", ["map.ad", "annotation.txt"]))).cast("long")
    return read.select("request_id", F.size("blocks").cast("long").alias("n_blocks"), has("xml").alias("n_xml"), has("argdown", ("filename", "map", True)).alias("n_maps"), has("argdown", ("filename", "map", False)).alias("n_exact"), named.alias("n_named"), F.array_join(F.transform("blocks", lambda b: b["metadata"]["filename"]), ",").alias("files"))


def _pair(s: SparkSession, d: str, kinds: tuple[str, str], check) -> DataFrame:
    """request_id, n_messages of a check of two blocks."""
    block = {"arganno": extraction.last("xml"), "argmap": extraction.last("argdown", [("filename", "map", True)]), "infreco": extraction.last("argdown", [("filename", "reconstructions", True)])}
    read = extraction.read(_compounds(s, d, *kinds), carried=["request_id"], ids=False).select("request_id", block[kinds[0]].alias("a"), block[kinds[1]].alias("b"))
    return read.select("request_id", F.size(check(F.col("a"), F.col("b"))).cast("long").alias("n_messages"))


COHERENCE = {
    "arganno_argmap_elements": (("arganno", "argmap"), coherence.annotation_map_elements), "arganno_argmap_relations": (("arganno", "argmap"), coherence.annotation_map_relations),
    "arganno_infreco_elements": (("arganno", "infreco"), coherence.annotation_reconstruction_elements), "arganno_infreco_relations": (("arganno", "infreco"), coherence.annotation_reconstruction_relations),
    "argmap_infreco_elements": (("argmap", "infreco"), coherence.same_labels), "argmap_infreco_relations": (("argmap", "infreco"), coherence.map_reconstruction_relations),
    "argmap_logreco_relations": (("argmap", "infreco"), coherence.map_logic_relations),
}


COMPOUND_JUDGES = {
    "argmap_plus_arganno": ("arganno", "argmap"), "arganno_plus_infreco": ("arganno", "infreco"), "arganno_plus_logreco": ("arganno", "infreco"), "argmap_plus_infreco": ("argmap", "infreco"),
    "argmap_plus_logreco": ("argmap", "infreco"), "argmap_plus_arganno_plus_logreco": ("arganno", "argmap", "infreco"),
}


def logic_formulas(s: SparkSession, d: str) -> DataFrame:
    """Each formula of the arguments in its syntaxes and in English."""
    read = extraction.read(_logical(s, d), logic=True, verdicts=False, carried=["request_id"], ids=False).select("request_id", F.inline(F.flatten(F.transform("blocks", lambda b: b["logic"]["formulas"]))))
    return read.select("request_id", "proposition", "formula", "latex", "smt", "english", F.array_join("symbols", ",").alias("symbols"))


def edit_distances(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    return c.select("c_custkey", edit_distance(F.col("c_mktsegment"), F.lit("AUTOMOBLIE"), restricted=False).alias("distance"))


def text_functions(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents")
    return t.select("doc_id", F.length(shorten(F.col("text"), 64)).cast("long").alias("short"), word_count(F.col("text")).cast("long").alias("words"))


def evaluator_metrics(s: SparkSession, d: str) -> DataFrame:
    """The two errors of the made solutions as columns."""
    of = lambda e: F.coalesce(F.element_at("error_counts", F.lit(e)), F.lit(0)).alias(f"{e[3:]}_counts")
    return preference.metrics(_solutions(s, d)).select("problem_id", "n_solutions", "accuracy", of("01_quality"), of("02_toxic"))


def _solutions(s: SparkSession, d: str) -> DataFrame:
    return solutions(table(s, d, "documents"), table(s, d, "labels"))


def map_metrics(s: SparkSession, d: str) -> DataFrame:
    """Claims are customers, arguments their orders; an order supports (F), attacks (O) or neither."""
    sign = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    edges = table(s, d, "orders").groupBy(F.col("o_custkey").alias("claim")).agg(F.count("*").alias("in_degree"), F.count_if(sign == 1).alias("supports"), F.count_if(sign == -1).alias("attacks"))
    out = table(s, d, "customer").select(F.col("c_custkey").alias("k")).join(edges, F.col("k") == F.col("claim"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    balance = F.when(F.col("supports") + F.col("attacks") > 0, F.abs(F.col("supports") - F.col("attacks")) / (F.col("supports") + F.col("attacks"))).otherwise(0.0)
    return out.select(F.col("k").alias("claim"), zero("in_degree"), zero("supports"), zero("attacks"), F.round(F.coalesce(balance, F.lit(0.0)), 6).alias("imbalance"))


def dialectics_indirect(s: SparkSession, d: str) -> DataFrame:
    """Two steps, order to customer to nation: the product of signs says whether an order supports or attacks the nation."""
    first = table(s, d, "orders").where("o_orderstatus in ('F', 'O')").select("o_custkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("one"))
    second = table(s, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, 1).otherwise(-1).alias("two"))
    both = first.join(second, F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count_if(F.col("one") * F.col("two") == 1).alias("supports"), F.count_if(F.col("one") * F.col("two") == -1).alias("attacks"))


def dedup_answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy(F.sha2("text", 256).alias("answer")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def chat_assembly(s: SparkSession, d: str) -> DataFrame:
    said = F.concat_ws("\n", F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])))
    return preference.chats(table(s, d, "conversations")).select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.md5(said).alias("chat"))


def map_scores(s: SparkSession, d: str) -> DataFrame:
    read = extraction.read(_maps(s, d), carried=["request_id"], ids=False).select("request_id", extraction.last("argdown").alias("b")).where("b is not null")
    own = {n: f for n, f in scores.MAP_VIRTUES.items() if n.removeprefix("map_") in ("connectedness", "max_args", "balance", "max_supports", "max_attacks", "max_diameter", "min_diameter", "density", "max_in_degree", "max_out_degree", "min_leafs")}
    return read.select("request_id", *[F.round(f(F.col("b")), 6).alias(n.removeprefix("map_")) for n, f in own.items()])


def anno_scores(s: SparkSession, d: str) -> DataFrame:
    read = extraction.read(_annotations(s, d), carried=["request_id"], ids=False).select("request_id", extraction.last("xml").alias("b")).where("b is not null")
    return read.select("request_id", *[F.round(f(F.col("b")), 6).alias(n.removeprefix("annotation_")) for n, f in scores.ANNOTATION_VIRTUES.items()])


def abbreviations(s: SparkSession, d: str) -> DataFrame:
    """Words of all documents that nearly always have a period."""
    return learned.abbreviations(table(s, d, "documents")).withColumn("score", F.round("score", 6))


def sentence_counts(s: SparkSession, d: str) -> DataFrame:
    """Sentences of made letters: names with titles and initials, lists, and what goes on in lower case."""
    said = F.concat(F.lit("Dr. Smith saw J. Doe."), F.when(F.col("o_orderkey") % 2 == 0, " He paid approx. ten, e.g. in coins!").otherwise(""), F.when(F.col("o_orderkey") % 3 == 0, " Why? nobody knows. (See fig. 2.)").otherwise(""), F.when(F.col("o_orderkey") % 5 == 0, " The end").otherwise(""))
    return table(s, d, "orders").select("o_orderkey", F.size(sentences(said)).cast("long").alias("n"), F.get(sentences(said), F.lit(0)).alias("first"))


def anno_ratios(s: SparkSession, d: str) -> DataFrame:
    """Annotated characters and propositions as shares of the text and its sentences."""
    read = extraction.read(_annotations(s, d), carried=["request_id"], ids=False).select("request_id", extraction.last("xml").alias("b")).where("b is not null")
    return read.select("request_id", F.round(scores.coverage_scorer(F.col("b")), 6).alias("coverage"), F.round(scores.scope_scorer(F.col("b")), 6).alias("scope"))


def inference_chains(s: SparkSession, d: str) -> DataFrame:
    """For every item of an argument: how many others its last conclusion is inferred from in the end, over chains with branches and cycles."""
    read = extraction.read(artifacts.chains(table(s, d, "customer"), table(s, d, "orders")), carried=["request_id"], ids=False).select("request_id", extraction.last("argdown")["graph"]["arguments"][0].alias("a"))
    used = F.array_distinct(coherence.used_for(F.col("a"), F.try_element_at("a.pcs", F.lit(-1))["label"]))
    return read.select("request_id", F.size("a.pcs").cast("long").alias("n_items"), F.size(used).cast("long").alias("n_used"), F.array_join(F.transform(F.array_sort(F.transform(used, lambda x: x.cast("long"))), lambda x: x.cast("string")), ",").alias("used"))


def solution_repetitions(s: SparkSession, d: str) -> DataFrame:
    """Texts that end in a line over and over, and what is left of them."""
    t = table(s, d, "documents").withColumn("times", F.pmod("doc_id", F.lit(23)).cast("int"))
    stuck = F.concat_ws("\n", F.array_repeat(F.lit("first"), F.pmod("doc_id", F.lit(7)).cast("int") + 9), F.array_repeat(F.lit("it goes on"), F.col("times")), F.lit("it g"))
    left = remove_repetitions(stuck)
    return t.select("doc_id", F.size(F.split(stuck, "\n")).cast("long").alias("n_before"), F.size(F.split(left, "\n")).cast("long").alias("n_after"), F.md5(left).alias("left"))


def reco_scores(s: SparkSession, d: str) -> DataFrame:
    """Virtues and scores of the first argument."""
    read = extraction.read(_reconstructions(s, d), carried=["request_id"], ids=False).select("request_id", extraction.last("argdown").alias("b")).where("size(b.graph.arguments) > 0")
    found = {n.removeprefix("reco_"): f for n, f in scores.RECO_VIRTUES.items() if "verbosity" not in n and "simplicity" not in n} | {"subarguments": scores.subarguments_scorer, "premises": scores.premises_scorer}
    return read.select("request_id", *[F.round(f(F.col("b")), 6).alias(n) for n, f in found.items()])


def logic_scores(s: SparkSession, d: str) -> DataFrame:
    read = extraction.read(_logical(s, d), logic=True, verdicts=False, carried=["request_id"], ids=False).select("request_id", extraction.last("argdown").alias("b"))
    return read.select("request_id", F.round(scores.logic_predicate_logic(F.col("b")), 6).alias("predicate_logic"), scores.triviality_scorer(F.col("b")).alias("triviality"))


def pair_scores(s: SparkSession, d: str) -> DataFrame:
    """How much of a map is annotated, and how much of an annotation is in the map."""
    read = extraction.read(_compounds(s, d, "arganno", "argmap"), carried=["request_id"], ids=False).select("request_id", extraction.last("xml").alias("a"), extraction.last("argdown").alias("b"))
    return read.select("request_id", scores.map_graph_proximity(F.col("a"), F.col("b")).alias("map_graph_proximity"), scores.annotation_graph_proximity(F.col("a"), F.col("b")).alias("annotation_graph_proximity"))


def verified(s: SparkSession, d: str) -> DataFrame:
    """Results and scores of requests by the map verifier."""
    out = judging.Request("argmap").filter("argmap", "filename", r"map\.ad", True).option("enable_argmap_faithfulness_scorer", False).source("source").run(_maps(s, d))
    score = lambda n: F.round(F.get(F.filter("scores", lambda x: x["name"] == n), F.lit(0))["score"], 6)
    return out.select("request_id", "is_valid", F.size("results").cast("long").alias("n_results"), score("argmap_size_scorer").alias("size"), score("argmap_density_scorer").alias("density"))


def stream_validity_rate(s: SparkSession, d: str) -> DataFrame:
    return validity_rate(table(s, d, "events"), F.col("value") >= 50).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def queries() -> dict[str, Query]:
    plain = (extract_blocks, block_roles, anno_accuracy, anno_has_annotations, anno_has_argdown, map_metrics, dialectics_indirect, dedup_answers, chat_assembly, map_scores, anno_scores, anno_ratios, abbreviations, sentence_counts, inference_chains, solution_repetitions, reco_scores, logic_scores, pair_scores, verified, logic_formulas, edit_distances, text_functions, stream_validity_rate)
    out: dict[str, Query] = {f.__name__: f for f in plain}
    for name, check in ANNOTATION.items():
        out[f"anno_{name}"] = lambda s, d, n=name, c=check: _check(_annotations(s, d), checks.ANNOTATION[c], n, "xml", "source" if n == "source_integrity" else None)
    out["anno_argument_labels"] = lambda s, d: _check(_annotations(s, d), checks.argument_labels(["L0", "L1"]), "argument_labels", "xml")
    out["anno_reference_labels"] = lambda s, d: _check(_annotations(s, d), checks.reference_labels(["R0", "R1"]), "reference_labels", "xml")
    for name, check in MAP.items():
        out[f"map_{name}"] = lambda s, d, n=name, c=check: _check(_maps(s, d), checks.MAP[c], n, message=True)
    for name, check in RECONSTRUCTION.items():
        out[f"reco_{name}"] = lambda s, d, n=name, c=check: _check(_reconstructions(s, d), checks.RECONSTRUCTION[c], n)
    out["reco_at_least_two"] = lambda s, d: _check(_reconstructions(s, d), checks.at_least(2), "at_least_two")
    out["reco_parses"] = lambda s, d: _parses(_reconstructions(s, d))
    for name, check in LOGIC.items():
        out[f"logic_{name}"] = lambda s, d, n=name, c=check: _check(_logical(s, d), LOGIC_CHECKS[c], n, logic=True)
    for name, (kinds, check) in COHERENCE.items():
        out[f"coherence_{name}"] = lambda s, d, k=kinds, c=check: _pair(s, d, k, c)
    out["judge_argmap"] = lambda s, d: _judged(_maps(s, d), "argmap")
    out["judge_infreco"] = lambda s, d: _judged(_reconstructions(s, d), "infreco")
    out["judge_logreco"] = lambda s, d: _judged(_logical(s, d), "logreco")
    for name, kinds in COMPOUND_JUDGES.items():
        out[f"judge_{name}"] = lambda s, d, n=name, k=kinds: _judged(_compounds(s, d, *k), n)
    out["evaluator_metrics"] = evaluator_metrics
    out["pairs_validity"] = lambda s, d: preference.validity_pairs(_solutions(s, d))
    out["pairs_ask_invalid"] = lambda s, d: preference.asked_invalid_pairs(_solutions(s, d))
    out["pairs_virtue"] = lambda s, d: preference.virtue_pairs(_solutions(s, d), "n_chars")
    out["pairs_failure_type"] = lambda s, d: preference.failure_pairs(_solutions(s, d))
    out["pairs_failure_diff"] = lambda s, d: preference.failure_diff_pairs(_solutions(s, d)).withColumns({c: F.array_join(c, ",") for c in ("avoided", "common")})
    out["pairs_routes"] = lambda s, d: preference.routes(_solutions(s, d))
    return out


_SOLUTIONS = f"WITH s AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') || '/' || (doc_id // {PROBLEM_DOCS}) AS problem_id, doc_id AS sol_pos, n_chars, quality = 1 AS is_valid, quality = 0 AS e1, toxic = 1 AS e2 FROM documents JOIN labels USING (doc_id))"
_DRAW = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


def oracle_sql() -> dict[str, str]:
    out = artifact_sql()
    out["stream_validity_rate"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, count(*) FILTER (value >= 50) AS n_valid FROM events GROUP BY ALL"
    out["extract_blocks"] = """SELECT doc_id AS request_id, 0 AS block_pos, 'xml' AS dtype, '{filename="annotation.txt"}' AS header FROM documents WHERE doc_id % 9 != 8"""
    out["map_metrics"] = """
SELECT c_custkey AS claim, count(o_orderkey) AS in_degree, count(*) FILTER (o_orderstatus = 'F') AS supports, count(*) FILTER (o_orderstatus = 'O') AS attacks,
  round(CASE WHEN count(*) FILTER (o_orderstatus IN ('F', 'O')) > 0 THEN abs(count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O'))::DOUBLE / count(*) FILTER (o_orderstatus IN ('F', 'O')) ELSE 0 END, 6) AS imbalance
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
    out["dialectics_indirect"] = """
SELECT c_nationkey AS nation, count(*) FILTER ((o_orderstatus = 'F') = (c_acctbal >= 0)) AS supports, count(*) FILTER ((o_orderstatus = 'F') != (c_acctbal >= 0)) AS attacks
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY c_nationkey"""
    out["dedup_answers"] = "SELECT sha256(text) AS answer, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text"
    out["chat_assembly"] = "SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS chat FROM conversations GROUP BY conv_id"
    out["evaluator_metrics"] = f"{_SOLUTIONS} SELECT problem_id, count(*) AS n_solutions, avg(is_valid::DOUBLE) AS accuracy, count(*) FILTER (e1) AS quality_counts, count(*) FILTER (e2) AS toxic_counts FROM s GROUP BY problem_id"
    pairs = "p AS (SELECT problem_id, min(sol_pos) FILTER (is_valid) AS chosen, min(sol_pos) FILTER (NOT is_valid) AS rejected, avg(is_valid::DOUBLE) AS accuracy FROM s GROUP BY problem_id)"
    out["pairs_validity"] = f"{_SOLUTIONS}, {pairs} SELECT problem_id, chosen, rejected FROM p WHERE chosen IS NOT NULL AND rejected IS NOT NULL"
    out["pairs_ask_invalid"] = f"{_SOLUTIONS}, {pairs} SELECT problem_id, rejected AS chosen, chosen AS rejected FROM p WHERE chosen IS NOT NULL AND rejected IS NOT NULL AND {_DRAW.format('problem_id')} < least(1 - accuracy, 0.5)"
    draw = _DRAW.format("problem_id || '|' || sol_pos")
    out["pairs_virtue"] = f"""{_SOLUTIONS}, b AS (SELECT *, max(n_chars) OVER w AS top, first_value(sol_pos) OVER (PARTITION BY problem_id ORDER BY n_chars DESC, sol_pos) AS chosen FROM s WHERE is_valid WINDOW w AS (PARTITION BY problem_id))
SELECT problem_id, chosen, sol_pos AS rejected FROM b WHERE n_chars < top QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY {draw}, sol_pos) = 1"""
    out["pairs_failure_type"] = f"""{_SOLUTIONS}, e AS (SELECT problem_id, count(*) AS n, [(count(*) FILTER (e1), '01_quality', 1), (count(*) FILTER (e2), '02_toxic', 2)] AS c FROM s GROUP BY problem_id),
x AS (SELECT problem_id, unnest(c) AS u, n FROM e), y AS (SELECT problem_id, u[2] AS error FROM x WHERE u[1] BETWEEN 1 AND n - 1 QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY u[1] DESC, u[2]) = 1)
SELECT problem_id, error, min(sol_pos) FILTER (NOT CASE error WHEN '01_quality' THEN e1 ELSE e2 END) AS chosen, min(sol_pos) FILTER (CASE error WHEN '01_quality' THEN e1 ELSE e2 END) AS rejected FROM s JOIN y USING (problem_id) GROUP BY problem_id, error"""
    out["pairs_failure_diff"] = f"""{_SOLUTIONS}, m AS (SELECT *, list_filter([CASE WHEN e1 THEN '01_quality' END, CASE WHEN e2 THEN '02_toxic' END], lambda x: x IS NOT NULL) AS made FROM s),
e AS (SELECT problem_id, error, count(*) AS c FROM (SELECT problem_id, unnest(made) AS error FROM m) GROUP BY ALL), n AS (SELECT problem_id, count(*) AS n FROM m GROUP BY problem_id),
y AS (SELECT problem_id, error FROM e JOIN n USING (problem_id) WHERE c < n QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY c DESC, error) = 1),
x AS (SELECT problem_id, error, sol_pos, made, list_contains(made, error) AS bad, row_number() OVER (PARTITION BY problem_id, list_contains(made, error) ORDER BY {_DRAW.format("problem_id || '|' || sol_pos")}, sol_pos) AS r FROM m JOIN y USING (problem_id)),
z AS (SELECT g.problem_id, g.error, g.sol_pos AS chosen, b.sol_pos AS rejected, g.made AS gm, b.made AS bm FROM x g JOIN x b ON g.problem_id = b.problem_id AND NOT g.bad AND b.bad AND g.r = 1 AND b.r = 1)
SELECT problem_id, error, chosen, rejected, array_to_string(list_sort(list_filter(bm, lambda x: NOT list_contains(gm, x))), ',') AS avoided, array_to_string(list_sort(list_filter(bm, lambda x: list_contains(gm, x))), ',') AS common FROM z"""
    out["pairs_routes"] = f"{_SOLUTIONS}, a AS (SELECT problem_id, avg(is_valid::INT::DOUBLE) AS accuracy FROM s GROUP BY problem_id) SELECT problem_id, accuracy, CASE WHEN accuracy = 0 THEN 'self_critique' WHEN {_DRAW.format("problem_id || '|route'")} < pow(accuracy, 4) THEN 'virtue' ELSE 'validity' END AS route FROM a"
    return out
