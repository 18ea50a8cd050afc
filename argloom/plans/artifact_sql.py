"""What SQL says about the artifacts: each is described as relations (elements, nodes, edges, items, truth values) from the same rows, and every check is evaluated on these."""

from __future__ import annotations

from argloom.sources.artifacts import CONCLUSIONS, PREDICATE_KEYS, PREMISES

_LINES = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)"
#: Elements of annotations, those inside others too, and per annotation what its propositions amount to.
_ANNO = f"""WITH {_LINES},
e AS (
  SELECT k, n, CASE WHEN p % 11 = 0 THEN NULL WHEN p % 13 = 0 THEN '1' ELSE n::VARCHAR END AS id, CASE s % 3 WHEN 0 THEN [(n + 1)::VARCHAR] WHEN 1 THEN ['1', '2'] ELSE [] END AS sup, CASE WHEN p % 7 = 0 THEN [(n + 2)::VARCHAR] ELSE [] END AS att,
    CASE WHEN p % 17 = 0 THEN 'claim' ELSE 'proposition' END AS name, p % 19 = 0 AS mood, p % 23 = 0 AS holds, CASE WHEN s % 2 = 0 THEN 'L' || (p % 4) END AS label, CASE WHEN s % 5 = 0 THEN 'R' || (p % 3) END AS ref, length('Line ' || n || ' of part ' || p || '.') + CASE WHEN p % 23 = 0 THEN 5 ELSE 0 END AS chars FROM l WHERE k % 29 != 0
  UNION ALL SELECT k, n * 100, NULL, [], [], 'b', false, true, NULL, NULL, 5 FROM l WHERE p % 23 = 0 AND k % 29 != 0
  UNION ALL SELECT k, n * 100, (n * 100)::VARCHAR, [], [], 'proposition', false, false, NULL, NULL, 5 FROM l WHERE p % 23 = 0 AND k % 29 != 0),
a AS (
  SELECT k, coalesce(list(id) FILTER (name = 'proposition' AND id IS NOT NULL), []) AS ids, coalesce(list(coalesce(id, 'None')) FILTER (name = 'proposition'), []) AS every, coalesce(flatten(list(sup) FILTER (name = 'proposition')), []) AS sup, coalesce(flatten(list(att) FILTER (name = 'proposition')), []) AS att,
    bool_or(name = 'proposition' AND holds) AS nested, bool_or(name = 'proposition' AND id IS NULL) AS lacking, bool_or(name = 'proposition' AND mood) AS mood, bool_or(name != 'proposition') AS foreigners,
    bool_or(name = 'proposition' AND coalesce(label NOT IN ('L0', 'L1'), false)) AS bad_label, bool_or(name = 'proposition' AND coalesce(ref NOT IN ('R0', 'R1'), false)) AS bad_ref, count(*) FILTER (name = 'proposition') AS n_props, coalesce(sum(chars) FILTER (name = 'proposition'), 0) AS chars
  FROM e GROUP BY k)"""
_ANNO_VALID = {
    "source_integrity": "k % 5 != 0", "nested_propositions": "NOT nested", "id_presence": "NOT lacking", "id_uniqueness": "len(every) = len(list_distinct(every))", "support_references": "len(list_filter(sup, lambda x: NOT list_contains(ids, x))) = 0",
    "attack_references": "len(list_filter(att, lambda x: NOT list_contains(ids, x))) = 0", "attributes": "NOT mood", "element_names": "NOT foreigners",
}
_ANNO_LABELS = {"argument_labels": "NOT bad_label", "reference_labels": "NOT bad_ref"}

#: Nodes and edges of maps.
_MAP = """WITH o AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')),
pr AS (SELECT o_custkey, max(c) AS most, count(*) AS n_prio FROM (SELECT o_custkey, o_orderpriority, count(*) AS c FROM o GROUP BY ALL) GROUP BY o_custkey),
m AS (
  SELECT c_custkey AS k, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS g, coalesce(any_value(n_prio), 0) AS n_prio, coalesce(any_value(most), 0) AS most, (c_custkey % 4 = 1)::INT AS pcs, (c_custkey % 3 = 0)::INT AS loose,
    list_concat(CASE WHEN c_custkey % 5 = 0 THEN ['Customer ' || c_custkey] ELSE [] END, coalesce(list('Order ' || o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 7 = 0), [])) AS twice
  FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN pr ON pr.o_custkey = c_custkey WHERE c_custkey % 31 != 0 GROUP BY c_custkey),
g AS (SELECT *, 1 + n + n_prio + loose + 3 * pcs AS nodes, 2 * n + 2 * pcs AS edges FROM m)"""
_MAP_MESSAGES = {
    "complete_claims": "CASE WHEN loose = 1 THEN 'Missing labels for nodes: A claim without any label, which [...]' ELSE '' END",
    "no_duplicate_labels": "CASE WHEN len(twice) > 0 THEN 'Duplicate labels: ' || array_to_string(twice, ', ') ELSE '' END",
    "no_pcs": "CASE WHEN pcs = 1 THEN 'Found detailed reconstruction of individual argument(s) <Reco ' || k || '> as premise-conclusion-structures.' ELSE '' END",
}

#: Reconstructions as tables: arguments, their items in order, what conclusions are inferred from, and propositions outside; checks are evaluated on these alone.
_RECO = """WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 37 != 0 OR l_orderkey % 41 = 0), full_ AS (SELECT k FROM o WHERE k % 41 != 0),
lines AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first FROM lineitem WHERE l_orderkey IN (SELECT k FROM full_)),
args AS (SELECT k, 1 AS pos, CASE WHEN k % 17 != 0 THEN 'Order ' || k END AS label, (k % 17 != 0 AND k % 6 != 1)::INT AS gists, k % 17 != 0 AND k % 9 = 4 AS data FROM full_ UNION ALL SELECT k, 2, 'Other', CASE WHEN k % 12 = 5 THEN 2 ELSE 1 END, false FROM full_ WHERE k % 4 = 1),
items AS (SELECT k, n + CASE WHEN k % 13 = 0 THEN 100 ELSE 0 END AS ord, n::VARCHAR AS label, false AS ends, NULL AS kind, false AS data FROM lines
  UNION ALL SELECT k, 50, CASE WHEN k % 11 = 0 THEN min(n)::VARCHAR ELSE 'C' END, true, CASE WHEN k % 7 = 0 THEN 'none' WHEN k % 14 = 1 THEN 'no key' WHEN k % 14 = 3 THEN 'no list' ELSE 'list' END, k % 23 = 0 FROM lines GROUP BY k),
refs AS (SELECT r.* FROM (SELECT k, n::VARCHAR AS label, k % 10 != 7 AS is_text FROM lines WHERE k % 5 != 0 OR n > first UNION ALL SELECT k, '99', false FROM full_ WHERE k % 3 = 0) r WHERE k IN (SELECT k FROM items WHERE kind = 'list')),
loose AS (SELECT k, 'Extra' AS label, false AS related FROM full_ WHERE k % 19 = 0 UNION ALL SELECT k, unnest(['One', 'Two']), true FROM full_ WHERE k % 8 = 3),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS place, count(*) OVER (PARTITION BY k) AS n FROM items),
a AS (SELECT k, count(*) AS n_args, max(gists) AS most_gists, min(gists) AS least_gists, bool_and(label IS NOT NULL) AS labeled, bool_or(data) AS data, bool_or(pos > 1) AS lacking FROM args GROUP BY k),
i AS (SELECT k, bool_or(ends AND place = 1) AS begins_wrong, bool_or(NOT ends AND place = n) AS ends_wrong, count(DISTINCT label) < count(*) AS twice, bool_or(data) AS data, bool_and(kind = 'list') FILTER (ends) AS listed, count(*) FILTER (ends AND place < n) AS between,
  count(*) FILTER (NOT ends) AS premises, count(*) FILTER (ends) AS conclusions, count(*) FILTER (place < n AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.k = x.k AND r.label = x.label AND r.is_text)) AS unused FROM x GROUP BY k),
r AS (SELECT refs.k, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM x b, x e WHERE b.k = refs.k AND e.k = refs.k AND e.ends AND b.place < e.place AND b.label = refs.label)) AS wrong FROM refs GROUP BY refs.k),
l AS (SELECT k, count(*) AS n, bool_or(related) AS related FROM loose GROUP BY k),
c AS (SELECT o.k, a.k IS NOT NULL AS present, coalesce(n_args, 0) AS n_args, most_gists, least_gists, labeled, a.data AS arg_data, lacking, begins_wrong, ends_wrong, twice, i.data AS item_data, listed, between, premises, conclusions, unused, coalesce(r.n, 0) AS n_refs, coalesce(wrong, 0) AS wrong, coalesce(l.n, 0) AS n_loose, coalesce(related, false) AS related
  FROM o LEFT JOIN a ON a.k = o.k LEFT JOIN i ON i.k = o.k LEFT JOIN r ON r.k = o.k LEFT JOIN l ON l.k = o.k)"""
_RECO_VALID = {
    "has_arguments": "present", "has_unique_argument": "n_args = 1", "has_pcs": "NOT lacking", "starts_with_premise": "NOT present OR NOT begins_wrong", "ends_with_conclusion": "NOT present OR NOT ends_wrong", "not_multiple_gists": "NOT present OR most_gists <= 1",
    "unique_labels": "NOT present OR NOT twice", "has_label": "NOT present OR labeled", "has_gist": "NOT present OR least_gists > 0", "inference_data": "NOT present OR listed AND n_refs > 0", "references_exist": "wrong = 0", "uses_all": "NOT present OR unused = 0",
    "no_extra_propositions": "n_loose = 0", "only_grounded_relations": "NOT related", "no_prop_inline_data": "NOT present OR NOT item_data", "no_arg_inline_data": "NOT present OR NOT arg_data", "at_least_two": "n_args >= 2",
}


def _truth() -> str:
    """Arguments with the truth values of all their formulas under all assignments of p, q and r."""
    has = ["true", *[f"k % {m} = {rest}" for _, m, rest, _ in PREMISES]]
    said = ["(NOT r OR q)", *[f"({f})" for *_, f in PREMISES]]
    whole = lambda drop=None: " AND ".join(f"(NOT ({h}) OR {f})" for i, (h, f) in enumerate(zip(has, said, strict=True)) if i != drop)
    n = " + ".join(f"({h})::INT" for h in has)
    end = "CASE k % 3 " + " ".join(f"WHEN {i} THEN {f}" for i, (_, f) in enumerate(CONCLUSIONS)) + " END"
    dropped = " OR ".join(f"({h}) AND bool_and(NOT ({whole(i)}) OR c)" for i, h in enumerate(has))
    return f"""WITH t(p, q, r) AS (SELECT * FROM (VALUES (false), (true)) p, (VALUES (false), (true)) q, (VALUES (false), (true)) r), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
x AS (SELECT k, p, q, r, {end} AS c, {n} AS n FROM b, t),
v AS (
  SELECT k, n, k % 17 = 0 AS flawed, k % 11 != 0 OR k % 19 = 0 OR k % 2 = 0 OR k % 3 != 1 OR k % 7 = 0 AS declared, bool_and(NOT ({whole()}) OR c) AS valid, bool_and(NOT ({said[0]}) OR c) AS by_first, n > 1 AND ({dropped}) AS spare, bool_or({whole()}) AS consistent,
    bool_and(NOT ({said[0]}) OR NOT c) AS against FROM x GROUP BY k, n)"""


_LOGIC_VALID = {
    "well_formed": "k % 11 != 0 AND NOT flawed AND k % 19 != 0", "globally_valid": "NOT flawed AND valid", "locally_valid": "NOT flawed AND CASE WHEN k % 13 = 0 THEN by_first ELSE valid END",
    "premises_relevant": "NOT flawed AND NOT spare", "premises_consistent": "consistent", "relations_grounded": "flawed OR CASE k % 6 WHEN 2 THEN by_first WHEN 4 THEN against ELSE true END",
}

#: Orders as elements, arguments and reconstructions, and how many messages each gives.
_COMPOUND = """WITH o AS (
  SELECT c_custkey AS k, o_orderkey AS o, o_orderstatus = 'F' AS f, o_orderkey % 5 = 0 AS nobody, o_orderkey % 6 = 0 AS nowhere, o_orderkey % 7 = 0 AS unrelated, CASE WHEN o_orderkey % 8 = 0 THEN 'none' WHEN o_orderkey % 9 = 0 THEN 'x' ELSE 'own' END AS ids, o_orderkey % 10 = 0 AS elsewhere, o_orderkey % 11 = 0 AS missing
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O'))"""
_COHERENCE = {
    "arganno_argmap_elements": "sum(nobody::INT + (ids != 'own' OR nobody)::INT)", "arganno_argmap_relations": "sum((NOT unrelated AND nobody)::INT + (unrelated OR nobody)::INT)",
    "arganno_infreco_elements": """1 + sum(CASE WHEN nobody OR missing THEN 1 WHEN nowhere THEN 1 WHEN ids != 'own' THEN 1 ELSE 0 END + CASE WHEN missing THEN 0 ELSE nobody::INT + (ids != 'own')::INT + (elsewhere OR NOT f)::INT END)
  + count(*) FILTER (ids = 'x' AND NOT missing) * (count(*) FILTER (ids = 'x' AND NOT missing) - 1) // 2""",
    "arganno_infreco_relations": "sum((NOT unrelated)::INT)", "argmap_infreco_elements": "sum(missing::INT)", "argmap_infreco_relations": "sum((NOT missing AND elsewhere)::INT)", "argmap_logreco_relations": "sum((NOT missing AND elsewhere)::INT)",
}


#: Failed checks of judges of several blocks; a is how many reconstructed arguments there are, w whether the customer is a premise or conclusion.
_COMPOUND_FAILED = {
    "argmap_plus_arganno": "(am > 0)::INT + (ar > 0)::INT", "arganno_plus_infreco": "(a = 0)::INT + (im > 0)::INT + (ir > 0)::INT",
    "arganno_plus_logreco": "(a = 0)::INT + (a > 0)::INT + (im > 0)::INT + (ir > 0)::INT", "argmap_plus_infreco": "(a = 0)::INT + (lm > 0)::INT + (lr > 0)::INT",
    "argmap_plus_logreco": "(a < 2)::INT + (NOT w)::INT + (a > 0)::INT + 2 * (lm > 0)::INT + 2 * (lr > 0)::INT",
    "argmap_plus_arganno_plus_logreco": "(a < 2)::INT + (NOT w)::INT + (a > 0)::INT + (am > 0)::INT + (ar > 0)::INT + (im > 0)::INT + (ir > 0)::INT + (lm > 0)::INT + (lr > 0)::INT",
}


def _one(relations: str, source: str, check_id: str, valid: str, more: str = "") -> str:
    return f"{relations} SELECT k AS request_id, '{check_id}' AS check_id, {valid} AS is_valid{more} FROM {source}"


def artifact_sql() -> dict[str, str]:
    out = {f"anno_{n}": _one(_ANNO, "a", n, v) for n, v in (_ANNO_VALID | _ANNO_LABELS).items()}
    orders = "SELECT DISTINCT l_orderkey AS k FROM lineitem"
    failed = " + ".join(f"(NOT ({v}))::INT" for v in _ANNO_VALID.values())
    out["anno_accuracy"] = f"{_ANNO} SELECT w.k AS request_id, coalesce(n, 1) = 0 AS is_valid, coalesce(n, 1)::BIGINT AS n_failed FROM ({orders}) w LEFT JOIN (SELECT k, {failed} AS n FROM a) j ON j.k = w.k"
    no_fence = "Input data has no properly formatted fenced codeblocks with "
    out["anno_has_annotations"] = f"SELECT k AS request_id, 'has_annotations' AS check_id, k % 29 != 0 AS is_valid, CASE WHEN k % 29 = 0 THEN '{no_fence}annotations. No closing ''```''.' ELSE '' END AS message FROM ({orders})"
    out["anno_has_argdown"] = f"SELECT k AS request_id, 'has_argdown' AS check_id, false AS is_valid, '{no_fence}Argdown code. No fenced code block starting with ''```argdown''.' || CASE WHEN k % 29 = 0 THEN ' No closing ''```''.' ELSE '' END AS message FROM ({orders})"
    out["anno_scores"] = f"{_ANNO} SELECT k AS request_id, n_props::DOUBLE AS scope, len(sup)::DOUBLE AS supports, len(att)::DOUBLE AS attacks, round(1 / (1 + len(att)::DOUBLE), 6) AS no_attacks, chars::DOUBLE AS coverage FROM a"
    out["anno_ratios"] = f"""{_ANNO},
w AS (SELECT k, sum(chars) + count(*) - 1 AS long, 1 + count(*) FILTER (NOT holds AND n < last) AS sentences FROM (SELECT *, max(n) OVER (PARTITION BY k) AS last FROM e WHERE n < 100) GROUP BY k)
SELECT k AS request_id, round(chars::DOUBLE / long, 6) AS coverage, round(least(n_props::DOUBLE / sentences, 1), 6) AS scope FROM a JOIN w USING (k)"""
    out["abbreviations"] = """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[^ \\t-\\r]+')) AS w FROM documents), c AS (SELECT CASE WHEN ends_with(w, '.') THEN w[:-2] ELSE w END AS word, count(*) AS n, count(*) FILTER (ends_with(w, '.')) AS p FROM w GROUP BY ALL),
s AS (SELECT sum(p)::DOUBLE / sum(n) AS share FROM c), l AS (SELECT word, n, p, len(word) - len(replace(word, '.', '')) AS inner_, len(replace(word, '.', '')) AS letters, share FROM c, s WHERE p > 0 AND NOT regexp_matches(word, '[0-9]') AND regexp_matches(word, '[^.]')),
x AS (SELECT word, n, p AS n_period, 2 * (p * ln(0.99::DOUBLE) + (n - p) * ln(0.01::DOUBLE) - p * ln(share) - (n - p) * ln(1 - share)) * exp(-letters::DOUBLE) * (inner_ + 1) * pow(letters::DOUBLE, -(n - p)::DOUBLE) AS score FROM l)
SELECT word, n, n_period::BIGINT AS n_period, round(score, 6) AS score FROM x WHERE score >= 0.3"""
    out["sentence_counts"] = """SELECT o_orderkey, 1 + (o_orderkey % 2 = 0)::BIGINT + 2 * (o_orderkey % 3 = 0)::BIGINT + (o_orderkey % 5 = 0)::BIGINT AS n, 'Dr. Smith saw J. Doe.' AS first FROM orders"""
    out["inference_chains"] = """WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT k, n, CASE WHEN o % 3 = 0 AND n > 2 THEN n - 2 ELSE n - 1 END AS ref FROM o WHERE n > 1 UNION SELECT k, n, n + 1 FROM o WHERE n > 1 AND o % 5 = 0 AND n < m),
u AS (SELECT k, ref FROM r JOIN (SELECT DISTINCT k, m FROM o) USING (k) WHERE n = m UNION SELECT r.k, r.ref FROM u JOIN r ON r.k = u.k AND r.n = u.ref)
SELECT k AS request_id, max(m) AS n_items, count(ref) AS n_used, coalesce(string_agg(ref::VARCHAR, ',' ORDER BY ref), '') AS used FROM (SELECT DISTINCT k, m FROM o) LEFT JOIN u USING (k) GROUP BY k"""
    out["solution_repetitions"] = """WITH t AS (SELECT doc_id, doc_id % 7 + 9 AS head, doc_id % 23 AS times FROM documents), l AS (SELECT *, head + times + 1 AS n, CASE WHEN times > 3 THEN least(times - 3, greatest(head + times + 1 - 16, 0)) ELSE 0 END AS cut FROM t)
SELECT doc_id, n AS n_before, n - cut AS n_after, md5(repeat('first' || chr(10), head::INT) || repeat('it goes on' || chr(10), (times - cut)::INT) || 'it g') AS left FROM l"""
    out |= {f"map_{n}": f"{_MAP}, q AS (SELECT k, {m} AS message FROM g) SELECT k AS request_id, '{n}' AS check_id, message = '' AS is_valid, message FROM q" for n, m in _MAP_MESSAGES.items()}
    n_map = "loose + (len(twice) > 0)::INT + pcs"
    out["judge_argmap"] = f"{_MAP} SELECT c_custkey AS request_id, coalesce({n_map}, 1) = 0 AS is_valid, coalesce({n_map}, 1)::BIGINT AS n_failed FROM customer LEFT JOIN g ON k = c_custkey"
    real = lambda x: f"round(({x})::DOUBLE, 6)"
    out["map_scores"] = f"""{_MAP}, h AS (SELECT *, n + f + 2 * pcs AS s FROM g)
SELECT k AS request_id, {real("1.0::DOUBLE / (1 + loose + pcs)")} AS connectedness, {real("n + pcs")} AS max_args, {real("CASE WHEN s + g > 0 THEN 1 - abs(s - g)::DOUBLE / (s + g) ELSE 0 END")} AS balance, {real("s")} AS max_supports, {real("g")} AS max_attacks,
  {real("CASE WHEN n > 0 OR pcs = 1 THEN 2 ELSE 0 END")} AS max_diameter, {real("CASE WHEN n > 0 OR pcs = 1 THEN 1.0::DOUBLE / 3 ELSE 1 END")} AS min_diameter, {real("CASE WHEN nodes > 1 THEN 2.0::DOUBLE * edges / (nodes * (nodes - 1)) ELSE 1 END")} AS density,
  {real("greatest(n, pcs)")} AS max_in_degree, {real("greatest(most, pcs)")} AS max_out_degree, {real("((n > 0)::INT + n + 2 * pcs)::DOUBLE / nodes")} AS min_leafs FROM h"""
    out["verified"] = f"{_MAP} SELECT c_custkey AS request_id, coalesce({n_map}, 1) = 0 AS is_valid, CASE WHEN k IS NULL THEN 2 ELSE 4 END::BIGINT AS n_results, CASE WHEN {n_map} = 0 THEN {real('CASE WHEN n + pcs <= 3 THEN 0 ELSE 1 - pow(0.6, n + pcs - 3) END')} END AS size, CASE WHEN {n_map} = 0 THEN {real('least(1, CASE WHEN nodes > 1 THEN 2.0::DOUBLE * edges / (nodes * (nodes - 1)) ELSE 1 END)')} END AS density FROM customer LEFT JOIN g ON k = c_custkey"
    out |= {f"reco_{n}": _one(_RECO, "c" + " WHERE present" * (n == "has_pcs"), n, v) for n, v in _RECO_VALID.items()}
    out["reco_parses"] = f"SELECT k AS request_id, 'parses' AS check_id, k % 37 != 0 OR k % 41 = 0 AS is_valid FROM ({orders})"
    judged = " + ".join(f"(NOT ({v if n != 'has_pcs' else f'NOT present OR {v}'}))::INT" for n, v in _RECO_VALID.items() if n not in ("uses_all", "at_least_two"))
    out["judge_infreco"] = f"{_RECO} SELECT w.k AS request_id, coalesce(m, 1) = 0 AS is_valid, coalesce(m, 1)::BIGINT AS n_failed FROM ({orders}) w LEFT JOIN (SELECT k, {judged} AS m FROM c) j ON j.k = w.k"
    out["reco_scores"] = f"""{_RECO} SELECT k AS request_id, {real("1.0::DOUBLE / (1 + unused)")} AS no_unused_props, {real("between")} AS many_intermediate_conclusions, {real("1.0::DOUBLE / (1 + between)")} AS few_intermediate_conclusions,
  {real("1 - pow(0.5, conclusions)")} AS subarguments, {real("1 - pow(0.7, greatest(premises - 1, 0))")} AS premises FROM c WHERE present"""
    out |= {f"logic_{n}": f"{_truth()} SELECT k AS request_id, '{n}' AS check_id, {v} AS is_valid FROM v" + " WHERE declared" * (n != "well_formed") for n, v in _LOGIC_VALID.items()}
    n_logic = " + ".join(f"(NOT ({v}))::INT" + ("" if n == "well_formed" else " * declared::INT") for n, v in _LOGIC_VALID.items())
    n_logic += " + (k % 6 IN (2, 4))::INT + (k % 13 = 0 AND n > 1)::INT"
    out["judge_logreco"] = f"{_truth()} SELECT k AS request_id, {n_logic} = 0 AS is_valid, ({n_logic})::BIGINT AS n_failed FROM v"
    out |= {f"coherence_{n}": f"{_COMPOUND} SELECT k AS request_id, ({v})::BIGINT AS n_messages FROM o GROUP BY k" for n, v in _COHERENCE.items()}
    short = {"am": "arganno_argmap_elements", "ar": "arganno_argmap_relations", "im": "arganno_infreco_elements", "ir": "arganno_infreco_relations", "lm": "argmap_infreco_elements", "lr": "argmap_infreco_relations"}
    counts = ", ".join(f"{_COHERENCE[n]} AS {s}" for s, n in short.items())
    for name, failed in _COMPOUND_FAILED.items():
        out[f"judge_{name}"] = f"{_COMPOUND}, c AS (SELECT k, count(*) FILTER (NOT missing) AS a, coalesce(bool_or(f AND NOT elsewhere AND NOT missing), false) AS w, {counts} FROM o GROUP BY k) SELECT k AS request_id, {failed} = 0 AS is_valid, ({failed})::BIGINT AS n_failed FROM c"
    out["block_roles"] = f"{_COMPOUND} SELECT DISTINCT k AS request_id, 3::BIGINT AS n_blocks, 1::BIGINT AS n_xml, 1::BIGINT AS n_maps, 0::BIGINT AS n_exact, 2::BIGINT AS n_named, 'map.ad,reconstructions.ad,annotation.txt' AS files FROM o"
    matched, annotated = "count(*) FILTER (NOT unrelated AND NOT nobody)", "count(*) FILTER (NOT unrelated)"
    named = "count(*) FILTER (NOT unrelated AND ids = 'own')"
    out["pair_scores"] = f"{_COMPOUND} SELECT k AS request_id, round_even({matched}::DOUBLE / count(*), 1) AS map_graph_proximity, CASE WHEN {annotated} > 0 THEN round_even({named}::DOUBLE / {annotated}, 1) END AS annotation_graph_proximity FROM o GROUP BY k"
    out["logic_scores"] = f"""{_truth()} SELECT k AS request_id, CASE WHEN {PREDICATE_KEYS} THEN 1.0 ELSE 0.0 END::DOUBLE AS predicate_logic, CASE WHEN NOT flawed THEN CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END ELSE 1 END::DOUBLE END AS triviality FROM v"""
    out["edit_distances"] = "SELECT c_custkey, damerau_levenshtein(c_mktsegment, 'AUTOMOBLIE') AS distance FROM customer"
    out["text_functions"] = """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x, len(regexp_extract_all(text, '\\S+')) AS words FROM documents), c AS (SELECT *, regexp_extract(x, '^(.{0,58})(?: |$)', 1) AS head FROM t)
SELECT doc_id, CASE WHEN x IS NULL THEN NULL WHEN length(x) <= 64 THEN length(x) WHEN head = '' THEN 5 ELSE length(head) + 6 END::BIGINT AS short, words::BIGINT AS words FROM c"""
    shapes = {"P": ("P", "P", "P", "{P}", "P"), "P -> Q": ("(P -> Q)", r"P \rightarrow Q", "(=> P Q)", "'if ' || {P} || ', then ' || {Q}", "P,Q"), "-P": ("-P", r"\lnot P", "(not P)", "'it is false that ' || {P}", "P"), "R": ("R", "R", "R", "{R}", "R"),
              "Q | R": ("(Q | R)", r"Q \lor R", "(or Q R)", "{Q} || ' or ' || {R}", "Q,R"), "Q": ("Q", "Q", "Q", "{Q}", "Q"), "P & Q": ("(P & Q)", r"P \land Q", "(and P Q)", "{P} || ' and ' || {Q}", "P,Q"), "-R | Q": ("(-R | Q)", r"\lnot R \lor Q", "(or (not R) Q)", "'it is false that ' || {R} || ' or else ' || {Q}", "R,Q")}
    about = {"P": ("F(a)", "F(a)", "(F a)", "{a} || ' is ' || {F}", "F,a"), "P -> Q": ("all x.(F(x) -> G(x))", r"\forall x: (F(x) \rightarrow G(x))", "(forall ((x UNIVERSAL)) (=> (F x) (G x)))", "'for every x it holds that if x is ' || {F} || ', then x is ' || {G}", "F,G"),
             "-P": ("-F(a)", r"\lnot F(a)", "(not (F a))", "{a} || ' is not ' || {F}", "F,a"), "R": ("H(a)", "H(a)", "(H a)", "{a} || ' is ' || {H}", "H,a"), "Q | R": ("(G(a) | H(a))", r"G(a) \lor H(a)", "(or (G a) (H a))", "{a} || ' is ' || {G} || ' or ' || {a} || ' is ' || {H}", "G,a,H"),
             "Q": ("G(a)", "G(a)", "(G a)", "{a} || ' is ' || {G}", "G,a"), "P & Q": ("(F(a) & G(a))", r"F(a) \land G(a)", "(and (F a) (G a))", "{a} || ' is ' || {F} || ' and ' || {a} || ' is ' || {G}", "F,a,G"),
             "-R | Q": ("all x.(H(x) -> G(x))", r"\forall x: (H(x) \rightarrow G(x))", "(forall ((x UNIVERSAL)) (=> (H x) (G x)))", "'for every x it holds that if x is ' || {H} || ', then x is ' || {G}", "H,G")}
    bare = lambda x, said: f"CASE WHEN k % 11 = 0 THEN '{x}' ELSE '{said}' END"
    meaning = {"{P}": "'it rains'", "{Q}": bare("Q", "streets are wet"), "{R}": bare("R", "it snows"), "{F}": "'rainy'", "{G}": bare("G", "wet"), "{H}": bare("H", "snowy"), "{a}": bare("a", "the street")}
    places = [("First", "-R | Q", "true"), *((f"Premise {i}", f, f"k % {m} = {rest}") for i, (f, m, rest, _) in enumerate(PREMISES, 2)), *(("End", f, f"k % 3 = {i} AND k % 17 != 0") for i, (f, _) in enumerate(CONCLUSIONS))]
    rows = []
    for place, f, when in places:
        for forms, own in ((shapes, f"NOT {PREDICATE_KEYS}"), (about, PREDICATE_KEYS)):
            a, b, c, e, y = forms[f]
            for k, v in meaning.items():
                e = e.replace(k, v)
            rows.append(f"SELECT k AS request_id, '{place}' AS proposition, '{a}' AS formula, '{b}' AS latex, '{c}' AS smt, {e} AS english, '{y}' AS symbols FROM ({orders}) WHERE {when} AND {own}")
    out["logic_formulas"] = " UNION ALL ".join(rows)
    return out
