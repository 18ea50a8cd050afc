"""Every query that has SQL gives the same rows, and the operators give what is written down for small cases."""

import itertools
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from argloom.functions import formulas, reading, texts
from argloom.functions.graphs import shape
from argloom.operators import sentences as learned
from argloom.operators import checks, coherence, extraction, preference, problems, scores
from argloom.plans import judging
from argloom.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "orders", "customer", "lineitem", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    got, want = queries()[name](spark, SF).toPandas(), db.sql(oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) > 0
    plain = lambda df: sorted(str([None if x != x else round(x, 9) if isinstance(x, float) else x for x in r]) for r in df[columns].itertuples(index=False))
    assert plain(got) == plain(want)


def requests(spark, *inputs, source=None):
    return spark.createDataFrame([(i, x, source) for i, x in enumerate(inputs)], "request_id long, inputs string, source string")


def fenced(*bodies):
    return "\n".join(f"```argdown {{filename=\"{name}\"}}\n{body}\n```" for name, body in bodies) + "\n"


def test_blocks(spark):
    answer = 'a\n```xml\n<proposition id="1" supports="2 3">x <b>y</proposition>z\n```\n```argdown {k=1}\n[A]: b\n```\n```xml never closed'
    df = extraction.blocks(spark.createDataFrame([(1, answer), (2, ""), (3, None)], "request_id long, answer string"))
    found = [tuple(r) for r in df.orderBy("block_pos").collect()]
    assert found == [(1, 0, "argdown", "{k=1}", "[A]: b"), (1, 1, "xml", "", '<proposition id="1" supports="2 3">x <b>y</proposition>z')]
    rows = extraction.read(requests(spark, answer, "", None, "```argdown foo\n[A\n```\n```argdown\n[B]\n```")).orderBy("request_id").collect()
    assert [(b["dtype"], b["metadata"], b["error"]) for b in rows[0]["blocks"]] == [("argdown", {"k": "1"}, None), ("xml", {}, None)]
    assert [(e["name"], e["parent"], e["supports"], e["text"]) for e in rows[0]["blocks"][1]["elements"]] == [("proposition", None, ["2", "3"], "x y"), ("b", 0, [], "y")]
    assert rows[1]["blocks"] == [] and rows[2]["blocks"] == []
    assert [(b["metadata_kind"], b["error"], b["graph"] is None) for b in rows[3]["blocks"]] == [("scalar", "a label is not closed", True), ("null", None, False)]


def test_headers_and_data():
    assert reading.header('{filename="map.ad", n=2}') == ("dict", {"filename": "map.ad", "n": "2"}) and reading.header("filename=map.ad") == ("dict", {"filename": "map.ad"})
    assert reading.header("foo")[0] == "scalar" and reading.header("") == ("null", {}) and reading.header("[1, 2]")[0] == "list" and reading.header("{a")[0] == "null"
    assert reading.data("""{a: [1, "2", 'it''s', true, ~], b: {c: x y, "d e": -1.5}}""") == {"a": [1, "2", "it's", True, None], "b": {"c": "x y", "d e": -1.5}}
    for bad in ("{a: 1", "[1", "{a: 1} b", "{: 1}"):
        with pytest.raises(ValueError):
            reading.data(bad)


def test_argdown():
    g = reading.argdown('[A]: x // note\n  goes on\n    <- <B>: y {k: 1}\n        +> [C]\n\n(1) [D]: p\n-- with rule {from: ["1", 2]} --\n(2) q')
    assert [(p["label"], p["unlabeled"], p["texts"]) for p in g["propositions"]] == [("A", False, ["x goes on"]), ("C", False, []), ("D", False, ["p"]), ("UNLABELED_PROPOSITION_4", True, ["q"])]
    assert [(a["label"], a["unlabeled"], a["data"], [(x["label"], x["is_conclusion"], x["refs"] and [(r["label"], r["is_text"]) for r in x["refs"]]) for x in a["pcs"]]) for a in g["arguments"]] == [("B", False, "dict", []), ("UNLABELED_ARGUMENT_2", True, None, [("1", False, None), ("2", True, [("1", True), ("2", False)])])]
    assert [(r["source"], r["target"], r["valence"], r["dialectics"]) for r in g["relations"]] == [("B", "A", "ATTACK", ["SKETCHED"]), ("B", "C", "SUPPORT", ["SKETCHED"]), ("D", "UNLABELED_ARGUMENT_2", "SUPPORT", ["GROUNDED"])]
    for bad in ("[A\n", "[A]\n    + [B]\n  + [C]", "(1) a\n-- {from: [1]} --\nno number", "(1) a\n-----"):
        with pytest.raises(ValueError):
            reading.argdown(bad)
    assert reading.argdown("- <Argument2")["propositions"][0]["texts"] == ["<Argument2"] and reading.argdown("") == {"propositions": [], "arguments": [], "relations": []}
    again = reading.argdown('<A>: g\n\n(1) a\n-- {from: ["1"]} --\n(2) b\n\n<A> ')
    assert again["arguments"][0]["texts"] == ["g", ""]
    contra = reading.argdown('<A>\n\n(1) [P]\n-- {from: ["1"]} --\n(2) [Q]\n    >< [R]\n\n<B>\n\n(1) [R]\n-- {from: ["1"]} --\n(2) [S]')
    assert {(r["source"], r["target"], r["valence"]) for r in contra["relations"] if r["dialectics"] == ["GROUNDED"]} == {("A", "Q", "SUPPORT"), ("A", "R", "ATTACK"), ("A", "B", "ATTACK"), ("P", "A", "SUPPORT"), ("B", "S", "SUPPORT"), ("R", "B", "SUPPORT"), ("Q", "B", "ATTACK")}


def holds(f, m):
    kind = f[0]
    if kind == "pred":
        return m[f[1]]
    if kind == "not":
        return not holds(f[1], m)
    a, b = holds(f[1], m), holds(f[2], m)
    return {"and": a and b, "or": a or b, "imp": not a or b, "iff": a == b}[kind]


def test_entailment():
    rng = random.Random(1)

    def make(depth):
        if not depth or rng.random() < 0.2:
            return ("pred", rng.choice("PQRS"))
        kind = rng.choice(["and", "or", "imp", "iff", "not"])
        return (kind, make(depth - 1)) if kind == "not" else (kind, make(depth - 1), make(depth - 1))

    for _ in range(1000):
        premises, end = [make(3) for _ in range(rng.randrange(1, 3))], make(3)
        worlds = [dict(zip("PQRS", b, strict=True)) for b in itertools.product([False, True], repeat=4)]
        assert formulas.entails(premises, end) == all(holds(end, m) for m in worlds if all(holds(p, m) for p in premises))
        assert formulas.read(formulas.plain(end)) == end
    read, yes = formulas.read, [(["all x.(F(x) -> G(x))", "F(a)"], "G(a)"), (["exists x.all y.R(x,y)"], "all y.exists x.R(x,y)"), (["all x.(F(x)->exists y.R(x,y))", "F(a)"], "exists y.R(a,y)"), (["a = b", "F(a)"], "F(b)"), (["a=b", "b=c", "R(a,d)"], "R(c,d)"), (["all x.(F(x) -> G(x))", "all x.(G(x) -> H(x))"], "all x.(F(x) -> H(x))")]
    no = [(["all x.(F(x) -> G(x))", "G(a)"], "F(a)"), (["all y.exists x.R(x,y)"], "exists x.all y.R(x,y)"), (["F(a)"], "F(b)")]
    assert all(formulas.entails([read(p) for p in ps], read(c)) for ps, c in yes) and not any(formulas.entails([read(p) for p in ps], read(c)) for ps, c in no)


def test_wording_of_formulas():
    f = formulas.read("all x.(P(x) -> exists y.(R(x,y) & Q(y)))")
    assert formulas.scheme(f) == "for every {x} it holds that if {x} is {P}, then there exists a {y} such that {x} stands in relation {R} to {y} and {y} is {Q}"
    assert formulas.sentence(formulas.read("all x.(H(x) -> M(x))"), {"H": "human", "M": "mortal", "x": "being"}) == "for every being it holds that if being is human, then being is mortal"
    assert formulas.latex(formulas.read("all x.exists y.(R(x,y) -> -Q(y) & P & S)")) == r"\forall x \exists y: (R(x,y) \rightarrow (\lnot Q(y) \land P \land S))"
    assert formulas.smt(formulas.read("all x y.(R(x,y) -> Q(y) | P)")) == "(forall ((x UNIVERSAL) (y UNIVERSAL)) (=> (R x y) (or (Q y) P)))"
    assert formulas.symbols(f) == ["P", "R", "Q"] and formulas.arities(f) == {"P": 1, "R": 2, "Q": 1} and formulas.propositional(formulas.read("P & Q(a)")) == ["P"]
    with pytest.raises(ValueError):
        formulas.arities(formulas.read("P(a) & P(a,b)"))
    for bad in ("P &", "(P", "P Q", "all x P(x)", "", "%"):
        with pytest.raises(ValueError):
            formulas.read(bad)
    program = formulas.smt_program({"1": formulas.read("F(a)")}, {"C": formulas.read("G(a)")}, {"F": "f", "G": "g", "a": "x"}, {"B": formulas.read("F(a)")}, {"C": ["1", "B"]})
    assert "(declare-const a UNIVERSAL) ;; x" in program and "(=> (and premise1 conclusionB) conclusionC)" in program and program.count("(push)") == 1


def test_distances():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in "ab")
        table = {}
        for i, j in itertools.product(range(-1, len(a)), range(-1, len(b))):
            if min(i, j) < 0:
                table[i, j] = max(i, j) + 1
                continue
            swap = table[i - 2, j - 2] + 1 if i and j and a[i] == b[j - 1] and a[i - 1] == b[j] else 99
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i] != b[j]), swap)
        assert texts.distance(a, b) == table[len(a) - 1, len(b) - 1]
        assert texts.distance(a, b, False) == duckdb.sql(f"select damerau_levenshtein('{a}', '{b}')").fetchall()[0][0]
    assert texts.altered("one two three", "one <proposition>two</proposition> three", ["two"]) == [] and "Diff" in texts.altered("one two three", "four", [])[0] and texts.altered(None, "x", []) is None
    long = " ".join(f"w{i}" for i in range(300))
    assert texts.altered(long, "", ["w5 w6", "w9"]) == [] and "missing" in texts.altered(long, "", ["zz"])[0] and "mixup" in texts.altered(long, "", ["w299" * 1, "w298 w299", "w1 w2"])[-1]


def test_plain_scalars():
    said = {"yes": True, "Off": False, "yEs": "yEs", "010": 8, "0": 0, "1_000": 1000, "0x1F": 31, "0b101": 5, "1:30": 90, "-7": -7, "nan": "nan", ".5": 0.5, "1e3": "1e3", "1.5e+3": 1500.0, "-.inf": float("-inf"), "~": None, "": None, "09": "09", "a b": "a b"}
    for text, value in said.items():
        got = reading.data("{k: %s}" % text)["k"]
        assert got == value and type(got) is type(value), text
    assert reading.data("{k: .nan}")["k"] != reading.data("{k: .nan}")["k"]


def test_integrity_options(spark):
    df = requests(spark, "```xml\n<proposition id=\"1\">one two three four</proposition> five\n```\n", source="one two three fourth five and six")
    wrong = lambda config: [x["message"] for x in judging.verify(df, "arganno", config, source="source").first()["results"] if "SourceTextIntegrity" in x["verifier_id"]][0]
    assert "Diff" in wrong({}) and wrong({"levenshtein_tolerance": 0.5}) is None and wrong({"allow_source_text_shortening_wc_threshold": 3}) is None
    with pytest.raises(judging.InvalidConfigError):
        judging.verify(df, "arganno", {"levenshtein_tolerance": "much"})


def test_sentences(spark, monkeypatch):
    """Abbreviations of a corpus, and texts cut by them, whether the model is sent or joined."""
    texts_ = ["The Abt. came at night. It left.", "An Abt. of ours. Nobody saw the Abt. there.", "He met the king. The king left. They saw a king."] * 30 + [None, "", " ... "] + ["one night he left us there and ours was left there that night with ours"] * 9
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "id long, text string")
    model = learned.abbreviations(df)
    assert {r["word"] for r in model.collect()} == {"abt"}
    want = {0: ["The Abt. came at night.", "It left."], 1: ["An Abt. of ours.", "Nobody saw the Abt. there."], 2: ["He met the king.", "The king left.", "They saw a king."], 90: None, 91: [], 92: ["..."]}
    for sent in (10, 0):
        monkeypatch.setattr(learned, "SENT", sent)
        got = {r["id"]: r["sentences"] for r in learned.cut(df, model, "id").collect()}
        assert len(got) == 102 and all(got[i] == x for i, x in want.items())
    one = lambda t: spark.range(1).select(texts.sentences(F.lit(t))).first()[0]
    assert one("Dr. Smith came.") == ["Dr. Smith came."] and one("He left (cf. Vol. 2). Then J. R. Doe came! \"Why?\" she said. No") == ["He left (cf. Vol. 2).", "Then J. R. Doe came!", "\"Why?\" she said.", "No"]


def test_checks_that_fail(spark):
    """A registered function that raises gives one invalid result; other blocks, checks and rows go on."""

    def short(block):
        if "bad" in block["snippet"]:
            raise KeyError("no such thing")
        return None if not block["graph"]["propositions"] else [] if len(block["graph"]["propositions"]) < 3 else ["too many", "claims"]

    before = dict(judging.VERIFIERS)
    try:
        judging.register_function("argmap", "Own.Short", short)
        df = requests(spark, fenced(("map.ad", "[A]: a")), fenced(("map.ad", "[bad]: a")), fenced(("map.ad", "[A]: a\n\n[B]: b\n\n[C]: c")), fenced(("map.ad", "")), None, fenced(("map.ad", "[A]: a"), ("map.ad", "[B]: bad")))
        got = {r["request_id"]: [(x["is_valid"], x["message"], len(x["refs"])) for x in r["results"] if x["verifier_id"] == "Own.Short"] for r in judging.verify(df, "argmap").collect()}
        rest = {r["request_id"]: (r["is_valid"], len(r["results"])) for r in judging.verify(df, "argmap").collect()}
    finally:
        judging.VERIFIERS.clear()
        judging.VERIFIERS.update(before)
    failed = (False, "Processing error: 'no such thing'", 0)
    assert got == {0: [(True, None, 1)], 1: [failed], 2: [(False, "too many claims", 1)], 3: [], 4: [], 5: [(True, None, 1), failed]}
    assert rest[0] == (True, 5) and rest[1] == (False, 5) and rest[3][1] == 4
    assert judging.executed(judging.get_verifier("argmap"))[0] == "HasArgdownHandler"


def test_long_distances():
    """Texts beyond a machine word against the table of the definition, row by row; a long pair; and bounds."""
    rng = random.Random(2)
    for _ in range(60):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(60, 200)))
        b = list(a)
        for _ in range(rng.randrange(40)):
            i = rng.randrange(len(b) - 1)
            b[i : i + 2] = rng.choice([[b[i + 1], b[i]], ["x", b[i], b[i + 1]], [b[i]], [rng.choice("abcd"), b[i + 1]]])
        b = "".join(b)
        rows = [list(range(len(b) + 1))]
        for i, c in enumerate(a):
            rows.append([i + 1])
            for j, d in enumerate(b):
                near = [rows[i][j] + (c != d), rows[i + 1][j] + 1, rows[i][j + 1] + 1]
                rows[i + 1].append(min(near + ([rows[i - 1][j - 1] + 1] if i and j and c == b[j - 1] and a[i - 1] == d else [])))
        exact = rows[-1][-1]
        assert texts.distance(a, b) == texts.distance(b, a) == exact
        for most in (exact - 1, exact, exact + 3):
            assert texts._within(a, b, most) == (exact <= most)
    long = "".join(rng.choice("abcdefgh ") for _ in range(33_000))
    began = time.time()
    assert texts.distance(long, "q" + long[:-1]) == 2 and not texts._within(long, long[::-1], 300)
    assert time.time() - began < 10


def test_repetitions():
    head = [f"line {i}" for i in range(16)]
    cut = lambda lines, **k: texts.without_repetitions("\n".join(lines), **k).split("\n")
    assert cut([*head, "B", "B", "B", "B", ""]) == [*head, "B", "B", "B", ""] and cut([*head, *["again"] * 9, "aga"]) == [*head, *["again"] * 3, "aga"]
    assert cut([*head, "B", "B", "B", "B", "C"]) == [*head, "B", "B", "B", "B", "C"] and cut([*head, "B", "B", "B", "B"]) == [*head, "B", "B", "B", "B"]
    assert cut([*head, *["a", "b"] * 6, "a"]) == [*head, *["a", "b"] * 3, "a"] and cut([*head, *["a", "b", "c"] * 5, ""]) == [*head, *["a", "b", "c"] * 3, ""]
    assert cut(["x"] * 16) == ["x"] * 16 and cut(["x"] * 40) == ["x"] * 16 and cut([*head, *[""] * 30]) == [*head, *[""] * 30] and cut([*head, *["a", ""] * 9, "a"]) == [*head, *["a", ""] * 9, "a"]
    assert cut(["x"] * 9, keep=1, least=4) == ["x"] * 4


def test_inference_chains(spark):
    """A chain of 40 steps, a cycle, and what no step leads to."""
    item = lambda n, *refs: f"(%d) [P%d]: x" % (n, n) if not refs else "-- {from: [%s]} --\n(%d) [P%d]: x" % (", ".join(f'"{r}"' for r in refs), n, n)
    chain = [item(1), item(2), *[item(n, n - 1) for n in range(3, 43)]]
    circle = [item(1), item(2, 3), item(3, 2), item(4, 1), item(5, 3)]
    read = extraction.read(requests(spark, *[fenced(("r", "<A>: g\n\n" + "\n".join(x))) for x in (chain, circle)])).select("request_id", extraction.last("argdown")["graph"]["arguments"][0].alias("a"))
    used = read.select("request_id", coherence.used_for(F.col("a"), F.try_element_at("a.pcs", F.lit(-1))["label"]).alias("u")).collect()
    assert {r["request_id"]: {int(x) for x in r["u"]} for r in used} == {0: set(range(2, 42)), 1: {2, 3}}


def test_large_maps(spark):
    """5,000 arguments of one claim, read and measured in seconds."""
    body = "[C]: c\n" + "\n".join(f"  {'<+' if i % 3 else '<-'} <A{i}>: a" for i in range(5000))
    b = extraction.read(requests(spark, fenced(("map.ad", body)))).select(extraction.last("argdown").alias("b"))
    began = time.time()
    got = b.select(scores.map_max_in_degree(F.col("b")), scores.map_max_out_degree(F.col("b")), scores.map_min_leafs(F.col("b")), scores.map_density(F.col("b")), F.size(checks.MAP["CompleteClaimsHandler"](F.col("b")))).first()
    assert tuple(got) == (5000.0, 1.0, 1 / 5001, 2 * 5000 / (5001 * 5000), 0) and time.time() - began < 30


def test_shapes():
    assert shape(["a", "b", "c", "d"], [("a", "b"), ("b", "c")]) == {"components": 2, "longest": 2} and shape([], []) == {"components": 0, "longest": 0}
    assert shape(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")]) == {"components": 1, "longest": 1} and shape(["a", "b", "c"], [("a", "b"), ("b", "a")]) == {"components": 2, "longest": None}


MAP = ("map.ad", "[A1]: First claim.\n[A2]: Second claim.\n[A3]: Third claim.\n\n<Argument1>\n    + [A1]\n    +> [A2] // Support\n<Argument2>\n    + [A3]\n    -> [A2]")
RECO = (
    "reconstructions.ad",
    '<Argument1>: First.\n\n(P1) [A1]: First claim. {formalization: "P", declarations: {"P": "one"}}\n-- {from: ["P1"]} --\n(C1) [A2]: Second claim. {formalization: "Q", declarations: {"Q": "two"}}\n\n'
    '<Argument2>: Second.\n\n(P1) [A3]: Third claim. {formalization: "R", declarations: {"R": "three"}}\n(P2) Implicit premise. {formalization: "R -> -Q", declarations: {}}\n-- {from: ["P1", "P2"]} --\n(C1) NOT: Second claim. {formalization: "-Q"}\n    -> [A2] // Attack',
)


def verdicts(df):
    return {(r["request_id"], r["verifier_id"]): r["is_valid"] for r in judging.rows_of(df).collect()}


def test_map_and_logical_reconstruction(spark):
    wrong = (RECO[0], RECO[1].replace("    -> [A2] // Attack", ""))
    got = verdicts(judging.verify(requests(spark, fenced(MAP, RECO), fenced(MAP, wrong), fenced(RECO, MAP), fenced(MAP)), "argmap_logreco"))
    assert got[0, "ArgmapLogreco.ElemCohereHandler"] and got[0, "ArgmapLogreco.RelationCohereHandler"] and got[0, "ArgmapInfreco.RelationCohereHandler"]
    assert got[0, "LogReco.WellFormedFormulasHandler"] and not got[0, "LogReco.GlobalDeductiveValidityHandler"] and got[0, "LogReco.PremisesConsistentHandler"] and got[0, "LogReco.FormallyGroundedRelationsHandler"]
    assert not got[1, "ArgmapLogreco.RelationCohereHandler"] and (2, "ArgmapLogreco.RelationCohereHandler") not in got and not got[3, "HasArgdownHandler.reco"]


def test_steps_of_inference_and_dialectics(spark):
    body = '<A>: g\n\n(1) [P]: p\n(2) [Q]: q\n-- {from: ["1"]} --\n(3) [R]: r\n-- {from: ["3", "2"]} --\n(4) [S]: NOT: p\n    +> [T]\n\n[T]: t\n    -> [U]\n\n[V]: p'
    b = extraction.read(requests(spark, fenced(("x", body)))).select(extraction.last("argdown").alias("b"))
    claim = lambda x: F.get(F.filter(F.col("b.graph.propositions"), lambda p: p["label"] == x), F.lit(0))
    b, argument = b, F.col("b.graph.arguments")[0]
    g, lit = F.col("b"), F.lit
    row = b.select(
        F.array_sort(coherence.used_for(argument, lit("4"))), F.array_sort(coherence.used_for(argument, lit("3"))), coherence.identical(claim("P"), claim("V")), coherence.identical(claim("P"), claim("Q")), coherence.contradictory(claim("S"), claim("P"), g), coherence.contradictory(claim("Q"), claim("P"), g),
        coherence.indirectly(lit("S"), lit("T"), g, "SUPPORT"), coherence.indirectly(lit("S"), lit("U"), g, "ATTACK"), coherence.indirectly(lit("S"), lit("U"), g, "SUPPORT"), coherence.strictly_identical(claim("S"), claim("T"), g), coherence.strictly_contradictory(claim("T"), claim("U"), g), coherence.indirectly(lit("S"), lit("S"), g, "ATTACK"),
    ).first()
    assert list(row) == [["1", "2", "3"], ["1"], True, False, True, False, True, True, False, False, False, False]


def test_annotation_and_reconstruction(spark):
    xml = '```xml {filename="annotation.txt"}\n<proposition id="1" argument_label="A" ref_reco_label="1" supports="2">x</proposition><proposition id="2" argument_label="A" ref_reco_label="2">y</proposition>\n```\n'
    body = '<A>: g\n\n(1) [P]: x {annotation_ids: ["1"]}\n-- {from: ["1"]} --\n(2) [Q]: y {annotation_ids: ["2"]}'
    bad = body.replace('["2"]}', '["1"]}')
    got = verdicts(judging.verify(requests(spark, xml + fenced(("r", body)), xml.replace('supports="2"', 'attacks="2"') + fenced(("r", bad)), xml.replace('id="1" a', 'id="1" supports="1" a').replace('supports="2"', "") + fenced(("r", body))), "arganno_infreco"))
    assert got[0, "ArgannoInfreco.ElemCohereHandler"] and got[0, "ArgannoInfreco.RelationCohereHandler"]
    assert not got[1, "ArgannoInfreco.ElemCohereHandler"] and not got[1, "ArgannoInfreco.RelationCohereHandler"] and not got[2, "ArgannoInfreco.RelationCohereHandler"]


def test_text_scores(spark):
    read = extraction.read(requests(spark, fenced(MAP, RECO), source="First claim. Second claim."), source="source", logic=True)
    g, r, src = extraction.last("argdown", [("filename", "map.ad", False)]), extraction.last("argdown", [("filename", "rec", True)]), F.col("source")
    got = read.select(scores.map_diverse_labels(g), scores.map_long_claims(g), scores.map_short_claims(g), scores.map_independent_wording(g, src), scores.source_text_proximity(g, src), scores.logic_faithfulness(r), scores.reco_verbosity(r), scores.logic_predicate_logic(r), scores.snippet_proximity(g, r), scores.map_argument_claim_size(g)).first()
    claims = ["First claim.", "Second claim.", "Third claim."]
    mean = sum(texts.relative("First claim. Second claim.", c) for c in claims) / 3
    assert list(got)[:4] == [round(texts.relative("Argument1", "Argument2"), 2), 10.0, 0.1, round(mean, 1)] and got[5] == round(sum(1 - texts.relative(a, b) for a, b in (("one", claims[0]), ("two", claims[1]))) / 2, 1) and got[6:8] == (10.0, 0.0) and got[9] == 0.0


def test_registry(spark):
    assert {"arganno", "argmap", "infreco", "logreco", "arganno_argmap_logreco"} <= {r["name"] for r in judging.list_verifiers(spark).collect()}
    df = requests(spark, fenced(("m.ad", "[A]: x\n\nno label"), ("n.ad", "[A]: x")))
    for action, error in ((lambda: judging.verify(df, "nothing"), judging.VerifierNotFoundError), (lambda: judging.verify(df, "argmap", {"size": 1}), judging.InvalidConfigError), (lambda: judging.verify(df, "argmap", {"from_key": 1}), judging.InvalidConfigError), (lambda: judging.verify(df, "argmap", filters={"arganno": []}), judging.InvalidFilterError), (lambda: judging.verify(df, "argmap", filters={"argmap": [{"key": "a", "value": "(", "regex": True}]}), judging.InvalidFilterError), (lambda: judging.judge(df, "argmap"), judging.InvalidConfigError)):
        with pytest.raises(error):
            action()
    assert not judging.verify(df, "argmap").first()["is_valid"] and judging.verify(df, "argmap", filters={"argmap": {"filename": "n.ad"}}).first()["is_valid"]
    assert judging.Request("argmap").filter("argmap", "filename", "n", True).run(df).first()["is_valid"]
    judging.register_check("has_argdown", "Own", lambda b: checks.one(F.size(checks.claims(b)) > 0, "There are claims."), "argmap")
    judging.register_score("has_annotations", "own", lambda blocks, source: F.lit(0.5))
    try:
        assert verdicts(judging.verify(df, "has_argdown")) == {(0, "HasArgdownHandler"): True, (0, "Own"): False}
        assert judging.verify(requests(spark, "```xml\nx\n```"), "has_annotations").first()["scores"][0]["score"] == 0.5
        assert judging.verifier_info("has_annotations")["scorers"] == ["own"]
    finally:
        judging.VERIFIERS.update(judging._verifiers())


def test_judged_metrics_and_prompts(spark):
    rows = [("p", 1, fenced(("m", "[A]: x")), "Q"), ("p", 2, fenced(("m", "x\n\n[A]: y\n\n[A]: z")), "Q"), ("p", 3, None, "Q")]
    judged = judging.judge(spark.createDataFrame(rows, "problem_id string, sol_pos int, raw_answer string, prompt string"), "argmap")
    got = {r["sol_pos"]: r for r in judged.collect()}
    assert [m["key"] for m in got[1]["metrics"]] == ["01_HasArgdownHandler", "02_ArgMap.CompleteClaimsHandler", "03_ArgMap.NoDuplicateLabelsHandler", "04_ArgMap.NoPCSHandler"] and got[1]["is_valid"] and not got[3]["is_valid"]
    asked = {r["sol_pos"]: r["feedback_prompt"] for r in problems.feedback_requests(judged).collect()}
    assert set(asked) == {2, 3} and "- **03_ArgMap.NoDuplicateLabelsHandler**: Duplicate labels: A" in asked[2]
    out = judged.select("sol_pos", problems.asking_for_invalid(F.col("prompt"), F.col("metrics")).alias("a"), problems.with_hints(F.col("prompt"), F.array(F.lit("h"), F.lit("i"))).alias("h"), problems.rendered(F.col("artifacts"), F.col("raw_answer"), ("argmap",)).alias("r"), preference.bare_errors(F.col("metrics")).alias("e")).orderBy("sol_pos").collect()
    assert out[1]["a"].count(problems.WARNING) == 2 and "- ArgMap.CompleteClaimsHandler: Missing labels" in out[1]["a"] and out[0]["h"] == "Q\n\nHints: h - i" and out[2]["r"] == "None" and out[1]["e"] == ["ArgMap.CompleteClaimsHandler", "ArgMap.NoDuplicateLabelsHandler"]
    nexts = problems.sequential_problems(judged, "arganno_from_argmap").collect()
    assert len(nexts) == 1 and "[A]: x" in nexts[0]["prompt"] and "imperfect" not in nexts[0]["prompt"]
    made = problems.problems(spark.createDataFrame([("p", ["<b>a</b> ", "b"])], "problem_id string, sources array<string>"), "annotation").first()
    assert made["sources"] == "a \n\n-----\n\nb" and made["sources"] in made["prompt"]
    kept = problems.ingested(spark.createDataFrame([("p", 1, "x"), ("p", 2, "x"), ("p", 3, " "), ("p", 4, None), ("q", 1, "x")], "problem_id string, sol_pos int, raw_answer string"))
    assert {(r["problem_id"], r["sol_pos"]) for r in kept.collect()} == {("p", 1), ("q", 1)}
    chat = judged.select(problems.as_chat(F.col("prompt"), F.lit("new"), F.col("raw_answer"), F.lit("how?"), F.lit("so")).alias("c"), "sol_pos").collect()
    assert {r["sol_pos"]: len(r["c"]) for r in chat} == {1: 6, 2: 6, 3: 2}


def test_self_critique(spark):
    solutions = spark.createDataFrame([("p", 1, "a1", False, ["e"]), ("p", 2, "a2", False, ["f"]), ("q", 1, "b1", True, []), ("q", 2, "b2", False, ["e"]), ("r", 1, "c1", False, ["e"]), ("r", 2, "c2", False, [])], "problem_id string, sol_pos int, raw_answer string, is_valid boolean, errors array<string>")
    feedbacks = spark.createDataFrame([("p", 1, 1, "f1"), ("p", 1, 2, "f2"), ("p", 1, 3, "f3"), ("p", 2, 1, "g1")], "problem_id string, sol_pos int, feedback_pos int, feedback string")
    revisions = spark.createDataFrame([("p", 1, 1, 1, "x1", False), ("p", 1, 2, 1, "x2", True), ("p", 1, 2, 2, "x3", False), ("p", 1, 3, 1, "x4", True), ("p", 2, 1, 1, "y1", True), ("p", 2, 1, 2, "y2", True)], "problem_id string, sol_pos int, feedback_pos int, rev_pos int, raw_answer string, is_valid boolean")
    got = {tuple(r) for r in preference.self_critique_pairs(solutions, feedbacks, revisions).collect()}
    assert got == {("p", 1, 2, "revision", "x2", "x3"), ("p", 1, 2, "feedback", "f2", "f1"), ("p", 2, 1, "original_revision", "y1", "a2")}
    every = {(r["problem_id"], r["kind"], r["chosen"], r["rejected"]) for r in preference.all_pairs(solutions, feedbacks, revisions).collect()}
    assert ("q", "validity", "b1", "b2") in every and ("r", "failure", "c2", "c1") in every and len(every) == 5
    scored = spark.createDataFrame([(f"p{i}", j, f"a{j}", j < 3, [], float(j), 1.0) for i in range(40) for j in range(3 + i % 2)], "problem_id string, sol_pos int, raw_answer string, is_valid boolean, errors array<string>, u double, v double")
    pairs = {r["problem_id"]: r for r in preference.solution_pairs(scored, ["u", "v"]).collect()}
    assert all(pairs[f"p{i}"]["kind"] == "u" and pairs[f"p{i}"]["chosen"] == 2 for i in range(0, 40, 2)) and {pairs[f"p{i}"]["kind"] for i in range(1, 40, 2)} == {"u", "validity"}


def test_validity_rate_of_a_stream(spark, tmp_path):
    """Finished windows of a stream are those of the table."""
    from argloom.streaming.validity import validity_rate

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    rates = validity_rate(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), F.col("value") >= 50)
    rates.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got, want = ({tuple(r) for r in df.collect()} for df in (spark.read.parquet(str(tmp_path / "out")), validity_rate(events, F.col("value") >= 50)))
    assert got and got <= want


def test_metrics_count_every_error(spark):
    rows = [("p", 1, True, []), ("p", 2, False, ["03_other", "03_other", "01_quality"]), ("p", 3, None, ["03_other", None]), ("q", 1, True, None), (None, 1, False, ["04"])]
    got = preference.metrics(spark.createDataFrame(rows, "problem_id string, sol_pos int, is_valid boolean, errors array<string>"))
    assert {tuple(r)[:3] + (tuple(sorted(r["error_counts"].items())),) for r in got.collect()} == {("p", 3, 0.5, (("01_quality", 1), ("03_other", 2))), ("q", 1, 1.0, ()), (None, 1, 0.0, (("04", 1),))}


def test_requests_without_blocks(spark):
    answers = spark.createDataFrame([(1, "```xml\na\n```\n```xml\nb\n```"), (2, "```xml never closed"), (3, "```argdown\n[A\n```"), (4, None), (None, "```xml\nc\n```")], "request_id long, answer string")
    found = extraction.blocks(answers)
    for dtype, name, want in (("xml", "has_annotations", {1, None}), ("argdown", "has_argdown", {3})):
        got = [tuple(r) for r in checks.has_block(answers, found, "request_id", dtype, name).collect()]
        assert sorted(got, key=str) == sorted(((k, name, k in want) for k in (1, 2, 3, 4, None)), key=str)


def test_plans_from_configuration(spark):
    from argloom.plans import factory

    assert factory.pairs_from_config({"judge": "nothing"}) is None and factory.pairs_from_config({}) is None and factory.evaluator_from_config({"judge": 1}) is None
    with pytest.raises(ValueError):
        factory.get_part("virtue.none")
    good, better, bad = fenced(("m", "[A]: x")), fenced(("m", "[A]: x\n    + <B>: y")), fenced(("m", "x"))
    solutions = spark.createDataFrame([("p", 1, good), ("p", 2, bad), ("q", 1, bad), ("q", 2, None), ("r", 1, good), ("r", 2, better)], "problem_id string, sol_pos int, raw_answer string")
    feedbacks = spark.createDataFrame([("q", 1, 1, "f")], "problem_id string, sol_pos int, feedback_pos int, feedback string")
    revisions = spark.createDataFrame([("q", 1, 1, 1, good), ("q", 1, 1, 2, bad)], "problem_id string, sol_pos int, feedback_pos int, rev_pos int, raw_answer string")
    made = factory.pairs_from_config({"judge": "argmap", "virtues": ["map_max_args"]})(solutions, feedbacks, revisions)
    got = {(r["problem_id"], r["kind"]): (r["chosen"], r["rejected"]) for r in made.collect()}
    assert got[("p", "validity")] == (good, bad) and got[("q", "revision")] == (good, bad) and got[("r", "map_max_args")] == (better, good)
    counts = {r["problem_id"]: (r["n_solutions"], r["accuracy"], r["error_counts"]) for r in factory.evaluator_from_config({"judge": "argmap"})(solutions).collect()}
    assert counts["p"] == (2, 0.5, {"ArgMap.CompleteClaimsHandler": 1}) and counts["r"] == (2, 1.0, {})
