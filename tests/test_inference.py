"""Arguments of formulas: tables against brute force, forms that are decided, and what is read or judged once."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from argloom.functions import formulas
from argloom.functions.reading import Keys
from argloom.operators import checks, extraction, inference
from argloom.operators.logic import LOGIC_CHECKS, well_formed
from argloom.plans import judging


def judged(spark, rows):
    given = inference.arguments_of(spark, rows)
    found = {r["i"]: r["verdict"] for r in given.select("i", "key").join(inference.judged(given), "key").collect()}
    return [found[i] for i in range(len(rows))]


def holds(f, m):
    if f[0] == "pred":
        return m[f]
    if f[0] == "not":
        return not holds(f[1], m)
    a, b = holds(f[1], m), holds(f[2], m)
    return {"and": a and b, "or": a or b, "imp": not a or b, "iff": a == b}[f[0]]


def test_truth_values(spark):
    """Random arguments of up to nine atoms, some with terms, against all assignments."""
    rng = random.Random(1)
    atoms = [("pred", x) for x in "PQRSTU"] + [("pred", "F", "a"), ("pred", "F", "b"), ("pred", "G", "a", "b")]

    def make(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice(atoms)
        kind = rng.choice(["and", "or", "imp", "iff", "not"])
        return (kind, make(depth - 1)) if kind == "not" else (kind, make(depth - 1), make(depth - 1))

    cases = [([make(3) for _ in range(rng.randrange(1, 4))], make(2)) for _ in range(80)]
    worlds = [dict(zip(atoms, w, strict=True)) for w in itertools.product([False, True], repeat=len(atoms))]
    follows = lambda ps, c: all(holds(c, m) for m in worlds if all(holds(p, m) for p in ps))
    got = judged(spark, [([formulas.plain(p) for p in ps], formulas.plain(c)) for ps, c in cases])
    for (ps, c), v in zip(cases, got, strict=True):
        assert v["valid"] == follows(ps, c) and v["consistent"] == any(all(holds(p, m) for p in ps) for m in worlds)
        assert v["spare"] == [follows(ps[:i] + ps[i + 1 :], c) for i in range(len(ps))]


def test_sixteen_symbols(spark):
    """As many symbols as are tabulated, and one more, which a proof takes on."""
    chain = lambda n: ([f"P{i} -> P{i + 1}" for i in range(n - 1)] + ["P0 | Z & -Z"], f"P{n - 1}")
    got = judged(spark, [chain(15), ([*chain(15)[0][1:]], "P14"), chain(30)])
    assert [v["valid"] for v in got] == [True, False, True] and not any(got[0]["spare"])


#: Arguments with whether they are valid.
FORMS = [
    (["all x.(F(x) -> G(x))", "F(a)"], "G(a)", True), (["all x.(F(x) -> G(x))", "G(a)"], "F(a)", False), (["F(a)"], "F(b)", False), (["F(a)", "a = b"], "F(b)", True), (["F(a)", "G(b)"], "exists x.(F(x) & G(x))", False),
    (["F(a)", "G(b)", "b = a"], "exists x.(F(x) & G(x))", True), (["all x.(F(x) -> G(x))", "all x.(G(x) -> H(x))"], "all x.(F(x) -> H(x))", True), (["all x.(F(x) -> H(x))", "all x.(G(x) -> H(x))"], "all x.(F(x) -> G(x))", False),
    ([f"a{i} = a{i + 1}" for i in range(14)], "a0 = a14", True), (["all x y.(F(x) & F(y) -> x = y)", "F(a)", "F(b)", "G(a)"], "G(b)", True), (["all x.F(x)"], "exists x.F(x)", True), (["all x.((F(x) | G(x)) -> H(x))", "G(a)"], "H(a)", True),
    (["all x.((exists y.R(x,y)) -> F(x))", "R(a,b)"], "F(a)", True), (["all x.(R(x,x) -> F(x))", "R(a,b)"], "F(a)", False), (["all x.(R(x,x) -> F(x))", "R(a,b)", "b = a"], "F(b)", True), (["R(a,b) <-> R(b,a)", "R(b,a)"], "R(a,b)", True),
    (["exists x.all y.R(x,y)"], "all y.exists x.R(x,y)", True), (["all y.exists x.R(x,y)"], "exists x.all y.R(x,y)", None), (["-F(a)", "all x.(F(x) | G(x))"], "G(a)", True), (["F(a) -> -G(a)", "G(a)"], "F(a)", False),
]


def test_forms(spark):
    got = judged(spark, [(ps, c) for ps, c, _ in FORMS])
    assert [v["valid"] for v in got] == [w for *_, w in FORMS]


def test_long_chains(spark):
    """31 constants, and proofs that run out of their bounds are unknown, not refuted."""
    order = ["all x y z.(R(x,y) & R(y,z) -> R(x,z))", *[f"R(c{i},c{i + 1})" for i in range(30)]]
    holes = [" | ".join(f"P{i}x{j}" for j in range(7)) for i in range(8)] + [f"-(P{i}x{j} & P{k}x{j})" for j in range(7) for i in range(8) for k in range(i)]
    given = inference.arguments_of(spark, [(order, "R(c0,c30)"), (order, "R(c30,c0)")])
    whole = given.withColumn("premises", F.slice("premises", 1, 40))
    assert {r["i"]: r["verdict"]["valid"] for r in whole.select("i", "key").join(inference.derived(whole), "key").collect()} == {0: True, 1: False}
    assert formulas.entails([formulas.read(h) for h in holes], formulas.read("Q & -Q")) is None
    assert formulas.entails([formulas.read(f"a{i} = a{i + 1}") for i in range(14)], formulas.read("a0 = a14")) is None  # why such are derived


RECO = """<A>: Gist.

(1) [P]: One. {{formalization: "{p}", declarations: {{F: "f", a: "thing"}}}}
(2) [Q]: Two. {{formalization: "all x.(F(x) -> G(x))", declarations: {{G: "g"}}}}
-- {{from: ["1", "2"]}} --
(3) [R]: Three. {{formalization: "{c}"}}"""


def answers(spark, rows):
    return spark.createDataFrame([(i, f"```argdown\n{x}\n```\n") for i, x in enumerate(rows)], "request_id long, inputs string")


def test_read_once(spark):
    """Answers that repeat are read once; formulas and arguments that repeat, in other answers too, are."""
    one, two = RECO.format(p="F(a)", c="G(a)"), RECO.format(p="F(a)", c="F(b)")
    df = answers(spark, [one, two, one] * 20).repartition(5)
    counter = spark.sparkContext.accumulator(0)
    plain = {r["request_id"]: r["blocks"][0]["graph"] for r in extraction.read(df).collect()}
    out = extraction.read(df, once=True, counter=counter).collect()
    assert counter.value == 2 and len(out) == 60 and all(r["blocks"][0]["graph"] == plain[r["request_id"]] for r in out)
    assert len({r["blocks"][0]["id"] for r in out}) == 60
    read = extraction.read(df, logic=True).select("request_id", extraction.last("argdown").alias("b"))
    got = {r[0]: r[1:] for r in read.select("request_id", *[check(F.col("b")).alias(n) for n, check in LOGIC_CHECKS.items()]).collect()}
    assert all(got[i] == ([], [], [], [], [], []) for i in range(0, 60, 3))
    wrong = got[1]
    assert wrong[0] == ["Variable 'b' in formalization 'F(b)' of proposition [R] is not declared anywhere."] and "not deductively valid" in wrong[1][0] and "(declare-const a UNIVERSAL) ;; thing" in wrong[1][0] and wrong[3:] == ([], [], [])


def stages(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow ") + plan.count("ArrowEvalPython")


def test_one_stage_reads(spark):
    """A filter on what was read is not pushed below the reading."""
    df = answers(spark, [RECO.format(p="F(a)", c="G(a)")])
    read = extraction.read(df).withColumn("b", extraction.last("argdown")).where("b is not null")
    assert stages(read.select("request_id", checks.RECONSTRUCTION["UsesAllPropsHandler"](F.col("b")).alias("m")).where("m is not null")) == 1


def test_other_keys(spark):
    body = RECO.format(p="F(a)", c="G(a)").replace("from:", "uses:").replace("formalization:", "fol:").replace("declarations:", "names:")
    df = answers(spark, [body, body.replace('{fol: "G(a)"}', "{k: 1}").replace("uses:", "by:")])
    options = {"from_key": "uses", "formalization_key": "fol", "declarations_key": "names"}
    found = {r["request_id"]: {x["verifier_id"]: x["message"] for x in r["results"]} for r in judging.verify(df, "logreco", options).collect()}
    assert found[0]["InfReco.HasInferenceDataHandler"] is None and found[0]["LogReco.WellFormedFormulasHandler"] is None and found[0]["LogReco.GlobalDeductiveValidityHandler"] is None
    assert "lacks 'uses' key" in found[1]["InfReco.HasInferenceDataHandler"] and "lacks fol key" in found[1]["LogReco.WellFormedFormulasHandler"]
    assert "is not a dict" in extraction.read(answers(spark, [body.replace('{F: "f", a: "thing"}', "3")]), keys=Keys("uses", "fol", "names"), logic=True).select(well_formed(Keys("uses", "fol", "names"))(extraction.last("argdown"))).first()[0][0]


def test_nothing_to_judge(spark):
    df = spark.createDataFrame([(1, "no block"), (2, None), (3, "```argdown\n[A\n```\n"), (4, "```argdown\n[A]: a\n```\n")], "request_id long, inputs string")
    read = {r["request_id"]: r["blocks"] for r in extraction.read(df, logic=True).collect()}
    assert read[1] == [] and read[2] == [] and read[3][0]["logic"] is None and read[4][0]["logic"]["formulas"] == []
    with pytest.raises(ValueError):
        formulas.arities(formulas.read("P(a) & P(a,b)"))
    known = {r["text"]: r["formula"]["error"] for r in inference.described(spark.createDataFrame([("P(a) & P(a,b)",), ("P &",), ("P",), (None,)], "text string")).collect()}
    assert known["P"] is None and known["P(a) & P(a,b)"] == "'P' has different numbers of terms" and known["P &"] and len(known) == 3
