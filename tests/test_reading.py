"""How answers are read: few at a time, once, and only what is wanted of them."""

import random
import textwrap
import time

from pyspark import AccumulatorParam
from pyspark.sql import functions as F

from argloom.functions import reading
from argloom.operators import extraction, scores
from argloom.plans import judging, queries
from argloom.sources import artifacts

TOKENS = ['<proposition id="1">', "</proposition>", "<b>", "</b>", "text ", "x\n", '<Proposition SUPPORTS="1 2" id="">', '<a id="1" id="2">', "</a>", "<br/>", "&amp;", "<p>", "</P>", " > ", "<", "<!-- c -->", "</ b>", "<i x=1>", "<script>", "</script>", "<h1>", "é", '<claim mood="sad">', "</nope>"]


def test_plain_markup_is_read_as_by_the_lenient_reader():
    rng, plainly = random.Random(3), 0
    for i in range(6000):
        body = "".join(rng.choice(TOKENS[:13] if i % 3 else TOKENS) for _ in range(rng.randrange(12)))
        plainly += reading._plainly(body) is not None
        assert reading.annotation(body) == (reading._Elements(body).found, reading.plain(body)), body
    assert plainly > 1000


def test_shortened_as_by_the_library():
    rng, words = random.Random(4), ["a", "bc", "longwordlongword" * 5, "é f", "z.", "\t", " ", "<t", "w-x", "--"]
    for i in range(6000):
        text = " ".join(rng.choice(words[: 8 if i % 2 else 10]) for _ in range(rng.randrange(30)))
        width = rng.choice([7, 10, 20, 40, 64])
        assert reading.shorten(text, width) == textwrap.shorten(text, width)


def _most():
    class Most(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):  # noqa: N802: named by Spark
            return max(a, b)

    return Most()


def test_few_answers_in_memory(spark):
    """A batch of Spark's has up to 10,000 answers; what is read of them takes many times their texts."""
    most = spark.sparkContext.accumulator(0, _most())
    answers = spark.range(0, 1000, 1, 1).selectExpr("id AS request_id", "concat('```xml\\n<proposition id=\"', id, '\">x</proposition>\\n```\\n') AS inputs")
    rows = extraction.read(answers, counter=most).collect()
    assert 0 < most.value <= 64
    assert sorted(r["blocks"][0]["elements"][0]["id"] for r in rows) == sorted(str(i) for i in range(1000))


def test_few_characters_in_memory(spark):
    """Long answers are read fewer at a time than short ones, so that what is read of them takes no more."""
    most = spark.sparkContext.accumulator(0, _most())
    answers = spark.range(0, 40, 1, 1).selectExpr("id AS request_id", "concat('```argdown\\n<A>: ', repeat('word ', 30000), '\\n```\\n') AS inputs")
    rows = extraction.read(answers, counter=most).select("request_id", F.size("blocks.graph.arguments").alias("n")).collect()
    assert 0 < most.value <= 4
    assert sorted(map(tuple, rows)) == [(i, 1) for i in range(40)]


def test_wide_pairs(spark):
    """A map of 300 relations and their reconstructions: nodes are looked up, not searched for once more for every relation and premise."""
    drawn = "".join(f"\n    {'<+' if i % 2 else '<-'} <A{i}>: G." for i in range(300))
    made = "".join(f"\n\n<A{i}>: G.\n\n(1) [P{i}]: P{i}.\n-- {{from: [\"1\"]}} --\n(2) " + ("[End]" if i % 2 else f"[N{i}]: No.\n    >< [End]" if i % 4 else f"[M{i}]: Else.") for i in range(300))
    inputs = f'```argdown {{filename="map.ad"}}\n[End]: It is.{drawn}\n```\n```argdown {{filename="reconstructions.ad"}}\n[End]: It is.{made}\n```\n'
    began = time.time()
    row = judging.judge(spark.createDataFrame([(1, inputs)], "sol_pos long, raw_answer string"), "argmap_plus_infreco").first()
    said = [m["message"] for m in row["metrics"] if "RelationCohere" in m["key"]]
    assert said == [" - ".join(f"Sketched attack relation from <A{i}> to [End] in argument map is not grounded in the argument reconstruction, proposition [End] does not contradict the conclusion of <A{i}>." for i in range(0, 300, 4))]
    assert time.time() - began < 60


def test_shape_of_a_graph_is_asked_for_once(spark):
    """Three measures of a map's shape share one function, which gets a row at a time."""
    inputs = "```argdown\n[A]: Claim.\n    <+ <B>: G.\n        <- <C>: H.\n```\n"
    blocks = extraction.read(spark.createDataFrame([(1, inputs)], "request_id long, inputs string")).select(extraction.last("argdown").alias("b"))
    out = blocks.select(scores.map_connectedness(F.col("b")), scores.map_max_diameter(F.col("b")), scores.map_min_diameter(F.col("b")))
    assert tuple(out.first()) == (1.0, 2.0, 1 / 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert next(x for x in plan.splitlines() if "ArrowEvalPython" in x).split("], [")[0].count("each(") == 1


def test_lines_are_dealt_once(spark):
    lines = spark.createDataFrame([(k, n, k * 7 + n, n) for k in range(20) for n in range(1, 4)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = artifacts.annotations(lines)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange") == 1


def test_only_what_is_wanted_is_read(spark):
    answers = spark.createDataFrame([(1, "```argdown\n[A]: One.\n```\n```argdown\n[A\n```\n")], "request_id long, inputs string")
    (row,) = extraction.read(answers, carried=["request_id"], ids=False, bare=True).collect()
    assert row.asDict().keys() == {"request_id", "blocks"}
    assert [(b["graph"], b["error"] is None) for b in row["blocks"]] == [(None, True), (None, False)]
    assert [r["is_valid"] for r in queries._parses(answers).collect()] == [True, False]


def test_what_follows_from_answers_is_evaluated_once_for_each(spark):
    """Rows with the same text get what follows from it, not its blocks; where nothing is shared, the same comes out."""
    text = "```argdown\n<A>: Gist.\n\n(1) [P]: One. {formalization: \"p\", declarations: {p: \"it is so\"}}\n-- {from: [\"1\"]} --\n(2) [Q]: Two. {formalization: \"p\"}\n```\n"
    answers = spark.createDataFrame([(i, text if i % 3 else text + "!") for i in range(30)] + [(30, "none"), (31, None)], "request_id long, inputs string")
    then = lambda df: [F.transform("blocks", lambda b: b["dtype"]).alias("kinds")]
    want = sorted([(i, ["argdown"]) for i in range(30)] + [(30, []), (31, None)], key=lambda r: r[0])
    shared = extraction.read(answers, carried=["request_id"], ids=False, then=then, logic=True)
    alone = extraction.read(answers, carried=["request_id"], ids=False, then=then)
    for df in (shared, alone):
        assert df.columns == ["request_id", "kinds"]
        assert [(i, k or (None if i == 31 else k)) for i, k in sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])] == want
    out = judging.judge(answers, "logreco", "inputs", key="request_id").collect()
    assert len(out) == 32 and {r["is_valid"] for r in out if r["request_id"] >= 30} == {False}
    assert len({str(r["metrics"]) for r in out if r["request_id"] < 30}) == 1
