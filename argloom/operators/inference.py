"""What formulas of answers say and what follows from them, as tables: distinct formulas are read once, distinct arguments judged once.

`described` reads every distinct formula. `arguments` are premises and a conclusion, whoever holds them; `judged` gives each of them an answer to
three questions (does the conclusion follow, which premises can it do without, may the premises be true together), or null: unknown.

1. Formulas without quantifiers and equalities, of up to SYMBOLS distinct atoms: each is a vector of truth values, one bit for every
   assignment, 64 of them in a long; programs are evaluated with bitwise operators, and what one premise adds is seen from the conjunctions of
   those before and behind it. Exact.
2. Premises that are facts, rules and equations, with a conclusion of such atoms: rows of facts are joined with bodies of rules until
   nothing new comes, equal terms are merged into the least one. What isn't among the facts then doesn't follow. Exact, and such premises
   may always be true together.
3. Others go to `formulas.entails`, one by one; beyond its bounds the answer is null.

Null texts give no formulas. Tables are written in `spark.checkpoint.dir` between rounds where the session names one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from argloom.functions import formulas

_ATOM = "struct<name:string,terms:array<string>>"
_RULES = f"array<struct<head:{_ATOM},body:array<{_ATOM}>>>"
_GOAL = f"struct<assume:array<{_ATOM}>,prove:array<{_ATOM}>>"
#: A formula in all its forms; `error` says what is wrong with a text that is none.
FORMULA = f"struct<error:string,plain:string,latex:string,smt:string,scheme:string,occurrences:array<struct<symbol:string,arity:int>>,program:array<string>,rules:{_RULES},goal:{_GOAL}>"
#: Answers on an argument: null is unknown. `spare` has an answer for each premise: whether the conclusion follows without it.
VERDICT = "struct<valid:boolean,spare:array<boolean>,consistent:boolean>"
#: Atoms of an argument that truth values are tabulated for.
SYMBOLS = 16
#: Values of the first six symbols over 64 assignments.
_PATTERNS = [sum(1 << w for w in range(64) if w >> i & 1) for i in range(6)]
_SIGNED = [p - (1 << 64) if p >> 63 else p for p in _PATTERNS]


def described(texts: DataFrame, text: str = "text") -> DataFrame:
    """text, formula: every distinct text, read once."""
    kind = to_arrow_type(_parse_datatype_string(FORMULA))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [formulas.described(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([{k: v for k, v in r.items() if k != "text"} for r in rows], kind)], names=["text", "formula"])

    out = texts.select(F.col(text).alias("text")).where("text is not null").distinct().mapInArrow(read, f"text string, formula {FORMULA}")
    return out.withColumn("formula", F.col("formula").withField("error", F.coalesce("formula.error", _arity_error(F.col("formula.occurrences")))))


def _arity_error(occurrences: Column) -> Column:
    """A predicate with different numbers of terms."""
    predicates = F.filter(occurrences, lambda o: o["arity"] >= 0)
    first = lambda s: F.get(F.filter(predicates, lambda o: o["symbol"] == s), F.lit(0))["arity"]
    bad = F.filter(predicates, lambda o: o["arity"] != first(o["symbol"]))
    return F.when(F.size(bad) > 0, F.concat(F.lit("'"), F.get(bad, F.lit(0))["symbol"], F.lit("' has different numbers of terms")))


def names(formula: Column) -> Column:
    """Distinct symbols of a formula, in order."""
    return F.array_distinct(F.transform(formula["occurrences"], lambda o: o["symbol"]))


def worded(formula: Column, meaning: Column) -> Column:
    """A formula in English; meaning is a map of symbols, others stand for themselves."""
    parts = F.split(formula["scheme"], "[{}]")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(meaning, x), x)).otherwise(x)), "")


def key_of(premises: Column, conclusion: Column) -> Column:
    """Arguments with the same key are the same: their formulas as written plainly."""
    return F.sha2(F.concat_ws("\n", F.transform(premises, lambda p: p["plain"]), F.lit("|-"), conclusion["plain"]), 256)


# 1. Truth values


def _leaf(position: Column, words: Column) -> Column:
    """The values of the symbol at a position, from 0."""
    pattern = F.element_at(F.array(*[F.lit(p) for p in _SIGNED]), F.least(position + 1, F.lit(6)))
    return F.when(position < 6, F.transform(words, lambda w: pattern)).otherwise(F.transform(words, lambda w: -_bit(w, position - 6)))


def _bit(word: Column, i: Column) -> Column:
    """A bit of the number of a word: a word holds 64 assignments of the first six symbols, its number those of the others."""
    return F.floor(word / F.pow(F.lit(2), i)).cast("long").bitwiseAND(F.lit(1).cast("long"))


def _vector(program: Column, symbols: Column, words: Column) -> Column:
    """Truth values of a program: operands are pushed, operators take the last one or two."""
    top = lambda s, n: F.element_at(s, F.lit(-n))
    rest = lambda s, n: F.slice(s, F.lit(1), F.size(s) - n)
    pair = lambda s, of: F.concat(rest(s, 2), F.array(F.zip_with(top(s, 2), top(s, 1), of)))

    def step(s: Column, w: Column) -> Column:
        return (
            F.when(w == formulas.NOT, F.concat(rest(s, 1), F.array(F.transform(top(s, 1), F.bitwise_not))))
            .when(w == formulas.AND, pair(s, lambda a, b: a.bitwiseAND(b)))
            .when(w == formulas.OR, pair(s, lambda a, b: a.bitwiseOR(b)))
            .when(w == formulas.IMP, pair(s, lambda a, b: F.bitwise_not(a).bitwiseOR(b)))
            .when(w == formulas.IFF, pair(s, lambda a, b: F.bitwise_not(a.bitwiseXOR(b))))
            .otherwise(F.concat(s, F.array(_leaf((F.array_position(symbols, w) - 1).cast("int"), words))))
        )

    return top(F.aggregate(program, F.array().cast("array<array<bigint>>"), step), 1)


def _and(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def _holds(premises: Column, conclusion: Column) -> Column:
    """Whether no assignment makes the premises true and the conclusion false."""
    return F.forall(F.zip_with(premises, conclusion, lambda p, c: p.bitwiseAND(F.bitwise_not(c))), lambda x: x == 0)


def tabulated(arguments: DataFrame) -> DataFrame:
    """key, verdict of arguments whose programs are known, by their truth values."""
    operators = F.array(*[F.lit(w) for w in (formulas.NOT, formulas.AND, formulas.OR, formulas.IMP, formulas.IFF)])
    rows = arguments.withColumn("symbols", F.array_except(F.array_distinct(F.flatten(F.concat(F.transform("premises", lambda p: p["program"]), F.array("conclusion.program")))), operators))
    rows = rows.withColumn("words", F.sequence(F.lit(0), F.expr("shiftleft(1, greatest(size(symbols) - 6, 0))") - 1))
    rows = rows.select("key", "words", F.transform("premises", lambda p: _vector(p["program"], F.col("symbols"), F.col("words"))).alias("p"), _vector(F.col("conclusion.program"), F.col("symbols"), F.col("words")).alias("c"))
    true = F.transform("words", lambda w: F.lit(-1).cast("long"))
    running = lambda xs: F.aggregate(xs, F.array(true), lambda a, x: F.concat(a, F.array(_and(F.element_at(a, F.lit(-1)), x))))
    rows = rows.select("key", "p", "c", running(F.col("p")).alias("before"), F.reverse(running(F.reverse("p"))).alias("behind"))
    whole = F.element_at("before", F.lit(-1))
    spare = F.transform("p", lambda x, i: _holds(_and(F.get("before", i), F.get("behind", i + 1)), F.col("c")))
    verdict = F.struct(_holds(whole, F.col("c")).alias("valid"), spare.alias("spare"), F.exists(whole, lambda x: x != 0).alias("consistent"))
    return rows.select("key", verdict.cast(VERDICT).alias("verdict"))


# 2. Facts and rules


#: Fixed values of this module: predicates of its own.
_EQUAL, _THERE, _SHOWN = "=", "!there", "!shown"


def _kept(df: DataFrame) -> DataFrame:
    """df without its lineage, in the folder that the session names; cached where it names none."""
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.cache()
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _is_variable(term: Column) -> Column:
    return F.startswith(term, F.lit("?"))


def _cases(arguments: DataFrame) -> DataFrame:
    """case, key, drop, premises, conclusion: each argument whole (drop -1) and without each of its premises."""
    drops = F.sequence(F.lit(-1), F.size("premises") - 1)
    rows = arguments.select("key", "premises", "conclusion", F.explode(drops).alias("drop"))
    kept = F.filter("premises", lambda p, i: i != F.col("drop"))
    return rows.select(F.concat_ws("#", "key", "drop").alias("case"), "key", "drop", kept.alias("premises"), "conclusion")


def _joined(bindings: DataFrame, facts: DataFrame) -> DataFrame:
    """Bindings of rules whose atom at `at` is found among the facts, one atom further; facts are met by the first of the atom's terms that is known."""
    atom = F.get("body", F.col("at"))
    known = F.filter(F.transform(atom["terms"], lambda t, j: F.struct(j.alias("j"), F.when(_is_variable(t), F.try_element_at("bound", t)).otherwise(t).alias("v"))), lambda x: x["v"].isNotNull())
    first = F.get(known, F.lit(0))
    rows = bindings.select("*", atom["name"].alias("a_name"), atom["terms"].alias("a_terms"), F.coalesce(first["j"], F.lit(-1)).alias("a_at"), F.coalesce(first["v"], F.lit("")).alias("a_value"))
    places = F.concat(F.array(F.struct(F.lit(-1).alias("j"), F.lit("").alias("v"))), F.transform("terms", lambda t, j: F.struct(j.alias("j"), t.alias("v"))))
    seen = facts.select(F.col("case").alias("f_case"), F.col("name").alias("f_name"), F.col("terms").alias("f_terms"), F.inline(places)).withColumnsRenamed({"j": "f_at", "v": "f_value"})
    met = rows.join(seen, (F.col("case") == F.col("f_case")) & (F.col("a_name") == F.col("f_name")) & (F.col("a_at") == F.col("f_at")) & (F.col("a_value") == F.col("f_value")) & (F.size("a_terms") == F.size("f_terms")))
    value = lambda t: F.when(_is_variable(t), F.try_element_at("bound", t)).otherwise(t)
    pairs = F.arrays_zip(F.col("a_terms").alias("a"), F.col("f_terms").alias("f"))
    met = met.where(F.forall(pairs, lambda x: F.coalesce(value(x["a"]) == x["f"], F.lit(True))))
    fresh = F.filter(pairs, lambda x: _is_variable(x["a"]) & F.try_element_at("bound", x["a"]).isNull())
    same = F.forall(fresh, lambda x: F.forall(fresh, lambda y: (x["a"] != y["a"]) | (x["f"] == y["f"])))
    new = F.map_from_entries(F.array_distinct(F.transform(fresh, lambda x: F.struct(x["a"], x["f"]))))
    return met.where(same).select("case", "head", "body", F.map_concat("bound", new).alias("bound"), (F.col("at") + 1).alias("at"))


def _merged(facts: DataFrame) -> DataFrame:
    """case, term, least: terms that are equal to others, each with the least of them; follows equations until nothing changes."""
    pairs = facts.where((F.col("name") == _EQUAL) & (F.size("terms") == 2)).select("case", F.get("terms", F.lit(0)).alias("a"), F.get("terms", F.lit(1)).alias("b")).where("a != b")
    edges = _kept(pairs.select("case", "a", "b").unionByName(pairs.select("case", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = edges.groupBy("case", F.col("a").alias("term")).agg(F.least(F.min("a"), F.min("b")).alias("least"))
    while True:
        roots = _kept(roots)
        near = edges.join(roots.select(F.col("case").alias("c"), F.col("term").alias("t"), F.col("least").alias("l")), (F.col("case") == F.col("c")) & (F.col("b") == F.col("t"))).groupBy("case", "a").agg(F.min("l").alias("l"))
        step = roots.join(near.withColumnsRenamed({"case": "c"}), (F.col("case") == F.col("c")) & (F.col("term") == F.col("a")))
        if step.where("l < least").isEmpty():
            return roots
        roots = step.select("case", "term", F.least("least", "l").alias("least"))


def _renamed(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """Facts with the least of equal terms in each place; equations of a term with itself stay, others are done with."""
    places = facts.select("case", "name", F.posexplode_outer("terms").alias("j", "t"), F.xxhash64("name", "terms").alias("f"))
    to = roots.select(F.col("case").alias("c"), "term", "least")
    out = places.join(to, (F.col("case") == F.col("c")) & (F.col("t") == F.col("term")), "left").groupBy("case", "name", "f").agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce("least", "t").alias("t")))).alias("ts"))
    return out.select("case", "name", F.transform(F.filter("ts", lambda x: x["j"].isNotNull()), lambda x: x["t"]).alias("terms")).distinct()


def derived(arguments: DataFrame) -> DataFrame:
    """key, verdict of arguments of facts and rules: these are joined until nothing new comes."""
    cases = _kept(_cases(arguments))
    said = F.concat(F.flatten(F.transform("premises", lambda p: p["rules"])), F.transform(F.col("conclusion.goal.assume"), lambda a: F.struct(a.alias("head"), F.array().cast(f"array<{_ATOM}>").alias("body"))))
    shown = F.struct(F.struct(F.lit(_SHOWN).alias("name"), F.array().cast("array<string>").alias("terms")).alias("head"), F.col("conclusion.goal.prove").alias("body"))
    rules = cases.select("case", F.inline(F.concat(said, F.array(shown))))
    loose = F.filter(F.array_distinct(F.col("head.terms")), lambda t: _is_variable(t) & ~F.exists("body", lambda b: F.array_contains(b["terms"], t)))
    there = F.transform(loose, lambda t: F.struct(F.lit(_THERE).alias("name"), F.array(t).alias("terms")))
    rules = _kept(rules.select("case", "head", F.concat("body", there).alias("body")))
    ground = lambda terms: F.filter(terms, lambda t: ~_is_variable(t))
    terms = rules.select("case", F.explode(ground(F.concat(F.col("head.terms"), F.flatten(F.transform("body", lambda b: b["terms"]))))).alias("t")).distinct()
    terms = terms.unionByName(cases.select("case", F.lit("!0").alias("t")).join(terms, "case", "left_anti"))
    domain = terms.select("case", F.lit(_THERE).alias("name"), F.array("t").alias("terms")).unionByName(terms.select("case", F.lit(_EQUAL).alias("name"), F.array("t", "t").alias("terms")))
    facts = rules.where(F.size("body") == 0).select("case", "head.name", "head.terms").unionByName(domain).distinct()
    rules = rules.where(F.size("body") > 0)
    equations = not rules.where(F.col("head.name") == _EQUAL).isEmpty() or not facts.where((F.col("name") == _EQUAL) & (F.get("terms", F.lit(0)) != F.get("terms", F.lit(1)))).isEmpty()
    longest = rules.agg(F.max(F.size("body"))).first()[0] or 0
    facts, new = _kept(facts), None
    while True:
        if equations and (new is None or not new.where(F.col("name") == _EQUAL).isEmpty()):
            roots = _merged(facts)
            if not roots.isEmpty():
                facts, rules = _kept(_renamed(facts, roots)), _kept(_with_least(rules, roots))
        start = rules.withColumn("bound", F.lit(None).cast("map<string,string>")).withColumn("bound", F.coalesce("bound", F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"))).withColumn("at", F.lit(0))
        done = None
        for _ in range(longest):
            start = _joined(start, facts)
            ended = start.where(F.col("at") == F.size("body")).select("case", "head", "bound")
            done = ended if done is None else done.unionByName(ended)
            start = start.where(F.col("at") < F.size("body"))
        if done is None:
            break
        filled = F.transform(F.col("head.terms"), lambda t: F.coalesce(F.try_element_at("bound", t), t))
        found = done.select("case", F.col("head.name").alias("name"), filled.alias("terms")).distinct()
        new = _kept(found.join(facts, ["case", "name", "terms"], "left_anti"))
        if new.isEmpty():
            break
        facts = _kept(facts.unionByName(new))
    answered = facts.where(F.col("name") == _SHOWN).select(F.col("case").alias("c"))
    out = cases.select("case", "key", "drop").join(answered, F.col("case") == F.col("c"), "left").select("key", "drop", F.col("c").isNotNull().alias("follows"))
    spare = F.transform(F.array_sort(F.filter(F.collect_list(F.struct("drop", "follows")), lambda x: x["drop"] >= 0)), lambda x: x["follows"])  # one for each premise
    out = out.groupBy("key").agg(F.bool_or(F.col("follows") & (F.col("drop") == -1)).alias("valid"), spare.alias("spare"))
    return out.select("key", F.struct("valid", "spare", F.lit(True).alias("consistent")).cast(VERDICT).alias("verdict"))


def _with_least(rules: DataFrame, roots: DataFrame) -> DataFrame:
    """Rules with the least of equal terms in all places."""
    table = roots.groupBy(F.col("case").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("term", "least"))).alias("to"))  # the terms of one argument
    to = lambda a: F.struct(a["name"].alias("name"), F.transform(a["terms"], lambda t: F.coalesce(F.try_element_at("to", t), t)).alias("terms"))
    out = rules.join(table, F.col("case") == F.col("c"), "left")
    return out.select("case", to(F.col("head")).alias("head"), F.transform("body", to).alias("body"))


# 3. Others


def proven(arguments: DataFrame) -> DataFrame:
    """key, verdict of any arguments, as far as `formulas.entails` knows."""

    @F.pandas_udf(VERDICT)
    def prove(premises: pd.Series, conclusions: pd.Series) -> pd.DataFrame:
        out = []
        for ps, c in zip(premises, conclusions, strict=True):
            ps, c = [formulas.read(p) for p in ps], formulas.read(c)
            refuted = formulas.entails(ps, ("not", ps[0])) if ps else False
            out.append((formulas.entails(ps, c), [formulas.entails(ps[:i] + ps[i + 1 :], c) for i in range(len(ps))], None if refuted is None else not refuted))
        return pd.DataFrame(out, columns=["valid", "spare", "consistent"]).astype(object)

    return arguments.select("key", prove(F.transform("premises", lambda p: p["plain"]), F.col("conclusion.plain")).alias("verdict"))


def judged(arguments: DataFrame) -> DataFrame:
    """key, verdict: every distinct argument (key, premises, conclusion) judged once."""
    rows = _kept(arguments.dropDuplicates(["key"]))
    programs = F.concat(F.transform("premises", lambda p: p["program"]), F.array("conclusion.program"))
    atoms = F.filter(F.array_distinct(F.flatten(programs)), lambda w: w.rlike("^[A-Za-z_]"))
    plain = F.coalesce(F.forall(programs, lambda p: p.isNotNull()) & (F.size(atoms) <= SYMBOLS), F.lit(False))
    ruled = F.forall("premises", lambda p: p["rules"].isNotNull()) & F.col("conclusion.goal").isNotNull()
    rows = rows.withColumn("way", F.when(plain, 1).when(F.coalesce(ruled, F.lit(False)), 2).otherwise(3))
    ways = {r[0] for r in rows.select("way").distinct().collect()}
    by = {1: tabulated, 2: derived, 3: proven}
    parts = [by[w](rows.where(F.col("way") == w).drop("way")) for w in sorted(ways)] or [rows.select("key", F.lit(None).cast(VERDICT).alias("verdict"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def arguments_of(spark, rows: list[tuple[list[str], str]]) -> DataFrame:
    """key, premises, conclusion of arguments given as texts."""
    given = spark.createDataFrame([(i, ps, c) for i, (ps, c) in enumerate(rows)], "i long, ps array<string>, c string")
    texts = given.select(F.explode(F.concat("ps", F.array("c"))).alias("text"))
    known = described(texts)
    spread = given.select("i", "c", F.posexplode_outer("ps").alias("k", "text")).join(known, "text", "left").groupBy("i", "c").agg(F.array_sort(F.collect_list(F.struct("k", "formula"))).alias("fs"))
    spread = spread.select("i", "c", F.transform(F.filter("fs", lambda x: x["k"].isNotNull()), lambda x: x["formula"]).alias("premises"))
    out = spread.join(known.withColumnsRenamed({"text": "t", "formula": "conclusion"}), F.col("c") == F.col("t"))
    return out.select("i", key_of(F.col("premises"), F.col("conclusion")).alias("key"), "premises", "conclusion")
