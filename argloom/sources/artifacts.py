"""Answers written from the plain tables, several things wrong with them at once.

What each artifact consists of follows from its rows by the rules below, so that SQL over the same rows can describe it as relations
(elements, nodes, edges, items) and evaluate every check on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fence(dtype: str, name: str, body: Column) -> Column:
    return F.concat(F.lit(f'```{dtype} {{filename="{name}"}}\n'), body, F.lit("\n```\n"))


def _if(wrong: Column, text, other="") -> Column:
    return F.when(wrong, text).otherwise(other)


def _every(key: str, n: int, rest: int = 0) -> Column:
    return F.col(key) % n == rest


def _one_each(lineitem: DataFrame) -> DataFrame:
    """k, n, p, s: one row for each line of an order; those of an order lie together."""
    return _together(lineitem, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))


def _together(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """These columns, dealt by the key once, before texts are made of them: groups within a key need no further exchange."""
    return rows.select(key, *more).repartition(key)


def _body(parts: Column, between: str = "\n") -> Column:
    """The second fields of collected structs, in order of the first ones."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["text"]), between)


def annotations(lineitem: DataFrame) -> DataFrame:
    """request_id, inputs, source: each order an annotation, each line an element."""
    name = _if(_every("p", 17), "claim", "proposition")
    own_id = F.when(_every("p", 11), "").otherwise(F.format_string(' id="%d"', _if(_every("p", 13), F.lit(1), F.col("n"))))
    supports = F.when(_every("s", 3), F.format_string(' supports="%d"', F.col("n") + 1)).when(_every("s", 3, 1), ' supports="1 2"').otherwise("")
    attacks = _if(_every("p", 7), F.format_string(' attacks="%d"', F.col("n") + 2))
    label = _if(_every("s", 2), F.format_string(' argument_label="L%d"', F.col("p") % 4))
    reference = _if(_every("s", 5), F.format_string(' ref_reco_label="R%d"', F.col("p") % 3))
    inner = _if(_every("p", 23), F.format_string('<b><proposition id="%d">inner</proposition></b>', F.col("n") * 100))
    said = F.format_string("Line %d of part %d.", "n", "p")
    element = F.concat(F.lit("<"), name, own_id, supports, attacks, label, reference, _if(_every("p", 19), ' mood="sad"'), F.lit(">"), said, inner, F.lit("</"), name, F.lit(">"))
    plain = F.concat(said, _if(_every("p", 23), "inner"))
    rows = _one_each(lineitem).groupBy("k").agg(_body(F.struct("n", element.alias("text")), " ").alias("body"), _body(F.struct("n", plain.alias("text")), " ").alias("source"))
    whole = F.concat(F.lit('Here:\n```xml {filename="annotation.txt"}\n'), F.col("body"), _if(_every("k", 29), "", "\n```\n"))
    return rows.select(F.col("k").alias("request_id"), whole.alias("inputs"), _if(_every("k", 5), F.concat(F.lit("Something else was said here. "), F.col("source")), F.col("source")).alias("source"))


def maps(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """request_id, inputs, source: each customer a claim, orders arguments for (F) or against (O) it, priorities claims that support these."""
    sign = F.when(F.col("o_orderstatus") == "F", "<+").otherwise("<-")
    line = F.concat(F.lit("\n    "), sign, F.format_string(" <Order %d>: It was ordered.\n        + [%s of %d]: The priority.", F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey")))
    again = _if(_every("o_orderkey", 7), F.format_string("\n\n<Order %d>: Ordered another time.", "o_orderkey"))
    below = orders.where("o_orderstatus in ('F', 'O')").groupBy("o_custkey").agg(_body(F.struct("o_orderkey", line.alias("text")), "").alias("below"), _body(F.struct("o_orderkey", again.alias("text")), "").alias("again"))
    k = F.col("c_custkey")
    head = F.concat(F.lit("===\ntitle: A map\n===\n# Customers\n\n"), F.format_string("[Customer %d]: In\n  %s. // here", "c_custkey", "c_mktsegment"))
    more = F.concat(
        _if(k % 3 == 0, "\n\nA claim without any label, which goes on for some time."), _if(k % 5 == 0, F.format_string("\n\n[Customer %d]: Another text.", "c_custkey")),
        _if(k % 4 == 1, F.format_string('\n\n<Reco %d>: Gist.\n\n(1) [Premise %d]: So.\n--\nby\n{from: ["1"]}\n--\n(2) [End %d]: Hence.', "c_custkey", "c_custkey", "c_custkey")), _if(k % 31 == 0, "\n\n[A]\n    + [B]\n  + [C]"),
    )
    body = F.concat(head, F.coalesce("below", F.lit("")), F.coalesce("again", F.lit("")), more)
    return customer.join(below, F.col("c_custkey") == F.col("o_custkey"), "left").select(k.alias("request_id"), _fence("argdown", "map.ad", body).alias("inputs"), F.concat(F.lit("On "), F.col("c_mktsegment")).alias("source"))


def reconstructions_of(lineitem: DataFrame) -> DataFrame:
    """request_id, inputs, source: each order an argument, its line numbers premises of a conclusion C."""
    rows = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("ns"))
    k = F.col("k")
    argument = _if(k % 17 == 0, "", F.concat(F.format_string("<Order %d>", "k"), _if(k % 6 == 1, "", ": The gist."), _if(k % 9 == 4, " {rank: 1}"), F.lit("\n\n")))
    items = F.array_join(F.transform("ns", lambda n: F.format_string("(%d) Line %d\n  holds.", n, n)), "\n")
    used = F.when(k % 5 == 0, F.slice("ns", 2, F.size("ns"))).otherwise(F.col("ns"))
    refs = F.array_join(F.concat(F.transform(used, lambda n: F.when(k % 10 == 7, n.cast("string")).otherwise(F.format_string('"%d"', n))), F.when(k % 3 == 0, F.array(F.lit("99"))).otherwise(F.array().cast("array<string>"))), ", ")
    inference = F.when(k % 7 == 0, "-----").when(k % 14 == 1, "-- {uses: []} --").when(k % 14 == 3, '-- {from: "1"} --').otherwise(F.concat(F.lit("-- with rule {from: ["), refs, F.lit("]} --")))
    end = F.concat(F.lit("("), _if(k % 11 == 0, F.get("ns", F.lit(0)).cast("string"), F.lit("C")), F.lit(") It follows."), _if(k % 23 == 0, ' {key: "value"}'))
    whole = F.when(k % 13 == 0, F.concat(inference, F.lit("\n"), end, F.lit("\n"), items)).otherwise(F.concat(items, F.lit("\n"), inference, F.lit("\n"), end))
    more = F.concat(
        _if(k % 4 == 1, "\n\n<Other>: A second gist."), _if((k % 4 == 1) & (k % 12 == 5), "\n\n<Other>: A third gist."), _if(k % 19 == 0, "\n\n[Extra]: Not used."),
        _if(k % 8 == 3, "\n\n[One]: One.\n    <+ [Two]: Two."), _if(k % 37 == 0, "\n\n[A\n"),
    )
    body = F.when(k % 41 == 0, "// nothing").otherwise(F.concat(argument, whole, more))
    return rows.select(k.alias("request_id"), _fence("argdown", "reconstructions.ad", body).alias("inputs"), F.format_string("Lines of order %d hold.", "k").alias("source"))


#: Formulas of premises and of the conclusion, by what the key leaves over; each is also SQL over truth values of p, q and r.
PREMISES = [("P", 2, 0, "p"), ("P -> Q", 3, 0, "NOT p OR q"), ("-P", 7, 0, "NOT p"), ("R", 5, 0, "r"), ("Q | R", 4, 1, "q OR r")]
CONCLUSIONS = [("Q", "q"), ("R", "r"), ("P & Q", "p AND q")]
#: The same formulas on one thing, a, or on all things: what they say of a is what the others say.
PREDICATES = {"P": "F(a)", "P -> Q": "all x.(F(x) -> G(x))", "-P": "-F(a)", "R": "H(a)", "Q | R": "G(a) | H(a)", "Q": "G(a)", "P & Q": "F(a) & G(a)", "-R | Q": "all x.(H(x) -> G(x))"}
#: Keys whose arguments are written with predicates.
PREDICATE_KEYS = "k % 9 IN (2, 5)"


def logical(lineitem: DataFrame) -> DataFrame:
    """request_id, inputs: each order an argument with formulas; (1) is always -R | Q, then those of PREMISES that its key has. P (or F) is declared wherever it is used."""
    k = F.col("k")
    rows = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    of = lambda f: F.when(F.expr(PREDICATE_KEYS), PREDICATES[f]).otherwise(f)
    declared = F.when(F.expr(PREDICATE_KEYS), 'declarations: {G: "wet", H: "snowy"}').otherwise('declarations: {Q: "streets are wet", R: "it snows"}')
    rain = F.when(F.expr(PREDICATE_KEYS), 'F: "rainy"').otherwise('P: "it rains"')
    lines = [F.concat(F.lit('(1) [First]: Snow makes streets wet. {formalization: "'), of("-R | Q"), F.lit('"'), _if(k % 11 == 0, "", F.concat(F.lit(", "), declared)), F.lit("}"))]
    lines += [F.when(k % m == rest, F.concat(F.lit(f'({i}) [Premise {i}]: Premise {i} holds. {{formalization: "'), of(f), F.lit('"'), F.concat(F.lit(", declarations: {"), rain, F.lit("}")) if "P" in f else F.lit(""), F.lit("}"))) for i, (f, m, rest, _) in enumerate(PREMISES, 2)]
    refs = F.array_join(F.concat(F.array(F.lit('"1"')), *[F.when(k % m == rest, F.array(F.lit(f'"{i}"'))).otherwise(F.array().cast("array<string>")) for i, (_, m, rest, _) in enumerate(PREMISES, 2)]), ", ")
    refs = F.when(k % 13 == 0, '"1"').otherwise(refs)
    end = F.element_at(F.array(*[of(f) for f, _ in CONCLUSIONS]), (k % len(CONCLUSIONS) + 1).cast("int"))
    end = F.when(k % 17 == 0, F.concat(end, F.lit(" &"))).otherwise(end)
    relation = F.when(k % 6 == 2, "\n    <+ [First]").when(k % 6 == 4, "\n    <- [First]").otherwise("")
    own = F.concat_ws(", ", F.when(k % 3 == 2, rain), F.when(F.expr(PREDICATE_KEYS) & (k % 11 != 0), 'a: "the street"'), F.when(k % 19 == 0, 'Z: "unused"'))
    more = _if(own != "", F.concat(F.lit(", declarations: {"), own, F.lit("}")))
    body = F.concat(F.lit("<Weather>: On streets.\n\n"), F.concat_ws("\n", *lines), F.lit("\n-- {from: ["), refs, F.lit(']} --\n(C) [End]: It follows. {formalization: "'), end, F.lit('"'), more, F.lit("}"), relation)
    return rows.select(k.alias("request_id"), _fence("argdown", "reconstructions.ad", body).alias("inputs"))


def chains(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """request_id, inputs: each customer's orders, numbered, as items of one argument; an order is inferred from the one before it (every third: from the one before that, every
    fifth: from the next one too), the first is a premise."""
    rows = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("os"))
    rows = rows.join(customer.select("c_custkey"), F.col("k") == F.col("c_custkey"))

    def item(o, i):
        n = i + 1
        refs = F.concat_ws(", ", F.when((o % 3 == 0) & (n > 2), F.format_string('"%d"', n - 2)).otherwise(F.format_string('"%d"', n - 1)), F.when((o % 5 == 0) & (n < F.size("os")), F.format_string('"%d"', n + 1)))
        return F.concat(F.when(i == 0, "").otherwise(F.concat(F.lit("-- {from: ["), refs, F.lit("]} --\n"))), F.format_string("(%d) [Order %d]: So it was.", n, o))

    body = F.concat(F.lit("<Chain>: One after the other.\n\n"), F.array_join(F.transform("os", item), "\n"))
    return rows.select(F.col("k").alias("request_id"), _fence("argdown", "reconstructions.ad", body).alias("inputs"))


def _nodes_of(orders: DataFrame) -> Column:
    """What is said on an order in an annotation, a map and a reconstruction."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    valence = F.when(F.col("o_orderstatus") == "F", "supports").otherwise("attacks")
    label = F.when(o % 5 == 0, F.format_string("Nobody %d", o)).otherwise(F.format_string("Order %d", o))
    annotated = F.concat(F.format_string('<proposition id="o%d" argument_label="%s" ref_reco_label="%s"', o, label, F.when(o % 6 == 0, "9").otherwise("1")), _if(o % 7 == 0, "", F.concat(F.lit(" "), valence, F.lit('="c"'))), F.format_string(">Order %d was made.</proposition>", o))
    given = F.when(o % 8 == 0, "").when(o % 9 == 0, ' {annotation_ids: ["x"]}').otherwise(F.format_string(' {annotation_ids: ["o%d"]}', o))
    sign = F.when(F.col("o_orderstatus") == "F", "<+").otherwise("<-")
    drawn = F.concat(F.lit("\n    "), sign, F.format_string(" <Order %d>: Order %d was made.", o, o), given)
    end = F.when(o % 10 == 0, F.format_string("[Else %d]: Something else.", o)).when(F.col("o_orderstatus") == "F", F.format_string("[Customer %d]", c)).otherwise(F.format_string("[Not %d]: It isn't so.\n    >< [Customer %d]", o, c))
    made = F.concat(F.format_string("\n\n<Order %d>: Made.\n\n(1) [Made %d]: Order %d was made.", o, o, o), given, F.lit('\n-- {from: ["1"]} --\n(2) '), end)
    made = F.when(o % 11 == 0, "").otherwise(made)
    return F.struct(o.alias("o"), annotated.alias("annotated"), drawn.alias("drawn"), made.alias("made"))


def _joined(field: str, between: str = "") -> Column:
    return F.array_join(F.transform("rows", lambda r: r[field]), between)


def compounds(customer: DataFrame, orders: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """request_id, inputs: each customer with orders an annotation, a map and reconstructions of their orders, as far as asked for."""
    rows = orders.where("o_orderstatus in ('F', 'O')").groupBy("o_custkey").agg(F.array_sort(F.collect_list(_nodes_of(orders))).alias("rows"))
    rows = rows.join(customer.select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("c_custkey")
    parts = {
        "arganno": _fence("xml", "annotation.txt", F.concat(F.format_string('<proposition id="c" argument_label="Customer %d">The customer.</proposition> ', k), _joined("annotated", " "))),
        "argmap": _fence("argdown", "map.ad", F.concat(F.format_string('[Customer %d]: The customer. {annotation_ids: ["c"]}', k), _joined("drawn"))),
        "infreco": _fence("argdown", "reconstructions.ad", F.concat(F.format_string('[Customer %d]: The customer. {annotation_ids: ["c"]}', k), _joined("made"))),
    }
    return rows.select(k.alias("request_id"), F.concat(*[parts[x] for x in kinds]).alias("inputs"))
