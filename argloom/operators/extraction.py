"""Fenced code blocks of answers, with what they hold: elements of xml blocks, graphs of argdown blocks.

Blocks are found by a pattern; a small reader goes through each body once, for all of a row's blocks, which stay an array in the row:
nothing is moved between tasks, unless answers that repeat, or their formulas, are to be read once (`read`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from argloom.functions import reading
from argloom.functions.texts import SHORTENING_FROM, TOLERANCE, altered

from . import inference
from .inference import _kept
from .logic import LOGIC, cases_of, declared_in, denied_in, found_in, texts_of, with_items, worded_in

LANGUAGES = ("argdown", "xml")
ELEMENTS = "array<struct<pos:int,parent:int,depth:int,name:string,id:string,supports:array<string>,attacks:array<string>,argument_label:string,ref_reco_label:string,attributes:array<string>,nested:boolean,text:string,shown:string,brief:string>>"
GRAPH = (
    "struct<propositions:array<struct<label:string,unlabeled:boolean,texts:array<string>,data:string,annotation_ids:array<string>,formalization:string,declarations:array<struct<symbol:string,meaning:string>>,declarations_kind:string>>,"
    "arguments:array<struct<label:string,unlabeled:boolean,texts:array<string>,data:string,annotation_ids:array<string>,pcs:array<struct<label:string,proposition:string,is_conclusion:boolean,inference:string,refs:array<struct<label:string,is_text:boolean>>>>>>,"
    "relations:array<struct<source:string,source_argument:boolean,target:string,target_argument:boolean,valence:string,dialectics:array<string>>>>"
)
#: Answers whose blocks are in a reader's memory at once, and characters of these blocks (a longer answer is there alone): what is read of them takes
#: some 25 times their texts.
READ_ROWS, READ_CHARS = 64, 1 << 19
BLOCK = f"struct<pos:int,id:string,dtype:string,snippet:string,metadata_kind:string,metadata:map<string,string>,elements:{ELEMENTS},content:string,graph:{GRAPH},error:string,altered:array<string>,logic:{LOGIC}>"


def _fenced(text: str, language: str) -> Column:
    """The blocks of one language, each what stands between its tag and the next closing fence."""
    raw = F.regexp_extract_all(text, F.lit(f"(?s)```{language}(.*?)\\n```"), F.lit(1))
    return F.transform(raw, lambda b: F.struct(F.lit(language).alias("dtype"), b.alias("raw")))


def blocks(answers: DataFrame, key: str = "request_id", text: str = "answer") -> DataFrame:
    """key, block_pos, dtype, header, body: the blocks of each language in turn; an unclosed fence gives none."""
    found = F.concat(*[_fenced(text, x) for x in LANGUAGES])
    out = answers.select(key, F.posexplode(found).alias("block_pos", "b"))
    header = F.trim(F.substring_index("b.raw", "\n", 1))
    body = F.when(F.contains("b.raw", F.lit("\n")), F.expr("substring(b.raw, locate('\n', b.raw) + 1)")).otherwise("")
    return out.select(key, "block_pos", "b.dtype", header.alias("header"), body.alias("body"))


def _read_one(pos: int, dtype: str, raw: str, source: str | None, keys: reading.Keys, integrity: tuple[float, int]) -> dict:
    head, _, body = raw.partition("\n")
    out = {"pos": pos, "dtype": dtype, "snippet": f"```{dtype}{raw}\n```", "metadata_kind": "null", "metadata": []}
    try:
        out["metadata_kind"], metadata = reading.header(head.strip())
        out["metadata"] = list(metadata.items())
        if dtype == "xml":
            out["elements"], out["content"] = reading.annotation(body)
            out["altered"] = altered(source, body, [e["text"] for e in out["elements"] if e["name"] == "proposition"], *integrity, own=out["content"])
        else:
            out["graph"] = reading.argdown(body, keys)
    except (ValueError, RecursionError) as error:
        out["error"] = str(error) or type(error).__name__
    return out


def _with_blocks(answers: DataFrame, text: str, source: str | None, keys: reading.Keys, counter: Accumulator | None, integrity: tuple[float, int], carried: list[str] | None = None, bare: bool = False) -> DataFrame:
    """answers (those of their columns that are carried) with `blocks`, read in one stage that no filter is pushed below, READ_ROWS answers and READ_CHARS characters at a time."""
    kind = to_arrow_type(_parse_datatype_string(f"array<{BLOCK}>"))
    carried = answers.columns if carried is None else carried

    def one(i: int, dtype: str, raw: str, source: str | None) -> dict:
        out = _read_one(i, dtype, raw, source, keys, integrity)
        return {k: v for k, v in out.items() if k not in ("elements", "content", "altered", "graph")} if bare else out

    def some(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        *given, dtypes, raws, sources = whole.columns
        found, size = [], 0
        for row in range(whole.num_rows):
            ds, rs, s = dtypes[row].as_py(), raws[row].as_py(), sources[row].as_py()
            found.append([one(i, d, r, s) for i, (d, r) in enumerate(zip(ds, rs, strict=True))] if rs is not None else [])
            size += sum(map(len, rs or ()))
            if len(found) == READ_ROWS or size >= READ_CHARS or row == whole.num_rows - 1:
                if counter is not None:
                    counter.add(len(found))
                blocks = pa.array(found, kind)
                n, found, size = len(found), [], 0
                yield pa.RecordBatch.from_arrays([*[c.slice(row + 1 - n, n) for c in given], blocks], names=[*whole.schema.names[:-3], "blocks"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield from some(whole)
            del whole  # before the next one is there

    found = F.concat(*[_fenced(text, x) for x in LANGUAGES])
    rows = answers.select(*carried, F.transform(found, lambda b: b["dtype"]).alias("_dtypes"), F.transform(found, lambda b: b["raw"]).alias("_raws"), (F.col(source) if source else F.lit(None).cast("string")).alias("_source"))
    return rows.mapInArrow(parse, StructType([*answers.select(*carried).schema.fields, StructField("blocks", _parse_datatype_string(f"array<{BLOCK}>"))]))


def read(requests: DataFrame, key: str = "request_id", text: str = "inputs", source: str | None = None, keys: reading.Keys = reading.KEYS, logic: bool = False, once: bool = False, counter: Accumulator | None = None, verdicts: bool = True, integrity: tuple[float, int] = (TOLERANCE, SHORTENING_FROM), carried: list[str] | None = None, ids: bool = True, bare: bool = False, then: Callable[[DataFrame], list[Column]] | None = None) -> DataFrame:
    """requests with `blocks`: pos, id, dtype, snippet, metadata_kind, metadata, elements, graph, error, altered, logic of each block.

    A block that can't be read has an error and neither elements nor graph; it doesn't stop the others. `content` is the text of an annotation without its tags, `altered` is what an annotation changed
    in its source (null without one; `integrity`: by what share a text may differ, and the words from which on it may be shortened), `logic` what the formulas of a reconstruction say (only if asked for). With `once` (always for logic) rows with the same
    text and source share one reading, found by a hash of both: answers move, but each is read a single time. `counter` adds up the texts read; without
    `verdicts` formulas are read, but arguments not judged. `carried` names the columns of requests that are wanted (all, unless given); without `ids` blocks have none;
    `bare` blocks have neither elements nor graph, only an error where these can't be read.
    `then` gives columns (with names of their own) that follow from text and blocks alone: where reading is shared, they are evaluated once for each answer, and instead of blocks only they go to the rows."""
    shared = [text, *([source] if source else [])]
    if not (once or logic):
        out = _with_blocks(requests, text, source, keys, counter, integrity, carried, bare)
    else:
        digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.sha2(F.col(c), 256), F.lit("-")) for c in shared]), 256)
        named = requests.withColumn("_digest", digest)
        distinct = named.select("_digest", *shared).dropDuplicates(["_digest"])
        if then:  # what follows is much work on few bytes: more tasks than these would get
            distinct = distinct.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_digest")
        texts = [text] if then else []
        answers = _with_blocks(distinct, text, source, keys, counter, integrity, ["_digest", *texts], bare and not logic).select(F.col("_digest").alias("_d"), *texts, "blocks")
        if logic:
            answers = with_logic(_kept(answers), verdicts=verdicts)
        own = ["blocks"]
        if then:
            columns = then(answers)
            answers = answers.select("_d", *columns)
            own = [c for c in answers.columns if c != "_d"]
        out = named.join(answers, F.col("_digest") == F.col("_d")).select(*(requests.columns if carried is None else carried), *own)
    if then:
        return out if once or logic else out.select(*(requests.columns if carried is None else carried), *then(out))
    if not ids:
        return out
    name = lambda b: F.concat(b["dtype"], F.lit("_"), F.substring(F.sha2(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("None")), b["pos"]), 256), 1, 16))
    return out.withColumn("blocks", F.transform("blocks", lambda b: b.withField("id", name(b))))


def with_logic(answers: DataFrame, key: str = "_d", verdicts: bool = True) -> DataFrame:
    """answers (by key) with the logic of their blocks: each distinct formula read once, each distinct argument judged once, and both joined back."""
    more = [c for c in answers.columns if c not in (key, "blocks")]
    texts = answers.select(F.col(key).alias("_t"), F.explode(F.array_distinct(F.flatten(F.transform("blocks", texts_of)))).alias("t"))
    formulas = inference.described(texts, "t")
    own = texts.join(formulas, F.col("t") == F.col("text")).groupBy("_t").agg(F.map_from_entries(F.collect_list(F.struct("text", "formula"))).alias("known"))  # the formulas of one answer
    out = answers.join(own, F.col(key) == F.col("_t"), "left").withColumn("known", F.coalesce("known", F.map_from_entries(F.array().cast(f"array<struct<text:string,formula:{inference.FORMULA}>>"))))
    out = out.withColumn("_i", F.transform("blocks", lambda b: with_items(b, F.col("known")))).withColumn("_m", F.transform("_i", declared_in)).withColumn("_g", F.transform("_i", found_in))
    at = lambda c, i: F.get(F.col(c), i)
    logic = lambda b, i: F.struct(at("_i", i).alias("items"), at("_m", i).alias("declared"), at("_g", i).alias("found"), denied_in(b, at("_g", i), F.col("known")).alias("denied"), F.lit(None).cast(f"map<string,{inference.VERDICT}>").alias("verdicts"), worded_in(at("_g", i), at("_m", i)).alias("formulas"))
    out = (_kept if verdicts else lambda df: df)(out.select(key, *more, F.transform("blocks", lambda b, i: b.withField("logic", F.when(b["graph"].isNotNull(), logic(b, i)).cast(LOGIC))).alias("blocks")))
    if not verdicts:
        return out
    cases = out.select(F.col(key).alias("_c"), F.explode(F.flatten(F.transform(F.filter("blocks", lambda b: b["graph"].isNotNull()), cases_of))).alias("c"))
    cases = _kept(cases.select("_c", inference.key_of(F.col("c.premises"), F.col("c.conclusion")).alias("key"), "c.premises", "c.conclusion"))
    answered = inference.judged(cases.select("key", "premises", "conclusion")).withColumnRenamed("key", "v_key")
    own = cases.select("_c", "key").distinct().join(answered, F.col("key") == F.col("v_key")).groupBy("_c").agg(F.map_from_entries(F.collect_list(F.struct("key", "verdict"))).alias("verdicts"))  # those of one answer
    out = out.join(own, F.col(key) == F.col("_c"), "left")
    filled = lambda b: b.withField("logic", F.when(b["logic"].isNotNull(), b["logic"].withField("verdicts", F.coalesce(F.col("verdicts"), b["logic"]["verdicts"]))))
    return out.select(key, *more, F.transform("blocks", filled).alias("blocks"))


def in_role(block: Column, dtype: str, rules: list[tuple[str, str, bool]] = ()) -> Column:
    """Whether a block is of the type and its metadata meet all rules: (key, value, whether the value is a pattern for its beginning)."""
    out = block["dtype"] == dtype
    for name, value, is_pattern in rules:
        own = F.try_element_at(block["metadata"], F.lit(name))
        out &= F.coalesce(own.rlike(f"^(?:{value})") if is_pattern else own == value, F.lit(False))
    return out


def metadata_in(block: Column, key: str, values: list[str]) -> Column:
    """Whether the block's metadata have one of the values; False without metadata."""
    return F.coalesce(F.try_element_at(block["metadata"], F.lit(key)).isin(*values), F.lit(False))


def last(dtype: str, rules: list[tuple[str, str, bool]] = (), parsed: bool = True) -> Column:
    """The last of a row's blocks in a role (of those that could be read)."""
    good = lambda b: in_role(b, dtype, rules) & (b["error"].isNull() if parsed else F.lit(True))
    return F.try_element_at(F.filter("blocks", good), F.lit(-1))
