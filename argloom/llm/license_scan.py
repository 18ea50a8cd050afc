"""License scans by diagonal voting.

Every run of K_PHRASE and of K words of every text is hashed and joined in Spark to the places of the same hash in the templates
(a small fixed table, so the join is a broadcast one by construction). A match votes for the diagonal
(text position - template position) of its template. A base phrase stands where its diagonal has all
votes. For longer templates, diagonals no more than DRIFT apart whose matches lie near each other are merged, which
bridges inserted and missing words; a merged span with enough votes is verified word by word on the text: the longest
common subsequence of span and template must cover MIN_COVER of the template and of the span. Of overlapping spans with
different labels the one that has most words in common with its template counts, which tells variants of a license apart.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null texts have no words. Other columns are ignored, whatever their names. Repeated rows are
counted and given back as often; rows of one doc_id with different texts, and null doc_ids, are kept apart by a hash
of the text. Equal words are told by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textblocks import NOT_ALNUM, Block, blocks

#: Words of a run, for the base phrases (which may have two words) and for templates.
K_PHRASE, K = 2, 4
DRIFT, NEAR, MIN_VOTES, MIN_COVER = 3, 30, 0.4, 0.7
#: Up to so many texts and spans to verify (some 30 bytes each) are sent to every task; more are joined by a shuffle.
BROADCAST_SPANS = 200_000

#: Base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Whole short licenses, notices and clauses of longer ones; run() takes others.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("released under the mit license", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd"),
    ("in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl"),
    ("to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "cc0"),
]
#: Creative Commons variants, as written out and in short; and identifiers of licenses.
CREATIVE_COMMONS = [("attribution", "by", "cc-by"), ("attribution sharealike", "by sa", "cc-by-sa"), ("attribution noncommercial", "by nc", "cc-by-nc"), ("attribution noderivatives", "by nd", "cc-by-nd"), ("attribution noncommercial sharealike", "by nc sa", "cc-by-nc-sa"), ("attribution noncommercial noderivatives", "by nc nd", "cc-by-nc-nd")]
IDENTIFIERS = [("mit", "mit"), ("apache 2 0", "apache"), ("gpl 2 0 only", "gpl"), ("gpl 2 0 or later", "gpl"), ("gpl 3 0 only", "gpl"), ("gpl 3 0 or later", "gpl"), ("lgpl 2 1 only", "lgpl"), ("lgpl 2 1 or later", "lgpl"), ("lgpl 3 0 or later", "lgpl"), ("agpl 3 0 only", "agpl"), ("agpl 3 0 or later", "agpl"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("isc", "isc"), ("mpl 2 0", "mpl"), ("epl 2 0", "epl"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("bsl 1 0", "bsl"), ("cc0 1 0", "cc0")]
for written_out, short, own_label in CREATIVE_COMMONS:
    for version in ("4 0", "3 0"):
        TEMPLATES += [(f"this work is licensed under a creative commons {written_out} {version} international license", own_label), (f"licensed under cc {short} {version}", own_label), (f"creative commons {written_out} {version}", own_label)]
TEMPLATES += [(f"spdx license identifier {name}", own_label) for name, own_label in IDENTIFIERS]
#: Stands in front of each text's hashes, so that texts without matches are in the result too.
_ROW = 0


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, Block, list[tuple[np.ndarray, np.ndarray]]]]:
    """(lo, hi, block, hashes of all runs of K_PHRASE words and the text of each, the same of K words)."""
    for lo, hi, b in blocks(texts, NOT_ALNUM, lower=True):
        words, out = b.word_hash(), []
        for k in (K_PHRASE, K):
            hashes, at = b.grams(words, k)
            out.append(((hashes | np.uint64(1)).view(np.int64), b.doc[at]))  # never _ROW
        yield lo, hi, b, out


def template_words(text: str) -> str:
    """The words of a template as the scan sees them, one space between."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))
    if len(words) < K:
        raise ValueError(f"a template needs {K} words at least: {text!r}")
    return " ".join(words)


def _texts_labels(templates: Sequence[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Of base phrases and templates."""
    return [p for p, _ in PHRASES] + [template_words(t) for t, _ in templates], [x for _, x in PHRASES] + [x for _, x in templates]


def template_table(spark, texts: list[str]) -> DataFrame:
    rows = [(_ROW, -1, 0)]
    for i, text in enumerate(texts):
        for *_, grams in _grams(pa.array([text])):
            rows += [(int(h), i, p) for p, h in enumerate(grams[i >= len(PHRASES)][0])]
    return spark.createDataFrame(rows, "hash long, template int, at int")


def _key(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("key")


def rolling(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (hash of the text), n_words, and _ROW followed by the hashes of all runs of K_PHRASE words, then of K words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b, grams in _grams(batch.column(1)):
                parts = [(np.full(b.n, _ROW, np.int64), np.arange(b.n)), *grams]
                doc = np.concatenate([d for _, d in parts])
                order = np.argsort(doc, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.n))])
                values = np.concatenate([h for h, _ in parts])[order]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(b.n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["doc_id", "key", "n_words", "hashes"])

    return docs.select("doc_id", text, _key(text)).mapInArrow(run, "doc_id long, key long, n_words long, hashes array<long>")


def _spans(docs: DataFrame, text: str, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per distinct (doc_id, text): n_words, how many rows, base places and merged spans of templates."""
    texts, labels = _texts_labels(templates)
    grams = rolling(docs, text).select("doc_id", "key", "n_words", F.posexplode("hashes").alias("pos", "hash"))
    votes = grams.join(F.broadcast(template_table(docs.sparkSession, texts)), "hash")
    long_ones = F.when(F.col("template") >= len(PHRASES), F.greatest(F.col("n_words") - (K_PHRASE - 1), F.lit(0))).otherwise(0)
    votes = votes.withColumn("pos", (F.col("pos") - 1 - long_ones).cast("int"))
    diagonal = votes.groupBy("doc_id", "key", "template", F.when(F.col("template") >= 0, F.col("pos") - F.col("at")).otherwise(0).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # A phrase's places and the row itself are diagonals of their own; only templates' diagonals are merged.
    own = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal", "lo")
    apart = (F.col("template") < len(PHRASES)) | F.lag("diagonal").over(own).isNull() | (F.col("diagonal") - F.lag("diagonal").over(own) > DRIFT) | (F.col("lo") - F.lag("hi").over(own) > NEAR) | (F.lag("lo").over(own) - F.col("hi") > NEAR)
    merged = diagonal.withColumn("first", apart.cast("int")).withColumn("group", F.sum("first").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("doc_id", "key", "template", "group").agg(F.max("n_words").alias("n_words"), F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    need = F.element_at(F.array(*[F.lit(len(t.split()) - (K if i >= len(PHRASES) else K_PHRASE) + 1) for i, t in enumerate(texts)]), F.greatest(F.col("template"), F.lit(0)) + 1)

    copies = F.max(F.when(F.col("template") == -1, F.col("votes"))).over(Window.partitionBy("doc_id", "key"))
    merged = merged.withColumn("rows", copies).where((F.col("template") == -1) | (F.col("template") < len(PHRASES)) & (F.col("votes") == need * F.col("rows")) | (F.col("template") >= len(PHRASES)) & (F.col("votes") >= F.ceil(need * MIN_VOTES) * F.col("rows")))
    base = (F.col("template") >= 0) & (F.col("template") < len(PHRASES))
    label = F.element_at(F.array(*map(F.lit, labels)), F.greatest(F.col("template"), F.lit(0)) + 1)

    return merged.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, label))).alias("base_labels"),
        F.collect_list(F.when(F.col("template") >= len(PHRASES), F.struct("template", "lo", "hi"))).alias("spans"))


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a bit for each place of a, so that whole licenses are quick."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for y in b:
        match = row & places.get(y, 0)
        row = (row + match | row - match) & whole
    return len(a) - row.bit_count()


def verified(docs: DataFrame, found: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, key, labels and score of the spans that hold on the text itself."""
    texts, names = _texts_labels(templates)
    wanted = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "spans")
    n, spans = wanted.agg(F.count("*"), F.sum(F.size("spans"))).first()
    if n + (spans or 0) <= BROADCAST_SPANS:
        wanted = F.broadcast(wanted)

    def judged(words: list[str], spans: list[dict]) -> tuple[list[str], float]:
        """Labels of the spans that hold. Where spans overlap, the one with the most words in common decides (then that of the best cover)."""
        held = []
        for s in spans:
            template, end = texts[s["template"]].split(), s["hi"] + K
            # A changed word near an end of the template takes the runs around it: so the span is also tried with its surroundings.
            for lo, hi in ((s["lo"], end), (max(s["lo"] - K + 1, 0), end + K - 1)):
                own = words[lo:hi]
                common = _common(template, own)
                if common / max(len(template), len(own)) >= MIN_COVER:
                    held.append((-common, -common / max(len(template), len(own)), s["lo"], end, names[s["template"]]))
        good: list[tuple] = []
        for x in sorted(held):
            if all(x[4] == y[4] or x[3] <= y[2] or y[3] <= x[2] for y in good):
                good.append(x)
        return sorted({x[4] for x in good}), max((-x[1] for x in good), default=0.0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi, b in blocks(batch.column(1), NOT_ALNUM, lower=True):
                for i in range(hi - lo):
                    found.append(judged([b.word(w) for w in range(b.word_at[i], b.word_at[i + 1])], batch.column(3)[lo + i].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([y for _, y in found], pa.float64())], names=["doc_id", "key", "added", "cover"])

    pairs = docs.select("doc_id", text, _key(text)).join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", text, "k", "spans")
    return pairs.mapInArrow(keyed, "doc_id long, key long, added array<string>, cover double").dropDuplicates(["doc_id", "key"])


def run(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Counts and labels of every row; templates are (text, label)."""
    found = written(_spans(docs, text, templates), "license-spans")
    more = verified(docs, found, text, templates).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "added", "cover")
    out = found.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    out = out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base_labels", F.coalesce("added", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"), F.sequence(F.lit(1), F.col("rows").cast("int")).alias("r"))
    return out.withColumn("r", F.explode("r")).drop("r")
