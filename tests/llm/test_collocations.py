"""Collocations against counting everything."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from argloom.llm import collocations

SCHEMA = "key long, text string, lang string, f int, score string"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, least, top):
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, *words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    frequent = {p: c for p, c in counts.items() if c >= least}
    inside = {(p[0], *p[i:j]) for p, c in frequent.items() for i in (1, 2) for j in (len(p), len(p) - 1) if (i, j) != (1, len(p)) and counts[p[0], *p[i:j]] == c}
    found = collections.defaultdict(list)
    for p, a in frequent.items():
        if len(p) > 2 and p not in inside:
            n = total[p[0]]
            score, k = min((1000 * a * n // (counts[p[: k + 1]] * counts[p[0], *p[k + 1 :]]), k) for k in range(1, len(p) - 1))
            found[p[0]].append((-score, -a, " ".join(p[1:]).encode(), a, counts[p[: k + 1]], counts[p[0], *p[k + 1 :]], n, score))
    return sorted((lang, i, p.decode(), *rest) for lang, own in found.items() for i, (_, _, p, *rest) in enumerate(sorted(own)[:top], 1))


def texts(seed, n=300):
    """Zipf words of two languages and none, with passages that return, whole or in part; few words, so that counts are high."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(rng.randrange(2, 9))] for k in range(8)]
    rows = []
    for i in range(n):
        words = []
        while len(words) < rng.randrange(5, 80):
            own = rng.choice(passages)
            words += own[: rng.randrange(1, 9)] if rng.random() < 0.3 else [f"W{int(rng.paretovariate(0.7)) % 40}{rng.choice(['', '', '', '.', ',', '!'])}"]
        rows.append((i, rng.choice([" ", " ", "\t ", "\n"]).join(words), rng.choice(["en", "en", "de", None]), 1, "clash"))
    return rows + [(None, None, "en", 1, ""), (1, "", None, 1, ""), (2, " .,! ", "fr", 1, ""), (3, "the the " * 3000, "en", 1, ""), (4, "é" * 200_000 + " x y", "es", 1, "")] + rows[:1] * 30


@pytest.mark.parametrize("seed, least, top", [(1, 5, 10), (2, 3, 2000), (3, 20, 3)])
def test_phrases(spark, monkeypatch, seed, least, top):
    rows = texts(seed)
    out = collocations.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least, top=top)
    assert sorted(map(tuple, out.collect())) == brute(rows, least, top)


def test_full_tables_still_count_right(spark, monkeypatch):
    """Bit tables too small for their keys let others through, which changes no result."""
    monkeypatch.setattr(collocations, "_busy", lambda *_: collocations.Bits(np.full(16, 0xFF, np.uint8)))
    monkeypatch.setattr(collocations.Bits, "of", classmethod(lambda cls, keys, key="key": cls(np.full(16, 0xFF if keys.count() else 0, np.uint8))))
    rows = texts(5, 120)
    assert sorted(map(tuple, collocations.mine(spark.createDataFrame(rows, SCHEMA), least=4, top=15).collect())) == brute(rows, 4, 15)


def test_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, "one two", "en", 1, "")], SCHEMA)).count() == 0


def test_exact_scores(spark):
    big = [(10**13 + 7, 10**15 - 1, 10**13 + 9, 10**14 + 3), (100, 100, 100, 100)]
    df = spark.createDataFrame(big, "a long, n long, l long, r long")
    assert [r[0] for r in df.select(collocations._score("a", "n", "l", "r")).collect()] == [1000 * a * n // (left * r) for a, n, left, r in big]


def test_bits(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    bits = collocations.Bits.of(spark.createDataFrame([(int(x),) for x in keys], "key long").withColumn("key", F.col("key")))
    others = rng.integers(-(2**63), 2**63 - 1, 100_000)
    assert bits.has(keys).all() and bits.has(others).mean() < 0.1


def test_same_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted(map(tuple, collocations.mine(docs).collect())) == sorted(duckdb.sql(collocations.PHRASES_SQL).fetchall())
