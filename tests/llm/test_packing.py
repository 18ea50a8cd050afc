"""Packed sequences against the library, text by text."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from argloom.llm import packing
from argloom.llm.shared import new_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "sequence_id int, text string, doc_id long, ids string, tie long"


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def strange(n, seed=0):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "é", "'s", "12", ".", "<|endoftext|>", " ", "　", "中", " the", " \n", "\x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)] + ["", " ", "\n", None]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_of_strange_text(path, monkeypatch):
    monkeypatch.setattr(packing, "TABLE_PIECES", 500)
    texts, want, found = strange(4000), library(path), []
    table = packing.PieceTable(path)
    for lo in range(0, len(texts), 700):
        for _, _, ids, n in table.texts(pa.array(texts[lo : lo + 700], pa.string())):
            found += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert found == [want(x) for x in texts]


def check(df, path, window, tokenizer=BYTES):
    """Every document, sequence and piece; returns the pieces in order."""
    spark, ids = df.sparkSession, library(tokenizer)
    packing.write(df, tokenizer, path, window=window)
    pieces = sorted((r.asDict() for r in packing.pieces(spark, path, window).collect()), key=lambda r: (r["sequence_id"], r["offset"]))
    made = {r["sequence_id"]: r for r in packing.sequences(spark, path, window).collect()}
    docs, here = [], None
    for r in pieces:
        if r["start"] == 0:
            docs.append((r["doc_id"], []))
        own = np.frombuffer(made[r["sequence_id"]]["ids"], f"<u{made[r['sequence_id']]['width']}")[r["offset"] : r["offset"] + r["length"]]
        assert len(docs[-1][1]) == r["start"] and docs[-1][0] == r["doc_id"] and zlib.crc32(own.astype("<u4").tobytes()) == r["ids_crc32"]
        here = (r["sequence_id"], 0) if here is None or here[0] != r["sequence_id"] else here
        assert r["offset"] == here[1] and here[1] + r["length"] <= window
        here = (here[0], here[1] + r["length"])
        docs[-1][1].extend(own.tolist())
    assert sorted((str(d), x) for d, x in docs) == sorted((str(r["doc_id"]), [*ids(r["text"]), 0]) for r in df.collect())
    assert all(r["doc_tokens"] == len(docs[i][1]) for i, r in enumerate([p for p in pieces if p["start"] == 0]))
    assert sorted(made) == list(range(len(made))) and all(made[i]["n_tokens"] == window for i in range(len(made) - 1))
    for r in made.values():
        n = len(r["ids"]) // r["width"]
        assert n == window or n == r["n_tokens"] and n & (n - 1) == 0
        assert not any(r["ids"][r["width"] * r["n_tokens"] :])
    return pieces


@pytest.mark.parametrize("window", [8, 1024])
def test_packing(spark, monkeypatch, window):
    monkeypatch.setattr(packing, "ROW_IDS", 50)  # tasks of this test run with the usual number; the driver's own rows don't
    texts = [*strange(150, 1), "word and " * 3000, "x" * 2000]
    rows = [(7, t, i if i % 9 else None, "clash", 3) for i, t in enumerate(texts)] + [(7, "a copy of all", 3, "clash", 3)] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    one = check(df, new_path(spark, "packed"), window)
    two = check(df.coalesce(1), new_path(spark, "packed"), window)
    assert one == two  # whatever the ranges and the order of rows
    assert [p["doc_id"] for p in one if p["doc_id"] is None] and one[0]["doc_id"] is None


def test_padding(spark):
    rows = spark.createDataFrame([(0, 0, 3, w, bytes(range(3 * w))) for w in (2, 4)] + [(0, 0, 4, 2, bytes(8))], "sequence_id long, offset int, n int, w int, ids binary")
    found = [r[0] for r in rows.select(packing._filled(F.col("ids"), F.col("n"), F.col("w"), 8, 258)).collect()]
    assert found == [bytes(range(6)) + b"\x02\x01" * 5, bytes(range(12)) + b"\x02\x01\0\0" * 5, bytes(8)]


def test_long_rows():
    rng = np.random.default_rng(0)
    for window in (4, 64):
        run, cells, all_ids, first = packing._Run(np.uint16, window), [], [], 37
        for _ in range(50):
            n = rng.integers(1, 90, rng.integers(1, 6))
            ids = rng.integers(0, 60000, n.sum()).astype(np.uint16)
            cells += list(run.add(first + np.cumsum(n) - n, pa.array(range(len(n)), pa.int64()), n, np.zeros(len(n), np.int64), ids))
            all_ids.append(ids)
            first += int(n.sum())
            if rng.random() < 0.2:  # a hole in the run
                first += 1000
        cells += [run.fragments(True)] if len(run.ids) else []
        rows = [r for b in cells for r in b.to_pylist()]
        assert b"".join(r["ids"] for r in rows) == np.concatenate(all_ids).tobytes()
        assert all(r["whole"] == (r["n_tokens"] == window) and r["offset"] + r["n_tokens"] <= window and sum(p["length"] for p in r["pieces"]) == r["n_tokens"] for r in rows)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.run(none, BYTES).count() == 0
    only = spark.createDataFrame([(1, None, None, "", 1)], SCHEMA)
    assert [tuple(r) for r in packing.run(only, BYTES).collect()] == [(None, 0, 1, zlib.crc32(bytes(4)), 1, 0, 0)]
