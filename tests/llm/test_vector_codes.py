"""Product codes against the same rounds in plain integers."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from argloom.llm import vector_codes
from argloom.llm.queries import op12_vector_codes

SCHEMA = "vec_id long, label int, embedding array<double>, code int, row string, part long"
BIG = 2**63


def brute(rows, n_entries=16, rounds=6):
    """(vec_id, code, error, label_error, sha) of kept rows, with integers of any size."""
    kept = [(i, label, [math.floor(x * 4096) for x in v]) for i, label, v, *_ in rows if v is not None and all(x is not None and abs(x) < 2**40 for x in v)]
    size = -(-max((len(v) for _, _, v in kept), default=0) // 8)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    split = lambda v: [(v + [0] * size * 8)[p * size : (p + 1) * size] for p in range(8)]
    vectors = [split(v) for _, _, v in kept]
    books = [[v[p] for v in vectors[:n_entries]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(8)] for v in vectors]
    for _ in range(rounds):
        made = collections.defaultdict(list)
        for v, a in zip(vectors, assign(), strict=True):
            for p in range(8):
                made[p, a[p][1]].append(v[p])
        for (p, k), own in made.items():
            books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(r[0], r[1], "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a)) for r, a in zip(kept, assign(), strict=True)]
    sums = collections.Counter()
    for _, label, _, d in found:
        sums[label] += d
    fit = lambda x: x if x < BIG else None
    return sorted(((i, c, fit(d), fit(sums[label]), sha) for i, label, c, d in found), key=str)


def vectors(seed, n, dims=24, scale=1.0, copies=0):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i // 2, None]), rng.choice([None, 1, 2, 3]), [rng.gauss(0, scale) for _ in range(dims)], 1, "clash", 2) for i in range(n)]
    rows += rows[:1] * copies
    bad = [None, [None] * dims, [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [2.0**40] * dims]
    return rows + [(900 + i, 1, v, 1, "bad", 2) for i, v in enumerate(bad)]


@pytest.mark.parametrize("rows", [vectors(1, 300, copies=400), vectors(2, 90, scale=3e7), vectors(3, 60, scale=1e11), vectors(4, 9), vectors(5, 40, dims=13) + [(5, 1, [0.5, -1.0], 1, "short", 2), (6, 1, [], 1, "empty", 2)], vectors(6, 0)])
def test_codes(spark, rows):
    out = vector_codes.run(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_empty_vectors(spark):
    found = vector_codes.run(spark.createDataFrame([(1, 1, [], 1, "", 1), (2, None, [], 1, "", 1)], SCHEMA)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in found] == [("00" * 8, 0, 0)] * 2


def test_same_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op12_vector_codes(spark, folder).collect()) == sorted(duckdb.sql(vector_codes.CODES_SQL).fetchall())


def test_decoded(spark):
    rows = vectors(7, 50)[:50]
    codes, books = vector_codes.encode(spark.createDataFrame(rows, SCHEMA))
    for r in vector_codes.decode(codes, books).collect():
        entry = [x for p in range(8) for x in books[p][int(r["code"][2 * p : 2 * p + 2], 16)]]
        assert r["decoded"] == [x / 4096 for x in entry]
    with pytest.raises(ValueError):
        vector_codes.encode(spark.createDataFrame(rows, SCHEMA), entries=0)


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 4), (3, 3), (5, 2)])
def test_curve_goes_step_by_step(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = vector_codes.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    assert (abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_shortlists_lose_nothing():
    rng = np.random.default_rng(0)
    for _ in range(200):
        values, entries = rng.integers(-20, 20, (30, 4)), rng.integers(-30, 30, (16, 4))
        values += rng.integers(-40, 40, 4)
        (short,) = vector_codes.shortlists(values.min(0)[None], values.max(0)[None], entries)
        index, far = vector_codes.nearest(values, entries)
        own, near = vector_codes.nearest(values, entries[short])
        assert (np.flatnonzero(short)[own] == index).all() and (near == far).all()
