"""Product codes of vectors: each part of a vector is replaced by the nearest of a few entries of its codebook, in exact integers.

1. Components become integers floor(SCALE * x). Every part of every vector goes to its place on a Hilbert curve of its own dimensions; sorted
   along it, neighbours lie close together.
2. Consecutive parts of one position make flat blocks of BLOCK: their integers, the box around them (least and largest of each component) and
   their sums.
3. In each round a task compares the boxes with the codebook: an entry whose least distance to a box exceeds some other entry's largest
   distance is nearest to none of the block. What is left is the block's shortlist. With one entry left, the block's sums count as they are;
   otherwise its parts are compared with the shortlist alone. Tasks send counts and sums by entry and component; the driver sees these
   (entries times components) and makes the next codebook.
4. The last assignment gives each vector its code and its error.

Distances are exact: 64-bit where they surely fit, else integers of any size. A vector that is null or has a null, non-finite or huge (2**40 or
more) component is dropped. Shorter vectors count as followed by zeros, up to a multiple of PARTS components; empty ones are all alike. With
fewer vectors than entries there are as many entries as vectors. Rows that repeat a vec_id are vectors of their own; null vec_ids stand behind all
others. An error beyond 64 bits is null. Rows without a label have their sum together. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts in a block, bytes of integers for each range of the curve, and the components that are too large.
BLOCK, RANGE_BYTES, HUGE = 256, 32 << 20, float(1 << 40)
#: Up to so many labels (some 40 bytes each) have their sums sent to all tasks; more are joined by a shuffle.
BROADCAST_LABELS = 200_000
_BLOCKS = "part int, n int, rows binary, values binary, lo binary, hi binary, sums binary"


class Shape(NamedTuple):
    """What all tasks must know of the vectors: components of a part, the range of all integers, and how they are kept."""

    size: int
    lo: int
    hi: int
    kept: str  # numpy's name of the type in blocks
    wide: bool  # distances may pass 64 bits

    @classmethod
    def of(cls, dims: int, lo: int, hi: int) -> Shape:
        size, most = -(-dims // PARTS), max(abs(lo), abs(hi))
        kept = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 1 << bits)
        return cls(size, lo, hi, kept, PARTS * size * (2 * most) ** 2 >= 1 << 62)

    @property
    def exact(self) -> type:
        return object if self.wide else np.int64


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of points on the curve through a grid with 2**bits cells along each axis (at most 63 bits in all)."""
    axes = [x.astype(np.int64) for x in cells.T]
    for b in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        below = (1 << b) - 1
        for i in range(len(axes)):
            turned = (axes[i] >> b & 1).astype(bool)
            swap = np.where(turned, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(turned, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] >> b & 1, (1 << b) - 1, 0)
    place = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for x in axes:
            place = place << 1 | (x ^ flip) >> b & 1
    return place


def _curve(values: np.ndarray, shape: Shape) -> np.ndarray:
    """Place of each part: cells over the range of all integers, on the first 63 components at most."""
    used = values[:, :63]
    if not used.shape[1]:
        return np.zeros(len(values), np.int64)
    bits = min(16, 63 // used.shape[1])
    cells = (used - shape.lo).astype(float) * ((1 << bits) / (shape.hi - shape.lo + 1))
    return hilbert(np.minimum(cells.astype(np.int64), (1 << bits) - 1), bits)


def _integers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """row, vec_id, label, values of all vectors that are kept; row tells them apart."""
    x = F.col("v").cast("array<double>")
    good = F.col("v").isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c) < HUGE, F.lit(False)))  # NaN is above all numbers
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(good)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform(x, lambda c: F.floor(c * SCALE)).alias("values"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows, zeros behind the shorter ones."""
    ends = column.offsets.to_numpy()
    n = np.diff(ends)
    flat = column.values.to_numpy()[ends[0] : ends[-1]]
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)] = flat
    return out


def _blocks(kept: DataFrame, shape: Shape, n: int) -> DataFrame:
    """Flat blocks of all parts, along the curve of their position."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(1), shape.size * PARTS)
            for p in range(PARTS):
                own = np.ascontiguousarray(values[:, p * shape.size : (p + 1) * shape.size])
                cells = [x.tobytes() for x in own.astype(shape.kept)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p, np.int32)), pa.array(_curve(own, shape)), batch.column(0), pa.array(cells, pa.binary())], names=["part", "place", "row", "own"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rows, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            out = []
            for run in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1) if len(part) else ():
                for at in range(int(run[0]), int(run[-1]) + 1, BLOCK):
                    end = min(at + BLOCK, int(run[-1]) + 1)
                    values = np.frombuffer(b"".join(cells[at:end]), shape.kept).reshape(end - at, shape.size)
                    box = [x.tobytes() for x in (values.min(0), values.max(0), values.sum(0, dtype=np.int64))]
                    out.append((int(part[at]), end - at, rows[at:end].tobytes(), values.tobytes(), *box))
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    spark = kept.sparkSession
    ranges = max(parts(spark), -(-n * shape.size * PARTS * np.dtype(shape.kept).itemsize // RANGE_BYTES))
    keyed = kept.select("row", "values").mapInArrow(places, "part int, place long, row long, own binary")
    keyed = keyed.repartitionByRange(ranges, "part", "place", "row").sortWithinPartitions("part", "place", "row")
    return keyed.select("part", "row", "own").mapInArrow(pack, _BLOCKS)


def shortlists(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries may be nearest to something in each box: (boxes, entries)."""
    lo, hi = lo[:, None, :], hi[:, None, :]
    outside = np.maximum(np.maximum(lo - entries, entries - hi), 0)
    across = np.maximum(abs(entries - lo), abs(entries - hi))
    return (outside * outside).sum(2) <= (across * across).sum(2).min(1)[:, None]


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower one of equals; squared distance) of each row."""
    far = values[:, None, :] - entries
    far = (far * far).sum(2)
    index = far.argmin(1)
    return index, far[np.arange(len(values)), index]


def _read(batch: pa.RecordBatch, shape: Shape, codebooks: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, n, rows, values, sums, shortlist) of each block."""
    part, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    of = lambda i, kind: np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(len(part), shape.size).astype(shape.exact)
    lo, hi, sums = of(4, shape.kept), of(5, shape.kept), of(6, "<i8")
    short = np.zeros((len(part), len(codebooks[0])), bool)
    for p in np.unique(part).tolist():
        own = part == p
        short[own] = shortlists(lo[own], hi[own], codebooks[p])
    for i in range(len(part)):
        values = np.frombuffer(batch.column(3)[i].as_py(), shape.kept).reshape(int(n[i]), shape.size).astype(shape.exact)
        yield int(part[i]), int(n[i]), np.frombuffer(batch.column(2)[i].as_py(), np.int64), values, sums[i], np.flatnonzero(short[i])


def _round(blocks: DataFrame, shape: Shape, codebooks: list) -> list:
    """The next codebooks: each entry the floor of its parts' mean; unused ones stay."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, len(codebooks[0])), np.int64)
        sums = np.zeros((PARTS, len(codebooks[0]), shape.size), shape.exact)
        for batch in batches:
            for part, n, _, values, whole, short in _read(batch, shape, codebooks) if batch.num_rows else ():
                if len(short) == 1:
                    counts[part, short[0]] += n
                    sums[part, short[0]] += whole
                    continue
                index, _ = nearest(values, codebooks[part][short])
                for i, e in enumerate(short.tolist()):
                    own = index == i
                    counts[part, e] += int(own.sum())
                    sums[part, e] += values[own].sum(0)
        p, e = np.nonzero(counts)
        at = np.tile(np.arange(shape.size, dtype=np.int32), len(p))
        columns = [np.repeat(p, shape.size).astype(np.int32), np.repeat(e, shape.size).astype(np.int32), at, np.repeat(counts[p, e], shape.size)]
        total = pa.array([Decimal(int(x)) for x in sums[p, e].ravel().tolist()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), total], names=["part", "entry", "at", "n", "total"])

    found = blocks.mapInArrow(add, "part int, entry int, at int, n long, total decimal(38,0)").groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [x.copy() for x in codebooks]
    for r in found.collect():  # at most one for each entry and component
        out[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def _codes(blocks: DataFrame, shape: Shape, codebooks: list) -> DataFrame:
    """row, code, error: the entries of each vector, a byte for each part, and the sum of their distances."""
    kind = "decimal(38,0)" if shape.wide else "long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, rows, values, _, short in _read(batch, shape, codebooks) if batch.num_rows else ():
                index, far = nearest(values, codebooks[part][short])
                error = pa.array([Decimal(int(x)) for x in far.tolist()], pa.decimal128(38, 0)) if shape.wide else pa.array(far)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(short[index] << 8 * (PARTS - 1 - part)), error], names=["row", "code", "error"])

    out = blocks.mapInArrow(assign, f"row long, code long, error {kind}").groupBy("row").agg(F.sum("code").alias("code"), F.sum("error").alias("error"))
    return out.select("row", F.lower(F.lpad(F.hex("code"), 2 * PARTS, "0")).alias("code"), "error")


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error of every vector that is kept; the codebooks: part, entry, component)."""
    if not 1 <= entries <= 128:
        raise ValueError(f"1 to 128 entries, not {entries}")
    kept = written(_integers(vectors, key, vector, label), "integers")
    n, dims, lo, hi = kept.agg(F.count("*"), F.max(F.size("values")), F.min(F.array_min("values")), F.max(F.array_max("values"))).first()
    shape = Shape.of(dims or 0, min(lo or 0, 0), max(hi or 0, 0))
    first = [r["values"] + [0] * (shape.size * PARTS - len(r["values"])) for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(entries).collect()]
    codebooks = [np.array([x[p * shape.size : (p + 1) * shape.size] for x in first], shape.exact).reshape(len(first), shape.size) for p in range(PARTS)]
    if not n:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    blocks = written(_blocks(kept, shape, n), "blocks")
    for _ in range(rounds):
        codebooks = _round(blocks, shape, codebooks)
    codes = _codes(blocks, shape, codebooks).withColumnRenamed("row", "r")
    out = kept.select("row", "vec_id", "label").join(codes, F.col("row") == F.col("r"))
    return out.select("vec_id", "label", "code", "error"), [[[int(x) for x in e] for e in book.tolist()] for book in codebooks]


def decode(codes: DataFrame, codebooks: list[list[list[int]]]) -> DataFrame:
    """The codes with `decoded`: the entries they name, as vectors on the scale of the given ones."""
    books = F.lit([[[x / SCALE for x in e] for e in book] for book in codebooks])
    part = lambda p: F.get(F.get(books, p), F.conv(F.substr(F.col("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int"))
    return codes.withColumn("decoded", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), part)))


def run(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    codes, codebooks = encode(vectors)
    codes = written(codes, "codes")
    sums = codes.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    few = sums.count() <= BROADCAST_LABELS
    said = hashlib.sha256(",".join(str(x) for book in codebooks for e in book for x in e).encode()).hexdigest()
    long = lambda c: F.expr(f"try_cast({c} as bigint)").alias(c)
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", long("error"), long("label_error"), F.lit(said).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """The same rounds over all parts and entries."""
    steps = [f"""
v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS i, vec_id, label, x FROM (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
p AS (SELECT i, j AS part, x[j * (len(x) // {PARTS}) + 1 : (j + 1) * (len(x) // {PARTS})] AS y FROM v, range({PARTS}) t(j)),
c0 AS (SELECT part, i AS entry, y AS e FROM p WHERE i < {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, part, y, arg_min(entry, [d, entry]) AS entry, min(d) AS d FROM (SELECT i, p.part, y, entry, list_sum(list_transform(list_zip(y, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{r} c ON c.part = p.part) GROUP BY i, part, y)")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT part, entry, list(q ORDER BY pos) AS e FROM (SELECT part, entry, pos, (sum(y[pos]) - ((sum(y[pos]) % count(*)) + count(*)) % count(*)) // count(*) AS q FROM a{r}, generate_series(1, len(y)) g(pos) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry)""")
    return f"""WITH {", ".join(steps)},
s AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS said FROM c{ROUNDS}),
o AS (SELECT i, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY i)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, said AS codebooks_sha256 FROM v JOIN o USING (i), s"""


CODES_SQL = _codes_sql()
