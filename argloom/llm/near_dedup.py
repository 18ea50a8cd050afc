"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

A document's set is its distinct SHINGLE-word shingles (64-bit hashes); fewer words are one shingle, none is the empty
set, which is linked with nothing. Documents whose sets are equal form a class, kept together by a 128-bit
hash of the set, so a group of copies counts once from then on.

Each class has REGISTERS HyperMinHash registers: the least hash of a bucket as its count of leading zeros (6 bits) and the
MANTISSA bits that follow; empty buckets borrow from others in a fixed random order. BAND registers make a band; classes that
agree in a band meet (at similarity 0.75 one of 48 bands of 4 fails to join them once in 10**8). Sets of at most
SMALL shingles also meet by the prefixes that two sets of similarity 0.75 must share, so small sets miss nothing.
Where classes meet, similarity is estimated from equal registers, less the collisions to be expected; pairs within
SLACK standard errors of the limit connect classes to clusters. Only then are full sets fetched, once for
a cluster, and every pair in a cluster that nothing joins yet is decided exactly; what leaves a unit of work is at most one link per class.

A bucket or cluster beyond a block first meets one pivot of its own, up to PIVOTS times: rows linked with the pivot are joined
through it and never meet each other, so a group of near copies costs as much as it has rows. Rows that aren't linked with it stay, and meet the
linked ones where the triangle inequality of Jaccard distances allows a link (in clusters: similarity 0.5 to the pivot). What stays after that is cut into
blocks, each pair of blocks being a task's unit of bounded size.

Null texts are empty. A null doc_id is linked with nothing and has no component. Rows that repeat a doc_id count as one document
with the links of all of them. Long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import parts, written
from .textblocks import Block, blocks, mix

SHINGLE, PERCENT = 5, 75
REGISTERS, BAND, MANTISSA, SMALL, SLACK = 192, 4, 10, 24, 5.0
#: Classes of a bucket compared at once, and classes of a cluster whose sets are compared at once.
BUCKET_BLOCK, CLUSTER_BLOCK = 512, 128
#: So many times the rows of a larger group meet one of them before pairs of blocks do.
PIVOTS = 4
#: Up to so many classes are sent to all tasks to fetch their texts (24 bytes each); more are joined by a shuffle.
BROADCAST_CLASSES = 100_000
_A, _B, _C = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _sets(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles, sorted by text and hash."""
    words = b.word_hash()
    found = []
    for k in range(1, SHINGLE + 1):
        hashes, at = b.grams(words, k)
        use = np.ones(len(at), bool) if k == SHINGLE else b.n_words[b.doc[at]] == k
        found.append((hashes[use], b.doc[at][use]))
    hashes, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def _register(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits behind the first one, in 16 bits."""
    zeros, x = np.zeros(least.shape, np.uint64), least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < np.uint64(1) << np.uint64(64 - step)
        zeros[low] += np.uint64(step)
        x[low] <<= np.uint64(step)
    return (zeros << np.uint64(MANTISSA) | (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)).astype(np.uint16)


_PROBES = np.random.default_rng(7).integers(0, REGISTERS, (32, REGISTERS))


def registers(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS; rows of empty sets are 0."""
    bucket = (mix(hashes ^ _A) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc * REGISTERS + bucket.astype(np.int64), mix(hashes ^ _B))
    least = least.reshape(n, REGISTERS)
    empty = least == np.iinfo(np.uint64).max
    out = _register(least)
    out[empty] = 0
    full = ~empty
    for probe in _PROBES:
        rows = np.flatnonzero(empty.any(1) & full.any(1))
        if not len(rows):
            break
        take = empty[rows] & full[rows][:, probe]
        out[rows] = np.where(take, out[rows][:, probe], out[rows])
        empty[rows] &= ~take
    for i in np.flatnonzero(empty.any(1) & full.any(1)):  # few registers filled: the next one borrows
        has = np.flatnonzero(full[i])
        gaps = np.flatnonzero(empty[i])
        out[i, gaps] = out[i, has[np.searchsorted(has, gaps) % len(has)]]
    return out


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, hash of the set (s1, s2), registers, and keys by which small sets meet; for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(batch.column(1), lower=True):
                hashes, doc = _sets(b)
                n = np.bincount(doc, minlength=b.n)
                at = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ c))]) for c in (_B, _C)]
                s1, s2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                regs = registers(hashes, doc, b.n)
                # Of the shingles in order, sets of at least this similarity share one of the first n - ceil(0.75 n) + 1.
                prefix = np.where(n * PERCENT <= SMALL * 100, n - -(-n * PERCENT // 100) + 1, 0) * (n > 0)
                firsts = np.concatenate([hashes[a : a + p] for a, p in zip(at[:-1], prefix, strict=True)] or [hashes[:0]])
                small = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]), pa.int32()), pa.array(mix(firsts ^ _A).view(np.int64)))
                packed = pa.array([r.tobytes() for r in regs], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), packed, small], names=["doc_id", "n_shingles", "s1", "s2", "regs", "small"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, regs binary, small array<long>")


def _whole_groups(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Hand over sorted rows in tables of whole units (first column), with where each unit begins and the end."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, rows]) if held is not None else rows
        unit = held.column(0).to_numpy()
        last = int(np.flatnonzero(unit == unit[-1])[0])
        if last:
            done = unit[:last]
            yield from work(held.slice(0, last), np.concatenate([np.flatnonzero(np.diff(done, prepend=done[0] - 1)), [last]]))
            held = held.slice(last)
    if held is not None:
        yield from work(held, np.array([0, held.num_rows]))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on 0..n-1."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


_LEVELS = np.arange(64)


def _level_shares(n: np.ndarray) -> np.ndarray:
    """Share of registers by leading zeros for sets of n shingles (at least one to a register)."""
    per = np.maximum(n / REGISTERS, 1.0)[:, None]
    upper = (1 - 0.5 ** (_LEVELS + 1.0)) ** per
    lower = (1 - 0.5 ** (_LEVELS + 0.0)) ** per
    return upper - lower


def _near(equal: np.ndarray, n1: np.ndarray, n2: np.ndarray, collide: np.ndarray) -> np.ndarray:
    """Whether the similarity, estimated from the share of equal registers less collisions, may reach the limit."""
    least, most = np.minimum(n1, n2), np.maximum(n1, n2)
    estimate = (equal - collide) / (1 - collide)
    error = np.sqrt(0.1875 * (1 / REGISTERS + 1 / least))
    return (estimate >= PERCENT / 100 - SLACK * error) & (100 * least >= PERCENT * most)


def _meet(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links between classes of a unit that may be near, as a forest."""
    reps, n = table.column("rep").to_numpy(), table.column("n_shingles").to_numpy()
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    shares = _level_shares(n)
    # Neighbours first: a unit whose every neighbours are near is connected by them.
    collide = (shares[1:] * shares[:-1]).sum(1) / (1 << MANTISSA)
    near = _near((regs[1:] == regs[:-1]).mean(1), n[1:], n[:-1], collide)
    inside = np.ones(len(near), bool)
    inside[starts[1:-1] - 1] = False
    near |= reps[1:] == reps[:-1]
    i = np.flatnonzero(near & inside)
    a, b = [reps[i]], [reps[i + 1]]
    broken = np.unique(np.searchsorted(starts, np.flatnonzero(inside & ~near), "right") - 1)
    for lo, hi in zip(starts[broken], starts[broken + 1], strict=True):
        if hi - lo > 2:
            r, own, x = regs[lo:hi], n[lo:hi], shares[lo:hi]
            near_pairs = np.zeros((hi - lo, hi - lo), bool)
            for j in range(hi - lo):
                near_pairs[j, j + 1 :] = _near((r[j + 1 :] == r[j]).mean(1), own[j + 1 :], np.full(hi - lo - j - 1, own[j]), x[j + 1 :] @ x[j] / (1 << MANTISSA))
            edges = np.array(_forest(hi - lo, *np.nonzero(near_pairs)), int).reshape(-1, 2) + lo
            a.append(reps[edges[:, 0]]), b.append(reps[edges[:, 1]])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])


def _confirm(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of a unit that hold on full sets, as a forest."""
    reps, packed = table.column("rep").to_numpy(), table.column("shingles").to_pylist()
    out: list[tuple[int, int]] = []
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        sets = [np.frombuffer(x, np.uint64) for x in packed[lo:hi]]
        size = np.array([len(s) for s in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(hi - lo), size)
        _, at, count = np.unique(values, return_inverse=True, return_counts=True)
        common = np.zeros((hi - lo, hi - lo), np.int64)
        dense = np.cumsum(count > 1) - 1
        use = count[at] > 1
        column, owner = dense[at[use]], owner[use]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        width = 1 << 13
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            x, y = np.searchsorted(column, [first, first + width])
            part = np.zeros((hi - lo, width), np.float32)
            part[owner[x:y], column[x:y] - first] = 1
            common += (part @ part.T).astype(np.int64)
        linked = np.triu(100 * common >= PERCENT * (size[:, None] + size[None, :] - common), 1)
        out += [(reps[lo + i], reps[lo + j]) for i, j in _forest(hi - lo, *np.nonzero(linked))]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _units(rows: DataFrame, key: str, n: str, block: int) -> DataFrame:
    """Rows with unit, sorted by it within partitions: a group of n rows is one unit, or one for each pair of its blocks."""
    rows = rows.withColumn("n_blocks", F.ceil(F.col(n) / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep", key), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    unit = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    kept = [c for c in rows.columns if c not in ("n_blocks", "own", "other", key, n)]
    return rows.select(unit, *kept)


def _near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with nearness 2 where they may be near their pivot, else 1."""
    for batch in batches:
        own, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs", "p_regs"))
        n, m = batch.column("n_shingles").to_numpy(), batch.column("p_n_shingles").to_numpy()
        collide = (_level_shares(n) * _level_shares(m)).sum(1) / (1 << MANTISSA)
        near = 1 + _near((own == pivot).mean(1), n, m, collide)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(near, pa.int32())], names=["key", "rep", "n_shingles", "regs", "p", "nearness"])


def _linked_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of clusters with nearness 2 where they are linked with their pivot, 1 where they may be linked with one that is, else 0."""
    for batch in batches:
        near = []
        for own, pivot in zip(batch.column("shingles"), batch.column("p_shingles"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (own, pivot))
            common = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - common
            near.append(2 if 100 * common >= PERCENT * union else int(100 * common >= (2 * PERCENT - 100) * union))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near, pa.int32())], names=["key", "rep", "shingles", "p", "nearness"])


def _by_unit(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition(parts(rows.sparkSession), "unit").sortWithinPartitions("unit", *more)


def _split(left: DataFrame, block: int, judge: Callable) -> tuple[DataFrame, DataFrame]:
    """Groups beyond a block (key, rep, more columns; a stored table): links with pivots, and the units that remain."""
    kept = left.columns[1:]
    types = {f.name: f.dataType.simpleString() for f in left.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in left.columns) + ", p long, nearness int"
    links, units = [], []
    for turn in range(PIVOTS):
        sizes = left.groupBy("key").agg(F.min("rep").alias("p"), F.count("*").alias("n"))
        if sizes.where(F.col("n") > block).isEmpty():
            break
        first = left.join(sizes.select(F.col("key").alias("k"), "p"), (F.col("key") == F.col("k")) & (F.col("rep") == F.col("p")))
        first = first.select("k", "p", *[F.col(c).alias(f"p_{c}") for c in kept[1:]]).dropDuplicates(["k"])  # a doc_id with equal texts
        met = left.join(first, F.col("key") == F.col("k")).select(*left.columns, "p", *[f"p_{c}" for c in kept[1:]])
        judged = written(met.mapInArrow(judge, schema), "pivots")
        links.append(judged.where("nearness = 2 and rep != p").select(F.col("rep").alias("a"), F.col("p").alias("b")))
        blocks_of = lambda n: F.ceil(F.count_if(F.col("nearness") == n) / block).cast("int")
        both = judged.groupBy(F.col("key").alias("k")).agg(blocks_of(2).alias("n_near"), blocks_of(1).alias("n_far")).where("n_far > 0")
        both = judged.where("nearness > 0").join(both, F.col("key") == F.col("k"))
        near = F.col("nearness") == 2
        both = both.withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.when(near, F.col("n_near")).otherwise(F.col("n_far"))).cast("int"))
        both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(near, F.col("n_far")).otherwise(F.col("n_near")) - 1)))
        unit = F.xxhash64("key", F.lit(turn), F.when(near, F.col("own")).otherwise(F.col("other")), F.when(near, F.col("other")).otherwise(F.col("own")))
        units.append(both.select(unit.alias("unit"), *kept))
        left = judged.where("nearness < 2").select("key", *kept)
    sizes = left.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"))
    units.append(_units(left.join(sizes, F.col("key") == F.col("k")).drop("k"), "key", "n", block))
    return reduce(DataFrame.unionByName, links), reduce(DataFrame.unionByName, units)


def _band_keys():
    return F.array(*[F.xxhash64(F.substring("regs", 1 + 2 * BAND * i, 2 * BAND), F.lit(i)) for i in range(REGISTERS // BAND)])


def link_classes(docs: DataFrame, classes: DataFrame, text: str = "text") -> DataFrame:
    """Links (a, b) that connect classes just as all links do; classes: rep, n_shingles, s1, s2, regs, small."""
    keys = classes.select("rep", F.explode(F.concat(_band_keys(), "small")).alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    met = written(keys.join(shared, F.col("key") == F.col("k")).select("key", "rep", "n"), "buckets")
    own = classes.select(F.col("rep").alias("r"), "n_shingles", "regs")
    units = _units(met.where(F.col("n") <= BUCKET_BLOCK), "key", "n", BUCKET_BLOCK).join(own, F.col("rep") == F.col("r")).drop("r")
    hot, pivots = met.where(F.col("n") > BUCKET_BLOCK), None
    if not hot.isEmpty():
        pivots, more = _split(written(hot.join(own, F.col("rep") == F.col("r")).select("key", "rep", "n_shingles", "regs"), "large-buckets"), BUCKET_BLOCK, _near_pivot)
        units = units.unionByName(more)
    near = _by_unit(units, "n_shingles", "rep").mapInArrow(lambda it: _whole_groups(it, _meet), "a long, b long")
    near = (near.unionByName(pivots) if pivots else near).distinct()
    clusters = components(near).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n")).withColumnRenamed("cluster", "c")
    wanted = written(clusters.join(sizes, F.col("cluster") == F.col("c")).drop("c").join(classes.select(F.col("rep").alias("r"), "s1", "s2"), F.col("rep") == F.col("r")).drop("r"), "clusters")
    again = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("twice")).agg(F.count("*").alias("c")).where("c > 1").select("twice"), "repeated-ids")
    some = not again.isEmpty()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(batch.column(5), lower=True):
                hashes, doc = _sets(b)
                at = np.searchsorted(doc, np.arange(b.n + 1))
                part = batch.slice(lo, hi - lo).select([0, 1, 2])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ c))]) for c in (_B, _C)]
                same = np.ones(b.n, bool)  # another text may have the doc_id of a class
                for s, i in zip(sums, (3, 4), strict=True):
                    same &= (s[at[1:]] - s[at[:-1]]).view(np.int64) == batch.column(i).to_numpy()[lo:hi]
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array([hashes[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["rep", "cluster", "n", "shingles"])
                yield out.filter(pa.array(same))

    def sets(part: DataFrame) -> DataFrame:
        few = part.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
        texts = docs.select("doc_id", text).join(F.broadcast(part) if few else part, F.col("doc_id") == F.col("rep")).select("rep", "cluster", "n", "s1", "s2", text)
        found = lambda rows: rows.mapInArrow(fetch, "rep long, cluster long, n long, shingles binary")
        if not some:
            return found(texts)
        # A doc_id that repeats with its text gives the same set once.
        once = texts.join(again, F.col("rep") == F.col("twice"), "left_anti")
        return found(once).unionByName(found(texts.join(again, F.col("rep") == F.col("twice"), "left_semi").dropDuplicates(["rep", "cluster", text])))

    units = _units(sets(wanted.where(F.col("n") <= CLUSTER_BLOCK)), "cluster", "n", CLUSTER_BLOCK)
    hot, pivots = wanted.where(F.col("n") > CLUSTER_BLOCK), None
    if not hot.isEmpty():
        pivots, more = _split(written(sets(hot).select(F.col("cluster").alias("key"), "rep", "shingles"), "large-clusters"), CLUSTER_BLOCK, _linked_pivot)
        units = units.unionByName(more)
    links = _by_unit(units).select("unit", "rep", "shingles").mapInArrow(lambda it: _whole_groups(it, _confirm), "a long, b long")
    return links.unionByName(pivots) if pivots else links


def run(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    signed = written(signatures(docs, text), "signatures")
    part = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(part.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"), F.first("small").alias("small")), "classes")
    links = link_classes(docs, classes, text)
    rep = classes.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("n_shingles").alias("m"), "rep")
    same = (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n_shingles") == F.col("m")) & F.col("doc_id").isNotNull()
    members = written(signed.select("doc_id", "n_shingles", "s1", "s2").join(rep, same, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    # One doc_id in several classes joins them.
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a != most").select(F.col("doc_id").alias("d"), "a")
    joined = members.join(several, F.col("doc_id") == F.col("d")).select("a", F.col("rep").alias("b"))
    found = components(links.unionByName(joined))
    out = members.join(found, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", (F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).alias("kept"))


#: run() in DuckDB's SQL, over `documents`.
LINKS_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reached) AS component_id, w.doc_id = min(r.reached) AS kept
FROM w JOIN r ON w.doc_id = r.doc_id LEFT JOIN n ON w.doc_id = n.doc_id GROUP BY w.doc_id, n.n
"""
