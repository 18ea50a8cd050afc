"""Exact top-k inner products with an impact-ordered index, score at a time.

Components become integers, floor(SCALE * x). Vectors are dealt into shards by hash; a shard's index holds its postings
(dimension, vector, impact) in segments of descending quantised impact, level = bits of |impact|, and what each
vector's components below each level amount to (their Euclidean norm). A block of queries takes a shard's
segments from the highest level down and adds query weight times impact to its accumulators. After a
segment, by Cauchy-Schwarz, a vector's score is within |query| * |rest of the vector| of what it has so far. A query
stops when this proves that at most POSSIBLE vectors can be among its k best (or the segments end); these are scored anew in
exact integers. Shards' best are merged per query row by a window.

Shards and blocks of queries meet in groups of one shard and up to GROUP_BLOCKS blocks, by a cogroup: both sides are dealt by key, whatever
their sizes, and nothing of them passes through the driver.
Vectors that are null, hold null or non-finite components, or have no vec_id take no part. Shorter vectors count as padded
with zeros. Other columns are ignored, whatever their names. A query never finds rows of its own vec_id; other repeated rows are found once each. Ties go to the smaller vec_id.
Every query row is answered by itself: where a vec_id is repeated among the queries, each of its rows has its own k best, ranked from 1.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SCALE, SHARD, QUERY_BLOCK, POSSIBLE = 1024, 8192, 512, 64
#: Blocks of queries that meet a shard in one group (all of them are in memory at once, some 0.3 MB each, and 10 MB for the shard), and the largest number of partitions.
GROUP_BLOCKS, MOST_PARTS = 8, 4096


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the integer components, of the vectors that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).where(sound).select("vec_id", F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("x"))


def _matrix(rows: pd.Series) -> np.ndarray:
    x = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x


def build(vec_ids: np.ndarray, x: np.ndarray) -> dict:
    """A shard's index."""
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, x = vec_ids[order], x[order]
    doc, dim = np.nonzero(x)
    value = x[doc, dim]
    level = np.frexp(np.abs(value).astype(float))[1]
    down = np.argsort(-level, kind="stable")
    doc, dim, value, level = doc[down].astype(np.int32), dim[down].astype(np.int32), value[down], level[down]
    cuts = np.concatenate([np.flatnonzero(np.diff(level, prepend=level[:1] + 1)), [len(level)]]) if len(level) else np.zeros(1, int)
    return {"ids": vec_ids, "dims": x.shape[1], "doc": doc, "dim": dim, "value": value, "cuts": cuts}


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if len(q) and float(np.abs(x).max(initial=0)) * float(np.abs(q).max()) * len(q) >= 2**62:
        return np.array([sum(map(int.__mul__, map(int, r), map(int, q))) for r in x], object)
    return x @ q


def search(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the queries, vec_id, score) of each query's k best of the shard."""
    ids, dims = index["ids"], max(index["dims"], queries.shape[1])
    m = len(ids)
    q = np.zeros((len(queries), dims), np.int64)
    q[:, : queries.shape[1]] = queries
    whole = np.zeros((m, dims), np.int64)
    whole[index["doc"], index["dim"]] = index["value"]
    rest = (whole.astype(float) ** 2).sum(1)
    norm, q_norm = np.sqrt(rest), np.sqrt((q.astype(float) ** 2).sum(1))
    open_, scores = np.arange(len(q)), np.zeros((len(q), m))
    first, last = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def finish(i: int, possible: np.ndarray) -> None:
        possible = possible[(possible < first[i]) | (possible >= last[i])]
        s = _exact(whole[possible], q[i])
        best = sorted(range(len(s)), key=lambda j: (-s[j], ids[possible[j]]))[:k] if len(s) <= 4 * POSSIBLE or s.dtype == object else np.lexsort((ids[possible], -s))[:k]
        out.append((np.full(len(best), i), ids[possible[best]], s[best]))

    cuts = index["cuts"]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        doc, dim, value = index["doc"][a:b], index["dim"][a:b], index["value"][a:b].astype(float)
        # Only the vectors and dimensions that have a posting in the segment are touched.
        own_docs, i = np.unique(doc, return_inverse=True)
        own_dims, j = np.unique(dim, return_inverse=True)
        segment = np.zeros((len(own_docs), len(own_dims)))
        segment[i, j] = value
        gain = q[np.ix_(open_, own_dims)].astype(float) @ segment.T
        if len(own_docs) == m:
            scores[open_] += gain
        else:
            scores[np.ix_(open_, own_docs)] += gain
        rest = np.maximum(rest - np.bincount(doc, weights=value**2, minlength=m), 0)
        left = np.sqrt(rest) + 1e-7 * norm
        if m <= POSSIBLE or b < len(index["doc"]) and left.mean() > norm.mean() / 3:
            continue  # too early to prove anything
        still = []
        for i in open_:
            within = q_norm[i] * left + 1e-6
            low = scores[i] - within
            low[first[i] : last[i]] = -np.inf
            sure = np.partition(low, max(m - k, 0))[max(m - k, 0)]
            possible = np.flatnonzero(scores[i] + within >= sure)
            if len(possible) <= POSSIBLE:
                finish(i, possible)
            else:
                still.append(i)
        open_ = np.array(still, int)
        if not len(open_):
            break
    for i in open_:
        finish(i, np.arange(m))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def top_k(vectors: DataFrame, is_query, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k best of all vectors."""
    rows = written(integers(vectors, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERY_BLOCK))
    deal = lambda parts, seed: F.pmod(F.xxhash64("vec_id", "x", F.lit(seed)), F.lit(parts)).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["x"])
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "segments": [pickle.dumps(build(pdf["vec_id"].to_numpy(), x))]})

    def pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "queries": [pickle.dumps((pdf["row"].to_numpy(), pdf["vec_id"].to_numpy(), _matrix(pdf["x"])))]})

    def find(shard: pd.DataFrame, blocks_: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        if len(shard):
            index = pickle.loads(shard["segments"].iloc[0])
            for queries in blocks_["queries"]:
                row, ids, x = pickle.loads(queries)
                q, v, s = search(index, ids, x, k)
                out.append(pd.DataFrame({"row": row[q], "query_id": ids[q], "vec_id": v, "score": s.astype(np.int64)}))
        return pd.concat(out)

    groups = -(-blocks // GROUP_BLOCKS)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.withColumn("shard", deal(shards, 1)).repartition(min(shards, MOST_PARTS), "shard").groupBy("shard").applyInPandas(pack, "shard int, segments binary").withColumn("group", each(groups))
    asked = rows.where(is_query).withColumn("block", deal(blocks, 2)).groupBy("block").applyInPandas(pack_queries, "block int, queries binary").withColumn("group", F.pmod("block", F.lit(groups))).withColumn("shard", each(shards))
    met = [df.repartition(min(shards * groups, MOST_PARTS), "shard", "group").groupBy("shard", "group") for df in (index, asked)]
    best = met[0].cogroup(met[1]).applyInPandas(find, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: top_k() of every hundredth vector in DuckDB's SQL, over `embeddings`.
TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id != q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
