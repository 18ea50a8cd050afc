"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Sources, by code point and null last, weigh 5, 2, 1, repeating. All sizes are shared out by weight;
a target stops at MOST times its source's size and the excess is shared anew by weight, which
is the level L with sum(min(weight * L, MOST * size)) = total. Of a source, every document is taken in as many
complete epochs as fit its target. The rest of the budget is filled in the order of
exponential keys, -ln(u) / quality weight: the documents of least key whose sizes, summed up, come
nearest to the rest. u comes from doc_id, so reruns agree; rows of one doc_id follow
each other by size and text hash.

Keys fall into BUCKETS of nearly equal share. Buckets are summed per source first, so that only the rows
of the one bucket in which the budget ends are sorted: a source with a third of all rows needs no task of its own.

Null texts have size 0. Documents without words have nothing to take. A source without words has target 0.
Null doc_ids share one u. Extra columns are ignored by plan(), kept by resampled(), whatever their names. An empty table gives no rows.
The list of sources (not of documents) is ranked and summed in one task: some 50 bytes a source, so a million sources are 50 MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WEIGHTS, MOST, BUCKETS, SALTS = (5, 2, 1), 3, 4096, 64
#: Goals of up to so many bytes in all are sent to every task, so that rows stay where they are; more are joined by a salted shuffle.
BROADCAST_BYTES = 8 << 20
#: Quality weight: near 1 for ordinary words, down to 1/2 for texts of very short or very long ones.
USUAL_WORD = 6.0


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key() -> Column:
    """-ln(u) / quality weight; u in (0, 1) from doc_id."""
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    word = F.greatest(F.col("chars") / F.greatest(F.col("size"), F.lit(1)), F.lit(0.5))
    weight = 0.5 + 0.5 * F.least(word / USUAL_WORD, USUAL_WORD / word)
    return -F.log(u) / weight


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows of (source, source_size); only the list of sources is sorted as one."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)).withColumn("most", F.col("source_size") * float(MOST))
    # Sources in the order in which a rising level stops them; at each, the level that the others could have.
    stops = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, whole = stops.rowsBetween(Window.unboundedPreceding, -1), stops.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    levels = weighed.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    levels = levels.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(whole))
    return levels.select("source", "source_size", F.least(F.col("weight") * F.col("level"), F.col("most")).alias("target"))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs without its text, with size, key, bucket, a hash to order repeated doc_ids by, and a salt."""
    rows = docs.withColumns({"size": _size(text), "chars": F.coalesce(F.length(text), F.lit(0)), "tie": F.xxhash64(text)}).withColumn("key", _key())
    # 1 - exp(-key) is even in (0, 1) for weight 1, and keeps the order of the keys.
    rows = rows.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key", "tie"), F.lit(SALTS)).cast("int")).drop("chars", text)


def _goals(rows: DataFrame) -> DataFrame:
    """Per source (as `of`): its size, target, epochs, rest, and the bucket in which the rest ends."""
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = buckets.withColumn("filled", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    ends = ends.join(goals.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).where("filled <= rest and filled + bucket_size > rest")
    ends = ends.groupBy("s").agg(F.min(F.struct("bucket", "filled")).alias("end"))
    return goals.join(ends, goals["source"].eqNullSafe(ends["s"]), "left").select(goals["source"].alias("of"), "source_size", "target", "epochs", "rest", F.col("end.bucket").alias("end_bucket"), F.col("end.filled").alias("filled"))


def _taken(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Rows of _keyed() with their source's goal and copies."""
    goals = written(goals, "mixing-goals")
    if (goals.agg(F.sum(F.coalesce(F.octet_length("of"), F.lit(0)) + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(goals), rows["source"].eqNullSafe(goals["of"]))
    else:  # each goal meets its rows in SALTS parts
        salted = goals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(salted, rows["source"].eqNullSafe(salted["of"]) & (rows["salt"] == salted["part"]))
    full = F.col("bucket") < F.coalesce(F.col("end_bucket"), F.lit(BUCKETS))
    outside = rows.where("end_bucket is null or bucket != end_bucket").withColumn("copies", F.col("epochs") + F.when((F.col("rest") > 0) & full, 1).otherwise(0))
    running = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where("bucket = end_bucket").withColumn("run", F.col("filled") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    inside = inside.withColumn("copies", F.col("epochs") + F.when(F.col("run") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).drop("run")
    return outside.unionByName(inside)


def plan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row. Only sizes and keys move, not texts."""
    rows = written(_keyed(docs.select("doc_id", "source", text), text), "mixing")
    return _taken(rows, _goals(rows)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def resampled(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as mixed: each row as often as it is taken, with its own columns; rows without words are not taken."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    goals = _goals(written(_keyed(docs.select("doc_id", "source", text), text), "mixing"))
    mixed = _taken(_keyed(docs.select("doc_id", "source", text, own), text), goals)
    return mixed.where("copies > 0 and size > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: plan() in DuckDB's SQL, over `documents`.
PLAN_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, coalesce(length(text), 0) AS chars, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE)
    / (0.5 + 0.5 * least(greatest(chars / greatest(size, 1), 0.5) / {USUAL_WORD}, {USUAL_WORD} / greatest(chars / greatest(size, 1), 0.5))) AS key FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM keyed GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum({MOST}.0::DOUBLE * source_size) OVER (ORDER BY {MOST} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY {MOST} * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources),
level AS (SELECT max(level) AS l FROM levels WHERE level * weight <= {MOST} * source_size),
goals AS (SELECT source, source_size, least(weight * l, {MOST}.0::DOUBLE * source_size) AS target FROM sources, level),
run AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN run + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
