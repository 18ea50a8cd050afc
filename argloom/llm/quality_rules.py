"""Quality rules with an isolation forest over the rules' statistics.

Every text gets its rule statistics in one vectorised pass. A document fails the base rules with
fewer than MIN_WORDS words or more than MAX_REPEAT_PERCENT of its words in repeated windows.
The others are judged by an isolation forest: trees of random splits over ratios of
the statistics; a short mean path means an unusual document. The forest is fitted on at most
SAMPLE documents that pass the base rules (those of least hash). The threshold on its score comes from all
labelled documents: of those that reject at most GOOD_LOSS of the good ones, the one
with the largest difference between the shares of bad and good ones it rejects, the higher of equals.
Without documents labelled as good, only the base rules reject.

Null texts have no words and fail the base rules. Rows are judged one by one: repeats agree.
Null doc_ids are judged too; they take no part in fitting. A doc_id labelled both ways counts as bad.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .textblocks import SPACE, Block, blocks, mix

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SAMPLE, TREES, TREE_ROWS, SEED = 4096, 100, 256, 17
GOOD_LOSS = 0.003
#: Scores are counted in so many bins for calibration.
BINS = 2000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_marks", "n_distinct")
_SYMBOL, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _repeats(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its text, equals an earlier one of its text)."""
    key = mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order[1:][same]] = many[order[:-1][same]] = True
    later[order[1:][same]] = True
    return many, later


def block_statistics(b: Block) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[b.bounds[1:]] - sums[b.bounds[:-1]]

    solid = ~SPACE[b.data]
    out = {"n_words": b.n_words, "word_chars": total(solid & ((b.data & 0xC0) != 0x80))}
    out |= {n: total(lut[b.data]) for n, lut in (("n_symbols", _SYMBOL), ("n_marks", _MARK))}
    cuts = np.unique(np.concatenate([b.bounds, np.flatnonzero(b.data == 10) + 1]))
    starts, ends = cuts[:-1], cuts[1:].copy()
    if len(starts):
        ends -= b.data[ends - 1] == 10
    filled = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    keep = filled[ends] > filled[starts]
    starts, ends = starts[keep], ends[keep]
    doc = np.searchsorted(b.bounds, starts, "right") - 1
    out["n_dup_lines"] = b.per_doc(_repeats(doc, b.spans_hash(starts, ends))[1], doc)
    words = b.word_hash()
    out["n_distinct"] = b.per_doc(~_repeats(b.doc, words)[1], b.doc)
    grams, at = b.grams(words, WINDOW)
    at = at[_repeats(b.doc[at], grams)[0]]
    cover = np.zeros(len(words) + WINDOW + 1, np.int64)
    cover[at] += 1
    cover[at + WINDOW] -= 1
    out["n_repeat_words"] = b.per_doc(np.cumsum(cover)[: len(words)] > 0, b.doc)
    return out


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Mean word length, shares of symbols and of punctuation, and how rich the words are for the length; 0 where nothing counts."""
    ratio = lambda a, b: x[a] / np.maximum(x[b], 1)
    return np.column_stack([ratio("word_chars", "n_words"), ratio("n_symbols", "word_chars"), ratio("n_marks", "word_chars"), ratio("n_distinct", "n_words") * np.log1p(x["n_words"])])


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n, 2) - 1) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees in flat arrays: leaves have feature -1 and their path length as threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    roots: np.ndarray
    rows: int
    cut: float = 2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 is unusual."""
        paths = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.threshold[node]
                node = np.where(inner, self.left[node] + right, node)
            paths += self.threshold[node]
        return 2.0 ** -(paths / len(self.roots) / max(float(_mean_path(self.rows)), 1e-9))


def grow(x: np.ndarray) -> Forest | None:
    """A forest over rows x; none for fewer than two rows."""
    if len(x) < 2:
        return None
    rng = np.random.default_rng(SEED)
    rows = min(TREE_ROWS, len(x))
    limit = int(np.ceil(np.log2(rows)))
    feature, threshold, left, roots = [], [], [], []

    def node() -> int:
        feature.append(-1), threshold.append(0.0), left.append(0)
        return len(feature) - 1

    for _ in range(TREES):
        roots.append(node())
        todo = [(roots[-1], x[rng.choice(len(x), rows, replace=False)], 0)]
        while todo:
            at, own, depth = todo.pop()
            wide = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 and depth < limit else []
            if not len(wide):
                threshold[at] = depth + float(_mean_path(len(own)))
                continue
            f = int(rng.choice(wide))
            lo, hi = own[:, f].min(), own[:, f].max()
            cut = lo + (hi - lo) * rng.uniform(1e-9, 1)
            feature[at], threshold[at], left[at] = f, cut, node()
            node()
            todo += [(left[at], own[own[:, f] < cut], depth + 1), (left[at] + 1, own[own[:, f] >= cut], depth + 1)]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(roots), rows)


_COLUMNS = [T.StructField(n, T.LongType(), False) for n in COUNTS + MORE]
_VERDICT = [T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False), T.StructField("anomaly", T.DoubleType(), False)]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the counts, for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(batch.column(1)):
                x = block_statistics(b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(x[n], pa.int64()) for n in COUNTS + MORE]], names=["doc_id", *COUNTS, *MORE])

    return docs.select("doc_id", text).mapInArrow(run, T.StructType([docs.schema["doc_id"], *_COLUMNS]))


def _verdicts(x: dict[str, np.ndarray], forest: Forest | None) -> list[pa.Array]:
    failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
    score = forest.score(features(x)) if forest else np.zeros(len(failed))
    return [pa.array(failed), pa.array(~failed & (score < (forest.cut if forest else 2.0))), pa.array(score)]


def judge(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Verdicts on rows of statistics()."""
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {n: batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in COUNTS + MORE}
            yield pa.RecordBatch.from_arrays([*batch.columns, *_verdicts(x, forest)], names=[*names, *[f.name for f in _VERDICT]])

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, *_VERDICT]))


def keep(docs: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(batch.column(names.index(text))):
                yield batch.slice(lo, hi - lo).filter(_verdicts(block_statistics(b), forest)[1])

    return docs.mapInArrow(run, docs.schema)


def fit(stats: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest and threshold; what reaches the driver is SAMPLE rows and 2 * BINS counts."""
    passed = stats.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words")))
    usable = passed.where("doc_id is not null")
    # Only about 2 * SAMPLE rows compete for the sample, so that no partition sends all it has; more, where too few have a small hash (rows that repeat
    # have the same one).
    draw, n = F.xxhash64("doc_id", *COUNTS + MORE), usable.count()
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    while True:
        drawn = usable.where(draw <= F.lit(-(1 << 63) + min(int(share * (1 << 64)), (1 << 64) - 1)))
        if share == 1.0 or drawn.count() >= min(SAMPLE, n):
            break
        share = min(1.0, 8 * share)
    sample = drawn.orderBy(draw, "doc_id", *COUNTS + MORE).limit(SAMPLE).select(*COUNTS, *MORE).toPandas()
    forest = grow(features({n: sample[n].to_numpy() for n in COUNTS + MORE}))
    if not forest:
        return None
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    scored = judge(passed.join(known, "doc_id"), forest)
    counts = np.zeros((2, BINS + 1), np.int64)
    for r in scored.groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), (F.col("quality") == 1).cast("int").alias("good")).count().collect():
        counts[r["good"], min(r["bin"], BINS)] += r["count"]
    bad, good = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in counts)  # at or above each bin; none above the last
    if good[0]:
        gain = np.where(good <= GOOD_LOSS * good[0], bad / max(bad[0], 1) - good / good[0], -1)
        forest.cut = float(np.flatnonzero(gain == gain.max())[-1] / BINS)
    return forest


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdicts of every document, the forest's score as anomaly."""
    stats = written(statistics(docs), "quality-statistics")
    return judge(stats, fit(stats, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
