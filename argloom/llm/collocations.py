"""Collocations: the best phrases of each language, found by growing the phrases that may still be among them.

A phrase is contiguous words of a piece of text. With a its count, l and r the counts of what a cut leaves on either side, and n the words of the language, a cut
scores floor(1000 * a * n / (l * r)), and a phrase as its lowest cut. r >= a, so whatever begins with words counted c times scores at most
floor(1000 * n / c): the count of the first word bounds all that grows from it, the count of each prefix its own cut.

1. Words are counted; those that are frequent are kept. Texts are stored as hashes of frequent words, 0 where a piece ends or another word stands.
2. The frontier begins with the rarest words, whose bounds are highest. A step counts, in one pass over the stored texts, one-word
   extensions of the frontier and the phrases that open scores lack. Extensions that are frequent join the frontier; more common words
   join it in later steps, as far as their bound still matters. Where words join, a pass before it adds extensions up in a table of
   small counters, by hash: those whose counter stays below the least count can't be frequent and are left out.
3. A phrase whose occurrences all have the same word before them, or behind, is part of a longer one with the same count: it is dropped.
   For others the cuts give a score, or a bound where a count is missing (it is a at least). The 2000th settled score of a language closes
   all of the frontier below it; what reaches it, ties included, stays open until it is settled.

Counts are exact sums over all texts. The frontier reaches tasks as a bit table of at most 2**MOST_BITS bits: it never misses, and what it lets through
by mistake is counted and does no harm. Words and phrases are told by 64-bit hashes. Nothing but bit tables goes through the driver.

The session's Arrow batches shrink to `shared.BATCH_ROWS` rows. Null texts are empty; null languages are `und`. Repeated rows count again. Empty tables give no rows. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, written
from .textblocks import Block, blocks, chain, mix

LEAST, LONGEST, TOP = 100, 5, 2000
#: Shares of a language's words (the rarest first) that join the frontier together.
SHARES = (0.125, 0.5, 1.0)
#: Bits of a table for each phrase in it, and the most of all (32 MB).
KEY_BITS, MOST_BITS = 16, 28
#: Words (and their bytes) and phrases that a task keeps before it sends them on; hashes in a stored row.
TASK_WORDS, TASK_BYTES, TASK_PHRASES, ROW_WORDS = 120_000, 8 << 20, 800_000, 1 << 11
#: Occurrences for each counter, bits of the largest table of them, and counters that are added up in one group.
PER_COUNTER, COUNTER_BITS, CHUNK = 8, 24, 1 << 10
#: Tasks that look for the best of a language before they meet.
SALTS = 64

_GAP, _END = (0x20, 0x09), (*b".,;:!?", *range(0x0A, 0x0E))
BREAKS, PIECE_END = np.zeros(256, bool), np.zeros(256, bool)
PIECE_END[list(_END)] = True
BREAKS[[*_GAP, *_END]] = True
_W = [f"w{i}" for i in range(1, LONGEST + 1)]
_PHRASE = ", ".join(f"{w} long" for w in _W)


def _languages(column: pa.Array) -> np.ndarray:
    """A number for each language, from its name."""
    names = pc.fill_null(column.cast(pa.string()), "und").dictionary_encode()
    known = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.dictionary.to_pylist()]
    return np.array(known, np.uint64)[names.indices.to_numpy()] if len(column) else np.zeros(0, np.uint64)


def _hashes(b: Block, languages: np.ndarray) -> np.ndarray:
    """A hash of each word and its language, never 0."""
    return np.maximum(mix(b.word_hash() ^ languages[b.doc]), np.uint64(1))


def _vocabulary(rows: DataFrame) -> DataFrame:
    """lang, word, h, f of all words; a row without a word for each language holds the count of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        held = 0

        def sent() -> pa.RecordBatch:
            columns = zip(*found.values(), strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "word", "h", "f"])
            found.clear()
            return out

        for batch in batches:
            names, languages = pc.fill_null(batch.column(0).cast(pa.string()), "und").to_pylist(), _languages(batch.column(0))
            for lo, _, b in blocks(batch.column(1), BREAKS, lower=True):
                h = _hashes(b, languages[lo : lo + b.n])
                distinct, first, n = np.unique(h, return_index=True, return_counts=True)
                doc = b.doc[first]
                for x, i, d, c in zip(distinct.view(np.int64).tolist(), first.tolist(), doc.tolist(), n.tolist(), strict=True):
                    if x in found:
                        found[x][3] += c
                    else:
                        found[x] = [names[lo + d], b.word(i), x, c]
                        held += len(found[x][1])
                for d in np.flatnonzero(b.n_words).tolist():
                    key = ("all", names[lo + d])
                    found.setdefault(key, [names[lo + d], None, None, 0])[3] += int(b.n_words[d])
                if len(found) > TASK_WORDS or held > TASK_BYTES:
                    yield sent()
                    held = 0
        if found:
            yield sent()

    return rows.mapInArrow(count, "lang string, word string, h long, f long").groupBy("lang", "word").agg(F.max("h").alias("h"), F.sum("f").alias("f"))


class Bits:
    """Which keys may be in a set: one bit for the low bits of each."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(8 * len(table) - 1)

    @classmethod
    def of(cls, keys: DataFrame, key: str = "key") -> Bits:
        n = keys.count()
        size = 1 << min(max(KEY_BITS * n, 1 << 15).bit_length(), MOST_BITS)
        place = F.col(key).bitwiseAND(F.lit(size - 1)) + 1
        found = keys.select(place.alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits")) if n else None
        table = np.zeros(size // 8, np.uint8)
        for r in found.collect() if n else ():  # size / 2**15 rows of 4 KB
            table[(r["b"] - 1) << 12 : r["b"] << 12] = np.frombuffer(r["bits"], np.uint8)
        return cls(table)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.uint64) & self.mask
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _stored(rows: DataFrame, frequent: Broadcast) -> DataFrame:
    """words: hashes of words that may be frequent, 0 between pieces and for other words, some ROW_WORDS to a row."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = _languages(batch.column(0))
            for lo, _, b in blocks(batch.column(1), BREAKS, lower=True):
                if not len(b.starts):
                    continue
                h = _hashes(b, languages[lo : lo + b.n])
                h[~frequent.value.has(h)] = 0
                ended = np.concatenate([[0], np.cumsum(PIECE_END[b.data])])[b.starts]
                new = np.flatnonzero((np.diff(ended) != 0) | (np.diff(b.doc) != 0)) + 1
                h = np.append(np.insert(h, new, 0), np.uint64(0))
                h = h[(h != 0) | np.concatenate([[False], h[:-1] != 0])]  # one 0 where there are many
                zeros = np.flatnonzero(h == 0) + 1
                cuts = np.unique(zeros[np.searchsorted(zeros, np.arange(ROW_WORDS, len(h) + ROW_WORDS, ROW_WORDS).clip(max=len(h)))]) if len(zeros) else zeros
                offsets = np.concatenate([[0], cuts]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], names=["words"])

    return rows.mapInArrow(code, "words array<long>")


def _keys(words: np.ndarray, m: int) -> np.ndarray:
    """The key of each m consecutive words; a word's is its hash."""
    return words[: len(words) - m + 1] if m == 1 else chain(words, m)


def _same(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value that all of a group have, or 0."""
    values = values[order]
    least = np.minimum.reduceat(values, starts)
    return np.where(least == np.maximum.reduceat(values, starts), least, 0)


def _summed(key: np.ndarray, words: np.ndarray, n: np.ndarray, before: np.ndarray, behind: np.ndarray) -> tuple:
    """One row for each key."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    if not len(starts):
        return key, words, n, before, behind
    return key[order][starts], words[order[starts]], np.add.reduceat(n[order], starts, dtype=n.dtype), _same(before, order, starts), _same(behind, order, starts)


def _extensions(x: np.ndarray, frontier: Bits) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(m, keys of m words, which lie within a piece, which extend the frontier by a word) for each m."""
    grows, zero = np.zeros(len(x), bool), np.concatenate([[0], np.cumsum(x == 0)])
    for m in range(1, min(LONGEST, len(x)) + 1):
        sound = zero[m:] == zero[: len(zero) - m]
        key = _keys(x, m)
        yield m, key, sound, sound & grows[: len(key)]
        grows = sound & frontier.has(key)


def _flat(batch: pa.RecordBatch, rows: int = 128) -> Iterator[np.ndarray]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.column(0).slice(lo, rows).flatten().to_numpy().view(np.uint64)


def _busy(stored: DataFrame, frontier: Broadcast, occurrences: int, least: int) -> Bits:
    """Which extensions of the frontier may be frequent: those whose counter, shared with others of the same hash, reaches the least count."""
    bits = min(max(occurrences // PER_COUNTER, 1 << 16).bit_length(), COUNTER_BITS)
    kind = np.min_scalar_type(least)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = np.zeros(1 << bits, kind), np.uint64((1 << bits) - 1)
        for batch in batches:
            for x in _flat(batch):
                at = np.concatenate([(key[grown] & mask).astype(np.int64) for _, key, _, grown in _extensions(x, frontier.value)] or [np.zeros(0, np.int64)])
                at, n = np.unique(at, return_counts=True)
                table[at] = np.minimum(table[at].astype(np.int64) + n, least)  # enough is enough
        used = np.flatnonzero(table.reshape(-1, CHUNK).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([table[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in used.tolist()], pa.binary())], names=["chunk", "counters"])

    def together(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in group.column(1).to_pylist():
            total += np.frombuffer(x, kind)
        return pa.table({"chunk": group.column(0).slice(0, 1), "bits": [np.packbits(total >= least, bitorder="little").tobytes()]})

    table = np.zeros((1 << bits) // 8, np.uint8)
    summed = stored.mapInArrow(add, "chunk int, counters binary").groupBy("chunk").applyInArrow(together, "chunk int, bits binary")
    for r in summed.collect():  # 2**COUNTER_BITS bits at most
        table[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return Bits(table)


def _counted(stored: DataFrame, frontier: Broadcast, busy: Broadcast, lacking: Broadcast) -> DataFrame:
    """w1 .. w5 (0 behind the last), f, before, behind of the frontier's extensions and the lacking phrases that may be frequent; before and behind are 0 if
    occurrences differ in that word, or one has none."""

    def phrases(x: np.ndarray) -> Iterator[tuple[int, tuple]]:
        for m, key, sound, grown in _extensions(x, frontier.value):
            at = np.flatnonzero(grown & busy.value.has(key) | sound & lacking.value.has(key)) if m > 1 else ()
            if len(at):
                words = np.column_stack([x[at + i] for i in range(m)])
                before = np.where(at > 0, x[at - 1], 0).astype(np.uint64)
                behind = np.where(at + m < len(x), x[np.minimum(at + m, len(x) - 1)], 0).astype(np.uint64)
                yield m, _summed(key[at], words, np.ones(len(at), np.int32), before, behind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}  # by the number of words
        rows = lambda: sum(len(x[0]) for own in kept.values() for x in own)

        def merge() -> None:
            for m, own in kept.items():
                if len(own) > 1:
                    kept[m] = [_summed(*(np.concatenate(x) for x in zip(*own, strict=True)))]

        def sent() -> Iterator[pa.RecordBatch]:
            for m in sorted(kept):
                ((_, words, n, before, behind),) = kept.pop(m)
                for lo in range(0, len(n), 50_000):
                    part = slice(lo, lo + 50_000)
                    columns = [words[part, i] if i < m else np.zeros(len(n[part]), np.uint64) for i in range(LONGEST)]
                    columns = [np.ascontiguousarray(x).view(np.int64) for x in (*columns, before[part], behind[part])]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:LONGEST]), pa.array(n[part].astype(np.int64)), *map(pa.array, columns[LONGEST:])], names=[*_W, "n", "before", "behind"])

        size = 0
        for batch in batches:
            for x in _flat(batch):
                for m, found in phrases(x):
                    kept.setdefault(m, []).append(found)
                    size += len(found[0])
                if size > TASK_PHRASES:
                    merge()
                    size = rows()
                    if size > TASK_PHRASES * 3 // 4:
                        yield from sent()
                        size = 0
        merge()
        yield from sent()

    rows = stored.mapInArrow(count, f"{_PHRASE}, n long, before long, behind long")
    same = lambda c: F.when(F.min(c) == F.max(c), F.max(c)).otherwise(0).alias(c)
    return rows.groupBy(*_W).agg(F.sum("n").alias("f"), same("before"), same("behind"))


def _with_keys(phrases: DataFrame) -> DataFrame:
    """The phrases with m, key, and the keys of what cuts leave: left, right (null behind the last cut)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.column_stack([batch.column(i).to_numpy() for i in range(LONGEST)]).view(np.uint64)
            m = (words != 0).sum(1)
            of = np.zeros((LONGEST, LONGEST + 1, len(words)), np.uint64)  # from, to
            for k in range(1, LONGEST + 1):
                for i in range(LONGEST - k + 1):
                    of[i, i + k] = words[:, i] if k == 1 else _chained(words[:, i : i + k])
            row = np.arange(len(words))
            cut = np.arange(1, LONGEST)[:, None] < m
            lists = []
            for sides in ([of[0, k] for k in range(1, LONGEST)], [of[k, m, row] for k in range(1, LONGEST)]):
                flat = np.column_stack(sides)[cut.T] if len(words) else np.zeros(0, np.uint64)
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cut.sum(0))]).astype(np.int32)), pa.array(flat.view(np.int64))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.astype(np.int32)), pa.array(of[0, m, row].view(np.int64)), *lists], names=[*batch.schema.names, "m", "key", "left", "right"])

    return phrases.mapInArrow(keys, f"{_PHRASE}, f long, before long, behind long, m int, key long, `left` array<long>, `right` array<long>")


def _chained(words: np.ndarray) -> np.ndarray:
    """The key of each row of words, as chain() has it."""
    k = words.shape[1]
    flat = chain(np.ascontiguousarray(words).ravel(), k)
    return flat[::k] if len(words) else np.zeros(0, np.uint64)


def _score(a: Column | str, n: Column | str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (l * r)) in exact decimals."""
    big = lambda c: f"cast({c} as decimal(16, 0))"
    return F.expr(f"cast((cast(1000 as decimal(5, 0)) * {big(a)} * {big(n)}) div ({big(left)} * {big(right)}) as bigint)")


def _first(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """The first rows of each language by the order, with rank; no task sees more of them than `top` of each other one."""
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))).where(F.col("rank") <= top)
    return ranked(ranked(rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))), "salt").drop("rank", "salt"))


def _bars(settled: DataFrame, top: int) -> DataFrame:
    """b_lang, bar: the top-th settled score of each language that has so many."""
    best = _first(settled.select("lang", "key", "score"), top, F.col("score").desc(), F.col("key"))
    return best.groupBy(F.col("lang").alias("b_lang")).agg(F.min("score").alias("bar"), F.count("*").alias("c")).where(F.col("c") == top).drop("c")


def _reach(rows: DataFrame, bars: DataFrame, score: str) -> DataFrame:
    """The rows whose score, or bound of it, reaches the bar of their language."""
    return rows.join(bars, F.col("lang") == F.col("b_lang"), "left").where(f"bar is null or {score} >= bar").drop("b_lang", "bar")


def _cuts(open_: DataFrame, counts: DataFrame) -> DataFrame:
    """The open phrases with score (a bound, if a count is missing), cut, l, r of the lowest cut, and the keys that are missing."""
    cuts = open_.select("key", "f", "n", F.posexplode(F.arrays_zip("left", "right")).alias("k", "x")).select("key", "f", "n", "k", F.col("x.left").alias("lk"), F.col("x.right").alias("rk"))
    known = lambda side: counts.select(F.col("c_key").alias(side), F.col("c_f").alias(side[0]))
    cuts = cuts.join(known("l_key"), F.col("lk") == F.col("l_key"), "left").join(known("r_key"), F.col("rk") == F.col("r_key"), "left")
    cuts = cuts.withColumn("l_or", F.coalesce("l", "f")).withColumn("r_or", F.coalesce("r", "f")).withColumn("score", _score("f", "n", "l_or", "r_or"))
    lowest = F.min(F.struct("score", "k", "l_or", "r_or"))
    lacks = F.flatten(F.collect_list(F.filter(F.array(F.when(F.col("l").isNull(), F.col("lk")), F.when(F.col("r").isNull(), F.col("rk"))), lambda x: x.isNotNull())))  # four cuts at most
    found = cuts.groupBy(F.col("key").alias("c")).agg(lowest.alias("x"), lacks.alias("lacks"))
    return open_.drop("score", "cut", "l", "r", "lacks").join(found, F.col("key") == F.col("c")).select(*[c for c in open_.columns if c not in ("score", "cut", "l", "r", "lacks")], F.col("x.score").alias("score"), (F.col("x.k") + 1).alias("cut"), F.col("x.l_or").alias("l"), F.col("x.r_or").alias("r"), "lacks")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = written(_vocabulary(rows).where(f"word is null or f >= {least}"), "words")
    totals = counted.where("word is null").select(F.col("lang").alias("t_lang"), F.col("f").alias("n"))
    mass = counted.where("word is not null").groupBy("lang", "f").agg((F.count("*") * F.col("f")).alias("mass"))
    share = F.sum("mass").over(Window.partitionBy("lang").orderBy("f"))  # distinct counts of a language, not words
    shares = mass.select(F.col("lang").alias("s_lang"), F.col("f").alias("s_f"), share.alias("upto"))
    words = counted.where("word is not null").join(totals, F.col("lang") == F.col("t_lang")).join(shares, (F.col("lang") == F.col("s_lang")) & (F.col("f") == F.col("s_f")))
    begin = F.when(F.col("upto") <= SHARES[0] * F.col("n"), 0)
    for i, s in enumerate(SHARES[1:-1], 1):
        begin = begin.when(F.col("upto") <= s * F.col("n"), i)
    ones = F.lit(1).cast("long")
    words = written(words.withColumn("one", ones).select("lang", "word", "h", "f", "n", _score("one", "n", "f", "one").alias("bound"), begin.otherwise(len(SHARES) - 1).alias("begin")), "vocabulary")
    send = lambda keys: spark.sparkContext.broadcast(Bits.of(keys))
    stored = written(_stored(rows, send(words.select(F.col("h").alias("key")))), "hashes")

    none = spark.createDataFrame([], "key long")
    counts = words.select(F.col("h").alias("c_key"), F.col("f").alias("c_f"))
    first = words.select(F.col("h").alias("v_h"), "lang", "n", "bound")
    bars = spark.createDataFrame([], "b_lang string, bar long")
    grown = settled = open_ = None
    lacking, step = none, 0
    everything = spark.sparkContext.broadcast(Bits(np.full(8, 0xFF, np.uint8)))
    while True:
        frontier = _reach(words.where(F.col("begin") == step), bars, "bound").select(F.col("h").alias("key"), "f", F.lit(1).alias("m"))
        if grown is not None:
            frontier = frontier.unionByName(_reach(grown.where(F.col("m") < LONGEST), bars, "bound").select("key", "f", "m"))
        frontier = written(frontier, "frontier")
        n, occurrences = frontier.agg(F.count("*"), F.sum(F.when(F.col("m") == 1, F.col("f")))).first()
        if step >= len(SHARES) and not n and lacking.isEmpty():
            break
        sent, step = send(frontier), step + 1
        busy = spark.sparkContext.broadcast(_busy(stored, sent, occurrences, least)) if occurrences else everything
        new = _with_keys(_counted(stored, sent, busy, send(lacking)).where(F.col("f") >= least))
        new = new.join(counts.select(F.col("c_key").alias("old")), F.col("key") == F.col("old"), "left_anti")
        grown = written(new.join(first, F.col("w1") == F.col("v_h")).drop("v_h"), "phrases")
        counts = written(counts.unionByName(grown.select(F.col("key").alias("c_key"), F.col("f").alias("c_f"))), "counts")  # one table, so that plans stay small
        fresh = grown.where(f"m = {LONGEST} or before = 0 and behind = 0").drop("before", "behind").withColumns({"score": F.col("bound"), "cut": F.lit(0), "l": F.lit(0).cast("long"), "r": F.lit(0).cast("long"), "lacks": F.array().cast("array<long>")})
        waiting = fresh if open_ is None else fresh.unionByName(open_)
        judged = written(_cuts(_reach(waiting, bars, "score"), counts), "judged")
        done = judged.where(F.size("lacks") == 0)
        settled = written(_reach(done if settled is None else settled.unionByName(done), bars, "score"), "settled")
        bars = written(_bars(settled, top), "bars")
        open_ = _reach(judged.where(F.size("lacks") > 0), bars, "score")
        lacking = open_.select(F.explode("lacks").alias("key")).distinct()

    best = _reach(settled, bars, "score")
    spelt = best.select("key", F.posexplode(F.filter(F.array(*_W), lambda w: w != 0)).alias("i", "w")).join(words.select("h", "word"), F.col("w") == F.col("h"))
    spelt = spelt.groupBy(F.col("key").alias("p_key")).agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("s"))  # five words at most
    best = best.join(spelt, F.col("key") == F.col("p_key")).withColumn("phrase", F.array_join(F.transform("s", lambda x: x["word"]), " ")).withColumnRenamed("f", "a")
    out = _first(best.select("lang", "key", "phrase", "a", "l", "r", "n", "score"), top, F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]') AS p FROM documents),
q AS (SELECT d, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM d),
t AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x != '') AS w FROM q),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM t GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM t, range(1, 6) AS r(m), unnest(range(1, len(w) - m + 2)) AS s(i)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, m, phrase, a, n, string_split(phrase, ' ') AS w FROM f JOIN n USING (lang) WHERE m > 1),
h AS (SELECT lang, array_to_string(w[1 : m - 1], ' ') AS phrase, a FROM c WHERE m > 2 UNION ALL SELECT lang, array_to_string(w[2 :], ' '), a FROM c WHERE m > 2),
x AS (SELECT c.lang, c.phrase, c.a, c.n, k, l.a AS l, r.a AS r, (1000::HUGEINT * c.a * c.n) // (l.a::HUGEINT * r.a) AS score FROM c, range(1, 5) AS u(k), f l, f r
  WHERE k < c.m AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') AND r.phrase = array_to_string(w[k + 1 :], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM y
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = y.lang AND h.phrase = y.phrase AND h.a >= y.a) QUALIFY rank <= {TOP}"""
