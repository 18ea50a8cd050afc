"""Interpolated modified Kneser-Ney model of any order from 2, counted in Spark, stored as sorted arrays, memory-mapped to score.

1. Words of the training texts are counted; (hash, count) arrays, sorted by hash and cut into ranges of it, are the vocabulary. A word's
   id is its place in it.
2. Each task counts the n-grams of ids it sees; sorted and packed they go to the part of their last but one word (those where it is one of the few
   words with more than a HOT-th of all tokens are spread over parts by their last word). N-grams with the same last two words meet in a part, so it
   has all that is needed for the lower orders: how many words precede a shorter n-gram (one that begins a text keeps its count).
   For each order a part stores the contexts, sorted by key, and the words that follow each with their counts.
3. The parts' sums go to ranges of ids (how many words each word follows) and, for contexts that end in a spread word, to parts by key
   (how often they are followed, by how many words once, twice, more often). Counts of counts give the three discounts of each order.
4. Tasks map the arrays into memory, look up every token of every text and add up log10 of its probability, from the lowest order to the highest
   whose context was seen.

Everything is counted over all training documents; the driver sees one row for each part. The arrays are plain files in the shared
folder, written under another name and renamed, so tasks may run twice. Memory mapping needs that folder mounted (file:).

Texts are lower-cased (A-Z), tokens are `[^\\x20\\x09-\\x0D]+` and one end; each text begins in a context of its own.
Null texts are empty. Training documents are those with crc32(doc_id as text) mod 7 != 2 (null doc_id: empty text). A word unknown in training
gets the share that the lower level leaves over for one more word. With no training documents every token has probability 1.
Rows are scored one by one: repeats agree, and count again in training.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, parts
from .textblocks import Block, blocks, mix

FOLDS, HELD_OUT, HOT = 7, 2, 64
#: N-grams a task keeps before it sends them on.
TASK_GRAMS = 3_000_000
#: Bytes of texts for each part of the arrays (at least as many parts as shuffle partitions).
PART_BYTES = 64 << 20
#: Contexts with more words behind them have their sums stored. Counts from MANY on are kept apart, so that one byte holds the others.
LONG, MANY = 16, 255
_END, _BEGIN = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)


def held_out(doc_ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % FOLDS == HELD_OUT for x in doc_ids.to_pylist()], bool)


def _tokens(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, each text's words and its end; the text of each."""
    at = b.word_at[1:] + np.arange(b.n)
    out = np.full(len(b.starts) + b.n, _END, np.uint64)
    words = np.ones(len(out), bool)
    words[at] = False
    out[words] = b.word_hash()
    doc = np.repeat(np.arange(b.n), b.n_words + 1)
    return out, doc


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, the first one sorted; bytes of the same weight side by side."""
    out, widths = [], []
    for i, x in enumerate(arrays):
        x = np.diff(x.astype(np.uint64), prepend=np.uint64(0)) if i == 0 else _small(x)
        widths.append(x.itemsize)
        out.append(x.view(np.uint8).reshape(len(x), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(len(arrays[0]).to_bytes(8, "little") + bytes(widths) + b"".join(out))


def _unpack(packed: bytes, more: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n, at, out = int(raw[:8].view(np.uint64)[0]), 9 + more, []
    for width in raw[8 : 9 + more].tolist():
        out.append(np.ascontiguousarray(raw[at : at + width * n].reshape(width, n).T).view(f"u{width}").ravel())
        at += width * n
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _small(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _summed(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the columns, sorted, and the sums of the values of each."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = [x[order] for x in columns]
    at = _changes(*columns)
    return [x[at] for x in columns], [np.add.reduceat(x[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for x in values]


def _merge(rows: pa.ChunkedArray, n_keys: int, more: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums by key of packed arrays; a key has n_keys columns."""
    pieces = [_unpack(x, n_keys - 1 + more) for x in rows.to_pylist()]
    columns = [np.concatenate(x) for x in zip(*pieces, strict=True)] if pieces else [np.zeros(0, np.uint64)] * (n_keys + more)
    return _summed(columns[:n_keys], columns[n_keys:])


def gram_key(words: list[np.ndarray]) -> np.ndarray:
    """One number for each row of ids: exact for one or two words, hashes chained from there on."""
    key = words[0].astype(np.uint64)
    for i, w in enumerate(words[1:]):
        key = key << np.uint64(32) | w.astype(np.uint64) if i == 0 else mix(mix(key) + w.astype(np.uint64))
    return key


def history(ids: np.ndarray, b: Block, order: int, begin: int, nothing: int) -> list[np.ndarray]:
    """The ids of each token and the order - 1 before it, farthest first: the begin of its text, and nothing before that."""
    place = np.arange(len(ids)) - np.repeat(b.word_at[:-1] + np.arange(b.n), b.n_words + 1)
    return [np.where(place >= j, np.roll(ids, j), np.where(place == j - 1, begin, nothing)) for j in range(order - 1, 0, -1)] + [ids]


def _save(folder: str, name: str, values: np.ndarray) -> None:
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        np.save(f, values)
    os.replace(temporary, f"{folder}/{name}.npy")


@dataclass
class Model:
    """Where the arrays lie and the sums that the driver has seen."""

    folder: str
    n_parts: int
    order: int = 2
    first_id: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each range of hashes
    total: int = 0  # training tokens
    n_docs: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pairs: int = 0  # distinct
    discounts: list[np.ndarray] = field(default_factory=list)  # of each order from 1
    left_over: float = 1.0  # of the lower level

    def __post_init__(self):
        self._maps: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def array(self, name: str) -> np.ndarray:
        if name not in self._maps:
            self._maps[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self._maps[name]

    @property
    def size(self) -> int:
        """Distinct training tokens; the begin of texts is in the arrays, but no token."""
        return max(int(self.first_id[-1]) - 1, 0) if self.n_docs else 0

    def range_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.n_parts) >> np.uint64(32)).astype(np.int64)

    def part_of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The part of n-grams by their last two words."""
        spread = np.isin(u, self.hot)
        return (mix(u.astype(np.uint64) + np.where(spread, v.astype(np.uint64) << np.uint64(32), np.uint64(0))) % np.uint64(self.n_parts)).astype(np.int64)

    def id_range(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_id, ids, "right") - 1

    def _by_part(self, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.n_parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            yield int(p), order[cuts[p] : cuts[p + 1]]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, or -1, and training count) of each hash."""
        distinct, at = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1), np.zeros(len(distinct), np.int64)
        for p, own in self._by_part(self.range_of(distinct)) if self.n_docs else ():
            words = self.array(f"words-{p}")
            if len(words):
                place = np.minimum(np.searchsorted(words, distinct[own]), len(words) - 1)
                hit = words[place] == distinct[own]
                ids[own[hit]] = self.first_id[p] + place[hit]
                counts[own[hit]] = self.array(f"counts-{p}")[place[hit]]
        return ids[at], counts[at]

    def follows(self, ids: np.ndarray) -> np.ndarray:
        """How many words each word follows."""
        distinct, at = np.unique(ids, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        known = np.flatnonzero(distinct >= 0)
        for p, own in self._by_part(self.id_range(distinct[known])):
            out[known[own]] = self.array(f"follows-{p}")[distinct[known[own]] - self.first_id[p]]
        return out[at]

    def _times(self, name: str, places: np.ndarray) -> np.ndarray:
        out = self.array(f"times-{name}")[places].astype(np.int64)
        many = np.flatnonzero(out == MANY)
        if len(many):
            out[many] = self.array(f"many-times-{name}")[np.searchsorted(self.array(f"many-{name}"), places[many])]
        return out

    def _sums(self, name: str, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of contexts at these places of a part, from the words behind them."""
        out = np.zeros((len(place), 4), np.int64)
        long = hi - lo > LONG
        out[long] = self.array(f"long-sums-{name}")[np.searchsorted(self.array(f"long-{name}"), place[long])]
        short = np.flatnonzero(~long)
        n = (hi - lo)[short]
        times = self._times(name, np.repeat(lo[short] - np.cumsum(n) + n, n) + np.arange(n.sum()))
        own = np.repeat(np.arange(len(short)), n)
        out[short] = np.column_stack([np.bincount(own, weights=x, minlength=len(short)) for x in (times, times == 1, times == 2, times > 2)])
        return out

    def lookup(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of n-grams of known words, and rows of their contexts: how often followed, by how many words once, twice, more often."""
        k, v, w = len(words), words[-2], words[-1]
        context = gram_key(words[:-1])
        counts, sums = np.zeros(len(w), np.int64), np.zeros((len(w), 4), np.int64)
        order = np.argsort(context, kind="stable")
        hot = np.isin(v, self.hot)
        for p, own in self._by_part(self.part_of(v[order], w[order])):
            own, name = order[own], f"{k}-{p}"
            keys = self.array(f"contexts-{name}")
            if not len(keys):
                continue
            place = np.minimum(np.searchsorted(keys, context[own]), len(keys) - 1)
            hit = keys[place] == context[own]
            own, place = own[hit], place[hit]
            starts, behind = self.array(f"starts-{name}"), self.array(f"behind-{name}")
            lo, end = starts[place].astype(np.int64), starts[place + 1].astype(np.int64)
            cold = ~hot[own]
            sums[own[cold]] = self._sums(name, place[cold], lo[cold], end[cold])
            hi, open_ = end.copy(), np.arange(len(own))
            while len(open_):
                middle = (lo[open_] + hi[open_]) // 2
                less = behind[middle] < w[own[open_]]
                lo[open_[less]], hi[open_[~less]] = middle[less] + 1, middle[~less]
                open_ = open_[lo[open_] < hi[open_]]
            found = np.flatnonzero(lo < end)
            found = found[behind[lo[found]] == w[own[found]]]
            counts[own[found]] = self._times(name, lo[found])
        order = order[hot[order]]
        for p, own in self._by_part(self.key_part(context[order])):
            own, keys = order[own], self.array(f"hot-{k}-{p}")
            if len(keys):
                place = np.minimum(np.searchsorted(keys, context[own]), len(keys) - 1)
                hit = keys[place] == context[own]
                sums[own[hit]] = self.array(f"hot-sums-{k}-{p}")[place[hit]]
        return counts, sums

    def key_part(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) % np.uint64(self.n_parts)).astype(np.int64)

    def log10_probability(self, words: list[np.ndarray]) -> np.ndarray:
        """Of each last word behind the order - 1 before it; -1: unknown, or before the begin of a text."""
        if not self.n_docs:
            return np.zeros(len(words[-1]))
        discount = lambda c, d: np.where(c > 0, d[np.clip(c, 1, 3) - 1], 0.0)
        follows = self.follows(words[-1])
        out = (follows - discount(follows, self.discounts[0])) / self.pairs + self.left_over / (self.size + 1)
        seen = np.arange(len(out))  # a context is seen only if the shorter one is
        for k in range(2, self.order + 1):
            seen = seen[words[-k][seen] >= 0]
            own = [x[seen] for x in words[-k:]]
            c, sums = self.lookup(own)
            n, d = sums[:, 0], self.discounts[k - 1]
            known = n > 0
            seen, c, n, sums = seen[known], c[known], n[known], sums[known]
            out[seen] = (c - discount(c, d)) / n + sums[:, 1:] @ d / n * out[seen]
        return np.log10(out)


def discounts(n: np.ndarray) -> np.ndarray:
    """Of items counted once, twice, more often, from how many items have the counts 1 to 4; each below its count."""
    n = n.astype(float)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.clip(d, 0.05, [0.95, 1.95, 2.95])


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        texts = batch.column(1).filter(pa.array(~held_out(batch.column(0)), pa.bool_()))
        for _, _, b in blocks(texts, lower=True):
            yield b


def _local_folder(path: str) -> str:
    if ":" in path.split("/")[0] and not path.startswith("file:"):
        raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {path}")
    return "/" + path.removeprefix("file:").lstrip("/")


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    if order < 2:
        raise ValueError(f"the order must be 2 at least, not {order}")
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    model = Model(_local_folder(new_path(spark, "ngrams")), max(16, parts(spark), -(-n_bytes // PART_BYTES)), order)
    os.makedirs(model.folder)
    rows = docs.select("doc_id", text)
    out_pair = pa.schema([("part", pa.int32()), ("packed", pa.binary())])

    def emit(parted: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
        found = list(parted)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], schema=out_pair)

    def count_all(batches: Iterator[pa.RecordBatch], of_block, part_of) -> Iterator[pa.RecordBatch]:
        """Counts of keys over a task's training texts, by part, sent on when there are many."""
        def sent(k: list[np.ndarray], c: np.ndarray) -> pa.RecordBatch:
            return emit((p, _pack(*(x[at] for x in k), c[at])) for p, at in model._by_part(part_of(k[0])))

        def together(kept: list) -> tuple[list[np.ndarray], np.ndarray]:
            keys, (counts,) = _summed([np.concatenate(x) for x in zip(*(k for k, _ in kept), strict=True)], [np.concatenate([c for _, c in kept])])
            return keys, counts

        kept, size = [], 0
        for b in _training(batches):
            columns = of_block(b)
            k, (c,) = _summed(columns, [np.ones(len(columns[0]), np.uint32)])
            kept.append((k, _small(c)))
            size += len(c)
            if size > TASK_GRAMS:
                kept = [together(kept)]
                size = len(kept[0][1])
                if size > TASK_GRAMS // 2:
                    yield sent(*kept[0])
                    kept, size = [], 0
        if kept:
            yield sent(*together(kept))

    # 1. the vocabulary
    def words(b: Block) -> list[np.ndarray]:
        return [np.concatenate([_tokens(b)[0], np.full(b.n, _BEGIN, np.uint64)])]

    def store_words(rows: pa.Table) -> pa.Table:
        p = rows.column("part")[0].as_py()
        (keys,), (counts,) = _merge(rows.column("packed"), 1, 1)
        _save(model.folder, f"words-{p}", keys), _save(model.folder, f"counts-{p}", _small(counts))
        n_docs = int(counts[keys == _BEGIN].sum())
        top = np.argsort(-counts, kind="stable")[:HOT]
        return pa.table({"part": pa.array([p], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum()) - n_docs], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "top": pa.array([top.tolist()], pa.list_(pa.int64())), "top_n": pa.array([counts[top].tolist()], pa.list_(pa.int64()))})

    found = rows.mapInArrow(lambda it: count_all(it, words, lambda k: model.range_of(k)), "part int, packed binary").groupBy("part").applyInArrow(store_words, "part int, n long, total long, n_docs long, top array<long>, top_n array<long>").collect()
    if not found:
        return model
    sizes = np.zeros(model.n_parts, np.int64)
    for r in found:
        sizes[r["part"]] = r["n"]
    for p in np.flatnonzero(sizes == 0):
        _save(model.folder, f"words-{p}", np.empty(0, np.uint64)), _save(model.folder, f"counts-{p}", np.empty(0, np.uint32))
    model.first_id = np.concatenate([[0], np.cumsum(sizes)])
    if model.first_id[-1] + 1 >= 1 << 32:
        raise ValueError(f"ids have 32 bits, which {model.first_id[-1]} distinct words exceed")
    model.total, model.n_docs = sum(r["total"] for r in found), sum(r["n_docs"] for r in found)
    model.hot = np.array([model.first_id[r["part"]] + i for r in found for i, n in zip(r["top"], r["top_n"], strict=True) if n * HOT > model.total], np.int64)

    # 2. the n-grams, their last two words as one number, then the words before them, nearest first
    nothing = int(model.first_id[-1])

    def split(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def grams(b: Block) -> list[np.ndarray]:
        ids = model.ids(np.append(_tokens(b)[0], _BEGIN))[0]
        *before, u, v = history(ids[:-1], b, order, ids[-1], nothing)
        return [gram_key([u, v]), *(x.astype(np.uint32) for x in before[::-1])]

    def store_level(name: str, context: np.ndarray, last: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Store contexts and what follows; context keys, their sums, and whether they are whole, not spread."""
        rank = np.lexsort((w, context))
        context, w, counts, last = context[rank], w[rank], counts[rank], last[rank]
        at = _changes(context)
        sums = np.column_stack([np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for x in (counts, counts == 1, counts == 2, counts > 2)])
        starts, whole = np.append(at, len(w)), ~np.isin(last[at], model.hot)
        long, many = np.flatnonzero(np.diff(starts) > LONG), np.flatnonzero(counts >= MANY)
        for what, values in (("contexts", context[at]), ("starts", _small(starts)), ("behind", w.astype(np.uint32)), ("times", np.minimum(counts, MANY).astype(np.uint8)), ("many", many), ("many-times", counts[many]), ("long", long), ("long-sums", sums[long])):
            _save(model.folder, f"{what}-{name}", values)
        return context[at], sums, whole

    def store_grams(rows: pa.Table) -> pa.Table:
        p = rows.column("part")[0].as_py()
        columns, (counts,) = _merge(rows.column("packed"), order - 1, 1)
        sent, seen = [], []
        for k in range(order, 1, -1):
            u, v = split(columns[0])
            parts_ = [*columns[:0:-1], u, v]  # as they stand in the text
            real = parts_[0] != nothing if k > 2 else np.ones(len(v), bool)
            own = [x[real] for x in parts_]
            context, sums, whole = store_level(f"{k}-{p}", gram_key(own[:-1]), own[-2], own[-1], counts[real])
            spread, spread_sums = context[~whole], sums[~whole]
            sent += [(k, q, _pack(spread[at], *spread_sums[at].T)) for q, at in model._by_part(model.key_part(spread))]
            seen += np.bincount(np.minimum(counts[real], 5), minlength=6)[1:5].tolist()
            # each n-gram is one word before the shorter one; what begins a text keeps its count
            once = np.where(real, 1, counts)
            if k > 2:
                columns = columns[:-1]
                at = _changes(*columns)
                columns, counts = [x[at] for x in columns], np.add.reduceat(once, at)
        ids, n = np.unique(split(columns[0])[1], return_counts=True)
        sent += [(1, q, _pack(ids[at], n[at])) for q, at in model._by_part(model.id_range(ids))]
        m = len(sent)
        return pa.table({"level": pa.array([k for k, _, _ in sent], pa.int32()), "part": pa.array([q for _, q, _ in sent], pa.int32()), "packed": pa.array([x for _, _, x in sent], pa.binary()), "own": pa.array([p] * m, pa.int32()), "n": pa.array([len(columns[0])] * m, pa.int64()), "counts": pa.array([seen] * m, pa.list_(pa.int64()))})

    # 3. sums by word, and by context where spread
    def store_sums(rows: pa.Table) -> pa.Table:
        q, levels = rows.column("part")[0].as_py(), np.array(rows.column("level"))
        of_level = lambda k: rows.column("packed").filter(pa.array(levels == k))
        for k in range(2, order + 1):
            (keys,), sums = _merge(of_level(k), 1, 4)
            _save(model.folder, f"hot-{k}-{q}", keys), _save(model.folder, f"hot-sums-{k}-{q}", _small(np.column_stack(sums)))
        (ids,), (n,) = _merge(of_level(1), 1, 1)
        dense = np.zeros(int(model.first_id[q + 1] - model.first_id[q]), np.int64)
        dense[ids.astype(np.int64) - model.first_id[q]] = n
        _save(model.folder, f"follows-{q}", _small(dense))
        own = {r["own"]: (r["n"], r["counts"]) for r in rows.select(["own", "n", "counts"]).to_pylist()}
        follows = np.bincount(np.minimum(dense, 5), minlength=6)[1:6].tolist()
        return pa.table({"part": pa.array([q], pa.int32()), "follows": pa.array([follows], pa.list_(pa.int64())), "own": pa.array([list(own)], pa.list_(pa.int32())), "n": pa.array([[n for n, _ in own.values()]], pa.list_(pa.int64())), "counts": pa.array([[c for _, cs in own.values() for c in cs]], pa.list_(pa.int64()))})

    stored = rows.mapInArrow(lambda it: count_all(it, grams, lambda k: model.part_of(*split(k))), "part int, packed binary").groupBy("part").applyInArrow(store_grams, "level int, part int, packed binary, own int, n long, counts array<long>")
    found = stored.groupBy("part").applyInArrow(store_sums, "part int, follows array<long>, own array<int>, n array<long>, counts array<long>").collect()
    m = 4 * (order - 1)
    seen = {p: (n, r["counts"][m * i : m * i + m]) for r in found for i, (p, n) in enumerate(zip(r["own"], r["n"], strict=True))}
    for p in set(range(model.n_parts)) - set(seen):
        for k in range(2, order + 1):
            _save(model.folder, f"contexts-{k}-{p}", np.empty(0, np.uint64))
    for q in set(range(model.n_parts)) - {r["part"] for r in found}:
        for k in range(2, order + 1):
            _save(model.folder, f"hot-{k}-{q}", np.empty(0, np.uint64))
    model.pairs = sum(n for n, _ in seen.values())
    follows = np.sum([r["follows"] for r in found], axis=0)
    levels = np.sum([c for _, c in seen.values()], axis=0).reshape(order - 1, 4)[::-1]
    model.discounts = [discounts(n) for n in (follows[:4], *levels)]
    model.left_over = float(model.discounts[0] @ np.array([follows[0], follows[1], follows[2:].sum()]) / model.pairs)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = held_out(batch.column(0))
            for lo, hi, b in blocks(batch.column(1), lower=True):
                hashes, doc = _tokens(b)
                ids, counts = model.ids(np.append(hashes, _BEGIN))
                words = history(ids[:-1], b, model.order, ids[-1], -1)
                counts = counts[:-1]
                add = lambda x: np.bincount(doc, weights=x, minlength=b.n)
                base = add(np.log10((counts + 1) / (model.total + model.size + 1)))
                out = [batch.column(0).slice(lo, hi - lo), pa.array(held[lo:hi]), pa.array(add(np.ones(len(doc))).astype(np.int64)), pa.array(add(counts > 0).astype(np.int64)), pa.array(np.full(b.n, model.total)), pa.array(base), pa.array(add(model.log10_probability(words)))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def run(docs: DataFrame, order: int = 2) -> DataFrame:
    return score(docs, train(docs, order=order))
