"""Documents concatenated and cut into sequences of WINDOW token ids.

1. Texts are sorted by ranges of (doc_id, hash of the text) and encoded, END behind each; a table keeps the ids of every document, its
   range, and how many ids of its range stand before it.
2. Prefix sums over the ranges' totals (one row for PART_BYTES of texts) give every document its place in the whole, whatever the ranges
   are: the order is that of the documents alone, so that reruns agree.
3. Tasks cut their run of documents at the multiples of WINDOW. A window that lies within a run is a sequence; what a run has of
   its first and last window is a boundary record, and the boundary records of a window (a document may span many) meet by its number.

Only the last sequence is short. It is padded, unless its length is a power of two.

Tokens of a byte-level file never cross the place before a word and the one space in front of it, so each distinct piece between such places is
encoded once per table and its ids joined by position; where the file's merges stand in the order of their ids, a quicker library that merges by
id encodes Latin pieces. Texts with other white space than space and \\t to \\r, or with a
special token, are encoded whole; so are all texts if the file has other rules.

Null texts are empty: only END. Null doc_ids come first. Rows that repeat a doc_id follow each other by a hash of the text; equal rows, by
where they stand, are packed each by itself. An empty table gives no sequences. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, parts
from .textblocks import Block, as_strings, blocks
from .token_shards import _LETTERS

#: Token ids of a sequence, the id behind each document, and the one that fills the last sequence.
WINDOW, END, PAD = 1024, 0, 0
#: Bytes of texts for each range (at least as many ranges as shuffle partitions), and ids of a document that one row holds.
PART_BYTES, ROW_IDS = 32 << 20, 1 << 20
#: Pieces of text that a worker keeps before it begins anew, and their bytes.
TABLE_PIECES, TABLE_BYTES = 800_000, 32 << 20
#: Up to so many ranges (16 bytes each) have their place sent to every task; more are joined by a shuffle and sorted again.
BROADCAST_PARTS = 2_000_000
#: Bytes of texts that are cut into pieces at a time.
BLOCK_BYTES = 4 << 20
#: The pattern of byte-level words, the same in both libraries for characters up to the one below.
_PATTERN, _LATIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", "\u017f"
#: Other characters that count as white space somewhere: texts with one of them are encoded whole.
_OTHER_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"

_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64())])
_FRAGMENT = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE)), ("whole", pa.bool_())])
_PIECES = "array<struct<doc_id:long,start:long,length:int,doc_tokens:long>>"


def _cuts_at_space(file: dict) -> bool:
    """Whether the file's rules are those of a plain byte-level tokenizer."""
    cut = file.get("pre_tokenizer") or {}
    level = cut.get("type") == "ByteLevel" and cut.get("use_regex") is True and cut.get("add_prefix_space") is False
    return level and not file.get("normalizer") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in file.get("added_tokens") or [])


def _plain_ranks(file: dict) -> dict[bytes, int] | None:
    """Bytes of each token -> its id, if merges come in the order of the ids they make: then a token's id is its rank."""
    model, special = file["model"], {x["content"] for x in file.get("added_tokens") or []}
    made = [model["vocab"].get("".join(x) if isinstance(x, list) else x.replace(" ", "")) for x in model.get("merges") or []]
    bytes_of = {letter: byte for byte, letter in _LETTERS.items()}
    plain = model.get("type") == "BPE" and None not in made and all(x < y for x, y in zip(made, made[1:])) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if not plain or not all(x in model["vocab"] for x in bytes_of) or len(model["vocab"]) - len(special & set(model["vocab"])) != 256 + len(made):
        return None
    return {bytes(bytes_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class PieceTable:
    """A word with the space before it, or other white space -> its ids, in one flat array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.whole = "|".join([_OTHER_SPACE, *(re.escape(x["content"]) for x in file.get("added_tokens") or [])]) if _cuts_at_space(file) else ""
        ranks = _plain_ranks(file) if self.whole else None
        self.ranked = tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.bytes = 0
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.width)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.width), np.array([len(x) for x in ids], np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces: of Latin ones by rank, of others by the library."""
        if not self.ranked:
            return self._library(texts)
        other = [i for i, x in enumerate(texts) if not x.isascii() and max(x) > _LATIN]
        ids = [self.ranked(x) for x in texts]
        for i, e in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        return np.fromiter(chain.from_iterable(ids), self.width), np.array([len(x) for x in ids], np.int64)

    @staticmethod
    def cut(b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of a block's texts start and end: words with the space before them, and what white space is left over; of that
        in front of a word without a space, the last character is a piece of its own."""
        if not len(b.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = b.bounds[b.doc]
        ahead = (b.starts > first) & (b.data[np.maximum(b.starts - 1, 0)] == 0x20)
        starts = b.starts - ahead
        previous = np.concatenate([[0], b.ends[:-1]])
        before = np.maximum(previous, first)  # the end of the word before, in the same text
        gap = np.flatnonzero(before < starts)
        single = starts[gap] - ~ahead[gap]
        last = np.full(b.n, -1)
        last[b.doc] = b.ends
        last = np.where(last < 0, b.bounds[:-1], last)
        tail = np.flatnonzero(last < b.bounds[1:])
        lo = np.concatenate([starts, before[gap], single, last[tail]])
        hi = np.concatenate([b.ends, single, starts[gap], b.bounds[1:][tail]])
        some = lo < hi
        order = np.argsort(lo[some], kind="stable")
        return lo[some][order], hi[some][order]

    def encode(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, how many of each text)."""
        if len(self.at) > TABLE_PIECES or self.bytes > TABLE_BYTES:
            self.clear()
        lo, hi = self.cut(b)
        _, first, kind = np.unique(b.spans_hash(lo, hi), return_index=True, return_inverse=True)
        data = b.data.tobytes()
        pieces = [data[x:y] for x, y in zip(lo[first].tolist(), hi[first].tolist(), strict=True)]
        if not self._alike(b.data, lo, hi, first, kind):  # two pieces of this block have the same hash
            kinds: dict[bytes, int] = {}
            kind = np.array([kinds.setdefault(data[x:y], len(kinds)) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
            pieces = list(kinds)
        where = np.array([self.at.get(x, -1) for x in pieces], np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            ids, sizes = self._ids([x.decode("utf-8", "replace") for x in fresh])
            where[new] = len(self.starts) + np.arange(len(new))
            self.at.update(zip(fresh, where[new].tolist(), strict=True))
            self.bytes += sum(map(len, fresh))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, ids])
        word = where[kind]
        sizes = self.sizes[word]
        ends = np.cumsum(sizes)
        out = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[word] - ends + sizes, sizes)]
        doc = np.searchsorted(b.bounds, lo, "right") - 1
        return out, np.bincount(doc, weights=sizes, minlength=b.n).astype(np.int64)

    @staticmethod
    def _alike(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, kind: np.ndarray) -> bool:
        """Whether all pieces of a kind have the bytes of its first one."""
        size = hi - lo
        if (size != size[first[kind]]).any():
            return False
        ends = np.cumsum(size)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        return bool((data[np.repeat(lo, size) + step] == data[np.repeat(lo[first[kind]], size) + step]).all())

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, how many of each) over a column of texts."""
        column = as_strings(column)
        odd = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False) if self.whole else np.ones(len(column), bool)
        kinds = pc.if_else(pa.array(odd), "", column)
        for lo, hi, b in blocks(kinds, size=BLOCK_BYTES):
            ids, n = self.encode(b)
            if odd[lo:hi].any():
                at = np.flatnonzero(odd[lo:hi])
                own, sizes = self._library(column.slice(lo, hi - lo).take(pa.array(at)).to_pylist())
                ids = np.insert(ids, np.repeat(np.cumsum(n)[at], sizes), own)
                n[at] = sizes
            yield lo, hi, ids, n


_tables: dict[str, PieceTable] = {}


def _table(path: str) -> PieceTable:
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def _encoded(docs: DataFrame, tokenizer: str, end: int, text: str) -> DataFrame:
    """part, before, doc_id, doc_tokens, start, ids: the ids of all documents, of long ones in several rows; before counts the part's ids ahead of the row."""
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(max(parts(docs.sparkSession), -(-n_bytes // PART_BYTES)), *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, before = _table(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, ids, n in table.texts(batch.column(1)):
                ids, n = np.insert(ids, np.cumsum(n), table.width(end)), n + 1
                own = np.repeat(np.arange(hi - lo), -(-n // ROW_IDS))
                start = np.concatenate([np.arange(0, x, ROW_IDS) for x in n])
                at = (np.cumsum(n) - n)[own] + start
                raw = memoryview(ids.tobytes())
                cells = [bytes(raw[ids.itemsize * x : ids.itemsize * y]) for x, y in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
                columns = [pa.array(np.full(len(own), part, np.int64)), pa.array(before + at), batch.column(0).slice(lo, hi - lo).take(pa.array(own)), pa.array(n[own]), pa.array(start), pa.array(cells, pa.binary())]
                before += len(ids)
                yield pa.RecordBatch.from_arrays(columns, names=["part", "before", "doc_id", "doc_tokens", "start", "ids"])

    return rows.select("doc_id", "text").mapInArrow(encode, "part long, before long, doc_id long, doc_tokens long, start long, ids binary")


def _placed(rows: DataFrame, width: int) -> DataFrame:
    """The rows with `first`, their place in the whole; rows of a part stay in order."""
    totals = rows.groupBy("part").agg(F.sum(F.octet_length("ids") / width).cast("long").alias("n"))
    firsts = totals.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # one row for PART_BYTES of texts
    few = totals.count() <= BROADCAST_PARTS
    out = rows.join(F.broadcast(firsts) if few else firsts, F.col("part") == F.col("p")).withColumn("first", F.col("ahead") + F.col("before"))
    out = out if few else out.sortWithinPartitions("part", "before")
    return out.select("first", "doc_id", "doc_tokens", "start", "ids")


class _Run:
    """Rows that follow each other: what the last window has of them stays until the next rows come."""

    def __init__(self, width: type, window: int):
        self.width, self.window = width, window
        self.clear()

    def clear(self) -> None:
        self.first, self.ids = 0, np.zeros(0, self.width)
        self.pieces: list[np.ndarray] = []  # place, row's document, start, doc_tokens
        self.docs: list[int | None] = []

    def add(self, first: np.ndarray, docs: pa.Array, doc_tokens: np.ndarray, start: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows without a hole between them; gives the windows that are done."""
        if len(self.ids) and self.first + len(self.ids) != first[0]:
            yield self.fragments(True)
        if not len(self.ids):
            self.first = int(first[0])
        self.ids = np.concatenate([self.ids, ids])
        self.pieces.append(np.column_stack([first, len(self.docs) + np.arange(len(first)), start, doc_tokens]))
        self.docs += docs.to_pylist()
        if (self.first + len(self.ids)) // self.window > self.first // self.window:
            yield self.fragments(False)

    def fragments(self, all_: bool) -> pa.RecordBatch:
        """The windows so far; the last one, if it isn't full, stays unless all are asked for."""
        end, w = self.first + len(self.ids), self.window
        done = end if all_ else end // w * w
        rows = np.concatenate(self.pieces)
        cuts = np.arange(self.first // w + 1, -(-done // w)) * w  # multiples of the window inside
        lo = np.concatenate([[self.first], cuts])
        hi = np.concatenate([cuts, [done]])
        places = np.unique(np.concatenate([rows[:, 0], cuts, [done]]))
        of = np.searchsorted(rows[:, 0], places, "right") - 1
        own = places < done
        piece = np.column_stack([rows[of, 1], rows[of, 2] + places - rows[of, 0], np.diff(places, append=end), rows[of, 3]])
        at = np.searchsorted(places, lo)
        raw = memoryview(self.ids.tobytes())
        size = self.ids.itemsize
        cells = [bytes(raw[size * x : size * y]) for x, y in zip((lo - self.first).tolist(), (hi - self.first).tolist(), strict=True)]
        n = int(own.sum())
        structs = pa.StructArray.from_arrays([pa.array([self.docs[i] for i in piece[:n, 0].tolist()], pa.int64()), pa.array(piece[:n, 1]), pa.array(piece[:n, 2].astype(np.int32)), pa.array(piece[:n, 3])], fields=list(_PIECE))
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, n).astype(np.int32)), structs)
        lists = lists.cast(pa.list_(_PIECE))
        out = pa.RecordBatch.from_arrays([pa.array(lo // w), pa.array((lo % w).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(cells, pa.binary()), lists, pa.array(hi - lo == w)], schema=_FRAGMENT)
        rest, kept = self.ids[done - self.first :], [self.docs[i] for i in piece[n:, 0].tolist()]
        left = np.column_stack([places[n:], np.arange(len(places) - n), piece[n:, 1], piece[n:, 3]])
        self.clear()
        if len(rest):
            self.first, self.ids, self.docs, self.pieces = done, rest, kept, [left]
        return out


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END, window: int = WINDOW, text: str = "text") -> None:
    """Sequences and boundary records under path: sequence_id, offset, n_tokens, ids (little-endian, as wide as the vocabulary needs), pieces, whole."""
    spark = docs.sparkSession
    width = _table(tokenizer).width
    size = np.dtype(width).itemsize
    _encoded(docs, tokenizer, end, text).write.option("compression", "zstd").parquet(f"{path}/documents")
    rows = _placed(spark.read.schema("part long, before long, doc_id long, doc_tokens long, start long, ids binary").parquet(f"{path}/documents"), size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(width, window)
        for batch in batches:
            first, _, doc_tokens, start, _ = (x.to_numpy(zero_copy_only=False) if i not in (1, 4) else None for i, x in enumerate(batch.columns))
            cells = batch.column(4).to_pylist()
            n = np.array([len(x) // size for x in cells], np.int64)
            for at in np.split(np.arange(len(n)), np.flatnonzero(first[1:] != first[:-1] + n[:-1]) + 1) if len(n) else ():
                lo, hi = int(at[0]), int(at[-1]) + 1
                ids = np.frombuffer(b"".join(cells[lo:hi]), width)
                yield from run.add(first[lo:hi], batch.column(1).slice(lo, hi - lo), doc_tokens[lo:hi], start[lo:hi], ids)
        if len(run.ids):
            yield run.fragments(True)

    out = rows.mapInArrow(cut, f"sequence_id long, offset int, n_tokens int, ids binary, pieces {_PIECES}, whole boolean")
    out.write.partitionBy("whole").option("compression", "zstd").parquet(f"{path}/windows")


def _filled(ids: Column, n: Column, width: Column, window: int, pad: int) -> Column:
    """Ids of a short sequence with the padding behind them."""
    one = F.rpad(F.lit(pad.to_bytes(4, "little").hex()), F.lit(2) * width, F.lit("0"))  # the low bytes stand first
    return F.concat(ids, F.unhex(F.repeat(one, F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(window) - n))))


def sequences(spark: SparkSession, path: str, window: int = WINDOW, pad: int = PAD) -> DataFrame:
    """sequence_id, n_tokens, width, ids, pieces of every sequence written under path; n_tokens leaves padding out, an id has `width` bytes, pieces stand in order from offset 0."""
    rows = spark.read.schema(f"sequence_id long, offset int, n_tokens int, ids binary, pieces {_PIECES}, whole boolean").parquet(f"{path}/windows")
    rows = rows.withColumn("width", F.expr("cast(octet_length(ids) / n_tokens as int)"))
    whole = rows.where("whole").select("sequence_id", "n_tokens", "width", "ids", "pieces")
    met = rows.where("not whole").groupBy("sequence_id").agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("offset", "n_tokens", "ids", "pieces"))).alias("r"))  # at most one for each token of a window
    joined = met.select("sequence_id", F.aggregate("r", F.lit(0), lambda a, x: a + x["n_tokens"]).alias("n_tokens"), "width", F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.flatten(F.transform("r", lambda x: x["pieces"])).alias("pieces"))
    return whole.unionByName(joined.withColumn("ids", _filled(F.col("ids"), F.col("n_tokens"), F.col("width"), window, pad)))


def pieces(spark: SparkSession, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, from the sequences."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = pc.list_flatten(batch.column(2))
            own = pc.list_parent_indices(batch.column(2)).to_numpy()
            length = inner.field("length").to_numpy()
            before = np.cumsum(length) - length
            new = np.flatnonzero(np.diff(own, prepend=-1))
            offset = before - np.repeat(before[new], np.diff(new, append=len(own))) if len(own) else before
            crc, cells, widths = [], batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for i, x, n in zip(own.tolist(), offset.tolist(), length.tolist(), strict=True):
                crc.append(zlib.crc32(np.frombuffer(cells[i], f"<u{widths[i]}", n, x * widths[i]).astype("<u4").tobytes()))
            columns = [inner.field("doc_id"), inner.field("start"), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64()), inner.field("doc_tokens"), batch.column(0).take(pa.array(own)), pa.array(offset.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return sequences(spark, path, window).select("sequence_id", "ids", "pieces", "width").mapInArrow(read, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def run(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(docs.sparkSession, "packed")
    write(docs, tokenizer, path)
    return pieces(docs.sparkSession, path)
