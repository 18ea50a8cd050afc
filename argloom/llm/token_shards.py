"""Token ids in shards of documents, each one file with a wavelet matrix.

Texts are encoded through tables of distinct words: tokens never cross white space, so each distinct word (found
by hash, told by its bytes) is encoded once per table by the library and its ids joined by position; a file with other
rules for words than the known ones is encoded text by text. Documents are sorted by ranges of
(doc_id, hash of the text), so that a repeated or missing id may span many ranges; a range gives shards of about SHARD_TOKENS
tokens (a longer document has one of its own), END following each document. A shard file holds doc_ids, document lengths, and the bit planes of
a wavelet matrix with samples of their ranks, all compressed, in one binary cell of its own Parquet file, so that
Spark commits it or not at all and any store can hold it. WaveletMatrix answers access, rank,
count, select and occurrences from it, and gives back the whole sequence.

Null texts are empty: only END. Null doc_ids come first. Rows that repeat a doc_id follow each other by a hash of the text. An empty table gives no
shards and no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, parts
from .textblocks import Block, blocks

#: Words, and parts of words, that a worker keeps before it begins anew.
TABLE_WORDS, TABLE_PARTS, SAMPLE_BITS = 800_000, 400_000, 512
#: And bytes of these words.
TABLE_BYTES = 32 << 20
#: Bytes of texts for each range (at least as many ranges as shuffle partitions), and tokens of a shard.
PART_BYTES, SHARD_TOKENS = 32 << 20, 4 << 20
#: Up to so many shards have their place sent to every task (16 bytes each); more are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000
_MAGIC = b"WMX1"

# In texts of Latin-1 alone, lower-casing goes letter by letter, nothing composes, and these are the letters,
# numbers and spaces of the vocabulary's own pattern; so its words can be cut here.
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\x09-\x0d\x20\x85\xa0"
_LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


#: The normalizer and the pattern for which words can be cut at white space, as in the file.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_at_space(file: dict) -> bool:
    """Whether the file's normalizer and pre-tokenizer are those that the word table is made for."""
    first, *others = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": _PATTERN} and first.get("behavior") == "Removed" and first.get("invert")
    level = [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in others] == [("ByteLevel", False, False)]
    plain = all(x["content"].startswith("<|") and not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in file.get("added_tokens") or [])
    return bool((file.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and split and level and plain)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


_LETTERS = _byte_letters()


class WordTable:
    """A word between white space -> its ids, in one flat array; and the ids of the parts words consist of."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _cuts_at_space(json.loads(self.tokenizer.to_str()))
        self.parts: dict[str, tuple[int, ...]] = {}
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.chars = 0
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word. Latin-1 words fall into parts that the model encodes by themselves; the library takes the others whole."""
        out: list[tuple[int, ...]] = [()] * len(words)
        whole = []
        if len(self.parts) > TABLE_PARTS:
            self.parts = {}
        for i, w in enumerate(words):
            if "<|" in w or not w.isascii() and max(w) > "\xff":  # special tokens could begin; letters could compose
                whole.append(i)
                continue
            ids: tuple[int, ...] = ()
            for part in _LATIN_WORD.findall(w.lower()):
                got = self.parts.get(part)
                if got is None:
                    got = self.parts[part] = tuple(t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(_LETTERS)))
                ids += got
            out[i] = ids
        for i, e in zip(whole, self.tokenizer.encode_batch([words[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = tuple(e.ids)
        return out

    def _places(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(a word of each kind, the kind of every word) of a block; words of a kind have the same bytes."""
        _, first, kind = np.unique(b.word_hash(), return_index=True, return_inverse=True)
        if b.same_words(np.arange(len(kind)), first[kind]).all():
            return first, kind
        kinds: dict[bytes, int] = {}  # two words of this block have the same hash
        kind = np.array([kinds.setdefault(b.word_bytes(i), len(kinds)) for i in range(len(kind))])
        return np.unique(kind, return_index=True)[1], kind

    def encode(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, how many of each text)."""
        if not self.by_word:
            texts = [b.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(b.bounds[:-1].tolist(), b.bounds[1:].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64)
        if len(self.at) > TABLE_WORDS or self.chars > TABLE_BYTES:
            self.clear()
        first, kind = self._places(b)
        words = [b.word_bytes(i) for i in first.tolist()]
        where = np.array([self.at.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            new_words = [words[i] for i in new.tolist()]
            ids = self._ids([w.decode("utf-8", "replace") for w in new_words])
            sizes = np.array([len(x) for x in ids], np.int64)
            where[new] = len(self.starts) + np.arange(len(new))
            self.at.update(zip(new_words, where[new].tolist(), strict=True))
            self.chars += sum(map(len, new_words))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
        word = where[kind]
        sizes = self.sizes[word]
        ends = np.cumsum(sizes)
        out = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[word] - ends + sizes, sizes)]
        return out, np.bincount(b.doc, weights=sizes, minlength=b.n).astype(np.int64)


_tables: dict[str, WordTable] = {}


def _word_table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


class WaveletMatrix:
    """A sequence of integers as bit planes, the highest first; each plane sorts the next one stably by its bit."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n = planes, n
        step = SAMPLE_BITS // 8
        ones = [np.add.reduceat(np.bitwise_count(p), np.arange(0, len(p), step), dtype=np.int64) if len(p) else np.zeros(0, np.int64) for p in planes]
        self.samples = [np.concatenate([[0], np.cumsum(x)]) for x in ones]
        self.zeros = [n - int(s[-1]) for s in self.samples]

    @classmethod
    def of(cls, values: np.ndarray) -> WaveletMatrix:
        planes = []
        if not len(values) or values.max() < 1 << 16:
            values = values.astype(np.uint16)
        for bit in range(max(1, int(values.max(initial=0)).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            values = np.concatenate([values[~ones], values[ones]])
        return cls(planes, len(values))

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // SAMPLE_BITS
        full, bits = divmod(i - block * SAMPLE_BITS, 8)
        start = block * SAMPLE_BITS // 8
        got = int(self.samples[level][block]) + int(np.bitwise_count(self.planes[level][start : start + full]).sum())
        return got + (int(self.planes[level][start + full]) & (1 << bits) - 1).bit_count() if bits else got

    def _down(self, level: int, i: int, bit: int) -> int:
        ones = self._rank1(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i >> 3]) >> (i & 7) & 1
            value, i = value << 1 | bit, self._down(level, i, bit)
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the value's occurrences among the first i end up behind the last plane."""
        if value >> len(self.planes):
            return 0, 0
        lo = 0
        for level in range(len(self.planes)):
            bit = value >> (len(self.planes) - 1 - level) & 1
            lo, i = self._down(level, lo, bit), self._down(level, i, bit)
        return lo, i

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value among the first i."""
        lo, hi = self._range(value, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence of value, from 0."""
        i = self._range(value, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self._select_bit(level, i - self.zeros[level] if bit else i, bit)
        return i

    def _select_bit(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th bit of this kind in a plane."""
        at = np.arange(len(self.samples[level])) * SAMPLE_BITS
        before = self.samples[level] if bit else np.minimum(at, self.n) - self.samples[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        start = block * SAMPLE_BITS // 8
        bits = np.unpackbits(self.planes[level][start : start + SAMPLE_BITS // 8], bitorder="little")
        return block * SAMPLE_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last plane up: each plane's zeros and ones take their values in order."""
        values = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[~ones] = values[: self.zeros[level]]
            above[ones] = values[self.zeros[level] :] | values.dtype.type(1 << len(self.planes) - 1 - level)
            values = above
        return values.astype(np.uint32)


def pack(doc_ids: list[int | None], lengths: np.ndarray, values: np.ndarray) -> bytes:
    """A shard file."""
    matrix = WaveletMatrix.of(values)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    pieces = [known.tobytes(), np.array([x or 0 for x in doc_ids], np.int64).tobytes(), lengths.astype(np.int64).tobytes(), *[p.tobytes() for p in matrix.planes]]
    squeeze = zstandard.ZstdCompressor(level=3)
    pieces = [squeeze.compress(p) for p in pieces]
    return _MAGIC + struct.pack("<QQI", len(doc_ids), len(values), len(matrix.planes)) + struct.pack(f"<{len(pieces)}Q", *map(len, pieces)) + b"".join(pieces)


def unpack(file: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, document lengths and the wavelet matrix of a shard file."""
    assert file[:4] == _MAGIC, "not a shard file"
    n_docs, n, n_planes = struct.unpack_from("<QQI", file, 4)
    sizes = struct.unpack_from(f"<{n_planes + 3}Q", file, 24)
    at, pieces, expand = 24 + 8 * len(sizes), [], zstandard.ZstdDecompressor()
    for size in sizes:
        pieces.append(expand.decompress(file[at : at + size]))
        at += size
    known, ids = np.frombuffer(pieces[0], np.uint8), np.frombuffer(pieces[1], np.int64)
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], np.frombuffer(pieces[2], np.int64), WaveletMatrix([np.frombuffer(p, np.uint8) for p in pieces[3:]], n)


def write(docs: DataFrame, tokenizer: str, end: int, path: str, text: str = "text") -> None:
    """Shard files of all texts under path: Parquet with shard, n_tokens and file, one row each; shards are numbered in order."""
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(parts(docs.sparkSession), -(-n_bytes // PART_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select("doc_id", text, F.xxhash64(text).alias("tie")).repartitionByRange(ranges, *order).sortWithinPartitions(*order, text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _word_table(tokenizer), TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def shard(number: int) -> pa.RecordBatch:
            ids, lengths, values = (list(x) for x in zip(*held, strict=True))
            held.clear()
            lengths, values = np.concatenate(lengths), np.concatenate(values)
            file = pack(pa.chunked_array(ids).to_pylist(), lengths, values)
            return pa.RecordBatch.from_arrays([pa.array([part | number], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([file], pa.binary())], names=["shard", "n_tokens", "file"])

        number = size = 0
        for batch in batches:
            for lo, hi, b in blocks(batch.column(1)):
                found, n = words.encode(b)
                held.append((batch.column(0).slice(lo, hi - lo), n + 1, np.insert(found, np.cumsum(n), np.uint32(end))))
                size += len(found)
                if size > SHARD_TOKENS:
                    yield shard(number)
                    number, size = number + 1, 0
        if held:
            yield shard(number)

    files = rows.select("doc_id", text).mapInArrow(encode, "shard long, n_tokens long, file binary")
    files.write.option("compression", "uncompressed").option("maxRecordsPerFile", 1).parquet(path)


def _firsts(sizes: DataFrame) -> DataFrame:
    """s, first: the tokens before each shard, summed by the range that the shard is of, then over the ranges."""
    of = F.shiftright("s", 32)
    ranges = sizes.groupBy(of.alias("range")).agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # one row for PART_BYTES of texts
    own = F.sum("n_tokens").over(Window.partitionBy(of).orderBy("s")) - F.col("n_tokens")
    return sizes.withColumn("own", own).join(ranges, of == F.col("range")).select("s", (F.col("before") + F.col("own")).alias("first"))


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files."""
    files = spark.read.schema("shard long, n_tokens long, file binary").parquet(path)
    firsts = _firsts(files.select(F.col("shard").alias("s"), "n_tokens"))
    if files.count() <= BROADCAST_SHARDS:
        firsts = F.broadcast(firsts)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, lengths, matrix = unpack(file.as_py())
                values = memoryview(matrix.decode().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(values[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "file").join(firsts, F.col("shard") == F.col("s")).select("first", "file").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def run(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    path = new_path(docs.sparkSession, "token-shards")
    write(docs, tokenizer, end, path)
    return read(docs.sparkSession, path)
