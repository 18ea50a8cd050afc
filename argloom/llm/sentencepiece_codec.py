"""SentencePiece encoding and decoding through distinct-chunk tables.

The text is marked as the library does (a space becomes U+2581, one marker goes in front)
and cut in front of each run of markers. No piece of the model has a marker behind another
character (`crosses_markers` checks the vocabulary), so merges never cross a cut. Each block of texts
gets a table of its distinct marked words; every one of them is segmented once and ids are
joined back by position. A Python worker keeps its table from block to block and task to task
until it reaches its bound, then begins it anew: memory is bounded, no rows move between tasks,
and a lost executor costs only its own tasks.

Null and empty texts have no ids and decode to "". Rows are kept one to one, repeats too.
A model whose pieces cross markers is encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
_CUT = re.compile("[ ▁]+[^ ▁]*")
#: Distinct marked words (and characters in them) a task keeps before it starts a new table.
TABLE_CHUNKS, TABLE_CHARS = 250_000, 8 << 20


class ChunkTable:
    """Marked word -> its ids in decimal, joined by commas, and the text they decode to."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.mark = self.model.piece_to_id(MARK)
        self.whole = crosses_markers(self.model)
        self.ids: dict[str, str] = {}
        self.surface: dict[str, str] = {}
        self.chars = 0

    def cut(self, text: str) -> list[str]:
        return _CUT.findall(" " + text) if text else []

    def add(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks, each once, and decode them."""
        if len(self.ids) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.ids, self.surface, self.chars = {}, {}, 0
        new = [c for c in chunks if c not in self.ids]
        self.chars += sum(map(len, new))
        # The library puts one marker in front of what it is given; an empty rest would get none.
        ids = [x or [self.mark] for x in self.model.encode([c[1:] for c in new], num_threads=1)]
        self.ids.update(zip(new, [",".join(map(str, x)) for x in ids], strict=True))
        # A chunk decoded by itself lacks the one marker that the library drops in front.
        self.surface.update((c, c if c == " " + x else " " + x) for c, x in zip(new, self.model.decode(ids), strict=True))

    def written(self, texts: list[str]) -> list[tuple[str, str]]:
        """Each text's ids in decimal, joined by commas, and the text they decode to."""
        if self.whole:
            ids = self.model.encode(texts, num_threads=1)
            return [(",".join(map(str, x)), y) for x, y in zip(ids, self.model.decode(ids), strict=True)]
        cut = [self.cut(t) for t in texts]
        self.add(set(chain.from_iterable(cut)))
        ids, surface = self.ids.__getitem__, self.surface.__getitem__
        return [(",".join(map(ids, c)), "".join(map(surface, c))[1:]) for c in cut]


_tables: dict[str, ChunkTable] = {}


def chunk_table(model_path: str) -> ChunkTable:
    """The worker's own table for a model."""
    if model_path not in _tables:
        _tables[model_path] = ChunkTable(model_path)
    return _tables[model_path]


def crosses_markers(model) -> bool:
    """Whether some piece has a marker behind another character."""
    return any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))


def _in_blocks(texts: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t.as_py() or "")
        size += len(block[-1])
        if size > chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with its token ids, and what they decode to if a name is given for it."""
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])
    kept = [c for c in docs.columns if c not in {f.name for f in new}]
    docs = docs.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(model_path)
        for batch in batches:
            at = 0
            for block in _in_blocks(batch.column(kept.index(text))):
                found = chunks.written(block)
                out = [pa.array([np.fromstring(x, np.int32, sep=",") for x, _ in found], pa.list_(pa.int32()))]
                if decoded:
                    out.append(pa.array([y for _, y in found], pa.string()))
                part = batch.slice(at, len(block))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*kept, *[f.name for f in new]])
                at += len(block)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, for every row.

    Digests are taken where ids are made, so that neither ids nor texts travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            at = 0
            for block in _in_blocks(batch.column(1)):
                found = chunks.written(block)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(block)),
                    pa.array([x.count(",") + 1 if x else 0 for x, _ in found], pa.int64()),
                    pa.array([sha(x) for x, _ in found], pa.string()),
                    pa.array([sha(y) for _, y in found], pa.string()),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(block)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
