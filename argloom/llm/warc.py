"""WARC archives with revisit records, and an external merge of their capture index.

Pages are written as WARC/1.0 records by Spark's own text writer (gzip files of bounded size, committed or not at all). Of pages with equal payloads
of at least MIN_BYTES, the one with the smallest page_id is a response; the others are revisits that refer to it. Archives
are read back as binary files and parsed by their Content-Length. Each archive gives a run of
captures, sorted by URL key (reversed host, then path), timestamp and page_id. Runs are cut at bounds
taken from a sample of keys; the pieces of each range are merged by a loser tree, which reads them one capture at a time.
(part, pos) is the place in the global order. The bounds are of whole keys (URL key, timestamp, page_id), so one URL with a third of all captures
spreads over many ranges; so do captures whose keys are wholly equal. Payloads move only where more of them are shared than can be sent to all tasks.

Null html is an empty payload; a null url has an empty key. A page without page_id is a response and refers to
nothing. Rows that repeat page_id and payload have one kind of record. Extra columns are ignored.
"""

from __future__ import annotations

import collections
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, parts, written

MIN_BYTES = 100
#: Records of an archive file at most, bytes of their payloads on average, and compressed bytes read at once.
FILE_RECORDS, FILE_BYTES, STEP_BYTES = 5000, 64 << 20, 1 << 16
#: Captures of a range of the merge, and rows sampled for each to find its bounds.
RANGE_ROWS, OVERSAMPLE = 50_000, 20
#: Up to so many payloads that several pages share have their first page sent to every task (some 100 bytes each).
BROADCAST_FIRSTS = 200_000
_EPOCH, _SPAN = 1_577_836_800, 1_000_000_000

_CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, ts string"


def _firsts(rows: DataFrame) -> DataFrame:
    """d, first, n: the smallest page_id of each payload that several pages have; only digests move."""
    long = rows.where((F.col("payload_bytes") >= MIN_BYTES) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    return written(long.groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first-pages")


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    firsts = _firsts(rows)
    several, most = firsts.agg(F.count("*"), F.sum("n")).first()
    refers = F.when((F.col("first") != F.col("page_id")) & (F.col("payload_bytes") >= MIN_BYTES), F.col("first"))
    if several <= BROADCAST_FIRSTS:
        return rows.join(F.broadcast(firsts.drop("n")), F.col("payload_digest") == F.col("d"), "left").withColumn("refers_to", refers).drop("d", "first")
    # The payloads with the most pages, at most BROADCAST_FIRSTS of them, are sent to all tasks; pages of the others meet theirs by a shuffle.
    hot = F.col("n") > most / BROADCAST_FIRSTS
    rows = rows.join(F.broadcast(firsts.where(hot).select(F.col("d").alias("hot"), F.col("first").alias("hot_first"))), F.col("payload_digest") == F.col("hot"), "left")
    rows = rows.withColumn("key", F.when(F.col("hot").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    rows = rows.join(firsts.where(~hot).drop("n"), F.col("key") == F.col("d"), "left").withColumn("first", F.coalesce("hot_first", "first"))
    return rows.withColumn("refers_to", refers).drop("d", "first", "hot", "hot_first", "key")


def write(pages: DataFrame, path: str) -> None:
    """The records as gzip files under path. A record ends in CR LF CR LF; the writer adds the last LF."""
    uuid = lambda c: F.concat(F.lit("<urn:md5:"), F.md5(F.coalesce(c.cast("string"), F.lit(""))), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.lit(_EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(_SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "payload_bytes", F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", uuid(F.col("page_id"))), line("WARC-Date", date),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", uuid(F.col("refers_to"))), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"))
    n, size = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    per_file = max(1, min(FILE_RECORDS, FILE_BYTES * n // max(size or 0, 1)))
    out = records(pages).withColumn("block", block).select(F.concat(head, "block", F.lit("\r\n\r")).alias("value"))
    out.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip file, which is unpacked bit by bit: only one record is held."""
    unpack, held, at = zlib.decompressobj(31), bytearray(), 0

    def until(enough) -> bool:
        """Unpack more until there is enough; False at the end of the file."""
        nonlocal at
        while not enough():
            if at >= len(archive) and not unpack.unconsumed_tail:
                return False
            data = unpack.unconsumed_tail or archive[at : (at := at + STEP_BYTES)]
            held.extend(unpack.decompress(data, 4 * STEP_BYTES))
        return True

    while until(lambda: len(held) > 0):
        assert until(lambda: held.find(b"\r\n\r\n") >= 0), "a record is cut off"
        start = held.find(b"\r\n\r\n") + 4
        lines = held[: start - 4].decode().split("\r\n")
        assert lines[0] == "WARC/1.0", "not a WARC record"
        head = dict(x.split(": ", 1) for x in lines[1:])
        end = start + int(head["Content-Length"])
        assert until(lambda: len(held) >= end + 4) and held[end : end + 4] == b"\r\n\r\n", "a record is cut off"
        yield head, bytes(held[start:end])
        del held[: end + 4]


def urlkey(url: str | None) -> str:
    """Reversed host, then path and query in lower case, without scheme, www, port and fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)(?::[0-9]+)?([^#]*)", (url or "").strip().lower())
    return ",".join(reversed(m[1].removeprefix("www.").split("."))) + ")" + (m[2] or "/")


def stamp(page_id: int | None) -> str:
    return datetime.fromtimestamp(_EPOCH + (page_id or 0) % _SPAN, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _capture(head: dict[str, str], block: bytes) -> dict:
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    revisit = head["WARC-Type"] == "revisit"
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit:
        assert len(payload) == size and hashlib.sha256(payload).hexdigest() == digest, "a payload was damaged"
    number = lambda x: int(x) if x else None
    return {"page_id": number(head["X-Page-Id"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number(head.get("X-Refers-To-Page-Id")), "urlkey": urlkey(head["WARC-Target-URI"]), "ts": head["WARC-Date"]}


def _order(x: dict) -> tuple[str, str, int]:
    return x["urlkey"], x["ts"], -1 if x["page_id"] is None else x["page_id"]


class LoserTree:
    """Merges sorted runs, of which it holds the heads: inner nodes keep the loser of their match, so each item costs one path to the root."""

    def __init__(self, runs: Iterable[Iterable[dict]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [self._key(i) for i in range(len(self.runs))]
        self.losers = [-1] * max(len(self.runs), 1)
        for i in range(len(self.runs)):
            self._play(i)

    def _key(self, i: int):
        return (1,) if self.heads[i] is None else (0, *_order(self.heads[i]), i)

    def _play(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            if self.losers[node] < 0:  # the first to come waits
                self.losers[node] = i
                return
            if self.keys[self.losers[node]] < self.keys[i]:
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[dict]:
        while self.runs and self.heads[i := self.losers[0]] is not None:
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = self._key(i)
            self._play(i)


def _bounds(pages: DataFrame) -> list[tuple]:
    """Keys that cut the captures into ranges of about RANGE_ROWS; the driver gets one row for each range."""
    spark = pages.sparkSession
    n = pages.count()
    ranges = max(parts(spark), -(-n // RANGE_ROWS))
    share = min(1.0, OVERSAMPLE * ranges / max(n, 1))
    some = pages.select("page_id", "url").where(F.xxhash64("page_id", "url") <= F.lit(-(1 << 63) + min(int(share * (1 << 64)), (1 << 64) - 1)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, url = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(urlkey(re.sub(r"[\x00-\x20]", "%20", u or "")), stamp(p), -1 if p is None else p) for p, u in zip(page, url, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["u", "t", "p"])

    # OVERSAMPLE rows for each range, numbered in one task; in bytes' order, which is that of code points.
    place = F.row_number().over(Window.orderBy("u", "t", "p"))
    every = F.greatest(F.floor(F.count("*").over(Window.partitionBy()) / ranges), F.lit(1))
    picked = some.mapInArrow(keys, "u string, t string, p long").withColumns({"place": place, "every": every}).where("place % every = 0")
    return sorted((r["u"], r["t"], r["p"]) for r in picked.select("u", "t", "p").collect())


def merged_index(spark: SparkSession, path: str, bounds: list[tuple]) -> DataFrame:
    """Captures of all archives under path in global order: the columns of _CAPTURE, part and pos."""
    entry = pa.list_(pa.struct([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("urlkey", pa.string()), ("ts", pa.string())]))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = content.as_py()
                run = sorted((_capture(*x) for x in parse(file)), key=_order)
                salt, pieces = zlib.crc32(file), collections.defaultdict(list)
                for i, x in enumerate(run):
                    # A key that is several bounds at once has all the ranges between them.
                    least, most = bisect_left(bounds, _order(x)), bisect_right(bounds, _order(x))
                    pieces[most if most - least < 2 else least + 1 + (salt + i) % (most - least)].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(list(pieces.values()), entry)], names=["part", "run"])

    def merge(table: pa.Table) -> pa.Table:
        column = table.column("run").combine_chunks()
        column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks)
        rows = column.values
        out = list(LoserTree((rows[j].as_py() for j in range(a, b)) for a, b in zip(column.offsets.to_pylist(), column.offsets.to_pylist()[1:], strict=False)))
        found = pa.Table.from_pylist(out, pa.schema(entry.value_type))
        return found.append_column("part", pa.array([table.column("part")[0].as_py()] * len(out), pa.int32())).append_column("pos", pa.array(range(len(out)), pa.int64()))

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return archives.mapInArrow(runs, f"part int, run array<struct<{_CAPTURE.replace(' ', ':').replace(',:', ',')}>>").groupBy("part").applyInArrow(merge, f"{_CAPTURE}, part int, pos long")


def run(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, read these back and merge their index; captures in order of (part, pos)."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    return merged_index(spark, path, _bounds(pages))


PAGES_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {MIN_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first != page_id THEN first END AS refers_to FROM f
"""
