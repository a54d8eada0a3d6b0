"""WARC archives: written from pages, read back, and indexed by an external merge.

Writing: one projection makes each record's text; Spark's text writer ends records with the two line ends that the format
asks for, so any file system that Spark writes to holds the archives, and a lost task's output is never seen. Of equal
payloads of at least ``least`` bytes the largest id is the response and the others are revisits of it: one grouped maximum
per digest, and a join in which a hot digest may be split.

Reading: an archive is inflated piece by piece and cut into records by Content-Length; payload digests are checked. The index
tells each capture's archive and its place and length in the inflated archive, and ``record_at`` fetches it from there.

Index: a reading task sorts its captures into runs, one per key range, front-coded. Runs travel as single rows to the task
of their range, which merges them with a loser tree by URL key, timestamp and id; range order and merge order together are
the global order. Ranges are cut at quantiles of a bounded sample of whole sort keys, so a hot URL is spread over ranges.

Cases: null html is an empty payload; a null url has no target line and the key ''; payloads below ``least`` bytes are all
responses; a null page_id is written ``<urn:capture:null>``, read as null and comes first among equal keys and times; an
empty table gives an empty index; archives are cut at ``FILE_RECORDS`` records, and earlier if that many of the longest page would pass
``FILE_BYTES``, so that an archive can be read as one value.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _losers
from ._shared import keep, new_path, partitions, table

#: Records of an archive file, keys in the sample that cuts the ranges, captures of a run that a task sorts at once.
FILE_RECORDS, SAMPLE_KEYS, RUN_CAPTURES = 5_000, 5_000, 20_000
#: Bytes of an archive before compression, and of a record besides its payload.
FILE_BYTES, HEAD_BYTES = 1 << 30, 8_192

#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

#: While captures are sorted: a null id, below every id, and a missing URL, which no head can spell.
NO_ID, NO_URL = -(2**63) - 1, "\0"

CAPTURE = "page_id long, url string, url_key string, captured_at string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, file_offset long, file_length long"


def with_responses(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, its size and digest, and ``refers_to``: the response's id for a revisit, else null."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload").cast("long")})
    first = own.where(F.col("size") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    return own.join(first, (own["digest"] == first["d"]) & (own["size"] >= least), "left").select(
        "page_id", "url", "payload", "size", "digest", F.when(F.col("response") != F.col("page_id"), F.col("response")).alias("refers_to")
    )


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """One column ``value``: the text of each page's record, without the two line ends that close it."""
    own = with_responses(pages, least)
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(HTTP_HEAD + "Content-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: " + REVISIT_PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    # concat_ws leaves out the lines that are null
    return own.select(F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), block).alias("value"))


def write(pages: DataFrame, path: str, least: int = 1000) -> str:
    """Write the archives of a table of pages (page_id, url, html) under ``path``."""
    longest = pages.agg(F.max(F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0] or 0
    most = max(1, min(FILE_RECORDS, FILE_BYTES // (longest + HEAD_BYTES)))
    records(pages, least).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    return path


def record_at(content: bytes, offset: int, length: int) -> bytes:
    """The bytes of one record, from the place that the index tells."""
    inflate, seen, out = zlib.decompressobj(wbits=31), 0, bytearray()
    for at in range(0, len(content), 262_144):
        piece = inflate.decompress(content[at : at + 262_144])
        out += piece[max(0, offset - seen) : max(0, offset + length - seen)]
        seen += len(piece)
        if seen >= offset + length:
            break
    return bytes(out)


def url_key(url: str | None) -> str:
    """Host labels from the top level down, then path and query: neighbours in order are neighbours on the web."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url or "")
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2] or '/'}" if m else (url or "")


def parse(content: bytes) -> Iterator[tuple]:
    """The captures of one archive, in file order."""
    inflate, at, buffer, begun = zlib.decompressobj(wbits=31), 0, bytearray(), 0

    def more(need: int) -> bool:
        nonlocal at
        while len(buffer) < need and at < len(content):
            buffer.extend(inflate.decompress(content[at : at + 262_144]))
            at += 262_144
        return len(buffer) >= need

    while more(1):
        need = 4096
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more(need):
            need *= 2
        if end < 0:
            raise ValueError("an archive ends within a record's head")
        lines = buffer[:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        length = int(head["Content-Length"])
        if not more(end + 4 + length + 4):
            raise ValueError("an archive ends within a record")
        block = bytes(buffer[end + 4 : end + 4 + length])
        del buffer[: end + 8 + length]
        place, begun = begun, begun + end + 8 + length
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        number = lambda x: NO_ID if x == "<urn:capture:null>" else int(x[len("<urn:capture:") : -1])
        url = head.get("WARC-Target-URI")
        refers = number(head["WARC-Refers-To"]) if kind == "revisit" else None
        yield (url_key(url), head["WARC-Date"], number(head["WARC-Record-ID"]), NO_URL if url is None else url, size, digest, kind, refers, place, begun - place)


def front_coded(rows: list[tuple]) -> bytes:
    """A sorted run as bytes; each key is written as the length it shares with the one before, and the rest."""
    out, last = [], ""
    for key, *rest in rows:
        n = 0
        while n < min(len(key), len(last)) and key[n] == last[n]:
            n += 1
        out.append([n, key[n:], *rest])
        last = key
    return zlib.compress(json.dumps(out).encode(), 1)


def decoded(run: bytes) -> Iterator[tuple]:
    last = ""
    for n, tail, *rest in json.loads(zlib.decompress(run)):
        last = last[:n] + tail
        yield (last, *rest)


def read_index(spark: SparkSession, path: str, ranges: int | None = None) -> DataFrame:
    """Every capture of the archives under ``path``, in the order of (range_no, place): URL key, timestamp, id."""
    ranges = ranges or partitions(spark)
    files = spark.read.format("binaryFile").load(path).select("content", "path")

    def read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, path in zip(batch.column(0), batch.column(1).to_pylist()):
                rows, name = [], path.rpartition("/")[2]
                for row in parse(content.as_py()):
                    rows.append((*row, name))
                    if len(rows) == RUN_CAPTURES:
                        yield sorted_run(rows)
                        rows = []
                if rows:
                    yield sorted_run(rows)

    def sorted_run(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:3])
        return pa.RecordBatch.from_pydict({"run": pa.array([front_coded(rows)], pa.binary()), "n": pa.array([len(rows)], pa.int64())})

    runs = keep(files.mapInArrow(read_runs, "run binary, n long"), "warc-runs")
    total = runs.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, SAMPLE_KEYS / max(total, 1))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0):
                keys = [(r[0], r[1], r[2]) for r in decoded(run.as_py()) if zlib.crc32(f"{r[0]} {r[1]} {r[2]}".encode()) < share * 2**32]
                yield pa.RecordBatch.from_pydict({"k": pa.array([k[0] for k in keys], pa.string()), "t": pa.array([k[1] for k in keys], pa.string()), "i": pa.array([max(k[2], NO_ID + 1) for k in keys], pa.int64())})

    keys = sorted(tuple(r) for r in runs.mapInArrow(sample, "k string, t string, i long").limit(4 * SAMPLE_KEYS).collect())
    cuts = [keys[len(keys) * j // ranges] for j in range(1, ranges)] if keys else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut each sorted run at the range bounds."""
        for batch in batches:
            for run in batch.column(0):
                parts: dict[int, list[tuple]] = {}
                for row in decoded(run.as_py()):
                    parts.setdefault(bisect.bisect_right(cuts, row[:3]), []).append(row)
                yield pa.RecordBatch.from_pydict({"range_no": pa.array(list(parts), pa.int32()), "run": pa.array([front_coded(p) for p in parts.values()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge the runs of each range; a partition may hold several ranges, in order."""
        now, held = None, []
        for batch in batches:
            for no, run in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and no != now:
                    yield from merged(now, held)
                    held = []
                now = no
                held.append(run.as_py())
        if held:
            yield from merged(now, held)

    def merged(no: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        place, rows = 0, []
        for row in _losers.merge([decoded(run) for run in held]):
            rows.append((no, place + len(rows), *row))
            if len(rows) == 5_000:
                place += len(rows)
                yield captures(rows)
                rows = []
        if rows:
            yield captures(rows)

    def captures(rows: list[tuple]) -> pa.RecordBatch:
        no, place, key, at, page, url, size, digest, kind, refers, offset, length, file = zip(*rows)
        page, url = [None if x == NO_ID else x for x in page], [None if x == NO_URL else x for x in url]
        return pa.RecordBatch.from_arrays(
            [pa.array(no, pa.int32()), pa.array(place, pa.int64()), pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(key, pa.string()), pa.array(at, pa.string()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64()), pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
            names=["range_no", "place", "page_id", "url", "url_key", "captured_at", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "file_offset", "file_length"],
        )

    dealt = runs.select("run").mapInArrow(deal, "range_no int, run binary").repartition(ranges, "range_no").sortWithinPartitions("range_no")
    return dealt.mapInArrow(merge, "range_no int, place long, " + CAPTURE)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to FROM r"""
