"""WARC archives as a table of chunks: oversized payloads go in and out in pieces, never as one record.

Writing is DataFrame work: a payload is cut into segments, the first of which is a response record and the others
continuation records of the WARC format, each a row of a compressed text file. Reading is one pass over the
decompressed stream of each file: a payload comes out as rows of (record, chunk number), with length and digest carried
from chunk to chunk. Records with equal payloads are stored once; the others revisit the one with the largest id.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import tidy, unused, written

#: Bytes of a payload in one segment, and in one chunk that is read.
SEGMENT = 1 << 18
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
#: Copied payloads up to this number (about 40 bytes each) are broadcast to the writers; more are joined.
BROADCAST_ROWS = 50_000
#: Bytes that go to the parser at once, if lines are short; a line may be as long as a segment.
_PIECE = 1 << 20
_HTTP_END = b"\r\n\r\n"
#: A block that has no end of its HTTP header within this many bytes has none.
_HTTP_MOST = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _bytes(*parts: Column | str) -> Column:
    return F.concat(*[(F.lit(p) if isinstance(p, str) else p).cast("string") for p in parts]).cast("binary")


def warc_records(pages: DataFrame, id_column: str, uri_column: str, payload_column: str, segment: int = SEGMENT, revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """One row `record` (binary) per WARC record of these pages; a payload longer than `segment` makes several, in order.

    A null payload is empty, a null id or uri gives no value in the record. Of equal payloads of at least
    `revisit_bytes` bytes the row with the largest id is stored; rows that tie for it are stored each, and so is every
    row of a group without ids. A repeated row repeats its record and record id.
    """
    payload, n, sha = unused(pages, "payload", "n", "sha")
    key, first, page, uri = unused(pages, "key", "first", "page", "uri")
    rows = pages.select(F.col(id_column).cast("long").alias(page), F.col(uri_column).cast("string").alias(uri), F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary").alias(payload))
    rows = rows.withColumns({n: F.octet_length(payload).cast("long"), sha: F.sha1(payload), key: F.when(F.octet_length(payload) >= revisit_bytes, F.unhex(F.sha2(payload, 256)))})
    copies = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(page).alias(first), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = written(copies, "copied_payloads")
    few = copies.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(copies) if few else copies, key, "left")

    revisits = F.coalesce(F.col(first).isNotNull() & (F.col(page).isNull() | (F.col(page) < F.col(first))), F.lit(False))
    name = lambda who: F.concat(F.lit("<urn:x-page:"), F.coalesce(who.cast("string"), F.lit("")), F.lit(":"), F.col(sha), F.lit(">"))
    line = lambda field, value: F.coalesce(F.concat(F.lit(f"{field}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col(n).cast("string"), F.lit("\r\n\r\n"))
    stored = F.when(revisits, F.lit(0)).otherwise(F.col(n))
    pieces = F.greatest(F.lit(1), F.ceil(stored / segment)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.when(stored > 0, F.substring(F.col(payload), i * segment + 1, F.lit(segment))).otherwise(F.lit(b"")))
    safe_uri = F.regexp_replace(F.regexp_replace(F.col(uri), "\r", "%0D"), "\n", "%0A")
    cut = rows.select(
        revisits.alias("revisit"),
        name(F.col(page)).alias("id"),
        F.when(revisits, name(F.col(first))).alias("refers"),
        safe_uri.alias("uri"),
        http.alias("http"),
        stored.alias("stored"),
        F.col(sha).alias("sha"),
        pieces.alias("pieces"),
        F.posexplode(parts).alias("k", "part"),
    )
    start = F.col("k") == 0
    block = F.when(start, F.concat(F.col("http").cast("binary"), F.col("part"))).otherwise(F.col("part"))
    cut = cut.withColumn("block", block)
    many, last = F.col("pieces") > 1, F.col("k") == F.col("pieces") - 1
    kind = F.when(~start, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    own = F.when(start, F.col("id")).otherwise(F.regexp_replace("id", ">$", F.concat(F.lit(":"), (F.col("k") + 1).cast("string"), F.lit(">"))))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Segment-Number", F.when(many, F.col("k") + 1)),
        line("WARC-Segment-Origin-ID", F.when(~start, F.col("id"))),
        line("WARC-Segment-Total-Length", F.when(many & last, F.octet_length("http") + F.col("stored"))),
        line("WARC-Profile", F.when(F.col("revisit"), F.lit(_PROFILE))),
        line("WARC-Refers-To", F.col("refers")),
        line("WARC-Payload-Digest", F.when(start, F.concat(F.lit("sha1:"), F.col("sha")))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        line("Content-Type", F.when(start, F.lit("application/http; msgtype=response"))),
        line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    return cut.select(F.concat(header.cast("binary"), F.col("block"), F.lit(b"\r\n\r\n")).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the rows `record` as gzip-compressed WARC files into a new folder, one per task: readers that know Spark's
    file systems need nothing else, and a lost task leaves no file behind. Each file is one gzip stream."""
    text = F.expr("substring(record, 1, octet_length(record) - 1)").cast("string")  # the writer adds the last \n
    records.select(text.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class _Stream:
    """Parses WARC files that come as pieces of bytes; holds the bytes of one header or chunk at most, besides the piece."""

    def __init__(self, chunk: int, with_payload: bool):
        self.chunk, self.with_payload = chunk, with_payload
        self.held, self.left, self.out = b"", None, []
        self.record = None  # the record whose payload goes on

    def feed(self, data: bytes) -> None:
        data, at = self.held + data, 0
        while True:
            if self.left is None:
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                self._header(data[at:end])
                at = end + 4
            if self.left > 0:
                part = data[at : at + min(self.left, self.chunk)]
                if len(part) < min(self.left, self.chunk):  # wait for a whole chunk
                    break
                at += len(part)
                self.left -= len(part)
                self._body(part)
                if self.left:
                    continue
            if len(data) < at + 4:
                break
            if data[at : at + 4] != b"\r\n\r\n":
                raise ValueError(f"a record does not end where its Content-Length says: {self.record['record_id']}")
            at += 4
            self.left = None
            self._end_of_record()
        self.held = data[at:]

    def close(self) -> None:
        if self.held.strip() or self.left is not None:
            raise ValueError("an archive ends within a record")
        self._flush(last=True)

    def _header(self, head: bytes) -> None:
        first, *lines = head.split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin; archives must be files that Spark does not split, such as .gz")
        f = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}
        self.left, self.block, self.declared_block = int(f["content-length"]), hashlib.sha1(), _hex(f.get("warc-block-digest"))
        number, origin = int(f.get("warc-segment-number", 0)), f.get("warc-segment-origin-id")
        r = self.record
        self.final = "warc-segment-total-length" in f or not number
        if r and origin == r["record_id"] and number == r["segment"] + 1:
            r["segment"] = number
            return
        self._flush(last=True)
        self.record = {
            "record_id": origin or f.get("warc-record-id"), "record_type": f.get("warc-type"), "target_uri": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to"),
            "declared_digest": _hex(f.get("warc-payload-digest")), "segment": number, "first_segment": number, "complete": number <= 1, "intact": True,
            "http": b"" if number <= 1 and f.get("content-type", "").startswith("application/http") else None,
            "chunk": 0, "n": 0, "sha": hashlib.sha1(), "payload": None,
        }

    def _body(self, part: bytes) -> None:
        r = self.record
        self.block.update(part)
        if r["http"] is not None:
            r["http"] += part
            end = r["http"].find(_HTTP_END)
            if end < 0 and len(r["http"]) < _HTTP_MOST:
                return
            part, r["http"] = r["http"][end + 4 if end >= 0 else 0 :], None
        if part:
            self._payload(part)

    def _payload(self, part: bytes) -> None:
        r = self.record
        if r["payload"] is not None:
            self._row(last=False)
        r["n"] += len(part)
        r["sha"].update(part)
        r["payload"] = part

    def _end_of_record(self) -> None:
        r = self.record
        r["intact"] &= self.declared_block in (None, self.block.hexdigest())
        if self.final:
            self._flush(last=True)

    def _flush(self, last: bool) -> None:
        r = self.record
        if r is None:
            return
        if r["http"]:  # too short for a header
            part, r["http"] = r["http"], None
            self._payload(part)
        r["complete"] &= self.final
        if r["complete"]:
            r["intact"] &= r["record_type"] == "revisit" or r["declared_digest"] in (None, r["sha"].hexdigest())
        self._row(last)
        self.record = None

    def _row(self, last: bool) -> None:
        r = self.record
        if last or self.with_payload or r["first_segment"] > 0:
            whole = last and r["complete"]
            keep = self.with_payload or r["first_segment"] > 0  # segments may have to be put together from several files
            self.out.append((
                r["record_id"], r["record_type"], r["target_uri"], r["refers_to"], r["declared_digest"], r["first_segment"], r["chunk"], last,
                r["payload"] if keep else None, r["n"], r["sha"].hexdigest() if whole else None, r["intact"], r["complete"] if last or not r["first_segment"] else None,
            ))
        r["chunk"] += 1
        r["payload"] = None

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(_FIELDS), _TYPES, strict=True)], names=_FIELDS)


_FIELDS = ["record_id", "record_type", "target_uri", "refers_to", "declared_digest", "segment", "chunk", "last", "payload", "payload_bytes", "payload_digest", "intact", "complete"]
_TYPES = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
CHUNKS = (
    "record_id string, record_type string, target_uri string, refers_to string, declared_digest string, segment long, chunk long, last boolean, "
    "payload binary, payload_bytes long, payload_digest string, intact boolean, complete boolean"
)


def _hex(digest: str | None) -> str | None:
    """A labelled SHA-1 digest, hexadecimal or base 32, in lower-case hexadecimal; null for another algorithm."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _parse(batches: Iterator[pa.RecordBatch], chunk: int, with_payload: bool) -> Iterator[pa.RecordBatch]:
    stream = _Stream(chunk, with_payload)
    for batch in batches:
        waiting, size = [], 0
        for line in batch.column(0).to_pylist():
            waiting.append(line)
            size += len(line)
            if size >= _PIECE:
                stream.feed(b"\n".join(waiting) + b"\n")
                waiting, size = [], 0
                if stream.out:
                    yield stream.rows()
        if waiting:
            stream.feed(b"\n".join(waiting) + b"\n")
        if stream.out:
            yield stream.rows()
    stream.close()
    yield stream.rows()


def warc_chunks(spark: SparkSession, path: str, chunk: int = SEGMENT, with_payload: bool = True) -> DataFrame:
    """The chunked record table of the archives in a folder (files that Spark does not split, such as .gz).

    A row for each chunk of a payload: record_id, record_type, target_uri, refers_to, declared_digest, segment (the first
    of the segments that stand in a row in one file; 0: not segmented), chunk (0, 1, ...), last, payload, payload_bytes
    (up to and with this chunk), payload_digest (SHA-1, on the last chunk of a complete payload), intact (no declared
    digest differs), complete (false: segments are missing here, null: not known yet). An empty payload is one row.
    Without payloads only last rows are returned, and the segments that other files may continue.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(lambda it: _parse(it, chunk, with_payload), CHUNKS)


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of each record's chunks, which come in order: only a running digest is held."""
    now, sha, done = None, None, []
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or r["record_id"] != now["record_id"]:
                if now:
                    done.append({**now, "payload_digest": sha.hexdigest()})
                now, sha = {k: r[k] for k in _TOTALS if k not in ("payload_digest", "payload_bytes")} | {"payload_bytes": 0}, hashlib.sha1()
            now["payload_bytes"] += len(r["payload"] or b"")
            now["intact"] &= r["intact"]
            sha.update(r["payload"] or b"")
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, _TOTALS_SCHEMA)
            done = []
    if now:
        done.append({**now, "payload_digest": sha.hexdigest()})
    yield pa.RecordBatch.from_pylist(done, _TOTALS_SCHEMA)


_TOTALS = ["record_id", "record_type", "target_uri", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "intact"]
_TOTALS_SCHEMA = pa.schema([(k, _TYPES[_FIELDS.index(k)]) for k in _TOTALS])


@tidy
def warc_payloads(spark: SparkSession, path: str, chunk: int = SEGMENT) -> DataFrame:
    """One row per record of the archives in a folder: record_id, record_type, target_uri, refers_to, declared_digest,
    payload_bytes, payload_digest, intact.

    Length and digest of what is stored come from one pass over each file; records whose segments stand in several files
    are put in order by (record, segment, chunk) and carried on from there; their ids must be unique. A revisit has no stored payload. No archives
    or empty ones give no rows; broken archives raise an error.
    """
    found = written(warc_chunks(spark, path, chunk, with_payload=False), "warc_chunks")
    apart = found.where(~F.col("complete")).select("record_id").distinct()
    whole = found.where(F.col("complete") & F.col("last")).select(*_TOTALS)
    split = found.join(apart, "record_id", "left_semi").where("complete is null or not complete")
    split = split.repartition("record_id").sortWithinPartitions("record_id", "segment", "chunk").select(*_FIELDS)
    split = split.mapInArrow(_carry, ", ".join(f"{k} {t}" for k, t in zip(_TOTALS, ["string"] * 5 + ["long", "string", "boolean"], strict=True)))
    return whole.unionByName(split)


@tidy
def archived_pages(pages: DataFrame, path: str, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html", segment: int = SEGMENT, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes pages as WARC archives to a new folder and reads them back: page_id, payload_bytes, payload_digest,
    record_type (response or revisit), refers_to (the page of a revisit's response), intact.

    Length and digest are of the full payload; a revisit takes its length from its response. See warc_records for nulls,
    ties and repeated rows; an empty table gives no rows.
    """
    spark = pages.sparkSession
    write_warc(warc_records(pages, id_column, uri_column, payload_column, segment, revisit_bytes), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d*):", 1).try_cast("long")
    found = warc_payloads(spark, path, segment)
    stored = found.where("record_type = 'response'")
    sizes = stored.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = found.where("record_type = 'revisit'").join(sizes, "refers_to", "left")
    columns = [page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"), "intact"]
    revisits = revisits.withColumns({"payload_bytes": F.col("full_bytes"), "payload_digest": F.col("declared_digest")})
    return stored.select(columns).unionByName(revisits.select(columns))
