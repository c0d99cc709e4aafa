"""WARC archives: a writer with deduplicating revisit records, and a splittable reader.

A reader task owns the records that start in its byte range. It looks for the gzip magic, takes a candidate for a
member only if it decodes to a WARC header, and reads owned members to their end, past the range if need be.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import cut, shared_dir

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "file string, offset long, type string, record_id string, refers_to string, target_uri string, digest string, payload binary, payload_length long"


def _filesystem(uri: str):
    """A file system that driver and executors reach, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        raise ValueError(f"{uri!r} names no file system; give an address such as file:///folder or hdfs://host/folder")
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def member(kind: str, record_id: str, uri: str | None, digest: bytes | None, body: bytes, date: str, refers_to: str | None = None, content: str = "application/http; msgtype=response") -> bytes:
    """One record as a gzip member of its own."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", quote(uri, safe="%:/?#[]@!$&'()*+,;=-._~")))
    if digest is not None:
        head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if refers_to is not None:
        head += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", content), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + body + b"\r\n\r\n") + packer.flush()


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Window:
    """Bytes of a file from `start` on, read in pieces as they are asked for; what lies before `drop` is given up."""

    def __init__(self, file, start: int, size: int, piece: int = 1 << 20) -> None:
        self.file, self.base, self.size, self.piece, self.data = file, start, size, piece, bytearray()

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.base + len(self.data)
        if have < end:
            self.file.seek(have)
            self.data += self.file.read(min(self.size, max(end, have + self.piece)) - have)

    def drop(self, at: int) -> None:
        if at - self.base > 4 * self.piece:
            del self.data[: at - self.base]
            self.base = at

    def find(self, at: int, end: int) -> int:
        """Start of the first magic in [at, end), or -1."""
        while at < end:
            stop = min(end, at + self.piece)
            self.upto(stop + len(MAGIC) - 1)
            hit = self.data.find(MAGIC, at - self.base, stop + len(MAGIC) - 1 - self.base)
            if hit >= 0:
                return self.base + hit
            at = stop
            self.drop(at)
        return -1


def read_member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at a position, and where the member ends; None if no record starts there."""
    unpack, out, pos, sure = zlib.decompressobj(31), bytearray(), at, False
    try:
        while not unpack.eof:
            window.upto(pos + (65536 if sure else 4096))
            chunk = bytes(window.data[pos - window.base : pos - window.base + (65536 if sure else 4096)])
            if not chunk:
                return None
            out += unpack.decompress(chunk)
            pos += len(chunk)
            if not sure and (len(out) >= 7 or unpack.eof):
                if not out.startswith(b"WARC/1."):
                    return None
                sure = b"\r\n\r\n" in out
                if not sure and len(out) > 1 << 20:
                    return None
    except zlib.error:
        return None
    end = pos - len(unpack.unused_data)
    window.upto(end + len(MAGIC))
    follows = bytes(window.data[end - window.base : end - window.base + len(MAGIC)])
    return (bytes(out), end) if b"\r\n\r\n" in out and follows in (b"", MAGIC) else None


def parse(record: bytes) -> tuple:
    """(type, record_id, refers_to, target_uri, digest as hex, payload, payload_length) of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    body = rest[: int(fields.get("content-length", 0))]
    payload, length = body, len(body)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = body.partition(b"\r\n\r\n")
        length = int(_fields(http).get("content-length", len(payload)))
    digest = fields.get("warc-payload-digest")
    if digest and digest.startswith("sha1:"):
        digest = base64.b32decode(digest[5:]).hex()
    kind = fields.get("warc-type")
    return kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), digest, None if kind == "revisit" else payload, length


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple]:
    """(offset, *parse(record)) of the records that start in [start, end)."""
    window, at = _Window(file, start, size), start
    while (at := window.find(at, min(end, size))) >= 0:
        found = read_member(window, at)
        if found is None:
            at += 1
            continue
        yield (at, *parse(found[0]))
        at = found[1]
        window.drop(at)


def revisits(pages: DataFrame, least: int = 1000, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages as (key, url, payload text, digest, length, refers_to): refers_to is the response that a copy revisits.

    Of payloads of at least `least` bytes that are equal (by SHA-1), those with the largest key are responses. Rows
    that repeat the largest key, rows with a null key and shorter payloads are responses too.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("k"), F.col("url").alias("url"), text.alias("payload"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("length"))
    marks = rows.filter(F.col("length") >= least).select("k", "digest")
    copied = marks.groupBy("digest").agg(F.max("k").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    later = marks.join(copied, "digest").filter("k < first").select("k", "digest", F.col("first").alias("refers_to")).distinct()
    return rows.join(later, ["k", "digest"], "left")


def write(pages: DataFrame, folder: str, least: int = 1000, key: str = "page_id", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a WARC file per task into folder; returns its files as (file, size, records).

    A file counts once its task has returned it, under a name no other attempt has, so lost executors and repeated
    tasks leave at most files that nothing refers to. An empty table gives no record.
    """

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        size = records = 0
        with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
            first = member("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", None, None, b"software: loomspark\r\n", date, content="application/warc-fields")
            out.write(first)
            size += len(first)
            for batch in batches:
                for k, url, payload, digest, length, refers in batch[["k", "url", "payload", "digest", "length", "refers"]].itertuples(index=False):
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
                    copy = isinstance(refers, str)
                    body = http if copy else http + payload.encode()
                    data = member("revisit" if copy else "response", f"<urn:x-page:{k}>", url, bytes.fromhex(digest), body, date, f"<urn:x-page:{refers}>" if copy else None)
                    out.write(data)
                    size += len(data)
                    records += 1
        yield pd.DataFrame({"file": [f"{folder}/{name}"], "size": [size], "records": [records]})

    rows = revisits(pages, least, key, html)
    held = F.when(F.col("refers_to").isNull(), F.col("payload"))
    ready = rows.select(F.coalesce(F.col("k").cast("string"), F.lit("null")).alias("k"), "url", held.alias("payload"), "digest", "length", F.col("refers_to").cast("string").alias("refers"))
    return cut(ready.mapInPandas(store, "file string, size long, records long"))


def read(spark: SparkSession, files: DataFrame, split: int = 8 << 20) -> DataFrame:
    """The records of the files (file, size), each once, whatever the split; warcinfo records included.

    Columns: RECORD_SCHEMA. A revisit has no payload; its payload_length is that of the HTTP header it keeps.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for name, size, start in batch.itertuples(index=False):
                fs, path = _filesystem(name)
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for offset, kind, rid, refers, uri, digest, payload, length in records_in(file, size, start, start + split):
                        rows.append((name, offset, kind, rid, refers, uri, digest, payload, length))
                        held += len(payload or b"")
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=names)

    starts = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    count = max(1, int(starts.count()))
    return starts.repartition(min(count, 100_000)).mapInPandas(scan, RECORD_SCHEMA)


def scratch(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
