"""WARC archives: a writer with revisit records and a splittable reader.

Writer: each task writes one ``.warc.gz`` file, every record a gzip member of its own. A task that runs
again writes a file of another name; the manifest names the files of the attempts that counted. Payloads
of LEAST_REVISIT bytes or more that are equal are stored once, in the record with the largest page_id;
the others become revisit records of the identical-payload-digest profile.

Reader: the archives are cut into byte ranges; a task scans its range for the gzip magic, decodes the
head of each candidate member to see whether a WARC record begins there, and owns the records whose
members start inside its range. No index and no record boundary need to be known beforehand. Nothing
larger than a chunk and one record is held.

What a row says of a response is counted and hashed from the payload that was read; a header that says
otherwise is an error. A revisit has no payload, so its header is held against the response it refers to.

Null html is the empty payload. A null page_id is kept as null and refers to nothing by number. Rows
with the same page_id and payload can't be told apart: both are responses. Files are reached through
pyarrow's file systems, by the scheme of the shared folder's URI.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.runtime import dropped, partitions, removed, steady, stored, table_path

LEAST_REVISIT = 1000
MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
SPLIT_BYTES = 8 << 20
ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(lines.encode() + block + b"\r\n\r\n") + z.flush()


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    name = lambda x: f"<{ID}{'' if x is None else x}>"
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return member(head, http + payload)
    return member([*head, ("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)], http)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds refers_to: null for records that hold their payload. Equal payloads are found by digest:
    a partial aggregate of ids, then an equi-join on the digest, which may be split where one is hot."""
    marked = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n"))
    keepers = marked.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("k")).where("k > 1").select("digest", "keeper")
    links = marked.where(F.col("n") >= LEAST_REVISIT).select("page_id", "digest").join(keepers, "digest").where("page_id < keeper").select("page_id", "digest", "keeper").distinct()
    return marked.join(links.withColumnRenamed("keeper", "refers_to"), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive for each task that has rows; returns path, bytes, records, stored."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        task = TaskContext.get()
        path = f"{at}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        records = size = 0
        with fs.open_output_stream(path, compression=None) as out:
            for b in batches:
                for page_id, url, html, refers in zip(b.page_id, b.url, b.html, b.refers_to, strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    none = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) else x
                    data = record(none(page_id), url, payload, hashlib.sha1(payload).hexdigest(), none(refers))
                    out.write(data)
                    records, size = records + 1, size + len(data)
        if records:
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [records]})
        else:
            fs.delete_file(path)

    text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  ids travel as text, so nulls and large numbers stay as they are
    return stored(pages.select(text("page_id"), "url", "html", text("refers_to")).mapInPandas(write, "path string, bytes long, records long"), "manifest")


class Corrupt(ValueError):
    pass


def parse_record(data: bytes) -> dict:
    """The fields of a record. Size and digest are those of the payload; only a revisit, which has none,
    is taken at its word."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    ident = lambda k: fields.get(k, "").removeprefix(f"<{ID}").removesuffix(">") or None
    name, size = ident("warc-record-id"), int(fields["content-length"])
    if len(block) < size:
        raise Corrupt(f"record {name} holds {len(block)} bytes instead of {size}")
    http, _, payload = block[:size].partition(b"\r\n\r\n")
    said = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") != "revisit":
        found = hashlib.sha1(payload).hexdigest()
        if (said, digest) != (len(payload), found):
            raise Corrupt(f"the payload of record {name} is {len(payload)} bytes with digest {found}, its heads say {said} and {digest!r}")
    return {
        "page_id": name, "url": fields.get("warc-target-uri"), "payload_bytes": said, "payload_digest": digest,
        "record_type": fields.get("warc-type"), "refers_to": ident("warc-refers-to"), "payload": payload,
    }


def record_at(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The record of the gzip member at a place and the member's end, or None where no WARC record
    begins: the bytes there only look like the magic. Damage after a valid head is an error, never a
    lost record."""
    z, out, pos, step, valid = zlib.decompressobj(31), b"", at, 4096, False
    parts: list[bytes] = []
    while pos < size and not z.eof:
        f.seek(pos)
        data = f.read(min(step, size - pos))
        pos, step = pos + len(data), min(4 * step, CHUNK)
        try:
            got = z.decompress(data)
        except zlib.error as e:
            if valid:
                raise Corrupt(f"damaged record at byte {at}") from e
            return None
        parts.append(got)
        if not valid:
            out += got
            if len(out) >= 7 or z.eof:
                if not out.startswith(b"WARC/1."):
                    return None
                valid = True
    if valid and not z.eof:
        raise Corrupt(f"record at byte {at} is cut off")
    return (b"".join(parts), pos - len(z.unused_data)) if valid else None


def records_in(f, start: int, end: int, size: int) -> Iterator[bytes]:
    """The records whose members start in [start, end). Payloads are UTF-8, which can't hold the magic,
    so nothing inside a member that began before the range decodes as a record."""
    at = start
    while at < end:
        f.seek(at)
        data = f.read(min(CHUNK, end + len(MAGIC) - 1 - at, size - at))
        i, after = data.find(MAGIC), at + max(1, len(data) - len(MAGIC) + 1)
        while i >= 0 and at + i < end:
            if found := record_at(f, at + i, size):
                yield found[0]
                if (i := found[1] - at) >= len(data):
                    after = max(after, found[1])
                    break
                i = data.find(MAGIC, i)
            else:
                i = data.find(MAGIC, i + 1)
        at = after


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False, folder: str = "") -> DataFrame:
    """Reads the archives of a manifest back, a task for each byte range."""
    splits = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("bytes") - 1), F.lit(split_bytes).cast("long"))).alias("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = file_system(folder)[0]
        for b in batches:
            for path, size, start in zip(b.path, b.bytes, b.start, strict=True):
                with fs.open_input_file(path) as f:
                    rows = []
                    for data in records_in(f, start, min(size, start + split_bytes), size):
                        rows.append(parse_record(data))
                        if not payloads:
                            del rows[-1]["payload"]
                        if len(rows) >= 256:
                            yield pd.DataFrame(rows)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return splits.repartition(partitions(spark)).mapInPandas(read, schema + (", payload binary" if payloads else ""))


def check_revisits(records: DataFrame) -> None:
    whole = records.where("record_type <> 'revisit'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    lost = records.where("record_type = 'revisit'").join(whole, ["refers_to", "payload_bytes", "payload_digest"], "left_anti").select("page_id").take(1)
    if lost:
        raise Corrupt(f"record {lost[0].page_id} revisits no response with its payload")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder, reads them back from the bytes. Fails if a
    revisit's size and digest aren't those of the response that it refers to."""
    spark = pages.sparkSession
    steady(spark)
    kind = dict(pages.dtypes)["page_id"]
    folder = table_path(spark, "warc")
    manifest = write_archives(with_revisits(pages), folder)
    back = stored(read_archives(spark, manifest, folder=folder), "records")
    check_revisits(back)
    dropped(manifest)
    removed(spark, folder)  # nothing reads the archives any more
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")
