"""WARC archives with an index of their records, and indexed reads.

write() makes WARC/1.1 files, one per task, each with a warcinfo record and then its records, every record a gzip member of its own; and an index table
first and foremost: (file, offset, length, url, digest, page_id, record_type, refers_to, payload_bytes). Records whose payloads are equal are written
once, as the response of the largest page id; the others are revisit records with the payload's digest, the response's record id, URI and date, and no
payload. read() takes any rows of the index, sorts their byte ranges by file and offset, coalesces neighbours into few reads, and parses the records.

Equal payloads are found by SHA-1 and length with a pre-aggregated maximum per digest, over ids, URLs and digests alone. The join of the
two carries no payload; a digest that a third of the pages share makes a partition of small rows, which adaptive execution splits. Revisits are written
from that table, as they have no payload; the ids and digests that are revisits are stored as sorted arrays, and a scan of the pages writes
all others. So payloads are never shuffled, however many revisits there are.

Null payloads and urls are empty; of equal page ids with equal payloads all rows of the largest id are responses. Very long payloads are written whole. Empty
tables give an empty index. Other columns of the pages are not used. A file appears only when it is whole, so a rerun task replaces it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import sorted_ids
from spanloom.llm.bpe import blocks
from spanloom.llm.common import atomic_file, filesystem, materialise
from spanloom.llm.token_records import ranges

INDEX = ("file", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to", "payload_bytes")
INDEX_SCHEMA = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
RECORD_SCHEMA = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload_digest string, declared_bytes long, payload binary"
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str) -> str:
    """A header's value: white space and controls percent-encoded, so that it can't break the header."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _member(lines: list[str], body: bytes) -> bytes:
    """One record as a gzip member."""
    raw = ("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(raw) + coder.flush()


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{url}')}>"


def info(name: str) -> bytes:
    """The warcinfo record at the head of a file."""
    body = b"software: spanloom\r\nformat: WARC File Format 1.1\r\n"
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], body)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str = "", size: int | None = None) -> bytes:
    """A response record, or, if refers_to is given, a revisit one that refers to that page's response; size: of the payload, if it isn't at hand."""
    head = HTTP % (len(payload) if size is None else size)
    revisit = refers_to is not None
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}",
            f"WARC-Refers-To-Target-URI: {one_line(refers_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return _member([*lines, "Content-Type: application/http; msgtype=response"], head if revisit else head + payload)


def parse(member: bytes) -> dict:
    """Headers, HTTP head and payload of a gzip member that holds one record; ValueError if it is damaged."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    declared = int(http.rsplit(b"Content-Length: ", 1)[1])
    fields |= {"payload": payload, "declared": declared, "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    if fields["WARC-Type"] == "response" and (len(payload) != declared or digest_of(payload) != fields["digest"]):
        raise ValueError("the payload does not match its digest")
    return fields


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes archives and their index into folder; returns the index. Equal payloads of least_bytes or more are written once."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    digests = materialise(rows.select("page_id", "url", F.unhex(F.sha1("payload")).alias("sha1"), F.length("payload").cast("long").alias("bytes")), "warc-digests")
    large = digests.where(F.col("bytes") >= least_bytes)
    owners = large.groupBy("sha1", "bytes").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    owners = owners.select("sha1", "bytes", F.col("o.page_id").alias("owner"), F.col("o.url").alias("owner_url"))
    revisits = materialise(large.join(owners, ["sha1", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("owner"))), "warc-revisits")
    # The first eight bytes of the digest tell the payloads of one page id apart; pages without an id are told by two parts of it.
    part = lambda k: F.conv(F.hex(F.substring("sha1", k, 8)), 16, -10).cast("long")
    known = sorted_ids.store_pairs(revisits.select(F.coalesce("page_id", part(9)).alias("a"), F.when(F.col("page_id").isNull(), F.bitwise_not(part(1))).otherwise(part(1)).alias("b")))

    def responses(batches):
        from pyspark import TaskContext

        have, name = sorted_ids.loaded_pairs(known), f"pages-{TaskContext.get().partitionId():06d}.warc.gz"

        def members():
            for batch in batches:
                for block in blocks(batch, "payload"):
                    ids, urls, bodies = (c.to_pylist() for c in block.columns)
                    raw = [hashlib.sha1(x).digest() for x in bodies]
                    number = lambda d, k: int.from_bytes(d[k:k + 8], "big", signed=True)
                    a = np.array([number(d, 8) if i is None else i for i, d in zip(ids, raw)], np.int64)
                    b = np.array([~number(d, 0) if i is None else number(d, 0) for i, d in zip(ids, raw)], np.int64)
                    for page_id, address, data, sha, gone in zip(ids, urls, bodies, raw, have.has(a, b)):
                        if not gone:
                            digest = base64.b32encode(sha).decode()
                            yield record(page_id, address, data, digest, None), (address, digest, page_id, "response", None, len(data))

        yield from _written(folder, name, members())

    def repeats(batches):
        from pyspark import TaskContext

        def members():
            for batch in batches:
                for page_id, address, sha, size, owner, owner_url in zip(*(c.to_pylist() for c in batch.columns)):
                    digest = base64.b32encode(sha).decode()
                    yield record(page_id, address, b"", digest, owner, owner_url, size), (address, digest, page_id, "revisit", owner, size)

        yield from _written(folder, f"revisits-{TaskContext.get().partitionId():06d}.warc.gz", members())

    rows.mapInArrow(responses, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    # A join's order may differ from one attempt of a task to the next; sorted, every attempt writes the same file.
    ordered = revisits.select("page_id", "url", "sha1", "bytes", "owner", "owner_url").sortWithinPartitions("page_id", "url", "sha1")
    ordered.mapInArrow(repeats, INDEX_SCHEMA).write.mode("append").parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def _written(folder: str, name: str, members):
    """Writes (member, rest of its index row) pairs into one file, if there are any, and yields the index."""
    at, out, first = 0, [], next(members, None)
    if first is None:
        return
    with atomic_file(f"{folder}/warc", name) as stream:
        stream.write(head := info(name))
        at = len(head)
        for member, rest in itertools.chain([first], members):
            out.append((name, at, len(member), *rest))
            at += len(member)
            stream.write(member)
    for i in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i:i + 10_000]), _INDEX_TYPES)], names=list(INDEX))


_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_RECORD_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
_RECORD_NAMES = ["file", "offset", "page_id", "url", "record_type", "refers_to", "payload_digest", "declared_bytes", "payload"]


def read(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """The records of some rows of the index (all by default), with their payloads (empty for revisits).

    Ranges of a file are read in order of offset by one task; ranges that lie close together are read at once.
    """
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index") if index is None else index
    files = index.select("file").distinct().count()

    def run(batches):
        for batch in batches:
            names, offsets, lengths = (c.to_pylist() for c in batch.columns)
            cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(cut, cut[1:]):
                if i == j:
                    continue
                system, root = filesystem(f"{folder}/warc")
                with system.open_input_file(f"{root}/{names[i]}") as source:
                    at = i
                    for start, length, count in ranges(offsets[i:j], lengths[i:j]):
                        data, out = source.read_at(length, start), []
                        for k in range(at, at + count):
                            x = parse(data[offsets[k] - start:offsets[k] - start + lengths[k]])
                            page, refers = x["X-Page-ID"], x.get("X-Refers-To-Page-ID")
                            out.append((names[k], offsets[k], int(page) if page else None, x["WARC-Target-URI"], x["WARC-Type"], int(refers) if refers else None, x["digest"], x["declared"], x["payload"]))
                        at += count
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RECORD_TYPES)], names=_RECORD_NAMES)

    chosen = index.select("file", "offset", "length").repartition(max(1, files), "file").sortWithinPartitions("file", "offset")
    return chosen.mapInArrow(run, RECORD_SCHEMA)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS owner FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * i::INT, 5))::BIGINT >> (15 - 5 * k::INT)::INT) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to,
       CASE WHEN page_id IS NOT DISTINCT FROM owner THEN n ELSE 0 END AS stored_bytes
FROM o
"""
