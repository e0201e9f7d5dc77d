"""WARC archives, read by an index of offsets that is made as they are written."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A file is closed once it has this many bytes. Reads of one file are joined over gaps up to GAP, up to MOST bytes.
FILE_BYTES, GAP, MOST = 64 << 20, 64 << 10, 4 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, url string, payload_digest string, record_type string, file string, offset bigint, length bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member that holds a response record, or a revisit record where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_uri(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The page id, url, type, digest, size, payload (None for a revisit) and refers_to of a record; its length and digest are verified."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(x[len("<urn:page:") : -1] or -1) if x and x != "<urn:page:>" else None
    named = field["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = field["WARC-Type"] == "response"
    if whole and (len(payload) != size or digest(payload) != named):
        raise ValueError("the payload does not match its digest")
    return {"page_id": number(field["WARC-Record-ID"]), "url": field.get("WARC-Target-URI"), "record_type": field["WARC-Type"], "payload_digest": named, "payload_bytes": size, "payload": payload if whole else None, "refers_to": number(field.get("WARC-Refers-To"))}


def write(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for each page (page_id, url, html) into archives under folder; return the index (INDEX), which is written too.

    Null html is an empty payload, a null url or page_id leaves its field empty. Of pages with equal payloads of at least
    least_revisit bytes, those of the largest page_id are responses and the others revisit it. A file belongs to one attempt
    of one task, so a task that runs again leaves no half file in the index.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("__sha", F.sha1("payload"))
    equal = rows.where(F.octet_length("payload") >= least_revisit).groupBy("__sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1").select("__sha", "first")
    typed = rows.join(common.saved(equal, "warc-equal"), "__sha", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    if not folder.startswith("/") and "://" not in folder and not folder.startswith("file:"):
        raise ValueError("folder must be an absolute path or a URI")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        number, out, name = 0, None, ""
        for batch in batches:
            index: list[tuple] = []
            columns = [batch.column(x) for x in ("page_id", "url", "payload", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, number = store.open_output_stream(f"{root}/{name}", compression=None), number + 1
                member = record(page_id, url, payload, refers_to)
                index.append((page_id, url, digest(payload), "response" if refers_to is None else "revisit", name, out.tell(), len(member)))
                out.write(member)
                if out.tell() >= FILE_BYTES:
                    out.close()
                    out = None
            names = [x.split()[0] for x in INDEX.split(", ")]
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True) if index else [[]] * 7, types, strict=True)], names=names)
        if out is not None:
            out.close()

    return common.saved(typed.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, where: Column | None = None) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload of the indexed records that `where` selects.

    Records are sorted by file and offset, and neighbouring byte ranges of a file are fetched by one read.
    """
    chosen = (index if where is None else index.where(where)).select("file", "offset", "length")
    schema = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, source = None, None

        def fetched(group: list[tuple[str, int, int]]) -> pa.RecordBatch:
            nonlocal name, source
            if group[0][0] != name:
                name, source = group[0][0], store.open_input_file(f"{root}/{group[0][0]}")
            base = group[0][1]
            data = source.read_at(group[-1][1] + group[-1][2] - base, base)
            found = [parse(data[o - base : o - base + n]) for _, o, n in group]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in types.items()], names=list(types))

        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (file != group[0][0] or offset - group[-1][1] - group[-1][2] > GAP or offset + length - group[0][1] > MOST):
                    yield fetched(group)
                    group = []
                group.append((file, offset, length))
        if group:
            yield fetched(group)

    files = chosen.agg(F.countDistinct("file")).first()[0]  # index rows are few, what they name is not: so many tasks as files
    return chosen.repartition(max(1, files), "file").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive the pages and read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or common.new_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
