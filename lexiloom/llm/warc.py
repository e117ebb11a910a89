"""Web archives with a Zstandard dictionary.

An archive holds WARC 1.1 records.  Its first frame is a skippable frame with a dictionary trained on the archive's
own records; each record follows as a frame of its own, compressed with that dictionary, so a reader can start at any
record.  Archives are bounded in size and stored as rows (name, n_records, content) of a table in the shared folder:
Spark's writer commits them whole or not at all, and any store that Spark reads will do.  ``export`` makes files.

Of records with equal payloads (by length and SHA-256 digest) of at least ``min_bytes``, the one with the largest id is
the response; the others are revisit records that refer to it and hold no payload.

Defined results: a null payload is empty; a null URL becomes ``urn:unknown``; rows that repeat the largest id are
responses all, and rows that repeat an id share its record id; records with a null id revisit a group's largest id, and are responses where the group has none; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import join_by_key, prepare, text_of, written

#: Frame magics of the Zstandard format, and the type of skippable frame that holds a dictionary (fixed values).
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES, DICT_BYTES, LEVEL = 8 << 20, 32 << 10, 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record, a response or (with ``refers_to``) a revisit."""
    name = "none" if key is None else str(key)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:unknown'}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and block of one record; raises if lengths or the payload's digest are wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("the payload differs from its digest")
    key = lambda x: None if x in (None, "<urn:page:none>") else int(x[10:-1])
    return {"id": key(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "url": fields["WARC-Target-URI"], "bytes": size, "digest": digest, "refers_to": key(fields.get("WARC-Refers-To")), "payload": payload}


def _dictionary(records: list[bytes], size: int):
    import zstandard

    try:
        return zstandard.train_dictionary(size, records, k=1024, d=8)
    except zstandard.ZstdError:  # too few records to train on: their own bytes are the dictionary
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes], dict_bytes: int = DICT_BYTES, level: int = LEVEL) -> bytes:
    """An archive of the records."""
    import zstandard

    d = _dictionary(records, dict_bytes)
    c = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
    raw = d.as_bytes()
    return SKIPPABLE.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw + b"".join(map(c.compress, records))


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends."""
    import zstandard

    head = bytes(data[at : at + 18])
    if head[:4] != FRAME:
        raise ValueError("no frame here")
    checked = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checked


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    import zstandard

    data = memoryview(content)
    if int.from_bytes(data[:4], "little") != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary")
    at = 8 + int.from_bytes(data[4:8], "little")
    raw = bytes(data[8:at])
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    while at < len(data):
        end = frame_end(data, at)
        yield d.decompress(data[at:end])
        at = end


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The table of archives (name, n_records, content) of all rows of ``pages``, in the shared folder."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_of(payload_col).alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    same = written(rows.groupBy("sha", "size").agg(F.max("id").alias("response"), F.count("*").alias("n")), "payloads")
    total = same.agg(F.sum("n")).first()[0] or 0
    dealt = join_by_key(rows, same, ["sha", "size"], "n", total)
    revisit = (F.col("size") >= min_bytes) & F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    dealt = dealt.select("id", "url", "payload", F.when(revisit, F.col("response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def archive() -> pa.RecordBatch:
            nonlocal held, size, made
            out = pa.RecordBatch.from_arrays([pa.array([f"pages-{part:05d}-{made:05d}.warc.zst"]), pa.array([len(held)], type=pa.int64()), pa.array([pack(held)], type=pa.binary())], names=["name", "n_records", "content"])
            held, size, made = [], 0, made + 1
            return out

        for batch in batches:
            for key, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = text.encode()
                held.append(record(key, url, payload, refers_to, sha1_base32(payload)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
        if held:
            yield archive()

    return written(dealt.mapInArrow(run, "name string, n_records long, content binary"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to (and url and payload)."""
    prepare(archives.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if with_payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string(), pa.binary()] if with_payload else [])]
    keys = ["id", "bytes", "digest", "type", "refers_to", "url", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found: list[list] = []
                for data in unpack(content.as_py()):
                    x = parse(data)
                    found.append([x[k] for k in keys[: len(names)]])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if with_payload else "")
    return archives.select("content").mapInArrow(run, schema)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write the archives as files to a local folder, one after the other."""
    out = []
    for row in archives.select("name", "content").toLocalIterator():
        path = Path(folder) / row.name
        path.write_bytes(row.content)
        out.append(str(path))
    return out
