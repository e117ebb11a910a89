"""Media columns: payloads in progressive JPEG files, and RGB tensors out of them.

A payload is stored losslessly in the unit of the format, the quantised coefficient: each byte less 128 is one
coefficient, with all quantisers 1 and chroma planes of half the resolution.  Reading accumulates the scans of the
file into coefficient arrays, which give back the bytes, and transforms them to a full-resolution RGB tensor
(``lexiloom.llm.jpeg``).  Payloads over ``SHEET`` bytes take several files, so that memory stays bounded however long a
text is.

``media_digests`` keeps everything it makes in tables of the shared folder: the files; then, from the files as they are
read back, the tensors and the digests of payload and file; then, from the tensors as they are read back, the features.
Files and tensors take about 3.4 bytes for each byte of text, so the documents pass in up to ``PARTS`` parts, by a hash
of id and text, and the tables of a part go when its features are written.

Defined results: null and empty texts have a payload of one unit of filling; equal texts give equal files, tensors and
features in any batch; rows with a null file give null tensors; an empty table gives an empty result; columns other
than the id and the text (or file) are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import jpeg
from lexiloom.llm.common import drop_written, prepare, spread, text_of, written

UNIT, FILL = 576, b"\xff"
SHEET = UNIT * 1024
#: Payload bytes encoded and decoded together: arrays of the first stay in a cache, loops of the second need many lanes.
WRITTEN, READ = 256 << 10, 4 << 20
#: Parts of the documents at most, and bytes of text under which a table is not cut.
PARTS, PART_BYTES = 6, 4 << 20
SAMPLING = ((2, 2), (1, 1), (1, 1))


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + FILL * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _square(size: int) -> jpeg.Geometry:
    units = -(-size // 384)  # six blocks of 64
    across = math.isqrt(units - 1) + 1
    return jpeg.Geometry(16 * across, 16 * -(-units // across), SAMPLING)


def write_files(sheets: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload."""
    images = [_square(len(s)) for s in sheets]
    bases = np.cumsum([0, *(g.blocks for g in images)])
    coefs = np.zeros((int(bases[-1]), 64), dtype=np.int64)
    for s, g, base in zip(sheets, images, bases, strict=False):
        order = g.order((0, 1, 2))[0] + base
        data = np.frombuffer(s, dtype=np.uint8).astype(np.int64) - 128
        coefs[order[: len(data) // 64]] = data.reshape(-1, 64)
    return jpeg.encode(coefs, images, comments=[b"payload bytes %d" % len(s) for s in sheets])


def read_files(raw: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, RGB tensor) of each file that ``write_files`` made."""
    files = [jpeg.parse(x) for x in raw]
    coefs, bases = jpeg.coefficients(files)
    out = []
    for f, a, b in zip(files, bases, bases[1:], strict=False):
        mine = coefs[a:b]
        size = int(f.comments[0].split()[-1])
        data = mine[f.geometry.order((0, 1, 2))[0]].reshape(-1)[:size] + 128
        out.append((data.astype(np.uint8).tobytes(), jpeg.pixels(f, mine)))
    return out


def batches_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if held:
        yield start, len(sizes)


def files_of(texts: list[str]) -> list[list[bytes]]:
    """The files of each text."""
    payloads = [payload_of(t) for t in texts]
    sheets = [(i, p[x : x + SHEET]) for i, p in enumerate(payloads) for x in range(0, len(p), SHEET)]
    out: list[list[bytes]] = [[] for _ in texts]
    for a, b in batches_of([len(s) for _, s in sheets], WRITTEN):
        for (i, _), f in zip(sheets[a:b], write_files([s for _, s in sheets[a:b]]), strict=True):
            out[i].append(f)
    return out


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_bytes`` of the text and ``files`` (array of binary) of every row.  Narrow: no shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            for a, b in batches_of([max(n, UNIT) for n in sizes], READ):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sizes[a:b], type=pa.int64()), pa.array(files_of(texts[a:b]), type=pa.list_(pa.binary()))], names=[id_col, "n_bytes", "files"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col), text_of(text_col).alias("text"))).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, files array<binary>")


DIGESTS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
_DIGEST_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
_TENSOR = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])


def read_back(files: list[list[bytes]]) -> list[tuple[tuple, list[dict]]]:
    """(digests of payload and files, RGB tensors) of each text's files."""
    out = []
    flat = [(i, f) for i, some in enumerate(files) for f in some]
    back, media = [hashlib.sha256() for _ in files], [hashlib.sha256() for _ in files]
    n_back, tail, tensors = [0] * len(files), [b""] * len(files), [[] for _ in files]
    for a, b in batches_of([len(f) for _, f in flat], READ):
        for (i, file), (payload, rgb) in zip(flat[a:b], read_files([f for _, f in flat[a:b]]), strict=True):
            back[i].update(payload)
            media[i].update(file)
            n_back[i] += len(payload)
            tail[i] = (tail[i] + payload)[-32:]
            tensors[i].append({"height": rgb.shape[0], "width": rgb.shape[1], "rgb": rgb.tobytes()})
    for i, some in enumerate(files):
        out.append(((n_back[i], back[i].hexdigest(), zlib.crc32(tail[i]), sum(map(len, some)), media[i].hexdigest()), tensors[i]))
    return out


def store_tensors(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digests and the ``tensors`` of every row of what ``store_payloads`` made."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2).to_pylist()
            for a, b in batches_of([sum(map(len, f)) for f in files], READ):
                found = read_back(files[a:b])
                digests = [pa.array(c, type=t) for c, t in zip(zip(*(d for d, _ in found), strict=True), _DIGEST_KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *digests, pa.array([t for _, t in found], type=pa.list_(_TENSOR))], names=[id_col, "n_bytes", *DIGESTS, "tensors"])

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors array<struct<height:int,width:int,rgb:binary>>"
    return media.select(id_col, "n_bytes", "files").mapInArrow(run, schema)


def feature_of(tensors: list[dict]) -> str:
    """Size, sums of the channels and CRC-32 of each tensor."""
    out = []
    for t in tensors:
        total = np.frombuffer(t["rgb"], dtype=np.uint8).reshape(-1, 3).sum(axis=0, dtype=np.int64)
        out.append(f"{t['width']}x{t['height']}:{total[0]},{total[1]},{total[2]}:{zlib.crc32(t['rgb']):08x}")
    return ";".join(out)


def features(tensors: DataFrame) -> DataFrame:
    """``tensors`` with a ``feature`` in place of each row's tensors."""

    @F.arrow_udf("string")
    def feature(some: pa.Array) -> pa.Array:
        return pa.array([feature_of(x.as_py()) for x in some], type=pa.string())

    return tensors.withColumn("feature", feature("tensors")).drop("tensors")


def rgb_tensors(media: DataFrame, id_col: str, file_col: str) -> DataFrame:
    """id, height, width and ``rgb`` (binary, height * width * 3 bytes) of every row's progressive JPEG file."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                rgb = None if raw is None else jpeg.decode(raw)
                h, w = (None, None) if rgb is None else rgb.shape[:2]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.array([h], type=pa.int32()), pa.array([w], type=pa.int32()), pa.array([None if rgb is None else rgb.tobytes()], type=pa.binary())], names=[id_col, "height", "width", "rgb"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, file_col).mapInArrow(run, f"`{id_col}` {kind}, height int, width int, rgb binary")


def _few(size: int) -> int:
    """In how many parts a table of so many bytes passes."""
    return max(1, min(PARTS, size // PART_BYTES))


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text's payload, reads the stored bytes back, stores their tensors and digests what it has read.  No shuffle."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = _few(size)
    out = []
    for part in range(parts):
        mine = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)) == part)
        files = written(store_payloads(mine, id_col, text_col), "files")
        tensors = written(store_tensors(files, id_col), "tensors")
        out.append(written(features(tensors), "features"))
        drop_written(files)
        drop_written(tensors)
    return reduce(DataFrame.unionByName, out)
