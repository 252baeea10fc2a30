"""Documents as PNG images in binary columns, and perceptual hashes of them.

The writer and the reader are complete for 8-bit greyscale: signature, chunks with CRC tests,
zlib streams, all five row filters. Everything runs in Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE, held_by, only, slices, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Side of the block of low-frequency coefficients that make up the hash.
LOW = 8
STRIP = 4096


class PngError(ValueError):
    """A stored image that breaks the format: bad signature, length, checksum or filter."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A (height, width) array of bytes as a PNG; one filter of none, sub and up for the whole image.

    The filter is the one whose residuals, read as signed bytes, have the least sum; ties go
    to the first of the three, so equal images give equal files.
    """
    height, width = samples.shape
    left, above = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    above[1:] -= samples[:-1]
    options = (samples, left, above)
    best = min(range(3), key=lambda k: (int(np.abs(options[k].view(np.int8).astype(np.int16)).sum(dtype=np.int64)), k))
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = best, options[best]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc_ else b if pb <= pc_ else c


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of a (height, 1 + width) array of one-byte samples.

    Runs of rows with one filter are undone together: none is a copy, sub a running sum along
    rows, up a running sum down the run. Average and Paeth depend on each sample before.
    """
    height, width = rows.shape[0], rows.shape[1] - 1
    kinds, out = rows[:, 0], np.empty((height, width), np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for begin, end in zip(np.r_[0, edges], np.r_[edges, height], strict=True) if height else ():
        kind, part = int(kinds[begin]), rows[begin:end, 1:]
        over = out[begin - 1] if begin else np.zeros(width, np.uint8)
        if kind == 0:
            out[begin:end] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[begin:end])
        elif kind == 2:
            np.cumsum(part, axis=0, dtype=np.uint8, out=out[begin:end])
            out[begin:end] += over
        elif kind in (3, 4):
            up = over.tolist()
            for y in range(begin, end):
                a, c, line = 0, 0, []
                for x, v in enumerate(rows[y, 1:].tolist()):
                    b = up[x]
                    a = (v + ((a + b) // 2 if kind == 3 else _paeth(a, b, c))) & 255
                    c = b
                    line.append(a)
                out[y], up = line, line
        else:
            raise PngError(f"unknown row filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise PngError("not a PNG signature")
    at, size, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise PngError("truncated chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data):
            raise PngError("truncated chunk")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise PngError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, method, filters, interlace) != (8, 0, 0, 0, 0):
                raise PngError("only 8-bit greyscale without interlacing is read")
            size = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise PngError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if size is None or not ended:
        raise PngError("header or end is missing")
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != size[0] * (size[1] + 1):
        raise PngError("the samples do not fill the image")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


@lru_cache(maxsize=64)
def _cosines(n: int) -> np.ndarray:
    """The first LOW rows of the orthonormal cosine transform (type II) of length n."""
    k, x = np.arange(LOW)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def dct_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine coefficients exceed the median of all but the first.

    Tall images are summed in strips, so temporaries stay small.
    """
    height, width = samples.shape
    part = np.zeros((LOW, width))
    if height <= STRIP:
        part = _cosines(height) @ samples.astype(np.float64)
    else:
        k = np.arange(LOW)[:, None]
        scale = np.full((LOW, 1), np.sqrt(2 / height))
        scale[0] = np.sqrt(1 / height)
        for y in range(0, height, STRIP):
            rows = samples[y : y + STRIP].astype(np.float64)
            x = np.arange(y, y + len(rows))[None, :]
            part += (np.cos(np.pi * (2 * x + 1) * k / (2 * height)) * scale) @ rows
    low = (part @ _cosines(width).T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def text_payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def store_images(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, image): each whole text as a 64-sample-wide greyscale PNG in a binary column.

    Null texts count as empty and give one row of zeros. Repeated rows and null keys are kept as
    they are. An empty table gives an empty table; further columns are ignored. A text must fit one
    row of a Spark binary column (2 GB).
    """
    base = only(documents, key, text)
    kind = base.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                data, at = utf8(part, text)
                images = []
                for begin, end in zip(at[:-1], at[1:], strict=True):
                    payload = text_payload(data[begin:end].tobytes())
                    images.append(encode_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
                yield pa.RecordBatch.from_arrays(
                    [held_by(part, key), pa.array(np.diff(at)), pa.array(images, pa.binary())], ["key", "n_bytes", "image"]
                )

    return base.mapInArrow(run, f"key {kind.simpleString()}, n_bytes long, image binary").withColumnRenamed("key", key)


def image_features(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored images hold, read back: payload size and digests, and the cosine hash.

    Input (key, n_bytes, image). Broken images raise :class:`PngError`; a null image gives nulls.
    """
    kind = images.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for image in held_by(batch, "image"):
                blob = image.as_py()
                if blob is None:
                    rows.append((None,) * 6)
                    continue
                samples = decode_png(blob)
                payload = samples.tobytes()
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                    len(blob), hashlib.sha256(blob).hexdigest(), dct_hash(samples),
                ))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [held_by(batch, key), held_by(batch, "n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return images.select(key, "n_bytes", "image").mapInArrow(run, schema).withColumnRenamed("key", key)
