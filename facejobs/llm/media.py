"""Media columns: texts as PNG images in a binary column, and hashes of their low frequencies.

The stored form is PNG: signature, IHDR, IDAT chunks of bounded size, IEND, each with its
CRC-32. Readers test every checksum, inflate (zlib tests Adler-32), undo the row filters with
NumPy, and hash the low-frequency block of a discrete cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facejobs.llm import common

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 18
#: Side of the thumbnail and of its block of low frequencies.
SIDE, LOW = 32, 8

_k = np.arange(SIDE)
_COS = np.sqrt(2 / SIDE) * np.cos(np.pi * (2 * _k[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))
_COS[0] /= np.sqrt(2)


class PngError(ValueError):
    """The bytes are not a PNG of the kind stored here, or a checksum differs."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload(text: bytes) -> bytes:
    """``text`` with zero bytes appended up to a positive multiple of ``WIDTH``."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def encode_png(samples: bytes, level: int = 6) -> bytes:
    """8-bit greyscale PNG, ``WIDTH`` samples a row.

    One row filter for the image: of none, sub and up the one with the least sum of absolute
    signed residuals. ``samples`` is a positive multiple of ``WIDTH`` long.
    """
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    sub, up = x.copy(), x.copy()
    sub[:, 1:] -= x[:, :-1]
    up[1:] -= x[:-1]
    kind, rows = min(((k, r) for k, r in enumerate((x, sub, up))), key=lambda p: int(np.abs(p[1].view(np.int8).astype(np.int16)).sum(dtype=np.int64)))
    raw = np.empty((len(x), WIDTH + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = kind, rows
    data = zlib.compress(raw.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(x), 8, 0, 0, 0, 0)
    idat = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + idat + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo PNG row filters (one byte a pixel), a run of rows with the same filter at a time."""
    out = np.empty_like(rows)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
    for a, b in zip(cuts, cuts[1:]):
        kind, before = kinds[a], out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == 0:
            out[a:b] = rows[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8) + before
        elif kind in (3, 4):
            for r in range(a, b):
                above = (out[r - 1] if r else np.zeros(rows.shape[1], np.uint8)).astype(int)
                left = corner = 0
                for c in range(rows.shape[1]):
                    if kind == 3:
                        guess = (left + above[c]) // 2
                    else:
                        p = left + above[c] - corner
                        guess = min((abs(p - v), k, v) for k, v in enumerate((left, above[c], corner)))[2]
                    corner, left = above[c], int(rows[r, c]) + int(guess) & 255
                    out[r, c] = left
        else:
            raise PngError(f"row filter {kind}")
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples (height, width) of an 8-bit greyscale PNG without interlacing; all checksums tested."""
    if png[:8] != SIGNATURE:
        raise PngError("signature")
    at, head, data, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise PngError("cut short")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(png):
            raise PngError("cut short")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise PngError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0) or not ended:
        raise PngError("not 8-bit greyscale, or without end")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise PngError(str(e)) from e
    if raw.size != head[1] * (head[0] + 1):
        raise PngError("size")
    raw = raw.reshape(head[1], head[0] + 1)
    return _unfilter(raw[:, 0], raw[:, 1:])


def _shrink(x: np.ndarray) -> np.ndarray:
    """Mean over a SIDE x SIDE grid of cells; images lower or narrower than that repeat their lines."""
    for axis in (0, 1):
        n = x.shape[axis]
        if n < SIDE:
            x = np.take(x, np.arange(SIDE) * n // SIDE, axis=axis).astype(np.float64)
        else:
            edges = np.arange(SIDE + 1) * n // SIDE
            x = np.add.reduceat(x, edges[:-1], axis=axis, dtype=np.float64) / np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
    return x


def dct_hash(samples: np.ndarray) -> bytes:
    """8 bytes: for each of the 64 low frequencies but the mean, whether it lies over their median."""
    low = (_COS @ _shrink(samples) @ _COS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def store(docs: DataFrame, text: str = "text", out: str = common.RESULT) -> DataFrame:
    """Adds struct ``out``: ``n_bytes`` long and ``png`` binary of each row's whole text.

    Null text counts as empty; an empty text gives one row of zeros. Other columns pass
    unchanged; an empty table stays empty.
    """

    @F.arrow_udf("n_bytes long, png binary")
    def to_png(column: pa.Array) -> pa.Array:
        raw = [x.encode() for x in common.texts(column)]
        return common.struct(n_bytes=pa.array(map(len, raw), pa.int64()), png=pa.array((encode_png(payload(x)) for x in raw), pa.binary()))

    return docs.withColumn(out, to_png(F.col(text)))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, feature_bytes binary"


def features(media: DataFrame, png: str = "png", out: str = common.RESULT) -> DataFrame:
    """Adds struct ``out`` with :data:`FEATURES` of each stored image; a null image gives nulls.

    A damaged image raises :class:`PngError`, so the job fails rather than passing wrong bytes on.
    """

    @F.arrow_udf(FEATURES)
    def read(column: pa.Array) -> pa.Array:
        rows = []
        for x in column:
            if (stored := x.as_py()) is None:
                rows.append(None)
                continue
            samples = decode_png(stored)
            data, hashed = samples.tobytes(), dct_hash(samples)
            rows.append({
                "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-WIDTH:]),
                "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": hashed.hex(), "feature_bytes": hashed,
            })
        kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("feature_bytes", pa.binary())]
        return pa.array(rows, pa.struct(kinds))

    return media.withColumn(out, read(F.col(png)))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: store every document as PNG in the shared folder, read it back, digest it."""
    common.small_batches(spark)
    stored = store(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", f"{common.RESULT}.*")
    media = common.stage(stored, "media", compression="none")
    return features(media).select("doc_id", "n_bytes", f"{common.RESULT}.*").drop("feature_bytes")
