"""Media columns: texts' bytes as PNG images in a binary column, read back and hashed by their low frequencies.

A PNG here is written and read by its chunks (length, kind, data, CRC-32), with zlib for the samples. The
writer uses row filters None, Sub and Up in turn; the reader undoes all five with numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import short_batches

#: PNG signature; colour type and channels of its kinds.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH, ROW = 64, 192
#: Bytes of samples in one IDAT chunk.
IDAT_BYTES = 1 << 16
#: Bytes of samples that an image may have: as many as a binary value.
MOST = (1 << 31) - 1
#: Side of the grey thumbnail and of its low-frequency corner.
SIDE, LOW = 32, 8


class BrokenImage(ValueError):
    """Bytes that aren't a whole PNG of 8-bit samples."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """An RGB image of 64 pixels a row from a positive multiple of 192 bytes."""
    if not payload or len(payload) % ROW:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = np.arange(len(rows)) % 3
    out[:, 1:] = rows
    out[1::3, 4:] = rows[1::3, 3:] - rows[1::3, :-3]
    out[2::3, 1:] = rows[2::3] - rows[1:-1:3][: len(rows[2::3])]
    packed = zlib.compress(out.tobytes(), 1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    parts = [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(parts) + _chunk(b"IEND", b"")


def unfilter(raw: np.ndarray, channels: int) -> np.ndarray:
    """Samples of filtered rows (each with its filter's number first)."""
    kinds = raw[:, 0]
    if kinds.max(initial=0) > 4:
        raise BrokenImage("unknown row filter")
    if (kinds > 2).any():
        return _by_diagonals(raw, channels)
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    flat = kinds == 0
    out[flat] = raw[flat, 1:]
    sub = kinds == 1
    if sub.any():
        out[sub] = np.add.accumulate(raw[sub, 1:].reshape(int(sub.sum()), -1, channels), axis=1, dtype=np.uint8).reshape(int(sub.sum()), -1)
    for i in np.flatnonzero(kinds == 2):
        out[i] = raw[i, 1:] + (out[i - 1] if i else 0)
    return out


def _by_diagonals(raw: np.ndarray, channels: int) -> np.ndarray:
    """As unfilter, for all filters: a pixel needs those left of it, above it and between, so a diagonal of pixels is undone at once."""
    kinds, pixels = raw[:, 0], raw[:, 1:].reshape(len(raw), -1, channels).astype(np.int16)
    height, width = pixels.shape[:2]
    done = np.zeros((height + 1, width + 1, channels), np.int16)
    for d in range(height + width - 1):
        i = np.arange(max(0, d - width + 1), min(height, d + 1))
        j = d - i
        left, up, corner = done[i + 1, j], done[i, j + 1], done[i, j]
        far = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
        nearest = np.choose(far.argmin(0), [left, up, corner])  # the first of equals, as the format has it
        told = np.choose(kinds[i][:, None], [np.zeros_like(left), left, up, (left + up) // 2, nearest])
        done[i + 1, j + 1] = (pixels[i, j] + told) & 255
    return done[1:, 1:].reshape(height, -1).astype(np.uint8)


def _chunks(image: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, data) of each chunk; lengths and checksums are tested, and that the end is the end."""
    if image[: len(SIGNATURE)] != SIGNATURE:
        raise BrokenImage("no PNG signature")
    at, found = len(SIGNATURE), []
    while at < len(image):
        if at + 12 > len(image):
            raise BrokenImage("a chunk is cut off")
        size, kind = struct.unpack_from(">I4s", image, at)
        data, check = image[at + 8 : at + 8 + size], image[at + 8 + size : at + 12 + size]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(kind + data):
            raise BrokenImage(f"the checksum of {kind!r} is wrong")
        found.append((kind, data))
        at += 12 + size
    return found


def decode(image: bytes) -> tuple[np.ndarray, int]:
    """(samples by row, channels) of a PNG with 8-bit samples.

    Checksums, lengths, the order of chunks and the number of samples are tested; whatever is amiss is a
    BrokenImage. No more is inflated than the header's size allows.
    """
    chunks = _chunks(image)
    kinds = [k for k, _ in chunks]
    if kinds[:1] != [b"IHDR"] or kinds.count(b"IHDR") > 1 or len(chunks[0][1]) != 13:
        raise BrokenImage("no header, or not one at the start")
    if kinds[-1] != b"IEND" or kinds.count(b"IEND") > 1 or chunks[-1][1]:
        raise BrokenImage("no end, or something after it")
    places = [i for i, k in enumerate(kinds) if k == b"IDAT"]
    if not places or places[-1] - places[0] >= len(places):
        raise BrokenImage("no samples, or samples in several places")
    if any(k[:1].isupper() and k not in (b"IHDR", b"PLTE", b"IDAT", b"IEND") for k in kinds):
        raise BrokenImage("a chunk that can't be left out is unknown")
    width, height, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    if not width or not height:
        raise BrokenImage("an image without width or height")
    if depth != 8 or colour not in CHANNELS or packing or filtering or interlace:
        raise BrokenImage("only 8-bit samples without palette or interlace are read")
    channels = CHANNELS[colour]
    size, inflate = height * (width * channels + 1), zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(chunks[i][1] for i in places), min(size + 1, MOST))
    except zlib.error as e:
        raise BrokenImage(str(e)) from e
    if len(raw) != size or not inflate.eof or inflate.unused_data:
        raise BrokenImage("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), channels), channels


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_COSINES = _cosines(SIDE)


def low_frequency_hash(samples: np.ndarray, channels: int) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine coefficients of the grey thumbnail exceed their median.

    The thumbnail takes the mean of each of 32 x 32 areas (rows and columns repeat in smaller images). Sums
    are whole numbers, so equal images have equal hashes everywhere.
    """
    grey = samples.reshape(len(samples), -1, channels)[:, :, : min(channels, 3)].sum(2, dtype=np.int64)
    for _ in range(2):  # rows, then columns
        n = len(grey)
        edge = np.arange(SIDE) * n // SIDE
        size = np.maximum((np.arange(SIDE) + 1) * n // SIDE - edge, 1)
        if n >= SIDE:
            grey = np.add.reduceat(grey, edge, axis=0) * 4096 // size[:, None]
        else:
            grey = grey[edge] * 4096
        grey = grey.T
    low = np.round(_COSINES @ (grey / 2.0**24) @ _COSINES.T, 6)
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes (none for null), blank-padded to a positive multiple of 192."""
    raw = (text or "").encode()
    return raw + b" " * (max(-(-len(raw) // ROW), 1) * ROW - len(raw))


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): the text of every row of docs(doc_id, text) as an image.

    Null and empty texts are an image of 192 blanks; equal texts have equal images; repeated rows stay; an
    empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def read_media(rows: DataFrame) -> DataFrame:
    """rows(doc_id, n_bytes, media) with what the stored bytes hold: adds payload, feature and error.

    Bytes that aren't a whole PNG, or null, give a null payload and feature, and the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, features, errors = [], [], []
            for media in b.column(2).to_pylist():
                try:
                    samples, channels = decode(media or b"")
                    found = samples.tobytes(), low_frequency_hash(samples, channels), None
                except BrokenImage as e:
                    found = None, None, str(e)
                for to, x in zip((payloads, features, errors), found, strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(errors, pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature", "error"])

    short_batches(rows.sparkSession)
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary, payload binary, feature string, error string")


def digests(rows: DataFrame) -> DataFrame:
    """Lengths and checksums in place of the bytes of read_media."""
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).cast("bigint").alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature")
