import hashlib
import struct
import zlib

import numpy as np
import pytest

from gleaner.llm import media
from tests.llm.cases import documents, edge_rows


def test_every_text_comes_back(spark):
    rows = edge_rows()
    got = media.digests(media.read_media(media.with_media(documents(spark, rows)))).collect()

    def wanted(i, t):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        return (-1 if i is None else i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))

    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(wanted(*x) for x in rows)
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def _image(raw: bytes, width: int, height: int, colour: int) -> bytes:
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"a\0b") + media._chunk(b"IDAT", zlib.compress(raw)) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,channels", media.CHANNELS.items())
def test_all_row_filters(colour, channels):
    rng, width, height = np.random.default_rng(colour), 7, 11
    samples = rng.integers(0, 256, (height, width * channels), dtype=np.uint8)
    raw = bytearray()
    for y in range(height):
        kind = y % 5
        raw.append(kind)
        for x in range(width * channels):
            a = int(samples[y, x - channels]) if x >= channels else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - channels]) if y and x >= channels else 0
            p = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            raw.append((int(samples[y, x]) - [0, a, b, (a + b) // 2, p][kind]) % 256)
    got, n = media.decode(_image(bytes(raw), width, height, colour))
    assert n == channels and (got == samples).all()


def test_broken_images_are_told(spark):
    whole = media.encode(b"x" * 192)
    for broken in (b"", whole[:-5], whole[:40] + bytes([whole[40] ^ 1]) + whole[41:], b"GIF89a", _image(b"\0" * 5, 7, 11, 0), _image(b"\7" * 8, 7, 1, 0)):
        with pytest.raises(media.BrokenImage):
            media.decode(broken)
    rows = spark.createDataFrame([(1, 3, bytearray(whole)), (2, 0, None), (3, 0, bytearray(b"no"))], "doc_id bigint, n_bytes bigint, media binary")
    got = {r.doc_id: r for r in media.read_media(rows).collect()}
    assert got[1].error is None and bytes(got[1].payload) == b"x" * 192
    assert got[2].payload is None and got[2].error and got[3].feature is None and got[3].error


def _png(*chunks: tuple[bytes, bytes]) -> bytes:
    return media.SIGNATURE + b"".join(media._chunk(*c) for c in chunks)


@pytest.mark.parametrize("broken", [
    _png((b"IHDR", b"\0" * 5), (b"IDAT", zlib.compress(b"")), (b"IEND", b"")),
    _png((b"IHDR", struct.pack(">IIBBBBB", 0, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0")), (b"IEND", b"")),
    _png((b"IHDR", struct.pack(">IIBBBBB", 1, 0, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"")), (b"IEND", b"")),
    _png((b"IDAT", zlib.compress(b"\0a")), (b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IEND", b"")),
    _png((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(bytes(1 << 26))), (b"IEND", b"")),
    _png((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0a")), (b"IEND", b"")) + b"more",
    _png((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0a")[:-1]), (b"IEND", b"")),
    _png((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0a")), (b"tIME", b""), (b"IDAT", b""), (b"IEND", b"")),
    _png((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"NEWS", b""), (b"IDAT", zlib.compress(b"\0a")), (b"IEND", b"")),
    _png((b"IHDR", struct.pack(">IIBBBBB", 1 << 31, 1 << 31, 8, 6, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0a")), (b"IEND", b"")),
    _png((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IEND", b"")), _png(), _png((b"IEND", b"")),
])
def test_headers_orders_and_sizes_are_told(broken):
    with pytest.raises(media.BrokenImage):
        media.decode(broken)


def test_feature_is_the_corner_of_the_cosine_transform():
    samples = np.random.default_rng(1).integers(0, 256, (64, 192), dtype=np.uint8)
    grey = samples.reshape(64, 64, 3).sum(2).astype(float).reshape(32, 2, 32, 2).mean((1, 3))
    x = np.arange(32)
    low = np.array([[(grey * np.outer(np.cos(np.pi * u * (2 * x + 1) / 64), np.cos(np.pi * v * (2 * x + 1) / 64))).sum() for v in range(8)] for u in range(8)])
    ours = int(media.low_frequency_hash(samples, 3), 16)
    bits = int(np.packbits((low > np.median(low)).ravel()).tobytes().hex(), 16)
    flat = int(np.packbits((low > np.median(low)).T.ravel()).tobytes().hex(), 16)
    assert min((ours ^ bits).bit_count(), (ours ^ flat).bit_count()) <= 2


def test_empty_table(spark):
    assert media.digests(media.read_media(media.with_media(documents(spark, [])))).count() == 0
