"""Image headers, built here byte by byte."""

import struct
import zlib

import pytest

from sheafline.sources import images


def chunk(kind, data=b""):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(w, h, color=2, clear=False, late=False):
    middle = (chunk(b"pHYs", bytes(9)) + (chunk(b"tRNS", bytes(6)) if clear else b"")) + chunk(b"IDAT", b"x") + (chunk(b"tRNS") if late else b"")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + middle + chunk(b"IEND")


def exif(order, orientation, others=1):
    e = "<" if order == b"II" else ">"
    entries = b"".join(struct.pack(e + "HHI", 0x010F + 0x100 * i, 3, 1) + struct.pack(e + "HH", 7, 0) for i in range(others)) + struct.pack(e + "HHI", 0x0112, 3, 1) + struct.pack(e + "HH", orientation, 0)
    return b"Exif\0\0" + order + struct.pack(e + "HI", 42, 8) + struct.pack(e + "H", others + 1) + entries + bytes(4)


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def jpeg(w, h, *segments, frame=0xC2, fill=b""):
    return b"\xff\xd8" + b"".join(segments) + fill + segment(frame, struct.pack(">BHHB", 8, h, w, 3) + bytes(9)) + segment(0xDA, bytes(8)) + b"data\xff\xd9"


def tiff(order, entries):
    e = "<" if order == b"II" else ">"
    rows = b"".join(struct.pack(e + "HHI", tag, kind, n) + (struct.pack(e + "HH", v, 0) if kind == 3 else struct.pack(e + "I", v)) for tag, kind, n, v in entries)
    return order + struct.pack(e + "HI", 42, 8) + struct.pack(e + "H", len(entries)) + rows + bytes(4)


def webp(kind, payload):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(payload)) + b"WEBP" + kind + struct.pack("<I", len(payload)) + payload


def gif(w, h, *blocks):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0, 0, 0) + b"".join(blocks) + b";" + bytes(8)


CONTROL = lambda flags: b"!\xf9\x04" + bytes([flags, 0, 0, 0, 0])
FRAME = b"," + bytes(9)
lossless = lambda w, h: webp(b"VP8L", b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14) + bytes(12))
dib = lambda w, h, bits: b"BM" + bytes(12) + struct.pack("<IiiHH", 40, w, h, 1, bits) + bytes(24)
CASES = [  # content, mime, width, height, orientation, transparent, animated, error
    (png(2, 1, 6), "png", 2, 1, 1, True, False, None), (png(50_000, 40_000), "png", 50_000, 40_000, 1, False, False, None), (png(3, 4, clear=True), "png", 3, 4, 1, True, False, None), (png(3, 4, late=True), "png", 3, 4, 1, False, False, None),
    (png(9, 9)[:30], "png", None, None, 1, False, False, "truncated"), (png(0, 4), "png", None, None, 1, False, False, "invalid"),
    (jpeg(640, 480), "jpeg", 640, 480, 1, False, False, None), (jpeg(640, 480, segment(0xE0, b"JFIF\0" + bytes(9)), segment(0xE1, exif(b"II", 6))), "jpeg", 640, 480, 6, False, False, None), (jpeg(7, 8, segment(0xE1, exif(b"MM", 8, 5)), frame=0xC0), "jpeg", 7, 8, 8, False, False, None),
    (jpeg(7, 8, segment(0xE1, exif(b"II", 9))), "jpeg", 7, 8, 1, False, False, None), (jpeg(7, 8, segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0x")), "jpeg", 7, 8, 1, False, False, None), (jpeg(7, 8, segment(0xE1, exif(b"II", 3)[:20])), "jpeg", 7, 8, 1, False, False, None),
    (jpeg(7, 8, fill=b"\0\1" * 50), "jpeg", 7, 8, 1, False, False, None), (jpeg(7, 8, *[segment(0xE2, bytes(65_000))] * 20), "jpeg", 7, 8, 1, False, False, None), (b"\xff\xd8\xff\xe0\xff\xff\0", "jpeg", None, None, 1, False, False, "invalid"),
    (b"\xff\xd8" + segment(0xDA, bytes(8)), "jpeg", None, None, 1, False, False, "no-size"), (b"\xff\xd8", "jpeg", None, None, 1, False, False, "truncated"), (b"\xff\xd8" + segment(0xFE, b"") * 1100 + jpeg(7, 8)[2:], "jpeg", None, None, 1, False, False, "segments"),
    (gif(20, 10, FRAME), "gif", 20, 10, 1, False, False, None), (gif(20, 10, CONTROL(1), FRAME, CONTROL(0), FRAME), "gif", 20, 10, 1, True, True, None), (gif(20, 10, CONTROL(8), FRAME), "gif", 20, 10, 1, False, False, None), (b"GIF89a", "gif", None, None, 1, False, False, "truncated"),
    (webp(b"VP8X", bytes([0x12, 0, 0, 0]) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), "webp", 100, 50, 1, True, True, None), (lossless(513, 257), "webp", 513, 257, 1, True, False, None), (lossless(16384, 16384), "webp", 16384, 16384, 1, True, False, None),
    (webp(b"VP8 ", b"abc\x9d\x01\x2a" + struct.pack("<HH", 320 | 0x4000, 200) + bytes(9)), "webp", 320, 200, 1, False, False, None), (webp(b"VP8 ", bytes(40)), "webp", None, None, 1, False, False, "no-size"), (webp(b"ABCD", bytes(40)), "webp", None, None, 1, False, False, "no-size"),
    (dib(30, -20, 32), "bmp", 30, 20, 1, True, False, None), (dib(30, 20, 24), "bmp", 30, 20, 1, False, False, None), (b"BM" + bytes(12) + struct.pack("<IHHHH", 12, 5, 6, 1, 24) + bytes(9), "bmp", 5, 6, 1, False, False, None), (b"BM" + bytes(40), "bmp", None, None, 1, False, False, "unsupported"),
    (tiff(b"II", [(256, 3, 1, 70), (257, 4, 1, 80_000), (274, 3, 1, 5)]), "tiff", 70, 80_000, 5, False, False, None), (tiff(b"MM", [(256, 4, 1, 70), (257, 3, 1, 80), (274, 3, 1, 77)]), "tiff", 70, 80, 1, False, False, None),
    (tiff(b"II", [(256, 3, 2, 70), (257, 3, 1, 80)]), "tiff", None, None, 1, False, False, "invalid"), (b"II*\0" + struct.pack("<I", 9999) + bytes(20), "tiff", None, None, 1, False, False, "invalid"), (b"XX" + bytes(30), "tiff", None, None, 1, False, False, "invalid"), (b"x", "x", None, None, 1, False, False, "unsupported"),
]


def test_headers(spark):
    df = spark.createDataFrame([(i, bytearray(c[0]), f"image/{c[1]}") for i, c in enumerate(CASES)], "i int, content binary, mime string").repartition(3)
    got = {r.i: r.m for r in df.select("i", images.inspected(df["content"], df["mime"]).alias("m")).collect()}
    for i, (_, _, *want) in enumerate(CASES):
        assert [got[i][k] for k in ("width", "height", "orientation", "transparent", "animated", "error")] == want, (i, CASES[i][1:])
    assert [f"{k} {t}" for k, t in df.select(images.inspected(df["content"], df["mime"]).alias("m")).select("m.*").dtypes] == [x.strip().replace("long", "bigint") for x in images.FIELDS.split(",")]


def test_limits(spark):
    rows = [(1, png(4000, 3000), "png"), (2, png(8000, 6000), "png"), (3, png(12_001, 10), "png"), (4, b"<svg/>", "svg+xml"), (5, b"x" * 3000, "png"), (6, jpeg(30, 20, segment(0xE1, exif(b"II", 6))), "jpeg"), (7, b"no", "png")]
    df = spark.createDataFrame([("b", i, bytearray(c), f"image/{m}") for i, c, m in rows], "bundle_id string, seq int, content binary, mime string")
    got = {r.seq: r for r in images.image_meta(df, images.ImagePolicy(max_bytes=2000)).collect()}
    assert {i: r.code for i, r in got.items()} == {1: None, 2: "image-pixels", 3: "image-side", 4: "image-active", 5: "image-bytes", 6: None, 7: "image-truncated"}
    assert (got[6].shown_width, got[6].shown_height, got[1].shown_width) == (20, 30, 4000)
    with pytest.raises(ValueError):
        images.ImagePolicy(max_side=0)
