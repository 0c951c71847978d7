"""Sizes, orientation and flags of images from their headers, as expressions over the bytes.

Formats that chain segments (PNG, JPEG) are walked by a fold whose state is a place in the file and what was seen so far;
directories of tags (EXIF, TIFF) are arrays of their entries. Numbers are read from slices of a few bytes, so a file is never
copied, but for searches that the format itself asks for (frames of GIF, the start code of WebP).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Segments that a walk follows at most; a file with more has the error `segments`.
SEGMENTS = 1024
#: JPEG markers of frames that state the size, PNG color types with transparency, the tags of size and orientation.
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
CLEAR_TYPES = (4, 6)
WIDTH, HEIGHT, ORIENTATION = 256, 257, 274
FIELDS = "width long, height long, orientation int, transparent boolean, animated boolean, label string, error string"


def _slice(content: Column, at, n) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.substr(content, (at + 1).cast("int"), (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def big(content: Column, at, n: int) -> Column:
    """A number of n bytes, the highest first; places count from 0."""
    return F.conv(F.hex(_slice(content, at, n)), 16, 10).cast("long")


def little(content: Column, at, n: int) -> Column:
    out = big(content, at, 1)
    for i in range(1, n):
        out = out + big(content, at + i, 1) * (1 << 8 * i)
    return out


def _either(content: Column, is_little: Column, at, n: int) -> Column:
    return F.when(is_little, little(content, at, n)).otherwise(big(content, at, n))


def _bound(values: dict[str, Column], use) -> Column:
    """use over a struct whose fields are computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), 0)


def _found(width=None, height=None, label="", orientation=1, transparent=False, animated=False, error=None) -> Column:
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    values = {"width": (width, "long"), "height": (height, "long"), "orientation": (orientation, "int"), "transparent": (transparent, "boolean"), "animated": (animated, "boolean"), "label": (label, "string"), "error": (error, "string")}
    return F.struct(*[lit(x, kind).alias(k) for k, (x, kind) in values.items()])


def _failed(label: str, error: str) -> Column:
    return _found(label=label, error=error)


def _walk(start: dict[str, Column], step) -> Column:
    """Fold step(state) until state.done; what is not done after SEGMENTS steps stays so."""
    state = F.struct(*[v.alias(k) for k, v in start.items()])
    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), state, lambda s, _: F.when(s["done"], s).otherwise(step(s)))


def png(c: Column) -> Column:
    size = F.octet_length(c).cast("long")

    def step(s: Column) -> Column:
        kind = _slice(c, s["at"] + 4, 4).cast("string")
        there = s["at"] + 12 <= size
        return F.struct(
            (s["at"] + 12 + big(c, s["at"], 4)).alias("at"), (s["clear"] | (there & (kind == "tRNS"))).alias("clear"), (~there | kind.isin("IDAT", "IEND")).alias("done"))

    walked = _walk({"at": F.lit(8).cast("long"), "clear": big(c, 25, 1).isin(*CLEAR_TYPES), "done": F.lit(False)}, step)
    seen = _bound({"w": walked}, lambda x: F.when(~x["w"]["done"], _failed("PNG", "segments")).otherwise(_found(big(c, 16, 4), big(c, 20, 4), "PNG", transparent=x["w"]["clear"])))
    return F.when(size < 33, _failed("PNG", "truncated")).otherwise(seen)


def _entries(c: Column, base: Column, end: Column, is_little: Column, ifd: Column) -> Column:
    """Places of the entries of a directory at ifd that lie whole before end."""
    n = F.least(_either(c, is_little, ifd, 2), F.floor((end - ifd - 2) / 12))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: ifd + 2 + i * 12)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _exif(c: Column, at: Column, size: Column) -> Column:
    """The orientation that an EXIF segment with its payload at a place states, or 1."""
    tiff, end = at + 6, at + size
    order = _slice(c, tiff, 2).cast("string")
    is_little = order == "II"
    ifd = tiff + _either(c, is_little, tiff + 4, 4)

    def of(x: Column) -> Column:
        hit = F.get(F.filter(_entries(c, tiff, end, x["little"], x["ifd"]), lambda e: _either(c, x["little"], e, 2) == ORIENTATION), 0)
        return _bound({"v": _either(c, x["little"], hit + 8, 2)}, lambda y: F.when(y["v"].between(1, 8), y["v"]).otherwise(1))

    good = (size >= 14) & (F.hex(_slice(c, at, 6)) == "457869660000") & order.isin("II", "MM") & (ifd + 2 <= end)
    return F.when(good, _bound({"little": is_little, "ifd": ifd}, of)).otherwise(1).cast("int")


def jpeg(c: Column) -> Column:
    size = F.octet_length(c).cast("long")
    state = lambda at, orientation, frame, error, done: F.struct(at.cast("long").alias("at"), orientation.alias("orientation"), frame.cast("long").alias("frame"), error.cast("string").alias("error"), done.alias("done"))
    null, no, yes = F.lit(None), F.lit(False), F.lit(True)

    def step(s: Column) -> Column:
        at, turned = s["at"], s["orientation"]
        head = F.hex(_slice(c, at, 4))
        marker = F.conv(F.substring(head, 3, 2), 16, 10).cast("int")
        length = F.conv(F.substring(head, 5, 4), 16, 10).cast("long")
        skipped = F.instr(F.decode(_slice(c, at, 1 << 16), "ISO-8859-1"), "ÿ").cast("long")  # to the next byte FF
        exif = F.when(marker == 0xE1, _exif(c, at + 4, length - 2)).otherwise(turned)
        return (
            F.when(at + 4 > size, state(at, turned, null, null, yes))
            .when(F.substring(head, 1, 2) != "FF", state(at + F.when(skipped > 0, skipped - 1).otherwise(1 << 16), turned, null, null, no))
            .when(marker.isin(0xD8, 0xD9), state(at + 2, turned, null, null, no))
            .when(marker == 0xDA, state(at, turned, null, null, yes))
            .when((length < 2) | (at + 2 + length > size), state(at, turned, null, F.lit("invalid"), yes))
            .when(marker.isin(*FRAMES), F.when(length < 8, state(at, turned, null, F.lit("truncated"), yes)).otherwise(state(at, turned, at + 4, null, yes)))
            .otherwise(state(at + 2 + length, exif, null, null, no))
        )

    walked = _walk({"at": F.lit(2).cast("long"), "orientation": F.lit(1), "frame": null.cast("long"), "error": null.cast("string"), "done": no}, step)

    def of(x: Column) -> Column:
        w = x["w"]
        error = F.when(~w["done"], "segments").when(w["error"].isNotNull(), w["error"]).when(w["frame"].isNull(), "no-size")
        return F.when(error.isNotNull(), _found(label="JPEG", error=error)).otherwise(_found(big(c, w["frame"] + 3, 2), big(c, w["frame"] + 1, 2), "JPEG", w["orientation"]))

    return F.when(size < 4, _failed("JPEG", "truncated")).otherwise(_bound({"w": walked}, of))


def gif(c: Column) -> Column:
    """Frames and clear colors are counted by their marks, wherever these stand behind the header."""
    size = F.octet_length(c)
    text = F.decode(_slice(c, 13, F.greatest(size - 17, F.lit(0))), "ISO-8859-1")
    odd = "".join(chr(b) for b in range(1, 256, 2) if chr(b) not in "[]^&-\\")
    clear = text.rlike(f"!ù\u0004(?:[{odd}]|[\\[\\]\\-])")
    marks = _slice(c, 13, F.greatest(size - 20, F.lit(0)))
    frames = F.length(F.decode(marks, "ISO-8859-1")) - F.length(F.replace(F.decode(marks, "ISO-8859-1"), F.lit(","), F.lit("")))
    return F.when(size < 13, _failed("GIF", "truncated")).otherwise(_found(little(c, 6, 2), little(c, 8, 2), "GIF", transparent=clear, animated=frames > 1))


def webp(c: Column) -> Column:
    size = F.octet_length(c)
    kind = _slice(c, 12, 4).cast("string")
    bits = little(c, 21, 4)
    lossless = _bound({"b": bits}, lambda x: _found(1 + x["b"].bitwiseAND(0x3FFF), 1 + F.shiftright(x["b"], 14).bitwiseAND(0x3FFF), "WebP lossless", transparent=True))
    code = F.locate("\u009d\u0001*", F.decode(c, "ISO-8859-1"), 24)  # the start code of a key frame, behind its tag of three bytes

    def lossy(x: Column) -> Column:
        there = (x["code"] > 0) & (x["code"] + 5 < size)
        return F.when(there, _found(little(c, x["code"] + 2, 2).bitwiseAND(0x3FFF), little(c, x["code"] + 4, 2).bitwiseAND(0x3FFF), "WebP lossy")).otherwise(_failed("WebP", "no-size"))

    flags = big(c, 20, 1)
    extended = _found(1 + little(c, 24, 3), 1 + little(c, 27, 3), "WebP", transparent=flags.bitwiseAND(16) > 0, animated=flags.bitwiseAND(2) > 0)
    return F.when(size < 30, _failed("WebP", "truncated")).when(kind == "VP8X", extended).when(kind == "VP8L", lossless).when(kind == "VP8 ", _bound({"code": code}, lossy)).otherwise(_failed("WebP", "no-size"))


def bmp(c: Column) -> Column:
    header = little(c, 14, 4)
    signed = lambda at: F.abs(F.when(little(c, at, 4) >= 1 << 31, little(c, at, 4) - (1 << 32)).otherwise(little(c, at, 4)))
    old = _found(little(c, 18, 2), little(c, 20, 2), "BMP", transparent=little(c, 24, 2) == 32)
    new = _found(signed(18), signed(22), "BMP", transparent=little(c, 28, 2) == 32)
    return F.when(F.octet_length(c) < 30, _failed("BMP", "truncated")).when(header < 12, _failed("BMP", "unsupported")).when(header == 12, old).otherwise(new)


def tiff(c: Column) -> Column:
    """Sizes are values of one number; the last entry of a tag counts."""
    size = F.octet_length(c).cast("long")
    order = _slice(c, 0, 2).cast("string")
    ifd = _either(c, order == "II", 4, 4)

    def of(x: Column) -> Column:
        read = lambda at, n: _either(c, x["little"], at, n)
        one = lambda e: F.when(read(e + 4, 4) != 1, 0).when(read(e + 2, 2) == 3, read(e + 8, 2)).when(read(e + 2, 2) == 4, read(e + 8, 4)).otherwise(0)
        rows = F.transform(_entries(c, F.lit(0), size, x["little"], x["ifd"]), lambda e: F.struct(read(e, 2).alias("tag"), one(e).alias("value")))

        def use(y: Column) -> Column:
            last = lambda tag, ok: F.try_element_at(F.filter(y["rows"], lambda r: (r["tag"] == tag) & ok(r["value"])), F.lit(-1))["value"]
            of_any = lambda tag: F.coalesce(last(tag, lambda v: v.isNotNull()), F.lit(0).cast("long"))
            return _found(of_any(WIDTH), of_any(HEIGHT), "TIFF", F.coalesce(last(ORIENTATION, lambda v: v.between(1, 8)), F.lit(1)))

        return _bound({"rows": rows}, use)

    good = _bound({"little": order == "II", "ifd": ifd}, lambda x: F.when(x["ifd"] + 2 > size, _failed("TIFF", "invalid")).otherwise(of(x)))
    return F.when(size < 16, _failed("TIFF", "truncated")).when(~order.isin("II", "MM"), _failed("TIFF", "invalid")).otherwise(good)


FORMATS = {"image/png": png, "image/jpeg": jpeg, "image/gif": gif, "image/webp": webp, "image/bmp": bmp, "image/tiff": tiff}


def inspected(content: Column, mime: Column) -> Column:
    """struct of FIELDS: size and flags as the header states them, or an error: truncated, invalid, no-size, unsupported, segments; a size without an extent is invalid."""
    out = None
    for name, read in FORMATS.items():
        out = F.when(mime == name, read(content)) if out is None else out.when(mime == name, read(content))
    out = out.otherwise(_failed("", "unsupported"))
    flat = lambda x: x["error"].isNull() & ~F.coalesce((x["width"] > 0) & (x["height"] > 0), F.lit(False))
    return F.get(F.transform(F.array(out), lambda x: F.when(flat(x), F.struct(*[F.lit(None).cast("long").alias(k) if k in ("width", "height") else F.lit("invalid").alias(k) if k == "error" else x[k].alias(k) for k in ("width", "height", "orientation", "transparent", "animated", "label", "error")])).otherwise(x)), 0)


@dataclass(frozen=True)
class ImagePolicy:
    max_bytes: int = 50 << 20
    max_pixels: int = 40_000_000
    max_side: int = 12_000

    def __post_init__(self):
        if min(self.max_bytes, self.max_pixels, self.max_side) < 1:
            raise ValueError("limits must be positive")


def image_meta(files: DataFrame, policy: ImagePolicy = ImagePolicy(), keys: tuple[str, ...] = ("bundle_id", "seq")) -> DataFrame:
    """keys, mime, size and flags, oriented size, and the first limit that an image (content, mime) breaks: image-bytes, image-active (drawings with scripts), an error of its header, image-pixels, image-side."""
    rows = files.select(*keys, "mime", F.octet_length("content").cast("long").alias("bytes"), F.when(F.octet_length("content") <= policy.max_bytes, F.col("content")).alias("content"))
    rows = rows.withColumn("i", F.when(F.col("content").isNotNull(), inspected(F.col("content"), F.col("mime"))))
    w, h = F.col("i.width"), F.col("i.height")
    code = (
        F.when(F.col("bytes") > policy.max_bytes, "image-bytes").when(F.col("mime") == "image/svg+xml", "image-active").when(F.col("i.error").isNotNull(), F.concat(F.lit("image-"), "i.error"))
        .when(w * h > policy.max_pixels, "image-pixels").when(F.greatest(w, h) > policy.max_side, "image-side")
    )
    turned = F.col("i.orientation") >= 5
    return rows.select(*keys, "mime", "i.label", "i.width", "i.height", "i.orientation", "i.transparent", "i.animated", F.when(turned, h).otherwise(w).alias("shown_width"), F.when(turned, w).otherwise(h).alias("shown_height"), code.alias("code"))
