"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about FRAME_BYTES, each an independent Zstandard frame; a bundle ends with a seek table in
a skippable frame (the published seekable format: compressed and decompressed size of each frame). The index maps each
record's id to its bundle and frame and to its offset and length inside the decompressed frame; archives are read through
it, whole or record by record. Bundles are binary values of bounded size in a written table, so any store that Spark
reaches can hold them.

Null and empty payloads are response records of no bytes; payloads shorter than `least` are never revisits; among equal
payloads the largest id is the response, so there are no ties; pages with a null id are responses and are never referred
to; ids are taken to be unique, repeated rows get a record each; a payload of any length is one record in a frame of its
own, held whole by its task; an empty table gives no bundles; columns other than those named are not read, so their
names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import join_hot, written

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLE_BYTES, FRAME_BYTES = 4 << 20, 64 << 10
LEAST_REVISIT = 1000


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """Compressed and decompressed size of each frame, from the end of the bundle."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at = len(bundle) - 9 - 8 * n
    return list(struct.iter_unpack("<II", bundle[at : at + 8 * n]))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """A WARC/1.1 record; a revisit has no payload but the digest and length of the whole one."""
    block = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").rstrip(">") if urn else ""
    return int(number) if number else None


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, sha1, refers_to. Only ids and digests are shuffled to find equal payloads, and ids to mark revisits."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    digests = rows.filter(F.octet_length("payload") >= least).select("page_id", F.sha2("payload", 256).alias("key"))
    digests = written(digests.filter("page_id is not null"), "warc-digests")
    groups = digests.groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = join_hot(digests, written(groups, "warc-groups"), ["key"], "n", digests.count()).filter("page_id <> last")
    revisits = written(revisits.select("page_id", "key", F.col("last").alias("refers_to")).distinct(), "warc-revisits")
    keyed = rows.withColumns({"sha1": F.sha1("payload"), "key": F.when(F.octet_length("payload") >= least, F.sha2("payload", 256))})
    # joined by id as well, so that a frequent payload is no frequent key
    return keyed.join(revisits, ["page_id", "key"], "left").select("page_id", "url", "payload", "sha1", "refers_to")


ENTRIES = "array<struct<page_id:long,frame:int,offset:long,length:long,raw_length:long,inner:long,size:long>>"
ENTRY = ("page_id", "frame", "offset", "length", "raw_length", "inner", "size")


def write_bundles(rows: DataFrame, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """bundle (name), data and entries (the index) of each archive, written once to the shared folder."""
    kind = pa.list_(pa.struct([(c, pa.int32() if c == "frame" else pa.int64()) for c in ENTRY]))

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        entries: list[dict] = []
        open_: list[tuple[int, bytes]] = []  # ids and records of the frame that is being filled
        held = filled = 0

        def close_frame():
            nonlocal held, filled
            frames.append(compressor.compress(b"".join(r for _, r in open_)))
            inner = 0
            for page, r in open_:
                entries.append(dict(zip(ENTRY, (page, len(sizes), held, len(frames[-1]), filled, inner, len(r)), strict=True)))
                inner += len(r)
            sizes.append((len(frames[-1]), filled))
            held += len(frames[-1])
            open_.clear()
            filled = 0

        def close():
            nonlocal held
            data = b"".join([*frames, seek_table(sizes)])
            name = f"{uuid.UUID(bytes=hashlib.sha256(data).digest()[:16])}.warc.zst"
            out = pa.record_batch([pa.array([name]), pa.array([data], pa.binary()), pa.array([entries], kind)], names=["bundle", "data", "entries"])
            for x in (frames, sizes, entries):
                x.clear()
            held = 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    open_.append((r["page_id"], record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["sha1"])))
                    filled += len(open_[-1][1])
                    if filled >= frame_bytes:
                        close_frame()
                        if held >= bundle_bytes:
                            yield close()
        if open_:
            close_frame()
        if frames:
            yield close()

    rows = rows.select("page_id", "url", "payload", "sha1", "refers_to")
    return written(rows.mapInArrow(run, f"bundle string, data binary, entries {ENTRIES}"), "warc")


def index(bundles: DataFrame) -> DataFrame:
    """page_id, bundle, frame, offset and length of the frame in the bundle, its decompressed length, and offset and size of the record inside it."""
    return bundles.select("bundle", F.explode("entries").alias("e")).select("e.page_id", "bundle", *[f"e.{c}" for c in ENTRY[1:]])


RECORDS = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, block binary"


def _records(rows: DataFrame) -> DataFrame:
    """The records that rows of bundle, data and entries ask for; only their frames are decompressed, one at a time."""
    kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])

    def run(batches):
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                name, data, entries = (c[i].as_py() for c in batch.columns)
                sizes = read_seek_table(data)
                rows, frame, raw = [], None, b""
                for e in sorted(entries, key=lambda e: (e["frame"], e["inner"])):
                    if e["frame"] != frame:
                        frame = e["frame"]
                        if sizes[frame] != (e["length"], e["raw_length"]):
                            raise ValueError(f"index and seek table of {name} differ")
                        raw = reader.decompress(data[e["offset"] : e["offset"] + e["length"]], max_output_size=e["raw_length"])
                    fields, block = parse(raw[e["inner"] : e["inner"] + e["size"]])
                    page, digest = _page(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if page != e["page_id"] or fields["WARC-Type"] == "response" and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"record of page {page} in {name} is damaged")
                    rows.append((page, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), digest, block))
                    if len(rows) >= 256:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return rows.select("bundle", "data", "entries").mapInArrow(run, RECORDS)


def read_records(bundles: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, url, payload_bytes, payload_digest and block of each record, through the index of each bundle."""
    return _records(bundles)


def read_at(bundles: DataFrame, found: DataFrame) -> DataFrame:
    """The records of the index rows found, each from its own frame only; a bundle is read once for all of its records."""
    asked = found.groupBy("bundle").agg(F.collect_list(F.struct(*ENTRY)).alias("entries"))  # at most what one bundle holds
    return _records(bundles.select("bundle", "data").join(asked, "bundle"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    bundles = write_bundles(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return read_records(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha1(encode(p.h)) AS payload_digest,
  CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
