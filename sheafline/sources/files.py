"""Tables of files: from folders, from text tables, and the demonstration files derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_SCHEMA = "bundle_id string, seq long, raw_path string, source_kind string, size long, compressed_size long, mime_declared string, last_modified long, content binary"


def from_folder(spark: SparkSession, path: str, bundle_id: str, pattern: str | None = None) -> DataFrame:
    """All files below a folder; contents are read only where a plan uses them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = F.lit(path.rstrip("/") + "/")
    found = reader.load(path)
    relative = F.element_at(F.split(F.col("path"), F.concat(F.lit(r"\Q"), root, F.lit(r"\E")), 2), -1)
    return found.select(
        F.lit(bundle_id).alias("bundle_id"), F.xxhash64("path").alias("seq"), relative.alias("raw_path"), F.lit("directory-picker").alias("source_kind"), F.col("length").alias("size"),
        F.col("length").alias("compressed_size"), F.lit(None).cast("string").alias("mime_declared"), F.unix_millis("modificationTime").alias("last_modified"), "content")


def from_rows(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, FILES_SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FILES_SCHEMA)


def is_archive_import(names: list[str], directories: list[str]) -> bool:
    """One archive alone is opened; anything else is taken as files."""
    return len(names) == 1 and not directories and names[0].lower().endswith(".zip")


def prefix_of(content, n: int):
    return F.substring(content, 1, n)


#: Extensions and first characters that the demonstration files get by their number, so that every rule has rows.
EXTENSIONS = ("txt", "md", "py", "json", "html", "csv", "pdf", "exe", "docx", "", "png", "zip", "pem", "bin")
HEADS = ("%PDF-", "MZ", "PK\x03\x04", "GIF89a", "\x01\x02\x03", "BM", "RIFF1234WEBP", "RIFF1234WAVE", "Rar!\x1a\x07", "\x7fELF", "ID3", "OggS", "1234ftyp")


def demo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle_id, seq, raw_path, body, size, mime_declared: rows of three text tables as files with odd paths and heads."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    null = F.lit(None).cast("string")
    docs = read("documents").select(F.lit("documents").alias("bundle_id"), F.col("doc_id").alias("seq"), F.concat_ws("/", F.lit("documents"), "source", "lang", F.concat(F.lit("doc_"), "doc_id")).alias("stem"), "text", null.alias("mime_declared"))
    pages = read("pages").select(F.lit("pages").alias("bundle_id"), F.col("page_id").alias("seq"), F.concat(F.lit("pages/page_"), "page_id").alias("stem"), F.col("html").alias("text"), F.lit("text/html").alias("mime_declared"))
    turns = read("conversations").select(F.lit("conversations").alias("bundle_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat(F.lit("conversations/conv_"), "conv_id", F.lit("/"), "turn", F.lit("_"), "role").alias("stem"), "text", null.alias("mime_declared"))
    rows = docs.unionAll(pages).unionAll(turns)
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("seq") % len(EXTENSIONS)).cast("int"))
    path = (
        F.when(F.col("seq") % 17 == 0, F.concat("bundle_id", F.lit("/dup/shared_"), (F.col("seq") % 5).cast("string"), F.lit(".txt")))
        .when(F.col("seq") % 37 == 0, F.concat("bundle_id", F.lit("/dup")))
        .otherwise(F.concat("stem", F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))))
    )
    odd = F.when(F.col("seq") % 11 == 0, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(path)
    raw = F.concat(F.when(F.col("seq") % 13 == 0, "../").when(F.col("seq") % 7 == 0, "./").otherwise(""), odd)
    head = F.coalesce(F.get(F.array(*map(F.lit, HEADS)), (F.col("seq") % 41).cast("int")), F.lit(""))
    body = F.concat(head, F.coalesce("text", F.lit("")))
    return rows.select("bundle_id", "seq", raw.alias("raw_path"), body.alias("body"), F.octet_length(body).cast("long").alias("size"), "mime_declared")
