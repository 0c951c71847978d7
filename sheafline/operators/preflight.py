"""Preflight: classify files, list their risks, estimate output sizes, total them and recommend a mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, text

SAMPLE_BYTES = 16_384
GENERIC = ("", "application/octet-stream", "binary/octet-stream")


@dataclass(frozen=True)
class PreflightPolicy:
    medium_bytes: int = 50 << 20
    high_bytes: int = 200 << 20
    ratio: float = 50.0
    quick_bytes: int = 750 << 20
    quick_files: int = 10_000
    multipart_bytes: int = 100 << 20


#: Names that hint at secrets.
SENSITIVE = (
    r"(?i)\A\.env(?:\.|\z)",
    r"(?i)(?:\A|/)(?:id_rsa|id_ed25519|credentials|secrets?|passwords?)(?:\.|\z)",
    r"(?i)\.(?:pem|key|p12|pfx|keystore)\z",
    r"(?i)(?:\A|/)(?:service-account|firebase-adminsdk)[^/]*\.json\z",
)
#: Least and greatest output per input byte, or constant bytes, by category: Markdown, then PDF.
FACTORS = {
    "text": ((1.03, 1.35), (0.15, 0.8)), "code": ((1.03, 1.35), (0.15, 0.8)), "document": ((0.08, 1.1), (0.9, 1.7)), "spreadsheet": ((0.2, 2.2), (0.3, 2.5)),
    "presentation": ((0.08, 0.9), (0.4, 2.2)), "image": ((500, 2200), (0.25, 1.25)),
}
OTHER_RANGES, BLOCKED_RANGES, MANIFEST_RANGE = ((400, 1400), (0, 1200)), ((400, 1200), (0, 900)), (700, 1800)


def looked_up(files: DataFrame) -> DataFrame:
    """files with the registry's struct for their extension, or else for their name, or null: two joins with a table of fixed size."""
    reg = F.broadcast(formats.registry(files.sparkSession))
    fields = ("mime", "category", "level", "adapter", "macro", "active", "executable", "nested")
    by = lambda kind: reg.filter(F.col("kind") == kind).select(F.col("key").alias(f"__{kind}"), F.struct(*fields).alias(f"__by_{kind}"))
    out = files.join(by("extension"), F.col("extension") == F.col("__extension"), "left").join(by("name"), F.lower("name") == F.col("__name"), "left")
    return out.withColumn("registered", F.coalesce("__by_extension", "__by_name")).drop("__extension", "__by_extension", "__name", "__by_name")


def classified(files: DataFrame) -> DataFrame:
    """files (path, name, extension, content, mime_declared) with mime, category, level, adapter, method, is_text, encoding, warned and four flags."""
    sample = F.substring("content", 1, SAMPLE_BYTES)
    known = F.struct(
        F.col("registered").alias("reg"), formats.signature_of(sample).alias("sig"), text.sniffed(sample).alias("txt"),
        F.coalesce(F.lower(F.trim("mime_declared")), F.lit("")).alias("declared"), F.col("extension").alias("extension"))
    # the lambda binds what is known once; else each field of the result would repeat it all in the plan
    found = F.get(F.transform(F.array(known), _decided), 0)
    return looked_up(files).withColumn("__c", found).select(*files.columns, "__c.*")


def _decided(known: Column) -> Column:
    """The cascade: signatures, containers, extensions, text, declared types."""
    reg, sig, txt, declared, extension = (known[k] for k in ("reg", "sig", "txt", "declared", "extension"))
    off = {k: F.lit(False) for k in ("macro", "active", "executable", "nested")}

    def result(mime, category, level, adapter, method, is_text=F.lit(False), encoding=None, warned=F.lit(False), flags=off) -> Column:
        lit = lambda c: F.lit(c) if isinstance(c, str) else c
        return F.struct(
            lit(mime).alias("mime"), lit(category).alias("category"), lit(level).alias("level"), lit(adapter).alias("adapter"), F.lit(method).alias("method"),
            is_text.alias("is_text"), (F.lit(None) if encoding is None else encoding).cast("string").alias("encoding"), warned.alias("warned"), *[v.alias(k) for k, v in flags.items()])

    own = {k: reg[k] for k in off}
    registered = lambda method, *a: result(reg["mime"], reg["category"], reg["level"], reg["adapter"], method, *a, flags=own)
    unknown = lambda method="unknown": result("application/octet-stream", "binary", "D", "inventory", method)
    image = sig["category"] == "image"
    contained = ((sig["mime"] == "application/zip") & extension.isin(*formats.ZIP_CONTAINERS)) | ((sig["mime"] == "application/x-ole-storage") & extension.isin(*formats.OLE_CONTAINERS))
    code = F.when(declared.contains("javascript") | declared.contains("css"), "code").otherwise("text")
    return (
        F.when(sig["executable"], result(sig["mime"], sig["category"], "E", "blocked", "signature", flags=off | {"executable": F.lit(True)}))
        .when(contained, registered("container-extension"))
        .when(sig.isNotNull() & F.coalesce(reg["mime"] == sig["mime"], F.lit(False)), result(sig["mime"], sig["category"], reg["level"], reg["adapter"], "signature", flags=own))
        .when(sig.isNotNull(), result(sig["mime"], sig["category"], F.when(image, "C").otherwise("D"), F.when(image, "image").otherwise("inventory"), "signature"))
        .when(reg.isNotNull() & (reg["adapter"] == "text") & ~txt["is_text"], unknown())
        .when(reg.isNotNull(), registered("extension", txt["is_text"], txt["encoding"], txt["warned"]))
        .when(txt["is_text"], result("text/plain", "text", "B", "text", "text-heuristic", F.lit(True), txt["encoding"], txt["warned"]))
        .when(declared.startswith("text/"), result(declared, code, "B", "text", "declared", F.lit(True)))
        .when(declared.startswith("image/"), result(declared, "image", "C", "image", "declared"))
        .otherwise(unknown())
    )


def mime_mismatch() -> Column:
    declared = F.lower(F.trim("mime_declared"))
    differs = F.col("method").isin("signature", "container-extension") & ~declared.isin(*GENERIC) & (declared != F.col("mime"))
    return F.coalesce(differs & ~((declared == "application/zip") & F.col("mime").contains("officedocument")), F.lit(False))


def risks(policy: PreflightPolicy = PreflightPolicy()) -> Column:
    """array of struct(code, level), in a fixed order."""
    risk = lambda test, code, level: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level")))
    sensitive = F.lit(False)
    for pattern in SENSITIVE:
        sensitive = sensitive | F.col("path").rlike(pattern)
    each = F.array(
        risk(F.col("executable"), "executable-content", "high"), risk(F.col("macro"), "office-macro", "high"), risk(F.col("active"), "active-content", "medium"),
        risk(F.col("nested"), "archive-nested", "medium"), risk(sensitive, "sensitive-name", "high"),
        F.coalesce(risk(F.col("size") >= policy.high_bytes, "large-file", "high"), risk(F.col("size") >= policy.medium_bytes, "large-file", "medium")),
        risk((F.col("compressed_size") > 0) & (F.col("size") >= policy.ratio * F.col("compressed_size")), "compression-ratio", "medium"),
        risk(mime_mismatch(), "mime-mismatch", "medium"), risk((F.col("adapter") == "inventory") & (F.col("category") == "binary"), "binary-unknown", "medium"),
        risk(F.col("warned"), "text-decoding", "medium"),
    )
    return F.filter(each, lambda r: r.isNotNull())


def highest(risk_list: Column) -> Column:
    has = lambda level: F.exists(risk_list, lambda r: r["level"] == level)
    return F.when(has("high"), "high").when(has("medium"), "medium").otherwise("low")


def estimate() -> dict[str, Column]:
    """md_min, md_max, pdf_min, pdf_max, mf_min, mf_max; halves are rounded up."""
    rounded = lambda c: F.floor(c + 0.5).cast("long")
    out = {}
    for at, family in enumerate(("md", "pdf")):
        for end, name in enumerate(("min", "max")):
            of = F.when(F.col("level") == "E", F.lit(BLOCKED_RANGES[at][end]).cast("long"))
            for category, ranges in FACTORS.items():
                x = ranges[at][end]
                of = of.when(F.col("category") == category, F.lit(x).cast("long") if isinstance(x, int) else rounded(F.col("size") * F.lit(x)))
            out[f"{family}_{name}"] = of.otherwise(F.lit(OTHER_RANGES[at][end]).cast("long"))
    return out | {f"mf_{n}": F.lit(x).cast("long") for n, x in zip(("min", "max"), MANIFEST_RANGE, strict=True)}


def records(files: DataFrame, policy: PreflightPolicy = PreflightPolicy()) -> DataFrame:
    """The preflight record of each file, without its content."""
    rows = classified(files).drop("content").withColumn("risks", risks(policy))
    rows = rows.withColumn("risk_level", highest(F.col("risks"))).withColumn("default_included", F.col("level") != "E")
    return rows.withColumns(estimate())


def totals(recs: DataFrame) -> DataFrame:
    """One row for each bundle."""
    count = lambda test: F.count_if(test).alias
    sums = [F.sum(c).alias(c) for c in ("md_min", "md_max", "pdf_min", "pdf_max", "mf_min", "mf_max")]
    out = recs.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("logical_bytes"), F.sum("compressed_size").alias("compressed_bytes"), F.max("size").alias("largest"), F.countDistinct("mime").alias("mimes"),
        *[count(F.col("level") == x)(f"level_{x.lower()}") for x in "ABCDE"], *[count(F.col("risk_level") == x)(f"risk_{x}") for x in ("low", "medium", "high")], *sums)
    mb = 1 << 20
    low = F.col("logical_bytes") + F.least(F.col("largest"), F.lit(16 * mb))
    high = F.col("logical_bytes") + F.least(F.col("logical_bytes"), F.greatest(F.col("largest") * 3, F.lit(64 * mb)))
    return out.withColumns({"memory_min": low, "memory_max": high})


def output_mode(total: DataFrame, policy: PreflightPolicy = PreflightPolicy()) -> DataFrame:
    mode = (
        F.when((F.col("logical_bytes") >= policy.quick_bytes) | (F.col("file_count") >= policy.quick_files) | (F.col("risk_high") > 0), "quick-preview")
        .when(F.col("md_max") + F.col("pdf_max") >= policy.multipart_bytes, "multipart").otherwise("three-files")
    )
    return total.select("bundle_id", mode.alias("mode"))
