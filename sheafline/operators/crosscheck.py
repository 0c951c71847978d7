"""Checks between tables that describe one bundle: text parts, the records of what is in them, manifest files, scan reports.

Markers are extracted once from each part's content, and what is found, declared and recorded meets by joins on the
marker or the file, never by a search of each marker in each part. All checks return bundle_id, code and subject (a
marker, a file id or the name of a part), one row for each broken rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .validation import broken

#: A marker in a part; its first group is the anchor.
MARKER = r'<a id="(file_[a-f0-9]{64}(?:-segment-[0-9]{3})?)"></a>'


def marker(anchor: Column) -> Column:
    return F.concat(F.lit('<a id="'), anchor, F.lit('"></a>'))


def _coded(rows: DataFrame, code: str, subject: str) -> DataFrame:
    return rows.select("bundle_id", F.lit(code).alias("code"), F.col(subject).alias("subject"))


def _rules(rows: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    return broken(rows, ("bundle_id", subject), rules).select("bundle_id", "code", F.col(subject).alias("subject"))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def indexed(parts: DataFrame) -> DataFrame:
    """bundle_id, part, name, byte_length, anchors of parts with the markers found in their content and its true length: contents are read once."""
    found = F.regexp_extract_all("content", F.lit(MARKER), F.lit(1))
    return settled(parts.select("bundle_id", "part", "name", "byte_length", "anchors", found.alias("found"), F.octet_length("content").alias("actual")))


def occurrences(parts: DataFrame) -> DataFrame:
    """bundle_id, anchor, name, n: how often each marker stands in each indexed part."""
    every = parts.select("bundle_id", "name", F.explode("found").alias("anchor"))
    return every.groupBy("bundle_id", "anchor", "name").agg(F.count(F.lit(1)).alias("n"))


def declared(parts: DataFrame) -> DataFrame:
    """bundle_id, anchor, name, part, times of the anchors that parts (part, name, anchors) declare."""
    every = parts.select("bundle_id", "part", "name", F.explode("anchors").alias("anchor"))
    return every.groupBy("bundle_id", "anchor", "name").agg(F.max("part").alias("part"), F.count(F.lit(1)).alias("times"))


def markers(parts: DataFrame) -> DataFrame:
    """Anchors that do not stand once in the part that declares them, that several places declare, or that stand in a part that does not declare them."""
    own = declared(parts)
    both = own.join(occurrences(parts), ["bundle_id", "anchor", "name"], "full_outer")
    rows = _rules(both, "anchor", {
        "anchor-occurrence": F.col("times").isNotNull() & (F.coalesce("n", F.lit(0)) != 1),
        "anchor-foreign": F.col("times").isNull(),
    })
    places = own.groupBy("bundle_id", "anchor").agg(F.sum("times").alias("times"))
    return rows.unionByName(_coded(places.filter("times > 1"), "anchor-duplicate", "anchor"))


def records(records: DataFrame, parts: DataFrame, files: DataFrame) -> DataFrame:
    """Records (file_id, status, anchors, parts, truncated) against the parts they name and the manifest's files (file_id, text_status, text_anchors, text_parts, text_truncated)."""
    names = parts.select("bundle_id", "name").distinct()
    places = declared(parts).groupBy("bundle_id", "anchor").agg(F.max_by("name", "part").alias("place"))  # the last declaration counts
    rows = records.join(files.select("bundle_id", "file_id", F.lit(True).alias("known"), "text_status", "text_anchors", "text_parts", "text_truncated"), ["bundle_id", "file_id"], "left")
    named = records.select("bundle_id", "file_id", F.explode("parts").alias("name")).join(names, ["bundle_id", "name"], "left_anti")
    anchors = records.select("bundle_id", "file_id", "parts", F.explode("anchors").alias("anchor")).join(places, ["bundle_id", "anchor"], "left")
    return _union([
        _rules(rows, "file_id", {
            "record-file": F.col("known").isNull(),
            "manifest-status": F.col("text_status") != F.col("status"),
            "manifest-anchors": F.col("text_anchors") != F.col("anchors"),
            "manifest-parts": F.col("text_parts") != F.col("parts"),
            "manifest-truncation": F.col("text_truncated") != F.col("truncated"),
        }),
        _coded(named, "record-part", "file_id"),
        _rules(anchors, "file_id", {"record-anchor": F.col("place").isNull(), "record-anchor-part": ~F.array_contains("parts", F.col("place"))}),
    ])


#: Columns that a scan report and its manifest file hold alike, and the code where they differ.
SAME = {"status": "security-status", "finding_count": "security-findings", "redactions": "security-redactions", "excluded": "security-excluded", "visual_omitted": "security-visual", "scan_truncated": "security-truncated", "categories": "security-categories"}


def reports(reports: DataFrame, files: DataFrame, modes: DataFrame) -> DataFrame:
    """Scan reports (file_id, path, mode and the columns of SAME) against the manifest's files (file_id, path, included, reason, text_anchors, text_parts, pages, and SAME with security_ before each) and its modes (bundle_id, mode)."""
    own = [F.col(f"security_{c}") for c in SAME]
    known = files.select("bundle_id", "file_id", F.col("path").alias("file_path"), "included", "reason", "text_anchors", "text_parts", "pages", *own, F.lit(True).alias("known"))
    rows = reports.join(known, ["bundle_id", "file_id"], "left").join(modes.select("bundle_id", F.col("mode").alias("bundle_mode")), "bundle_id", "left")
    held = (F.size("text_anchors") > 0) | (F.size("text_parts") > 0)
    return _union([
        _coded(reports.groupBy("bundle_id", "file_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "security-report-duplicate", "file_id"),
        _rules(rows, "file_id", {
            "security-report-file": F.col("known").isNull(),
            "security-report-path": F.col("path") != F.col("file_path"),
            "security-report-mode": F.col("known") & (F.col("mode") != F.col("bundle_mode")),
            **{code: F.col(c) != F.col(f"security_{c}") for c, code in SAME.items()},
            "security-exclusion-inclusion": F.col("known") & F.col("excluded") & (F.col("included") | ~F.col("reason").eqNullSafe("excluded-secret-policy")),
            "security-exclusion-markdown": F.col("excluded") & held,
            "security-visual-pages": F.col("visual_omitted") & (F.size("pages") > 0),
        }),
        _coded(files.join(reports.select("bundle_id", "file_id"), ["bundle_id", "file_id"], "left_anti"), "security-report-missing", "file_id"),
    ])


def part_names(parts: DataFrame, most: int) -> DataFrame:
    """Names that several indexed parts have, lengths that are not those of the content, and parts above the limit."""
    twice = parts.groupBy("bundle_id", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _coded(twice, "part-duplicate", "name").unionByName(_rules(parts, "name", {"part-byte-length": F.col("actual") != F.col("byte_length"), "part-limit": F.col("byte_length") > most}))


def bundle(parts: DataFrame, recs: DataFrame, files: DataFrame, scans: DataFrame, modes: DataFrame, most: int) -> DataFrame:
    """All checks between the tables of bundles; parts are (bundle_id, part, name, content, byte_length, anchors)."""
    index = indexed(parts)
    return _union([part_names(index, most), markers(index), records(recs, index, files), reports(scans, files, modes)])


def fingerprint(items: DataFrame, group: str, position: str, value: str, name: str) -> DataFrame:
    """group, n and two sums of hashes of position and value: equal for equal ordered lists. It is summed map-side, so a list of any length is compared without being gathered or sorted; lists that differ agree by chance once in 2^127."""
    wide = lambda seed: F.xxhash64(F.lit(seed), F.col(position).cast("long"), F.col(value)).cast("decimal(20,0)")
    sums = F.struct(F.count(F.lit(1)).alias("n"), F.sum(wide(1)).alias("a"), F.sum(wide(2)).alias("b"))
    return items.groupBy(group).agg(sums.alias(name))


def list_mismatch(one: DataFrame, other: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Groups whose two lists (a row for each position and value) are not the same items in the same order: a lost, doubled, changed or swapped item."""
    both = fingerprint(one, group, position, value, "x").join(fingerprint(other, group, position, value, "y"), group, "full_outer")
    return both.filter(~F.col("x").eqNullSafe(F.col("y"))).select(group)
