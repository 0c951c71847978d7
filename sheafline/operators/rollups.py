"""Listings, issue rollups, snapshots and checks across the tables of a bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .packing import running_totals

#: States by rising weight; a file with several issues has the heaviest.
ISSUE_WEIGHT = {"not-applicable": 0, "completed": 1, "not-started": 2, "partial": 3, "failed": 4, "invalid": 5}
#: Extensions that are processed in three of the categories.
PROCESSED = {"spreadsheet": ("xlsx", "xlsm"), "document": ("docx", "docm"), "presentation": ("pptx", "pptm")}


def preorder_key(path: Column, kind: Column) -> Column:
    """Sorts nodes so that each directory comes right before all that lies below it.

    Siblings are sorted as in `tree.ordered_children`: directories first, then by name with numbers by value. Normalized
    paths hold no control characters, so these separate names (\\x01) and levels (\\x02).
    """
    parts = F.split(path, "/", -1)

    def level(name: Column, i: Column) -> Column:
        last = (i == F.size(parts) - 1) & (kind == "file")
        return F.concat(F.when(last, "1").otherwise("0"), paths.natural_key(name, lower=True), F.lit("\x01"), name)

    return F.when(path == "", "").otherwise(F.array_join(F.transform(parts, level), "\x02"))


def preorder(tree: DataFrame) -> DataFrame:
    """bundle_id, path, kind, depth and position of each node in a walk from the root, which has position 1.

    Positions come from a range-partitioned sort, so no task holds a whole bundle.
    """
    rows = tree.select("bundle_id", "path", "kind", "depth", preorder_key(F.col("path"), F.col("kind")).alias("key"), F.lit(1).cast("long").alias("one"))
    return running_totals(rows, ("bundle_id",), "key", "one").select("bundle_id", "path", "kind", "depth", F.col("upto").alias("position"))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """bundle_id, seq, status and details of each file with issues, from rows (bundle_id, seq, place, source, status, messages).

    The status is the heaviest; details are marked by their source, distinct, in order of their first place. Rows
    without messages count for nothing. The messages of one file are few; they are reduced before they are gathered.
    """
    weight = F.create_map(*(F.lit(v) for pair in ISSUE_WEIGHT.items() for v in pair))
    said = issues.select("bundle_id", "seq", "place", "source", F.element_at(weight, F.col("status")).alias("weight"), F.posexplode("messages").alias("i", "message"))
    said = said.withColumn("detail", F.concat(F.lit("["), "source", F.lit("] "), "message"))
    first = said.groupBy("bundle_id", "seq", "detail").agg(F.min(F.struct("place", "i")).alias("at"), F.max("weight").alias("weight"))
    rolled = first.groupBy("bundle_id", "seq").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("at", "detail"))).alias("all"))
    names = F.array(*(F.lit(s) for s in sorted(ISSUE_WEIGHT, key=ISSUE_WEIGHT.get)))
    return rolled.select("bundle_id", "seq", F.get(names, F.col("weight")).alias("status"), F.col("all.detail").alias("details"))


def processable(included: Column, is_text: Column, mime: Column, category: Column, extension: Column) -> Column:
    """Whether a file is included and of a kind that is turned into text or pages; null counts as no."""
    kinds = [(category == c) & extension.isin(*es) for c, es in PROCESSED.items()]
    known = is_text | (mime == "application/pdf") | (category == "image") | kinds[0] | kinds[1] | kinds[2]
    return F.coalesce(included & known, F.lit(False))


def unmatched(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files that have no record."""
    return files.join(records.select("bundle_id", "seq"), ["bundle_id", "seq"], "left_anti")


def with_records(files: DataFrame, records: DataFrame) -> DataFrame:
    """files with the columns of their records; a file without one fails the job, since totals would be wrong without it."""
    out = files.join(records.withColumn("__found", F.lit(True)), ["bundle_id", "seq"], "left")
    missing = F.raise_error(F.concat(F.lit("no record of file "), F.col("bundle_id"), F.lit(" "), F.col("seq").cast("string")))
    return out.filter(F.coalesce("__found", missing)).drop("__found")


def snapshot(records: DataFrame) -> DataFrame:
    """bundle_id with counts of files by their state and the bytes of their text."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_files")
    return records.groupBy("bundle_id").agg(count("completed"), count("partial"), count("failed"), F.sum("size").cast("long").alias("total_bytes"))


#: Characters of the first part that a snapshot shows.
PREVIEW = 6000


def artifact_snapshot(parts: DataFrame, records: DataFrame, assets: DataFrame, scans: DataFrame, outputs: DataFrame, violations: DataFrame) -> DataFrame:
    """One row for each bundle that has parts: what was made of it, in numbers.

    parts are (bundle_id, part, name, content, byte_length, anchors), records (bundle_id, status), assets (bundle_id, kind:
    xlsx, pdf, image, docx or pptx, units: sheets, pages or slides, formulas, visual: whether it is shown), scans
    (bundle_id, finding_count, redactions, excluded, visual_omitted), outputs (bundle_id, family: documents, spreadsheet or
    office, pages, bytes) and violations (bundle_id, family: content or documents), a row for each broken rule.
    """
    count, total = F.count_if, lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    is_kind = lambda *k: F.col("kind").isin(*k)
    of = lambda family, c: total(F.when(F.col("family") == family, F.col(c)))
    first = F.min_by(F.substring("content", 1, PREVIEW), "part")
    by_part = parts.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("part_count"), F.sum("byte_length").cast("long").alias("total_bytes"), F.sum(F.size("anchors")).cast("long").alias("anchor_count"), (F.count(F.lit(1)) > 1).alias("sharded"), first.alias("preview"))
    tables = [
        records.groupBy("bundle_id").agg(*[count(F.col("status") == x).alias(f"{x}_files") for x in ("completed", "partial", "failed")]),
        assets.groupBy("bundle_id").agg(
            count(is_kind("xlsx")).alias("spreadsheet_workbooks"), total(F.when(is_kind("xlsx"), F.col("units"))).alias("spreadsheet_sheets"), total(F.when(is_kind("xlsx"), F.col("formulas"))).alias("spreadsheet_formula_cells"),
            count(is_kind("pdf")).alias("pdf_documents"), total(F.when(is_kind("pdf"), F.col("units"))).alias("pdf_source_pages"), count(is_kind("image")).alias("image_files"), count(is_kind("image") & F.col("visual")).alias("image_visual_pages"),
            count(is_kind("docx", "pptx")).alias("office_documents"), count(is_kind("docx")).alias("docx_documents"), count(is_kind("pptx")).alias("presentations"), total(F.when(is_kind("pptx"), F.col("units"))).alias("presentation_slides")),
        outputs.groupBy("bundle_id").agg(*[of(f, c).alias(f"{f}_{n}{c}") for f, n in (("spreadsheet", "preview_"), ("office", "preview_"), ("documents", "")) for c in ("pages", "bytes")], F.bool_or(F.col("family") == "documents").alias("has_documents")),
        scans.groupBy("bundle_id").agg(count(F.col("finding_count") > 0).alias("secret_flagged_files"), total("finding_count").alias("secret_findings"), total("redactions").alias("secret_redactions"), count("excluded").alias("secret_excluded_files"), count("visual_omitted").alias("secret_visual_omissions")),
        violations.groupBy("bundle_id").agg(count(F.col("family") == "content").alias("content_errors"), count(F.col("family") == "documents").alias("documents_errors")),
    ]
    out = by_part
    for t in tables:
        out = out.join(t, "bundle_id", "left")
    numbers = [c for c, kind in out.dtypes if kind == "bigint"]
    out = out.fillna(0, numbers).fillna(False, ["has_documents"])
    good = F.col("has_documents") & (F.col("documents_errors") == 0)
    valid = (F.col("content_errors") == 0) & (good | ~F.col("has_documents"))
    return out.withColumns({"documents_valid": good, "valid": valid}).drop("has_documents", "content_errors", "documents_errors")


def part_summaries(parts: DataFrame) -> DataFrame:
    """bundle_id, part, name, byte_length, anchor_count of each part."""
    return parts.select("bundle_id", "part", "name", "byte_length", F.size("anchors").alias("anchor_count"))


def used_range(cells: DataFrame) -> DataFrame:
    """sheet, first and last row and column with a cell, cells and formulas, and whether any was cut."""
    return cells.groupBy("sheet").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"),
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("formula").isNotNull()).alias("formulas"), F.bool_or("cut").alias("truncated"))
