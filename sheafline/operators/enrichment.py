"""Manifest records with what extraction, scanning and page making found: left joins by file, defaults where a row is absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def ordered_union(*lists: Column) -> Column:
    """Distinct values of the lists in the order of their first occurrence; a null list is empty."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists]))


def combined_status(text: Column, page: Column) -> Column:
    """State of a file from the states of its text and its pages; partial unless both agree or only one counts."""
    return (
        F.when(text == "not-applicable", text)
        .when((text == page) & text.isin("completed", "failed"), text)
        .when((text == "not-started") & (page == "failed"), page)
        .otherwise("partial")
    )


def without_match(files: DataFrame, records: DataFrame, keys=("bundle_id", "path")) -> DataFrame:
    """Files that have no record: a complete preflight leaves none."""
    return files.join(records.select(*keys), list(keys), "left_anti")


def with_security(recs: DataFrame, reports: DataFrame) -> DataFrame:
    """recs with their scan reports; a file that the policy excludes is no longer included nor converted.

    reports: bundle_id, seq, security_status, finding_count, redactions, excluded. A file without one was not scanned.
    """
    rows = recs.join(reports, ["bundle_id", "seq"], "left")
    out = F.coalesce("excluded", F.lit(False))
    gone = lambda value, name: F.when(out, F.lit(value)).otherwise(F.col(name))
    return rows.withColumns({
        "excluded": out,
        "security_status": F.coalesce("security_status", F.lit("not-scanned")),
        "finding_count": F.coalesce("finding_count", F.lit(0)),
        "redactions": F.coalesce("redactions", F.lit(0)),
        "included": gone(False, "included"),
        "reason": gone("excluded-secret-policy", "reason"),
        "matched_glob": gone(None, "matched_glob"),
        "status": gone("not-applicable", "status"),
    })


def with_pages(recs: DataFrame, made: DataFrame) -> DataFrame:
    """recs (with status, warnings) and the states, pages and warnings of their pages; files without pages stay as they are.

    made: bundle_id, seq, page_status, pages, page_warnings.
    """
    rows = recs.join(made, ["bundle_id", "seq"], "left")
    status = F.when(F.col("page_status").isNull(), F.col("status")).otherwise(combined_status(F.col("status"), F.col("page_status")))
    warnings = ordered_union(F.col("warnings"), F.col("page_warnings"))
    return rows.withColumns({"status": status, "warnings": warnings}).drop("page_warnings")


def import_summary(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files, directories (without the root) and bytes by bundle."""
    sums = files.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    dirs = nodes.filter("kind = 'directory' and path <> ''").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("directories"))
    return sums.join(dirs, "bundle_id", "left").fillna({"directories": 0})
