"""Checks of manifest tables: each returns the rows that break a rule, with the rule's code. A null state is an unknown one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States, encodings and categories that a manifest may name.
INTEGRITY = ("pending", "computed", "failed")
SECURITY = ("not-scanned", "clean", "flagged", "redacted", "excluded", "failed")
CONVERSION = ("not-started", "completed", "partial", "failed", "not-applicable")
ENCODINGS = ("utf-8", "utf-8-bom", "utf-16be", "utf-16le", "windows-1252")
CATEGORIES = (
    "sensitive-filename", "private-key", "cloud-credential", "access-token", "jwt", "connection-string", "password-assignment", "high-entropy",
)

ANCHOR = r"\Afile_[a-f0-9]{64}(?:-segment-[0-9]{3})?\z"


def broken(rows: DataFrame, keys, rules: dict[str, Column]) -> DataFrame:
    """keys and code of each rule that holds for a row; the rules say what is wrong."""
    codes = F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(code)) for code, wrong in rules.items()])
    return rows.select(*keys, F.explode(F.array_compact(codes)).alias("code"))


def unknown(state: Column, known) -> Column:
    return ~F.coalesce(state.isin(*known), F.lit(False))


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _filled(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def integrity(recs: DataFrame, keys=("bundle_id", "seq")) -> DataFrame:
    """Digest state against digest and error (integrity_status, integrity_value, integrity_error)."""
    state, value, error = (F.col(f"integrity_{c}") for c in ("status", "value", "error"))
    digest = F.coalesce(value.rlike(r"\A[a-f0-9]{64}\z"), F.lit(False))
    return broken(recs, keys, {
        "integrity-status": unknown(state, INTEGRITY),
        "integrity-pending": (state == "pending") & F.coalesce(value, error).isNotNull(),
        "integrity-computed": (state == "computed") & ~(digest & error.isNull()),
        "integrity-failed": (state == "failed") & (value.isNotNull() | _blank(error)),
    })


def security_state(recs: DataFrame, keys=("bundle_id", "seq")) -> DataFrame:
    """Scan state against counts, flags and inclusion.

    Columns: security_status, finding_count, high, medium, categories, redactions, excluded, reason.
    """
    state, found = F.col("security_status"), F.col("finding_count")
    odd = F.exists("categories", lambda c: unknown(c, CATEGORIES))
    return broken(recs, keys, {
        "security-status": unknown(state, SECURITY),
        "security-severity-count": F.col("high") + F.col("medium") != found,
        "security-category": odd,
        "security-not-scanned-findings": (state == "not-scanned") & (found != 0),
        "security-clean-findings": (state == "clean") & (found != 0),
        "security-findings-required": state.isin("flagged", "redacted", "excluded") & (found == 0),
        "security-excluded-state": (state == "excluded") & ~F.col("excluded"),
        "security-excluded-flag": (state != "excluded") & F.col("excluded"),
        "security-redaction-required": (state == "redacted") & (F.col("redactions") < 1),
        "security-redaction-state": (state != "redacted") & (F.col("redactions") != 0),
        "security-inclusion": F.col("excluded") & ~F.col("reason").eqNullSafe("excluded-secret-policy"),
    })


def representation(recs: DataFrame, keys=("bundle_id", "seq")) -> DataFrame:
    """Text and page output states against what each declares.

    Columns: size, text_status, anchors, parts, truncated, original_bytes, extracted_bytes, encoding, newlines, text_error,
    page_status, pages, page_parts, excluded, visual_omitted.
    """
    text, page = F.col("text_status"), F.col("page_status")
    anchors, parts, pages, page_parts = (_filled(F.col(c)) for c in ("anchors", "parts", "pages", "page_parts"))
    error, made = F.col("text_error"), text.isin("completed", "partial")
    idle = lambda state: state.isin("not-started", "not-applicable")
    return broken(recs, keys, {
        "representation-status": unknown(text, CONVERSION) | unknown(page, CONVERSION),
        "markdown-anchor": F.exists("anchors", lambda a: ~F.coalesce(a.rlike(ANCHOR), F.lit(False))),
        "markdown-original-bytes": F.col("original_bytes") != F.col("size"),
        "markdown-extracted-bytes": F.col("extracted_bytes") > F.col("original_bytes"),
        "markdown-encoding": F.col("encoding").isNotNull() & unknown(F.col("encoding"), ENCODINGS),
        "markdown-newlines": F.col("newlines") != "lf",
        "markdown-pending": idle(text) & (anchors | parts | (F.col("extracted_bytes") > 0) | error.isNotNull()),
        "markdown-completed": made & ~(anchors & parts & error.isNull() & F.col("newlines").eqNullSafe("lf")),
        "markdown-completed-truncated": (text == "completed") & F.col("truncated"),
        "markdown-partial-truncated": (text == "partial") & ~F.col("truncated"),
        "markdown-failed": (text == "failed") & ~(anchors & parts & ~_blank(error)),
        "pdf-pending": idle(page) & (pages | page_parts),
        "pdf-generated": page.isin("completed", "partial") & ~(pages & page_parts),
        "pdf-security-omission": (F.col("excluded") | F.col("visual_omitted")) & ((page != "not-applicable") | pages | page_parts),
    })


def ranges(estimates: DataFrame, names, keys=("bundle_id", "seq")) -> DataFrame:
    """Estimates whose least value (name_min) lies above the greatest (name_max)."""
    rules = {f"range-order-{n}": F.col(f"{n}_min") > F.col(f"{n}_max") for n in names}
    return broken(estimates, keys, rules)


def children(directories: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Declared children (bundle_id, node_id, children) that do not exist among nodes, or that name another parent."""
    declared = directories.select("bundle_id", "node_id", F.explode("children").alias("child_id"))
    known = nodes.select("bundle_id", F.col("node_id").alias("child_id"), "parent_id", F.lit(True).alias("exists"))
    rows = declared.join(known, ["bundle_id", "child_id"], "left")
    return broken(rows, ("bundle_id", "node_id", "child_id"), {
        f"{kind}-child": F.col("exists").isNull(),
        f"{kind}-child-parent": F.col("exists") & ~F.col("parent_id").eqNullSafe(F.col("node_id")),
    })


def security_totals(recs: DataFrame) -> DataFrame:
    """Sums by bundle that a manifest declares about its scan."""
    count = F.count_if
    return recs.groupBy("bundle_id").agg(
        count(F.col("security_status") != "not-scanned").alias("scanned"), count(F.col("finding_count") > 0).alias("flagged"),
        F.sum("finding_count").alias("findings"), F.sum("redactions").alias("redactions"),
        count("excluded").alias("excluded"), count(F.col("security_status") == "failed").alias("failed"))


def declared_totals(declared: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Bundles for which the declared row and the recomputed one differ in any column, or one of them is absent."""
    a = declared.select("bundle_id", F.struct(*recomputed.columns).alias("declared"))
    b = recomputed.select("bundle_id", F.struct(*recomputed.columns).alias("recomputed"))
    rows = a.join(b, "bundle_id", "full_outer")
    return rows.filter(~F.col("declared").eqNullSafe(F.col("recomputed"))).select("bundle_id")


def text_parts(parts: DataFrame, most: int) -> DataFrame:
    """Parts (bundle_id, part, content, byte_length, anchors) with a wrong length, above the limit, or whose markers do not occur once."""
    marker = lambda a: F.concat(F.lit('<a id="'), a, F.lit('"></a>'))
    without = lambda a: F.length(F.replace("content", marker(a), F.lit("")))
    times = lambda a: (F.length("content") - without(a)) / F.length(marker(a))
    return broken(parts, ("bundle_id", "part"), {
        "part-byte-length": F.octet_length("content") != F.col("byte_length"),
        "part-limit": F.col("byte_length") > most,
        "anchor-occurrence": F.exists("anchors", lambda a: times(a) != 1),
    })


def page_sequence(pages: DataFrame) -> DataFrame:
    """Pages (bundle_id, page) that occur twice or lack the page before them: a join on the number, no ordered pass."""
    counted = pages.groupBy("bundle_id", "page").agg(F.count(F.lit(1)).alias("n"))
    before = counted.select("bundle_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("follows"))
    rows = counted.join(before, ["bundle_id", "page"], "left")
    return broken(rows, ("bundle_id", "page"), {
        "page-repeated": F.col("n") > 1,
        "page-sequence": (F.col("page") != 1) & F.col("follows").isNull(),
    })
