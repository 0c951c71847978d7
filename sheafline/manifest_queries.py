"""Registered queries of manifest checks, enrichment and decoding, with their SQL; states are given to all rows by their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import enrichment, manifest, tree, validation
from .queries import BODIES, FILES, NODES, SELECTED, _bodies, _files, _good, _selected, _sql


def _one_of(values, by):
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def _pick(values, by):
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{by} % {len(values)} + 1]"


def q_validate_integrity(spark, sf):
    value = F.when(F.col("seq") % 3 == 0, F.sha2("body", 256)).when(F.col("seq") % 3 == 1, "abc")
    error = F.when(F.col("seq") % 5 == 0, "unreadable").when(F.col("seq") % 5 == 1, "")
    recs = _bodies(spark, sf).select(
        "seq", _one_of((*validation.INTEGRITY, "other"), F.col("seq")).alias("integrity_status"), value.alias("integrity_value"), error.alias("integrity_error"))
    return validation.integrity(recs, ("seq",))


def _scans(spark, sf):
    return _bodies(spark, sf).select(
        "seq", "bundle_id", _one_of(validation.SECURITY, F.col("seq")).alias("security_status"), (F.col("seq") % 4).alias("finding_count"),
        (F.col("seq") % 2).alias("high"), (F.col("seq") % 4 - F.col("seq") % 2 + F.when(F.col("seq") % 7 == 0, 1).otherwise(0)).alias("medium"),
        F.array(F.when(F.col("seq") % 11 == 0, "odd").otherwise("jwt")).alias("categories"), F.when(F.col("seq") % 9 == 0, 1).otherwise(0).alias("redactions"),
        (F.col("seq") % 5 == 0).alias("excluded"), F.when(F.col("seq") % 10 == 0, "excluded-secret-policy").otherwise("selected").alias("reason"))


def q_validate_security(spark, sf):
    return validation.security_state(_scans(spark, sf), ("seq",))


def q_security_totals(spark, sf):
    return validation.security_totals(_scans(spark, sf))


def q_validate_representation(spark, sf):
    size = F.octet_length("body").cast("long")
    none = F.expr("cast(array() as array<string>)")
    anchor = F.concat(F.lit("file_"), F.sha2("path", 256), F.when(F.col("seq") % 13 == 0, "-segment-7").otherwise(""))
    recs = _bodies(spark, sf).select(
        "seq", size.alias("size"), _one_of(validation.CONVERSION, F.col("seq")).alias("text_status"), _one_of((*validation.CONVERSION, "other"), F.col("seq")).alias("page_status"),
        F.when(F.col("seq") % 2 == 0, F.array(anchor)).otherwise(none).alias("anchors"), F.when(F.col("seq") % 3 > 0, F.array(F.lit("part_001"))).otherwise(none).alias("parts"),
        (F.col("seq") % 4 == 0).alias("truncated"), (size + F.when(F.col("seq") % 17 == 0, 1).otherwise(0)).alias("original_bytes"),
        F.when(F.col("seq") % 19 == 0, size + 2).when(F.col("seq") % 5 == 0, F.lit(0)).otherwise(size).alias("extracted_bytes"),
        F.when(F.col("seq") % 23 == 0, "ebcdic").when(F.col("seq") % 2 == 0, "utf-8").alias("encoding"), F.when(F.col("seq") % 29 == 0, "crlf").when(F.col("seq") % 7 > 0, "lf").alias("newlines"),
        F.when(F.col("seq") % 8 == 0, "").when(F.col("seq") % 8 == 3, "failed").alias("text_error"), F.when(F.col("seq") % 3 == 0, F.array(F.lit(1))).otherwise(F.expr("cast(array() as array<int>)")).alias("pages"),
        F.when(F.col("seq") % 4 == 0, F.array(F.lit("pages_001"))).otherwise(none).alias("page_parts"), (F.col("seq") % 31 == 0).alias("excluded"), (F.col("seq") % 37 == 0).alias("visual_omitted"))
    return validation.representation(recs, ("seq",))


def q_validate_children(spark, sf):
    nodes = tree.nodes(_files(spark, sf).filter("error is null"))
    child = F.when(F.col("name").like("%9%"), F.concat("node_id", F.lit("x"))).otherwise(F.col("node_id"))
    above = F.when(F.col("name").like("%8%"), "dir_0").otherwise(F.col("parent_id"))
    declared = nodes.filter("parent_id is not null").select("bundle_id", above.alias("node_id"), F.array(child).alias("children"))
    return validation.children(declared, nodes, "file")


def q_validate_pages(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    shifted = F.col("l_linenumber") + F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)
    return validation.page_sequence(li.select(F.col("l_orderkey").alias("bundle_id"), shifted.cast("long").alias("page")))


def q_status_combine(spark, sf):
    one, other = (_one_of(validation.CONVERSION, by) for by in (F.col("seq"), F.floor(F.col("seq") / 5)))
    return _bodies(spark, sf).select("seq", enrichment.combined_status(one, other).alias("status"))


def q_manifest_security(spark, sf):
    state = F.when(F.col("seq") % 12 == 0, "excluded").when(F.col("seq") % 3 == 0, "flagged").otherwise("clean")
    reports = _good(spark, sf).filter(F.col("seq") % 4 != 1).select(
        "bundle_id", "seq", state.alias("security_status"), F.when(F.col("seq") % 3 == 0, 2).otherwise(0).alias("finding_count"), F.lit(0).alias("redactions"), (F.col("seq") % 12 == 0).alias("excluded"))
    out = enrichment.with_security(manifest.file_records(_selected(spark, sf)), reports)
    return out.select("bundle_id", "seq", "included", "reason", "matched_glob", "status", "security_status", "finding_count")


def q_import_summary(spark, sf):
    return enrichment.import_summary(_good(spark, sf), tree.nodes(_files(spark, sf).filter("error is null")))


def q_warning_union(spark, sf):
    words = F.split("body", " ")
    return _bodies(spark, sf).select("seq", F.sha2(F.array_join(enrichment.ordered_union(words, F.reverse(words), F.array(F.lit("last"))), " "), 256).alias("sha256"))


def q_escape_markdown(spark, sf):
    return _bodies(spark, sf).select("seq", F.sha2(text.escaped(F.concat("body", F.lit("<a&b>[*_#]\\"))), 256).alias("sha256"))


def q_decode_text(spark, sf):
    """Texts written in four ways come back alike."""
    b = F.col("body")
    raw = (
        F.when(F.col("seq") % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), b.cast("binary"))).when(F.col("seq") % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(b, "UTF-16LE")))
        .when(F.col("seq") % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(b, "UTF-16BE"))).otherwise(b.cast("binary"))
    )
    d = _bodies(spark, sf).select("seq", text.decoded(raw).alias("d"))
    return d.select("seq", "d.encoding", "d.fallback", F.sha2("d.text", 256).alias("sha256"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}


def _codes(rows: str, rules: dict[str, str]) -> str:
    return f"WITH r AS ({rows}) " + " UNION ALL ".join(f"SELECT seq, '{code}' AS code FROM r WHERE {wrong}" for code, wrong in rules.items())


_SCANS = f"""SELECT doc_id AS seq, {_pick(validation.SECURITY, 'doc_id')} AS st, doc_id % 4 AS n, doc_id % 2 AS hi, doc_id % 4 - doc_id % 2 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS me,
  doc_id % 11 = 0 AS odd, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS red, doc_id % 5 = 0 AS ex, doc_id % 10 = 0 AS policy FROM documents"""
_REPRESENTED = f"""SELECT doc_id AS seq, {_pick(validation.CONVERSION, 'doc_id')} AS t, {_pick((*validation.CONVERSION, 'other'), 'doc_id')} AS p, doc_id % 2 = 0 AS a, doc_id % 3 > 0 AS q,
  doc_id % 4 = 0 AS cut, octet_length(encode(coalesce(text, ''))) AS size, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS more, doc_id % 3 = 0 AS pg, doc_id % 4 = 0 AS pp,
  CASE WHEN doc_id % 19 = 0 THEN octet_length(encode(coalesce(text, ''))) + 2 WHEN doc_id % 5 = 0 THEN 0 ELSE octet_length(encode(coalesce(text, ''))) END AS x,
  CASE WHEN doc_id % 29 = 0 THEN 'crlf' WHEN doc_id % 7 > 0 THEN 'lf' ELSE 'none' END AS nl, CASE doc_id % 8 WHEN 0 THEN '' WHEN 3 THEN 'failed' END AS er FROM documents"""
SQL = {
    "validate_integrity": _codes(
        f"SELECT doc_id AS seq, {_pick(('pending', 'computed', 'failed', 'other'), 'doc_id')} AS st, doc_id % 3 AS v, doc_id % 5 AS e FROM documents",
        {"integrity-status": "st = 'other'", "integrity-pending": "st = 'pending' AND (v < 2 OR e < 2)", "integrity-computed": "st = 'computed' AND (v > 0 OR e < 2)", "integrity-failed": "st = 'failed' AND (v < 2 OR e > 0)"},
    ),
    "validate_security": _codes(_SCANS, {
        "security-severity-count": "hi + me <> n", "security-category": "odd", "security-not-scanned-findings": "st = 'not-scanned' AND n > 0", "security-clean-findings": "st = 'clean' AND n > 0",
        "security-findings-required": "st IN ('flagged', 'redacted', 'excluded') AND n = 0", "security-excluded-state": "st = 'excluded' AND NOT ex", "security-excluded-flag": "st <> 'excluded' AND ex",
        "security-redaction-required": "st = 'redacted' AND red = 0", "security-redaction-state": "st <> 'redacted' AND red > 0", "security-inclusion": "ex AND NOT policy",
    }),
    "security_totals": f"""SELECT 'documents' AS bundle_id, count(*) FILTER (WHERE st <> 'not-scanned') AS scanned, count(*) FILTER (WHERE n > 0) AS flagged, CAST(sum(n) AS BIGINT) AS findings,
  CAST(sum(red) AS BIGINT) AS redactions, count(*) FILTER (WHERE ex) AS excluded, count(*) FILTER (WHERE st = 'failed') AS failed FROM ({_SCANS})""",
    "validate_representation": _codes(_REPRESENTED, {
        "representation-status": "p = 'other'", "markdown-anchor": "a AND seq % 13 = 0", "markdown-original-bytes": "more > 0", "markdown-extracted-bytes": "x > size + more", "markdown-encoding": "seq % 23 = 0",
        "markdown-newlines": "nl = 'crlf'", "markdown-pending": "t LIKE 'not-%' AND (a OR q OR x > 0 OR er IS NOT NULL)", "markdown-completed": "t IN ('completed', 'partial') AND NOT (a AND q AND er IS NULL AND nl = 'lf')",
        "markdown-completed-truncated": "t = 'completed' AND cut", "markdown-partial-truncated": "t = 'partial' AND NOT cut", "markdown-failed": "t = 'failed' AND NOT (a AND q AND coalesce(er, '') <> '')",
        "pdf-pending": "p LIKE 'not-%' AND (pg OR pp)", "pdf-generated": "p IN ('completed', 'partial') AND NOT (pg AND pp)", "pdf-security-omission": "(seq % 31 = 0 OR seq % 37 = 0) AND (p <> 'not-applicable' OR pg OR pp)",
    }),
    "validate_children": _sql(NODES, """SELECT bundle_id, CASE WHEN name LIKE '%8%' THEN 'dir_0' ELSE parent_id END AS node_id, CASE WHEN name LIKE '%9%' THEN node_id || 'x' ELSE node_id END AS child_id,
  CASE WHEN name LIKE '%9%' THEN 'file-child' ELSE 'file-child-parent' END AS code FROM nodes WHERE parent_id IS NOT NULL AND (name LIKE '%8%' OR name LIKE '%9%')"""),
    "validate_pages": """WITH p AS (SELECT l_orderkey AS bundle_id, CAST(l_linenumber + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS page FROM lineitem),
c AS (SELECT bundle_id, page, count(*) AS n, lag(page) OVER (PARTITION BY bundle_id ORDER BY page) AS prior FROM p GROUP BY bundle_id, page)
SELECT bundle_id, page, 'page-repeated' AS code FROM c WHERE n > 1 UNION ALL SELECT bundle_id, page, 'page-sequence' FROM c WHERE page <> 1 AND (prior IS NULL OR prior <> page - 1)""",
    "status_combine": f"""SELECT seq, CASE WHEN a = 'not-applicable' THEN a WHEN a = 'failed' AND b = 'failed' THEN 'failed' WHEN a = 'completed' AND b = 'completed' THEN 'completed'
  WHEN b = 'failed' AND a = 'not-started' THEN 'failed' ELSE 'partial' END AS status FROM (SELECT doc_id AS seq, {_pick(validation.CONVERSION, 'doc_id')} AS a, {_pick(validation.CONVERSION, 'doc_id // 5')} AS b FROM documents)""",
    "manifest_security": _sql(SELECTED, """, g AS (SELECT *, seq % 12 = 0 AS gone FROM sel) SELECT bundle_id, seq, reason = 'selected' AND NOT gone AS included, CASE WHEN gone THEN 'excluded-secret-policy' ELSE reason END AS reason,
  CASE WHEN reason = 'excluded-glob' AND NOT gone THEN hit END AS matched_glob, CASE WHEN gone THEN 'not-applicable' WHEN reason = 'selected' THEN 'pending' ELSE 'skipped' END AS status,
  CASE WHEN seq % 4 = 1 THEN 'not-scanned' WHEN gone THEN 'excluded' WHEN seq % 3 = 0 THEN 'flagged' ELSE 'clean' END AS security_status, CASE WHEN seq % 4 <> 1 AND seq % 3 = 0 THEN 2 ELSE 0 END AS finding_count FROM g"""),
    "import_summary": _sql(NODES, """SELECT f.bundle_id, f.files, f.bytes, d.directories FROM (SELECT bundle_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM good GROUP BY bundle_id) f
JOIN (SELECT bundle_id, count(*) AS directories FROM nodes WHERE kind = 'directory' AND path <> '' GROUP BY bundle_id) d ON d.bundle_id = f.bundle_id"""),
    "warning_union": _sql(BODIES, """, w AS (SELECT seq, word, min(i) AS i FROM (SELECT seq, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT seq, string_split(body, ' ') || ['last'] AS l FROM bodies)) GROUP BY seq, word)
SELECT seq, sha256(string_agg(word, ' ' ORDER BY i)) AS sha256 FROM w GROUP BY seq"""),
    "escape_markdown": _sql(BODIES, r"SELECT seq, sha256(regexp_replace(replace(replace(replace(body || '<a&b>[*_#]\', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\*_\[\]#])', '\\\1', 'g')) AS sha256 FROM bodies"),
    "decode_text": _sql(BODIES, r"SELECT seq, (['utf-8-bom', 'utf-16le', 'utf-16be', 'utf-8'])[seq % 4 + 1] AS encoding, FALSE AS fallback, sha256(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha256 FROM bodies"),
}
