"""Registered queries of listings, rollups and previews, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import rollups, tree, validation
from .queries import _KEY, BODIES, CLASSIFIED, NODES, SELECTED, _bodies, _files, _good, _records, _selected, _sql


def q_tree_preorder(spark, sf):
    return rollups.preorder(tree.nodes(_files(spark, sf).filter("error is null")))


def _states(spark, sf):
    status = lambda by: F.get(F.array(*map(F.lit, validation.CONVERSION)), (by % len(validation.CONVERSION)).cast("int"))
    return _bodies(spark, sf).select("bundle_id", "seq", status(F.col("seq")).alias("one"), status(F.floor(F.col("seq") / 5)).alias("other"), F.octet_length("body").alias("size"))


def q_issue_rollup(spark, sf):
    s = F.col("seq")
    said = lambda *words: F.array(*map(F.lit, words))
    none = F.expr("cast(array() as array<string>)")
    one = F.when(s % 3 == 0, said("cut", "odd bytes", "cut")).when(s % 3 == 1, said("odd bytes")).otherwise(none)
    other = F.when(s % 2 == 0, said("no page")).otherwise(none)
    rows = _states(spark, sf)
    both = rows.select("bundle_id", "seq", F.lit(0).alias("place"), F.lit("Markdown").alias("source"), F.col("one").alias("status"), one.alias("messages"))
    both = both.unionByName(rows.select("bundle_id", "seq", F.lit(1).alias("place"), F.lit("PDF").alias("source"), F.col("other").alias("status"), other.alias("messages")))
    return rollups.issue_rollup(both).select("seq", "status", F.array_join("details", "; ").alias("details"))


def q_artifact_snapshot(spark, sf):
    return rollups.snapshot(_states(spark, sf).withColumnRenamed("one", "status"))


def q_processable_files(spark, sf):
    rows = _selected(spark, sf)
    keep = rollups.processable(F.col("included"), F.col("level").isin("A", "B"), F.col("mime"), F.col("category"), F.col("extension"))
    return rows.filter(keep).select("bundle_id", "seq")


def q_unmatched_files(spark, sf):
    return rollups.unmatched(_good(spark, sf), _records(spark, sf).filter("seq % 7 <> 0")).select("bundle_id", "seq")


def q_human_bytes(spark, sf):
    size = F.octet_length("body").cast("long")
    return _bodies(spark, sf).select("seq", *(text.human_bytes(size * m).alias(f"size_{m}") for m in (1, 977, 1048583)))


def q_used_range(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    cells = li.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 26 + 1).alias("col"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit("=A1")).alias("formula"), (F.col("l_partkey") % 11 == 0).alias("cut"))
    return rollups.used_range(cells)


def q_preview_pages(spark, sf):
    """Lines are wrapped by a rule that SQL has no form for; the test compares with brute force."""
    folded = text.ascii_folded(text.normalize_newlines(F.col("body")), keep=r"\n")
    pages = _bodies(spark, sf).select("seq", folded.alias("folded")).select("seq", F.posexplode(text.preview_pages(F.col("folded"))).alias("page", "lines"))
    return pages.select("seq", "page", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("sha256"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_STATE = "([" + ", ".join(f"'{v}'" for v in validation.CONVERSION) + f"])[{{}} % {len(validation.CONVERSION)} + 1]"
_WEIGHT = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rollups.ISSUE_WEIGHT.items()) + " END"
_LEVELS = _KEY.replace("lower(name)", "lower(x)")
_HUMAN = lambda n: f"CASE WHEN {n} < 1024 THEN {n} || ' B' " + " ".join(
    f"{'WHEN ' + n + ' < ' + str(d * 1024) + ' THEN' if u != 'GB' else 'ELSE'} rtrim(rtrim(format('{{:,.2f}}', round({n} / {d}.0::DOUBLE, 2)), '0'), '.') || ' {u}'" for d, u in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB"))) + " END"
SQL = {
    "tree_preorder": _sql(NODES, f""", keyed AS (SELECT *, CASE WHEN path = '' THEN '' ELSE array_to_string(list_transform(string_split(path, '/'), lambda x, i:
  (CASE WHEN i = len(string_split(path, '/')) AND kind = 'file' THEN '1' ELSE '0' END) || {_LEVELS} || chr(1) || x), chr(2)) END AS key FROM nodes)
SELECT bundle_id, path, kind, depth, row_number() OVER (PARTITION BY bundle_id ORDER BY key) AS position FROM keyed"""),
    "issue_rollup": f"""WITH d AS (SELECT doc_id AS seq, {_STATE.format('doc_id')} AS one, {_STATE.format('doc_id // 5')} AS other FROM documents),
w AS (SELECT seq, {_WEIGHT('one')} AS a, {_WEIGHT('other')} AS b, seq % 3 < 2 AS has_a, seq % 2 = 0 AS has_b FROM d),
m AS (SELECT *, CASE WHEN has_a AND has_b THEN greatest(a, b) WHEN has_a THEN a ELSE b END AS w FROM w WHERE has_a OR has_b)
SELECT seq, (['not-applicable', 'completed', 'not-started', 'partial', 'failed'])[w + 1] AS status,
  concat_ws('; ', CASE seq % 3 WHEN 0 THEN '[Markdown] cut; [Markdown] odd bytes' WHEN 1 THEN '[Markdown] odd bytes' END, CASE WHEN has_b THEN '[PDF] no page' END) AS details FROM m""",
    "artifact_snapshot": f"""SELECT 'documents' AS bundle_id, count(*) FILTER (WHERE s = 'completed') AS completed_files, count(*) FILTER (WHERE s = 'partial') AS partial_files, count(*) FILTER (WHERE s = 'failed') AS failed_files,
  CAST(sum(n) AS BIGINT) AS total_bytes FROM (SELECT {_STATE.format('doc_id')} AS s, octet_length(encode(coalesce(text, ''))) AS n FROM documents)""",
    "processable_files": _sql(SELECTED, """SELECT bundle_id, seq FROM sel WHERE reason = 'selected' AND (level IN ('A', 'B') OR mime = 'application/pdf' OR category = 'image'
  OR (category = 'spreadsheet' AND extension IN ('xlsx', 'xlsm')) OR (category = 'document' AND extension IN ('docx', 'docm')) OR (category = 'presentation' AND extension IN ('pptx', 'pptm')))"""),
    "unmatched_files": _sql(CLASSIFIED, "SELECT bundle_id, seq FROM classified WHERE seq % 7 = 0"),
    "human_bytes": _sql(BODIES, ", n AS (SELECT seq, CAST(octet_length(encode(body)) AS BIGINT) AS n FROM bodies) SELECT seq, " + ", ".join(f"{_HUMAN(f'(n * {m})')} AS size_{m}" for m in (1, 977, 1048583)) + " FROM n"),
    "used_range": """SELECT l_orderkey AS sheet, min(l_linenumber) AS first_row, max(l_linenumber) AS last_row, min(l_suppkey % 26 + 1) AS first_col, max(l_suppkey % 26 + 1) AS last_col, count(*) AS cells,
  count(*) FILTER (WHERE l_partkey % 3 = 0) AS formulas, bool_or(l_partkey % 11 = 0) AS truncated FROM lineitem GROUP BY l_orderkey""",
}
