"""Registered queries of the library with their SQL, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import formats, paths, text
from .operators import importing, lineage, manifest, packing, preflight, security, selection, spreadsheet, tree
from .plans import bundle
from .sources import archives
from .sources import files as sources

GLOBS = ["conversations/**/*_system.*", "pages/page_1?.*", "documents/src1/**"]


def _files(spark, sf):
    return importing.with_paths(lineage.spread(sources.demo_files(spark, sf)))


def _good(spark, sf):
    rows = importing.accepted(_files(spark, sf))
    return rows.withColumn("content", F.col("body").cast("binary")).withColumn("compressed_size", F.floor(F.col("size") / (1 + F.col("seq") % 60)).cast("long")).drop("body", "raw_path")


def _records(spark, sf):
    return preflight.records(_good(spark, sf))


def _selected(spark, sf):
    out = _good(spark, sf).filter("seq % 9 = 0").select("bundle_id", "seq")
    return selection.inclusion(_records(spark, sf), GLOBS, out)


def _bodies(spark, sf):
    """Whole texts of the documents as files."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select(F.lit("documents").alias("bundle_id"), F.col("doc_id").alias("seq"), F.concat_ws("/", "source", F.concat(F.lit("doc_"), "doc_id", F.lit(".md"))).alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    return lineage.spread(rows)


def _password_spans(spark, sf):
    found = security.findings(_bodies(spark, sf), security.ScanPolicy(None, None, high_entropy=False))
    return found.filter("category = 'password-assignment'")


def q_import_accepted(spark, sf):
    return importing.accepted(_files(spark, sf)).select("bundle_id", "seq", "path", "name", "extension", "depth")


def q_import_issues(spark, sf):
    return importing.issues(_files(spark, sf))


def q_path_conflicts(spark, sf):
    return importing.path_conflicts(_files(spark, sf).filter("error is null"))


def q_import_greedy(spark, sf):
    return importing.accept_greedy(_files(spark, sf))


def q_path_ancestors(spark, sf):
    rows = _files(spark, sf).filter("error is null")
    return rows.select("bundle_id", "seq", F.array_join(paths.ancestors(F.col("path")), "|").alias("ancestors"), paths.parent(F.col("path")).alias("parent"))


def q_node_ids(spark, sf):
    return _files(spark, sf).filter("error is null").select("bundle_id", "seq", paths.node_id("file", F.col("path")).alias("node_id"))


def q_registry_lookup(spark, sf):
    rows = preflight.looked_up(_files(spark, sf).filter("error is null"))
    return rows.select("bundle_id", "seq", F.col("registered.mime").alias("mime"), F.col("registered.category").alias("category"), F.col("registered.level").alias("level"), F.col("registered.adapter").alias("adapter"))


def q_signature_detect(spark, sf):
    s = formats.signature_of(F.col("content"))
    return _good(spark, sf).select("bundle_id", "seq", s["mime"].alias("mime"), s["category"].alias("category"))


def q_text_sniff(spark, sf):
    s = text.sniffed(F.substring("content", 1, preflight.SAMPLE_BYTES))
    return _good(spark, sf).select("bundle_id", "seq", s["is_text"].alias("is_text"), s["encoding"].alias("encoding"))


def q_classify_files(spark, sf):
    return preflight.classified(_good(spark, sf)).select("bundle_id", "seq", "mime", "category", "level", "adapter", "method", "is_text")


def q_risk_assess(spark, sf):
    rows = _records(spark, sf)
    return rows.select("bundle_id", "seq", F.array_join(F.transform("risks", lambda r: F.concat(r["code"], F.lit(":"), r["level"])), ",").alias("risks"), "risk_level")


def q_size_estimate(spark, sf):
    return _records(spark, sf).select("bundle_id", "seq", "md_min", "md_max", "pdf_min", "pdf_max", "mf_min", "mf_max")


def q_preflight_totals(spark, sf):
    return preflight.totals(_records(spark, sf))


def q_output_mode(spark, sf):
    return preflight.output_mode(preflight.totals(_records(spark, sf)))


def q_inclusion(spark, sf):
    return _selected(spark, sf).select("bundle_id", "seq", "included", "reason", "matched_glob")


def q_view_filter(spark, sf):
    return selection.view(_selected(spark, sf), "SRC", "A", "all", True).select("bundle_id", "seq", "path")


def q_manifest_summary(spark, sf):
    return manifest.summary(_selected(spark, sf))


def q_tree_nodes(spark, sf):
    return tree.nodes(_files(spark, sf).filter("error is null")).select("bundle_id", "node_id", "parent_id", "kind", "name", "path", "depth")


def q_tree_order(spark, sf):
    return tree.ordered_children(tree.nodes(_files(spark, sf).filter("error is null"))).select("bundle_id", "path", "kind", "ordinal")


def q_tree_render(spark, sf):
    return tree.rendered(tree.nodes(_files(spark, sf).filter("error is null")))


def q_dangling_refs(spark, sf):
    nodes = tree.nodes(_files(spark, sf).filter("error is null")).filter("not (kind = 'directory' and name like 'conv_1%')")
    return tree.dangling(nodes).select("bundle_id", "path")


def q_content_sha256(spark, sf):
    return _bodies(spark, sf).select("seq", F.sha2("body", 256).alias("sha256"), F.octet_length("body").cast("long").alias("bytes"))


def q_text_stats(spark, sf):
    b = F.col("body")
    return _bodies(spark, sf).select("seq", text.line_count(b).cast("long").alias("lines"), text.longest_run(b, "*").cast("long").alias("stars"), text.longest_run(b, "%").cast("long").alias("percents"))


def q_line_numbers(spark, sf):
    return _bodies(spark, sf).select("seq", F.sha2(text.with_line_numbers(F.col("body")), 256).alias("numbered_sha256"))


def q_normalize_newlines(spark, sf):
    odd = F.replace("body", F.lit("\n"), F.when(F.col("seq") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r")))
    return _bodies(spark, sf).select("seq", F.sha2(text.normalize_newlines(odd), 256).alias("sha256"))


def q_fence_language(spark, sf):
    return _files(spark, sf).filter("error is null").select("bundle_id", "seq", formats.fence_language(F.col("name"), F.col("extension")).alias("language"))


def q_safe_fence(spark, sf):
    ticked = F.concat("body", F.repeat(F.lit("`"), (F.col("seq") % 6).cast("int")), F.lit(" "), F.repeat(F.lit("~"), (F.col("seq") % 4).cast("int")))
    return _bodies(spark, sf).select("seq", text.safe_fence(ticked).alias("fence"))


def q_crop_text(spark, sf):
    return _bodies(spark, sf).select("seq", text.cropped(F.col("body"), 80).alias("cropped"))


def q_formula_guard(spark, sf):
    sign = F.get(F.array(*map(F.lit, ["=", "+", "-", "@", "a", ""])), (F.col("seq") % 6).cast("int"))
    return _bodies(spark, sf).select("seq", text.formula_guarded(F.concat(sign, F.col("seq").cast("string"))).alias("guarded"))


def q_password_findings(spark, sf):
    return _password_spans(spark, sf).select("seq", "start", "end", "line", "column")


def q_redact_passwords(spark, sf):
    out = security.redacted(_bodies(spark, sf), _password_spans(spark, sf))
    return out.filter("redactions > 0").select("seq", "redactions", F.sha2("body", 256).alias("sha256"))


def q_secret_findings(spark, sf):
    return security.findings(_bodies(spark, sf), security.ScanPolicy(None, None)).select("seq", "finding_id", "ordinal", "category", "severity", "source", "confidence", "start", "end", "line", "column")


def q_scan_reports(spark, sf):
    """Under limits that bind: the number of findings and of characters are what a policy is for."""
    policy = security.ScanPolicy(2, 3000)
    rows = _bodies(spark, sf)
    out = security.scan_reports(rows, security.findings(rows, policy), policy)
    return out.select("seq", "status", "scanned_characters", "scan_truncated", "finding_count", F.array_join("categories", ",").alias("categories"), F.array_join("warnings", ",").alias("warnings"))


def q_security_summary(spark, sf):
    rows, policy = _bodies(spark, sf), security.ScanPolicy(None, None)
    found = security.findings(rows, policy)
    return security.summary(found, reports=security.scan_reports(rows, found, policy))


def q_secure_modes(spark, sf):
    rows, found = _bodies(spark, sf), _password_spans(spark, sf)
    one = lambda m: security.by_mode(rows, found, m).groupBy(F.lit(m).alias("mode"), "status").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("body")).alias("characters"))
    return one("report").unionByName(one("redact")).unionByName(one("exclude"))


def q_shannon_entropy(spark, sf):
    chars = _bodies(spark, sf).filter("body <> ''").select("seq", F.explode(F.split("body", "")).alias("c"))
    counts = chars.groupBy("seq", "c").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("seq").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select("seq", F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


def q_merge_intervals(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    spans = ev.select("user_id", (F.col("event_id") * 37 % 10007).alias("start"), (F.col("event_id") * 37 % 10007 + F.col("event_id") % 90).alias("end"), F.col("event_type").alias("category"))
    return security.merged_intervals(spans, ("user_id",)).select("user_id", "start", "end")


def q_pack_parts(spark, sf):
    pieces = F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("body") / 10_000).cast("int") - 1)))
    cut = _bodies(spark, sf).select("bundle_id", "seq", "body", pieces.alias("at", "piece"))  # pieces of at most 10,000 characters
    atoms = cut.select("bundle_id", (F.col("seq") * 1_000_000 + F.col("at")).alias("ordinal"), F.octet_length(F.substr("body", F.col("at") * 10_000 + 1, F.lit(10_000))).cast("long").alias("byte_length"))
    return packing.pack(atoms, 64_512 + packing.RESERVED).select("ordinal", "part")


def q_split_utf8(spark, sf):
    pieces = packing.segments(_bodies(spark, sf), 2000)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "content"))), lambda x: x["content"]), "")
    return pieces.groupBy("seq").agg(F.sha2(joined, 256).alias("sha256"), (F.max("byte_length") <= 2000).alias("fits"))


def q_running_budget(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("size", F.floor("o_totalprice").cast("long"))
    return packing.running_budget(orders, "o_custkey", "o_orderkey", "size", 400_000).select("o_orderkey", "running", "within")


def q_char_budget(spark, sf):
    rows = _bodies(spark, sf).select("seq", F.substring_index("path", "/", 1).alias("source"), F.length("body").cast("long").alias("n"))
    return packing.char_budget(rows, "source", "seq", "n", 50_000).select("seq", F.col("taken").cast("long").alias("taken"))


def q_page_budget_fit(spark, sf):
    rows = _bodies(spark, sf).select(F.substring_index("path", "/", 1).alias("bundle_id"), "path", F.ceil(F.length("body") / 3000).cast("long").alias("pages"))
    return packing.page_fit(rows.filter("pages > 0"), 60)


def q_excel_address(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 18278 + 1).alias("n"))
    letters = spreadsheet.column_letters(F.col("n"))
    return rows.select("o_orderkey", letters.alias("letters"), spreadsheet.column_number(letters).alias("n"))


def q_excel_serial(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 60000 + F.lit(0.25)).alias("serial"))
    return rows.select("o_orderkey", spreadsheet.serial_to_iso(F.col("serial")).alias("iso"))


def q_grid_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("sheet"), (F.col("c_custkey") % 130).alias("n_rows"), (F.col("c_custkey") % 31).alias("n_columns"))
    return packing.grid_pages(rows).withColumns({c: F.col(c).cast("long") for c in ("first_row", "first_column")})


def q_densify_grid(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    cells = li.groupBy(F.col("l_suppkey").alias("sheet"), F.col("l_linenumber").cast("int").alias("row"), (F.col("l_orderkey") % 5 + 1).cast("int").alias("col")).agg(F.min("l_partkey").alias("value"))
    return spreadsheet.densified(cells, 7, 6)


def q_image_resize_plan(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey") * 7919 % 9000 + 1).cast("long").alias("width"), (F.col("p_partkey") * 104729 % 7000 + 1).cast("long").alias("height"), (F.col("p_partkey") % 8 + 1).alias("orientation"))
    return packing.resize_plan(rows).select("p_partkey", "target_width", "target_height")


def q_sections(spark, sf):
    rows = _bodies(spark, sf).withColumn("name", F.substring_index("path", "/", -1)).withColumn("extension", F.lit("md"))
    return bundle.sections(rows).select("ordinal.path", "ordinal.segment", "byte_length", F.sha2("content", 256).alias("sha256"))


def q_html_active_counts(spark, sf):
    return archives.active_counts(spark.read.parquet(f"{sf}/pages.parquet"))


def q_html_text(spark, sf):
    return archives.html_text(spark.read.parquet(f"{sf}/pages.parquet"))


def q_validate_inclusion(spark, sf):
    recs = manifest.file_records(_selected(spark, sf))
    broken = recs.withColumn("included", F.when(F.col("seq") % 50 == 0, ~F.col("included")).otherwise(F.col("included")))
    return manifest.inconsistent(broken)


def q_validate_unique(spark, sf):
    return manifest.repeated_values(_files(spark, sf).filter("error is null"), "path")


def q_file_security(spark, sf):
    return security.file_rollup(_password_spans(spark, sf)).select("seq", "high", "medium", F.array_join("categories", ",").alias("categories"))


def q_sensitive_names(spark, sf):
    rows = _files(spark, sf).filter("error is null")
    return rows.select("bundle_id", "seq", security.sensitive_name(F.col("path")).alias("sensitive")).filter("sensitive")


def q_cap_and_count(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return spreadsheet.capped(li, "l_suppkey", "l_orderkey", 500)


def q_interval_overlap(spark, sf):
    rows = _password_spans(spark, sf).select("seq", "start", "end")
    a, b = (rows.select("seq", *[F.col(c).alias(f"{c}_{x}") for c in ("start", "end")]) for x in "ab")
    return a.join(b, "seq").filter("start_a < start_b and start_b < end_a + 2000").select("seq", "start_a", "start_b")


_EXT = "[" + ", ".join(f"'{e}'" for e in sources.EXTENSIONS) + "]"
_chr = lambda s: "||".join(f"chr({ord(c)})" for c in s)
_HEAD = "CASE seq % 41 " + " ".join(f"WHEN {i} THEN {_chr(h)}" for i, h in enumerate(sources.HEADS)) + " ELSE '' END"
FILES = f"""
raw0 AS (
  SELECT 'documents' AS bundle_id, doc_id AS seq, 'documents/'||source||'/'||lang||'/doc_'||doc_id AS stem, text, CAST(NULL AS VARCHAR) AS mime_declared FROM documents
  UNION ALL SELECT 'pages', page_id, 'pages/page_'||page_id, html, 'text/html' FROM pages
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, 'conversations/conv_'||conv_id||'/'||turn||'_'||role, text, NULL FROM conversations),
raw1 AS (SELECT bundle_id, seq, mime_declared, {_HEAD} || coalesce(text, '') AS body, ({_EXT})[seq % {len(sources.EXTENSIONS)} + 1] AS ext, stem FROM raw0),
raw2 AS (SELECT *, CASE WHEN seq % 17 = 0 THEN bundle_id||'/dup/shared_'||(seq % 5)||'.txt' WHEN seq % 37 = 0 THEN bundle_id||'/dup' ELSE stem || CASE WHEN ext = '' THEN '' ELSE '.'||ext END END AS p FROM raw1),
files AS (SELECT bundle_id, seq, mime_declared, body, octet_length(encode(body)) AS size,
  CASE WHEN seq % 13 = 0 THEN '../' WHEN seq % 7 = 0 THEN './' ELSE '' END || CASE WHEN seq % 11 = 0 THEN replace(p, '/', chr(92)) ELSE p END AS raw_path, p AS path,
  CASE WHEN seq % 13 = 0 THEN 'path-traversal' END AS error FROM raw2),
named AS (SELECT *, string_split(path, '/')[-1] AS name, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM files WHERE error IS NULL),
valid AS (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS extension, row_number() OVER (PARTITION BY bundle_id, path ORDER BY seq) AS copy FROM named),
good AS (SELECT *, size // (1 + seq % 60) AS compressed_size FROM valid WHERE copy = 1)
"""
_b = lambda x: "TRUE" if x else "FALSE"
_REG = ", ".join("(" + ", ".join(_b(v) if isinstance(v, bool) else f"'{v}'" for v in r) + ")" for r in formats.registry_rows())
_SIG = "CASE " + " ".join("WHEN " + " AND ".join(f"substr(hx, {2 * at + 1}, {len(code)}) = '{code}'" for at, code in parts) + f" THEN {{{'mime'!r}: {m!r}, {'category'!r}: {c!r}, {'executable'!r}: {_b(x)}}}" for parts, m, c, x in formats.SIGNATURES) + " END"
REGISTERED = f"""
reg(kind, key, mime, category, level, adapter, macro, active, executable, nested) AS (VALUES {_REG}),
looked AS (SELECT g.*, coalesce(e.mime, n.mime) AS r_mime, coalesce(e.category, n.category) AS r_category, coalesce(e.level, n.level) AS r_level, coalesce(e.adapter, n.adapter) AS r_adapter,
  coalesce(e.macro, n.macro, FALSE) AS r_macro, coalesce(e.active, n.active, FALSE) AS r_active, coalesce(e.executable, n.executable, FALSE) AS r_executable, coalesce(e.nested, n.nested, FALSE) AS r_nested
  FROM {{source}} g LEFT JOIN reg e ON e.kind = 'extension' AND e.key = g.extension LEFT JOIN reg n ON n.kind = 'name' AND n.key = lower(g.name))
"""
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
CLASSIFIED = (
    FILES
    + ","
    + REGISTERED.format(source="good")
    + f""",
signed0 AS (SELECT *, hex(encode(substr(body, 1, 16))) AS hx, 1 - (length(body) - length(regexp_replace(body, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))) / length(body) AS printable FROM looked),
signed AS (SELECT *, {_SIG} AS sig, coalesce(printable >= 0.85, TRUE) AS txt FROM signed0),
cases AS (SELECT *, CASE WHEN sig.executable THEN 1
  WHEN (sig.mime = 'application/zip' AND extension IN {_in(formats.ZIP_CONTAINERS)}) OR (sig.mime = 'application/x-ole-storage' AND extension IN {_in(formats.OLE_CONTAINERS)}) THEN 2
  WHEN sig IS NOT NULL AND r_mime = sig.mime THEN 3 WHEN sig IS NOT NULL THEN 4 WHEN r_adapter = 'text' AND NOT txt THEN 5 WHEN r_mime IS NOT NULL THEN 6 WHEN txt THEN 7
  WHEN mime_declared LIKE 'text/%' THEN 8 ELSE 9 END AS k FROM signed),
classified AS (SELECT *, CASE WHEN k IN (1, 3, 4) THEN sig.mime WHEN k IN (2, 6) THEN r_mime WHEN k = 7 THEN 'text/plain' WHEN k = 8 THEN mime_declared ELSE 'application/octet-stream' END AS mime,
  CASE WHEN k IN (1, 3, 4) THEN sig.category WHEN k IN (2, 6) THEN r_category WHEN k IN (7, 8) THEN 'text' ELSE 'binary' END AS category,
  CASE WHEN k = 1 THEN 'E' WHEN k IN (2, 3, 6) THEN r_level WHEN k = 4 THEN CASE WHEN sig.category = 'image' THEN 'C' ELSE 'D' END WHEN k IN (7, 8) THEN 'B' ELSE 'D' END AS level,
  CASE WHEN k = 1 THEN 'blocked' WHEN k IN (2, 3, 6) THEN r_adapter WHEN k = 4 THEN CASE WHEN sig.category = 'image' THEN 'image' ELSE 'inventory' END WHEN k IN (7, 8) THEN 'text' ELSE 'inventory' END AS adapter,
  CASE WHEN k IN (1, 3, 4) THEN 'signature' WHEN k = 2 THEN 'container-extension' WHEN k = 6 THEN 'extension' WHEN k = 7 THEN 'text-heuristic' WHEN k = 8 THEN 'declared' ELSE 'unknown' END AS method,
  CASE WHEN k = 6 THEN txt WHEN k IN (7, 8) THEN TRUE ELSE FALSE END AS is_text,
  k IN (2, 3, 6) AND r_macro AS macro, k IN (2, 3, 6) AND r_active AS active, k = 1 OR (k IN (2, 3, 6) AND r_executable) AS executable, k IN (2, 3, 6) AND r_nested AS nested FROM cases)
"""
)
_SENS = " OR ".join("regexp_matches(path, '" + p.replace("\\A", "^").replace("\\z", "$").replace("'", "''") + "')" for p in preflight.SENSITIVE)
_est = lambda at, end: (
    f"CASE WHEN level = 'E' THEN {preflight.BLOCKED_RANGES[at][end]} " + " ".join(f"WHEN category = '{c}' THEN " + (str(r[at][end]) if isinstance(r[at][end], int) else f"CAST(floor(size * CAST({r[at][end]} AS DOUBLE) + 0.5) AS BIGINT)") for c, r in preflight.FACTORS.items()) + f" ELSE {preflight.OTHER_RANGES[at][end]} END"
)
RECORDS = (
    CLASSIFIED
    + f""",
risky AS (SELECT *, list_filter([CASE WHEN executable THEN 'executable-content:high' END, CASE WHEN macro THEN 'office-macro:high' END, CASE WHEN active THEN 'active-content:medium' END, CASE WHEN nested THEN 'archive-nested:medium' END,
  CASE WHEN {_SENS} THEN 'sensitive-name:high' END, CASE WHEN size >= 209715200 THEN 'large-file:high' WHEN size >= 52428800 THEN 'large-file:medium' END,
  CASE WHEN compressed_size > 0 AND size >= 50 * compressed_size THEN 'compression-ratio:medium' END,
  CASE WHEN mime_declared IS NOT NULL AND method IN ('signature', 'container-extension') AND mime_declared <> mime THEN 'mime-mismatch:medium' END,
  CASE WHEN adapter = 'inventory' AND category = 'binary' THEN 'binary-unknown:medium' END], lambda x: x IS NOT NULL) AS rs FROM classified),
recs AS (SELECT *, CASE WHEN len(list_filter(rs, lambda x: x LIKE '%:high')) > 0 THEN 'high' WHEN len(rs) > 0 THEN 'medium' ELSE 'low' END AS risk_level,
  CAST({_est(0, 0)} AS BIGINT) AS md_min, CAST({_est(0, 1)} AS BIGINT) AS md_max, CAST({_est(1, 0)} AS BIGINT) AS pdf_min, CAST({_est(1, 1)} AS BIGINT) AS pdf_max, CAST(700 AS BIGINT) AS mf_min, CAST(1800 AS BIGINT) AS mf_max FROM risky)
"""
)
TOTALS = (
    RECORDS
    + """,
totals AS (SELECT bundle_id, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS logical_bytes, CAST(sum(compressed_size) AS BIGINT) AS compressed_bytes, max(size) AS largest, count(DISTINCT mime) AS mimes,
"""
    + ", ".join(f"count(*) FILTER (WHERE level = '{x}') AS level_{x.lower()}" for x in "ABCDE")
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE risk_level = '{x}') AS risk_{x}" for x in ("low", "medium", "high"))
    + ", "
    + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("md_min", "md_max", "pdf_min", "pdf_max", "mf_min", "mf_max"))
    + " FROM recs GROUP BY bundle_id)"
)
_GLOB = "CASE " + " ".join(f"WHEN regexp_full_match(path, '{paths.glob_regex(g)}') THEN '{g}'" for g in GLOBS) + " END"
SELECTED = (
    RECORDS
    + f""",
sel0 AS (SELECT *, {_GLOB} AS hit FROM recs),
sel AS (SELECT *, CASE WHEN level = 'E' THEN 'blocked-capability' WHEN hit IS NOT NULL THEN 'excluded-glob' WHEN seq % 9 = 0 THEN 'excluded-manual' ELSE 'selected' END AS reason FROM sel0)
"""
)
_id = lambda kind, p: f"'{'dir' if kind == 'directory' else 'file'}_' || sha256('sheafline'||chr(0)||'manifest-v1'||chr(0)||'{kind}'||chr(0)||{p})"
_up = lambda p: f"array_to_string(list_slice(string_split({p}, '/'), 1, -2), '/')"
NODES = (
    FILES
    + f""",
own AS (SELECT DISTINCT bundle_id, path FROM valid),
dirs AS (SELECT DISTINCT bundle_id, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS path FROM own, unnest(range(1, len(string_split(path, '/')))) AS u(i) UNION SELECT DISTINCT bundle_id, '' FROM own),
kinds AS (SELECT bundle_id, path, 'directory' AS kind FROM dirs UNION ALL SELECT bundle_id, path, 'file' FROM own),
nodes AS (SELECT bundle_id, CASE WHEN kind = 'directory' THEN {_id("directory", "path")} ELSE {_id("file", "path")} END AS node_id,
  CASE WHEN path <> '' THEN {_id("directory", _up("path"))} END AS parent_id, kind, string_split(path, '/')[-1] AS name, path, CAST(CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS INTEGER) AS depth FROM kinds)
"""
)
_KEY = r"array_to_string(list_transform(regexp_extract_all(lower(name), '(\d+|\D+)', 1), lambda s: CASE WHEN regexp_full_match(s, '\d+') THEN lpad(s, CAST(greatest(length(s), 20) AS INTEGER), '0') ELSE s END), '')"
BODIES = "bodies AS (SELECT 'documents' AS bundle_id, doc_id AS seq, source||'/doc_'||doc_id||'.md' AS path, coalesce(text, '') AS body FROM documents)"
_PW = r"(?i)(^|[^A-Za-z0-9_])((?:password|passwd|pwd|secret|token|api[_-]?key|client[_-]?secret|access[_-]?key)[\x20\x09-\x0D]*[:=][\x20\x09-\x0D]*[\x22\x27]?)([^\x20\x09-\x0D\x22\x27#,;]{4,512})"
#: Pieces between findings give their places; no text of the tables has two findings that touch.
PASSWORDS = (
    BODIES
    + f""",
hits AS (SELECT seq, body, regexp_extract_all(body, '{_PW}', 0) AS m, regexp_extract_all(body, '{_PW}', 3) AS v, string_split_regex(body, '{_PW}') AS gaps FROM bodies WHERE regexp_matches(body, '{_PW}')),
spans AS (SELECT seq, body, CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i), lambda x: length(x))), 0) - length(v[i]) AS INTEGER) AS "start", length(v[i]) AS n FROM hits, unnest(range(1, len(m) + 1)) AS u(i))
"""
)

_RE2 = [(p.replace("{0,200000}?", "*?"), "(?i)" if flags else "", group) for _, _, _, group, p, flags in security.PATTERNS]
_CANDIDATES = [*[(flag + p, group) for p, flag, group in _RE2], ("[A-Za-z0-9_+/=-]{24,512}", 0)]
_quoted = lambda p: p.replace("'", "''")


def _secrets_sql(characters: int | None = None, bodies: str = BODIES) -> str:
    """Secrets of bodies (seq, body) in SQL: candidates of each pattern from the pieces between them, then what each rank adds to the ranks before it."""
    body = "body" if characters is None else f"substr(body, 1, {characters})"
    hits = " UNION ALL ".join(f"SELECT seq, {k} AS rank, b, regexp_extract_all(b, '{_quoted(p)}', 0) AS m, regexp_extract_all(b, '{_quoted(p)}', {g}) AS v, string_split_regex(b, '{_quoted(p)}') AS gaps FROM cut WHERE regexp_matches(b, '{_quoted(p)}')" for k, (p, g) in enumerate(_CANDIDATES))
    chars = "string_split(value, '')"
    good = f"rank < 6 OR (CAST(regexp_matches(value, '[a-z]') AS INT) + CAST(regexp_matches(value, '[A-Z]') AS INT) + CAST(regexp_matches(value, '[0-9]') AS INT) + CAST(regexp_matches(value, '[_+/=-]') AS INT) >= 3 AND len(list_distinct({chars})) >= 12 AND -list_sum(list_transform(list_distinct({chars}), lambda c: (length(value) - length(replace(value, c, ''))) / length(value) * log2((length(value) - length(replace(value, c, ''))) / length(value)))) >= 4.2)"
    kept = ["k0 AS (SELECT * FROM spans WHERE rank = 0)"] + [f"k{r} AS (SELECT * FROM k{r - 1} UNION ALL SELECT * FROM spans s WHERE rank = {r} AND NOT EXISTS (SELECT 1 FROM k{r - 1} k WHERE k.seq = s.seq AND k.a < s.b AND k.b > s.a))" for r in range(1, 7)]
    names = "CASE rank " + " ".join(f"WHEN {r} THEN '{c}'" for r, c in enumerate(security.RANKS[1:])) + " END"
    return (
        bodies
        + f""",
cut AS (SELECT seq, {body} AS b FROM bodies),
hits AS ({hits}),
placed AS (SELECT seq, rank, v[i] AS value, b AS whole, CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + list_sum(list_transform(list_slice(m, 1, i), lambda x: length(x))) - length(v[i]) AS INTEGER) AS a FROM hits, unnest(range(1, len(m) + 1)) AS u(i)),
spans AS (SELECT seq, rank, a, CAST(a + length(value) AS INTEGER) AS b, substr(whole, 1, a) AS ahead FROM placed WHERE {good}),
{", ".join(kept)},
found AS (SELECT *, {names} AS category, row_number() OVER (PARTITION BY seq ORDER BY rank, a) AS ordinal FROM k6)
"""
    )


def _sql(ctes: str, rest: str) -> str:
    """A query over common tables; rest may begin with more of them."""
    return f"WITH {ctes}{rest if rest.startswith(',') else chr(10) + rest}"


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
SQL = {
    "import_accepted": _sql(FILES, "SELECT bundle_id, seq, path, name, extension, depth FROM valid WHERE copy = 1"),
    "import_issues": _sql(FILES, "SELECT bundle_id, seq, error AS code, raw_path AS path FROM files WHERE error IS NOT NULL UNION ALL SELECT bundle_id, seq, 'duplicate-path', path FROM valid WHERE copy > 1"),
    "path_conflicts": _sql(FILES, "SELECT a.bundle_id, a.path, b.path AS conflict FROM (SELECT DISTINCT bundle_id, path FROM valid) a JOIN (SELECT DISTINCT bundle_id, path FROM valid) b ON a.bundle_id = b.bundle_id AND starts_with(a.path, b.path || '/')"),
    "path_ancestors": _sql(FILES, f"SELECT bundle_id, seq, array_to_string(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/')), '|') AS ancestors, {_up('path')} AS parent FROM valid"),
    "node_ids": _sql(FILES, f"SELECT bundle_id, seq, {_id('file', 'path')} AS node_id FROM valid"),
    "registry_lookup": _sql(FILES + "," + REGISTERED.format(source="valid"), "SELECT bundle_id, seq, r_mime AS mime, r_category AS category, r_level AS level, r_adapter AS adapter FROM looked"),
    "signature_detect": _sql(FILES, f"SELECT bundle_id, seq, sig.mime AS mime, sig.category AS category FROM (SELECT bundle_id, seq, {_SIG} AS sig FROM (SELECT *, hex(encode(substr(body, 1, 16))) AS hx FROM good))"),
    "text_sniff": _sql(FILES, "SELECT bundle_id, seq, t AS is_text, CASE WHEN t THEN 'utf-8' END AS encoding FROM (SELECT *, body = '' OR 1 - (length(body) - length(regexp_replace(body, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))) / length(body) >= 0.85 AS t FROM good)"),
    "classify_files": _sql(CLASSIFIED, "SELECT bundle_id, seq, mime, category, level, adapter, method, is_text FROM classified"),
    "risk_assess": _sql(RECORDS, "SELECT bundle_id, seq, array_to_string(rs, ',') AS risks, risk_level FROM recs"),
    "size_estimate": _sql(RECORDS, "SELECT bundle_id, seq, md_min, md_max, pdf_min, pdf_max, mf_min, mf_max FROM recs"),
    "preflight_totals": _sql(TOTALS, "SELECT *, logical_bytes + least(largest, 16777216) AS memory_min, logical_bytes + least(logical_bytes, greatest(largest * 3, 67108864)) AS memory_max FROM totals"),
    "output_mode": _sql(TOTALS, "SELECT bundle_id, CASE WHEN logical_bytes >= 786432000 OR file_count >= 10000 OR risk_high > 0 THEN 'quick-preview' WHEN md_max + pdf_max >= 104857600 THEN 'multipart' ELSE 'three-files' END AS mode FROM totals"),
    "inclusion": _sql(SELECTED, "SELECT bundle_id, seq, reason = 'selected' AS included, reason, CASE WHEN reason = 'excluded-glob' THEN hit END AS matched_glob FROM sel"),
    "view_filter": _sql(SELECTED, "SELECT bundle_id, seq, path FROM sel WHERE contains(lower(path), 'src') AND level = 'A' AND reason = 'selected'"),
    "manifest_summary": _sql(SELECTED, "SELECT bundle_id, count(*) AS files, count(*) FILTER (WHERE reason = 'selected') AS included, count(*) FILTER (WHERE reason <> 'selected') AS excluded, count(*) FILTER (WHERE reason = 'blocked-capability') AS blocked, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (WHERE reason = 'selected'), 0) AS BIGINT) AS included_bytes FROM sel GROUP BY bundle_id"),
    "tree_nodes": _sql(NODES, "SELECT * FROM nodes"),
    "tree_order": _sql(NODES, f"SELECT bundle_id, path, kind, CAST(row_number() OVER (PARTITION BY bundle_id, parent_id ORDER BY kind = 'file', {_KEY}, name) AS INTEGER) AS ordinal FROM nodes WHERE parent_id IS NOT NULL"),
    "tree_render": _sql(NODES, "SELECT bundle_id, path, repeat('  ', depth - 1) || '- ' || name || CASE WHEN kind = 'directory' THEN '/' ELSE '' END AS line FROM nodes WHERE path <> ''"),
    "dangling_refs": _sql(NODES, "SELECT n.bundle_id, n.path FROM nodes n WHERE NOT (n.kind = 'directory' AND n.name LIKE 'conv_1%') AND n.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes d WHERE d.kind = 'directory' AND d.name NOT LIKE 'conv_1%' AND d.bundle_id = n.bundle_id AND d.node_id = n.parent_id)"),
    "content_sha256": _sql(BODIES, "SELECT seq, sha256(body) AS sha256, octet_length(encode(body)) AS bytes FROM bodies"),
    "text_stats": _sql(BODIES, "SELECT seq, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS lines, coalesce(list_max(list_transform(regexp_extract_all(body, '[*]+'), lambda x: length(x))), 0) AS stars, coalesce(list_max(list_transform(regexp_extract_all(body, '[%]+'), lambda x: length(x))), 0) AS percents FROM bodies"),
    "line_numbers": _sql(BODIES, "SELECT seq, sha256(array_to_string(list_transform(l, lambda x, i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(l) AS VARCHAR)) AS INTEGER), ' ') || ' | ' || x), chr(10))) AS numbered_sha256 FROM (SELECT seq, string_split(body, chr(10)) AS l FROM bodies)"),
    "normalize_newlines": _sql(BODIES, "SELECT seq, sha256(body) AS sha256 FROM bodies"),
    "fence_language": _sql(FILES, "SELECT bundle_id, seq, CASE WHEN lower(name) IN ('dockerfile', 'makefile') THEN lower(name) ELSE CASE extension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in formats.LANGUAGES.items()) + " ELSE 'text' END END AS language FROM valid"),
    "safe_fence": _sql(BODIES, "SELECT seq, CASE WHEN greatest(3, seq % 6 + 1) <= greatest(3, seq % 4 + 1) THEN repeat('`', greatest(3, seq % 6 + 1)) ELSE repeat('~', greatest(3, seq % 4 + 1)) END AS fence FROM bodies"),
    "crop_text": _sql(BODIES, r"SELECT seq, CASE WHEN length(f) > 80 THEN substr(f, 1, 79) || '…' ELSE f END AS cropped FROM (SELECT seq, trim(regexp_replace(body, '[ \t\n\r\f]+', ' ', 'g')) AS f FROM bodies)"),
    "formula_guard": _sql(BODIES, "SELECT seq, CASE WHEN seq % 6 < 4 THEN chr(39) ELSE '' END || (['=', '+', '-', '@', 'a', ''])[seq % 6 + 1] || seq AS guarded FROM bodies"),
    "password_findings": _sql(PASSWORDS, "SELECT seq, \"start\", CAST(\"start\" + n AS INTEGER) AS \"end\", CAST(len(string_split(substr(body, 1, \"start\"), chr(10))) AS INTEGER) AS line, CAST(length(string_split(substr(body, 1, \"start\"), chr(10))[-1]) + 1 AS INTEGER) AS \"column\" FROM spans"),
    "redact_passwords": _sql(PASSWORDS, f"SELECT seq, CAST(len(m) AS INTEGER) AS redactions, sha256(regexp_replace(body, '{_PW}', '\\1\\2[REDACTED:password-assignment]', 'g')) AS sha256 FROM hits"),
    "secure_modes": _sql(PASSWORDS, f""", counted AS (SELECT b.seq, b.body, h.seq IS NOT NULL AS hit, length(regexp_replace(b.body, '{_PW}', '\\1\\2[REDACTED:password-assignment]', 'g')) AS safe FROM bodies b LEFT JOIN hits h ON b.seq = h.seq)
SELECT 'report' AS mode, CASE WHEN hit THEN 'flagged' ELSE 'clean' END AS status, count(*) AS files, CAST(sum(length(body)) AS BIGINT) AS characters FROM counted GROUP BY hit
UNION ALL SELECT 'redact', CASE WHEN hit THEN 'redacted' ELSE 'clean' END, count(*), CAST(sum(safe) AS BIGINT) FROM counted GROUP BY hit
UNION ALL SELECT 'exclude', CASE WHEN hit THEN 'excluded' ELSE 'clean' END, count(*), CAST(CASE WHEN hit THEN NULL ELSE sum(length(body)) END AS BIGINT) FROM counted GROUP BY hit"""),
    "secret_findings": _sql(_secrets_sql(), """SELECT seq, 'secret-content-'||category||'-'||lpad(CAST(ordinal AS VARCHAR), 3, '0') AS finding_id, CAST(ordinal AS INTEGER) AS ordinal, category, CASE WHEN category = 'high-entropy' THEN 'medium' ELSE 'high' END AS severity, 'content' AS source,
  CASE WHEN category IN ('high-entropy', 'password-assignment') THEN 'medium' ELSE 'high' END AS confidence, a AS "start", b AS "end", CAST(len(string_split(ahead, chr(10))) AS INTEGER) AS line, CAST(length(string_split(ahead, chr(10))[-1]) + 1 AS INTEGER) AS "column" FROM found"""),
    "scan_reports": _sql(_secrets_sql(3000), """, f AS (SELECT seq, count(*) AS n, list_sort(list(DISTINCT category)) AS c FROM found WHERE ordinal <= 2 GROUP BY seq)
SELECT b.seq, CASE WHEN n > 0 THEN 'flagged' ELSE 'clean' END AS status, CAST(least(length(body), 3000) AS INTEGER) AS scanned_characters, length(body) > 3000 OR coalesce(n, 0) >= 2 AS scan_truncated, coalesce(n, 0) AS finding_count, coalesce(array_to_string(c, ','), '') AS categories,
  array_to_string(list_filter([CASE WHEN length(body) > 3000 THEN 'characters-limited' END, CASE WHEN n >= 2 THEN 'findings-limited' END, CASE WHEN list_contains(c, 'high-entropy') THEN 'high-entropy-uncertain' END], lambda x: x IS NOT NULL), ',') AS warnings FROM bodies b LEFT JOIN f ON b.seq = f.seq"""),
    "security_summary": _sql(_secrets_sql(), "SELECT 'documents' AS bundle_id, (SELECT count(*) FROM found) AS findings, (SELECT count(DISTINCT seq) FROM found) AS flagged_files, " + ", ".join(f"(SELECT count(DISTINCT seq) FROM found WHERE category = '{c}') AS {c.replace('-', '_')}" for c in security.CATEGORIES) + ", count(*) AS scanned_files, CAST(0 AS BIGINT) AS truncated_scans, CAST(0 AS BIGINT) AS unscanned_files, CAST(sum(length(body)) AS BIGINT) AS scanned_characters FROM bodies"),
    "shannon_entropy": _sql(BODIES, "SELECT seq, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT seq, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY seq) AS t FROM (SELECT seq, unnest(string_split(body, '')) AS c FROM bodies WHERE body <> '') GROUP BY seq, c) GROUP BY seq"),
    "merge_intervals": """WITH s AS (SELECT user_id, event_id * 37 % 10007 AS a, event_id * 37 % 10007 + event_id % 90 AS b, event_type FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b, event_type ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(a) AS "start", max(b) AS "end" FROM i GROUP BY user_id, island""",
    "pack_parts": "WITH RECURSIVE " + BODIES + """, c AS (SELECT seq * 1000000 + k AS seq, octet_length(encode(substr(body, CAST(k * 10000 + 1 AS INTEGER), 10000))) + 2 AS cost FROM bodies, unnest(range(greatest(1, CAST(ceil(length(body) / 10000) AS BIGINT)))) AS u(k)),
o AS (SELECT seq, cost, row_number() OVER (ORDER BY seq) AS n FROM c),
r AS (SELECT n, seq, cost AS used, 1 AS part FROM o WHERE n = 1 UNION ALL SELECT o.n, o.seq, CASE WHEN r.used + o.cost > 64512 THEN o.cost ELSE r.used + o.cost END, CASE WHEN r.used + o.cost > 64512 THEN r.part + 1 ELSE r.part END FROM r JOIN o ON o.n = r.n + 1)
SELECT seq AS ordinal, CAST(part AS INTEGER) AS part FROM r""",
    "split_utf8": _sql(BODIES, "SELECT seq, sha256(body) AS sha256, TRUE AS fits FROM bodies"),
    "running_budget": "SELECT o_orderkey, CAST(r AS BIGINT) AS running, r <= 400000 AS within FROM (SELECT o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS r FROM orders)",
    "char_budget": _sql(BODIES, "SELECT seq, CAST(greatest(0, least(n, 50000 - coalesce(b, 0))) AS BIGINT) AS taken FROM (SELECT seq, length(body) AS n, sum(length(body)) OVER (PARTITION BY string_split(path, '/')[1] ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM bodies)"),
    "page_budget_fit": _sql(BODIES, """, e AS (SELECT string_split(path, '/')[1] AS bundle_id, path, CAST(ceil(length(body) / 3000) AS BIGINT) AS pages FROM bodies WHERE body <> ''),
w AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY path) AS n, coalesce(sum(pages) OVER (PARTITION BY bundle_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e),
r AS (SELECT *, 60 - (3 + ceil(n / 34)) - n - used AS room FROM w),
b AS (SELECT *, coalesce(max(CASE WHEN room < pages THEN 1 ELSE 0 END) OVER (PARTITION BY bundle_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM r),
k AS (SELECT bundle_id, path, pages, CAST(CASE WHEN broken = 1 THEN 0 ELSE greatest(0, least(pages, room)) END AS BIGINT) AS kept_pages FROM b)
SELECT bundle_id, path, pages, kept_pages, CAST(2 + ceil(count(*) OVER (PARTITION BY bundle_id) / 34) + 1 + coalesce(sum(kept_pages + 1) OVER (PARTITION BY bundle_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_page FROM k WHERE kept_pages > 0"""),
    "excel_address": "SELECT o_orderkey, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 % 26 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + (n - 27) // 26 % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters, n FROM (SELECT o_orderkey, o_orderkey % 18278 + 1 AS n FROM orders)",
    "excel_serial": "SELECT o_orderkey, strftime(TIMESTAMP '1899-12-30 06:00:00' + to_days(CAST(o_orderkey % 60000 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM orders",
    "grid_pages": "SELECT c_custkey AS sheet, CAST(d * 24 + 1 AS BIGINT) AS first_row, CAST(a * 12 + 1 AS BIGINT) AS first_column, least(c_custkey % 31 - a * 12, 12) > 7 AS landscape FROM customer, unnest(range(greatest(1, CAST(ceil((c_custkey % 130) / 24) AS BIGINT)))) AS u(d), unnest(range(greatest(1, CAST(ceil((c_custkey % 31) / 12) AS BIGINT)))) AS v(a)",
    "densify_grid": "WITH c AS (SELECT l_suppkey AS sheet, l_linenumber AS r, l_orderkey % 5 + 1 AS k, min(l_partkey) AS v FROM lineitem GROUP BY ALL) SELECT s.sheet, CAST(rr AS INTEGER) AS \"row\", CAST(kk AS INTEGER) AS col, v AS value FROM (SELECT DISTINCT sheet FROM c) s CROSS JOIN unnest(range(1, 8)) AS a(rr) CROSS JOIN unnest(range(1, 7)) AS b(kk) LEFT JOIN c ON c.sheet = s.sheet AND c.r = rr AND c.k = kk",
    "image_resize_plan": "WITH i AS (SELECT p_partkey, p_partkey * 7919 % 9000 + 1 AS w0, p_partkey * 104729 % 7000 + 1 AS h0, p_partkey % 8 + 1 AS o FROM part), j AS (SELECT p_partkey, CASE WHEN o >= 5 THEN h0 ELSE w0 END AS w, CASE WHEN o >= 5 THEN w0 ELSE h0 END AS h FROM i), k AS (SELECT *, least(1.0::DOUBLE, sqrt(4000000.0::DOUBLE / (w * h)), 2400.0::DOUBLE / greatest(w, h)) AS s FROM j) SELECT p_partkey, greatest(1, CAST(floor(w * s + 0.5) AS BIGINT)) AS target_width, greatest(1, CAST(floor(h * s + 0.5) AS BIGINT)) AS target_height FROM k",
    "html_active_counts": "SELECT page_id, len(regexp_extract_all(html, '(?i)<script')) AS scripts, len(regexp_extract_all(html, '(?i)<style')) AS styles, len(regexp_extract_all(html, '(?i)<iframe')) AS frames, len(regexp_extract_all(html, '(?i)[ ]on[a-z]+=')) AS events FROM pages",
    "validate_inclusion": _sql(SELECTED, ", r AS (SELECT bundle_id, seq, level, CASE WHEN seq % 50 = 0 THEN reason <> 'selected' ELSE reason = 'selected' END AS included, reason FROM sel) SELECT bundle_id, seq, 'inclusion-consistency' AS code FROM r WHERE included <> (reason = 'selected') UNION ALL SELECT bundle_id, seq, 'blocked-included' FROM r WHERE level = 'E' AND included"),
    "validate_unique": _sql(FILES, "SELECT bundle_id, path, count(*) AS n FROM valid GROUP BY bundle_id, path HAVING count(*) > 1"),
    "file_security": _sql(PASSWORDS, "SELECT seq, count(*) AS high, CAST(0 AS BIGINT) AS medium, 'password-assignment' AS categories FROM spans GROUP BY seq"),
    "sensitive_names": _sql(FILES, "SELECT bundle_id, seq, TRUE AS sensitive FROM valid WHERE " + " OR ".join("regexp_matches(path, '" + p.replace("\\A", "^").replace("\\z", "$") + "')" for p in security.SENSITIVE_FILES)),
    "cap_and_count": "SELECT l_suppkey, least(count(*), 500) AS kept, greatest(count(*) - 500, 0) AS omitted FROM lineitem GROUP BY l_suppkey",
    "interval_overlap": _sql(PASSWORDS, "SELECT a.seq, a.\"start\" AS start_a, b.\"start\" AS start_b FROM spans a JOIN spans b ON a.seq = b.seq AND a.\"start\" < b.\"start\" AND b.\"start\" < a.\"start\" + a.n + 2000"),
    "sections": _sql(BODIES, f", c AS (SELECT path, '<a id=\"' || {_id('file', 'path')} || '\"></a>' || chr(10) || '## '||path||chr(10)||chr(10)||'```markdown'||chr(10)||body||chr(10)||'```' AS s FROM bodies) SELECT path, CAST(1 AS INTEGER) AS segment, octet_length(encode(s)) AS byte_length, sha256(s) AS sha256 FROM c"),
}
