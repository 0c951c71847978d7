"""Registered queries of checks between the tables of a bundle, with their SQL; faults are put in by the documents' numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import crosscheck, documents, lineage, packing, rollups, security, tree
from .plans import bundle
from .queries import GLOBS, NODES, SELECTED, _bodies, _files, _id, _secrets_sql, _selected, _sql, _up
from .sources import files as sources
from .sources import images
from .sources import parts as sink

PART = 40  # documents of a part
LIMIT = 200_000
MAX_PART = 1 << 18


def _every(n, rest=0):
    return F.col("seq") % n == rest


def _marked(spark, sf):
    """seq, body, file_id, part and name of the documents."""
    part = F.floor(F.col("seq") / PART).cast("int")
    return _bodies(spark, sf).select("seq", "body", F.concat(F.lit("file_"), F.sha2(F.col("seq").cast("string"), 256)).alias("file_id"), part.alias("part"), F.format_string("part-%05d", part).alias("name"))


def _parts(spark, sf):
    """Parts of marked documents: some markers stand twice, never, or once more in the next part, and some are declared in part 0 too."""
    docs = _marked(spark, sf)
    mark = crosscheck.marker(F.col("file_id"))
    times = F.when(_every(97), F.concat(mark, mark)).when(_every(101), "").otherwise(mark)
    own = docs.select("part", "seq", F.concat(times, F.lit("\n"), "body").alias("text"), F.array("file_id").alias("anchors"))
    more = docs.filter(_every(103)).select((F.col("part") + 1).alias("part"), "seq", mark.alias("text"), F.expr("cast(array() as array<string>)").alias("anchors"))
    also = docs.filter(_every(89)).select(F.lit(0).alias("part"), "seq", F.lit("").alias("text"), F.array("file_id").alias("anchors"))
    pieces = own.unionByName(more).unionByName(also).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "anchors"))).alias("all"))
    rows = pieces.select(F.lit("b").alias("bundle_id"), "part", F.when(F.col("part") % 17 == 5, "part-00001").otherwise(F.format_string("part-%05d", "part")).alias("name"), F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("content"), F.flatten(F.transform("all", lambda x: x["anchors"])).alias("anchors"))
    return rows.withColumn("byte_length", F.octet_length("content") + F.when(F.col("part") % 13 == 3, 1).otherwise(0))


def _tables(spark, sf):
    docs = _marked(spark, sf)
    none = F.expr("cast(array() as array<string>)")
    anchors = F.array(F.when(_every(83), F.concat("file_id", F.lit("-segment-002"))).otherwise(F.col("file_id")))
    names = F.array(F.when(_every(79), "part-none").otherwise(F.col("name")))
    recs = docs.select(F.lit("b").alias("bundle_id"), "file_id", F.when(_every(67), "partial").otherwise("completed").alias("status"), anchors.alias("anchors"), names.alias("parts"), _every(53).alias("truncated"))
    cats = lambda n: F.when(_every(n), F.array(F.lit("jwt"))).otherwise(none)
    files = docs.filter(~_every(107)).select(
        F.lit("b").alias("bundle_id"), "file_id", F.concat(F.lit("d/"), F.col("seq")).alias("path"), (~_every(41)).alias("included"), F.when(_every(41), "excluded-secret-policy").otherwise("selected").alias("reason"),
        F.lit("completed").alias("text_status"), F.array("file_id").alias("text_anchors"), F.array("name").alias("text_parts"), _every(106).alias("text_truncated"), F.when(_every(3), F.array(F.lit(1))).otherwise(F.expr("cast(array() as array<int>)")).alias("pages"),
        F.when(_every(59), "clean").otherwise("flagged").alias("security_status"), (F.col("seq") % 4).cast("int").alias("security_finding_count"), F.lit(0).alias("security_redactions"), _every(82).alias("security_excluded"),
        F.lit(False).alias("security_visual_omitted"), F.lit(False).alias("security_scan_truncated"), cats(5).alias("security_categories"))
    scans = docs.filter(~_every(71)).withColumn("copies", F.explode(F.when(_every(73), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(
        F.lit("b").alias("bundle_id"), F.when(_every(109), F.concat("file_id", F.lit("0"))).otherwise(F.col("file_id")).alias("file_id"), F.concat(F.lit("d/"), F.col("seq") + F.when(_every(61), 1).otherwise(0)).alias("path"),
        F.when(_every(47), "report").otherwise("redact").alias("mode"), F.lit("flagged").alias("status"), (F.col("seq") % F.when(_every(43), 3).otherwise(4)).cast("int").alias("finding_count"), F.when(_every(37), 1).otherwise(0).alias("redactions"),
        _every(41).alias("excluded"), _every(31).alias("visual_omitted"), _every(29).alias("scan_truncated"), cats(10).alias("categories"))
    return recs, files, scans


def q_cross_check(spark, sf):
    recs, files, scans = _tables(spark, sf)
    modes = spark.createDataFrame([("b", "redact")], "bundle_id string, mode string")
    return crosscheck.bundle(_parts(spark, sf), recs, files, scans, modes, LIMIT)


def q_list_mismatch(spark, sf):
    """Lists of an order's parts against lists with a swapped, a lost and a doubled item."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    swap = (F.col("l_orderkey") % 11 == 0) & (F.col("l_linenumber") <= 2)
    there = F.when(swap, 3 - F.col("l_linenumber")).otherwise(F.col("l_linenumber"))
    again = li.filter("l_orderkey % 17 = 0 and l_linenumber = 1")
    other = li.withColumn("l_linenumber", there).filter("not (l_orderkey % 13 = 0 and l_linenumber = 1)").unionByName(again)
    return crosscheck.list_mismatch(li, other, "l_orderkey", "l_linenumber", "l_partkey")


def q_bundle_parts(spark, sf):
    """Parts of the documents, written through the sink and read back."""
    docs = _bodies(spark, sf)
    keep = ~_every(9)
    recs = docs.select("bundle_id", "seq", "path", F.octet_length("body").cast("long").alias("size"), keep.alias("included"), F.when(keep, "selected").otherwise("excluded-manual").alias("reason"), keep.alias("has_section"))
    rows = docs.filter(keep).withColumn("name", F.substring_index("path", "/", -1)).withColumn("extension", F.lit("md"))
    every = lineage.settled(bundle.atoms(recs, tree.nodes(docs), bundle.sections(rows, MAX_PART), MAX_PART))
    parts = packing.parts_text(every, packing.pack(every, MAX_PART), F.col("bundle_id"))
    folder = f"{lineage.shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    spark.dataSource.register(sink.BundleParts)
    parts.select("bundle_id", "name", "content").write.format("bundle-parts").mode("append").save(folder)
    back = spark.read.format("bundle-parts").load(folder)
    return back.select("bundle_id", "name", F.octet_length("content").cast("long").alias("byte_length"), "sha256")


def q_run_bundle(spark, sf):
    """The scan's summary of whole bundles, from files through import, preflight and selection."""
    files = sources.demo_files(spark, sf).withColumn("content", F.col("body").cast("binary")).withColumn("compressed_size", F.floor(F.col("size") / (1 + F.col("seq") % 60)).cast("long")).drop("body")
    return bundle.run_bundle(files, GLOBS, files.filter("seq % 9 = 0").select("bundle_id", "seq"), with_parts=False)["security"]


def q_manifest_records(spark, sf):
    """Digests of the manifest's record of each file, as canonical JSON."""
    docs = documents.file_documents(_selected(spark, sf))
    text = documents.record_text(docs, "record")
    return docs.select("bundle_id", "seq", "index", F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))


def _nodes(spark, sf):
    return tree.nodes(_files(spark, sf).filter("error is null"))


def q_tree_document(spark, sf):
    """The nested tree as texts, each with its order."""
    return documents.tree_rows(_nodes(spark, sf)).select("bundle_id", F.hex("key").alias("key"), "sub", "text")


def q_tree_digests(spark, sf):
    return documents.tree_digests(_nodes(spark, sf))


def q_skipping_budget(spark, sf):
    """Orders of each customer under a budget of money and of number."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("size"))
    return packing.skipping_budget(orders, ("o_custkey",), "o_orderkey", "size", 400_000, 6)


def q_tree_checks(spark, sf):
    """A tree with a cycle of three, an island, doubled nodes, wrong kinds, names and paths, put in by node ids."""
    nodes = _nodes(spark, sf).drop("depth")
    ids = {p: documents.paths.node_id("directory", F.lit(p)) for p in ("documents/src1", "documents/src2", "documents/src3", "documents/src4", "documents/src5/en")}
    at = lambda p: F.col("node_id") == ids[p]
    parent = F.when(at("documents/src1"), ids["documents/src2"]).when(at("documents/src2"), ids["documents/src3"]).when(at("documents/src3"), ids["documents/src1"]).when(at("documents/src4"), "dir_none").when(F.col("node_id").like("%00"), F.lit("file_gone")).otherwise(F.col("parent_id"))
    kind = F.when(F.col("node_id").like("file_%11"), "link").otherwise(F.col("kind"))
    path = F.when(F.col("node_id").like("%22"), F.concat("path", F.lit("x"))).otherwise(F.col("path"))
    declared = nodes.withColumns({"parent_id": parent, "kind": kind, "path": path})
    declared = declared.unionByName(declared.filter("node_id like '%33'"))
    above = declared.filter("node_id like 'file_%44'").select("bundle_id", F.concat(F.lit("file_"), F.sha2("node_id", 256)).alias("node_id"), F.col("node_id").alias("parent_id"), F.lit("file").alias("kind"), F.lit("in").alias("name"), F.concat("path", F.lit("/in")).alias("path"))
    return tree.checked(declared.unionByName(above), nodes.filter("node_id not like '%55'"))


def q_image_meta(spark, sf):
    """Headers of six formats with sizes, orientation and flags from the parts' numbers, read back by their bytes."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    k = F.col("p_partkey").cast("long")
    w, h = k * 7919 % 13_000 + 1, k * 104_729 % 9_000 + 1
    turn = k % 8 + 1
    high = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    low = lambda c, n: F.concat(*[F.substr(high(c, n), F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(n))])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), high(w, 4), high(h, 4), F.lit("08"), high(F.when(k % 12 < 6, 2).otherwise(6), 1), F.lit("00000000000000"), F.lit("0000000049444154"), F.lit("00000000"))
    exif = F.concat(F.lit("FFE1002245786966000049492A00080000000100"), F.lit("120103000100000"), F.lit("0"), low(turn, 2), F.lit("000000000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), exif, F.lit("FFC0001108"), high(h, 2), high(w, 2), F.lit("03012200021101031101FFDA"))
    gif = F.concat(F.lit("474946383961"), low(w, 2), low(h, 2), F.lit("000000"), F.when(k % 12 < 6, "21F9040100000000").otherwise(""), F.repeat(F.lit("2C00000000000000000000"), (k % 3).cast("int")), F.lit("3B0000000000000000"))
    webp = F.concat(F.lit("52494646000000005745425056503858"), F.lit("0A000000"), high(F.when(k % 12 < 6, 0x10).otherwise(0x02), 1), F.lit("000000"), low(w - 1, 3), low(h - 1, 3), F.lit("0000"))
    bmp = F.concat(F.lit("424D"), F.repeat(F.lit("00"), 12), F.lit("28000000"), low(w, 4), low(h, 4), F.lit("0100"), low(F.when(k % 12 < 6, 24).otherwise(32), 2))
    tiff = F.concat(F.lit("4D4D002A000000080003"), F.lit("0100000400000001"), high(w, 4), F.lit("0101000400000001"), high(h, 4), F.lit("0112000300000001"), high(turn, 2), F.lit("0000"))
    kinds = ["image/png", "image/jpeg", "image/gif", "image/webp", "image/bmp", "image/tiff"]
    at = (k % 6).cast("int")
    files = part.select(F.lit("b").alias("bundle_id"), k.alias("seq"), F.get(F.array(*map(F.lit, kinds)), at).alias("mime"), F.unhex(F.get(F.array(png, jpeg, gif, webp, bmp, tiff), at)).alias("content"))
    return images.image_meta(files).drop("bundle_id")


def q_artifact_snapshot(spark, sf):
    """Sources as bundles, with their documents as parts, records, assets, scans and outputs by number."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("bundle_id"), F.col("doc_id").alias("seq"), F.coalesce("text", F.lit("")).alias("content"))
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    seq = F.col("seq")
    parts = docs.select("bundle_id", seq.alias("part"), F.concat(F.lit("p"), seq).alias("name"), "content", F.octet_length("content").alias("byte_length"), F.array_repeat(F.lit("a"), (seq % 4).cast("int")).alias("anchors"))
    recs = docs.filter("seq % 5 > 0").select("bundle_id", pick(("completed", "partial", "failed", "not-started"), seq).alias("status"))
    assets = docs.filter("seq % 3 = 0").select("bundle_id", pick(("xlsx", "pdf", "image", "docx", "pptx"), F.floor(seq / 3)).alias("kind"), (seq % 7).alias("units"), (seq % 11).alias("formulas"), (seq % 2 == 0).alias("visual"))
    scans = docs.select("bundle_id", (seq % 3).alias("finding_count"), (seq % 2).alias("redactions"), (seq % 13 == 0).alias("excluded"), (seq % 17 == 0).alias("visual_omitted"))
    outputs = docs.filter("seq % 29 = 0 and bundle_id <> 'src3'").select("bundle_id", pick(("documents", "spreadsheet", "office"), F.floor(seq / 29)).alias("family"), (seq % 50).alias("pages"), (seq * 10).alias("bytes"))
    bad = docs.filter("seq % 211 = 0").select("bundle_id", pick(("content", "documents"), F.floor(seq / 211)).alias("family"))
    out = rollups.artifact_snapshot(parts, recs, assets, scans, outputs, bad)
    return out.withColumn("preview", F.sha2("preview", 256))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_ID = "'file_' || sha256(CAST(doc_id AS VARCHAR))"
_MARK = "'<a id=\"' || file_id || '\"></a>'"
_CROSS = f"""WITH d AS (SELECT doc_id AS seq, coalesce(text, '') AS body, {_ID} AS file_id, doc_id // {PART} AS part FROM documents),
pieces AS (SELECT part, seq, CASE WHEN seq % 97 = 0 THEN {_MARK} || {_MARK} WHEN seq % 101 = 0 THEN '' ELSE {_MARK} END || chr(10) || body AS t, file_id AS a FROM d
  UNION ALL SELECT part + 1, seq, {_MARK}, NULL FROM d WHERE seq % 103 = 0 UNION ALL SELECT 0, seq, '', file_id FROM d WHERE seq % 89 = 0),
pname AS (SELECT DISTINCT part, CASE WHEN part % 17 = 5 THEN 'part-00001' ELSE 'part-' || lpad(CAST(part AS VARCHAR), 5, '0') END AS name FROM pieces),
content AS (SELECT part, sum(octet_length(encode(t)) + 1) - 1 AS size FROM pieces GROUP BY part),
occ AS (SELECT name, anchor, count(*) AS n FROM (SELECT part, unnest(regexp_extract_all(t, '<a id="(file_[a-f0-9]{{64}}(?:-segment-[0-9]{{3}})?)"></a>', 1)) AS anchor FROM pieces) JOIN pname USING (part) GROUP BY ALL),
dec AS (SELECT name, a AS anchor, count(*) AS times, max(part) AS part FROM pieces JOIN pname USING (part) WHERE a IS NOT NULL GROUP BY name, a),
loc AS (SELECT anchor, arg_max(name, part) AS place FROM dec GROUP BY anchor),
rec AS (SELECT seq, file_id, CASE WHEN seq % 83 = 0 THEN file_id || '-segment-002' ELSE file_id END AS anchor, CASE WHEN seq % 79 = 0 THEN 'part-none' ELSE 'part-' || lpad(CAST(part AS VARCHAR), 5, '0') END AS name, 'part-' || lpad(CAST(part AS VARCHAR), 5, '0') AS own FROM d),
scan AS (SELECT *, CASE WHEN seq % 109 = 0 THEN file_id || '0' ELSE file_id END AS fid, seq % 109 <> 0 AND seq % 107 <> 0 AS known FROM d WHERE seq % 71 <> 0),
scans AS (SELECT scan.* FROM scan UNION ALL SELECT scan.* FROM scan WHERE seq % 73 = 0)
SELECT 'b' AS bundle_id, code, subject FROM (
SELECT 'part-duplicate' AS code, name AS subject FROM pname GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'part-byte-length', name FROM pname WHERE part % 13 = 3
UNION ALL SELECT 'part-limit', name FROM content JOIN pname USING (part) WHERE size + CASE WHEN part % 13 = 3 THEN 1 ELSE 0 END > {LIMIT}
UNION ALL SELECT 'anchor-occurrence', dec.anchor FROM dec LEFT JOIN occ ON occ.name = dec.name AND occ.anchor = dec.anchor WHERE coalesce(n, 0) <> 1
UNION ALL SELECT 'anchor-foreign', occ.anchor FROM occ LEFT JOIN dec ON occ.name = dec.name AND occ.anchor = dec.anchor WHERE times IS NULL
UNION ALL SELECT 'anchor-duplicate', anchor FROM dec GROUP BY anchor HAVING sum(times) > 1
UNION ALL SELECT 'record-file', file_id FROM rec WHERE seq % 107 = 0
UNION ALL SELECT 'manifest-status', file_id FROM rec WHERE seq % 67 = 0 AND seq % 107 <> 0
UNION ALL SELECT 'manifest-anchors', file_id FROM rec WHERE seq % 83 = 0 AND seq % 107 <> 0
UNION ALL SELECT 'manifest-parts', file_id FROM rec WHERE seq % 79 = 0 AND seq % 107 <> 0
UNION ALL SELECT 'manifest-truncation', file_id FROM rec WHERE (seq % 53 = 0) <> (seq % 106 = 0) AND seq % 107 <> 0
UNION ALL SELECT 'record-part', file_id FROM rec WHERE name NOT IN (SELECT name FROM pname)
UNION ALL SELECT 'record-anchor', file_id FROM rec WHERE seq % 83 = 0
UNION ALL SELECT 'record-anchor-part', file_id FROM rec JOIN loc ON loc.anchor = rec.anchor WHERE place <> name
UNION ALL SELECT 'security-report-duplicate', fid FROM scans GROUP BY fid HAVING count(*) > 1
UNION ALL SELECT 'security-report-file', fid FROM scans WHERE NOT known
UNION ALL SELECT 'security-report-path', fid FROM scans WHERE known AND seq % 61 = 0
UNION ALL SELECT 'security-report-mode', fid FROM scans WHERE known AND seq % 47 = 0
UNION ALL SELECT 'security-status', fid FROM scans WHERE known AND seq % 59 = 0
UNION ALL SELECT 'security-findings', fid FROM scans WHERE known AND seq % CASE WHEN seq % 43 = 0 THEN 3 ELSE 4 END <> seq % 4
UNION ALL SELECT 'security-redactions', fid FROM scans WHERE known AND seq % 37 = 0
UNION ALL SELECT 'security-excluded', fid FROM scans WHERE known AND (seq % 41 = 0) <> (seq % 82 = 0)
UNION ALL SELECT 'security-visual', fid FROM scans WHERE known AND seq % 31 = 0
UNION ALL SELECT 'security-truncated', fid FROM scans WHERE known AND seq % 29 = 0
UNION ALL SELECT 'security-categories', fid FROM scans WHERE known AND (seq % 10 = 0) <> (seq % 5 = 0)
UNION ALL SELECT 'security-exclusion-markdown', fid FROM scans WHERE known AND seq % 41 = 0
UNION ALL SELECT 'security-visual-pages', fid FROM scans WHERE known AND seq % 31 = 0 AND seq % 3 = 0
UNION ALL SELECT 'security-report-missing', d.file_id FROM d WHERE seq % 107 <> 0 AND file_id NOT IN (SELECT fid FROM scans))"""
_MOST = MAX_PART - packing.RESERVED - 2
_room = lambda title: (_MOST - len(title) - 4) // 2
_esc = lambda c: rf"regexp_replace({c}, '([\\*_\[\]#])', '\\\1', 'g')"


def _lines(name: str, kind: int, title: str, rows: str) -> str:
    """Lines in order (o, line) as atoms, in SQL."""
    return f"""{name}0 AS ({rows}), {name}1 AS (SELECT *, sum(octet_length(encode(line)) + 1) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) - octet_length(encode(line)) - 1 AS before FROM {name}0),
{name} AS (SELECT {kind} AS kind, '' AS path, CAST(before // {_room(title)} AS INTEGER) + 1 AS segment, CASE WHEN before // {_room(title)} = 0 THEN '{title}' || chr(10) || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY o) AS content FROM {name}1 GROUP BY before // {_room(title)})"""


_PARTS = f"""WITH RECURSIVE d AS (SELECT doc_id AS seq, source, source||'/doc_'||doc_id||'.md' AS path, coalesce(text, '') AS body FROM documents),
h AS (SELECT 0 AS kind, '' AS path, 1 AS segment, '## About this bundle' || chr(10) || chr(10) || 'The manifest is the index of all files; paths are those of the source.' || chr(10) || chr(10) || '- Files: ' || count(*) || chr(10) || '- Files included: ' || count(*) FILTER (WHERE seq % 9 <> 0)
  || chr(10) || '- Files excluded: ' || count(*) FILTER (WHERE seq % 9 = 0) || chr(10) || '- Bytes included: ' || sum(octet_length(encode(body))) FILTER (WHERE seq % 9 <> 0) AS content FROM d),
{_lines("t", 1, "## Tree", f"SELECT row_number() OVER (ORDER BY CAST(substr(source, 4) AS INTEGER), seq) AS o, line FROM (SELECT source, seq, '  - ' || {_esc("'doc_' || seq || '.md'")} AS line FROM d UNION ALL SELECT DISTINCT source, -1, '- ' || source || '/' FROM d)")},
{_lines("x", 2, "## Index of files", f"SELECT path AS o, '- **' || {_esc('path')} || '**, ' || CASE WHEN seq % 9 = 0 THEN 'excluded (excluded-manual)' ELSE 'anchor `' || {_id('file', 'path')} || '`' END AS line FROM d")},
s AS (SELECT 3 AS kind, path, 1 AS segment, '<a id="' || {_id('file', 'path')} || '"></a>' || chr(10) || '## ' || path || chr(10) || chr(10) || '```markdown' || chr(10) || body || chr(10) || '```' AS content FROM d WHERE seq % 9 <> 0),
a AS (SELECT *, octet_length(encode(content)) + 2 AS cost, row_number() OVER (ORDER BY kind, path, segment) AS n FROM (FROM h UNION ALL FROM t UNION ALL FROM x UNION ALL FROM s)),
r AS (SELECT n, cost AS used, 1 AS part FROM a WHERE n = 1 UNION ALL SELECT a.n, CASE WHEN r.used + a.cost > {MAX_PART - packing.RESERVED} THEN a.cost ELSE r.used + a.cost END, CASE WHEN r.used + a.cost > {MAX_PART - packing.RESERVED} THEN r.part + 1 ELSE r.part END FROM r JOIN a ON a.n = r.n + 1),
p AS (SELECT part, (SELECT max(part) FROM r) AS parts, string_agg(content, chr(10) || chr(10) ORDER BY a.n) AS content FROM a JOIN r ON a.n = r.n GROUP BY part),
m AS (SELECT *, 'documents-content' || CASE WHEN parts = 1 THEN '.md' ELSE '.part-' || lpad(CAST(part AS VARCHAR), 3, '0') || '.md' END AS name FROM p),
w AS (SELECT name, '<!-- part: ' || name || ' -->' || chr(10) || '# documents, part ' || part || ' of ' || parts || chr(10) || chr(10) || CASE WHEN parts > 1 THEN '> Load all parts that the manifest names before answering.' ELSE '> This is the only part.' END || chr(10) || chr(10) || content || chr(10) AS content FROM m)
SELECT 'documents' AS bundle_id, name, octet_length(encode(content)) AS byte_length, sha256(content) AS sha256 FROM w"""
_NAMES = " OR ".join("regexp_matches(path, '" + p.replace("\\A", "^").replace("\\z", "$") + "')" for p in security.SENSITIVE_FILES)
_SCANNED = SELECTED + ", bodies AS (SELECT bundle_id || '/' || seq AS seq, bundle_id, path, replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM sel WHERE reason = 'selected' AND is_text)"
_RUN = f"""WITH {_secrets_sql(bodies=_SCANNED)}, e AS (SELECT seq, category FROM found UNION ALL SELECT seq, 'sensitive-filename' FROM bodies WHERE {_NAMES}),
f AS (SELECT b.bundle_id, e.* FROM e JOIN bodies b ON b.seq = e.seq),
g AS (SELECT bundle_id, count(*) AS scanned_files, CAST(sum(length(body)) AS BIGINT) AS scanned_characters FROM bodies GROUP BY bundle_id)
SELECT g.bundle_id, count(f.seq) AS findings, count(DISTINCT f.seq) AS flagged_files, {", ".join(f"count(DISTINCT CASE WHEN category = '{c}' THEN f.seq END) AS {c.replace('-', '_')}" for c in security.CATEGORIES)},
  scanned_files, CAST(0 AS BIGINT) AS truncated_scans, CAST(0 AS BIGINT) AS unscanned_files, scanned_characters FROM g LEFT JOIN f ON f.bundle_id = g.bundle_id GROUP BY g.bundle_id, scanned_files, scanned_characters"""


def _json(spec, indent: int = 0) -> str:
    """SQL for the text of a JSON value: dicts by sorted keys, all else SQL for the text of a value without lines of its own."""
    if not isinstance(spec, dict):
        return spec
    pad = " " * (indent + 2)
    each = [f"chr(10) || '{pad}\"{k}\": ' || {_json(spec[k], indent + 2)}" for k in sorted(spec, key=documents.key_order)]
    return "'{' || " + " || ',' || ".join(each) + f" || chr(10) || '{' ' * indent}}}'"


_q = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_n = lambda c: f"CAST({c} AS VARCHAR)"
_word = lambda w: f"'{w}'"
_planned = "CASE WHEN reason = 'selected' THEN '\"not-started\"' ELSE '\"not-applicable\"' END"
_risks = "CASE WHEN len(rs) = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(rs, lambda x: chr(10) || '    {' || chr(10) || '      \"code\": \"' || string_split(x, ':')[1] || '\",' || chr(10) || '      \"level\": \"' || string_split(x, ':')[2] || '\"' || chr(10) || '    }'), ',') || chr(10) || '  ]' END"
_none, _zero, _no, _list = _word("null"), _word("0"), _word("false"), _word("[]")
_RECORD = {
    "fileId": _q(_id("file", "path")), "normalizedPath": _q("path"), "parentDirectoryId": _q(_id("directory", _up("path"))), "name": _q("name"), "extension": _q("extension"), "size": _n("size"), "compressedSize": _n("compressed_size"),
    "mimeDeclared": _q("mime_declared"), "mimeDetected": _q("mime"), "detectionMethod": _q("method"), "category": _q("category"), "capabilityLevel": _q("level"), "isText": _n("is_text"), "encoding": "CASE WHEN txt AND sig IS NULL THEN '\"utf-8\"' ELSE 'null' END", "risks": _risks, "riskLevel": _q("risk_level"),
    "inclusion": {"included": _n("reason = 'selected'"), "reason": _q("reason"), "matchedGlob": _q("CASE WHEN reason = 'excluded-glob' THEN hit END")},
    "security": {"status": _word('\"not-scanned\"'), "findingCount": _zero, "highSeverityCount": _zero, "mediumSeverityCount": _zero, "categories": _list, "redactionCount": _zero, "excluded": _no, "visualOmitted": _no, "scanTruncated": _no, "warnings": _list, "error": _none},
    "integrity": {"algorithm": _word('\"SHA-256\"'), "status": _word('\"pending\"'), "value": _none, "error": _none}, "adapter": {"id": _q("adapter"), "version": _none, "conversionStatus": _planned},
    "representations": {
        "manifest": {"recorded": _word("true"), "pointer": "'\"/files/' || i || '\"'"}, "pdf": {"status": _planned, "pages": _list, "parts": _list},
        "markdown": {"status": _planned, "anchors": _list, "parts": _list, "truncated": _no, "originalBytes": _n("size"), "extractedBytes": _zero, "extractedCharacters": _zero, "lineCount": _zero, "encoding": "CASE WHEN txt AND sig IS NULL THEN '\"utf-8\"' ELSE 'null' END", "usedFallback": _no, "replacementCharacters": _zero, "newlineNormalization": _none, "error": _none},
    },
}
_padded = lambda c: rf"array_to_string(list_transform(regexp_extract_all({c}, '(\d+|\D+)', 1), lambda s: CASE WHEN regexp_full_match(s, '\d+') THEN lpad(s, CAST(greatest(length(s), 20) AS INTEGER), '0') ELSE s END), '')"
_RECORDS = SELECTED + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY {_padded('path')}, path) - 1 AS i FROM sel), texts AS (SELECT bundle_id, seq, i, {_json(_RECORD)} AS t FROM placed)"""
_level = lambda i: f"CASE WHEN {i} = len(p) AND kind = 'file' THEN '1' ELSE '0' END || {_padded(f'lower(p[{i}])')} || chr(1) || p[{i}]"
_TREE = NODES + f""", keyed AS (SELECT *, CASE WHEN path = '' THEN '' ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda i: {_level('i')}), chr(2)) END AS k FROM (SELECT *, string_split(path, '/') AS p FROM nodes)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, parent_id ORDER BY k) = 1 AS f, repeat(' ', depth * 4) AS pad, node_id IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AS many FROM keyed)"""
_digest = "sha256('directory' || chr(1) || count(h) || chr(1) || coalesce(sum(('0x' || substr(h, 1, 15))::UBIGINT::HUGEINT), 0) || chr(1) || coalesce(sum(('0x' || substr(h, 16, 15))::UBIGINT::HUGEINT), 0))"
_levels = ", ".join(
    f"l{d} AS (SELECT n.bundle_id, n.node_id, n.parent_id, n.kind, n.name, n.path, n.depth, CAST(coalesce(sum(k.n_files), 0) AS BIGINT) AS n_files, {_digest} AS digest FROM nodes n LEFT JOIN (SELECT *, sha256(kind || chr(1) || name || chr(1) || digest) AS h FROM (SELECT * FROM leaf WHERE depth = {d + 1} UNION ALL SELECT * FROM l{d + 1})) k ON k.bundle_id = n.bundle_id AND k.parent_id = n.node_id WHERE n.kind = 'directory' AND n.depth = {d} GROUP BY ALL)"
    for d in range(7, -1, -1)
)
_DIGESTS = NODES + f""", leaf AS (SELECT *, CAST(1 AS BIGINT) AS n_files, sha256('file' || chr(1) || name) AS digest FROM nodes WHERE kind = 'file'), l8 AS (SELECT * FROM leaf WHERE FALSE), {_levels}"""
_dir = lambda p: f"(SELECT node_id FROM base WHERE kind = 'directory' AND path = '{p}')"
_CHECKS = "WITH RECURSIVE " + NODES + f""", base AS (SELECT * FROM nodes),
t0 AS (SELECT bundle_id, node_id, CASE WHEN node_id = {_dir('documents/src1')} THEN {_dir('documents/src2')} WHEN node_id = {_dir('documents/src2')} THEN {_dir('documents/src3')} WHEN node_id = {_dir('documents/src3')} THEN {_dir('documents/src1')}
  WHEN node_id = {_dir('documents/src4')} THEN 'dir_none' WHEN node_id LIKE '%00' THEN 'file_gone' ELSE parent_id END AS parent_id, CASE WHEN node_id LIKE 'file_%11' THEN 'link' ELSE kind END AS kind, name, CASE WHEN node_id LIKE '%22' THEN path || 'x' ELSE path END AS path FROM base),
t1 AS (SELECT * FROM t0 UNION ALL SELECT * FROM t0 WHERE node_id LIKE '%33'),
t AS (SELECT * FROM t1 UNION ALL SELECT bundle_id, 'file_' || sha256(node_id), node_id, 'file', 'in', path || '/in' FROM t1 WHERE node_id LIKE 'file_%44'),
rec AS (SELECT bundle_id, node_id, kind AS rk, path AS rp FROM base WHERE node_id NOT LIKE '%55'),
j AS (SELECT t.*, rk, rp, rk IS NULL OR rk <> kind AS lost FROM t LEFT JOIN rec ON rec.bundle_id = t.bundle_id AND rec.node_id = t.node_id),
par AS (SELECT bundle_id, node_id, min(path) AS above, bool_or(kind = 'file') AS is_file FROM t GROUP BY bundle_id, node_id),
b AS (SELECT t.*, above, is_file FROM t LEFT JOIN par ON par.bundle_id = t.bundle_id AND par.node_id = t.parent_id WHERE t.parent_id IS NOT NULL),
links AS (SELECT bundle_id, node_id, min(parent_id) AS parent_id FROM t WHERE kind = 'directory' GROUP BY bundle_id, node_id),
up(bundle_id, node_id, goes, steps) AS (SELECT bundle_id, node_id, parent_id, 1 FROM links UNION ALL SELECT up.bundle_id, up.node_id, d.parent_id, steps + 1 FROM up JOIN links d ON d.bundle_id = up.bundle_id AND d.node_id = up.goes WHERE steps < 70),
ends AS (SELECT bundle_id, node_id, arg_max(goes, steps) AS goes, max(steps) AS steps FROM (SELECT bundle_id, node_id, coalesce(goes, '') AS goes, steps FROM up) GROUP BY bundle_id, node_id),
st AS (SELECT bundle_id, node_id, CASE WHEN steps >= 70 THEN 'cycle' WHEN goes = '' THEN 'rooted' ELSE 'island' END AS state FROM ends),
astray AS (SELECT * FROM st UNION SELECT f.bundle_id, f.node_id, coalesce(st.state, 'island') FROM (SELECT DISTINCT bundle_id, node_id, parent_id FROM t WHERE kind <> 'directory' AND parent_id IS NOT NULL) f LEFT JOIN st ON st.bundle_id = f.bundle_id AND st.node_id = f.parent_id)
SELECT bundle_id, node_id, 'tree-kind' AS code FROM j WHERE kind = 'link'
UNION ALL SELECT bundle_id, node_id, 'tree-' || kind || '-reference' FROM j WHERE kind <> 'link' AND lost
UNION ALL SELECT bundle_id, node_id, 'tree-' || kind || '-path' FROM j WHERE kind <> 'link' AND NOT lost AND path <> rp
UNION ALL SELECT bundle_id, node_id, 'tree-duplicate-node' FROM t GROUP BY bundle_id, node_id HAVING count(*) > 1
UNION ALL SELECT bundle_id, node_id, 'tree-parent' FROM b WHERE is_file IS NULL
UNION ALL SELECT bundle_id, node_id, 'tree-path' FROM b WHERE path <> CASE WHEN above = '' THEN name ELSE above || '/' || name END
UNION ALL SELECT DISTINCT bundle_id, parent_id, 'tree-file-children' FROM b WHERE is_file
UNION ALL SELECT bundle_id, node_id, 'tree-' || state FROM astray WHERE state <> 'rooted'"""
_IMAGES = """WITH i AS (SELECT p_partkey AS seq, p_partkey * 7919 % 13000 + 1 AS w, p_partkey * 104729 % 9000 + 1 AS h, p_partkey % 8 + 1 AS turn, p_partkey % 6 AS k, p_partkey % 12 < 6 AS even FROM part),
j AS (SELECT *, CASE WHEN k IN (1, 5) THEN turn ELSE 1 END AS o FROM i)
SELECT seq, (['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'image/bmp', 'image/tiff'])[k + 1] AS mime, (['PNG', 'JPEG', 'GIF', 'WebP', 'BMP', 'TIFF'])[k + 1] AS label, w AS width, h AS height, CAST(o AS INTEGER) AS orientation,
  CASE k WHEN 0 THEN NOT even WHEN 2 THEN even WHEN 3 THEN even WHEN 4 THEN NOT even ELSE FALSE END AS transparent, CASE k WHEN 2 THEN seq % 3 > 1 WHEN 3 THEN NOT even ELSE FALSE END AS animated,
  CASE WHEN o >= 5 THEN h ELSE w END AS shown_width, CASE WHEN o >= 5 THEN w ELSE h END AS shown_height, CASE WHEN w * h > 40000000 THEN 'image-pixels' WHEN greatest(w, h) > 12000 THEN 'image-side' END AS code FROM j"""
_if = lambda test, value="1": f"CAST(coalesce(sum(CASE WHEN {test} THEN {value} ELSE 0 END), 0) AS BIGINT)"
_of = lambda k: f"seq % 3 = 0 AND seq // 3 % 5 = {k}"
_out = lambda f: f"seq % 29 = 0 AND source <> 'src3' AND seq // 29 % 3 = {f}"
_has, _bad_docs, _bad = f"bool_or({_out(0)})", "bool_or(seq % 211 = 0 AND seq // 211 % 2 = 1)", "bool_or(seq % 211 = 0 AND seq // 211 % 2 = 0)"
_SNAPSHOT = f"""WITH d AS (SELECT source, doc_id AS seq, coalesce(text, '') AS t FROM documents)
SELECT source AS bundle_id, count(*) AS part_count, CAST(sum(octet_length(encode(t))) AS BIGINT) AS total_bytes, CAST(sum(seq % 4) AS BIGINT) AS anchor_count, count(*) > 1 AS sharded, sha256(substr(arg_min(t, seq), 1, {rollups.PREVIEW})) AS preview,
  {_if('seq % 5 > 0 AND seq % 4 = 0')} AS completed_files, {_if('seq % 5 > 0 AND seq % 4 = 1')} AS partial_files, {_if('seq % 5 > 0 AND seq % 4 = 2')} AS failed_files,
  {_if(_of(0))} AS spreadsheet_workbooks, {_if(_of(0), 'seq % 7')} AS spreadsheet_sheets, {_if(_of(0), 'seq % 11')} AS spreadsheet_formula_cells, {_if(_of(1))} AS pdf_documents, {_if(_of(1), 'seq % 7')} AS pdf_source_pages,
  {_if(_of(2))} AS image_files, {_if(_of(2) + ' AND seq % 2 = 0')} AS image_visual_pages, {_if('seq % 3 = 0 AND seq // 3 % 5 >= 3')} AS office_documents, {_if(_of(3))} AS docx_documents, {_if(_of(4))} AS presentations, {_if(_of(4), 'seq % 7')} AS presentation_slides,
  {_if(_out(1), 'seq % 50')} AS spreadsheet_preview_pages, {_if(_out(1), 'seq * 10')} AS spreadsheet_preview_bytes, {_if(_out(2), 'seq % 50')} AS office_preview_pages, {_if(_out(2), 'seq * 10')} AS office_preview_bytes, {_if(_out(0), 'seq % 50')} AS documents_pages, {_if(_out(0), 'seq * 10')} AS documents_bytes,
  {_if('seq % 3 > 0')} AS secret_flagged_files, {_if('TRUE', 'seq % 3')} AS secret_findings, {_if('TRUE', 'seq % 2')} AS secret_redactions, {_if('seq % 13 = 0')} AS secret_excluded_files, {_if('seq % 17 = 0')} AS secret_visual_omissions,
  {_has} AND NOT {_bad_docs} AS documents_valid, NOT {_bad} AND (NOT {_has} OR NOT {_bad_docs}) AS valid FROM d GROUP BY source"""
SQL = {
    "artifact_snapshot": _SNAPSHOT,
    "image_meta": _IMAGES,
    "tree_checks": _CHECKS,
    "skipping_budget": """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT o_custkey, o_orderkey, size, n, size <= 400000 AS taken, CASE WHEN size <= 400000 THEN size ELSE 0 END AS used, CASE WHEN size <= 400000 THEN 1 ELSE 0 END AS k FROM o WHERE n = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.size, o.n, r.used + o.size <= 400000 AND k < 6, CASE WHEN r.used + o.size <= 400000 AND k < 6 THEN r.used + o.size ELSE r.used END, CASE WHEN r.used + o.size <= 400000 AND k < 6 THEN k + 1 ELSE k END FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.n = r.n + 1)
SELECT o_custkey, o_orderkey, size, taken FROM r""",
    "manifest_records": f"WITH {_RECORDS} SELECT bundle_id, seq, i AS index, octet_length(encode(t)) AS bytes, sha256(t) AS sha256 FROM texts",
    "tree_document": f"""WITH {_TREE} SELECT bundle_id, hex(encode(k)) AS key, CAST(0 AS INTEGER) AS sub, CASE WHEN f THEN '' ELSE ',' END || CASE WHEN depth = 0 THEN '' ELSE chr(10) || pad END || '{{' || chr(10) || pad || '  "children": [' || CASE WHEN many THEN '' ELSE ']' END AS text FROM ranked
UNION ALL SELECT bundle_id, hex(encode(CASE WHEN path = '' THEN chr(127) ELSE k || chr(3) END)), 1, CASE WHEN many THEN chr(10) || pad || '  ]' ELSE '' END || ',' || chr(10) || pad || '  "kind": "' || kind || '",' || chr(10) || pad || '  "name": "' || name || '",' || chr(10) || pad || '  "nodeId": "' || node_id || '",' || chr(10) || pad || '  "normalizedPath": "' || path || '"' || chr(10) || pad || '}}' FROM ranked""",
    "tree_digests": f"WITH {_DIGESTS} SELECT bundle_id, path, kind, n_files, digest FROM leaf" + "".join(f" UNION ALL SELECT bundle_id, path, kind, n_files, digest FROM l{d}" for d in range(8)),
    "bundle_parts": _PARTS,
    "run_bundle": _RUN,
    "cross_check": _CROSS,
    "list_mismatch": """WITH o AS (SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 AND l_linenumber <= 2 THEN 3 - l_linenumber ELSE l_linenumber END AS n, l_partkey FROM lineitem),
p AS (SELECT * FROM o WHERE NOT (l_orderkey % 13 = 0 AND n = 1) UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 17 = 0 AND l_linenumber = 1),
a AS (SELECT l_orderkey, list(CAST(l_linenumber AS VARCHAR) || ':' || l_partkey ORDER BY l_linenumber, l_partkey) AS x FROM lineitem GROUP BY l_orderkey),
b AS (SELECT l_orderkey, list(CAST(n AS VARCHAR) || ':' || l_partkey ORDER BY n, l_partkey) AS y FROM p GROUP BY l_orderkey)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey WHERE x IS DISTINCT FROM y""",
}
