"""From files to a described bundle: import, preflight, selection, scan, redaction, packing, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats, paths, text
from ..operators import crosscheck, importing, manifest, packing, preflight, rollups, security, selection, tree
from ..operators.lineage import settled


def accepted(files: DataFrame) -> DataFrame:
    """The first file of each valid path."""
    return importing.accepted(importing.with_paths(files, composed=True))


def sections(files: DataFrame, max_part: int = 1 << 20) -> DataFrame:
    """bundle_id, ordinal, anchor, content, byte_length: marked and fenced sections of the files with a body, in path order.

    Bodies are cut first and each piece gets its own marker and fence, so no part ends inside one. The ordinal is path and
    segment.
    """
    most = max_part - packing.RESERVED - 2
    language = formats.fence_language(F.col("name"), F.col("extension"))
    rows = files.filter("body is not null").withColumn("body", text.normalize_newlines(F.col("body")))
    # marker with a segment's number, heading with the number in brackets, blank line, language
    rows = rows.withColumn("file_id", paths.node_id("file", F.col("path"))).withColumn("head", F.octet_length(crosscheck.marker(F.col("file_id"))) + F.octet_length("path") + F.octet_length(language) + 32)
    pieces = packing.fitted_segments(rows, most, "head", ("bundle_id", "path", "name", "extension", "file_id"))
    anchor = packing.anchor(F.col("file_id"), F.col("segment"))
    head = F.concat(crosscheck.marker(anchor), F.lit("\n## "), F.col("path"), F.when(F.col("segment") > 1, F.format_string(" (%d)", F.col("segment"))).otherwise(""), F.lit("\n\n"))
    content = F.concat(head, text.fenced(F.col("content"), language))
    out = pieces.select("bundle_id", F.struct("path", "segment").alias("ordinal"), anchor.alias("anchor"), content.alias("content"))
    return out.withColumn("byte_length", F.octet_length("content").cast("long"))


#: Kinds of atoms in their order within a bundle.
HEADER, TREE, INDEX, SECTION = range(4)


def atoms(recs: DataFrame, nodes: DataFrame, own: DataFrame, max_part: int = 1 << 20) -> DataFrame:
    """bundle_id, ordinal (kind, path, segment), anchor, content, byte_length: what all parts hold, in order.

    A header with the bundle's sums comes first, then its tree and an index of its files, both cut by lines, then the
    files' sections (own). recs are bundle_id, path, size, included, reason, and has_section.
    """
    most = max_part - packing.RESERVED - 2
    sums = manifest.summary(recs)
    says = [("Files", "files"), ("Files included", "included"), ("Files excluded", "excluded"), ("Bytes included", "included_bytes")]
    header = sums.select("bundle_id", F.lit(1).alias("segment"), F.concat(F.lit("## About this bundle\n\nThe manifest is the index of all files; paths are those of the source.\n"), *[x for title, c in says for x in (F.lit(f"\n- {title}: "), F.col(c).cast("string"))]).alias("content"))
    walk = rollups.preorder(nodes).filter("path <> ''")
    name = text.escaped(F.substring_index("path", "/", -1))
    lines = walk.select("bundle_id", "position", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), name, F.when(F.col("kind") == "directory", "/").otherwise("")).alias("line"))
    shown = F.when(~F.col("included"), F.concat(F.lit("excluded ("), "reason", F.lit(")"))).when(F.col("has_section"), F.concat(F.lit("anchor `"), paths.node_id("file", F.col("path")), F.lit("`"))).otherwise("no text")
    index = recs.select("bundle_id", "path", F.concat(F.lit("- **"), text.escaped(F.col("path")), F.lit("**, "), shown).alias("line"))
    tables = [(HEADER, header), (TREE, packing.line_atoms(lines, most, "position", "## Tree")), (INDEX, packing.line_atoms(index, most, "path", "## Index of files"))]
    out = own.withColumn("ordinal", F.struct(F.lit(SECTION).alias("kind"), "ordinal.path", "ordinal.segment"))
    for kind, t in tables:
        row = t.select("bundle_id", F.struct(F.lit(kind).alias("kind"), F.lit("").alias("path"), "segment").alias("ordinal"), F.lit(None).cast("string").alias("anchor"), "content", F.octet_length("content").cast("long").alias("byte_length"))
        out = out.unionByName(row)
    return out


def run_bundle(files: DataFrame, globs: list[str] = (), excluded: DataFrame | None = None, mode: str = "redact", max_part: int = 1 << 20, policy: security.ScanPolicy = security.ScanPolicy(None, None), with_parts: bool = True) -> dict[str, DataFrame]:
    """All tables of a bundle from files (bundle_id, seq, raw_path, size, compressed_size, mime_declared, content).

    Contents are classified and decoded once, into tables that the other ones read. Texts are scanned whole unless a policy
    limits that; `scans` tells of which files it did. Without parts, nothing is rendered or packed.
    """
    with_path = importing.with_paths(files, composed=True)
    good = importing.accepted(with_path)
    recs = settled(selection.inclusion(preflight.records(good), list(globs), excluded))
    chosen = good.join(recs.filter("included and is_text").select("bundle_id", "seq"), ["bundle_id", "seq"], "left_semi")
    bodies = settled(chosen.select("bundle_id", "seq", "path", "name", "extension", text.decoded(F.col("content"))["text"].alias("body")))
    found = settled(security.findings(bodies, policy))
    scans = security.scan_reports(bodies, found, policy)
    nodes, records, totals = tree.nodes(recs), manifest.file_records(recs), preflight.totals(recs)
    out = {
        "issues": importing.issues(with_path), "preflight": recs, "totals": totals, "mode": preflight.output_mode(totals), "nodes": nodes, "findings": found, "scans": scans,
        "security": security.summary(found, reports=scans), "manifest": records, "summary": manifest.summary(recs), "violations": manifest.inconsistent(records),
    }
    if not with_parts:
        return out
    safe = security.by_mode(bodies, found, mode)
    listed = recs.withColumn("has_section", F.col("is_text"))
    if mode == "exclude":
        listed = listed.join(safe.filter("status = 'excluded'").select("bundle_id", "seq", F.lit(True).alias("gone")), ["bundle_id", "seq"], "left")
        listed = listed.withColumns({"reason": F.when(F.col("gone"), "excluded-secret-policy").otherwise(F.col("reason")), "included": F.col("included") & F.col("gone").isNull()})
    every = settled(atoms(listed, nodes, sections(safe, max_part), max_part))
    return out | {"parts": packing.parts_text(every, packing.pack(every, max_part), manifest.project_name(F.col("bundle_id")))}
