"""Canonical JSON of manifests in plans: keys sorted at every level, two spaces of indent, null values kept.

A record is one expression over its columns, driven by its schema. A whole manifest is a table of texts in order, whose
concatenation is the document: files, directories, their children and the nodes of the nested tree are rows of their own,
so no row grows with the bundle and nothing is put together on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, NullType, StringType, StructType

from ..functions import paths
from . import manifest
from .lineage import settled
from .packing import running_totals
from .rollups import preorder_key

_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(text: Column) -> Column:
    """A JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(_SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1F"\\]'), out).otherwise(text), F.lit('"'))


def key_order(name: str) -> tuple[str, str]:
    """Sorts keys of ASCII letters as a locale does: by letter, lower case first."""
    return name.lower(), name.swapcase()


def rendered(value: Column, kind: DataType, indent: int = 0) -> Column:
    """A value of the type as JSON text whose own lines are indented by so many spaces; the first one is not."""
    inner, outer = F.lit("\n" + " " * (indent + 2)), F.lit("\n" + " " * indent)
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: key_order(f.name))
        if not fields:
            return F.when(value.isNull(), "null").otherwise("{}")
        each = [F.concat(inner, F.lit(f'"{f.name}": '), rendered(value.getField(f.name), f.dataType, indent + 2)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *each), outer, F.lit("}"))
    elif isinstance(kind, ArrayType):
        each = F.transform(value, lambda x: F.concat(inner, rendered(x, kind.elementType, indent + 2)))
        text = F.when(F.size(value) == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(each, ","), outer, F.lit("]")))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        names = F.transform(F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(F.lower(k).alias("a"), F.translate(k, _LOWER + _LOWER.upper(), _LOWER.upper() + _LOWER).alias("b"), k.alias("k")))), lambda s: s["k"])
        each = F.transform(names, lambda k: F.concat(inner, quoted(k), F.lit(": "), rendered(F.element_at(value, k), kind.valueType, indent + 2)))
        text = F.when(F.size(value) == 0, "{}").otherwise(F.concat(F.lit("{"), F.array_join(each, ","), outer, F.lit("}")))
    elif isinstance(kind, StringType):
        text = quoted(value)
    elif isinstance(kind, (IntegralType, BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, NullType):
        return F.lit("null")
    else:
        raise ValueError(f"no JSON for values of type {kind.simpleString()}")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


_LOWER = "abcdefghijklmnopqrstuvwxyz"


def record_text(df: DataFrame, column: str, indent: int = 0) -> Column:
    return rendered(F.col(column), df.schema[column].dataType, indent)


_strings = lambda: F.expr("cast(array() as array<string>)")


def file_documents(recs: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """bundle_id, seq, path, record: the manifest's record of each file before conversion.

    recs are the selected preflight records, scans the scan reports with high and medium counts where there are any. A
    file's index is its place in the order of paths, numbers by value.
    """
    rows = recs.withColumns({"key": F.concat(paths.natural_key(F.col("path")), F.lit("\x01"), "path"), "one": F.lit(1).cast("long")})
    rows = running_totals(rows, ("bundle_id",), "key", "one").withColumn("index", F.col("upto") - 1)
    if scans is None:
        rows = rows.withColumns({"status": F.lit(None).cast("string"), "finding_count": F.lit(0), "high": F.lit(0), "medium": F.lit(0), "categories": _strings(), "scan_truncated": F.lit(False), "scan_warnings": _strings()})
    else:
        rows = rows.join(scans.select("bundle_id", "seq", "status", "finding_count", "high", "medium", "categories", "scan_truncated", F.col("warnings").alias("scan_warnings")), ["bundle_id", "seq"], "left")
    or_none = lambda c: F.coalesce(F.col(c), _strings())
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    planned = F.when(F.col("included"), "not-started").otherwise("not-applicable")
    null = F.lit(None).cast("string")
    struct = lambda **fields: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])
    declared = F.col("mime_declared") if "mime_declared" in recs.columns else null
    encoding = F.col("encoding") if "encoding" in recs.columns else null
    doc = struct(
        fileId=paths.node_id("file", F.col("path")), normalizedPath=F.col("path"), parentDirectoryId=paths.node_id("directory", paths.parent(F.col("path"))), name=F.col("name"), extension=F.col("extension"), size=F.col("size"),
        compressedSize=F.col("compressed_size"), mimeDeclared=declared, mimeDetected=F.col("mime"), detectionMethod=F.col("method"), category=F.col("category"), capabilityLevel=F.col("level"), isText=F.col("is_text"), encoding=encoding,
        risks=F.col("risks"), riskLevel=F.col("risk_level"), inclusion=struct(included=F.col("included"), reason=F.col("reason"), matchedGlob=F.col("matched_glob")),
        security=struct(status=F.coalesce("status", F.lit("not-scanned")), findingCount=count("finding_count"), highSeverityCount=count("high"), mediumSeverityCount=count("medium"), categories=or_none("categories"), redactionCount=0, excluded=False,
                        visualOmitted=False, scanTruncated=F.coalesce("scan_truncated", F.lit(False)), warnings=or_none("scan_warnings"), error=null),
        integrity=struct(algorithm="SHA-256", status="pending", value=null, error=null), adapter=struct(id=F.col("adapter"), version=null, conversionStatus=planned),
        representations=struct(
            manifest=struct(recorded=True, pointer=F.concat(F.lit("/files/"), F.col("index").cast("string"))),
            markdown=struct(status=planned, anchors=_strings(), parts=_strings(), truncated=False, originalBytes=F.col("size"), extractedBytes=0, extractedCharacters=0, lineCount=0, encoding=encoding, usedFallback=False, replacementCharacters=0, newlineNormalization=null, error=null),
            pdf=struct(status=planned, pages=F.expr("cast(array() as array<int>)"), parts=_strings())))
    return rows.select("bundle_id", "seq", "path", "index", doc.alias("record"))


#: Columns of a document's texts; their order is that of the document.
PLACE = ("section", "key", "sub", "child")


def _rows(df: DataFrame, section: int, key, sub: int, child, text: Column) -> DataFrame:
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("bundle_id", F.lit(section).alias("section"), column(key).alias("key"), F.lit(sub).alias("sub"), column(child).alias("child"), text.alias("text"))


def _firsts(nodes: DataFrame, by: list[str]) -> DataFrame:
    """nodes with whether each is the first of its group: by the least key, which is summed up before it is joined."""
    least = nodes.groupBy("bundle_id", *by).agg(F.min("key").alias("__least"))
    return nodes.join(least, ["bundle_id", *by]).withColumn("first", F.col("key") == F.col("__least")).drop("__least")


def _keyed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("key", preorder_key(F.col("path"), F.col("kind")))


def tree_rows(nodes: DataFrame, section: int = 0, indent: int = 0) -> DataFrame:
    """The nested tree of each bundle as texts: a node opens before its children, which are its first key, and its other keys follow them."""
    rows = settled(_keyed(nodes.filter("bundle_id is not null")).withColumn("above", F.coalesce("parent_id", F.lit(""))))
    least = settled(rows.groupBy("bundle_id", "above").agg(F.min("key").alias("key"), F.bool_or(F.col("parent_id").isNotNull()).alias("holds")))  # a row for each node with children
    first = least.select("bundle_id", "above", "key", F.lit(True).alias("first"))
    full = least.filter("holds").select("bundle_id", F.col("above").alias("node_id"), F.lit(True).alias("full"))
    rows = rows.drop("parent_id").join(first, ["bundle_id", "above", "key"], "left").drop("above")  # by the key too, so that no task gets all children of one node
    rows = rows.join(full, ["bundle_id", "node_id"], "left").fillna(False, ["first", "full"])
    pad = F.repeat(F.lit(" "), F.col("depth") * 4 + indent)
    lead = F.concat(F.when(F.col("first"), "").otherwise(","), F.when(F.col("depth") == 0, "").otherwise(F.concat(F.lit("\n"), pad)))
    opened = F.concat(lead, F.lit("{\n"), pad, F.lit('  "children": ['), F.when(F.col("full"), "").otherwise("]"))
    fields = [("kind", F.col("kind")), ("name", F.col("name")), ("nodeId", F.col("node_id")), ("normalizedPath", F.col("path"))]
    closed = F.concat(F.when(F.col("full"), F.concat(F.lit("\n"), pad, F.lit("  ]"))).otherwise(""), *[F.concat(F.lit(",\n"), pad, F.lit(f'  "{k}": '), quoted(v)) for k, v in fields], F.lit("\n"), pad, F.lit("}"))
    end = F.when(F.col("path") == "", "\x7f").otherwise(F.concat("key", F.lit("\x03")))  # behind all that lies below
    both = F.stack(F.lit(2), F.col("key"), F.lit(0), F.lit(""), opened, end, F.lit(1), F.lit(""), closed)  # not a union, which would join twice
    return rows.select("bundle_id", F.lit(section).alias("section"), both.alias("key", "sub", "child", "text"))


def directory_rows(nodes: DataFrame, section: int, indent: int = 4) -> DataFrame:
    """Records of all directories as texts; each child's id is a row."""
    pad = " " * indent
    dirs = nodes.filter("kind = 'directory'").withColumn("key", F.concat(paths.natural_key(F.col("path")), F.lit("\x01"), "path"))
    dirs = dirs.withColumn("first", F.col("path") == "")  # the root has the least path
    below = _firsts(_keyed(nodes.filter("parent_id is not null")), ["parent_id", "kind"])
    parts, lists = [], {}
    for sub, (name, kind) in enumerate((("childDirectoryIds", "directory"), ("childFileIds", "file"))):
        own = below.filter(F.col("kind") == kind)
        has = own.select("bundle_id", F.col("parent_id").alias("node_id")).distinct().withColumn(name, F.lit(True))
        dirs = dirs.join(has, ["bundle_id", "node_id"], "left")
        lists[name] = F.coalesce(name, F.lit(False))
        above = dirs.select("bundle_id", F.col("node_id").alias("parent_id"), F.col("key").alias("dir"))
        parts.append(_rows(own.join(above, ["bundle_id", "parent_id"]), section, F.col("dir"), 2 * sub + 1, F.col("key"), F.concat(F.when(F.col("first"), "").otherwise(","), F.lit(f"\n{pad}    "), quoted(F.col("node_id")))))
    starts = lambda name: F.concat(F.lit(f'  "{name}": ['), F.when(lists[name], "").otherwise("]"))
    ends = lambda name: F.when(lists[name], f"\n{pad}  ]").otherwise("")
    fields = [("directoryId", quoted(F.col("node_id"))), ("name", quoted(F.col("name"))), ("normalizedPath", quoted(F.col("path"))), ("parentDirectoryId", F.coalesce(quoted(F.col("parent_id")), F.lit("null")))]
    parts.append(_rows(dirs, section, F.col("key"), 0, "", F.concat(F.when(F.col("first"), "").otherwise(","), F.lit(f"\n{pad}{{\n{pad}"), starts("childDirectoryIds"))))
    parts.append(_rows(dirs, section, F.col("key"), 2, "", F.concat(ends("childDirectoryIds"), F.lit(f",\n{pad}"), starts("childFileIds"))))
    parts.append(_rows(dirs, section, F.col("key"), 4, "", F.concat(ends("childFileIds"), *[F.concat(F.lit(f',\n{pad}  "{k}": '), v) for k, v in fields], F.lit(f"\n{pad}}}"))))
    return reduce(DataFrame.unionByName, parts)


def manifest_rows(recs: DataFrame, nodes: DataFrame, settings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """bundle_id, section, key, sub, child, text: the manifest of each bundle; its texts in the order of PLACE are the document.

    settings has one row for each bundle: bundle_id and columns that become keys of the document as they are (their names
    may not be those of the tables below).
    """
    files = file_documents(recs, scans)
    sums = manifest.summary(recs).select("bundle_id", F.struct(F.col("files").alias("fileCount"), F.col("included").alias("includedFileCount"), F.col("excluded").alias("excludedFileCount"), F.col("blocked").alias("blockedFileCount"), F.col("bytes").alias("logicalBytes"), F.col("included_bytes").alias("includedLogicalBytes")).alias("summary"))
    head = settings.join(sums, "bundle_id")
    names = sorted([*[c for c in head.columns if c != "bundle_id"], "directories", "files", "tree"], key=key_order)
    parts = []
    for at, name in enumerate(names):
        lead = F.lit(("{" if not at else ",") + f'\n  "{name}": ')
        if name == "tree":
            parts += [_rows(head, at, "", -1, "", lead), tree_rows(nodes, at, 2)]
        elif name in ("files", "directories"):  # a bundle has a file at least, and so a root
            body = directory_rows(nodes, at) if name == "directories" else _rows(files, at, F.lpad(F.col("index").cast("string"), 19, "0"), 0, "", F.concat(F.when(F.col("index") == 0, "").otherwise(","), F.lit("\n    "), record_text(files, "record", 4)))
            parts += [_rows(head, at, "", -1, "", F.concat(lead, F.lit("["))), body, _rows(head, at, "\x7f", 9, "", F.lit("\n  ]"))]
        else:
            parts.append(_rows(head, at, "", 0, "", F.concat(lead, record_text(head, name, 2))))
    return reduce(DataFrame.unionByName, [*parts, _rows(head, len(names), "", 0, "", F.lit("\n}\n"))])


def stretches(rows: DataFrame, most: int) -> DataFrame:
    """bundle_id, stretch, content: a document's texts joined in order, about `most` bytes a row."""
    order = F.struct(*PLACE)
    held = running_totals(rows.select("bundle_id", order.alias("at"), "text", F.octet_length("text").cast("long").alias("bytes")), ("bundle_id",), "at", "bytes")
    held = held.withColumn("stretch", F.floor((F.col("upto") - F.col("bytes")) / most))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return held.groupBy("bundle_id", "stretch").agg(text.alias("content"))


def tree_digests(nodes: DataFrame) -> DataFrame:
    """bundle_id, path, kind, n_files, digest: of each subtree, from the leaves up, one level of depth after another.

    A directory's digest follows from its children's names and digests by sums of hashes, which Spark adds up map-side, so
    a directory with very many children is one small row at every step. Equal subtrees have equal digests wherever they lie.
    """
    rows = settled(nodes.select("bundle_id", "node_id", "parent_id", "kind", "name", "path", "depth"))
    sha = lambda *parts: F.sha2(F.concat_ws("\x01", *parts), 256)
    number = lambda hashed, at: F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(38,0)")
    leaf = rows.filter("kind = 'file'").select("*", F.lit(1).cast("long").alias("n_files"), sha(F.lit("file"), "name").alias("digest"))
    depths = [r.depth for r in rows.filter("kind = 'directory'").select("depth").distinct().collect()]  # no path is deeper than the limit of depth
    done, last = [leaf], None
    for depth in sorted(depths, reverse=True):
        kids = leaf.filter(F.col("depth") == depth + 1)
        if last is not None:
            kids = kids.unionByName(last)
        each = kids.filter("parent_id is not null").withColumn("h", sha("kind", "name", "digest"))
        sums = each.groupBy("bundle_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_files").alias("n_files"), F.sum(number("h", 1)).alias("a"), F.sum(number("h", 16)).alias("b"))
        dirs = rows.filter((F.col("kind") == "directory") & (F.col("depth") == depth)).join(sums, ["bundle_id", "node_id"], "left").fillna(0, ["n", "n_files"])
        zero = F.lit("0")
        digest = sha(F.lit("directory"), F.col("n").cast("string"), F.coalesce(F.col("a").cast("string"), zero), F.coalesce(F.col("b").cast("string"), zero))
        last = settled(dirs.select(*rows.columns, "n_files", digest.alias("digest")))
        done.append(last)
    return reduce(DataFrame.unionByName, done).select("bundle_id", "path", "kind", "n_files", "digest")
