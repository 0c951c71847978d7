"""Canonical documents in plans against documents built in Python."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sheafline.operators import documents as d
from sheafline.operators import manifest, tree
from sheafline.plans import bundle
from sheafline.sources import files


def canonical(value):
    """Keys sorted as key_order does."""
    import json

    def ordered(x):
        if isinstance(x, dict):
            return {k: ordered(x[k]) for k in sorted(x, key=d.key_order)}
        return [ordered(y) for y in x] if isinstance(x, list) else x

    return json.dumps(ordered(value), indent=2, ensure_ascii=False)


def test_values_render_as_json(spark):
    texts = ["", 'a"b\\c', "\n\t\r\b\f", "".join(map(chr, range(32))) + "\x7f", "é😀/ ", "\\u000b", None]
    rows = [(i, (t, [t, "x"], {"b": 1, "B": None, "a": 2}, None if i == 2 else (i, [(True, [])]), [])) for i, t in enumerate(texts)] + [(99, None)]
    schema = "i int, v struct<text:string,list:array<string>,Names:map<string,int>,zeta:struct<n:bigint,Inner:array<struct<yes:boolean,none:array<int>>>>,none:array<string>>"
    df = spark.createDataFrame(rows, schema)
    for r in df.select("i", "v", d.record_text(df, "v").alias("text"), d.record_text(df, "v", 4).alias("deep")).collect():
        want = canonical(r.v.asDict(recursive=True) if r.v is not None else None)
        assert r.text == want and r.deep == want.replace("\n", "\n    ")
    with pytest.raises(ValueError, match="double"):
        d.rendered(F.lit(1.5), spark.createDataFrame([(1.5,)], "x double").schema["x"].dataType)
    assert manifest.canonical_json({"b": [1], "a": None}) == canonical({"b": [1], "a": None}) + "\n"


def nested(nodes, path=""):
    """The tree built by recursion."""
    node = nodes[path]
    kids = sorted((n for n in nodes.values() if n.path and n.path.rpartition("/")[0] == path), key=lambda n: (n.kind == "file", *natural(n.name)))
    return {"nodeId": node.node_id, "kind": node.kind, "name": node.name, "normalizedPath": path, "children": [nested(nodes, n.path) for n in kids]}


def natural(name):
    import re

    return "".join(x.zfill(20) if x.isdigit() else x for x in re.findall(r"\d+|\D+", name.lower())), name


def test_manifest_equals_a_document_built_in_python(spark):
    raw = [("src/a10.py", b"print(1)"), ("src/a9.py", b"x"), ("src/sub/deep/é \"q\".md", b"# hi"), ("README.md", b"AKIA" + b"A1" * 8), ("bin/x.exe", b"MZ\x90\0"), ("B/b.txt", b""), ("a", b"?")]
    table = files.from_rows(spark, [("p", i, p, "list", len(c), len(c), None, None, bytearray(c)) for i, (p, c) in enumerate(raw)] + [("q", 1, "one.txt", "list", 1, 1, None, None, bytearray(b"1"))])
    out = bundle.run_bundle(table, ["src/a9*"], with_parts=False)
    settings = spark.createDataFrame([("p", "1.0", ("en", ["src/a9*"])), ("q", "1.0", ("de", []))], "bundle_id string, schemaVersion string, settings struct<language:string,exclusionGlobs:array<string>>")
    scans = out["scans"].withColumns({"high": F.lit(0), "medium": F.lit(0)})
    rows = d.manifest_rows(out["preflight"], out["nodes"], settings, scans)
    assert rows.columns == ["bundle_id", *d.PLACE, "text"]
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.bundle_id, r.section, r.key.encode(), r.sub, r.child.encode())):
        got[r.bundle_id] = got.get(r.bundle_id, "") + r.text
    records = {(r.bundle_id, r.path): r.record.asDict(recursive=True) for r in d.file_documents(out["preflight"], scans).collect()}
    for b, language, globs in (("p", "en", ["src/a9*"]), ("q", "de", [])):
        nodes = {n.path: n for n in out["nodes"].filter(F.col("bundle_id") == b).collect()}
        paths = sorted((p for x, p in records if x == b), key=lambda p: natural_path(p))
        dirs = sorted((n for n in nodes.values() if n.kind == "directory"), key=lambda n: natural_path(n.path))
        kids = lambda n, kind: [k["nodeId"] for k in nested(nodes, n.path)["children"] if k["kind"] == kind]  # noqa: B023, E731
        s = next(x for x in out["summary"].collect() if x.bundle_id == b)
        want = {
            "schemaVersion": "1.0", "settings": {"language": language, "exclusionGlobs": globs}, "tree": nested(nodes), "files": [records[b, p] for p in paths],
            "summary": {"fileCount": s.files, "includedFileCount": s.included, "excludedFileCount": s.excluded, "blockedFileCount": s.blocked, "logicalBytes": s.bytes, "includedLogicalBytes": s.included_bytes},
            "directories": [{"directoryId": n.node_id, "normalizedPath": n.path, "name": n.name, "parentDirectoryId": n.parent_id, "childDirectoryIds": kids(n, "directory"), "childFileIds": kids(n, "file")} for n in dirs],
        }
        assert got[b] == canonical(want) + "\n"
        assert [records[b, p]["representations"]["manifest"]["pointer"] for p in paths] == [f"/files/{i}" for i in range(len(paths))]
    secret = records["p", "README.md"]["security"]
    assert (secret["status"], secret["findingCount"], secret["categories"]) == ("flagged", 1, ["cloud-credential"]) and records["p", "bin/x.exe"]["inclusion"]["reason"] == "blocked-capability"
    pieces = sorted(d.stretches(rows.filter("bundle_id = 'p'"), 700).collect(), key=lambda r: r.stretch)
    assert "".join(r.content for r in pieces) == got["p"] and len(pieces) > 5


def natural_path(path):
    import re

    return "".join(x.zfill(20) if x.isdigit() else x for x in re.findall(r"\d+|\D+", path)) + "\x01" + path


def test_tree_digests_equal_a_recursion(spark):
    r = random.Random(2)
    rows = {(f"b{i % 2}", "/".join(r.choice("abc") + str(r.randrange(2)) for _ in range(r.randrange(1, 6))) + "/f" + str(i % 3)) for i in range(90)} | {("b0", "top"), ("one", "x")}
    nodes = tree.nodes(spark.createDataFrame(sorted(rows), "bundle_id string, path string"))
    every = {(n.bundle_id, n.path): n for n in nodes.collect()}
    sha = lambda *x: sha256("\x01".join(x).encode()).hexdigest()

    def digest(b, path):
        n = every[b, path]
        if n.kind == "file":
            return 1, sha("file", n.name)
        kids = [(k, *digest(b, k.path)) for (o, p), k in every.items() if o == b and p and p.rpartition("/")[0] == path]
        hashes = [sha(k.kind, k.name, x) for k, _, x in kids]
        return sum(m for _, m, _ in kids), sha("directory", str(len(kids)), str(sum(int(h[:15], 16) for h in hashes)), str(sum(int(h[15:30], 16) for h in hashes)))

    assert {(x.bundle_id, x.path): (x.n_files, x.digest) for x in d.tree_digests(nodes).collect()} == {k: digest(*k) for k in every}
    assert d.tree_digests(nodes.limit(0)).count() == 0


def moved_rows(df):
    """Rows that each shuffle of a collected plan wrote."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_a_tree_is_moved_twice_at_most(spark):
    flat = [("a", f"d/f{i}") for i in range(900)] + [("a", f"e{i}/x") for i in range(50)] + [(None, "lost"), ("a", None), ("b", "one")]
    nodes = tree.nodes(spark.createDataFrame(flat, "bundle_id string, path string"))
    n = nodes.filter("bundle_id is not null").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = d.tree_rows(nodes)
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.columns == ["bundle_id", *d.PLACE, "text"] and len(got) == 2 * n
    assert sum(moved_rows(out)) < 2.2 * n  # rows for the two joins, and one of each directory
    assert sorted((r.bundle_id, r.sub) for r in got if r.text is None) == [("a", 0), ("a", 1)]  # a file without a path keeps its rows


def test_odd_trees_keep_their_texts(spark):
    rows = [
        ("a", "r", None, "directory", "", "", 0), ("a", "d", "r", "directory", "d", "d", 1), ("a", "d", "r", "directory", "d", "d", 1), ("a", "f", "d", "file", "f", "d/f", 2), ("a", "g", "d", "file", "f", "d/f", 2), ("a", "f", "r", "file", "f", "d/f", 1),
        ("a", "h", "f", "file", "h", "h", 2), ("a", None, "d", "file", "n", "d/n", 2), ("a", "", "", "file", "e", "e", 1), ("a", "z", "gone", "file", "z", "q/z", 2), (None, "r", None, "directory", "", "", 0), ("b", "x", None, "file", None, None, None),
    ]
    got = d.tree_rows(spark.createDataFrame(rows, "bundle_id string, node_id string, parent_id string, kind string, name string, path string, depth int")).collect()
    starts = sorted((r.key, r.text.startswith(","), r.text.endswith("]")) for r in got if r.sub == 0 and r.text is not None)
    key = lambda *x: "\x02".join(f"{k}{n}\x01{n}" for k, n in x)
    want = [("", False, False)] + 2 * [(key("0d"), False, False)] + [(key("0d", "1f"), False, False), (key("0d", "1f"), False, True), (key("0d", "1f"), True, False), (key("0d", "1n"), True, True), (key("1h"), False, True), (key("1e"), True, False), (key("0q", "1z"), False, True)]
    assert starts == sorted(want) and len(got) == 22
    assert [(r.sub, r.key) for r in got if r.bundle_id == "b"] == [(0, None), (1, None)] and all(r.text is None for r in got if r.bundle_id == "b")
