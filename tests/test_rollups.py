"""Listings, rollups, sizes and previews on rows written by hand and against brute force."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from sheafline.functions import text
from sheafline.operators import rollups, tree


def test_preorder(spark):
    files = spark.createDataFrame([("b", p) for p in ("a/x10.txt", "a/x9.txt", "a b/c", "z", "a/sub/deep", "B/1")], "bundle_id string, path string")
    got = [r.path for r in rollups.preorder(tree.nodes(files)).orderBy("position").collect()]
    assert got == ["", "a", "a/sub", "a/sub/deep", "a/x9.txt", "a/x10.txt", "a b", "a b/c", "B", "B/1", "z"]
    assert rollups.preorder(tree.nodes(files.limit(0))).count() == 0


def test_issue_rollup(spark):
    rows = [
        ("b", 1, 0, "M", "partial", ["x", "y", "x"]), ("b", 1, 1, "P", "failed", ["z"]), ("b", 2, 0, "M", "completed", []), ("b", 3, 0, "M", "completed", None),
        ("b", 4, 1, "P", "completed", ["q"]), ("b", 4, 0, "P", "not-started", ["r", "q"]),
    ]
    got = rollups.issue_rollup(spark.createDataFrame(rows, "bundle_id string, seq long, place int, source string, status string, messages array<string>"))
    assert {r.seq: (r.status, r.details) for r in got.collect()} == {1: ("failed", ["[M] x", "[M] y", "[P] z"]), 4: ("not-started", ["[P] r", "[P] q"])}


def test_records_are_total(spark):
    files = spark.createDataFrame([("b", 1), ("b", 2)], "bundle_id string, seq long")
    records = spark.createDataFrame([("b", 1, "A")], "bundle_id string, seq long, level string")
    assert [r.seq for r in rollups.unmatched(files, records).collect()] == [2]
    with pytest.raises(Exception, match="no record of file b 2"):
        rollups.with_records(files, records).collect()
    assert [tuple(r) for r in rollups.with_records(files.filter("seq = 1"), records).collect()] == [("b", 1, "A")]


def test_processable(spark):
    rows = [(True, True, "text/plain", "text", "txt"), (False, True, "text/plain", "text", "txt"), (True, False, "application/pdf", "document", "pdf"), (True, False, "a/b", "document", "docm"), (True, False, "a/b", "document", "doc"), (True, None, None, None, None)]
    df = spark.createDataFrame(rows, "i boolean, t boolean, m string, c string, e string")
    assert [r.p for r in df.select(rollups.processable(*map(F.col, "itmce")).alias("p")).collect()] == [True, False, True, True, False, False]


def test_human_bytes(spark):
    sizes = {0: "0 B", 1023: "1,023 B".replace(",", ""), 1024: "1 KB", 1152: "1.13 KB", 1536: "1.5 KB", 10240: "10 KB", 5 << 20: "5 MB", 3 << 40: "3,072 GB", None: None}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.human_bytes(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == sizes


def wrap(value, width=88):
    """Brute force: words are added to a line while they fit."""
    out = []
    for line in value.split("\n"):
        now = ""
        for word in line.split():
            if now and len(now) + 1 + len(word) > width:
                out.append(now)
                now = ""
            now = f"{now} {word}".strip()
        out.append(now)
    return out


def test_previews(spark):
    texts = ["", "one", "a\n\n b  c \n", "w" * 100 + " x " + "v" * 88 + " u", " ".join(["lorem"] * 2000), "é“a”–ﬁ 日本\tq", ("abc " * 21 + "abcd\n") * 100, "x" * 87 + " y", "x" * 86 + " y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i long, t string")
    folded = text.ascii_folded(F.col("t"), keep=r"\n")
    got = {r.i: r for r in df.select("i", folded.alias("f")).withColumn("pages", text.preview_pages(F.col("f"))).collect()}
    assert got[99].pages is None
    assert got[5].f == 'e"a"-fi ???q'
    for i, t in enumerate(texts):
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M"))
        if t.isascii():
            assert got[i].f == plain.replace("\t", "?")
        lines = wrap(got[i].f)
        assert got[i].pages == [lines[a : a + 46] for a in range(0, len(lines), 46)]


def test_used_range(spark):
    cells = spark.createDataFrame([(1, 2, 5, None, False), (1, 9, 1, "=A1", True)], "sheet int, row int, col int, formula string, cut boolean")
    assert tuple(rollups.used_range(cells).first()) == (1, 2, 9, 1, 5, 2, 1, True)
