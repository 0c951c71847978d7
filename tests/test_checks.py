"""Manifest checks, enrichment, decoding and escaping on rows written by hand."""

import unicodedata
from itertools import product

from pyspark.sql import functions as F

from sheafline.functions import text
from sheafline.operators import enrichment, importing, validation
from sheafline.plans import bundle
from sheafline.sources import files


def codes(df):
    return sorted(r.code for r in df.collect())


def test_decoding(spark):
    given = {
        1: b"\xef\xbb\xbfcaf\xc3\xa9\r\nx\ry", 2: b"caf\xe9 \x80\x81\x9f", 3: b"\xff\xfe" + "aé😀".encode("utf-16-le"), 4: b"\xfe\xff" + "aé".encode("utf-16-be"),
        5: b"", 6: b"\xff\xfea\x00\x00\xd8", 7: None,
    }
    rows = spark.createDataFrame(list(given.items()), "seq long, content binary")
    got = {r.seq: (r.text, r.encoding, r.fallback) for r in rows.select("seq", text.decoded(F.col("content")).alias("d")).select("seq", "d.*").collect()}
    assert got[1] == ("café\nx\ny", "utf-8-bom", False)
    assert got[2] == ("café €\x81Ÿ", "windows-1252", True)
    assert got[3] == ("aé😀", "utf-16le", False)
    assert got[4] == ("aé", "utf-16be", False)
    assert got[5] == ("", "utf-8", False)
    assert got[6][0] == "a�"
    assert got[7][0] is None


def test_utf16_is_decoded_without_python(spark, capsys):
    units = [b"\x00\xd8", b"\x01\xdc", b"\xff\xdb", b"a\x00", b"\xff\xfe", b"\x00\x00", b"\xac\x20"]
    bodies = [b"".join(x) + rest for n in range(4) for x in product(units, repeat=n) for rest in (b"", b"\xd8")]
    bodies.append("é😀\n".encode("utf-16-le") * 200_000)
    swapped = lambda b: b"".join(b[i : i + 2][::-1] for i in range(0, len(b), 2))
    given = [(i, m + (b if m == b"\xff\xfe" else swapped(b))) for i, (b, m) in enumerate(product(bodies, (b"\xff\xfe", b"\xfe\xff")))]
    rows = spark.createDataFrame(given, "seq long, content binary").select("seq", text.decoded(F.col("content"))["text"].alias("t"))
    assert {r.seq: r.t for r in rows.collect()} == {i: b[2:].decode("utf-16-le" if b[:1] == b"\xff" else "utf-16-be", "replace") for i, b in given}
    rows.explain()
    assert "EvalPython" not in capsys.readouterr().out


def test_escapes_and_times(spark):
    row = spark.createDataFrame([("a<b>&c\\*_[]#",)], "t string").select(text.escaped(F.col("t")).alias("t")).first()
    assert row.t == "a&lt;b&gt;&amp;c\\\\\\*\\_\\[\\]\\#"
    times = {"2024-02-29T10:00:00.000Z": True, "2023-02-29T10:00:00.000Z": False, "2024-01-01T10:00:00Z": False, "": False, None: False, "2024-01-01T25:00:00.000Z": False}
    rows = spark.createDataFrame([(t,) for t in times], "t string").select("t", text.is_iso(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in rows} == times


def test_composed_paths(spark):
    wide, plain = "résumé.txt", unicodedata.normalize("NFC", "résumé.txt")
    rows = files.from_rows(spark, [("b", i, p, "zip", 1, 1, None, None, b"x") for i, p in enumerate((wide, plain, "a.txt"))])
    got = importing.first_wins(importing.with_paths(rows, composed=True)).filter("copy = 1").orderBy("seq").collect()
    assert [r.path for r in got] == [plain, "a.txt"]


def test_bundle_keeps_letters_of_other_encodings(spark):
    rows = files.from_rows(spark, [("b", 1, "a.txt", "zip", 4, 4, None, None, b"caf\xe9 and a longer text")])
    parts = bundle.run_bundle(rows)["parts"].collect()
    assert any("café" in str(p) for p in parts)


def test_integrity_and_unknown_states(spark):
    schema = "bundle_id string, seq long, integrity_status string, integrity_value string, integrity_error string"
    rows = [("b", 1, "computed", "a" * 64, None), ("b", 2, "computed", "A" * 64, None), ("b", 3, None, None, None), ("b", 4, "failed", None, "x"), ("b", 5, "pending", None, "x")]
    assert codes(validation.integrity(spark.createDataFrame(rows, schema))) == ["integrity-computed", "integrity-pending", "integrity-status"]
    assert codes(validation.integrity(spark.createDataFrame([], schema))) == []


def test_parts_ranges_and_totals(spark):
    mark = lambda a: f'<a id="{a}"></a>'
    rows = [("b", 1, mark("x") + "é", len(mark("x")) + 2, ["x"]), ("b", 2, mark("x") * 2, 3, ["x"]), ("b", 3, "z" * 99, 99, ["y"]), ("b", 4, "", 0, [])]
    found = validation.text_parts(spark.createDataFrame(rows, "bundle_id string, part long, content string, byte_length long, anchors array<string>"), 50)
    assert sorted((r.part, r.code) for r in found.collect()) == [(2, "anchor-occurrence"), (2, "part-byte-length"), (3, "anchor-occurrence"), (3, "part-limit")]
    est = spark.createDataFrame([("b", 1, 2, 1), ("b", 2, 1, 1)], "bundle_id string, seq long, md_min long, md_max long")
    assert codes(validation.ranges(est, ["md"])) == ["range-order-md"]
    one = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "bundle_id string, files long")
    two = spark.createDataFrame([("a", 1), ("b", 9), ("d", 3)], "bundle_id string, files long")
    assert sorted(r.bundle_id for r in validation.declared_totals(one, two).filter("bundle_id is not null").collect()) == ["b", "c", "d"]


def test_enrichment(spark):
    recs = spark.createDataFrame([("b", 1, "completed", ["w"]), ("b", 2, "not-started", None), ("b", 3, "completed", [])], "bundle_id string, seq long, status string, warnings array<string>")
    made = spark.createDataFrame([("b", 1, "failed", [1], ["v", "w"]), ("b", 2, "failed", [], ["x"])], "bundle_id string, seq long, page_status string, pages array<int>, page_warnings array<string>")
    got = {r.seq: (r.status, r.warnings) for r in enrichment.with_pages(recs, made).collect()}
    assert got == {1: ("partial", ["w", "v"]), 2: ("failed", ["x"]), 3: ("completed", [])}
    left = spark.createDataFrame([("b", "p"), ("b", "q")], "bundle_id string, path string")
    assert [r.path for r in enrichment.without_match(left, left.filter("path = 'p'")).collect()] == ["q"]
