"""Registered queries cover every row and all of each text."""

import math

import pytest

from sheafline.queries import QUERIES

#: Numbers of long documents: a .md, a .pem and a .py file that no rule of the demonstration files sends elsewhere.
LONG = (29, 40, 100)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with three documents of over 16,384 bytes, cut within a character there, and a short one."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, "x" + "é" * 10_000, "en", "src2", 10_001) for i in LONG] + [(15, "short", "en", "src2", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(15, "u", "<p>" + "y" * 20_000)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(2, 1, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", ["text_sniff", "classify_files", "risk_assess", "size_estimate", "inclusion"])
def test_long_files_have_rows(spark, tables, name):
    rows = QUERIES[name](spark, tables).collect()
    assert sorted((r.bundle_id, r.seq) for r in rows) == [("conversations", 2001), *[("documents", i) for i in (15, *LONG)], ("pages", 15)]
    if "is_text" in rows[0]:
        assert all(r.is_text for r in rows if r.seq in LONG and r.seq != 40)


def test_totals_count_long_files(spark, tables):
    size = 3 * 20_001 + 5
    totals = {r.bundle_id: r for r in QUERIES["preflight_totals"](spark, tables).collect()}
    assert (totals["documents"].file_count, totals["documents"].logical_bytes, totals["documents"].largest) == (4, size, 20_001)
    assert totals["pages"].logical_bytes == 20_003
    assert {r.bundle_id: r.mode for r in QUERIES["output_mode"](spark, tables).collect()}["documents"] == "quick-preview"  # for the name of the .pem file
    summary = {r.bundle_id: r for r in QUERIES["manifest_summary"](spark, tables).collect()}
    assert (summary["documents"].files, summary["documents"].bytes) == (4, size)
    assert {r.seq for r in QUERIES["view_filter"](spark, tables).collect()} >= {29}
    assert [r.seq for r in QUERIES["validate_inclusion"](spark, tables).collect()] == [100]


def test_secrets_behind_the_limits_of_a_scan(spark, tmp_path):
    keys = "\n".join(f"AKIA{i:016d}" for i in range(150))
    docs = [(1, f"{keys}\npassword = 'hunter22'"), (2, "a b " * 600_000 + "\ntoken = abcdef12"), (3, "\n".join(f"secret: value{i}" for i in range(120)))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    found = run("password_findings")
    assert sorted((r.seq, r.line, r.column) for r in found if r.seq < 3) == [(1, 151, 13), (2, 2, 9)] and sum(r.seq == 3 for r in found) == 120
    assert {r.seq: r.redactions for r in run("redact_passwords")} == {1: 1, 2: 1, 3: 120}
    assert {(r.mode, r.status, r.files) for r in run("secure_modes")} == {("report", "flagged", 3), ("redact", "redacted", 3), ("exclude", "excluded", 3)}
    assert {r.seq: r.high for r in run("file_security")} == {1: 1, 2: 1, 3: 120}
    assert len(run("secret_findings")) == 272 and run("security_summary")[0].findings == 272
    assert sum(r.seq == 3 for r in run("interval_overlap")) == 120 * 119 // 2


def test_entropy_of_whole_texts_and_all_lines_of_the_grid(spark, tmp_path):
    docs = [(1, "a" * 300 + "b" * 300), (2, "abc" * 100 + "😀" * 200), (3, "z"), (4, ""), (5, None)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.seq: r.entropy for r in QUERIES["shannon_entropy"](spark, str(tmp_path)).collect()}
    want = {i: -sum(p * math.log2(p) for p in (t.count(c) / len(t) for c in set(t))) for i, t in docs if t}
    assert set(got) == {1, 2, 3} and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    spark.createDataFrame([(1, n, 4, 10 + n) for n in range(1, 8)], "l_suppkey long, l_linenumber long, l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = QUERIES["densify_grid"](spark, str(tmp_path)).collect()
    assert len(cells) == 42 and {r.row: r.value for r in cells if r.col == 5} == {n: 10 + n for n in range(1, 8)}
