"""Checks between the tables of a bundle, one fault at a time."""

import pytest

from sheafline.operators import crosscheck as cc

A, B, C = (f"file_{c * 64}" for c in "abc")
MARK = '<a id="{}"></a>'
PARTS = "bundle_id string, part int, name string, content string, byte_length int, anchors array<string>"
RECORDS = "bundle_id string, file_id string, status string, anchors array<string>, parts array<string>, truncated boolean"
FILES = "bundle_id string, file_id string, path string, included boolean, reason string, text_status string, text_anchors array<string>, text_parts array<string>, text_truncated boolean, pages array<int>, security_status string, security_finding_count int, security_redactions int, security_excluded boolean, security_visual_omitted boolean, security_scan_truncated boolean, security_categories array<string>"
SCANS = "bundle_id string, file_id string, path string, mode string, status string, finding_count int, redactions int, excluded boolean, visual_omitted boolean, scan_truncated boolean, categories array<string>"


def sound():
    parts = [["b", 0, "p1", MARK.format(A) + " text " + MARK.format(B), 0, [A, B]], ["b", 1, "p2", "more " + MARK.format(f"{B}-segment-002"), 0, [f"{B}-segment-002"]]]
    for p in parts:
        p[4] = len(p[3].encode())
    recs = [["b", A, "completed", [A], ["p1"], False], ["b", B, "partial", [B, f"{B}-segment-002"], ["p1", "p2"], True]]
    files = [["b", r[1], f"d/{r[1][-1]}", True, "selected", r[2], r[3], r[4], r[5], [1], "flagged", 2, 0, False, False, False, ["jwt"]] for r in recs]
    files.append(["b", C, "d/c", False, "excluded-secret-policy", "not-applicable", [], [], False, [], "excluded", 1, 0, True, False, False, ["jwt"]])
    scans = [["b", f[1], f[2], "redact", *f[10:]] for f in files]
    return parts, recs, files, scans


def put(table, row, column, value):
    def change(tables):
        tables["parts recs files scans".split().index(table)][row][column] = value

    return change


def also(table, row, **changes):
    def change(tables):
        rows = tables["parts recs files scans".split().index(table)]
        new = list(rows[row])
        for k, v in changes.items():
            new[int(k[1:])] = v
        rows.append(new)

    return change


def drop(table, row):
    return lambda tables: tables["parts recs files scans".split().index(table)].pop(row)


def text(row, new):
    def change(tables):
        tables[0][row][3], tables[0][row][4] = new, len(new.encode())

    return change


FAULTS = [
    (lambda t: None, []),
    (put("parts", 0, 4, 7), [("part-byte-length", "p1")]),
    (text(1, MARK.format(f"{B}-segment-002") + "x" * 1000), [("part-limit", "p2")]),
    (text(1, "none"), [("anchor-occurrence", f"{B}-segment-002")]),
    (text(1, 2 * MARK.format(f"{B}-segment-002")), [("anchor-occurrence", f"{B}-segment-002")]),
    (text(1, MARK.format(f"{B}-segment-002") + MARK.format(A)), [("anchor-foreign", A)]),
    (put("parts", 1, 5, [f"{B}-segment-002", A]), [("anchor-duplicate", A), ("anchor-occurrence", A), ("record-anchor-part", A)]),
    (put("parts", 1, 2, "p1"), [("part-duplicate", "p1"), ("record-part", B)]),
    (also("recs", 0, _1="file_x"), [("record-file", "file_x")]),
    (put("recs", 0, 2, "failed"), [("manifest-status", A)]),
    (put("recs", 0, 3, [B]), [("manifest-anchors", A)]),
    (put("recs", 0, 3, ["file_y"]), [("manifest-anchors", A), ("record-anchor", A)]),
    (put("recs", 1, 4, ["p1"]), [("manifest-parts", B), ("record-anchor-part", B)]),
    (put("recs", 1, 4, ["p1", "p9"]), [("manifest-parts", B), ("record-anchor-part", B), ("record-part", B)]),
    (put("recs", 1, 5, False), [("manifest-truncation", B)]),
    (also("scans", 0), [("security-report-duplicate", A)]),
    (also("scans", 0, _1="file_z"), [("security-report-file", "file_z")]),
    (also("scans", 2, _1="file_z"), [("security-report-file", "file_z")]),
    (drop("scans", 2), [("security-report-missing", C)]),
    (put("scans", 0, 2, "elsewhere"), [("security-report-path", A)]),
    (put("scans", 0, 3, "report"), [("security-report-mode", A)]),
    (put("scans", 0, 4, "clean"), [("security-status", A)]),
    (put("scans", 0, 5, 3), [("security-findings", A)]),
    (put("scans", 0, 6, 3), [("security-redactions", A)]),
    (put("scans", 0, 9, True), [("security-truncated", A)]),
    (put("scans", 0, 10, []), [("security-categories", A)]),
    (put("scans", 0, 8, True), [("security-visual", A), ("security-visual-pages", A)]),
    (put("scans", 0, 7, True), [("security-excluded", A), ("security-exclusion-inclusion", A), ("security-exclusion-markdown", A)]),
    (put("files", 2, 3, True), [("security-exclusion-inclusion", C)]),
]


def test_each_fault_is_reported_alone(spark):
    """All cases are bundles of one table, so the checks run once."""
    tables, want = [[], [], [], []], {}
    for i, (fault, codes) in enumerate(FAULTS):
        own = [[list(r) for r in t] for t in sound()]
        fault(own)
        for t, rows in zip(tables, own, strict=True):
            t.extend([f"case{i:02d}", *r[1:]] for r in rows)
        if codes:
            want[f"case{i:02d}"] = sorted(codes)
    frames = [spark.createDataFrame(t, schema) for t, schema in zip(tables, (PARTS, RECORDS, FILES, SCANS), strict=True)]
    modes = spark.createDataFrame([(f"case{i:02d}", "redact") for i in range(len(FAULTS))], "bundle_id string, mode string")
    got = {}
    for r in cc.bundle(*frames, modes, 500).collect():
        got.setdefault(r.bundle_id, []).append((r.code, r.subject))
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("change, same", [(lambda x: x, True), (lambda x: x[::-1], False), (lambda x: x[:-1], False), (lambda x: [*x, x[-1]], False), (lambda x: [x[1], x[0], *x[2:]], False), (lambda x: [*x[:-1], "new"], False)])
def test_fingerprints_keep_order(spark, change, same):
    items = ["a", "b", "c", "b"]
    table = lambda x: spark.createDataFrame([("g", i, v) for i, v in enumerate(x)], "g string, at int, v string").repartition(3)
    assert cc.list_mismatch(table(items), table(change(items)), "g", "at", "v").isEmpty() == same
