"""The scan for secrets against a loop over the patterns."""

import math
import random
import re

import pytest

from sheafline.operators import security


def loop(path, text, policy):
    """(category, start, end, line, column) as a plain scanner finds them: pattern after pattern, none over an earlier one."""
    found = [("sensitive-filename", None, None, None, None)] if any(re.search(p.replace(r"\z", r"\Z"), path) for p in security.SENSITIVE_FILES) else []
    text = (text or "")[: policy.max_characters]
    free = lambda a, b: all(s is None or b <= s or a >= e for _, s, e, _, _ in found)

    def add(category, a, b):
        if b > a and free(a, b):
            found.append((category, a, b, text.count("\n", 0, a) + 1, a - (text.rfind("\n", 0, a) + 1) + 1))

    for category, _, _, group, pattern, flags in security.PATTERNS:
        for m in re.compile(pattern, re.ASCII | flags).finditer(text):
            add(category, *m.span(group))
    if policy.high_entropy:
        for m in re.finditer(f"[A-Za-z0-9_+/=-]{{{policy.min_length},{policy.max_length}}}", text):
            v = m.group()
            entropy = -sum(p * math.log2(p) for p in (v.count(c) / len(v) for c in set(v)))
            if sum(bool(re.search(c, v)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[_+/=-]")) >= 3 and len(set(v)) >= 12 and entropy >= policy.threshold:
                add("high-entropy", *m.span())
    return found[: policy.max_findings]


def texts(seed, n):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefgXYZ0123456789_-/+=") for _ in range(k))
    makers = [
        lambda: "-----BEGIN RSA PRIVATE KEY-----" + r.choice(["\n", ""]) + word(30) + "\nAKIA" + "A1" * 8 + "\n-----END RSA PRIVATE KEY-----", lambda: "AKIA" + "Z9" * 8, lambda: "ghp_" + word(30).replace("/", "a"),
        lambda: "eyJ" + "a1B2c3D4e5." * 2 + "f6G7h8I9j0", lambda: "postgres://user:" + word(9) + "@host/" + word(5), lambda: r.choice(["password", "API_KEY", "Secret"]) + r.choice([" = ", ":", "=\n"]) + r.choice(["'", '"', ""]) + word(r.randrange(3, 40)),
        lambda: word(r.randrange(20, 700)), lambda: "token: AKIA" + "Q7" * 8, lambda: "é" * r.randrange(5), lambda: "plain words here", lambda: "secret=postgres://a:bcd@h", lambda: "xAKIA" + "A1" * 8, lambda: "\n\n",
    ]
    return ["".join(r.choice(makers)() + r.choice([" ", "\n", "", "; "]) for _ in range(r.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("policy", [security.ScanPolicy(None, None), security.ScanPolicy(3, 400), security.ScanPolicy(None, None, high_entropy=False)])
def test_findings_equal_a_loop(spark, policy):
    rows = [("b", i, r"x/.env" if i % 7 == 0 else "x/key.pem" if i % 11 == 0 else "x/a.txt", t) for i, t in enumerate(texts(5, 240))] + [("b", 900, "n.txt", None), ("c", 1, "e.txt", "")]
    df = spark.createDataFrame(rows, "bundle_id string, seq long, path string, body string").repartition(5)
    got = {}
    found = security.findings(df, policy)
    for x in sorted(found.collect(), key=lambda x: x.ordinal):
        got.setdefault((x.bundle_id, x.seq), []).append((x.category, x.start, x.end, x.line, x.column))
        assert x.finding_id == f"secret-{x.source}-{x.category}-{x.ordinal:03d}" and x.ordinal == len(got[x.bundle_id, x.seq])
    want = {(b, i): loop(p, t, policy) for b, i, p, t in rows}
    assert got == {k: v for k, v in want.items() if v}
    assert {len(v) for v in want.values()} >= ({0, 1, 3} if policy.max_findings else {0, 1, 5})
    for x in security.scan_reports(df, found, policy).collect():
        text = next(t for b, i, _, t in rows if (b, i) == (x.bundle_id, x.seq))
        own = want[x.bundle_id, x.seq]
        cut, full = policy.max_characters is not None and len(text or "") > policy.max_characters, policy.max_findings is not None and len(own) >= policy.max_findings
        assert (x.finding_count, x.scan_truncated, x.categories) == (len(own), cut or full, sorted({f[0] for f in own}))
        assert x.scanned_characters == len((text or "")[: policy.max_characters]) and x.status == ("flagged" if own else "not-scanned" if text is None else "clean")
        assert ("characters-limited" in x.warnings) == cut and ("findings-limited" in x.warnings) == full


def test_summary_with_reports(spark):
    df = spark.createDataFrame([("b", 1, "a", "AKIA" + "A1" * 8), ("b", 2, "b", "clean"), ("b", 3, "c", None), ("d", 1, "x.pem", "AKIA" + "A1" * 8 + " " + "AKIA" + "B2" * 8)], "bundle_id string, seq long, path string, body string")
    policy = security.ScanPolicy(2, None)
    found = security.findings(df, policy)
    got = {x.bundle_id: x for x in security.summary(found, reports=security.scan_reports(df, found, policy)).collect()}
    assert [(x.findings, x.flagged_files, x.cloud_credential, x.scanned_files, x.unscanned_files, x.truncated_scans) for x in (got["b"], got["d"])] == [(1, 1, 1, 2, 1, 0), (2, 1, 1, 1, 0, 1)]


def test_many_findings_in_one_long_text(spark):
    """Places stay right far into a text, and a long text costs no more than its length."""
    text = "".join(f"line {i}\npassword = 'value{i:06d}' AKIA{i:016d}\n" for i in range(20_000))
    df = spark.createDataFrame([("b", 1, "a", text)], "bundle_id string, seq long, path string, body string")
    rows = security.findings(df, security.ScanPolicy(None, None, high_entropy=False)).select("start", "end", "line", "category").collect()
    assert len(rows) == 40_000
    for x in rows[:: 997]:
        assert text[x.start : x.end].startswith("AKIA" if x.category == "cloud-credential" else "value") and x.line == text.count("\n", 0, x.start) + 1
