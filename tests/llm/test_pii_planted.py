"""Surrogates in texts whose entities are known: each is replaced whole, by one of its type, and nothing else changes."""

import random
import re

import pytest

from sheafline.llm import pii


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def rest_97(iban):
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def valid_iban(r):
    body = "".join(r.choice("0123456789ABCDEFGH") for _ in range(18))
    return f"GB{98 - rest_97('GB00' + body):02d}{body}"


ENTITIES = {
    "email": (lambda r: r.choice(["ann.lee", "müller", "Жанна.к", "x+y"]) + str(r.randrange(99)) + "@mail.example.org", lambda v, w: re.fullmatch(r"\S+@\S+\.example", w) and len(w.partition("@")[0]) == len(v.partition("@")[0])),
    "ip": (lambda r: ".".join(str(r.randrange(1, 255)) for _ in range(4)), lambda v, w: re.fullmatch(r"(\d+\.){3}\d+", w)),
    "ipv6": (lambda r: r.choice(["fe80::1ff:fe23:4567:890a", "2001:db8:85a3:8d3:1319:8a2e:370:7348", "2001:db8::ff00:42:8329", "fe80::1"])[:-1] + r.choice("0123456789"), lambda v, w: re.sub("[0-9a-f]", "x", v) == re.sub("[0-9a-f]", "x", w)),
    "ssn": (lambda r: f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", lambda v, w: re.fullmatch(r"\d{3}-\d\d-\d{4}", w)),
    "phone": (lambda r: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", lambda v, w: re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", w)),
    "card": (lambda r: next(c for c in iter(lambda: "4" + "".join(r.choice("0123456789") for _ in range(15)), None) if luhn(c) == 0), lambda v, w: w[0] == "4" and len(w) == 16 and luhn(w) == 0),
    "iban": (valid_iban, lambda v, w: w.startswith("GB") and len(w) == 22 and rest_97(w) == 1),
    "cloud_key": (lambda r: "AKIA" + "".join(r.choice("ABCDEFGHXYZ0123456789") for _ in range(16)), lambda v, w: re.fullmatch("AKIA[0-9A-Z]{16}", w)),
}
PLAIN = ["The quick brown fox ", "version 1.2.3.4.5, ", "ratio 3.14; ", "12:30:45 o'clock ", "std::vector<int> ", "C3PO and R2D2. ", "Über Straße, ", "a@b, ", "номер один ", "Brown Bear and John ", "2024-01-02 ", "(see page 7) ", "::before "]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_entities(spark, seed):
    r = random.Random(seed)
    pool = {k: [make(r) for _ in range(12)] for k, (make, _) in ENTITIES.items()}
    rows, truth = [], {}
    for i in range(120):
        pieces = []
        for _ in range(r.randrange(6)):
            kind = r.choice(list(pool))
            pieces += [(None, r.choice(PLAIN)), (kind, r.choice(pool[kind])), (None, r.choice([", ", "; ", " and ", "\nso "]))]
        pieces.append((None, r.choice(PLAIN)))
        truth[i] = pieces
        rows.append((i, "".join(v for _, v in pieces)))
    got = {x.doc_id: x for x in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "key").collect()}
    new: dict = {}
    for i, pieces in truth.items():
        pattern = "".join(re.escape(v) if k is None else r"(\S+(?: \(\d{3}\) \d{3}-\d{4})?)" for k, v in pieces)
        m = re.fullmatch(pattern, got[i].text)
        assert m, (rows[i][1], got[i].text)  # what is no entity stays as it is
        planted = [(k, v) for k, v in pieces if k]
        assert got[i].n_entities == len(planted)
        for (kind, value), w in zip(planted, m.groups(), strict=True):
            assert ENTITIES[kind][1](value, w), (kind, value, w)
            assert new.setdefault((kind, value), w) == w  # alike everywhere
    assert len(set(new.values())) == len(new) and not set(new.values()) & {v for _, v in new}


def test_names(spark):
    rows = [
        (1, "Dr. Anna Smith met Mrs. Anna Smith; Anna Smith left. John Smith stayed, and The Anna Smith Prize."), (2, "Mr. John Smith wrote. Then John Smith and Anna Smith slept; Smith Brown too."), (3, "Anna Smith and John Smith have no title here."),
        (None, "Mr. Lone Wolf called Lone Wolf"), (None, "Mr. Other Man"), (4, "Prof. Quentin Vale knows Quentin Vale."), (5, "Mr. Anna Berg"),
    ]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    text = {r.doc_id: r.text for r in out if r.doc_id}
    m = re.fullmatch(r"Dr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); (\w+) (\w+) left\. John Smith stayed, and The (\w+) (\w+) Prize\.", text[1])
    assert m and len({m[1], m[3], m[5], m[7]}) == 1 and len({m[2], m[4], m[6], m[8]}) == 1 and m[1] != "Anna" and m[2] != "Smith"
    n = re.fullmatch(r"Mr\. (\w+) (\w+) wrote\. Then (\w+) (\w+) and Anna Smith slept; Smith Brown too\.", text[2])
    assert n and n[1] == n[3] and n[2] == n[4] == m[2]
    assert text[3] == rows[2][1]
    q = re.fullmatch(r"Prof\. (\w+) (\w+) knows (\w+) (\w+)\.", text[4])
    assert q and (q[1], q[2]) == (q[3], q[4]) and q[1] != "Quentin"
    lost = [r.text for r in out if r.doc_id is None]
    assert len(lost) == 2 and not any(x in t for t in lost for x in ("Lone", "Wolf", "Other", "Man "))


def sent_rows(df):
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


def test_texts_without_finds_are_not_shuffled(spark):
    rows = [(i, f"plain text {i} of Some Body" if i % 50 else f"Mr. Nick{chr(97 + i // 50)}y Berg wrote {i}@mail.org") for i in range(1000)]
    rows += [(None, None), (None, "plain"), (None, "Mrs. Lone Wolf"), (None, "plain"), (1, None), (2, "")]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "k")
    got = out.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got if not r.n_entities) == sorted((i or -1, t or "") for i, t in rows if not re.search("Mrs?[.]", t or ""))
    assert len(got) == len(rows) and sum(r.n_entities for r in got) == 20 * 3 + 2
    assert sent_rows(out) and sum(sent_rows(out)) < 500


def test_rows_that_share_an_id_share_their_names(spark):
    person, full = "Mr. John Smith wrote.", "John Smith slept; Some Body too."
    rows = [(1, person), (1, full), (1, full), (1, None), (1, ""), (2, full), (3, "to a.b@mail.org"), (3, full), (None, person), (None, full)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            out = [tuple(r) for r in pii.pseudonymise(df, "k").collect()]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        first = next(t for i, t, _ in out if i == 1 and t and t.startswith("Mr."))
        given, last = re.fullmatch(r"Mr\. (\w+) (\w+) wrote\.", first).groups()
        assert (given, last) != ("John", "Smith")
        want = [(1, first, 2), (1, f"{given} {last} slept; Some Body too.", 0), (1, f"{given} {last} slept; Some Body too.", 0), (1, None, 0), (1, "", 0), (2, full, 0), (3, full, 0), (None, first, 2), (None, full, 0)]
        key = lambda r: (r[0] or 0, r[1] or "", r[2])
        assert sorted((r for r in out if r[0] != 3 or not r[2]), key=key) == sorted(want, key=key)


def test_texts_are_not_searched_again_for_each_piece(spark):
    rows = [(1, "Mr. John Smith, token=abcdef99 and a.b@mail.org; 10.0.0.1"), (1, None), (1, "John Smith"), (None, None), (None, ""), (2, "nothing")]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(c1#" in plan and "regexp_extract_all(c1#" not in plan
    assert sorted(r.n_entities for r in out.collect()) == [0, 0, 0, 0, 0, 5]
