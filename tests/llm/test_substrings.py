"""Substring removal by words and by bytes against brute force."""

import random
import re

import numpy as np
import pytest

from sheafline.llm import suffix_dedup as sd
from sheafline.llm import substring_dedup as wd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(plain, window):
    words = {d: WORD.findall(t or "") for d, t in plain.items()}
    seen, gone = set(), {d: set() for d in plain}
    for d in sorted(plain):
        for i in range(len(words[d]) - window + 1):
            gram = tuple(words[d][i : i + window])
            if gram in seen:
                gone[d] |= set(range(i, i + window))
            seen.add(gram)
    return {d: (len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in words.items()}


def brute_bytes(plain, window):
    first, out = {}, {}
    for d in sorted(plain):
        raw = (plain[d] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            if first.setdefault(raw[i : i + window], d) < d:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def test_words_equal_brute_force(docs, plain):
    want = brute_words(plain, 20)
    rows = wd.substring_dedup(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == want and len(rows) == len(want)
    words = {d: WORD.findall(t or "") for d, t in plain.items()}
    for r in rows:
        for s in r.removed:
            assert (s.source, s.source_start) < (r.doc_id, s.start)
            assert words[s.source][s.source_start : s.source_start + 20] == words[r.doc_id][s.start : s.start + 20]


def test_words_with_small_windows(spark):
    r = random.Random(5)
    plain = {i: " ".join(r.choice("ab") for _ in range(r.randrange(60))) for i in range(40)}
    df = spark.createDataFrame(list(plain.items()), "doc_id long, text string")
    rows = wd.substring_dedup(df, window=7, anchor=3).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in rows} == brute_words(plain, 7)


def test_words_with_repeated_rows_and_null_ids(spark, empty):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (9, text), (None, "x " * 19)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in wd.substring_dedup(df).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (9, 30)]
    assert wd.substring_dedup(empty).count() == 0 and sd.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("together", [64, 1])
def test_bytes_equal_brute_force(docs, plain, together):
    rows = sd.suffix_dedup(docs, together=together).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in rows} == brute_bytes(plain, 50) and len(rows) == len(plain)


def test_bytes_with_periodic_texts(spark):
    r = random.Random(6)
    plain = {i: "".join(r.choice(["ab", "ab", "b", "é"]) for _ in range(r.randrange(200))) for i in range(50)} | {60: "ab" * 300, 61: "ab" * 100, 62: None, 63: "b" * 49, 64: "b" * 50, 65: "b" * 51}
    df = spark.createDataFrame(list(plain.items()), "doc_id long, text string")
    rows = sd.suffix_dedup(df).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, len(x.removed), bytes(x.kept)) for x in rows} == brute_bytes(plain, 50)
    rows = sd.suffix_dedup(df.union(spark.createDataFrame([(None, "ab" * 300)], df.schema))).collect()
    assert {x.doc_id: x.n_removed for x in rows if x.doc_id is None} == {None: 0}


def test_index_finds_all_long_matches():
    r = random.Random(7)
    for _ in range(60):
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(1, 12))]
        docs = np.array([r.randrange(5) for _ in pieces])
        window = r.randrange(2, 6)
        got = {(i, a + x) for i, a, n in zip(*(c.tolist() for c in sd.late_windows(pieces, docs, window)), strict=True) for x in range(n)}
        assert got == {(i, a) for i in range(len(pieces)) for a in range(len(pieces[i]) - window + 1) if any(docs[j] < docs[i] and pieces[i][a : a + window] in p for j, p in enumerate(pieces))}


@pytest.mark.parametrize("together", [2, 3, 8])
def test_bytes_by_longer_anchors_equal_brute_force(docs, plain, together):
    rows = sd.suffix_dedup(docs, together=together).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in rows} == brute_bytes(plain, 50) and len(rows) == len(plain)


def test_frequent_anchor_goes_by_longer_anchors(spark):
    """100 texts have one anchor, pairs share 10 bytes before and 20 behind it: a text sends a piece or two, not single windows."""
    r = random.Random(8)
    some = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    anchor = min((some(17) for _ in range(20_000)), key=lambda a: sd._grams(np.frombuffer(a.encode(), np.uint8))[0])
    around = [(some(10), some(20)) for _ in range(50)]
    df = spark.createDataFrame([(i, some(60) + around[i % 50][0] + anchor + around[i % 50][1] + some(60)) for i in range(100)], "doc long, text string")
    found = sd.located(df, sd._tokenise, 50, sd.ANCHOR, False, sd.TOGETHER)
    asked = sd.by_doc(found.filter(f"kind = {sd.PIECE}"), 4, sd.PIECES)
    sent = df.join(asked, "doc").select("doc", "text", "data").mapInArrow(sd._cut(50, 4, sd.TOGETHER), sd.SCHEMA).collect()
    assert sum(len(sd.unpack(x.data)[0][0]) for x in sent) <= 200
    rows = sd.suffix_dedup(df, id_col="doc").collect()
    assert {x.doc: (x.n_bytes, x.n_removed, len(x.removed), bytes(x.kept)) for x in rows} == brute_bytes({x.doc: x.text for x in df.collect()}, 50)


def test_windows_of_one_document_need_no_index(monkeypatch):
    """Single windows of frequent anchors are indexed only if a second document has them."""
    r = np.random.default_rng(9)
    pieces = [r.integers(97, 123, 50, np.uint8).tobytes() for _ in range(300)]
    indexed = []
    monkeypatch.setattr(sd, "late_windows", lambda p, docs, window, real=sd.late_windows: indexed.extend(p) or real(p, docs, window))
    of = np.append(np.arange(300), 7)  # document 300 has window 7 once more
    batch = sd.dealt(np.zeros(301, np.int64), sd.RECORD, [of.astype(np.uint64), np.arange(301), np.zeros(301, np.int64), np.full(301, 50)], 1, [pieces[i] for i in of])
    late = list(sd._indexed(50, 1)({sd.RECORD: batch.column(2).to_pylist()}))
    assert [c[:3] for c in ([x.tolist() for x in sd.unpack(b.column(2)[0].as_py())[0]] for b in late)] == [[[300], [0], [1]]]
    assert indexed == [pieces[7]] * 2
