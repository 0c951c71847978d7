"""Operators that work row by row: encoding, decontamination, quality rules, archives."""

import hashlib
import re
import random

import pytest

from sheafline.llm import bpe, decontaminate, quality, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_bpe_equals_the_library(docs, plain):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_tokenizer()
    lib = tokenizers.Tokenizer.from_file(path)
    for r in bpe.bpe_round_trip(docs, path).collect():
        want = lib.encode(plain[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == b"".join(i.to_bytes(4, "little") for i in want)
        assert r.n_tokens == len(want)
        assert r.decoded == (plain[r.doc_id] or "")


def test_bpe_special_and_odd_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    r = random.Random(4)
    rows = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "  \n\n x\r\n\ty ", "  x", "aaaa" * 5000, "１２３ ١٢", "é" * 50, "'ll 's 'T", "\x00\x1f"]
    rows += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F6FF)])) for _ in range(80)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for x in bpe.bpe_round_trip(df, bpe.default_tokenizer()).collect():
        want = lib.encode(rows[x.doc_id], add_special_tokens=False).ids
        assert x.ids == b"".join(i.to_bytes(4, "little") for i in want), rows[x.doc_id]
        assert x.decoded == lib.decode(want, skip_special_tokens=False) == rows[x.doc_id]


def low_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(words, items):
    hit, found = set(), set()
    for item, text in items:
        w = low_words(text)
        for win in {tuple(w[i : i + 10]) for i in range(len(w) - 9)} or ({tuple(w)} if w else set()):
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
    return hit, found


@pytest.mark.parametrize("block_words", [200_000, 5])
def test_contamination_equals_brute_force(spark, docs, plain, block_words):
    r = random.Random(2)
    source = [t for t in plain.values() if t and len(t.split()) > 30]
    items = [(i, " ".join(t.split()[5 : 5 + r.choice([3, 9, 10, 11, 25])])) for i, t in enumerate(source[:14])]
    items += [(90, None), (91, ""), (92, "... !"), (93, items[0][1]), (94, "the"), (95, "nothing like this anywhere at all in any of the texts here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for x in decontaminate.contamination(docs, bench, block_words=block_words).collect():
        words = low_words(plain[x.doc_id])
        hit, found = brute_hits(words, items)
        assert x.n_words == len(words)
        assert {i for s in x.spans for i in range(s.start, s.end)} == hit
        assert x["items"] == sorted(map(str, found))


def test_null_items_and_odd_columns(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(None, passage), (2, passage)], "item_id long, text string")
    df = spark.createDataFrame([(1, passage + " and " * 20, 3, "x"), (None, None, None, None)], "`my id` long, `the text` string, `a.b-c` long, n_words string")
    got = {r[0]: (r.n_words, r["items"]) for r in decontaminate.contamination(df, bench, id_col="my id", text_col="the text").collect()}
    assert got == {1: (30, ["2", None]), None: (0, [])}
    out = decontaminate.decontaminate(df, bench, text_col="the text")
    assert out.columns == df.columns and {r[0]: r[3] for r in out.collect()} == {1: "x", None: None}
    kept = quality.keep_good(df, "base", "the text")
    assert kept.columns == df.columns and kept.count() == 0  # too many repeated words, too few words


def test_decontaminate_cuts_spans_and_keeps_columns(spark, docs, empty, plain):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    more = spark.createDataFrame([(1000, "Left " * 20 + passage.upper().replace(" ", ", ") + "! right", "en", "s", 0, "x"), (1001, passage, "en", "s", 0, "x")], docs.schema)
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs.unionByName(more), bench).collect()}
    assert 1001 not in out
    assert out[1000].text == "Left " * 20 + "! right" and out[1000].n_chars == len(out[1000].text)
    assert {k: out[k].text for k in plain} == plain
    assert decontaminate.decontaminate(empty, bench).columns == docs.columns
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_quality_equals_brute_force(docs, plain):
    for x in quality.ledger(docs).collect():
        t = plain[x.doc_id] or ""
        w = WORD.findall(t)
        lines = [y for y in t.split("\n") if WORD.search(y)]
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        inside = {j for i, k in enumerate(wins) if wins.count(k) > 1 for j in range(i, i + 8)}
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert bool(x.fail_bits & quality.mask("base")) == (len(w) < 20 or 100 * len(inside) > 30 * len(w))


def test_quality_policies_and_ablation(docs, empty):
    led = quality.ledger(docs).cache()
    bits = [r.fail_bits for r in led.collect()]
    m = quality.mask("v1")
    got = {r.rule: r for r in quality.ablation(led, "v1").collect()}
    for rule in quality.RULES:
        if rule.name in quality.POLICIES["v1"]:
            b = 1 << rule.bit
            assert got[rule.name].n_kept_without == sum(not x & m & ~b for x in bits)
            assert got[rule.name].n_fail == sum(bool(x & b) for x in bits)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(not x & m for x in bits)
    assert quality.ledger(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_warc_round_trip(spark):
    big, small = "é" * 600, "<p>x</p>"
    rows = [(1, "u1", big), (2, "u2", small), (3, "u3", big), (4, None, None), (5, "u5", small), (6, "u6", ""), (7, "u\r\n7", big), (8, "u8", "y" * 1000), (9, "u9", "y" * 1000), (10, "u10", "z" * 999), (11, "u11", "z" * 999)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    bundles = warc.write_bundles(warc.with_revisits(pages), bundle_bytes=200)
    got = {r.page_id: r for r in warc.read_records(bundles).collect()}
    assert len(got) == len(rows)
    want = {1: 7, 3: 7, 8: 9}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha1(raw).hexdigest()
        assert got[i].refers_to == want.get(i) and got[i].record_type == ("revisit" if i in want else "response")
        assert got[i].block == (b"" if i in want else raw)
    found = warc.read_at(bundles, warc.index(bundles).filter("page_id in (2, 7)")).collect()
    assert {r.page_id: bytes(r.block) for r in found} == {2: small.encode(), 7: big.encode()}
    places = warc.index(bundles).collect()
    frames = {}
    for r in places:
        frames.setdefault((r.bundle, r.frame), []).append(r)
    assert len(places) == len(rows) and max(map(len, frames.values())) > 1  # several records share a frame
    for own in frames.values():
        own.sort(key=lambda r: r.inner)
        assert [r.inner for r in own] == [sum(x.size for x in own[:i]) for i in range(len(own))] and sum(r.size for r in own) == own[0].raw_length
    lost = spark.createDataFrame([(None, "u", big), (None, None, small), (3, "u", big)], "page_id long, url string, html string")
    got = warc.read_records(warc.write_bundles(warc.with_revisits(lost), frame_bytes=1)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.payload_bytes) for r in got) == [(0, "response", 8), (0, "response", 1200), (3, "response", 1200)]
    assert warc.read_records(warc.write_bundles(warc.with_revisits(pages.limit(0)))).count() == 0
