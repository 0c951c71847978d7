"""Piece encoding, filter audit and source divergence against the library and brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from sheafline.llm import divergence, filter_audit, pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as f:
        return pieces.Pieces(f.read())


def as_ids(ids):
    return np.array(ids, "<u4").tobytes()


def test_pieces_equal_the_library(docs, plain, empty, library):
    for r in pieces.piece_round_trip(docs, pieces.default_model()).collect():
        want = library.encode(plain[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded) == (as_ids(want), len(want), library.decode(want))
    out = pieces.piece_round_trip(docs.withColumnRenamed("doc_id", "a.b"), pieces.default_model(), "a.b")
    assert out.columns[0] == "a.b" and out.count() == docs.count()
    assert pieces.piece_round_trip(empty, pieces.default_model()).count() == 0


def test_pieces_of_odd_texts(library, model):
    r = random.Random(4)
    kinds = [
        lambda: "".join(r.choice(model.tokens) for _ in range(r.randrange(1, 12))),
        lambda: "".join(chr(r.choice([r.randrange(1, 127), r.randrange(160, 0x2FFF), r.randrange(0x4E00, 0x5000), r.randrange(0x1F300, 0x1F6FF)])) for _ in range(40)),
        lambda: "".join(r.choice(" abeinrst\n\t▁_.") for _ in range(60)),
        lambda: "".join(r.choice("eaointrsh") for _ in range(60)),
    ]
    texts = ["", " ", "▁", "   ", "\n", "<s>", "<0x41>", "x" * 20_000, " " * 5_000, "the " * 60_000] + [kinds[i % 4]() for i in range(1200)]
    for text in texts:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = model.encode(text)
        assert got == as_ids(want), text[:80]
        assert model.decode(got) == library.decode(want)
    for _ in range(800):
        ids = [r.choice([r.randrange(32000), r.randrange(262), r.choice([0, 1, 2, 259])]) for _ in range(r.randrange(9))]
        assert model.decode(as_ids(ids)) == library.decode(ids), ids


def test_tokens_fit_as_the_library_says(library, model):
    """The border test alone: two tokens fit if their letters in one line are encoded as these two."""
    r, size, seen = random.Random(6), len(model.tokens), Counter()
    common = [i for i in range(259, 3000)]
    for _ in range(4000):
        a, b = r.choice(common), r.choice(common)
        if model.tokens[a][0] != pieces.SPACE or not model.fits[size * size + a] or not model.fits[size * size + b]:
            continue
        want = library.encode((model.tokens[a] + model.tokens[b])[1:].replace(pieces.SPACE, " ")) == [a, b]
        assert model.fits[a * size + b] == want
        seen[want] += 1
    assert seen[True] > 50 and seen[False] > 50


def test_models_of_other_kinds_are_refused():
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Pieces(b"\x12\x02\x18\x01")


def judged(rows, labels):
    """Mask letters of each row, by the letter of the definitions."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and i > least[t])
        good, toxic = (any(x[0] == i is not None and x[k] == 1 for x in labels) for k in (1, 2))
        yield lang or "", set(fails), good, toxic


def brute_audit(rows, labels):
    out, shapley = defaultdict(Counter), Counter()
    every = list(judged(rows, labels))
    for order in map("".join, permutations("ABCDE")):
        for part, fails, good, toxic in every:
            gone = False
            for step, f in enumerate(order, 1):
                own = out[part, order, step]
                bad = f in fails
                own["removed"] += bad and not gone
                own["redundant"] += bad and gone
                own["unique_fails"] += fails == {f}
                own["good_lost"] += bad and not gone and good
                own["toxic_lost"] += bad and not gone and toxic
                shapley[part, f] += bad and not gone
                gone |= bad
                own["kept"] += not gone
    return {(p, o, s): tuple(c[k] for k in list(filter_audit.PRODUCTS)[:-1]) + (shapley[p, o[s - 1]],) for (p, o, s), c in out.items()}


def test_filter_audit_equals_brute_force(spark, plain):
    r = random.Random(9)
    texts = [t for t in plain.values()] + ["ABC " * 120, " ".join(f"w{i}" for i in range(150)), " ".join(f"W{i}" for i in range(150)), "x# " + " ".join(f"w{i}" for i in range(150)), " ".join(f"v{i}" for i in range(50_000))]
    rows = [(i, t, r.choice(["en", "de", None, ""])) for i, t in enumerate(texts)] + [(500 + i, texts[-2], "en") for i in range(40)]
    rows += [(None, texts[-2], "en"), (None, None, None), (7, plain[7], "fr"), (1000, texts[-1], "en"), (1000, texts[-1], "xx"), (1001, texts[-1], "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 540, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, lang string, part string, mask int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): tuple(x[c] for c in filter_audit.PRODUCTS) for x in filter_audit.filter_audit(docs, marks).collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0
    odd = docs.withColumnsRenamed({"doc_id": "a.b", "text": "the text", "lang": "x.y"})
    assert filter_audit.filter_audit(odd, marks.limit(0), "a.b", "the text", "x.y").count() == 600 * len({x[2] or "" for x in rows})


def brute_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in m) for m in term.findall(text or ""))
        counts[lang, source] += own
        documents[lang].update(own.keys())
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in documents[lang].items() if d >= least]
        total = lambda c: sum(c[t] for t in kept)
        p_of = lambda c, t: 1 + 10**9 * (c[t] + 2) // (total(c) + 2 * len(kept))
        whole = sum((counts[lang, s] for s in sources), Counter())
        table = {s: {t: p_of(counts[lang, s], t) for t in kept} for s in sources}
        q = {t: p_of(whole, t) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(table[s][t], table[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((-f(table[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and table[s][t] > q[t])[:top]
            out |= {(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found, 1)}
    return out


def test_divergence_equals_brute_force(spark, plain):
    r = random.Random(3)
    vocab = ["the", "The", "Straße", "日本", "ÉTÉ", "x", "don't", "a1b", "word", "Über"] + [chr(97 + i) * 3 for i in range(20)]
    rows = [(" ".join(r.choice(vocab) for _ in range(r.randrange(60))), r.choice(["en", "en", "de", None]), r.choice(["s1", "s2", "s3", "ß", None, ""])) for _ in range(160)]
    rows += [(t, "en", "s1") for t in plain.values()] + [(None, "en", "only nulls"), ("12 !", "xx", "b"), ("rare", "xx", "a"), ("the", "zz", "alone")] + [("word " * 400_000, "en", "s2")] + rows[:20]
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows], "text string, lang string, source string, term string, n int").repartition(4)
    got = [tuple(x[c] for c in ("lang", "source", "part", "item", "value", "rank")) for x in divergence.divergence(df).collect()]
    want = brute_divergence(rows, divergence.LEAST_DOCUMENTS, divergence.TOP)
    assert set(got) == want and len(got) == len(want)
    assert {x[4] for x in got if x[0] == "xx"} == {0}
    assert divergence.divergence(df.limit(0)).count() == 0


def test_divergence_in_small_pieces(spark, monkeypatch):
    """Texts in stretches, counts sent early and pairs in chunks give the same."""
    text = "one two, three " * 50 + "ÄÖ"
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "STRETCH", 7)
    assert divergence.term_counts(text) == whole == Counter({b"one": 50, b"two": 50, b"three": 50, "ÄÖ".encode(): 1})
    monkeypatch.setattr(divergence, "PAIRS", 3)
    sizes = np.array([1, 4, 2, 1, 5])
    got = sorted((int(a), int(b)) for i, j in divergence._pairs_of(sizes) for a, b in zip(i, j, strict=True))
    ends = np.cumsum(sizes)
    assert got == [(a, b) for e, n in zip(ends, sizes, strict=True) for a in range(e - n, e) for b in range(a + 1, e)]
