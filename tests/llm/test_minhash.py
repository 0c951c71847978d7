"""Near duplicates against all pairs."""

import random
import re

import pytest

from sheafline.llm import minhash as mh


def brute(plain, shingle, percent):
    sets = {}
    for d, t in plain.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    label = {d: d for d in plain}
    links = [(a, b) for a in plain for b in plain if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {d: (len(sets[d]), label[d]) for d in plain}


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, shingle, percent):
    r = random.Random(shingle)
    bases = [[f"w{r.randrange(300)}" for _ in range(r.randrange(40, 150))] for _ in range(4)]
    texts = [None, "", "  ", "one", "ONE", "one two", "one two three", "One two\tthree"]
    texts += [edited(r, r.choice(bases), r.randrange(9)) for _ in range(160)]
    chain = bases[0]
    for _ in range(25):  # links from copy to copy, not with the first
        chain = edited(r, chain, 1).split()
        texts.append(" ".join(chain))
    ids = r.sample(range(1000), len(texts))
    plain = dict(zip(ids, texts, strict=True))
    df = spark.createDataFrame(list(plain.items()), "doc_id long, text string").repartition(3)
    rows = mh.minhash_dedup(df, shingle, percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == brute(plain, shingle, percent) and len(rows) == len(plain)


def test_edge_cases(spark, docs, empty, plain):
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in mh.minhash_dedup(docs).collect()} == brute(plain, 3, 85)
    assert mh.minhash_dedup(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (7, "a b c d"), (8, None)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id) for x in mh.minhash_dedup(df).collect())
    assert got == [(0, 2, None), (3, 2, 3), (3, 2, 3), (7, 2, 3), (8, 0, 8)]
    kept = mh.keep_one(df, 5, 80)
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["3", "3", "8", "None"] and kept.columns == df.columns


def test_loose_copies_of_one_text_are_not_all_paired(spark):
    """40 texts lack other words of one text and share 17 words that it lacks; a 41st is near to the first of them."""
    r = random.Random(3)
    base = [f"p{i}" for i in range(400)]
    plain = {0: base}
    for i in range(1, 41):
        gone = set(r.sample(base, 60))
        plain[i] = [w for w in base if w not in gone] + [f"s{k}" for k in range(17)] + [f"d{i}x{k}" for k in range(43)]
    plain[41] = plain[1][:-5] + [f"e{k}" for k in range(5)]
    texts = spark.createDataFrame([(d, " ".join(w)) for d, w in plain.items()], "doc long, text string")
    stars = mh.compared(spark.createDataFrame([(d, 0) for d in range(1, 42)], "a long, b long"), texts, 1)
    assert stars.filter(mh.similar(80)).isEmpty()
    found = spark.createDataFrame([], "doc long, component long")
    pairs = {(p.a, p.b) for p in mh._rest(stars, found, texts, 1, 80)[0].collect()}
    links = {d for d, (_, label) in brute({d: " ".join(w) for d, w in plain.items()}, 1, 80).items() if d != label}
    assert links == {41} and (41, 1) in pairs and len(pairs) < 82
