"""The class model: the base against brute force, probabilities that sum to one, and held-out accuracy."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sheafline.llm import brown
from sheafline.llm.packed import unpack


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_equals_brute_force(docs, plain):
    model, words = brown.train(docs.select("doc_id", "text").filter(~brown.held_out("doc_id")), head=12, classes=6, rounds=2)
    train = {d: t for d, t in plain.items() if zlib.crc32(str(d).encode()) % 10}
    count = collections.Counter(w for t in train.values() for w in tokens(t))
    total, types = sum(count.values()), len(count)
    assert (model.total, model.types) == (total, types)
    rows = brown.score_texts(docs, model, words).collect()
    assert len(rows) == len(plain)
    for r in rows:
        own = tokens(plain[r.doc_id])
        want = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in own)
        assert r.n_tokens == len(own) and r.n_known == sum(w in count for w in own)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        assert r.score < 0


def word_hash(word):
    return brown.END if word is None else brown.tokens_in(pa.array([word]))[0][0]


def test_scores_equal_brute_force_and_sum_to_one(docs, plain):
    model, words = brown.train(docs.select("doc_id", "text"), head=12, classes=6, rounds=2)
    count = collections.Counter(w for t in plain.values() for w in tokens(t))
    rare = {}
    for r in words.collect():
        rare |= {h: (n, c) for h, n, c in zip(*(c.tolist() for c in unpack(r["data"])[0]), strict=True)}
    of, size, types = {}, np.zeros(6), np.zeros(6)
    heads = {int(h): i for i, h in enumerate(model.heads.hashes[:-1].tolist())}
    for w, n in count.items():
        h = int(word_hash(w))
        c = int(model.of[heads[h]]) if h in heads else rare[h][1]
        assert h in heads or rare[h][0] == n
        of[w] = c
        size[c] += n
        types[c] += 1
    steps = np.zeros((7, 6))
    for t in plain.values():
        own = tokens(t)
        for a, b in zip([None, *own], own):
            steps[of[a] if int(word_hash(a)) in heads else 6, of[b]] += 1
    chance = (steps + 0.1) / (steps + 0.1).sum(1, keepdims=True)
    inside = {w: (n + 0.1) / (size[of[w]] + 0.1 * (types[of[w]] + 1)) for w, n in count.items()}
    unseen = 0.1 / (size + 0.1 * (types + 1))
    for h in range(7):  # all words and one unseen
        assert math.isclose(sum(chance[h, of[w]] * p for w, p in inside.items()) + (chance[h] * unseen).sum(), 1, rel_tol=1e-9)
    for r in brown.score_texts(docs, model, words).collect():
        own = tokens(plain[r.doc_id])
        want = sum(math.log10(chance[of[a] if int(word_hash(a)) in heads else 6, of[b]] * inside[b]) for a, b in zip([None, *own], own))
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_gains_equal_the_change_of_the_likelihood(docs):
    rng = np.random.default_rng(1)
    words = rng.integers(0, 9, 300)
    of = rng.integers(0, 4, 9)

    def table(of):
        out = np.zeros((5, 5))
        np.add.at(out, (of[words[:-1]], of[words[1:]]), 1)
        return out

    counts = table(of)
    for w in range(9):
        right, left = (np.bincount(of[b[(a == w) & (b != w)]], minlength=5).astype(float) for a, b in ((words[:-1], words[1:]), (words[1:], words[:-1])))
        alone = float(((words[:-1] == w) & (words[1:] == w)).sum())
        got = brown.gains(int(of[w]), right, left, alone, counts)
        for c in range(5):
            moved = of.copy()
            moved[w] = c
            assert math.isclose(got[c], brown.likelihood(table(moved)) - brown.likelihood(counts), abs_tol=1e-6)


def test_likelihood_never_falls(docs):
    model, _ = brown.train(docs.select("doc_id", "text"), head=40, classes=6, rounds=8)
    assert len(model.history) > 2 and all(b >= a for a, b in zip(model.history, model.history[1:])) and model.history[-1] > model.history[0]


def test_classes_beat_the_base_on_held_out_texts(spark):
    rng = np.random.default_rng(3)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "abc"]  # words follow words of the next kind
    texts = [" ".join(kinds[(s + i) % 3][min(39, int(rng.exponential(8)))] for i in range(60)) for s in rng.integers(0, 3, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, words = brown.train(df.filter(~brown.held_out("doc_id")), head=100, classes=8, rounds=12)
    scored = brown.score_texts(df.filter(brown.held_out("doc_id")), model, words)
    r = scored.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > 0.85 * r.b and brown.perplexity(scored) < brown.perplexity(scored, "base_score")


def test_edge_cases(spark, empty):
    model, words = brown.train(empty.select("doc_id", "text"), head=4, classes=3, rounds=1)
    df = spark.createDataFrame([(None, None), (1, ""), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = sorted((r.n_tokens, r.n_known) for r in brown.score_texts(df, model, words).collect())
    assert got == [(1, 0), (1, 0), (3, 0), (3, 0)]
    assert brown.score_texts(empty, model, words).count() == 0
