"""Id columns with dots and columns with the names of working ones."""

import pytest
from pyspark.sql import functions as F

from sheafline.llm import bpe, decontaminate, line_dedup, minhash, pieces, pii, quality, substring_dedup, suffix_dedup

OPERATORS = {
    "substring_dedup": lambda d, **k: substring_dedup.substring_dedup(d, 5, 3, **k),
    "suffix_dedup": lambda d, **k: suffix_dedup.suffix_dedup(d, **k),
    "bpe": lambda d, **k: bpe.bpe_round_trip(d, bpe.default_tokenizer(), **k),
    "pieces": lambda d, **k: pieces.piece_round_trip(d, pieces.default_model(), **k),
    "line_dedup": lambda d, **k: line_dedup.line_dedup(d, **k),
    "minhash": lambda d, **k: minhash.minhash_dedup(d, **k),
    "pii": lambda d, **k: pii.pseudonymise(d, "k", **k),
    "quality": lambda d, **k: quality.ledger(d, **k),
}
TEXTS = ["Mail ann.lee@mail.org and Mr. John Smith said so today. " * 2, None, "", "one two three four five six seven eight nine\nten\neleven", "one two three four five six seven eight nine\nten\neleven"]


@pytest.mark.parametrize("name", OPERATORS)
def test_dotted_ids_give_the_same(spark, name):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    odd = df.select(F.col("doc_id").alias("a.b"), "text", F.lit(1).alias("__new"), F.lit("x").alias("plain_id"), F.lit(2).alias("c.d"))
    own = OPERATORS[name](df)
    got = OPERATORS[name](odd, id_col="a.b")
    columns = [c for c in own.columns if c != "doc_id"]
    assert "a.b" in got.columns
    rows = lambda d, i: sorted((repr([r[i], *[r[c] for c in columns]]) for r in d.collect()))
    assert rows(own, "doc_id") == rows(got, "a.b")


def test_contamination_of_dotted_ids(spark):
    bench = spark.createDataFrame([(1, TEXTS[3])], "item_id long, text string")
    odd = spark.createDataFrame(list(enumerate(TEXTS)), "`a.b` long, text string")
    assert {r["a.b"]: r.n_words > 0 for r in decontaminate.contamination(odd, bench, id_col="a.b").collect()}[3]
