"""The pipeline, stage by stage on its own input and as a whole, against brute force."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from sheafline.llm import quality  # noqa: E402

from .test_minhash import brute as brute_near  # noqa: E402
from .test_native import brute_lines  # noqa: E402
from .test_row_operators import brute_hits, low_words  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("sf"))
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(i, f"Line one of {i}\n" + "\n".join(f"shared line {j} of every such text here" for j in range(9)) + f"\nlast line with its own words {i} " + "and more " * 3, "en", "s", 0) for i in range(200, 206)]
    rows += [(300, "clean words " * 2 + " ".join(f"w{i}" for i in range(60)) + " " + passage, "en", "s", 0), (301, passage + " one two three four five six seven eight", "en", "s", 0)]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.unionByName(spark.createDataFrame(rows, plain.schema)).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "something else entirely that is nowhere in any of these texts")], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def test_each_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for at, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if at == 0:
            bad = {r.doc_id for r in quality.ledger(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect() if r.fail_bits & quality.mask("v1")}
            assert after == {k: v for k, v in before.items() if k not in bad} and 300 in after
        elif at == 1:
            want = brute_lines(before)
            assert after == {k: v for k, v in want.items() if v == before[k] or WORD.search(v)}
        elif at == 2:
            label = brute_near(before, 5, 80)
            assert after == {k: v for k, v in before.items() if label[k][1] == k}
        else:
            for k, v in before.items():
                hit, _ = brute_hits(low_words(v), items)
                assert (k in after) == (len(hit) <= 0.5 * len(low_words(v)))
                if k in after:
                    assert low_words(after[k]) == [w for i, w in enumerate(low_words(v)) if i not in hit]
        before = after
    whole = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    last = {r.doc_id: r for r in pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert whole == last and set(whole) == set(before) and 300 in whole and 301 not in whole
