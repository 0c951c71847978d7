"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per row: the ledger keeps the measurements and one bit per failed rule. Policies are
versioned masks over the bits, and ablations are bitwise aggregations of the ledger, so neither reads texts again.
Null and empty texts have zero measurements and fail the rule on the number of words; repeated rows are judged one by
one, so there are no ties; ids of any type, and null ones, pass through; a text of any length is measured whole; an empty
table gives an empty ledger; columns other than the id and the text are not read by the ledger, and keep_good keeps them
under their own names, whatever these are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .tasks import Words, gram_hashes, map_slices, mix, plain_id, slices, words_in

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL predicate over the measurements holds."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a changed rule gets a new bit.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "too_many_words", "n_words > 100000"),
    Rule(3, "symbols_per_word", "10 * n_symbols > n_words"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "duplicate_lines", "10 * n_dup_lines > n_words"),
)
#: Policy versions: the rules of which none may fail.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols_per_word", "short_words", "long_words", "duplicate_lines"),
}


def mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _repeat_words(words: Words) -> list[int]:
    """For each text, its words inside windows of REPEAT_WINDOW words that the text has at least twice."""
    lengths = words.lengths
    out = [0] * len(lengths)
    grams = gram_hashes(words.hashes, REPEAT_WINDOW)
    if not len(grams):
        return out
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(doc[: len(grams)] == doc[REPEAT_WINDOW - 1 :])
    key = mix(grams[starts] + doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hits = starts[twice]
    for d in np.unique(doc[hits]).tolist():
        first = int(ends[d] - lengths[d])
        seen: dict[bytes, list[int]] = {}
        for s in hits[doc[hits] == d].tolist():  # equal hashes are compared word by word
            own = b" ".join(words.data[words.starts[i] : words.ends[i]].tobytes() for i in range(s, s + REPEAT_WINDOW))
            seen.setdefault(own, []).append(s - first)
        inside = np.zeros(lengths[d] + 1, np.int64)
        for places in seen.values():
            if len(places) > 1:
                np.add.at(inside, places, 1)
                np.add.at(inside, np.array(places) + REPEAT_WINDOW, -1)
        out[d] = int((np.cumsum(inside) > 0).sum())
    return out


def _measure(part: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t or "" for t in part.column(1).to_pylist()]
    words = words_in(part.column(1))
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        dup.append(len(lines) - len(set(lines)))
    measures = [
        words.lengths,
        [len(t) - sum(map(t.count, BLANKS)) for t in texts],
        [sum(map(t.count, SYMBOLS)) for t in texts],
        dup,
        _repeat_words(words),
    ]
    return pa.record_batch([part.column(0), *(pa.array(m, pa.int64()) for m in measures)], names=[part.schema.names[0], *MEASURES])


def fail_bits() -> Column:
    out = F.lit(0).cast("long")
    for r in RULES:
        out = out.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out


@plain_id
def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements and fail_bits of each row; a narrow operation."""
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    out = map_slices(rows, _measure, StructType([rows.schema[0], *(StructField(m, LongType()) for m in MEASURES)]))
    return out.withColumn("fail_bits", fail_bits())


def passes(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: rows that fail it, that fail it alone, and that the policy keeps without it."""
    m = mask(policy)
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).count()  # at most 2^rules rows
    chosen = [r for r in RULES if r.name in POLICIES[policy]]
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen])).alias("r")
    each = counts.select("bits", "count", rules).select("bits", "count", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_fail_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(df: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """Rows that the policy keeps, with all their columns; measurements are put beside the rows, so nothing is joined or shuffled."""
    at = df.columns.index(text_col)
    plain = [StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)]  # names that clash with no measurement
    schema = StructType([*plain, *(StructField(m, LongType()) for m in MEASURES)])

    def run(batches):
        for batch in batches:
            two = pa.record_batch([batch.column(at), batch.column(at)], names=["id", "text"])
            done = 0
            for part in slices(iter([two])):
                own = batch.slice(done, part.num_rows)
                done += part.num_rows
                yield pa.record_batch([*own.columns, *_measure(part).columns[1:]], names=schema.names)

    kept = df.toDF(*schema.names[: len(plain)]).mapInArrow(run, schema).withColumn("fail_bits", fail_bits()).filter(passes(policy))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def op10_quality(spark, sf_dir: str) -> DataFrame:
    led = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = ~passes("base")
    return led.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & passes("v1")).alias("kept"), "fail_bits")


_FAILS = {r.name: r.fails for r in RULES}
OP10_SQL = (
    r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i, i + 7), ' ')) AS n FROM t, unnest(range(1, len(w) - 6)) AS u(i)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, unnest(range(0, 8)) AS v(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(s, chr(10)), lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*')) AS lines FROM t),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(s, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM t JOIN l ON t.doc_id = l.doc_id LEFT JOIN r ON t.doc_id = r.doc_id)
SELECT *, """
    + " OR ".join(_FAILS[n] for n in POLICIES["base"])
    + " AS base_failed, NOT ("
    + " OR ".join(_FAILS[n] for n in POLICIES["v1"])
    + ") AS kept, CAST("
    + " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    + " AS BIGINT) AS fail_bits FROM m\n"
)
