"""How filters act together: an incidence matrix of failures times integer matrices of all orders.

Five filters are judged once for each text, and what fails is one of 32 masks. A part of the table is then a row of
counts by mask, with the same counts for good and for toxic texts beside it: the incidence histogram. Whatever happens
to a text under any of the 120 orders depends on its mask alone, so the histogram times integer matrices of 32 rows and
600 columns (120 orders of 5 steps) gives what each step keeps, removes, finds removed already, and fails alone.

Judging is one scan. Labels meet rows by id, and equal texts by their 256-bit digest: each task counts its own copies
first, so that a large group of copies sends few rows. The histogram has one row for each part and is multiplied where it
lies; nothing is broadcast but labels where Spark finds them small.

Null texts are empty; a null part is the empty one; a null id has no order, so its row never repeats a smaller id's text
and has no labels; rows with one id are judged one by one and do not repeat each other; if labels hold an id more than
once, any of them counts; a text of any length is judged whole; an empty table has no parts and gives no rows; columns
other than the id, the text and the part are not read, so their names cannot clash.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters in the order of their bits; the last one, on copies, needs other rows and so is judged apart.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
KINDS = ("rows", "good", "toxic")
#: Parts multiplied at once.
BLOCK = 64


def failures(text: Column) -> Column:
    """The mask of the filters that look at one text only."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, F.lit(100) * distinct < F.lit(80) * n, F.lit(100) * capitals.cast("long") > F.lit(10) * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts n of rows by part, mask, good and toxic."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.filter("id is not null").groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).join(marks, "id", "left")
    known = known.select("id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    lost = rows.filter("id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    # of each text, part and label: all rows, and those of its smallest id
    groups = known.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("own", F.when(F.col("first.id") == smallest, F.col("first.n")).otherwise(0))
    masks = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("m")
    return groups.select("part", "good", "toxic", masks).select("part", "m.mask", "good", "toxic", "m.n").unionByName(lost)


def histogram(counts: DataFrame) -> DataFrame:
    """One row a part: counts by mask of all rows, of good and of toxic ones, as one array each."""
    kinds = {"rows": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    bins = [F.sum(F.when(F.col("mask") == m, kinds[k]).otherwise(0)).alias(f"{k}{m}") for k in KINDS for m in range(MASKS)]
    wide = counts.groupBy("part").agg(*bins)
    return wide.select("part", *[F.array(*[F.col(f"{k}{m}") for m in range(MASKS)]).alias(k) for k in KINDS])


def matrices() -> dict[str, np.ndarray]:
    """What each order and step makes of each mask: a row for each mask, a column for each order and step."""
    mask = np.arange(MASKS)[:, None]
    bits = np.array([[1 << FILTERS.index(c) for c in order] for order in ORDERS])
    done = np.cumsum(bits, 1)  # bits are distinct, so sums are unions
    own, until, before = bits.ravel()[None, :], done.ravel()[None, :], (done - bits).ravel()[None, :]
    fails, gone = (mask & own) > 0, (mask & before) > 0
    out = {"kept": (mask & until) == 0, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": np.broadcast_to(mask == own, fails.shape)}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    same = (own.T == own).astype(np.int64)  # columns of one filter
    return out | {"shapley": out["removed"] @ same}


#: Columns of the result: the histogram and the matrix that give it.
PRODUCTS = {"kept": ("rows", "kept"), "removed": ("rows", "removed"), "redundant": ("rows", "redundant"), "unique_fails": ("rows", "unique_fails"), "good_lost": ("good", "removed"), "toxic_lost": ("toxic", "removed"), "shapley": ("rows", "shapley")}


def outcomes(hist: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of PRODUCTS: the histogram's rows times the matrices."""

    def run(batches):
        tables = matrices()
        order = pa.array(np.repeat(ORDERS, len(FILTERS)), pa.string())
        step = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                rows = {k: np.array(some.column(i + 1).to_pylist(), np.int64) for i, k in enumerate(KINDS)}
                n = some.num_rows
                part = some.column(0).take(pa.array(np.repeat(np.arange(n), len(order))))
                product = [pa.array((rows[k] @ tables[m]).ravel()) for k, m in PRODUCTS.values()]
                yield pa.record_batch([part, pa.concat_arrays([order] * n), pa.concat_arrays([step] * n), *product], names=["part", "filter_order", "step", *PRODUCTS])

    columns = ", ".join(f"{c} long" for c in PRODUCTS)
    return hist.select("part", *KINDS).mapInArrow(run, f"part string, filter_order string, step int, {columns}")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each filter removes from each part of docs, at each step of each order."""
    return outcomes(histogram(judged(docs, labels, id_col, text_col, part_col)))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(s, '[A-Z]')) > 10 * length(s),
  regexp_matches(s, '[#$%&*|]'), coalesce(t.doc_id > least, false)] AS fails FROM t LEFT JOIN marks ON t.doc_id = marks.doc_id),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l(c, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
x AS (SELECT part, filter_order, step, seq[step] AS own, n, good, toxic, fails[seq[step]] AS bad, len(list_filter(seq[1 : step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS n_fails FROM h, o, unnest(range(1, 6)) AS u(step)),
y AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN bad AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y
"""
