"""MinHash near-dedup by min-max hashing.

A document's set is its distinct shingles of `shingle` words. Each of PERMUTATIONS hash functions is evaluated once per
shingle and gives two signature values, the least and the greatest; bands of four values are the buckets in which
similar sets meet: sets of similarity 0.85 miss each other in all 24 bands once in 50 million pairs, of 0.8 once in
300,000. Documents with equal sets are one class; only one of each class goes into buckets.

No bucket is expanded into all its pairs. First each member is compared with its bucket's first member; links are
confirmed on full sets and joined into components. What then still shares a first member across components is compared
only where an exact bound allows a link. Sets are linked when they differ in few shingles, and two sets differ where just
one of them differs from the first member. So if they are not linked through it, they must differ from it in the same
shingles, in so many that the most frequent ones can be left out; the others are joined, and a pair goes on only if all
more frequent ones of both would be enough. So large groups of loosely similar copies are settled without comparing all
their pairs.

Null and empty texts, and texts without words, have empty sets and are linked with nothing; texts of fewer words than a
shingle are one shingle; ties go to the smallest id; rows with equal ids count as one document; rows with a null id are
linked with nothing, have a null component and are kept; ids that are no integers are numbered in their order; a text
of any length is one set, held whole by its task; an empty table gives an empty result; columns other than the id and the
text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tasks import discard, gram_hashes, join_hot, map_slices, mix, numbered, words_in, written

SHINGLE, LEAST_PERCENT = 3, 85
PERMUTATIONS, BANDS = 48, 24

_RNG = np.random.default_rng(20240229)
FACTORS = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text; one of fewer words is one shingle, one without words none."""
    words = words_in(texts, lower=True)
    grams = gram_hashes(words.hashes, shingle)
    ends = np.cumsum(words.lengths)
    out = []
    for end, n in zip(ends.tolist(), words.lengths.tolist(), strict=True):
        own = grams[end - n : end - shingle + 1] if n >= shingle else gram_hashes(words.hashes[end - n : end], n) if n else grams[:0]
        out.append(np.unique(own))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """Least and greatest of each hash function over the set, one row each function."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(values), 2048):
        hashed = values[at : at + 2048] * FACTORS[:, None] + TERMS[:, None]
        hashed ^= hashed >> np.uint64(29)
        np.minimum(low, hashed.min(1), out=low)
        np.maximum(high, hashed.max(1), out=high)
    return np.stack([low, high], 1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for column in sig.reshape(BANDS, -1).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def sets(rows: DataFrame, shingle: int) -> DataFrame:
    """doc, n_shingles, digest of the set (s1, s2) and band keys of each row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = shingle_sets(part.column(1), shingle)
        both = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found), "<i8").reshape(-1, 2)
        bands = np.stack([band_keys(signature(x)) for x in found]).view(np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
        return pa.record_batch([part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), keys], names=["doc", "n", "s1", "s2", "bands"])

    return map_slices(rows, run, "doc long, n long, s1 long, s2 long, bands array<long>")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = pairs.join(texts.withColumnsRenamed({"doc": "a", "text": "text_a"}).hint("merge"), "a")
    return left.join(texts.withColumnsRenamed({"doc": "b", "text": "text_b"}).hint("merge"), "b").select("b", "text_b", "a", "text_a")


def _each_pair(part: pa.RecordBatch, shingle: int):
    """a, b and their full sets, from columns b, text_b, a, text_a; rows with one b lie together and its set is made once."""
    b = part.column(0).to_numpy()
    new = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    own = shingle_sets(part.column(1).take(pa.array(new)), shingle)
    of = np.cumsum(np.concatenate(([False], b[1:] != b[:-1])))
    yield from zip(part.column(2).to_pylist(), b.tolist(), shingle_sets(part.column(3), shingle), (own[i] for i in of.tolist()), strict=True)


def compared(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs a, b with the sizes of their full sets and of what these share."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(a, b, len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))) for a, b, x, y in _each_pair(part, shingle)]
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "n_a", "n_b", "shared"])

    return map_slices(_with_texts(pairs, texts), run, "a long, b long, n_a long, n_b long, shared long")


def similar(percent: int, shared: str = "shared") -> str:
    return f"100 * ({shared}) >= {percent} * (n_a + n_b - ({shared}))"


def components(links: DataFrame) -> DataFrame:
    """doc and component (the smallest id reachable) of every document with a link, by least labels and jumps to labels of labels.

    A first member with very many links, and the label of a large component, are met by join_hot: no task gets all rows of one.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    total = both.count()
    degrees = both.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "doc")
    labels = written(degrees.select("doc", F.least("least", "doc").alias("component"), "degree"), "labels")
    while True:
        near = join_hot(both.withColumnRenamed("b", "doc"), labels, ["doc"], "degree", total).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels["doc"] == near["a"]).select("doc", F.least("component", "near").alias("to"), F.col("component").alias("was"), "degree")
        new = written(new, "nearer-labels")
        members = new.groupBy("to").agg(F.count(F.lit(1)).alias("members"))
        jump = labels.select(F.col("doc").alias("to"), F.col("component").alias("far")).join(members, "to")
        after = join_hot(new, jump, ["to"], "members", total).select("doc", F.least("to", "far").alias("component"), "was", "degree")
        after = written(after, "labels")
        discard(labels, new)
        done = after.filter("component <> was").isEmpty()
        labels = _named(after.drop("was"), after)
        if done:
            discard(both)
            return _named(labels.select("doc", "component"), after)


def _named(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which reads a written table and can be discarded like it."""
    df.written_path = table.written_path
    return df


def near_duplicates(rows: DataFrame, shingle: int = SHINGLE, percent: int = LEAST_PERCENT) -> DataFrame:
    """doc, n_shingles and component (the smallest doc linked with the row, itself included) of rows doc, text."""
    every = written(sets(rows, shingle), "sets")
    full = every.filter("n > 0")
    classes = written(full.groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("times")), "classes")
    members = full.join(classes.select("rep"), F.col("doc") == F.col("rep"), "left_semi").select("doc", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(buckets, "shared-buckets")
    buckets = written(join_hot(members, shared, ["key"], "size", members.count()).select("doc", "pivot").distinct(), "buckets")
    ids = buckets.select("doc").distinct()
    # what joins with texts grows with the table, so these joins are planned alike at every size
    texts = written(rows.join(ids.hint("merge"), "doc", "left_semi").dropDuplicates(["doc"]), "candidates")
    stars = buckets.filter("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    stars = written(compared(stars, texts, shingle), "stars")
    links = stars.filter(similar(percent)).select("a", "b")
    first = components(links)
    rest, used = _rest(stars, first, texts, shingle, percent)
    more = written(compared(rest, texts, shingle).filter(similar(percent)).select("a", "b"), "more-links")
    found = components(links.unionByName(more))
    own = every.select("doc", "n", "s1", "s2").filter("n > 0")
    own = join_hot(own, classes, ["s1", "s2"], "times", own.count()).join(found.withColumnRenamed("doc", "rep"), "rep", "left")
    out = own.select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    empty = every.filter("n = 0").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component"))
    out = written(out.unionByName(empty), "near-duplicates")
    discard(every, classes, shared, buckets, texts, stars, more, first, found, *used)
    return out


def _rest(stars: DataFrame, found: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs a, b of different components and one first member (pivot) that may be linked; and the written tables that these read.

    A doc's weight tells how far it is from the pivot: two docs are linked just where `each` times the number of shingles
    in which both differ from the pivot reaches the sum of their weights. No weight is below the pivot's own, so where the
    sum is not positive both are linked with the pivot, and in one component.
    """
    each = 2 * (100 + percent)
    weight = F.expr(f"{100 + percent} * (n_a + n_b - 2 * shared) - {100 - percent} * n_a")
    rows = stars.select(F.col("b").alias("pivot"), F.col("a").alias("doc"), F.col("n_a").alias("n"), weight.alias("weight"))
    rows = rows.join(found, "doc", "left").select("pivot", "doc", "n", "weight", F.coalesce("component", "doc").alias("component"))
    rows = grouped = written(rows, "grouped")
    mixed = rows.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("weight").alias("least"), F.count(F.lit(1)).alias("size"))
    mixed = written(mixed.filter("low < high").drop("low", "high"), "mixed")
    rows = written(join_hot(rows, mixed, ["pivot"], "size", rows.count()), "mixed-groups")

    def apart(part: pa.RecordBatch) -> pa.RecordBatch:
        own = [(a, b, np.setxor1d(x, y, assume_unique=True)) for a, b, x, y in _each_pair(part, shingle)]
        sizes = [len(x) for _, _, x in own]
        doc, pivot = (np.repeat(np.array([o[i] for o in own], np.int64), sizes) for i in (0, 1))
        return pa.record_batch([pa.array(pivot), pa.array(doc), pa.array(np.concatenate([x for _, _, x in own]).view(np.int64))], names=["pivot", "doc", "shingle"])

    pairs = rows.select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    residue = map_slices(_with_texts(pairs, texts), apart, "pivot long, doc long, shingle long")
    residue = written(residue, "residue")
    common = residue.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    needed = F.expr(f"cast(greatest(1, ceil((weight + least) / {each})) as int)").alias("needed")
    named = rows.select("pivot", "doc", "n", "weight", "component", needed)
    frequent = Window.partitionBy("pivot", "doc").orderBy(F.desc("df"), F.desc("shingle"))
    common = written(common, "common-residue")
    named = join_hot(residue, common, ["pivot", "shingle"], "df", residue.count()).join(named, ["pivot", "doc"])
    own = ["doc", "n", "weight", "component", "at"]
    named = written(named.withColumn("at", F.row_number().over(frequent)).filter("at >= needed").select("pivot", "shingle", *own), "needed-residue")
    ends = [named.select("pivot", "shingle", *[F.col(c).alias(f"{c}_{x}") for c in own]) for x in "ab"]
    # in the rarest shingle of those that two docs share, all that they share stand at or before it
    able = F.expr(f"doc_a > doc_b and component_a <> component_b and {each} * least(at_a, at_b) >= weight_a + weight_b and {similar(percent, 'least(n_a, n_b)')}")
    pairs = ends[0].join(ends[1], [ends[0]["pivot"] == ends[1]["pivot"], ends[0]["shingle"] == ends[1]["shingle"], able]).select("doc_a", "doc_b")
    return pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct(), [grouped, mixed, rows, residue, common, named]


def keep_one(docs: DataFrame, shingle: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs but those linked, directly or through others, with a smaller id."""
    rows, names = numbered(docs, id_col, text_col)
    near = near_duplicates(rows, shingle, percent).filter("doc <> component").select("doc").distinct()
    near = (near if names is None else near.join(names, "doc").select("id")).toDF("__id")
    return docs.join(near.hint("merge"), F.col(f"`{id_col}`") == F.col("__id"), "left_anti")


def minhash_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = LEAST_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id linked with the row) of each row; those with a null id have a null component."""
    rows, names = numbered(docs, id_col, text_col)
    found = near_duplicates(rows, shingle, percent)
    lost = map_slices(docs.filter(F.col(f"`{id_col}`").isNull()).select(F.lit(0).cast("long").alias("doc"), F.col(f"`{text_col}`")), lambda part: pa.record_batch([pa.array([len(x) for x in shingle_sets(part.column(1), shingle)], pa.int64())], names=["n"]), "n long")
    kind = docs.schema[id_col].dataType
    if names is None:
        out = found.select(F.col("doc").cast(kind).alias(id_col), "n_shingles", F.col("component").cast(kind).alias("component_id"))
    else:
        heads = names.withColumnsRenamed({"doc": "component", "id": "component_id"})
        out = found.join(names, "doc").join(heads, "component").select(F.col("id").alias(id_col), "n_shingles", "component_id")
    return out.unionByName(lost.select(F.lit(None).cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast(kind).alias("component_id")))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    out = minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM t, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.doc_id, near.y FROM reach JOIN near ON reach.r = near.x)
SELECT t.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, t.doc_id = min(r) AS kept
FROM t JOIN reach ON t.doc_id = reach.doc_id LEFT JOIN sizes ON t.doc_id = sizes.doc_id GROUP BY t.doc_id
"""
