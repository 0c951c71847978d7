"""Substring dedup by compacting a De Bruijn graph of word k-mers.

Windows of `window` words are the edges of the graph, from the node of their first `window` - 1 words to the node of their
last ones. Runs of edges with a common anchor travel together (see anchors.py); a run that equals another as a whole is
a path that does not branch, and its later copies repeat the first one. Where different runs may share edges, the edges of
their first copies become a table with both nodes, in which Spark counts the edges that enter and leave each node. A
node with one of each, at which no run opens or closes, lies inside a path; joins with the nodes compact the edges into
such paths, and one more join finds the earliest place of each path by its first edge. All occurrences of a path are
whole, so what holds for its first edge holds for all.

Repeats that continue each other are joined into long spans, each with its source. Source coordinates verify them: the
words at the source are read and digested there (128 bits), and a span of which the words at its own place have another
digest stays in the text.

Null and empty texts have no words; texts shorter than a window are kept whole; ties cannot occur, as two windows never
start at the same place of the same document, and rows with the same id and text count as one document, so none is
removed for the other; rows with a null id are kept whole and are no sources; ids that are no integers are numbered in
their order; a text of any length is handled in stretches of about a million words, except that the last step holds it
whole; an empty table gives an empty result; columns other than the id and the text are not read, so their names cannot
clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .anchors import LATE, LATES, PIECE, PIECES, located
from .packed import SCHEMA, by_doc, dealt, gathered, joined, part_of, parts_of, unpack
from .tasks import by_id, discard, gram_hashes, join_hot, map_slices, mix, numbered, plain_id, slices, words_in, words_of, written

WINDOW = 20
ANCHOR = 7


def _tokeniser(k: int):
    def tokenise(column: pa.Array):
        words = words_in(column)
        return lambda a, b: gram_hashes(words.hashes[a:b], k), words.lengths

    return tokenise


EDGES = "key long, edge long, tail long, head long, doc long, run int, to int, start int"


def _edges(window: int):
    """The edges of the runs in batches of doc, text and packed places: hashes of the window and of its two nodes."""

    def run(batches):
        for part in slices(batches):
            words = words_in(part.column(1))
            whole, nodes = gram_hashes(words.hashes, window), gram_hashes(words.hashes, window - 1)
            begins = np.cumsum(words.lengths) - words.lengths
            rows = [[], [], [], [], []]  # doc, place of the first word of its text, run, n, key
            for doc, base, data in zip(part.column(0).to_pylist(), begins.tolist(), part.column(2).to_pylist(), strict=True):
                start, n, key, _ = unpack(data)[0]
                for c, x in zip(rows, (np.full(len(n), doc), np.full(len(n), base), start, n, key), strict=True):
                    c.append(x)
            doc, base, start, n = (np.concatenate(c).astype(np.int64) for c in rows[:4])
            key = np.concatenate(rows[4]).astype(np.uint64)
            for at in range(0, len(n), 65536):  # bounds what a text with very many runs holds at once
                d, b, r, m, k = (c[at : at + 65536] for c in (doc, base, start, n, key))
                step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                own = np.repeat(r, m) + step
                place = np.repeat(b, m) + own
                columns = [np.repeat(k, m), whole[place], nodes[place], nodes[place + 1]]
                yield pa.record_batch(
                    [*(pa.array(c.view(np.int64)) for c in columns), pa.array(np.repeat(d, m)), *(pa.array(c.astype(np.int32)) for c in (np.repeat(r, m), np.repeat(r + m, m), own))],
                    names=["key", "edge", "tail", "head", "doc", "run", "to", "start"],
                )

    return run


def compacted(edges: DataFrame) -> DataFrame:
    """Paths that do not branch: key, edge (the first one), doc, start and n (edges), for every run of edges (see EDGES)."""
    total = edges.count()
    distinct = written(edges.groupBy("key", "edge").agg(F.first("tail").alias("tail"), F.first("head").alias("head"), F.count(F.lit(1)).alias("times")), "distinct-edges")
    one, none, two = F.lit(1), F.lit(0), F.lit(2)  # where a run opens or closes, no path goes on
    ends = [
        distinct.select(F.col("head").alias("node"), one.alias("enter"), none.alias("leave"), F.lit(0).cast("long").alias("times")),
        distinct.select(F.col("tail").alias("node"), none.alias("enter"), one.alias("leave"), "times"),
        edges.filter("start = run").select(F.col("tail").alias("node"), two.alias("enter"), two.alias("leave"), F.lit(0).cast("long").alias("times")),
        edges.filter("start = to - 1").select(F.col("head").alias("node"), two.alias("enter"), two.alias("leave"), F.lit(0).cast("long").alias("times")),
    ]
    nodes = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])
    nodes = nodes.groupBy("node").agg(F.sum("enter").alias("enter"), F.sum("leave").alias("leave"), F.sum("times").alias("times"))
    nodes = written(nodes.select(F.col("node").alias("tail"), F.expr("enter = 1 and leave = 1").alias("inner"), "times"), "nodes")
    # a node with more than a 1,024th of all edges is one of fewer than 1,024: broadcast, the others shuffled
    often = F.col("times") > max(1, total // 1024)
    tagged = edges.join(F.broadcast(nodes.filter(often).select("tail", "inner")), "tail", "left")
    rest = tagged.filter("inner is null").drop("inner").join(nodes.filter(~often & F.col("inner")).select("tail"), "tail", "left_anti")
    heads = tagged.filter("not inner").drop("inner").unionByName(rest)
    following = F.lead("start").over(Window.partitionBy("doc", "run").orderBy("start"))
    return heads.select("key", "edge", "doc", "start", (F.coalesce(following, "to") - F.col("start")).alias("n"))


def _branching(edges: DataFrame) -> DataFrame:
    """doc, start, n, source, source_start of compacted paths that also lie at an earlier place."""
    total = edges.count()
    firsts = edges.groupBy("key", "edge").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    found = join_hot(compacted(edges), firsts, ["key", "edge"], "times", total)
    late = found.filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return late.select("doc", F.col("start").cast("long"), F.col("n").cast("long"), F.col("first.doc").alias("source"), F.col("first.start").cast("long").alias("source_start"))


def _packed_rows(rows: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            yield dealt(part_of(mix(columns[0].view(np.uint64)), parts), LATE, columns, parts)

    return rows.mapInArrow(run, SCHEMA)


def _long_spans(rows: DataFrame, parts: int) -> DataFrame:
    """doc, start, n, source, source_start with repeats that continue each other, at both places, joined."""

    def fn(held):
        columns = joined([v for values in held.values() for v in values], LATES)
        doc, start, n, source, source_start = columns
        order = np.lexsort((start, source_start - start, source, doc))
        doc, start, n, source, source_start = (c[order] for c in columns)
        if not len(doc):
            return
        same = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & ((source_start - start)[1:] == (source_start - start)[:-1])
        cut = np.concatenate(([True], ~same | (start[1:] != (start + n)[:-1])))
        at = np.flatnonzero(cut)
        n = np.add.reduceat(n, at)
        names = ["doc", "start", "n", "source", "source_start"]
        out = pa.record_batch([pa.array(c) for c in (doc[at], start[at], n, source[at], source_start[at])], names=names)
        for i in range(0, out.num_rows, 10_000):
            yield out.slice(i, 10_000)

    return gathered(rows, parts, fn, "doc long, start long, n long, source long, source_start long")


def _digest(words: list[bytes], start: int, n: int, window: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n + window - 1]), digest_size=16).digest()


def _verified(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """doc and its spans with the digests of the words at their sources."""
    total = spans.count()
    asked = written(spans.groupBy("source", "source_start", "n").agg(F.count(F.lit(1)).alias("times")), "asked")
    by_source = asked.groupBy(F.col("source").alias("doc")).agg(F.collect_list(F.struct("source_start", "n", "times")).alias("asked"))

    def digest(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, places in zip(*(c.to_pylist() for c in part.columns), strict=True):
            words = words_of(text)
            out += [(doc, p["source_start"], p["n"], p["times"], _digest(words, p["source_start"], p["n"], window)) for p in places]
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["source", "source_start", "n", "times", "digest"])

    found = map_slices(rows.join(by_source, "doc").select("doc", "text", "asked"), digest, "source long, source_start long, n long, times long, digest binary")
    found = written(found.distinct(), "source-digests")  # rows with one id and text are one document
    own = join_hot(spans, found, ["source", "source_start", "n"], "times", total)
    out = written(own.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "source", "source_start", "digest")).alias("spans")), "verified")
    discard(asked, found)
    return out


def repeated_spans(docs: DataFrame, window: int, anchor: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """doc, spans: start, n, source, source_start, digest of n consecutive windows that also start at the earlier place; names of docs."""
    rows, names = numbered(docs, id_col, text_col)
    parts = parts_of(docs)
    found = written(located(rows, _tokeniser(anchor), window, anchor, True), "located")
    asked = by_doc(found.filter(F.col("kind") == PIECE), parts, PIECES)
    edges = written(rows.join(asked, "doc").select("doc", "text", "data").mapInArrow(_edges(window), EDGES), "edges")
    late = found.filter(F.col("kind") == LATE).unionByName(_packed_rows(_branching(edges), parts))
    spans = written(_long_spans(late, parts), "long-spans")
    discard(found, edges)
    out = _verified(rows, spans, window)
    discard(spans)
    return out, names


def _union(spans: list[dict], window: int) -> list[list]:
    """Disjoint spans of words; each keeps the source of its first window."""
    out: list[list] = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["n"])):
        a, b = s["start"], s["start"] + s["n"] + window - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, s["source"], s["source_start"]])
    return out


@plain_id
def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, removed (spans of words with the source of their first window) and kept (text) of each row.

    Sources are numbers of documents: their ids where these are integers.
    """
    spans, names = repeated_spans(docs, window, anchor, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"))
    own = by_id(rows, id_col, spans.withColumnRenamed("spans", "__spans"), names).select(f"`{id_col}`", "__text", "__spans")
    longs = lambda *names: [StructField(x, LongType()) for x in names]
    span = StructType(longs("start", "end", "source", "source_start"))
    schema = StructType([own.schema[0], *longs("n_words", "n_removed"), StructField("removed", ArrayType(span)), StructField("kept", StringType())])
    spans_kind = pa.list_(pa.struct([(x, pa.int64()) for x in span.names]))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, removed, kept = [], [], [], []
        for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            words = words_of(text)
            own = _union([s for s in found or [] if _digest(words, s["start"], s["n"], window) == s["digest"]], window)
            left, at = [], 0
            for a, b, _, _ in own:
                left += words[at:a]
                at = b
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            removed.append([dict(zip(span.names, x, strict=True)) for x in own])
            kept.append(b" ".join(left).decode())
        return pa.record_batch([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, spans_kind), pa.array(kept, pa.string())], names=schema.names)

    return map_slices(own, run, schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS gram FROM t, unnest(range(1, len(w) - 18)) AS u(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS at FROM late, unnest(range(0, 20)) AS u(j)),
words AS (SELECT t.doc_id, p, w[p] AS word FROM t, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.at WHERE gone.at IS NULL GROUP BY words.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
