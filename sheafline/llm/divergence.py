"""How the words of each source differ from those of the other sources of its language: an inverted index of terms.

A group is a language and a source, and gives each term that the language keeps a smoothed share p, also where it never
holds the term. Two groups differ in a term by f(p, q) = floor((p - q)^2 / (p + q)). Nearly all terms are absent from
nearly all groups, so the sum of f over all V terms of a language is not made term by term. Each pair starts at V times f
of its two zero counts. A group's postings then correct this as if the other group held none of its terms; these
corrections depend on the count alone, so they are summed over the histogram of the group's counts. Where both hold a term,
the two corrections are replaced by the true difference; these are found in the postings of the index, a row for each
language and term with all groups that hold it. A task sums up what it finds by pair before it sends anything, so what is
shuffled follows the number of pairs and not that of postings. Terms are ranked by windows, which Spark cuts to the
first few in each task before it shuffles.

Texts are counted where they lie, and a task sends one row for each group and term it has met; the rows of one term are
summed by Spark before they are gathered. Groups meet their postings by join_hot, so no task gets all those of a large one;
pairs are formed in SALTS tasks a language. Nothing is broadcast but the few hot groups.

Null texts, languages and sources are empty; a group without terms has p of zero counts throughout; a language that keeps no
term (V = 0) has pairs of value 0 and no terms; ties are ranked by the item's UTF-8 bytes; repeated rows count one by
one; a text of any length is counted whole, in stretches; an
empty table gives an empty result; columns other than text, language and source are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tasks import discard, join_hot, written

#: Documents of its language that a kept term occurs in at least; ranks of terms; the scale of shares.
LEAST_DOCUMENTS, TOP, SCALE = 10, 10, 1_000_000_000
#: Terms and groups a task holds before it sends them, rows sent at once, bytes of a text counted at once, pairs of postings compared at once.
HELD, SENT, STRETCH, PAIRS = 700_000, 100_000, 4 << 20, 1 << 20
#: A task holds a term's documents above this bit of its count, and sends its counts before it has read so many bytes that either could need more bits.
SHIFT, MOST_BYTES = 32, 1 << 30
DOCUMENT = 1 << SHIFT
#: Tasks among which a language's pairs of groups are dealt.
SALTS = 16
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(text: str) -> Counter:
    """How often a text holds each term, in UTF-8; only A-Z are lower-cased."""
    data, out, at = text.encode().lower(), Counter(), 0
    while at < len(data):
        to = _BREAK.search(data, at + STRETCH)
        to = to.start() if to else len(data)
        out.update(_TERM.findall(data, at, to))
        at = to
    return out


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n occurrences and d documents; a group's row with a null term shows that the group occurs."""

    def rows(held: dict):
        for (lang, source), counts in held.items():
            for at in range(0, len(counts), SENT):
                some = dict(islice(counts.items(), at, at + SENT))
                both = np.fromiter(some.values(), np.int64, len(some))
                terms = pa.array(list(some), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), terms, pa.array(both & (DOCUMENT - 1)), pa.array(both >> SHIFT)]
                yield pa.record_batch(columns, names=["lang", "source", "term", "n", "d"])

    def run(batches):
        held, size, read = {}, 0, 0
        for batch in batches:
            for lang, text, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = held.get((lang, source))
                if own is None:
                    own, size = held.setdefault((lang, source), {None: 0}), size + 1
                before, get = len(own), own.get
                for term, n in term_counts(text).items():
                    own[term] = get(term, 0) + n + DOCUMENT
                size, read = size + len(own) - before, read + len(text)
                if size > HELD or read > MOST_BYTES:
                    yield from rows(held)
                    held, size, read = {}, 0, 0
        yield from rows(held)

    wanted = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (text_col, "text"), (source_col, "source"))]
    return docs.select(*wanted).mapInArrow(run, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _difference(p: str, q: str) -> str:
    """The same in SQL; p and q are column names."""
    return f"((({p} - {q}) * ({p} - {q})) div ({p} + {q}))"


def _share(count: str, total: str) -> str:
    """1 + floor(SCALE * (count + 2) / total) in SQL, exact beyond 64 bits; null where no term is kept."""
    return f"CASE WHEN {total} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(19, 0))) div CAST({total} AS DECIMAL(19, 0)) END"


def postings(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each group (lang, source, its number g, V and its share of a zero count), and one for each kept term that a group holds, with the group's share p and the language's share q."""
    alike = Window.partitionBy("lang", "term")
    rows = counts.filter("term is not null").select("*", F.sum("n").over(alike).alias("total"), F.sum("d").over(alike).alias("documents"), F.row_number().over(alike.orderBy("source")).alias("at"))
    kept = written(rows.filter(F.col("documents") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n", "total", "at"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.when(F.col("at") == 1, 1)).alias("v"), F.sum("n").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count(F.lit(1)).alias("held"))
    groups = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["v", "lang_n", "group_n", "held"])
    groups = groups.selectExpr("lang", "source", "v", "held", "group_n + 2 * v AS total_p", "lang_n + 2 * v AS total_q", f"{_share('0', 'group_n + 2 * v')} AS zero")
    groups = written(groups.withColumn("g", F.monotonically_increasing_id()), "groups")
    table = groups.select("lang", "source", "g", "zero", "total_p", "total_q", "held")
    found = join_hot(kept, table, ["lang", "source"], "held", kept.count())
    found = written(found.selectExpr("lang", "source", "term", "g", "zero", f"{_share('n', 'total_p')} AS p", f"{_share('total', 'total_q')} AS q"), "postings")
    discard(kept)
    return groups, found


def _pairs_of(sizes: np.ndarray):
    """For lists of such sizes in one line, the places of all pairs of each list, in chunks of about PAIRS."""
    own = np.repeat(np.cumsum(sizes), sizes)  # where the list of each place ends
    after = own - np.arange(len(own)) - 1
    done = np.concatenate(([0], np.cumsum(after)))
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        first = np.repeat(np.arange(at, to), after[at:to])
        yield first, first + 1 + np.arange(len(first)) - np.repeat(done[at:to] - done[at], after[at:to])
        at = to


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """a, b and delta with one row for each a, b."""
    a, b, delta = columns
    if not len(a):
        return columns
    order = np.lexsort((b, a))
    a, b, delta = a[order], b[order], delta[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return [a[starts], b[starts], np.add.reduceat(delta, starts)]


def shared_corrections(found: DataFrame) -> DataFrame:
    """a, b (numbers of groups, a < b) and delta: what the terms that both hold add to the corrections of each side alone."""
    index = found.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "zero")).alias("postings")).filter("size(postings) > 1")

    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            lists = batch.column(0)
            group, p, zero = (c.to_numpy() for c in lists.flatten().flatten())
            for i, j in _pairs_of(np.diff(lists.offsets.to_numpy())):
                delta = difference(p[i], p[j]) - difference(p[i], zero[j]) - difference(zero[i], p[j]) + difference(zero[i], zero[j])
                new = _summed([np.minimum(group[i], group[j]), np.maximum(group[i], group[j]), delta])
                held = _summed([np.concatenate(c) for c in zip(held, new, strict=True)])
                if len(held[0]) > PAIRS:
                    yield pa.record_batch([pa.array(c) for c in held], names=["a", "b", "delta"])
                    held = [c[:0] for c in held]
        if len(held[0]):
            yield pa.record_batch([pa.array(c) for c in held], names=["a", "b", "delta"])

    return index.select("postings").mapInArrow(run, "a long, b long, delta long").groupBy("a", "b").agg(F.sum("delta").alias("delta"))


def pair_values(groups: DataFrame, found: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value of all pairs of groups."""
    bars = found.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.collect_list(F.struct("p", "n")).alias("bars"))
    sides = groups.select("lang", "source", "v", "zero", "g").join(bars, "g", "left")
    a = sides.select("lang", "v", *[F.col(c).alias(f"{c}_a") for c in ("source", "zero", "g", "bars")], (F.col("g") % SALTS).cast("int").alias("salt"))
    b = sides.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "zero", "g", "bars")], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = a.join(b, [a["lang"] == b["lang"], a["salt"] == b["salt"], a["g_a"] < b["g_b"]]).drop(b["lang"]).drop("salt")
    none = _difference("zero_a", "zero_b")
    one = lambda bars, zero: f"aggregate(coalesce({bars}, array()), 0L, (sum, x) -> sum + x.n * ({_difference('x.p', zero)} - {none}))"
    both = both.join(shared_corrections(found).withColumnsRenamed({"a": "g_a", "b": "g_b"}), ["g_a", "g_b"], "left")
    value = f"CASE WHEN v > 0 THEN v * {none} + {one('bars_a', 'zero_b')} + {one('bars_b', 'zero_a')} + coalesce(delta, 0L) ELSE 0L END"
    both = both.selectExpr("lang", "source_a", "source_b", f"{value} AS value")
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("w")
    return both.select("lang", ways, "value").select("lang", "w.source", "w.item", "value")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: all other sources by their difference, and the terms that a source uses more than its language, to rank TOP."""
    counts = written(counted(docs, text_col, lang_col, source_col), "term-counts")
    groups, found = postings(counts)
    discard(counts)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, found).withColumn("rank", F.row_number().over(by))
    terms = found.filter("p > q").selectExpr("lang", "source", "term AS item", f"{_difference('p', 'q')} AS value")
    terms = terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL_P = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
_SQL_F = "((p - q) * (p - q)) // (p + q)"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT row_id, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS lang_count FROM o GROUP BY lang, term HAVING count(DISTINCT row_id) >= {LEAST_DOCUMENTS}),
c AS (SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN v ON o.lang = v.lang AND o.term = v.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_total FROM v GROUP BY lang),
g AS (SELECT DISTINCT d.lang, d.source, coalesce(l.v, 0) AS v, coalesce(lang_total, 0) AS lang_total FROM d LEFT JOIN l ON d.lang = l.lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
x AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, {_SQL_P.format(n="coalesce(c.n, 0)", total="coalesce(total, 0)")} AS p, {_SQL_P.format(n="lang_count", total="lang_total")} AS lang_p
  FROM g JOIN v ON g.lang = v.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND v.term = c.term),
pf AS (SELECT a.lang, a.source, b.source AS item, sum({_SQL_F.replace("p -", "a.p -").replace("(p +", "(a.p +").replace("q)", "b.p)")}) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pf ON pf.lang = a.lang AND pf.source = a.source AND pf.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - lang_p) * (p - lang_p)) // (p + lang_p) AS value FROM x WHERE n > 0 AND p > lang_p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR place <= {TOP}
"""
