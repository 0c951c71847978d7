"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Each line has a 60-bit hash; a hash that rolls over the last two lines with content ends a chunk after a line whose own
hash is divisible by DIVISOR while that of the line before is not, so boundaries depend on two lines only and shift
with them, and every chunk but a text's last one holds at least two lines with content. Chunks of at least two such lines
that occur again anywhere in the table are removed wherever they are not first (smallest id, then smallest place), after
their bytes have been compared with the first one's. Lines outside such chunks stay, however common: those of a shared
passage before its first boundary and after its last one, and a last line that is a chunk of its own.

Null texts stay null, with no lines; empty texts are one blank line; ties cannot occur, as places differ; rows with
equal ids count as one document; rows with a null id are kept whole and are nobody's first; an empty table gives an
empty result; a chunk whose 64-bit hash equals another's by chance is kept; a text of any length is cut within its row.
Columns of the input pass through line_dedup under their own names, also those that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tasks import discard, join_hot, plain_id, written

DIVISOR = 3
BLANK = r"^[\x20\x09-\x0D]*$"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk_ends(lines: Column) -> Column:
    """1-based numbers of the last line of each chunk."""
    ends = lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long") % DIVISOR == 0
    # number of the line and whether its hash would end a chunk, for lines with content
    filled = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(BLANK), F.struct((i + 1).alias("at"), ends(x).alias("ends")))), lambda x: x.isNotNull())
    rolled = lambda f: F.filter(f, lambda x, j: (j > 0) & x["ends"] & ~F.get(f, F.greatest(j - 1, F.lit(0)))["ends"])
    # bound once by a lambda over an array of one, so that lines are not hashed again at each use
    cuts = F.get(F.transform(F.array(filled), lambda f: F.transform(rolled(f), lambda x: x["at"])), 0)
    return F.when(lines.isNotNull(), F.concat(F.filter(cuts, lambda e: e < F.size(lines)), F.array(F.size(lines))))


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, place (from 0), text, n_lines and filled (lines with content) of each chunk."""
    rows = docs.select(F.col(id_col).alias("doc"), lines_of(F.col(text_col)).alias("lines")).filter("lines is not null")
    rows = rows.select("doc", "lines", chunk_ends(F.col("lines")).alias("ends"))
    cut = F.transform("ends", lambda e, k: F.slice("lines", F.when(k == 0, 1).otherwise(F.get("ends", k - 1) + 1), e - F.when(k == 0, 0).otherwise(F.get("ends", k - 1))))
    each = rows.select("doc", F.posexplode(cut).alias("place", "own"))
    filled = F.size(F.filter("own", lambda x: ~x.rlike(BLANK)))
    return each.select("doc", "place", F.array_join("own", "\n").alias("text"), F.size("own").alias("n_lines"), filled.alias("filled"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, place, n_lines of the chunks that repeat an earlier one byte for byte."""
    chunks = chunked(docs, id_col, text_col).filter("filled >= 2 and doc is not null").withColumn("hash", F.xxhash64("text"))
    # counted without their text; the first place is found among the repeated ones only
    again = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    again = written(again, "repeated-hashes")
    total = again.agg(F.sum("copies")).first()[0] or 0
    # the repeated hashes grow with the table, so the join is planned as it has to run on a large one, whatever their number
    copies = join_hot(chunks.select("hash", "doc", "place", "text", "n_lines"), again.hint("merge"), ["hash"], "copies", total)
    copies = written(copies, "repeated-chunks")
    first = copies.groupBy("hash").agg(F.min(F.struct("doc", "place")).alias("first"), F.count(F.lit(1)).alias("copies"))
    place = [F.col("first.doc").alias("doc"), F.col("first.place").alias("place")]
    firsts = copies.select("hash", "doc", "place", F.col("text").alias("first_text")).distinct().join(first.select("hash", "copies", *place), ["hash", "doc", "place"])
    firsts = written(firsts.select("hash", "copies", "first_text", F.col("doc").alias("first_doc"), F.col("place").alias("first_place")), "first-chunks")
    both = join_hot(copies.drop("copies"), firsts, ["hash"], "copies", total)
    later = (F.col("doc") != F.col("first_doc")) | (F.col("place") != F.col("first_place"))
    out = written(both.filter(later & (F.col("text") == F.col("first_text"))).select("doc", "place", "n_lines").distinct(), "later-chunks")
    discard(again, copies, firsts)
    return out


@plain_id
def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs with repeated chunks removed from the text, and n_chars, where there is one, set to its new length.

    drop_emptied: rows that had content and lose all of it go.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]  # names that clash with no working column
    own = dict(zip(docs.columns, columns, strict=True))
    rows, the_id, the_text = docs.toDF(*columns), F.col(own[id_col]), F.col(own[text_col])
    gone = repeated_chunks(docs, id_col, text_col).groupBy(F.col("doc").alias("__doc")).agg(F.collect_list("place").alias("__gone"))
    # the documents with repeats grow with the table: planned alike at every size
    joined = rows.join(gone.hint("merge"), the_id == F.col("__doc"), "left").drop("__doc")
    lines = lines_of(the_text)

    def left(s: Column) -> Column:
        """The lines that stay, of a struct of lines and chunk ends."""
        start = lambda k: F.when(k == 0, 1).otherwise(F.get(s["ends"], F.greatest(k - 1, F.lit(0))) + 1)
        stay = F.array_except(F.sequence(F.lit(0), F.size(s["ends"]) - 1), F.col("__gone"))
        return F.array_join(F.flatten(F.transform(stay, lambda k: F.slice(s["lines"], start(k), F.get(s["ends"], k) - start(k) + 1))), "\n")

    # bound once by a lambda over an array of one; exploded, so that the new text is made once for all that reads it
    cut = F.get(F.transform(F.array(F.struct(lines.alias("lines"), chunk_ends(lines).alias("ends"))), left), 0)
    out = joined.select("*", F.explode(F.array(F.when(F.col("__gone").isNull(), the_text).otherwise(cut))).alias("__new"))
    if drop_emptied:
        out = out.filter(F.col("__gone").isNull() | ~F.col("__new").rlike(BLANK))
    new = {text_col: F.col("__new")}
    if "n_chars" in own:
        chars = F.col(own["n_chars"])
        new["n_chars"] = F.when(F.col("__gone").isNull(), chars).otherwise(F.length("__new").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col(own[c])).alias(c) for c in docs.columns])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs.withColumn("before", F.size(lines_of(F.col("text")))))
    had = F.when(F.col("before") > 0, F.col("before")).otherwise(0).cast("long")
    has = F.when(F.col("text").isNull(), 0).when(F.col("before") < 0, 0).otherwise(F.size(lines_of(F.col("text")))).cast("long")
    return out.select("doc_id", had.alias("n_lines"), F.length("text").cast("long").alias("kept_chars"), has.alias("kept_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Chunks, their first places and what is left, for any table or expression named docs.
CHUNK_SQL = r"""
{p}lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs} WHERE text IS NOT NULL),
{p}filled AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: NOT regexp_full_match(l[i], '[\x20\x09-\x0D]*')) AS f FROM {p}lines),
{p}hashes AS (SELECT doc_id, l, f, list_transform(f, lambda i: CAST('0x' || substr(md5(l[i]), 1, 15) AS BIGINT) % 3 = 0) AS h FROM {p}filled),
{p}ends AS (SELECT doc_id, l, list_append(list_transform(list_filter(range(2, len(f) + 1), lambda j: h[j] AND NOT h[j - 1] AND f[j] < len(l)), lambda j: f[j]), len(l)) AS e FROM {p}hashes),
{p}chunks AS (SELECT doc_id, k, list_slice(l, CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END, e[k]) AS c FROM {p}ends, unnest(range(1, len(e) + 1)) AS u(k)),
{p}ranked AS (SELECT doc_id, k, c, len(list_filter(c, lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*'))) >= 2 AS multi, row_number() OVER (PARTITION BY c, len(list_filter(c, lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*'))) >= 2 ORDER BY doc_id, k) AS n FROM {p}chunks),
{p}kept AS (SELECT doc_id, bool_or(multi AND n > 1) AS cut, coalesce(string_agg(array_to_string(c, chr(10)), chr(10) ORDER BY k) FILTER (WHERE NOT multi OR n = 1), '') AS s FROM {p}ranked GROUP BY doc_id)
"""
OP7_SQL = (
    "WITH "
    + CHUNK_SQL.format(p="", docs="documents")
    + """
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(length(s) AS BIGINT) AS kept_chars,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(s, chr(10))) END AS BIGINT) AS kept_lines, sha256(s) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
)
