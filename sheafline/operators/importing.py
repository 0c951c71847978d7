"""Import: accept files with valid, new, conflict-free paths; report the others beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .lineage import settled


def with_paths(files: DataFrame, composed: bool = False) -> DataFrame:
    """files with path, name, extension, depth and error of each raw path; composed paths agree whichever way accents are written."""
    raw = F.col("raw_path")
    if composed:  # only paths beyond ASCII are sent to Python
        wide = raw.rlike(r"[^\x00-\x7F]")
        raw = F.when(wide, paths.compose(F.when(wide, raw))).otherwise(raw)
    return files.withColumn("__p", paths.normalized(raw)).select("*", "__p.path", "__p.name", "__p.extension", "__p.depth", "__p.error").drop("__p")


def first_wins(files: DataFrame) -> DataFrame:
    """copy: the place of each row among those with its path, by sequence; only the first is accepted."""
    valid = files.filter("error is null")
    return valid.withColumn("copy", F.row_number().over(Window.partitionBy("bundle_id", "path").orderBy("seq")))


#: Later copies that are broadcast, two numbers each; more are met by a shuffle.
FEW = 1_000_000


def accepted(files: DataFrame) -> DataFrame:
    """The first file of each valid path; seq numbers the files of a bundle.

    Which files are later copies is decided on paths and numbers alone. Bodies and contents stay where they are, unless
    there are more than FEW copies.
    """
    copies = first_wins(files.select("bundle_id", "seq", "path", "error")).filter("copy > 1").select("bundle_id", "seq")
    few = copies.count() <= FEW
    return files.filter("error is null").join(F.broadcast(copies) if few else copies, ["bundle_id", "seq"], "left_anti").drop("error")


def path_conflicts(files: DataFrame) -> DataFrame:
    """bundle_id, path, conflict: files that lie below another file. Ancestors are exploded, so the join is on equality."""
    own = files.select("bundle_id", "path").distinct()
    above = own.select("bundle_id", "path", F.explode(paths.ancestors(F.col("path"))).alias("conflict"))
    return above.join(own.withColumnRenamed("path", "conflict"), ["bundle_id", "conflict"]).select("bundle_id", "path", "conflict")


def issues(files: DataFrame) -> DataFrame:
    """bundle_id, seq, code, path of each file that is not accepted at first sight: bad paths and copies."""
    bad = files.filter("error is not null").select("bundle_id", "seq", F.col("error").alias("code"), F.col("raw_path").alias("path"))
    copies = first_wins(files).filter("copy > 1").select("bundle_id", "seq", F.lit("duplicate-path").alias("code"), "path")
    return bad.unionByName(copies)


def accept_greedy(files: DataFrame) -> DataFrame:
    """bundle_id, seq, path, code for every valid path: a file is rejected for what was accepted before it only.

    Copies share the fate of their path's first file. Among paths that lie below each other, each round accepts those with
    no open or accepted one before them and rejects those with an accepted one; few paths conflict, so few rows are joined.
    """
    rows = files.filter("error is null").select("bundle_id", "seq", "path")
    firsts = rows.groupBy("bundle_id", "path").agg(F.min("seq").alias("first"))
    below = path_conflicts(rows)
    seq = lambda c, name: firsts.select("bundle_id", F.col("path").alias(c), F.col("first").alias(name))
    both = below.join(seq("path", "s"), ["bundle_id", "path"]).join(seq("conflict", "t"), ["bundle_id", "conflict"])
    early = F.col("s") < F.col("t")
    edges = settled(both.select("bundle_id", F.when(early, F.col("path")).otherwise(F.col("conflict")).alias("before"), F.when(early, F.col("conflict")).otherwise(F.col("path")).alias("path")).distinct())
    open_ = settled(edges.select("bundle_id", "path").union(edges.select("bundle_id", F.col("before"))).distinct())
    decided = open_.limit(0).withColumn("ok", F.lit(True))
    live = edges  # edges from a path that may still be accepted, or is
    while not open_.isEmpty():
        good = settled(open_.join(live.select("bundle_id", "path").distinct(), ["bundle_id", "path"], "left_anti"))
        bad = settled(live.join(good.withColumnRenamed("path", "before"), ["bundle_id", "before"], "left_semi").select("bundle_id", "path").distinct())
        decided = settled(decided.unionByName(good.withColumn("ok", F.lit(True))).unionByName(bad.withColumn("ok", F.lit(False))))
        open_ = settled(open_.join(good.unionByName(bad), ["bundle_id", "path"], "left_anti"))
        live = settled(live.join(bad.withColumnRenamed("path", "before"), ["bundle_id", "before"], "left_anti").join(open_, ["bundle_id", "path"], "left_semi"))
    fate = rows.join(firsts, ["bundle_id", "path"]).join(decided, ["bundle_id", "path"], "left")
    code = F.when(~F.col("ok"), "path-conflict").when(F.col("seq") != F.col("first"), "duplicate-path")
    return fate.select("bundle_id", "seq", "path", code.alias("code"))


def zip_acceptance(entries: DataFrame, max_entry: int = 256 << 20, max_total: int = 1 << 30, max_ratio: float = 200.0) -> DataFrame:
    """code of the first broken rule of each archive entry; the running total counts all entries that got as far."""
    early = (
        F.when(F.col("encrypted"), "archive-encrypted").when(~F.col("method").isin(0, 8), "archive-method").when(F.col("size") > max_entry, "archive-entry-size")
        .when((F.col("compressed_size") > 0) & (F.col("size") / F.col("compressed_size") > max_ratio), "archive-ratio")
    )
    rows = entries.withColumn("early", early)
    order = Window.partitionBy("archive").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("early").isNull(), F.col("size")).otherwise(0)).over(order)
    rows = rows.withColumn("code", F.coalesce("early", F.when(total > max_total, "archive-total-size"))).drop("early")
    p = paths.normalized(F.col("name"))
    return rows.withColumn("code", F.coalesce("code", p["error"]))
