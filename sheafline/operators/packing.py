"""Text into sections, segments and byte-bounded parts; page plans."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import escaped, longest_run
from .lineage import settled

RESERVED = 1024


def split_utf8(text: str, limit: int) -> list[str]:
    """Pieces of at most `limit` bytes, cut at line ends where lines fit and between characters where they do not."""
    if limit < 1:
        raise ValueError("the limit must be positive")
    if len(text.encode()) <= limit:
        return [text]
    units = [(u, len(u.encode())) for u in text.splitlines(keepends=True)] if "\r" not in text and "\x0b" not in text else None
    if units is None or any(not u.endswith("\n") for u, _ in units[:-1]):  # only line feeds end lines
        lines = text.split("\n")
        units = [(x, len(x.encode())) for x in [*(f"{line}\n" for line in lines[:-1]), lines[-1]] if x]
    out, held, size = [], [], 0
    for unit, n in units:
        fits = n <= limit
        if not fits:  # an oversize line: whether what is held began with it, followed character by character
            before = "".join(held)
            at, growing = len(before), unit.startswith(before)
        for piece in [unit] if fits else unit:
            m = n if fits else len(piece.encode())
            if held and (size + m > limit or (not fits and piece is unit[0] and not (growing and not held[-1].endswith("\n")))):
                out.append("".join(held))
                held, size, at, growing = [], 0, 0, True
            if not fits:
                growing = growing and unit.startswith(piece, at)
                at += 1
            held.append(piece)
            size += m
    return [*out, "".join(held)] if held else out


def fence_bytes(piece: str) -> int:
    """Bytes that a fence around the piece takes at most, besides its language."""
    return 2 * max(3, 1 + max(map(len, re.findall("`+", piece)), default=0)) + 4


def fitting(text: str, most: int, head: int) -> list[str]:
    """Pieces that fit an atom of `most` bytes with a head of `head` bytes and their fence.

    The first cut leaves 2048 bytes for head and fence; where that is too little, the text is cut again at 0.7 of the
    limit, up to eight times.
    """
    limit = max(256, most - 2048)
    for _ in range(9):
        pieces = split_utf8(text, limit)
        if all(head + len(p.encode()) + fence_bytes(p) <= most for p in pieces):
            return pieces
        limit = max(128, limit * 7 // 10)
    raise ValueError(f"a text of {len(text)} characters cannot be cut into atoms of {most} bytes with a head of {head}")


def segments(files: DataFrame, limit: int, keys: tuple[str, ...] = ("bundle_id", "seq")) -> DataFrame:
    """keys, segment (from 1), content, byte_length of pieces of bodies, of at most `limit` bytes. Only bodies above it are sent to Python."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else split_utf8(t, limit))

    whole = F.octet_length("body") <= limit
    pieces = F.when(whole, F.array("body")).otherwise(cut(F.when(~whole, F.col("body"))))
    return _numbered(files.select(*keys, F.posexplode(pieces).alias("at", "content")), keys)


def fitted_segments(files: DataFrame, most: int, head: str, keys: tuple[str, ...] = ("bundle_id", "seq")) -> DataFrame:
    """The same for atoms of at most `most` bytes, of which a file's column `head` tells how many go before and around each piece.

    Only bodies that `fitting` would cut are sent to Python.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else fitting(t, most, h) for t, h in zip(texts, heads, strict=True)])

    size = F.octet_length("body")
    fence = 2 * F.greatest(F.lit(3), longest_run(F.col("body"), "`") + 1) + 4
    whole = (size <= max(256, most - 2048)) & (F.col(head) + size + fence <= most)
    pieces = F.when(whole, F.array("body")).otherwise(cut(F.when(~whole, F.col("body")), F.col(head)))
    return _numbered(files.select(*keys, F.posexplode(pieces).alias("at", "content")), keys)


def _numbered(each: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return each.select(*keys, (F.col("at") + 1).alias("segment"), "content", F.octet_length("content").cast("long").alias("byte_length"))


def anchor(file_id: Column, segment: Column) -> Column:
    """The first segment of a file has its id, later ones a three-digit number behind it; more than 999 segments fail."""
    later = F.when(segment <= 999, F.format_string("%s-segment-%03d", file_id, segment)).otherwise(F.raise_error(F.lit("more than 999 segments")))
    return F.when(segment == 1, file_id).otherwise(later)


def running_totals(rows: DataFrame, group: tuple[str, ...], order: str, size: str) -> DataFrame:
    """rows with upto: the total of size up to the row in its group. No task sees more than its range of the order."""
    held = settled(rows.repartitionByRange(*group, order).withColumn("__range", F.spark_partition_id()))
    sums = held.groupBy(*group, "__range").agg(F.sum(size).alias("__sum"))  # one row for each range of a group
    ahead = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum(size).over(Window.partitionBy(*group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return held.join(ahead.drop("__sum"), [*group, "__range"]).withColumn("upto", F.col("__ahead") + within).drop("__range", "__ahead")


#: Budgets in a stretch of atoms: what one task walks through, and a bound on what it holds (totals only, no contents).
STRETCH = 16


def _next(before: np.ndarray, upto: np.ndarray, budget: int) -> np.ndarray:
    """For each atom, if it opens a part, the place of the atom that opens the next one."""
    return np.searchsorted(upto, before + budget, "right")


def pack(atoms: DataFrame, max_part: int, group: tuple[str, ...] = ("bundle_id",), order: str = "ordinal") -> DataFrame:
    """group, order, part: next-fit packing of atoms (byte_length) in order; an atom costs its bytes and two for the blank line.

    From running totals each atom knows the one that would open the next part after it. These links are followed stretch by
    stretch: for each atom that may open the first part of its stretch, one task finds which atom opens the first part of
    the next stretch, and how many parts later. Doubling over these few links alone tells where each stretch begins, and
    then every stretch numbers its own atoms. Rounds follow the logarithm of the number of stretches.
    """
    budget = max_part - RESERVED
    width = budget * STRETCH
    bad = F.raise_error(F.concat(F.lit("an atom of "), F.col("byte_length"), F.lit(" bytes does not fit a part")))
    cost = F.when(F.col("byte_length") + 2 > budget, bad).otherwise(F.col("byte_length") + 2).cast("long")
    rows = settled(running_totals(atoms.select(*group, order, "byte_length").withColumn("cost", cost), group, order, "cost"))
    rows = rows.withColumn("before", F.col("upto") - F.col("cost")).withColumn("stretch", F.floor(F.col("before") / width))  # costs are positive: no two atoms of a group have one `before`
    kinds = [StructField(g, rows.schema[g].dataType) for g in group]
    long = lambda name: StructField(name, LongType())
    both = F.array_compact(F.array("stretch", F.when((F.col("stretch") > 0) & (F.col("before") - F.col("stretch") * width <= budget), F.col("stretch") - 1)))
    wide = rows.select(*group, "before", "upto", F.explode(both).alias("stretch"))  # each stretch sees the atoms that may open parts right behind it

    def chained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("before")
        start, before, upto = int(key[-1]) * width, pdf["before"].to_numpy(), pdf["upto"].to_numpy()
        after, own = _next(before, upto, budget).tolist(), int((before < start + width).sum())
        to, n = [-1] * own, [0] * own
        for i in range(own - 1, -1, -1):
            j = after[i]
            if j < own:
                to[i], n[i] = to[j], n[j] + 1
            elif j < len(before):
                to[i], n[i] = int(before[j]), 1
        first = int((before[:own] <= start + budget).sum())
        return pd.DataFrame({**{g: [k] * first for g, k in zip(group, key, strict=False)}, "opens": before[:first], "to": to[:first], "n": n[:first]})

    links = settled(wide.groupBy(*group, "stretch").applyInPandas(chained, StructType([*kinds, long("opens"), long("to"), long("n")])))
    opened = rows.filter("before = 0").select(*group, F.lit(0).cast("long").alias("opens"), F.lit(1).cast("long").alias("part"))
    hops = links.filter("to >= 0")
    known = -1 if hops.isEmpty() else 0
    while known >= 0:
        more = opened.join(hops, [*group, "opens"]).select(*group, F.col("to").alias("opens"), (F.col("part") + F.col("n")).alias("part"))
        opened = settled(opened.unionByName(more).distinct())
        if (n := opened.count()) == known:
            break
        known = n
        further = hops.select(*group, "opens", F.col("to").alias("mid"), F.col("n").alias("m")).join(hops.withColumnsRenamed({"opens": "mid"}), [*group, "mid"])
        hops = settled(further.select(*group, "opens", "to", (F.col("m") + F.col("n")).alias("n")))
    last = opened.join(links.filter("to < 0"), [*group, "opens"]).select(*group, (F.col("part") + F.col("n")).alias("last"))
    entries = opened.withColumn("stretch", F.floor(F.col("opens") / width))
    given = rows.select(*group, "before", "upto", "stretch").join(entries, [*group, "stretch"], "left").join(last, list(group)).fillna({"opens": -1, "part": 0})

    def told(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("before")
        before, opens, part, final = pdf["before"].to_numpy(), int(pdf["opens"].iloc[0]), int(pdf["part"].iloc[0]), int(pdf["last"].iloc[0])
        parts = np.full(len(before), final)  # no part begins in a stretch without an entry: it is the last one
        if opens >= 0:
            after, at = _next(before, pdf["upto"].to_numpy(), budget), int(np.searchsorted(before, opens))
            parts[:at] = part - 1
            while at < len(before):
                parts[at : after[at]] = part
                at, part = int(after[at]), part + 1
        return pd.DataFrame({**{g: [k] * len(before) for g, k in zip(group, key, strict=False)}, "before": before, "part": parts})

    parts = given.groupBy(*group, "stretch").applyInPandas(told, StructType([*kinds, long("before"), long("part")]))
    return rows.select(*group, order, "before").join(parts, [*group, "before"]).select(*group, order, F.col("part").cast("int").alias("part"))


def line_atoms(lines: DataFrame, most: int, order: str, title: str) -> DataFrame:
    """bundle_id, segment, content: lines in order, in atoms of at most `most` bytes; the first one begins with the title. A line of more than half of that goes into an atom of its own."""
    room = max(1, (most - len(title.encode()) - 4) // 2)
    rows = running_totals(lines.withColumn("bytes", F.octet_length("line").cast("long") + 1), ("bundle_id",), order, "bytes")
    rows = rows.withColumn("segment", (F.floor((F.col("upto") - F.col("bytes")) / room) + 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy("bundle_id", "segment").agg(text.alias("content"))
    return out.withColumn("content", F.concat(F.when(F.col("segment") == 1, f"{title}\n\n").otherwise(""), "content"))


def part_name(project: Column, part: Column, parts: Column) -> Column:
    return F.concat(project, F.when(parts == 1, F.lit("-content.md")).otherwise(F.format_string("-content.part-%03d.md", part)))


def prelude(project: Column, part: Column, parts: Column) -> Column:
    """What every part begins with: its name, its place, and whether there are more."""
    name = part_name(project, part, parts)
    more = F.when(parts > 1, "> Load all parts that the manifest names before answering.").otherwise("> This is the only part.")
    return F.concat(F.lit("<!-- part: "), name, F.lit(" -->\n# "), escaped(project), F.format_string(", part %d of %d\n\n", part, parts), more, F.lit("\n\n"))


def parts_text(atoms: DataFrame, packed: DataFrame, project: Column) -> DataFrame:
    """bundle_id, part, name, content, byte_length, anchors: each part's prelude and its atoms (ordinal, content, anchor) in order, with blank lines between."""
    rows = atoms.join(packed, ["bundle_id", "ordinal"])
    parts = packed.groupBy("bundle_id").agg(F.max("part").alias("parts"))  # a row for each bundle
    each = rows.groupBy("bundle_id", "part").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content", "anchor"))).alias("all")).join(parts, "bundle_id")
    joined = F.array_join(F.transform("all", lambda x: x["content"]), "\n\n")
    out = each.select("bundle_id", "part", part_name(project, F.col("part"), F.col("parts")).alias("name"), F.concat(prelude(project, F.col("part"), F.col("parts")), joined, F.lit("\n")).alias("content"), F.array_compact(F.transform("all", lambda x: x["anchor"])).alias("anchors"))
    return out.withColumn("byte_length", F.octet_length("content").cast("long"))


def running_budget(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """within: whether the running total up to the row stays in the limit; rows beyond it count too."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).withColumn("within", F.col("running") <= limit)


def char_budget(rows: DataFrame, group: str, order: str, length: str, limit: int) -> DataFrame:
    """taken: characters of each row that a running budget still allows; totals are made by ranges, so no task holds a group."""
    left = F.lit(limit) - (F.col("upto") - F.col(length))
    return running_totals(rows, (group,), order, length).withColumn("taken", F.greatest(F.lit(0), F.least(F.col(length), left))).drop("upto")


def skipping_budget(rows: DataFrame, group: tuple[str, ...], order: str, size: str, limit: int, most: int | None = None) -> DataFrame:
    """taken: whether a row is among those that a budget of size (and of `most` rows) takes in order; one that does not fit is skipped, and smaller ones after it still count.

    In each round every group takes the longest run of open rows that fits. The first that does not, and all that exceed what
    is left, are out for good, as what is left never grows; the others behind it go on. A round at least halves what a group
    has left or ends a run of rows, and all groups go through their rounds together.
    """
    one = F.lit(1).cast("long").alias("__one")
    open_ = settled(rows.select(*group, F.col(order).alias("__at"), F.col(size).cast("long").alias("__size"), one, F.lit(limit).cast("long").alias("__left"), F.lit(most).cast("long").alias("__room")))
    taken = None
    while True:
        open_ = open_.filter("__size <= __left and (__room is null or __room > 0)")
        run = settled(running_totals(open_, group, "__at", "__size").withColumnRenamed("upto", "__upto"))
        if most is not None:
            run = settled(running_totals(run, group, "__at", "__one").withColumnRenamed("upto", "__n"))
        else:
            run = run.withColumn("__n", F.lit(0))
        fits = (F.col("__upto") <= F.col("__left")) & (F.col("__room").isNull() | (F.col("__n") <= F.col("__room")))
        stop = run.filter(~fits).groupBy(*group).agg(F.min("__at").alias("__stop"))  # totals grow, so all before it fit
        marked = run.join(stop, list(group), "left")
        new = marked.filter(F.col("__stop").isNull() | (F.col("__at") < F.col("__stop")))
        got = new.groupBy(*group).agg(F.sum("__size").alias("__sum"), F.count(F.lit(1)).alias("__count"))
        taken = settled(new.select(*group, "__at") if taken is None else taken.unionByName(new.select(*group, "__at")))
        rest = marked.filter(F.col("__at") > F.col("__stop")).join(got, list(group))  # the first open row always fits, so each group that goes on has taken some
        open_ = settled(rest.select(*group, "__at", "__size", "__one", (F.col("__left") - F.col("__sum")).alias("__left"), (F.col("__room") - F.col("__count")).alias("__room")))
        if open_.isEmpty():
            break
    marks = taken.withColumnRenamed("__at", order).withColumn("taken", F.lit(True))
    return rows.join(marks, [*group, order], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def page_fit(entries: DataFrame, max_pages: int, fixed: int = 3, per_index: int = 34) -> DataFrame:
    """kept_pages and start_page of entries (bundle_id, path, pages) in path order, under a page budget.

    Entry n needs a separator and makes the index grow; the first that does not fit whole is cut, and those after it go.
    All before it are whole, so running totals of pages and numbers tell every entry's place.
    """
    rows = running_totals(entries.select("bundle_id", "path", F.col("pages").cast("long").alias("pages"), F.lit(1).cast("long").alias("one")), ("bundle_id",), "path", "pages")
    rows = running_totals(rows.withColumn("used", F.col("upto") - F.col("pages")).drop("upto"), ("bundle_id",), "path", "one").withColumnRenamed("upto", "n")
    room = F.lit(max_pages) - (fixed + F.ceil(F.col("n") / per_index)) - F.col("n") - F.col("used")
    rows = rows.withColumn("room", room.cast("long"))
    first = rows.filter("room < pages").groupBy("bundle_id").agg(F.min("path").alias("cut"))
    kept = F.when(F.col("cut").isNull() | (F.col("path") < F.col("cut")), F.col("pages")).when(F.col("path") == F.col("cut"), F.greatest(F.lit(0), F.least("pages", "room"))).otherwise(0)
    rows = rows.join(first, "bundle_id", "left").withColumn("kept_pages", kept.cast("long")).filter("kept_pages > 0")
    index = rows.groupBy("bundle_id").agg(F.ceil(F.count(F.lit(1)) / per_index).alias("index"))
    start = 2 + F.col("index") + 1 + F.col("used") + F.col("n") - 1
    return rows.join(index, "bundle_id").select("bundle_id", "path", "pages", "kept_pages", start.cast("long").alias("start_page"))


def grid_pages(sheets: DataFrame, rows: int = 24, columns: int = 12) -> DataFrame:
    """One row for each preview page of sheets (sheet, n_rows, n_columns)."""
    steps = lambda c, size: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(c) / size) - 1).cast("int")))
    out = sheets.withColumn("down", steps("n_rows", rows)).withColumn("across", steps("n_columns", columns))
    wide = F.least(F.col("n_columns") - F.col("across") * columns, F.lit(columns))
    return out.select("sheet", (F.col("down") * rows + 1).alias("first_row"), (F.col("across") * columns + 1).alias("first_column"), (wide > 7).alias("landscape"))


def resize_plan(images: DataFrame, max_pixels: int = 4_000_000, max_side: int = 2400) -> DataFrame:
    """target_width and target_height of images (width, height, orientation)."""
    swap = F.col("orientation") >= 5
    w, h = F.when(swap, F.col("height")).otherwise(F.col("width")), F.when(swap, F.col("width")).otherwise(F.col("height"))
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(max_pixels)) / (w * h)), F.lit(float(max_side)) / F.greatest(w, h))
    side = lambda x: F.greatest(F.lit(1).cast("long"), F.floor(x * scale + 0.5))
    return images.withColumns({"target_width": side(w), "target_height": side(h)})
