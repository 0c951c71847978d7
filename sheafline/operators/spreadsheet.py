"""Addresses, dates and grids of spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_number(letters: Column) -> Column:
    """A is 1, Z is 26, AA is 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)


def column_letters(number: Column) -> Column:
    """The inverse, up to three letters."""
    n = number
    one = F.char(65 + (n - 1) % 26)
    two = F.char(65 + F.floor((n - 27) / 26) % 26)
    three = F.char(65 + F.floor((n - 703) / 676) % 26)
    return F.concat(F.when(n > 702, three).otherwise(""), F.when(n > 26, two).otherwise(""), one)


def serial_to_iso(serial: Column, since_1904: bool = False) -> Column:
    """A spreadsheet's serial date as UTC text with milliseconds."""
    offset = 24107 if since_1904 else 25569
    ms = F.floor((serial - offset) * 86400000 + 0.5).cast("long")
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def densified(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every place of a small preview grid for each sheet, with its cell's value or null; the grid is built per sheet, without a cross join."""
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(rows)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda c: F.struct(r.alias("row"), c.alias("col"))))))
    places = cells.select("sheet").distinct().withColumn("p", grid).select("sheet", "p.row", "p.col")
    return places.join(cells, ["sheet", "row", "col"], "left")


def capped(cells: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """kept and omitted cells of each group under a cap in document order."""
    return cells.groupBy(group).agg(F.count(F.lit(1)).alias("n")).select(group, F.least("n", F.lit(cap)).alias("kept"), F.greatest(F.col("n") - cap, F.lit(0)).alias("omitted"))
