"""Selection of files by blocked level, globs and ids, and views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def inclusion(recs: DataFrame, globs: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """recs with included, reason and matched_glob; blocked comes before globs, globs before ids, and the first glob counts."""
    rows = recs.withColumn("__glob", paths.first_glob(F.col("path"), globs))
    if excluded is not None:
        rows = rows.join(excluded.select("bundle_id", "seq").distinct().withColumn("__out", F.lit(True)), ["bundle_id", "seq"], "left")
    else:
        rows = rows.withColumn("__out", F.lit(None).cast("boolean"))
    reason = F.when(~F.col("default_included"), "blocked-capability").when(F.col("__glob").isNotNull(), "excluded-glob").when(F.col("__out"), "excluded-manual").otherwise("selected")
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("included", F.col("reason") == "selected").withColumn("matched_glob", F.when(F.col("reason") == "excluded-glob", F.col("__glob"))).drop("__glob", "__out")


def view(recs: DataFrame, query: str = "", level: str = "all", risk: str = "all", selected_only: bool = False) -> DataFrame:
    out = recs
    if query.strip():
        out = out.filter(F.lower("path").contains(query.strip().lower()))
    if level != "all":
        out = out.filter(F.col("level") == level)
    if risk != "all":
        out = out.filter(F.col("risk_level") == risk)
    return out.filter("included") if selected_only else out
