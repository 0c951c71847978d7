"""Manifests: file records, summaries, canonical JSON, and checks between tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

UNSAFE = '\\/:*?"<>|'


def project_name(name):
    """Unsafe and control characters replaced, at most 120 characters, never empty."""
    safe = F.regexp_replace(F.trim(name), "[" + "".join("\\" + c for c in UNSAFE) + r"\x00-\x1F]", "-")
    return F.coalesce(F.nullif(F.substring(safe, 1, 120), F.lit("")), F.lit("project"))


def file_records(selected: DataFrame) -> DataFrame:
    """The manifest's row of each file of a selection."""
    return selected.select(
        "bundle_id", "seq", paths.node_id("file", F.col("path")).alias("file_id"), paths.node_id("directory", paths.parent(F.col("path"))).alias("parent_id"), "path", "name", "extension", "mime", "category",
        "level", "size", "risk_level", F.col("included"), "reason", "matched_glob", F.when(F.col("included"), "pending").otherwise("skipped").alias("status"))


def summary(recs: DataFrame) -> DataFrame:
    inc = F.col("included")
    return recs.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(inc).alias("included"), F.count_if(~inc).alias("excluded"), F.count_if(F.col("reason") == "blocked-capability").alias("blocked"),
        F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(inc, F.col("size"))), F.lit(0)).alias("included_bytes"))


def inconsistent(recs: DataFrame) -> DataFrame:
    """Rows whose inclusion, reason, glob or id contradict each other, with the rule they break."""
    rules = F.filter(
        F.array(
            F.when(F.col("included") != (F.col("reason") == "selected"), F.lit("inclusion-consistency")),
            F.when((F.col("reason") == "excluded-glob") != F.col("matched_glob").isNotNull(), F.lit("glob-consistency")),
            F.when((F.col("level") == "E") & F.col("included"), F.lit("blocked-included")),
            F.when(~F.col("file_id").rlike(r"\Afile_[a-f0-9]{64}\z"), F.lit("file-id")),
        ),
        lambda x: x.isNotNull(),
    )
    return recs.select("bundle_id", "seq", F.explode(rules).alias("code"))


def repeated_values(recs: DataFrame, column: str) -> DataFrame:
    return recs.groupBy("bundle_id", column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def canonical_json(value) -> str:
    """Keys sorted, absent values dropped, two spaces of indent, a line feed at the end; for one document of bounded size."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
