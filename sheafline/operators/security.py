"""Secrets: find, merge, redact, summarise."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ("private-key", "cloud-credential", "access-token", "jwt", "connection-string", "password-assignment", "high-entropy", "sensitive-filename")
#: Patterns of secrets in their order, with severity, confidence and the group that is the secret.
PATTERNS = [
    ("private-key", "high", "high", 0, r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----[\s\S]{0,200000}?-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY-----", 0),
    ("cloud-credential", "high", "high", 0, r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0),
    ("access-token", "high", "high", 0, r"\b(?:gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255}|xox[baprs]-[A-Za-z0-9-]{10,255})\b", 0),
    ("jwt", "high", "high", 0, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", 0),
    ("connection-string", "high", "high", 0, r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s:@/]{1,128}:[^\s@/]{1,256}@[^\s\"'<>]{1,512}", re.IGNORECASE),
    ("password-assignment", "high", "medium", 1, r"\b(?:password|passwd|pwd|secret|token|api[_-]?key|client[_-]?secret|access[_-]?key)\b\s*[:=]\s*[\"']?([^\s\"'#,;]{4,512})", re.IGNORECASE),
]
#: Names of files that usually hold secrets.
SENSITIVE_FILES = (
    r"(?i)(?:\A|/)\.env(?:\.[^/]+)?\z",
    r"(?i)(?:\A|/)(?:id_rsa|id_dsa|id_ecdsa|id_ed25519)(?:\.pub)?\z",
    r"(?i)(?:\A|/)(?:credentials|service[-_]?account|secrets?|auth|tokens?)\.(?:json|ya?ml|toml|ini|properties|txt)\z",
    r"(?i)(?:\A|/)(?:\.npmrc|\.pypirc|\.netrc|kubeconfig|wallet\.dat)\z",
    r"(?i)\.(?:pem|p12|pfx|key|keystore|jks)\z",
)


@dataclass(frozen=True)
class ScanPolicy:
    """Limits of a scan; no number of findings or of characters where these are None."""

    max_findings: int | None = 100
    max_characters: int | None = 2_000_000
    high_entropy: bool = True
    min_length: int = 24
    max_length: int = 512
    threshold: float = 4.2

    def __post_init__(self):
        if not (all(x is None or 0 < x for x in (self.max_findings, self.max_characters)) and 0 < self.min_length <= self.max_length and self.threshold > 0):
            raise ValueError("limits must be positive, and the least length no more than the greatest")


def sensitive_name(path: Column) -> Column:
    out = F.lit(False)
    for p in SENSITIVE_FILES:
        out = out | path.rlike(p)
    return out


def entropy_of(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(value, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return -F.aggregate(counts, F.lit(0.0), lambda a, p: a + p * F.log2(p))


def high_entropy(value: Column, policy: ScanPolicy = ScanPolicy()) -> Column:
    """Whether a candidate of letters, digits and _+/=- has three of four character classes, twelve characters and enough entropy."""
    classes = sum((value.rlike(c).cast("int") for c in ("[A-Z]", "[0-9]", "[_+/=-]")), value.rlike("[a-z]").cast("int"))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return F.when(classes < 3, False).when(distinct < 12, False).otherwise(entropy_of(value) >= policy.threshold)


def _java(pattern: str, flags: int) -> str:
    """The pattern with word borders of ASCII letters, whatever the Java version takes for one."""
    head, *rest = pattern.split(r"\b")
    borders = [r"(?<![A-Za-z0-9_])", *[r"(?![A-Za-z0-9_])"] * (len(rest) - 1)] if rest else []
    return ("(?i)" if flags & re.IGNORECASE else "") + head + "".join(b + r for b, r in zip(borders, rest, strict=True))


#: What a text must hold for a pattern to match, where that is cheap to see.
_HINTS = {"private-key": ["PRIVATE KEY-----"], "cloud-credential": ["AKIA", "ASIA"], "access-token": ["gh", "xox"], "jwt": ["eyJ"], "connection-string": ["://"]}
FILENAME = -1
#: Categories by rank: the file's name, the patterns in their order, random-looking strings.
RANKS = ["sensitive-filename", *(p[0] for p in PATTERNS), "high-entropy"]


def _measured(s: Column) -> list[Column]:
    """Characters, line feeds, and characters behind the last line feed."""
    return [F.length(s), F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))), F.length(F.substring_index(s, "\n", -1))]


def _matches(text: Column, pattern: str, group: int, good) -> Column:
    """For each match of a pattern: measures of what lies before its secret (from the end of the match before) and of the secret; the secret ends where the match does."""
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1))

    def one(z: Column) -> Column:
        whole, value, gap = z["0"], z["1"], z["2"]
        before = F.concat(gap, F.substr(whole, F.lit(1), F.length(whole) - F.length(value)))
        names = ("before", "before_lines", "before_tail", "size", "lines", "tail")
        return F.struct(*[c.alias(n) for n, c in zip(names, [*_measured(before), *_measured(value)], strict=True)], good(value).alias("good"))

    return F.transform(F.filter(parts, lambda z: z["0"].isNotNull()), one)


def candidates(files: DataFrame, policy: ScanPolicy, keys: tuple[str, ...]) -> DataFrame:
    """keys, path, rank, start, end, line, column of all that looks like a secret. Texts stay where they are; places are running sums of lengths."""
    text = F.coalesce("body", F.lit(""))
    text = text if policy.max_characters is None else F.substring(text, 1, policy.max_characters)
    zero = [F.lit(0).alias(n) for n in ("before_lines", "before_tail", "size", "lines", "tail")]
    found = [F.when(sensitive_name(F.col("path")), F.struct(F.lit(FILENAME).alias("rank"), F.array(F.struct(F.lit(-1).alias("before"), *zero, F.lit(True).alias("good"))).alias("each")))]
    for rank, (category, _, _, group, pattern, flags) in enumerate(PATTERNS):
        java = _java(pattern, flags)
        holds = text.rlike(java)
        if category in _HINTS:
            hint = F.lit(False)
            for word in _HINTS[category]:
                hint = hint | F.contains(text, F.lit(word))
            holds = hint & holds
        found.append(F.when(holds, F.struct(F.lit(rank).alias("rank"), _matches(text, java, group, lambda v: F.length(v) > 0).alias("each"))))
    if policy.high_entropy:
        java = f"[A-Za-z0-9_+/=-]{{{policy.min_length},{policy.max_length}}}"
        found.append(F.when(text.rlike(java), F.struct(F.lit(len(PATTERNS)).alias("rank"), _matches(text, java, 0, lambda v: high_entropy(v, policy)).alias("each"))))
    rows = files.select(*keys, "path", F.explode(F.array_compact(F.array(*found))).alias("f")).select(*keys, "path", "f.rank", F.posexplode("f.each").alias("at", "m"))
    rows = rows.select(*keys, "path", "rank", "at", "m.*").repartition(*keys)
    order = Window.partitionBy(*keys, "rank").orderBy("at")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    rows = rows.withColumns({"start": so_far(F.col("before") + F.col("size")) + F.col("before"), "line": so_far(F.col("before_lines") + F.col("lines")) + F.col("before_lines") + 1})
    rows = rows.withColumn("end", F.col("start") + F.col("size"))
    own = F.when(F.col("before_lines") > 0, F.col("start") - F.col("before_tail"))  # where the secret's line begins
    last = F.max(F.when(F.col("lines") > 0, F.col("end") - F.col("tail")).otherwise(own)).over(earlier)
    rows = rows.withColumn("column", F.col("start") - F.coalesce(own, last, F.lit(0)) + 1).filter("good")
    return rows.select(*keys, "path", "rank", *[F.col(c).cast("int").alias(c) for c in ("start", "end", "line", "column")])


def prior(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Those of spans (keys, path, rank, start, end, ...) that stay when ranks are taken one after the other, and in each the spans by position, none over one taken before.

    Spans that overlap directly or through others are one island; what stays is decided in each island alone.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end", "rank")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("island", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("island", F.sum("island").over(order))
    columns = ["rank", "start", "end", *[c for c in spans.columns if c not in (*keys, "rank", "start", "end")]]
    islands = rows.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("all"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (k["end"] > x["start"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    alone = F.when(F.size("all") == 1, F.col("all")).otherwise(kept)
    return islands.select(*keys, F.explode(alone).alias("s")).select(*keys, "s.*")


def findings(files: DataFrame, policy: ScanPolicy = ScanPolicy(), keys: tuple[str, ...] = ("bundle_id", "seq")) -> DataFrame:
    """keys, path, finding_id, ordinal, category, severity, source, confidence, start, end, line, column: one row for each finding of files (keys, path, body).

    Keys are those of one file. Candidates of all patterns are placed at once and overlaps decided by rank, then position;
    a policy's number of findings keeps the first ones, which scan_reports tells.
    """
    rows = prior(candidates(files, policy, keys), keys)
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "start")))
    if policy.max_findings is not None:
        rows = rows.filter(F.col("ordinal") <= policy.max_findings)
    category = F.get(F.array(*map(F.lit, RANKS)), F.col("rank") - FILENAME)
    source = F.when(F.col("rank") == FILENAME, "filename").otherwise("content")
    rows = rows.withColumns({"category": category, "source": source})
    medium = F.col("category").isin("high-entropy", "sensitive-filename")
    return rows.select(
        *keys, "path", F.format_string("secret-%s-%s-%03d", "source", "category", "ordinal").alias("finding_id"), "ordinal", "category", F.when(medium, "medium").otherwise("high").alias("severity"),
        "source", F.when(medium | (F.col("category") == "password-assignment"), "medium").otherwise("high").alias("confidence"),
        *[F.when(F.col("rank") != FILENAME, F.col(c)).alias(c) for c in ("start", "end", "line", "column")])


def scan_reports(files: DataFrame, found: DataFrame, policy: ScanPolicy = ScanPolicy(), keys: tuple[str, ...] = ("bundle_id", "seq")) -> DataFrame:
    """keys, path, status, scanned_characters, scan_truncated, finding_count, categories and warnings of each file; files without a body are not scanned."""
    sums = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("category")).alias("c"))
    rows = files.select(*keys, "path", F.length("body").alias("length")).join(sums, list(keys), "left")
    n, length = F.coalesce("n", F.lit(0)), F.coalesce("length", F.lit(0))
    cut = F.lit(False) if policy.max_characters is None else length > policy.max_characters
    full = F.lit(False) if policy.max_findings is None else n >= policy.max_findings
    uncertain = F.coalesce(F.array_contains("c", "high-entropy"), F.lit(False))
    warnings = F.array_compact(F.array(F.when(cut, "characters-limited"), F.when(full, "findings-limited"), F.when(uncertain, "high-entropy-uncertain")))
    return rows.select(
        *keys, "path", F.when(n > 0, "flagged").when(F.col("length").isNull(), "not-scanned").otherwise("clean").alias("status"),
        (length if policy.max_characters is None else F.least(length, F.lit(policy.max_characters))).alias("scanned_characters"), (cut | full).alias("scan_truncated"),
        n.alias("finding_count"), F.coalesce("c", F.expr("cast(array() as array<string>)")).alias("categories"), warnings.alias("warnings"))


def merged_intervals(spans: DataFrame, keys: tuple[str, ...] = ("bundle_id", "seq")) -> DataFrame:
    """keys, start, end, categories: overlapping or touching spans as one, with the categories in their order."""
    order = Window.partitionBy(*keys).orderBy("start", "end", "category")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("island", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("island", F.sum("island").over(order))
    sorted_ = F.array_sort(F.collect_list(F.struct("start", "end", "category")))
    out = rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), sorted_.alias("all"))
    return out.select(*keys, "start", "end", F.array_distinct(F.transform("all", lambda x: x["category"])).alias("categories"))


def redacted(files: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("bundle_id", "seq")) -> DataFrame:
    """files with secrets replaced by their categories, keeping line ends, and redactions: their number."""
    spans = merged_intervals(found.filter("source = 'content' and end > start"), keys)
    by_file = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "categories"))).alias("__spans"))
    rows = files.join(by_file, list(keys), "left")
    size = F.coalesce(F.size("__spans"), F.lit(0))
    piece = lambda i: F.substr("body", F.when(i == 0, 1).otherwise(F.get("__spans", i - 1)["end"] + 1), F.get("__spans", i)["start"] - F.when(i == 0, 0).otherwise(F.get("__spans", i - 1)["end"]))
    lost = lambda s: F.substr("body", s["start"] + 1, s["end"] - s["start"])
    mark = lambda s: F.concat(F.lit("[REDACTED:"), F.array_join(s["categories"], "+"), F.lit("]"), F.regexp_replace(lost(s), "[^\n]", ""))
    parts = F.transform("__spans", lambda s, i: F.concat(piece(i), mark(s)))
    rest = F.substr("body", F.element_at("__spans", -1)["end"] + 1, F.length("body"))
    body = F.when(size > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("body"))
    return rows.withColumn("body", body).withColumn("redactions", size).drop("__spans")


def by_mode(files: DataFrame, found: DataFrame, mode: str, keys: tuple[str, ...] = ("bundle_id", "seq")) -> DataFrame:
    """files under a policy: report keeps all, redact replaces secrets, exclude drops the bodies of flagged files; with status."""
    flagged = found.select(*keys).distinct().withColumn("flagged", F.lit(True))
    if mode == "redact":
        out = redacted(files, found, keys).join(flagged, list(keys), "left")
        return out.withColumn("status", F.when(F.col("redactions") > 0, "redacted").when(F.col("flagged"), "flagged").otherwise("clean")).drop("flagged")
    out = files.join(flagged, list(keys), "left").withColumn("redactions", F.lit(0))
    if mode == "exclude":
        out = out.withColumn("body", F.when(F.col("flagged"), F.lit(None)).otherwise(F.col("body")))
        return out.withColumn("status", F.when(F.col("flagged"), "excluded").otherwise("clean")).drop("flagged")
    if mode != "report":
        raise ValueError(f"no such mode: {mode}")
    return out.withColumn("status", F.when(F.col("flagged"), "flagged").otherwise("clean")).drop("flagged")


def summary(found: DataFrame, keys: tuple[str, ...] = ("bundle_id", "seq"), reports: DataFrame | None = None) -> DataFrame:
    """One row for each bundle: findings, flagged files, and the files of each category; with reports also of bundles without findings, with scanned, truncated and unscanned files."""
    file = F.struct(*keys)
    each = [F.countDistinct(F.when(F.col("category") == c, file)).alias(c.replace("-", "_")) for c in CATEGORIES]
    if reports is None:
        return found.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct(file).alias("flagged_files"), *each)
    count = lambda c: F.count_if(c)
    by_category = [count(F.array_contains("categories", c)).alias(c.replace("-", "_")) for c in CATEGORIES]
    return reports.groupBy("bundle_id").agg(
        F.sum("finding_count").alias("findings"), count(F.col("finding_count") > 0).alias("flagged_files"), *by_category, count(F.col("status") != "not-scanned").alias("scanned_files"), count(F.col("scan_truncated")).alias("truncated_scans"),
        count(F.col("status") == "not-scanned").alias("unscanned_files"), F.sum(F.col("scanned_characters").cast("long")).alias("scanned_characters"))


def file_rollup(found: DataFrame, keys: tuple[str, ...] = ("bundle_id", "seq")) -> DataFrame:
    return found.groupBy(*keys).agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"), F.sort_array(F.collect_set("category")).alias("categories"))
