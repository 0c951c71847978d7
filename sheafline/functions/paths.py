"""Expressions over paths: normalization, names, ancestors, globs, ordering."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_LENGTH = 64, 4096
MAX_GLOBS, MAX_GLOB_LENGTH = 100, 256


def normalized(raw: Column, max_depth: int = MAX_DEPTH, max_length: int = MAX_LENGTH) -> Column:
    """struct(path, name, extension, depth, error): error is the first broken rule, and then the rest is null.

    Paths are taken to be in composed form; compose() is there for others.
    """
    slashed = F.replace(raw, F.lit("\\"), F.lit("/"))
    segments = F.filter(F.split(slashed, "/", -1), lambda s: (s != "") & (s != "."))
    path = F.array_join(segments, "/")
    name = F.element_at(segments, -1)
    error = (
        F.when(slashed == "", "path-empty")
        .when(slashed.startswith("/") | slashed.rlike(r"\A[a-zA-Z]:(?:\z|/)"), "path-absolute")
        .when(slashed.rlike(r"[\x00-\x1F\x7F]"), "path-control-character")
        .when(F.array_contains(segments, ".."), "path-traversal")
        .when(F.size(segments) == 0, "path-empty")
        .when(F.size(segments) > max_depth, "path-depth")
        .when(F.length(path) > max_length, "path-length")
    )
    ok = lambda c: F.when(error.isNull(), c)
    safe_name = F.try_element_at(segments, F.lit(-1))
    extension = F.lower(F.regexp_extract(safe_name, r"(?s)\A.+\.([^.]+)\z", 1))
    return F.struct(ok(path).alias("path"), ok(safe_name).alias("name"), ok(extension).alias("extension"), ok(F.size(segments)).alias("depth"), error.alias("error"))


def compose(path: Column) -> Column:
    """Unicode composed form; Spark has no function for it."""
    @F.pandas_udf("string")
    def composed(values: pd.Series) -> pd.Series:
        return values.map(lambda p: None if p is None else unicodedata.normalize("NFC", p))

    return composed(path)


def ancestors(path: Column) -> Column:
    """Paths of all directories above, nearest last."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.expr("cast(array() as array<string>)"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def node_id(kind: str, path: Column, namespace: str = "sheafline") -> Column:
    """Id of a directory or file derived from its path; ids of another system come out with its namespace."""
    prefix = {"directory": "dir", "file": "file"}[kind]
    seed = F.concat(F.lit(f"{namespace}\0manifest-v1\0{kind}\0"), path)
    return F.concat(F.lit(f"{prefix}_"), F.sha2(seed.cast("binary"), 256))


#: Blocks of letters that may carry accents: Latin, Greek, Cyrillic, Latin with two accents.
_ACCENTED = ((0xC0, 0x24F), (0x370, 0x52F), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF))


def _plain_letters() -> dict[str, str]:
    """The letter without its accents, in lower case, of each composed one."""
    every = [chr(c) for a, b in _ACCENTED for c in range(a, b + 1)]
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)).lower() for c in every}
    return {c: b for c, b in bare.items() if len(b) == 1 and b != c.lower()}


def folded(text: Column) -> Column:
    """Text in lower case without accents, as names are compared: composed letters give their base letter, combining marks go."""
    plain = _plain_letters()
    bare = F.regexp_replace(F.translate(text, "".join(plain), "".join(plain.values())), r"\p{Mn}", "")
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(text))


def natural_key(path: Column, lower: bool = False) -> Column:
    """Sorts digit runs by value; in lower case also without regard to accents."""
    of = folded(path) if lower else path
    return F.array_join(F.transform(F.regexp_extract_all(of, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda s: F.when(s.rlike(r"\A\d+\z"), F.lpad(s, F.greatest(F.length(s), F.lit(20)), "0")).otherwise(s)), "")


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression; raises ValueError for an empty or too long one."""
    text = pattern.strip().replace("\\", "/")
    if not text:
        raise ValueError("empty pattern")
    if len(text) > MAX_GLOB_LENGTH:
        raise ValueError(f"pattern of more than {MAX_GLOB_LENGTH} characters")
    out, rest = [], text
    while rest:
        stars = len(rest) - len(rest.lstrip("*"))
        if stars > 1:
            rest = rest[stars:]
            directory = rest.startswith("/")
            out.append("(?:.*/)?" if directory else ".*")
            rest = rest[directory:]
            continue
        c, rest = rest[0], rest[1:]
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r"\^$.*+?()[]{}|" else c)
    return "".join(out)


def parse_globs(text: str) -> tuple[list[str], list[str]]:
    """Valid patterns, in order, and messages about the others."""
    found = [p.strip() for line in text.split("\n") for p in line.split(",") if p.strip()]
    good, bad = [], [f"more than {MAX_GLOBS} patterns"] if len(found) > MAX_GLOBS else []
    for p in found[:MAX_GLOBS]:
        try:
            glob_regex(p)
            good.append(p)
        except ValueError as e:
            bad.append(f"{p}: {e}")
    return good, bad


def first_glob(path: Column, patterns: list[str]) -> Column:
    """The first pattern that matches, or null. Patterns are a parameter of at most MAX_GLOBS entries, so no join is needed."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(path.rlike(rf"\A(?:{glob_regex(p)})\z"), F.lit(p)).otherwise(out)
    return out
