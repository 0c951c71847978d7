"""Expressions over text: newlines, fences, escapes, splitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def line_count(text: Column) -> Column:
    """Lines of a text; the empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)))


def with_line_numbers(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    width = F.length(F.size(lines).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, " "), F.lit(" | "), x)), "\n")


def longest_run(text: Column, char: str) -> Column:
    """Length of the longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"[{char}]+"), F.lit(0)), F.length)), F.lit(0))


def safe_fence(text: Column) -> Column:
    """Marker longer than any run in the text: backticks, or tildes where these need fewer."""
    ticks, tildes = (F.greatest(F.lit(3), longest_run(text, c) + 1) for c in "`~")
    return F.when(ticks <= tildes, F.repeat(F.lit("`"), ticks)).otherwise(F.repeat(F.lit("~"), tildes))


def fenced(text: Column, language: Column) -> Column:
    fence = safe_fence(text)
    safe = F.substring(F.regexp_replace(language, "[^a-zA-Z0-9_+.-]", ""), 1, 40)
    return F.concat(fence, safe, F.lit("\n"), text, F.lit("\n"), fence)


def cropped(text: Column, most: int) -> Column:
    """White space collapsed, cut to `most` characters with an ellipsis as the last one."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def formula_guarded(text: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r", "\n"), F.concat(F.lit("'"), text)).otherwise(text)


def printable_share(text: Column) -> Column:
    controls = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
    bad = F.length(text) - F.length(F.regexp_replace(text, controls, ""))
    return F.when(~text.rlike(controls), 1.0).otherwise(1 - bad / F.length(text))


def sniffed(content: Column) -> Column:
    """struct(is_text, encoding, warned) of a binary sample."""
    of = lambda t, e, w: F.struct(F.lit(t).alias("is_text"), e.cast("string").alias("encoding"), F.lit(w).alias("warned"))
    null = F.lit(None)

    def of_parts(x: Column) -> Column:
        utf8 = F.when(x["head"] == "EFBBBF", "utf-8-bom").otherwise("utf-8")
        return (
            F.when(x["head"] == "", of(True, F.lit("utf-8"), False))
            .when(x["head"].startswith("FFFE"), of(True, F.lit("utf-16le"), False))
            .when(x["head"].startswith("FEFF"), of(True, F.lit("utf-16be"), False))
            .when(x["body"].contains("\0"), of(False, null, False))
            .when(x["valid"] & (x["share"] >= 0.85), of(True, utf8, False))
            .when(~x["valid"] & (x["share"] >= 0.9), of(True, utf8, True))
            .otherwise(of(False, null, False))
        )

    # lambdas bind what several tests use: first the bytes behind a mark, then what is known of them
    head = F.hex(F.substring(content, 1, 3))
    body = F.when(head == "EFBBBF", F.substring(content, 4, 2**31 - 5)).otherwise(content).cast("string")
    read = lambda b: F.struct(F.is_valid_utf8(b).alias("valid"), F.when(F.is_valid_utf8(b), b).otherwise(F.make_valid_utf8(b)).alias("body"))
    known = lambda x: F.struct(head.alias("head"), x["body"].alias("body"), x["valid"].alias("valid"), printable_share(x["body"]).alias("share"))
    return F.get(F.transform(F.transform(F.transform(F.array(body), read), known), of_parts), 0)


#: The characters that Windows-1252 has in place of the control characters 80 to 9F; five codes stay controls.
WINDOWS_1252 = (
    "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f"
    "\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"
)


def _utf16(content: Column) -> Column:
    """Bytes that begin with a mark of UTF-16 as text, with U+FFFD for each surrogate that stands alone and for a rest of one byte.

    Spark's decode raises at these, so they are put right before, in patterns over bytes as characters.
    """

    def read(charset: str, unit: str, new: str) -> Column:
        high, low, any_ = (unit.replace("?", x) for x in (r"[\xD8-\xDB]", r"[\xDC-\xDF]", r"[\xD8-\xDF]"))
        sound = f"(?:{unit.replace('?', r'[^\xD8-\xDF]')}|{high}{low})*+"  # possessive: no recursion over long texts
        body = F.substring(content, 3, 2**31 - 3)
        chars = F.decode(body, "ISO-8859-1")
        mended = F.regexp_replace(chars, rf"(?s)\G({sound})(?:{high}.?\z|{any_}|.\z)", f"$1{new}")
        return F.decode(F.when(chars.rlike(rf"(?s)\A{sound}\z"), body).otherwise(F.encode(mended, "ISO-8859-1")), charset)

    little = F.hex(F.substring(content, 1, 2)) == "FFFE"
    return F.when(little, read("UTF-16LE", ".?", "\xfd\xff")).otherwise(read("UTF-16BE", "?.", "\xff\xfd"))


def decoded(content: Column) -> Column:
    """struct(text, encoding, fallback) of whole bytes: by their mark, else UTF-8 where valid, else Windows-1252.

    Newlines become line feeds.
    """
    head = F.hex(F.substring(content, 1, 3))
    little, big, marked = head.startswith("FFFE"), head.startswith("FEFF"), head == "EFBBBF"
    wide = little | big
    rest = F.when(marked, F.substring(content, 4, 2**31 - 5)).otherwise(content)
    valid = F.is_valid_utf8(rest.cast("string"))
    single = F.translate(F.decode(rest, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), WINDOWS_1252)
    body = F.when(wide, _utf16(F.when(wide, content))).when(valid, rest.cast("string")).otherwise(single)
    encoding = F.when(little, "utf-16le").when(big, "utf-16be").when(~valid, "windows-1252").when(marked, "utf-8-bom").otherwise("utf-8")
    return F.struct(normalize_newlines(body).alias("text"), encoding.alias("encoding"), (~wide & ~valid).alias("fallback"))


def escaped(text: Column) -> Column:
    """Text that Markdown shows as it is: angle brackets and ampersands as entities, a backslash before marks."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return F.regexp_replace(text, r"[\\*_\[\]#]", r"\\$0")


def is_iso(text: Column) -> Column:
    """Whether a text is a UTC time with milliseconds in the one form that timestamps are written in."""
    shaped = F.coalesce(text.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z\z"), F.lit(False))
    plain = F.substring(text, 1, 23)
    read = F.try_to_timestamp(F.when(shaped, plain), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return shaped & F.coalesce(F.date_format(read, "yyyy-MM-dd'T'HH:mm:ss.SSS") == plain, F.lit(False))


def human_bytes(size: Column) -> Column:
    """A size in B, KB, MB or GB with two decimals at most and groups of thousands."""

    def shown(value: Column, unit: str) -> Column:
        two = F.format_number(F.round(value, 2), 2)
        return F.concat(F.regexp_replace(F.regexp_replace(two, "0+$", ""), r"\.$", ""), F.lit(f" {unit}"))

    return (
        F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, shown(size / (1 << 10), "KB"))
        .when(size < 1 << 30, shown(size / (1 << 20), "MB")).otherwise(shown(size / (1 << 30), "GB"))
    )


#: Dashes and quotes that have a plain form.
PLAIN = {"\u2013": "-", "\u2014": "-", "\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'"}
#: Characters in a line of a preview, lines on its page.
LINE_WIDTH, PAGE_LINES = 88, 46


def ascii_folded(text: Column, keep: str = "") -> Column:
    """Text in plain ASCII: marks taken off letters, plain dashes and quotes, a question mark for the rest.

    Characters in keep, a part of a pattern's set, stay. Only texts beyond ASCII are sent to Python, which knows compatibility
    forms; Spark wants its result in a column of its own before lambdas such as those of `wrapped` read it.
    """
    import unicodedata

    import regex

    @F.pandas_udf("string")
    def bare(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else regex.sub(r"\p{M}", "", unicodedata.normalize("NFKD", t)))

    wide = text.rlike(r"[^\x00-\x7F]")
    flat = F.translate(F.when(wide, bare(F.when(wide, text))).otherwise(text), "".join(PLAIN), "".join(PLAIN.values()))
    return F.regexp_replace(flat, rf"[^\x20-\x7E{keep}]", "?")


def wrapped(text: Column, width: int = LINE_WIDTH) -> Column:
    """Lines of at most so many characters, cut between words; a longer word has a line of its own, an empty line stays.

    Each part of a line is a shortest run of words that the next word would overfill: a pattern finds them in one pass.
    """
    lines = F.split(normalize_newlines(text), "\n", -1)
    flat = F.transform(lines, lambda p: F.trim(F.regexp_replace(p, r"[ \t\x0B\f\x{85}\p{Z}]+", " ")))
    pieces = rf"[^ ](?:.{{0,{width - 2}}}[^ ])?(?= |\z)|[^ ]+"
    return F.flatten(F.transform(flat, lambda p: F.when(p == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(p, F.lit(pieces), F.lit(0)))))


def preview_pages(text: Column) -> Column:
    """Arrays of the lines on each page of a preview; the empty text has one empty line, null has no pages."""

    def pages(lines: Column) -> Column:
        last = F.floor((F.size(lines) - 1) / PAGE_LINES).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(lines, i * PAGE_LINES + 1, PAGE_LINES))

    return F.get(F.transform(F.array(wrapped(text)), pages), 0)  # the outer lambda binds the lines, so they are cut once
