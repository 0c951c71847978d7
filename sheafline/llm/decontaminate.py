"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are dealt into blocks of a bounded number of words; each block is broadcast and gives an automaton, and every
text is streamed through it, tracking the longest match that ends at each word. With several blocks a task holds texts of
HELD_BYTES and streams them through one automaton after the other, so the texts are read once.

Null and empty texts have no words and no hits; items without words match nothing; repeated items are all reported, and
items with a null id hit like others and are reported as null; an empty benchmark leaves all texts as they are; repeated
rows are matched one by one, so there are no ties; ids of any type, and null ones, pass through; a text of any length is
streamed whole; columns of any name pass through decontaminate, and contamination reads the named ones only.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .tasks import SLICE_BYTES, map_slices, plain_id, slices

#: Words of test items in one automaton; larger benchmarks take several passes.
BLOCK_WORDS = 200_000
#: Rows and bytes of text that a task holds while it goes through several automata.
HELD_ROWS, HELD_BYTES = 16_384, 16 << 20
WINDOW = 10
#: A-Z to lower case; every byte below 0x80 that is no digit or letter to space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Automaton:
    """Generalised suffix automaton of word sequences with the items behind each state."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        texts = []
        for item, text in items:
            words = (text or "").encode().translate(TO_WORDS).split()
            if words:
                texts.append((item, [self.ids.setdefault(w, len(self.ids)) for w in words]))
        for _, seq in texts:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.items: list[set[str]] = [set() for _ in self.next]
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for item, seq in texts:
            state = 0
            for c in seq:
                state = self.next[state][c]
                v = state
                while self.len[v] >= window and item not in self.items[v]:
                    self.items[v].add(item)
                    v = self.link[v]
            if len(seq) < window:
                while self.len[self.link[state]] >= len(seq):
                    state = self.link[state]
                self.short[state].append((len(seq), item))
        self.least = min([window, *(len(seq) for _, seq in texts)])
        # the nearest state on the suffix path, itself included, that is a whole short item
        self.near = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            self.near[v] = v if self.short[v] else self.near[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans covered by windows, and the items whose windows occur."""
        if not self.ids:
            return [], set()
        get = self.ids.get
        seq = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (seq >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for at, to in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if to - at >= self.least:
                self._stream(seq[at:to].tolist(), at, spans, found)
        return spans, found

    def _stream(self, seq: list[int], at: int, spans: list, found: set) -> None:
        nxt, link, length, window, near = self.next, self.link, self.len, self.window, self.near
        v = matched = 0
        for i, c in enumerate(seq, at):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c not in nxt[v]:
                continue
            v = nxt[v][c]
            matched += 1
            longest = 0
            if matched >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                found |= self.items[u]
                longest = window
            s = near[v]
            while s > 0:
                for n, item in self.short[s]:
                    if n <= matched:
                        found.add(item)
                        longest = max(longest, n)
                s = near[link[s]]
            if longest:
                if spans and spans[-1][1] >= i - longest + 1:
                    while spans and spans[-1][1] >= i - longest + 1:
                        start = min(spans.pop()[0], i - longest + 1)
                    spans.append((start, i + 1))
                else:
                    spans.append((i - longest + 1, i + 1))


_AUTOMATA: dict[str, Automaton] = {}


def _automaton(key: str, items: Broadcast, window: int) -> Automaton:
    """The automaton of a block; a worker keeps the last one."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(items.value, window)
    return _AUTOMATA[key]


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_words: int):
    """Test items in blocks of about block_words words; one block at a time is on the driver."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (5 * block_words)))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for b in range(n):
        rows = items.filter(F.col("block") == b).select("item", "text").collect()
        if rows:
            yield [(r.item, r.text) for r in rows]


def _matcher(docs: DataFrame, bench: DataFrame, window: int, item_col: str, text_col: str, block_words: int):
    """A function from a list of texts to (number of words, spans, items) of each; every block is loaded once for the list."""
    sc = docs.sparkSession.sparkContext
    blocks = [(sc.broadcast(rows), hashlib.sha256(repr((rows, window)).encode()).hexdigest()) for rows in _blocks(bench, item_col, text_col, block_words)]

    def match(texts: list[str | None]) -> list[tuple[int, list, list]]:
        words = [t.encode().translate(TO_WORDS).split() if t else [] for t in texts]
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        for shared, key in blocks:
            automaton = _automaton(key, shared, window)
            for i, own in enumerate(words):
                got, found = automaton.match(own)
                if got:
                    spans[i] = _merged(spans[i] + got) if spans[i] else got
                items[i] |= found
        return [(len(w), s, sorted(f, key=lambda x: (x is None, x))) for w, s, f in zip(words, spans, items, strict=True)]

    return match, HELD_BYTES if len(blocks) > 1 else SLICE_BYTES


@plain_id
def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, n_words, spans (of words, half open, disjoint) and items of each row of docs, in one pass over the texts."""
    match, held = _matcher(docs, bench, window, item_col, item_text_col, block_words)
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([rows.schema[0], StructField("n_words", LongType()), StructField("spans", ArrayType(span)), StructField("items", ArrayType(StringType()))])
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = match(part.column(1).to_pylist())
        spans = [[{"start": a, "end": b} for a, b in s] for _, s, _ in found]
        return pa.record_batch([part.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, kinds[0]), pa.array([i for _, _, i in found], kinds[1])], names=schema.names)

    return map_slices(rows, run, schema, HELD_ROWS, held)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw)]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode(errors="ignore")


def decontaminate(docs: DataFrame, bench: DataFrame, max_coverage: float = 0.5, min_words: int = 1, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the spans of at least min_words words; rows of which more than max_coverage is hit go.

    Whole rows pass through, whatever their columns are called; n_chars, where there is one, follows a changed text.
    """
    match, held = _matcher(docs, bench, window, item_col, item_text_col, block_words)
    at, schema = docs.columns.index(text_col), docs.schema
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            two = pa.record_batch([batch.column(at), batch.column(at)], names=["id", "text"])
            done = 0
            for part in slices(iter([two]), HELD_ROWS, held):
                own = batch.slice(done, part.num_rows)
                done += part.num_rows
                texts, keep, changed = part.column(1).to_pylist(), [], []
                for i, (n_words, spans, _) in enumerate(match(texts)):
                    spans = [(a, b) for a, b in spans if b - a >= min_words]
                    keep.append(sum(b - a for a, b in spans) <= max_coverage * n_words)
                    if spans:
                        texts[i] = cut_spans(texts[i], spans)
                        changed.append(i)
                columns = list(own.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None and changed:
                    sizes = columns[chars].to_pylist()
                    for i in changed:
                        sizes[i] = len(texts[i])
                    columns[chars] = pa.array(sizes, columns[chars].type)
                yield pa.record_batch(columns, names=[f"c{i}" for i in range(len(columns))]).filter(pa.array(keep))

    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*docs.columns)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, bench)
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN grams g ON p.n = g.n AND p.gram = g.gram),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, n)) AS v(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
