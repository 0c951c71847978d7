"""Suffix-array dedup with run-length Burrows-Wheeler indexes.

Strings of `window` bytes meet by their anchors (see anchors.py): later copies of whole runs of windows go at once, and the
first copies of runs that may share windows with others are gathered by anchor and indexed in blocks. A block's index is
its run-compressed Burrows-Wheeler transform with samples at the ends of runs: the place of the suffix that heads a run,
the place of the suffix that ends the run before, and how many bytes the two share. The pieces are streamed through
the samples: from one sample to the next each place's neighbour moves on by one byte and its match gets one byte shorter,
which gives every place's neighbour and matching statistic. Neighbours with matches of at least `window` bytes form chains
of equal strings, and in each chain the smallest document keeps its bytes. Pieces of one anchor are kept together up to
TOGETHER of them; those of more frequent anchors are halved and meet by the anchor with a third of a window to its right
or left. Halves of which more than TOGETHER meet are cut into their single windows, which meet by their own hashes in
the same kind of index, and of which each task sends one copy only. What only one document has is not indexed.

Null and empty texts have no bytes; texts shorter than a window are kept whole; strings that repeat inside one document
only are kept; rows with a null id are kept whole and are no sources; rows with equal ids count as one document; ties do
not occur, as the smallest id decides and ids that are no integers are numbered in their order; a text of any length is
handled in stretches of about a million bytes, except that the last step holds it whole; an empty table gives an empty
result; columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .anchors import LATE, LATES, PIECE, PIECES, RECORD, located
from .packed import SCHEMA, by_doc, dealt, gathered, joined, part_of, parts_of, unpack
from .tasks import MULTIPLIER, by_id, bytes_of, discard, map_slices, mix, numbered, plain_id, slices, written

WINDOW = 50
ANCHOR = 17
#: Pieces of one anchor that are indexed together; those of anchors with more meet by longer anchors, or else window by window.
TOGETHER = 64
#: Bytes in one index, and bytes of pieces that a task gathers before it sends them.
BLOCK_BYTES, SENT_BYTES = 1 << 17, 8 << 20


def _grams(have: np.ndarray) -> np.ndarray:
    have = have.astype(np.uint64)
    for done in (1, 2, 4):  # eight bytes in one integer
        have = have[:-done] | (have[done:] << np.uint64(8 * done)) if len(have) > done else have[:0]
    n = len(have) - (ANCHOR - 8)  # three overlapping parts of eight bytes make an anchor
    return mix(mix(have[:n] * MULTIPLIER + have[8 : 8 + n]) * MULTIPLIER + have[ANCHOR - 8 :]) if n > 0 else have[:0]


def _tokenise(column: pa.Array):
    data, places = bytes_of(column)
    return lambda a, b: _grams(data[a:b]), np.diff(places)


def _order(rank: np.ndarray, ahead: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places own in the order of (rank, ahead), and which of them differ from the one before; numbers have at most width bits."""
    if 3 * width <= 63:  # all three in one integer, which sorts much faster than an index
        key = np.sort(rank << 2 * width | ahead << width | own)
        return key & ((1 << width) - 1), np.concatenate(([True], key[1:] >> width != key[:-1] >> width))
    sort = np.lexsort((ahead, rank))
    rank, ahead = rank[sort], ahead[sort]
    return own[sort], np.concatenate(([True], (rank[1:] != rank[:-1]) | (ahead[1:] != ahead[:-1])))


def suffix_array(text: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; suffixes end at separators (255), which differ and sort by their place."""
    n = len(text)
    at = np.arange(n)
    rank = np.where(text == 255, 256 + piece, text)
    width = max(n, 256 + int(piece[-1]) + 1).bit_length()
    order, new = _order(rank, np.append(rank[1:], 0), at, width)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0)) + 1
    h = 2
    while h < n:
        open_ = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))  # places in the order that still tie with others
        if not len(open_):
            break
        own = order[open_]
        ahead = np.where(own + h < n, rank[np.minimum(own + h, n - 1)], 0)
        own, new[open_] = _order(rank[own], ahead, own, width)
        order[open_] = own
        rank[own] = np.maximum.accumulate(np.where(new[open_], open_, 0)) + 1
        h *= 2
    return order


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of pieces, with samples at the ends of its runs; the suffix array is not kept."""

    def __init__(self, pieces: list[bytes]):
        self.text = text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)  # no byte of UTF-8 is 255
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        self.ends = ends = np.cumsum(self.sizes) - 1
        self.piece = piece = np.repeat(np.arange(len(pieces)), self.sizes)
        order = suffix_array(text, piece)
        before = text[order - 1].astype(np.int64)
        apart = before == 255
        before[apart] = 256 + piece[order - 1][apart]  # separators differ
        head = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.letters, self.lengths = before[head], np.diff(np.append(head, len(text)))
        sample, previous = order[head], order[head - 1]
        match = self._shared(sample, previous)
        match[0] = 0  # nothing stands before the first suffix
        by_place = np.argsort(sample)
        self.sample, self.previous, self.match = sample[by_place], previous[by_place], match[by_place]

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, up to the ends of their pieces."""
        limit = np.minimum(self.ends[self.piece[a]] - a, self.ends[self.piece[b]] - b)
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(limit > 0)
        while len(live):
            live = live[self.text[a[live] + out[live]] == self.text[b[live] + out[live]]]
            out[live] += 1
            live = live[limit[live] > out[live]]
        return out

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """The neighbour and the matching statistic of every place, streamed from each sample to the next one."""
        last = np.repeat(np.arange(len(self.sample)), np.diff(np.append(self.sample, len(self.text))))
        step = np.arange(len(self.text)) - self.sample[last]
        return self.previous[last] + step, np.maximum(self.match[last] - step, 0)


def late_windows(pieces: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (piece, offset, number) of windows that a piece of a smaller document has too."""
    index = RunIndex(pieces)
    to, match = index.stream()
    linked = np.flatnonzero(match >= window)
    root = np.arange(len(to))
    root[linked] = to[linked]
    while True:  # chains halve with each step
        further = root[root[linked]]
        if np.array_equal(further, root[linked]):
            break
        root[linked] = further
    own = docs[index.piece]
    least = own.copy()
    np.minimum.at(least, root[linked], own[linked])
    tops = np.unique(root[linked])
    late = np.sort(np.concatenate((linked[least[root[linked]] < own[linked]], tops[least[tops] < own[tops]])))
    if not len(late):
        return late, late, late
    cut = np.flatnonzero((np.diff(late) != 1) | (index.piece[late[1:]] != index.piece[late[:-1]])) + 1
    starts, stops = late[np.concatenate(([0], cut))], late[np.concatenate((cut - 1, [len(late) - 1]))]
    p = index.piece[starts]
    return p, starts - (index.ends[p] - index.sizes[p] + 1), stops - starts + 1


def _late_rows(doc: np.ndarray, start: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    zero = np.zeros(len(doc), np.int64)
    return dealt(part_of(mix(doc.astype(np.int64).view(np.uint64)), parts), LATE, [doc, start, n, zero, zero], parts)


def _hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of bytes, eight bytes at a time."""
    whole = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    whole[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), np.uint64)
    for column in whole.view(np.uint64).T:
        out = mix(out * MULTIPLIER + column)
    return out


def _cut(window: int, parts: int, together: int):
    """Packed pieces, dealt by key, from batches of doc, text and packed places."""

    def run(batches):
        held, size = ([], []), 0  # pieces and single windows, as columns
        for part in slices(batches):
            data, places = bytes_of(part.column(1))
            found = [unpack(x)[0] for x in part.column(2).to_pylist()]
            times = [len(x[0]) for x in found]
            doc, base = (np.repeat(x, times) for x in (part.column(0).to_numpy(), places[:-1]))
            start, n, key, classes = (np.concatenate(c).astype(t) for c, t in zip(zip(*found, strict=True), (np.int64, np.int64, np.uint64, np.int64), strict=True))
            few = classes <= together
            if few.any():
                raw, at, to = data.tobytes(), base + start, base + start + n + window - 1
                pieces = [raw[a:b] for a, b in zip(at[few].tolist(), to[few].tolist(), strict=True)]
                held[0].append((key[few], doc[few], start[few], (to - at)[few], pieces))
                size += int((to - at)[few].sum())
            doc, base, start, n = (c[~few] for c in (doc, base, start, n))
            for at in range(0, len(n), 4096):  # bounds the windows that a text with very many of them holds at once
                d, b, s, m = (c[at : at + 4096] for c in (doc, base, start, n))
                own = np.repeat(s - np.cumsum(m) + m, m) + np.arange(m.sum())
                rows = data[(own + np.repeat(b, m))[:, None] + np.arange(window)]
                held[1].append((_hashes(rows), np.repeat(d, m), own, rows))
                size += rows.size
                if size >= SENT_BYTES:
                    yield from flush(*held)
                    held, size = ([], []), 0
            if size >= SENT_BYTES:
                yield from flush(*held)
                held, size = ([], []), 0
        yield from flush(*held)

    def flush(pieces, windows):
        if windows:  # a task sends a window for its smallest document only
            key, doc, start, rows = (np.concatenate(c) for c in zip(*windows, strict=True))
            order = np.lexsort((doc, key))
            new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            first = order[new][np.cumsum(new) - 1]
            late = (doc[order] > doc[first]) & (rows[order] == rows[first]).all(axis=1)
            gone, stay = order[late], order[~late]
            if len(gone):
                yield _late_rows(doc[gone], start[gone], np.ones(len(gone), np.int64), parts)
            pieces = [*pieces, (key[stay], doc[stay], start[stay], np.full(len(stay), window), rows[stay].view(f"V{window}").ravel().tolist())]
        if pieces:
            *columns, texts = zip(*pieces, strict=True)
            columns = [np.concatenate(c) for c in columns]
            yield dealt(part_of(mix(columns[0]), parts), RECORD, columns, parts, [x for t in texts for x in t])

    return run


def _indexed(window: int, parts: int):
    """Late windows, dealt by document, of the pieces of one part, in blocks of whole keys."""

    def blocks(key: np.ndarray, doc: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        apart = np.minimum.reduceat(doc[order], heads) < np.maximum.reduceat(doc[order], heads)
        order = order[np.repeat(apart, np.diff(np.append(heads, len(order))))]  # a key of one document has nothing to compare
        cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))), [len(order)]))
        ends = np.concatenate(([0], np.cumsum(size[order])))[cuts]
        at = 0
        while at < len(cuts) - 1:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1)
            yield order[cuts[at] : cuts[to]]
            at = to

    def fn(held):
        for v in held.get(LATE, []):
            yield _late_rows(*joined([v], LATES)[:3], parts)
        if RECORD not in held:
            return
        key, doc, start, size = joined(held[RECORD], [np.uint64, np.int64, np.int64, np.int64])
        payload, ends = b"".join(unpack(v)[1] for v in held[RECORD]), np.cumsum(size)
        for block in blocks(key, doc, size):
            once: dict[tuple[int, bytes], int] = {}
            places = zip(doc[block].tolist(), (ends - size)[block].tolist(), ends[block].tolist(), strict=True)
            of = np.array([once.setdefault((d, payload[a:b]), len(once)) for d, a, b in places])
            p, at, n = late_windows([x for _, x in once], np.array([d for d, _ in once], np.int64), window)
            # the ranges of a piece hold for all places where its document has it
            by = np.argsort(of, kind="stable")
            first = np.searchsorted(of[by], p)
            times = np.searchsorted(of[by], p, "right") - first
            row = block[by[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]]
            if len(row):
                yield _late_rows(doc[row], start[row] + np.repeat(at, times), np.repeat(n, times), parts)

    return fn


def late_runs(docs: DataFrame, window: int, together: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """doc and packed spans (start, number, and two unused columns): windows of doc that also start in a smaller one; names of docs."""
    rows, names = numbered(docs, id_col, text_col)
    parts = parts_of(docs)
    found = written(located(rows, _tokenise, window, ANCHOR, False, together), "located")
    asked = by_doc(found.filter(F.col("kind") == PIECE), parts, PIECES)
    pieces = rows.join(asked, "doc").select("doc", "text", "data").mapInArrow(_cut(window, parts, together), SCHEMA)
    late = written(gathered(pieces, parts, _indexed(window, parts), SCHEMA), "late-windows")
    spans = written(by_doc(found.filter(F.col("kind") == LATE).unionByName(late), parts, LATES), "spans")
    discard(found, late)
    return spans, names


@plain_id
def suffix_dedup(docs: DataFrame, window: int = WINDOW, together: int = TOGETHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, removed (disjoint spans of bytes) and kept (bytes) of each row."""
    spans, names = late_runs(docs, window, together, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"))
    own = by_id(rows, id_col, spans.withColumnRenamed("data", "__data"), names).select(f"`{id_col}`", "__text", "__data")
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([own.schema[0], StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(span)), StructField("kept", BinaryType())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, n_removed, removed, kept = [], [], [], []
        for text, data in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            raw = text.encode() if text else b""
            spans = union(*unpack(data)[0][:2], window) if data is not None else []
            left, at = [], 0
            for a, b in spans:
                left.append(raw[at:a])
                at = b
            kept.append(b"".join([*left, raw[at:]]))
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept[-1]))
            removed.append([{"start": a, "end": b} for a, b in spans])
        return pa.record_batch([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, spans_kind), pa.array(kept, pa.binary())], names=schema.names)

    return map_slices(own, run, schema)


def union(start: np.ndarray, n: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Disjoint spans of tokens covered by n windows from each start, given in the order of start."""
    start = start.astype(np.int64)
    reach = np.maximum.accumulate(start + n + window - 1)
    cut = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return list(zip(start[np.concatenate(([0], cut))].tolist(), reach[np.concatenate((cut - 1, [len(start) - 1]))].tolist(), strict=True))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM t, unnest(range(0, n - 49)) AS u(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
bytes AS (SELECT t.doc_id, p, substr(h, 2 * p + 1, 2) AS b FROM t, unnest(range(0, n)) AS u(p)),
gone AS (SELECT bytes.doc_id, p, b, max(late.i) OVER (PARTITION BY bytes.doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS cut FROM bytes LEFT JOIN late ON bytes.doc_id = late.doc_id AND bytes.p = late.i),
edges AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS starts FROM gone),
sums AS (SELECT doc_id, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (WHERE NOT cut) AS kept FROM edges GROUP BY doc_id)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN sums ON t.doc_id = sums.doc_id
"""
