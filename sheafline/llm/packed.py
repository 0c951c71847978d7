"""Shuffles of packed arrays: many small records travel as few binary rows, and tasks work on them as NumPy columns.

A task gathers records and deals them into parts; each part's columns become one binary value. Spark shuffles these
values by part, and the task that owns a part reads all its columns. A record costs its bytes, not a row.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, kind int, data binary"


def pack(columns: list[np.ndarray], payload: bytes = b"") -> bytes:
    """Columns of one length, each in the least integer type that holds it, and bytes behind them."""
    out = [struct.pack("<QB", len(columns[0]), len(columns))]
    for c in columns:
        if len(c) and (c.dtype.kind == "u" or c.dtype.kind == "i" and c.min() >= 0):
            c = c.astype(np.min_scalar_type(int(c.max())))
        out += [c.dtype.char.encode(), np.ascontiguousarray(c).tobytes()]
    return b"".join([*out, payload])


def unpack(data: bytes) -> tuple[list[np.ndarray], memoryview]:
    n, width = struct.unpack_from("<QB", data)
    at, out = 9, []
    for _ in range(width):
        kind = np.dtype(chr(data[at]))
        out.append(np.frombuffer(data, kind, n, at + 1))
        at += 1 + n * kind.itemsize
    return out, memoryview(data)[at:]


def joined(values: list[bytes], kinds: list) -> list[np.ndarray]:
    """The columns of all packed values, one behind the other, in the given types."""
    found = [unpack(v)[0] for v in values]
    if not found:
        return [np.empty(0, k) for k in kinds]
    return [np.concatenate(c).astype(k, copy=False) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]


def dealt(part: np.ndarray, kind: int, columns: list[np.ndarray], parts: int, pieces: list[bytes] | None = None) -> pa.RecordBatch:
    """A row for each part that has records; pieces are bytes that go with the records, in order."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows, number = [], []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[p] : cuts[p + 1]]
        rows.append(pack([c[own] for c in columns], b"".join([pieces[i] for i in own.tolist()]) if pieces else b""))
        number.append(p)
    return pa.record_batch([pa.array(number, pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["part", "kind", "data"])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(parts)).astype(np.int64)


def parts_of(df: DataFrame) -> int:
    """Parts of a shuffle: as many as the session's shuffles have partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def gathered(rows: DataFrame, parts: int, fn: Callable[[dict[int, list[bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to the packed values of each part, by kind."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(kind, []).append(data)
        if held:
            yield from fn(held)

    return rows.repartitionById(parts, F.col("part")).select("kind", "data").mapInArrow(run, schema)


def rows_of(values: list[bytes], kinds: list, batch: int = 256) -> Iterator[tuple[list, list[bytes]]]:
    """doc and packed columns of each doc (the first column), in batches; other columns are sorted by the second."""
    columns = joined(values, kinds)
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    if not len(order):
        return
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(columns[0])) + 1, [len(order)])).tolist()
    docs, found = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        docs.append(int(columns[0][a]))
        found.append(pack([c[a:b] for c in columns[1:]]))
        if len(docs) == batch:
            yield docs, found
            docs, found = [], []
    if docs:
        yield docs, found


def by_doc(rows: DataFrame, parts: int, kinds: list) -> DataFrame:
    """doc and data (the packed columns but the first, which is doc) of each document in packed rows dealt by document."""

    def fn(held):
        for docs, found in rows_of([v for values in held.values() for v in values], kinds):
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(found, pa.binary())], names=["doc", "data"])

    return gathered(rows, parts, fn, "doc long, data binary")
