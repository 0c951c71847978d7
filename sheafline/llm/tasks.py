"""Small helpers shared by the operators: batches inside tasks, written intermediate tables."""

from __future__ import annotations

import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

#: Rows and bytes of text a task handles at once, so that memory follows these and not the size of a partition.
SLICE, SLICE_BYTES = 1024, 1 << 18


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most so many rows, and so many bytes in the second column unless one row has more."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = SLICE, size: int = SLICE_BYTES) -> DataFrame:
    """Apply fn to small slices of each Arrow batch, the second column being the text; a narrow operation."""

    def run(batches):
        for part in slices(batches, rows, size):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the cluster names none and is this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sheafline-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Lets Spark delete the shuffle files of a job when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds the bytes that Spark hands to a Python worker at once; 10,000 rows of long texts may be very large.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, gives Spark true sizes.

    The shuffle files of the job that wrote it are of no more use and go at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    wanted = {CLEANUP: "true", ARROW_BYTES: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows doc (long, in the order of the ids) and text with an id, and a table doc, id where ids are no integers.

    Integers are their own numbers. Other ids are sorted and numbered once, in a written table.
    """
    kind = docs.schema[id_col].dataType
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text")
    if isinstance(kind, IntegralType):
        return docs.select(own.cast("long").alias("doc"), text).filter("doc is not null"), None
    names = docs.select(own.alias("id")).filter("id is not null").distinct().orderBy("id")
    names = written(names.select(F.monotonically_increasing_id().alias("doc"), "id"), "ids")
    return docs.select(own.alias("id"), text).join(names, "id").select("doc", "text"), names


def plain_id(fn):
    """Let an operator take id columns whose names hold dots or backticks: the column has a plain name while it works."""
    takes = inspect.signature(fn)

    @functools.wraps(fn)
    def run(*args, **named):
        given = takes.bind(*args, **named)
        given.apply_defaults()
        docs, own = next(iter(given.arguments.values())), given.arguments["id_col"]
        if not {".", "`"} & set(own):
            return fn(*args, **named)
        name = "plain_id"
        while name in docs.columns:
            name += "_"
        given.arguments[next(iter(given.arguments))], given.arguments["id_col"] = docs.withColumnRenamed(own, name), name
        return fn(*given.args, **given.kwargs).withColumnRenamed(name, own)

    return run


def by_id(docs: DataFrame, id_col: str, found: DataFrame, names: DataFrame | None) -> DataFrame:
    """docs with the columns of found (one row for each doc) beside them, null where there is none; doc itself goes."""
    if names is not None:
        found = found.join(names, "doc").drop("doc")
    else:
        found = found.withColumnRenamed("doc", "id")
    found = found.withColumnRenamed("id", "__id")
    return docs.join(found, F.col(f"`{id_col}`") == F.col("__id"), "left").drop("__id")


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with a table that holds each key once, with the number of rows that the key may have in column weight.

    Fewer than SHARES keys can have more than total / SHARES rows each; these are broadcast, so that no task gets all
    rows of one. Other keys are shuffled.
    """
    hot = F.col(weight) > max(1, total // SHARES)
    few, rest = table.filter(hot), table.filter(~hot)
    left = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(few), keys).unionByName(left)


SHARES = 1024


class Words(NamedTuple):
    """Words of a slice of texts: the texts' bytes in one line, where words begin and end there, words by text, 64-bit hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one line, and where each begins (and the last ends); null is empty."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_binary())
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    line = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.empty(0, np.uint8)
    return line, places - places[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words_in(column: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of anything but space and U+0009 to U+000D in each text."""
    data, places = bytes_of(column)
    if lower:
        data = LOWER[data]
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = places[1:-1][(places[1:-1] > 0) & (places[1:-1] < len(data))]  # words do not run on into the next text
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.diff(np.searchsorted(starts, places)), span_hashes(data, starts, ends))


#: Bytes hashed at once; words of more than LONG bytes are hashed by xxhash, one by one.
_BLOCK, LONG = 1 << 17, 256
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(_BLOCK, _BASE, np.uint64), dtype=np.uint64)
_INVERSE = np.cumprod(np.full(_BLOCK, pow(_BASE, -1, 2**64), np.uint64), dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of bytes: polynomials over a random value for each byte, from running sums."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + _BLOCK, "right")))
        if ends[to - 1] - begin <= _BLOCK:
            line = _BYTE[data[begin : ends[to - 1]]]
            line *= _POWERS[: len(line)]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(line, dtype=np.uint64)))
            a = starts[at:to] - begin
            out[at:to] = (sums[ends[at:to] - begin] - sums[a]) * _INVERSE[a]
        at = to
    out = mix(out)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and U+0009 to U+000D, as UTF-8."""
    return text.encode().split() if text else []


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive tokens, by doubling: the hash of a run joins those of its two parts."""
    if len(tokens) < k:
        return np.empty(0, np.uint64)
    have, done, out, out_len = tokens, 1, None, 0
    bits = k
    while True:
        if bits & 1:
            part = have
            if out is None:
                out, out_len = part, done
            else:
                m = len(tokens) - out_len - done + 1
                out = mix(out[:m] * MULTIPLIER + part[out_len : out_len + m])
                out_len += done
        bits >>= 1
        if not bits:
            return out
        m = len(have) - done
        have = mix(have[:m] * MULTIPLIER + have[done : done + m] + np.uint64(done))
        done *= 2
