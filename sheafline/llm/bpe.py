"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

The vocabulary is read from a tokenizer file on the driver (a fixed file of a few MB) and broadcast; texts are
encoded where they lie, without a shuffle. Null and empty texts give no tokens and an empty decoded text; ties
between equal ranks go to the leftmost pair; rows with the same id or text are encoded one by one; columns other
than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import map_slices, plain_id

#: Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps in each of its two generations.
KEPT = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with its merges."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.strings: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for at, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 32 | vocab[b], at)
            self.merged.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        by_length = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")").split if by_length else None
        self.pieces = regex.compile(PATTERN).findall
        self.cache = _Pieces(self)

    def merge(self, data: bytes) -> list[int]:
        """Join the pair of lowest rank, leftmost first, until no pair has a rank."""
        first, rank, merged = self.first, self.rank.get, self.merged
        sym = [first[b] for b in data]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [-1] * n  # rank of the pair that starts here; queue entries with another rank are stale
        queue = []
        for i in range(n - 1):
            r = rank(sym[i] << 32 | sym[i + 1])
            if r is not None:
                now[i] = r
                queue.append(r << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if now[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            sym[i], sym[j], now[j] = merged[r], -1, -1
            q = None
            if k < n:
                before[k] = i
                q = rank(sym[i] << 32 | sym[k])
            if q is None:
                now[i] = -1
            else:
                now[i] = q
                heapq.heappush(queue, q << 32 | i)
            h = before[i]
            if h >= 0:
                q = rank(sym[h] << 32 | sym[i])
                if q is None:
                    now[h] = -1
                else:
                    now[h] = q
                    heapq.heappush(queue, q << 32 | h)
        return [s for s in sym if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.cache.__getitem__
        if self.split_added is None:
            return b"".join(map(get, self.pieces(text)))
        out = []
        for at, part in enumerate(self.split_added(text)):
            if at % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out.extend(map(get, self.pieces(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


class _Pieces(dict):
    """Ids of pieces seen lately, in two generations: the older one is dropped when the younger is full."""

    def __init__(self, codec: Codec):
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None:
            value = b"".join([i.to_bytes(4, "little") for i in self.codec.merge(piece.encode())])
        if len(piece) <= 64:
            self[piece] = value
        return value


_CODECS: dict[int, Codec] = {}


def _codec(raw) -> Codec:
    """One codec a worker."""
    key = hash(raw.value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw.value)
    return _CODECS[key]


@plain_id
def bpe_round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded text of each row of df."""
    with open(tokenizer, encoding="utf-8") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(raw)
        ids = [codec.encode(t) if t else b"" for t in part.column(1).to_pylist()]
        return pa.record_batch(
            [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())],
            names=[id_col, "n_tokens", "ids", "decoded"],
        )

    kind = dict(df.dtypes)[id_col]
    return map_slices(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string", 128)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = bpe_round_trip(docs, default_tokenizer())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
