"""SentencePiece encoding and decoding (merge-type models) through a table of prefixes.

A merge-type model joins the adjacent pair whose whole has the highest score, leftmost first, until no pair has one. For
each prefix of a text the last token of its encoding is unique: it is the one token that ends there and fits the last
token of the prefix before it. Two tokens fit if the merges that make them never join across their border; this is
decided by walking both tokens' own merges in the order of their scores. So the table is filled in one pass over the
matches of an automaton of all pieces, in time that grows with the text, and the ids are read from it backwards.

Where two letters stand next to each other in no piece, no merge ever joins across, so the model itself tells where texts
may be cut; the table is filled part by part, and the words and parts seen lately are remembered. Characters that are in
no piece are encoded as their UTF-8 bytes.

The model (a fixed file of less than a MB) is read on the driver and broadcast; texts are encoded where they lie, without
a shuffle. Null and empty texts give the begin and end ids only and an empty decoded text; ties between equal scores go
to the leftmost pair; rows with the same id or text are encoded one by one; a text of any length is encoded whole, its
table holds one word at a time; an empty table gives an empty result; ids of any type pass through; columns other than
the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .tasks import map_slices

#: The letter that stands for a space, and the kinds of pieces of the published model format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose ids a worker keeps in each of two generations (of pairs of tokens that fit or not four times as many), and
#: letters of the longest.
KEPT, LONG = 250_000, 64
NEVER = 1 << 62


def fields(data: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        n = {1: 8, 2: None, 5: 4}[kind]
        n = varint() if n is None else n
        yield number, data[at : at + n]
        at += n


class Recent(dict):
    """Values made by a function and kept in two generations: the older one is dropped when the younger is full."""

    def __init__(self, make, kept: int = KEPT):
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key):
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if type(key) is int or len(key) <= LONG:
            self[key] = value
        return value


class Pieces:
    """A merge-type SentencePiece model with byte fallback and without text normalisation."""

    def __init__(self, raw: bytes):
        strings, scores, kinds, trainer, normalizer = [], [], [], {}, {}
        for number, value in fields(raw):
            if number == 1:
                own = dict(fields(value))
                strings.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own.get(2, bytes(4)))[0])
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        wanted = {"a merge-type model": trainer.get(3, 1) == 2, "byte fallback": trainer.get(35, 0) == 1 and kinds.count(BYTE) == 256, "no user-defined or unused pieces": not {USER, UNUSED} & set(kinds)}
        wanted |= {"no normalisation": not normalizer.get(2) and not normalizer.get(4, 1), "escaped spaces": normalizer.get(5, 1) == 1, "spaces before words": not trainer.get(24, 0)}
        if missing := [k for k, met in wanted.items() if not met]:
            raise ValueError(f"the model needs {', '.join(missing)}")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.begin, self.end = (i.to_bytes(4, "little") for i in (trainer.get(41, 1), trainer.get(42, 2)))
        self.normal = [k == NORMAL for k in kinds]
        bytes_at = {int(s[3:5], 16): i for i, (s, k) in enumerate(zip(strings, kinds, strict=True)) if k == BYTE}
        self._decoding(strings, kinds, bytes_at, trainer.get(44, " ⁇ ".encode()))
        order = {s: i for i, s in enumerate(sorted({x for x, n in zip(scores, self.normal, strict=True) if n}, reverse=True))}
        #: What joining two symbols to this string ranks: the least is joined first.
        self.rank = {s: order[x] for s, x, n in zip(strings, scores, self.normal, strict=True) if n}
        self.tokens = [s if n else "" for s, n in zip(strings, self.normal, strict=True)]
        self.fallback = lambda c: b"".join(bytes_at[b].to_bytes(4, "little") for b in c.encode())
        self.ids = [i.to_bytes(4, "little") for i in range(len(strings))]
        letters = {c for s in self.rank for c in s}
        for c in sorted(letters - set(self.rank)):  # a letter that pieces hold but that is none itself
            self.tokens.append(c)
            self.ids.append(self.fallback(c))
        automaton = ahocorasick.Automaton()
        for i, s in enumerate(self.tokens):
            if s:
                automaton.add_word(s, (i, len(s)))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.known, self.pairs = letters, {s[i : i + 2] for s in self.rank for i in range(len(s) - 1)}
        apart = not any(p[1] == SPACE != p[0] for p in self.pairs)  # no piece goes on past the end of a word
        ends = "".join(c for c in "\t\n\r" if c not in letters)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+|(?s:.)" if apart else "(?s:.+)").findall
        self.merges = Recent(self._merges)
        self.fits = Recent(self._fits, 4 * KEPT)
        self.part = Recent(self._part)
        self.word = Recent(lambda word: b"".join(map(self.part.__getitem__, self.parts(word))))

    def _merges(self, token: int):
        """Ranks of the merges that make the token in their order, and its first and last symbol before, between and after them; None if its letters give other tokens."""
        symbols = list(self.tokens[token])
        ranks, firsts, lasts = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            best, i = min((self.rank.get(symbols[i] + symbols[i + 1], NEVER), i) for i in range(len(symbols) - 1))
            if best == NEVER:
                return None
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            ranks.append(best)
            firsts.append(symbols[0])
            lasts.append(symbols[-1])
        return [*ranks, NEVER], firsts, lasts

    def _fits(self, pair: int) -> bool:
        """Whether the two tokens' letters in one line are encoded as these two tokens; of the first token alone if there is none before."""
        before, token = divmod(pair, len(self.tokens))
        own = self.merges[token]
        if own is None or before == len(self.tokens):
            return own is not None
        ranks, firsts, _ = own
        theirs, _, lasts = self.merges[before]
        i = j = 0
        while True:
            left, right, across = theirs[i], ranks[j], self.rank.get(lasts[i] + firsts[j], NEVER)
            if across < left and across <= right:
                return False
            if left == right == NEVER:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def parts(self, word: str) -> list[str]:
        """The word cut between letters that stand next to each other in no piece."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def table(self, part: str) -> list[tuple[int, int]]:
        """The last token of each prefix of a part and its number of letters; that of the empty prefix is at -1."""
        fits, size = self.fits, len(self.tokens)
        last = [None] * len(part)
        last.append((size, 0))
        for end, match in self.matches(part):
            if last[end] is None:
                token, n = match
                before = last[end - n]
                if before is not None and fits[before[0] * size + token]:
                    last[end] = match
        return last

    def _part(self, part: str) -> bytes:
        if part[0] not in self.known:
            return self.fallback(part)
        last, out, at = self.table(part), [], len(part) - 1
        while at >= 0:
            token, n = last[at]
            out.append(self.ids[token])
            at -= n
        return b"".join(out[::-1])

    def encode(self, text: str | None) -> bytes:
        """Ids with the begin and end ids, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        words = self.words(self.prefix + text.replace(" ", SPACE))
        return b"".join([self.begin, *map(self.word.__getitem__, words), self.end])

    def _decoding(self, strings: list[str], kinds: list[int], bytes_at: dict[int, int], unknown: bytes) -> None:
        self.byte = dict(zip(bytes_at.values(), bytes_at.keys(), strict=True))
        shown = {CONTROL: lambda _: b"", UNKNOWN: lambda _: unknown}
        self.shown = [shown.get(k, lambda s: s.replace(SPACE, " ").encode())(s) for s, k in zip(strings, kinds, strict=True)]
        for i, b in self.byte.items():
            self.shown[i] = bytes([b])
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.breaks = np.array([k == CONTROL for k in kinds])
        self.spaced = {i for i, (s, k) in enumerate(zip(strings, kinds, strict=True)) if k == NORMAL and s.startswith(SPACE)}

    def decode(self, ids: bytes) -> str:
        """The text of ids; a byte that belongs to no character is shown as U+FFFD."""
        found = np.frombuffer(ids, "<u4")
        broken = self.breaks[found[1:-1]].any()  # a control id between bytes keeps them apart
        found = found.tolist()
        cut = self.prefix and next((i for i in found if i not in self.control), None) in self.spaced
        data = b"".join(map(self.shown.__getitem__, found))
        try:
            if not broken:
                return data.decode()[bool(cut) :]
        except UnicodeDecodeError:
            pass
        return "".join(self._stretches(found))[bool(cut) :]

    def _stretches(self, found: list[int]):
        """Texts of tokens, where bytes next to each other are read together."""
        at = 0
        while at < len(found):
            to = at
            while to < len(found) and found[to] in self.byte:
                to += 1
            if to == at:
                yield self.shown[found[at]].decode()
                at += 1
                continue
            run = bytes(self.byte[i] for i in found[at:to])
            while run:
                size = next((n for n in range(1, 5) if _is_character(run[:n])), 0)
                yield run[:size].decode() if size else "�"
                run = run[size or 1 :]
            at = to


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


_MODELS: dict[int, Pieces] = {}


def _model(raw) -> Pieces:
    """One model a worker."""
    key = hash(raw.value)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Pieces(raw.value)
    return _MODELS[key]


def piece_round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded text of each row of df; a narrow operation."""
    with open(model, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    own = df.schema[id_col]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(raw)
        ids = [model.encode(t) for t in part.column(1).to_pylist()]
        columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.string())]
        return pa.record_batch(columns, names=["id", "n_tokens", "ids", "decoded"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([StructField("id", own.dataType), StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", StringType())])
    return map_slices(rows, run, schema, 128).withColumnRenamed("id", id_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = piece_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
