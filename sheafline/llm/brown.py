"""Scoring with a class-based bigram model whose classes come from exchange clustering.

Every word of the training rows gets a class. The `head` most frequent words get theirs by exchange: they start with the
most frequent ones in classes of their own, and in each round half of them are tried in every class against the counts of
class bigrams; the moves that raise the likelihood are made, or, where moves made at once spoil each other, the best half
of them, and so on, so the likelihood never falls. Rounds end when one gains less than TOLERANCE of the likelihood. Every
other word then goes to the class that its own contexts make most likely, against the counts of the exchange. As
history, the words outside the head are one class of their own. A text's probability is the product of smoothed class
transitions and of words in their classes; an unknown word is expected in each class with the share of one unseen word.

What is broadcast or on the driver is bounded by parameters: `head` words and `classes` squared transitions. All other
words stay in a table of packed parts, to which the texts' words are sent and which sends back sums. Words are
identified by 64-bit hashes.

Null and empty texts are one end token; ties in frequency go to the smaller hash, ties between classes to the first; a
null id counts as the empty string when texts are held out; repeated rows are counted and scored one by one; ids may have
any type; a text of any length is read whole by its task; an empty table gives an empty result; without any training
rows every word is unknown; columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .packed import SCHEMA, dealt, gathered, joined, pack, part_of, parts_of, unpack
from .tasks import discard, mix, plain_id, slices, words_in, written

HEAD, CLASSES, ROUNDS, TOLERANCE = 32_768, 96, 20, 0.0005
PRIOR = 0.1
#: Tokens with which a class is thought to have been seen beside its own, when a rare word is put into a class.
SHRINK = 1000.0
#: Stands for the hash of the end token.
END = np.uint64(0x0E4D)
#: Tokens that a task counts together before it sends them.
TOGETHER = 4 << 20
#: Kinds of packed rows.
LEXICON, PAIRS, CONTEXTS, ASKED, ANSWERS, ROWS = range(6)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def tokens_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in one line, each text followed by an end, and the number of tokens of each text."""
    words = words_in(texts, lower=True)
    out = np.full(len(words.hashes) + len(words.lengths), END)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(words.lengths + 1) - 1] = False
    out[inside] = words.hashes
    return out, words.lengths + 1


class Heads:
    """Numbers of the most frequent words by their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.append(hashes, np.uint64(0))  # the last one is never found: its number is -1
        self.bits = np.uint64((1 << max(10, (16 * len(hashes)).bit_length())) - 1)
        self.slot = np.full(int(self.bits) + 1, -1, np.int32)
        at = (hashes & self.bits).astype(np.int64)
        self.slot[at] = np.arange(len(hashes))
        lost = np.flatnonzero(self.slot[at] != np.arange(len(hashes)))  # another word has their slot
        self.crowded = np.zeros(len(self.slot), bool)
        self.crowded[at[lost]] = True
        order = np.argsort(hashes[lost])
        self.lost, self.lost_hashes = lost[order], hashes[lost][order]

    def __len__(self) -> int:
        return len(self.hashes) - 1

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or the number of heads for words that are none."""
        at = (hashes & self.bits).astype(np.int64)
        out = self.slot[at].astype(np.int64)
        out[(out < 0) | (self.hashes[out] != hashes)] = len(self)
        if len(self.lost):
            open_ = np.flatnonzero((out == len(self)) & self.crowded[at])
            place = np.minimum(np.searchsorted(self.lost_hashes, hashes[open_]), len(self.lost) - 1)
            ok = self.lost_hashes[place] == hashes[open_]
            out[open_[ok]] = self.lost[place[ok]]
        return out


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of n for each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def lexicon(rows: DataFrame) -> DataFrame:
    """Packed parts of words: hash and count, from the texts in the second column of rows."""
    parts = parts_of(rows)

    def flush(held):
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return dealt(part_of(mix(words), parts), LEXICON, [words, n], parts)

    def count(batches):
        held, size = [], 0
        for part in slices(batches):
            held.append(tokens_in(part.column(1))[0])
            size += len(held[-1])
            if size >= TOGETHER:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def meet(held):
        words, n = _sums(*joined(held[LEXICON], [np.uint64, np.int64]))
        yield dealt(part_of(mix(words), parts), LEXICON, [words, n], parts)

    return gathered(rows.mapInArrow(count, SCHEMA), parts, meet, SCHEMA)


def _most_frequent(words: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Hashes and counts of the `head` most frequent words, the number of all tokens and of all words.

    Only counts near enough to the top, by a histogram of their logarithms, are sorted.
    """

    def size_of(n: np.ndarray) -> np.ndarray:
        return (np.log2(n) * 32).astype(np.int64)

    def histogram(batches):
        for b in batches:
            for data in b.column(2).to_pylist():
                n = unpack(data)[0][1].astype(np.int64)
                size, at, types = np.unique(size_of(n), return_inverse=True, return_counts=True)
                yield pa.record_batch([pa.array(size), pa.array(types), pa.array(np.bincount(at, n).astype(np.int64))], names=["size", "types", "n"])

    found = words.mapInArrow(histogram, "size long, types long, n long").groupBy("size").agg(F.sum("types").alias("types"), F.sum("n").alias("n")).collect()
    left, least = head, 0
    for r in sorted(found, key=lambda r: -r["size"]):  # at most 32 rows for each bit of a count
        least, left = r["size"], left - r["types"]
        if left <= 0:
            break

    def top(batches):
        for b in batches:
            for data in b.column(2).to_pylist():
                word, n = (c.astype(k) for c, k in zip(unpack(data)[0], (np.uint64, np.int64), strict=True))
                keep = size_of(n) >= least
                yield pa.record_batch([pa.array(word[keep].view(np.int64)), pa.array(n[keep])], names=["word", "n"])

    best = words.mapInArrow(top, "word long, n long").orderBy(F.desc("n"), "word").limit(head).collect()  # bounded: a parameter of the model
    hashes = np.array([r["word"] for r in best], np.int64).view(np.uint64)
    return hashes, np.array([r["n"] for r in best], np.int64), sum(r["n"] for r in found), sum(r["types"] for r in found)


def contexts(rows: DataFrame, shared) -> DataFrame:
    """Packed parts: PAIRS of head words (word, neighbour, count, whether it stands left), and CONTEXTS (hash, word before) of all others."""
    parts = parts_of(rows)

    def flush(held):
        heads: Heads = shared.value
        first, second, rare, before = [], [], [], []
        for hashes in held:
            own = heads.numbers(hashes)
            previous = np.concatenate((heads.numbers(np.array([END])), own[:-1]))
            tail = own == len(heads)
            rare.append(hashes[tail])
            before.append(previous[tail])
            first.append(previous)
            second.append(own)
        a, b = np.concatenate(first), np.concatenate(second)
        pair, n = np.unique(a << 32 | b, return_counts=True)
        a, b = pair >> 32, pair & 0xFFFFFFFF
        for word, other, left in ((a, b, 0), (b, a, 1)):
            own = word < len(heads)
            yield dealt(word[own] % parts, PAIRS, [word[own], other[own], n[own], np.full(own.sum(), left)], parts)
        rare = np.concatenate(rare)
        yield dealt(part_of(mix(rare), parts), CONTEXTS, [rare, np.concatenate(before)], parts)

    def count(batches):
        held, size = [], 0
        for part in slices(batches):
            held.append(tokens_in(part.column(1))[0])
            size += len(held[-1])
            if size >= TOGETHER:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    def meet(held):
        if PAIRS in held:
            word, other, n, left = joined(held[PAIRS], [np.int64] * 4)
            keys, n = _sums(word << 32 | other << 1 | left, n)
            columns = [keys >> 32, keys >> 1 & 0x7FFFFFFF, n, keys & 1]
            yield dealt(columns[0] % parts, PAIRS, columns, parts)
        if CONTEXTS in held:
            rare, before = joined(held[CONTEXTS], [np.uint64, np.int64])
            order = np.argsort(rare, kind="stable")
            yield dealt(part_of(mix(rare), parts), CONTEXTS, [rare[order], before[order]], parts)

    return gathered(rows.mapInArrow(count, SCHEMA), parts, meet, SCHEMA)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(counts: np.ndarray) -> float:
    """What depends on the classes in the log likelihood of class bigrams and words."""
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(0)).sum() - _xlogx(counts.sum(1)).sum())


def gains(own: int, right: np.ndarray, left: np.ndarray, alone: float, counts: np.ndarray) -> np.ndarray:
    """What the likelihood gains when a word moves from class own to each class.

    right and left count its neighbours' classes, but for the word itself, which stands beside itself alone times.
    """
    n = counts.copy()
    n[own] -= right
    n[:, own] -= left
    n[own, own] -= alone
    r, c = np.flatnonzero(right), np.flatnonzero(left)
    to_right, to_left = np.zeros_like(n), np.zeros_like(n)
    to_right[:, r] = _xlogx(n[:, r] + right[r]) - _xlogx(n[:, r])
    to_left[c] = _xlogx(n[c] + left[c][:, None]) - _xlogx(n[c])
    inner = np.diag(n)
    gain = to_right.sum(1) - np.diag(to_right) + to_left.sum(0) - np.diag(to_left) + _xlogx(inner + right + left + alone) - _xlogx(inner)
    # the words before it stay before something, and those after it after something, wherever it goes
    rows, columns, a, b = n.sum(1) + left, n.sum(0) + right, right.sum() + alone, left.sum() + alone
    gain -= _xlogx(rows + a) - _xlogx(rows) + _xlogx(columns + b) - _xlogx(columns)
    return gain - gain[own]


def _class_counts(pairs: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class bigrams; the last class is that of all words outside the head."""
    shared = pairs.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        for b in batches:
            for data in b.column(2).to_pylist():
                word, other, n, left = (c.astype(np.int64) for c in unpack(data)[0])
                own = (left == 0) | (other == len(shared.value) - 1)  # each pair once: by its first word, if that is a head
                a, b2 = np.where(left == 0, word, other)[own], np.where(left == 0, other, word)[own]
                key, n = _sums(shared.value[a] * (classes + 1) + shared.value[b2], n[own])
                yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    out = np.zeros((classes + 1) ** 2)
    for r in pairs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most (classes + 1)^2 rows
        out[r["key"]] = r["n"]
    return out.reshape(classes + 1, classes + 1)


def _proposals(pairs: DataFrame, of: np.ndarray, counts: np.ndarray, turn: int) -> list:
    """word, best class and gain of those words of one half that gain by moving."""
    shared = pairs.sparkSession.sparkContext.broadcast((of, counts))

    def run(batches):
        of, counts = shared.value
        width = len(counts)
        for b in batches:
            for data in b.column(2).to_pylist():
                word, other, n, left = (c.astype(np.int64) for c in unpack(data)[0])
                half = (mix((word + (turn // 2 << 20)).astype(np.uint64)) & np.uint64(1)).astype(np.int64) == turn % 2
                word, other, n, left = (c[half] for c in (word, other, n, left))
                own, at = np.unique(word, return_inverse=True)
                alone = np.bincount(at, n * ((word == other) & (left == 0)), len(own))
                n = np.where(word == other, 0, n)
                moved = []
                for first in range(0, len(own), 1024):  # bounds the tables of neighbours
                    inside = (at >= first) & (at < first + 1024)
                    size = min(1024, len(own) - first)
                    key = ((at[inside] - first) * 2 + left[inside]) * width + of[other[inside]]
                    around = np.bincount(key, n[inside], size * 2 * width).reshape(size, 2, width)
                    for i in range(size):
                        c = int(of[own[first + i]])
                        gain = gains(c, around[i, 0], around[i, 1], alone[first + i], counts)[:-1]
                        best = int(np.argmax(gain))
                        if gain[best] > 1e-6 * max(1.0, counts.sum() * 1e-9):
                            moved.append((int(own[first + i]), best, float(gain[best])))
                if moved:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*moved, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["word", "class", "gain"])

    return pairs.mapInArrow(run, "word long, class long, gain double").collect()  # at most one row for each head word


def exchange(pairs: DataFrame, start: np.ndarray, classes: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each head word (and of all others, the last), counts of class bigrams, and the likelihood after each round."""
    of = np.append(start, classes)
    counts = _class_counts(pairs, of, classes)
    history = [likelihood(counts)]
    for turn in range(rounds):
        moves = sorted(_proposals(pairs, of, counts, turn), key=lambda r: (-r["gain"], r["word"]))
        while moves:
            new = of.copy()
            new[[r["word"] for r in moves]] = [r["class"] for r in moves]
            new_counts = _class_counts(pairs, new, classes)
            if likelihood(new_counts) >= history[-1]:
                of, counts = new, new_counts
                break
            moves = moves[: len(moves) // 2]  # moves made at once may spoil each other: the best half of them
        history.append(likelihood(counts))
        if turn % 2 and history[-1] - history[-3] < tolerance * abs(history[-1]):  # both halves have been tried
            break
    return of, counts, history


class Model:
    """What scoring needs besides the words outside the head: histories are classes 0 to classes, the last for those words."""

    def __init__(self, heads: Heads, head_counts: np.ndarray, of: np.ndarray, counts: np.ndarray, n_class: np.ndarray, v_class: np.ndarray, total: int, types: int, history: list[float]):
        self.heads, self.of, self.total, self.types, self.history = heads, of, total, types, history
        self.base = math.log10(total + PRIOR * (types + 1))
        smooth = counts + PRIOR
        self.steps = np.log10(smooth / smooth.sum(1, keepdims=True))
        self.sizes = np.log10(n_class + PRIOR * (v_class + 1))
        self.head_logs = np.log10(head_counts + PRIOR)
        self.inside = self.head_logs - self.sizes[of[:-1]]
        self.unknown = np.log10((10 ** (self.steps + math.log10(PRIOR) - self.sizes)).sum(1))


def _rare_classes(found: DataFrame, of: np.ndarray, counts: np.ndarray, classes: int) -> DataFrame:
    """LEXICON (hash, count, class) of the words outside the head, and PAIRS (word before's class, own class, tokens, words)."""
    total = counts.sum()
    n_class, n_before = counts[:, :classes].sum(0), counts.sum(1)
    fit = np.log((counts[:, :classes] + SHRINK * (n_before / max(total, 1.0))[:, None] + 1e-9) / (n_class + SHRINK)).astype(np.float32)
    shared = found.sparkSession.sparkContext.broadcast((of, fit))

    def run(batches):
        of, fit = shared.value
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                rare, before = unpack(data)[0]
                if not len(rare):
                    continue
                rare, h = rare.astype(np.uint64), of[before.astype(np.int64)]
                at = np.flatnonzero(np.concatenate(([True], rare[1:] != rare[:-1])))
                n = np.diff(np.append(at, len(rare)))
                best = np.empty(len(at), np.int64)
                step = max(1, (1 << 16) * len(at) // len(rare))
                for i in range(0, len(at), step):
                    a, z = at[i], at[i + step] if i + step < len(at) else len(rare)
                    best[i : i + step] = np.add.reduceat(fit[h[a:z]], at[i : i + step] - a).argmax(1)
                steps = np.bincount(h * classes + np.repeat(best, n), minlength=(classes + 1) * classes)
                types = np.bincount(best, minlength=classes)
                values = [pack([rare[at], n, best]), pack([steps, np.append(types, np.zeros(len(steps) - classes, np.int64))])]
                yield pa.record_batch([pa.array([part] * 2, pa.int32()), pa.array([LEXICON, PAIRS], pa.int32()), pa.array(values, pa.binary())], names=["part", "kind", "data"])

    return found.mapInArrow(run, SCHEMA)


def _added(found: DataFrame, width: int) -> np.ndarray:
    """Sums of the packed columns of all rows, in Spark."""

    def run(batches):
        out = np.zeros((2, width), np.int64)
        for b in batches:
            for data in b.column(2).to_pylist():
                out += np.array([c.astype(np.int64) for c in unpack(data)[0]])
        at = np.flatnonzero(out.any(0))
        yield pa.record_batch([pa.array(at), *(pa.array(c[at]) for c in out)], names=["at", "a", "b"])

    out = np.zeros((2, width))
    for r in found.mapInArrow(run, "at long, a long, b long").groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():  # at most width rows
        out[:, r["at"]] = r["a"], r["b"]
    return out


def train(rows: DataFrame, head: int = HEAD, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the packed table of all words outside the head, from the texts in the second column of rows."""
    sc = rows.sparkSession.sparkContext
    words = written(lexicon(rows), "unigrams")
    hashes, head_counts, total, types = _most_frequent(words, head)
    discard(words)
    heads = Heads(hashes)
    found = written(contexts(rows, sc.broadcast(heads)), "contexts")
    start = np.minimum(np.arange(len(heads)), classes - 1)  # by falling frequency
    of, counts, history = exchange(found.filter(F.col("kind") == PAIRS), start, classes, rounds)
    rare = written(_rare_classes(found.filter(F.col("kind") == CONTEXTS), of, counts, classes), "rare-words")
    steps, more = _added(rare.filter(F.col("kind") == PAIRS), (classes + 1) * classes)
    counts = counts[:, :classes] + steps.reshape(classes + 1, classes)
    n_class = np.bincount(of[:-1], head_counts, classes) + steps.reshape(classes + 1, classes).sum(0)
    v_class = np.bincount(of[:-1], minlength=classes) + more[:classes]
    discard(found)
    return Model(heads, head_counts, of, counts, n_class, v_class, total, types, history), rare.filter(F.col("kind") == LEXICON)


@plain_id
def score_texts(docs: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score and score (log10) of each row.

    Head words are scored where the text lies; other words go, with the class before them, to the part that knows them,
    and come back as one sum for each row and part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = parts_of(docs)
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"))

    def ask(batches):
        model: Model = shared.value
        task = TaskContext.get().partitionId()
        number, held, size = task << 36, [[], [], []], 0
        for part in slices(batches):
            hashes, lengths = tokens_in(part.column(1))
            own = model.heads.numbers(hashes)
            c = model.of[own]
            before = np.concatenate((model.of[model.heads.numbers(np.array([END]))], c[:-1]))
            head = own < len(model.heads)
            row = np.repeat(np.arange(len(lengths)), lengths)
            n = own[head]
            score = np.bincount(row[head], model.steps[before[head], c[head]] + model.inside[n], len(lengths))
            base = np.bincount(row[head], model.head_logs[n], len(lengths)) - lengths * model.base
            keys = number + np.arange(len(lengths))
            number += len(lengths)
            sums = [pa.array(x) for x in (keys, lengths, np.bincount(row[head], minlength=len(lengths)), base, score)]
            sink = pa.BufferOutputStream()
            batch = pa.record_batch([part.column(0), *sums], names=["id", "key", "n", "known", "base", "score"])
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.record_batch([pa.array([task % parts], pa.int32()), pa.array([ROWS], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "kind", "data"])
            for x, y in zip(held, (hashes[~head], keys[row[~head]], before[~head]), strict=True):
                x.append(y)
            size += int((~head).sum())
            if size >= TOGETHER // 4:
                yield dealt_asked(held)
                held, size = [[], [], []], 0
        if size:
            yield dealt_asked(held)

    def dealt_asked(held):
        columns = [np.concatenate(c) for c in held]
        return dealt(part_of(mix(columns[0]), parts), ASKED, columns, parts)

    def answer(held):
        model: Model = shared.value
        for data in held.get(ROWS, []):
            task = int(pa.ipc.open_stream(data).read_all().column("key")[0].as_py() >> 36)
            yield pa.record_batch([pa.array([task % parts], pa.int32()), pa.array([ROWS], pa.int32()), pa.array([data], pa.binary())], names=["part", "kind", "data"])
        if ASKED not in held:
            return
        word, n, of = joined(held.get(LEXICON, []), [np.uint64, np.int64, np.int64])
        word, n, of = np.append(word, np.uint64(2**64 - 1)), np.append(n, 0), np.append(of, 0)
        order = np.argsort(word, kind="stable")
        word, n, of = word[order], n[order], of[order]
        hashes, key, before = joined(held[ASKED], [np.uint64, np.int64, np.int64])
        at = np.searchsorted(word, hashes)
        known = (word[at] == hashes) & (n[at] > 0)
        count, c = np.where(known, n[at], 0), of[at]
        score = np.where(known, model.steps[before, c] + np.log10(count + PRIOR) - model.sizes[c], model.unknown[before])
        keys, row = np.unique(key, return_inverse=True)
        sums = [np.bincount(row, x, len(keys)) for x in (known, np.log10(count + PRIOR), score)]
        yield dealt((keys >> 36) % parts, ANSWERS, [keys, sums[0].astype(np.int64), sums[1], sums[2]], parts)

    def add(held):
        key, known, base, score = joined(held.get(ANSWERS, []), [np.int64, np.int64, np.float64, np.float64])
        order = np.argsort(key, kind="stable")
        key, known, base, score = (c[order] for c in (key, known, base, score))
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        more = [np.append(np.add.reduceat(c, at) if len(at) else c[:0], c.dtype.type(0)) for c in (known, base, score)]
        key = key[at]
        for data in held.get(ROWS, []):
            t = pa.ipc.open_stream(data).read_all().combine_chunks()
            own = t.column("key").to_numpy()
            place = np.searchsorted(key, own)
            found = np.append(key, -1)[place] == own
            place = np.where(found, place, len(key))
            known, base, score = (t.column(c).to_numpy() + m[place] for c, m in zip(("known", "base", "score"), more, strict=True))
            ids = t.column("id").combine_chunks()
            yield pa.record_batch([ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, t.column("n").combine_chunks(), pa.array(known), pa.array(base), pa.array(score)], names=out.names)

    out = StructType([rows.schema[0], StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    asked = rows.mapInArrow(ask, SCHEMA).unionByName(words.select("part", "kind", "data"))
    return gathered(gathered(asked, parts, answer, SCHEMA), parts, add, out)


def perplexity(scored: DataFrame, score_col: str = "score") -> float:
    """Ten to the power of the negative mean log10 probability of a token; of no rows it is not a number."""
    r = scored.agg(F.sum(score_col).alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-r.s / r.n) if r.n else math.nan


def op5_brown(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, words = train(docs.filter(~held_out("doc_id")))
    out = score_texts(docs, model, words)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
