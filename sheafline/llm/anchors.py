"""Anchored runs of windows: how equal windows of different rows meet without shuffling every window.

A window of `window` tokens is anchored at its leftmost k-gram of least hash, so equal windows have equal anchors at
equal places. Consecutive windows with one anchor form a run, about one run for every (window - k) / 2 tokens. A run
travels as one record: the hash of its anchor (key), a digest of all its tokens, hashes of the anchor with the tokens to
its right and to its left, and its place. Records meet by key. Records with equal key and digest are one class: every
later copy of a class repeats the first one whole, and only first copies go on. Two classes with one key may share some
of their windows; if so they also share what lies right of the anchor, or else left of it, and only such classes are
compared window by window afterwards, by the operators that use this module.

Each task drops its own later copies before the shuffle, so a class sends few records however often it occurs. A text of
any length is handled in stretches of STRETCH tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import SCHEMA, dealt, gathered, joined, part_of, parts_of
from .tasks import MULTIPLIER, mix, slices

#: Kinds of packed rows: records of runs, windows that repeat an earlier place, first copies to be compared.
RECORD, LATE, PIECE = 0, 1, 2
RECORDS = [np.uint64, np.uint64, np.uint32, np.uint32, np.int64, np.int64, np.int64, np.int64]  # key, digest, right, left, doc, start, n, split
LATES = [np.int64] * 5  # doc, start, n, source, source_start
PIECES = [np.int64, np.int64, np.int64, np.uint64, np.int64]  # doc, start, n, key, classes of the key
#: Records that a task gathers before it sends them, and tokens of a text handled at once.
FLUSH, STRETCH = 1 << 20, 1 << 18
#: Bytes of short texts handled at once: the arrays stay in a core's cache.
NEAR = 1 << 16
#: Low bits of a gram's hash that give way to its place in a slice.
PLACE = np.uint64((1 << 20) - 1)


class Runs(NamedTuple):
    """Runs of windows of a slice: row, first window's start in the row, number of windows, anchor hash, and the places of the first window and of the anchor in the slice."""

    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    place: np.ndarray


def runs(grams: np.ndarray, lengths: np.ndarray, window: int, k: int) -> Runs:
    """Anchored runs of windows of rows of so many tokens, from the hashes of all k-grams of the tokens in one line."""
    none = np.empty(0, np.int64)
    if len(grams) + k - 1 < window:
        return Runs(*[none] * 6)
    if len(grams) > int(PLACE):
        raise ValueError("a slice has too many tokens")
    # a gram's place stands in the low bits of its hash, so that one minimum finds both and the left one wins ties
    least = grams & ~PLACE | np.arange(len(grams), dtype=np.uint64)
    size, want = 1, window - k + 1
    while size < want:  # sliding minimum by doubling
        step = min(size, want - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    place = (least & PLACE).astype(np.int64)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    inside = np.flatnonzero(row[: len(least)] == row[window - 1 :])
    if not len(inside):
        return Runs(*[none] * 6)
    place, own = place[inside], row[inside]
    # one place anchors windows of one row only, as windows lie inside rows
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    at = inside[first]
    owner = own[first]
    return Runs(owner, at - (ends - lengths)[owner], np.diff(np.append(first, len(inside))), grams[place[first]].view(np.int64), at, place[first])


def records(grams: np.ndarray, lengths: np.ndarray, docs: np.ndarray, base: int, window: int, k: int) -> list[np.ndarray]:
    """The columns of RECORDS for rows of so many tokens; base is the place of the first token in its text."""
    side = (window - k) // 2
    if side > k:
        raise ValueError("the anchor must be longer than half of what it leaves of the window")
    found = runs(grams, lengths, window, k)
    key = found.anchor.view(np.uint64)
    # a run's tokens are covered by k-grams; the last one ends where the run ends
    size = found.n + window - 1
    digest = size.astype(np.uint64)
    for j in range(-(-(2 * window - k) // k)):
        digest = mix(digest * MULTIPLIER + grams[found.first + np.minimum(j * k, size - k)])
    before = found.place - found.first  # tokens left of the anchor in the first window; one less in each next one
    split = np.clip(before - (window - k - side), 0, found.n)  # so many windows reach less than `side` to the right of the anchor
    right, left = np.zeros(len(key), np.uint32), np.zeros(len(key), np.uint32)
    to = np.flatnonzero(split < found.n)
    right[to] = mix(key[to] * MULTIPLIER + grams[found.place[to] + side]) | np.uint64(1)
    to = np.flatnonzero(split)
    left[to] = mix(key[to] + grams[found.place[to] - side] * MULTIPLIER) | np.uint64(1)
    return [key, digest, right, left, docs[found.row], found.start + base, found.n.astype(np.int64), split]


def _first_copies(columns: list[np.ndarray], within: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which records stay, and the columns of LATES for the others: those with an equal one at an earlier place."""
    key, digest, _, _, doc, start, n, _ = columns
    both = mix(key + digest * MULTIPLIER)
    order = np.argsort(both)
    same = both[order][1:] == both[order][:-1]
    again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
    stay = np.ones(len(key), bool)
    if not len(again):
        return stay, [np.empty(0, np.int64)] * 5
    again = again[np.lexsort((start[again], doc[again], both[again]))]
    new = np.concatenate(([True], both[again][1:] != both[again][:-1]))
    first = again[new][np.cumsum(new) - 1]
    late = (doc[again] != doc[first]) | ((start[again] != start[first]) & within)
    gone, source = again[late], first[late]
    stay[gone] = False
    return stay, [doc[gone], start[gone], n[gone], doc[source], start[source]]


def _shared(key: np.ndarray, side: np.ndarray, doc: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of anchors made longer by a side, and the number of these classes with each: 0 if no window of theirs can be a copy; a side of 0 is none."""
    longer = mix(key + side.astype(np.uint64) * MULTIPLIER)
    _, first, of, counts = np.unique(longer, return_index=True, return_inverse=True, return_counts=True)
    again = counts > 1
    if not within:
        again = np.zeros(len(counts), bool)
        again[of[doc != doc[first][of]]] = True
    return longer, np.where(again[of] & (side > 0), counts[of], 0)


def located(docs: DataFrame, tokenise: Callable, window: int, k: int, within: bool, together: int | None = None) -> DataFrame:
    """Packed rows dealt by document: LATE windows, and PIECEs that may share windows with other classes.

    docs has columns doc and text; tokenise gives, for a slice of texts, the k-gram hashes of all tokens in one line (as
    a function of a range of them) and the number of tokens of each text. within: copies inside one document count.
    together: pieces hold only windows that share a side with another class, and those of anchors with more classes than
    this go to the anchors made longer by that side; None: pieces are whole runs.
    """
    parts = parts_of(docs)

    def flush(held: list[list[np.ndarray]]):
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        stay, late = _first_copies(columns, within)
        if len(late[0]):
            yield dealt(part_of(mix(late[0].view(np.uint64)), parts), LATE, late, parts)
        columns = [c[stay] for c in columns]
        yield dealt(part_of(mix(columns[0]), parts), RECORD, columns, parts)

    def send(batches):
        held, size = [], 0
        for part in slices(batches, size=NEAR):
            docs_of = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            grams, lengths = tokenise(part.column(1))
            if len(lengths) > 1 or lengths[0] <= STRETCH:
                stretches = [(0, grams(0, int(lengths.sum())), lengths)]
            else:
                n = int(lengths[0])
                stretches = ((a, grams(a, min(n, a + STRETCH + window - 1)), np.array([min(n, a + STRETCH + window - 1) - a])) for a in range(0, n - window + 1, STRETCH))
            for base, found, own in stretches:
                held.append(records(found, own, docs_of, base, window, k))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def meet(held):
        for data in held.get(LATE, []):  # dealt by document already; this part only passes it on
            yield dealt_late(data)
        columns = joined(held.get(RECORD, []), RECORDS)
        order = np.argsort(columns[0])
        key = columns[0][order]
        same = key[1:] == key[:-1]
        again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
        columns = [c[again] for c in columns]
        if not len(columns[0]):
            return
        stay, late = _first_copies(columns, within)
        if len(late[0]):
            yield dealt(part_of(mix(late[0].view(np.uint64)), parts), LATE, late, parts)
        key, digest, right, left, doc, start, n, split = columns = [c[stay] for c in columns]
        # one row for each class: those that stay of one class lie in one document
        _, one, of = np.unique(mix(key + digest * MULTIPLIER), return_index=True, return_inverse=True)
        _, place, size = np.unique(key[one], return_inverse=True, return_counts=True)
        classes = size[place][of]
        to_right, rights = (c[of] for c in _shared(key[one], right[one], doc[one], within))
        to_left, lefts = (c[of] for c in _shared(key[one], left[one], doc[one], within))
        if together is None:
            kinds = [((rights > 0) | (lefts > 0), start, n, key, classes)]
        else:
            whole = classes <= together
            a, b = np.where(lefts > 0, 0, split), np.where(rights > 0, n, split)
            kinds = [(whole & (a < b), start + a, b - a, key, classes), (~whole & (lefts > 0), start, split, to_left, lefts), (~whole & (rights > 0), start + split, n - split, to_right, rights)]
        for those, *columns in kinds:
            if those.any():
                piece = [doc[those], *(c[those] for c in columns)]
                yield dealt(part_of(mix(piece[0].view(np.uint64)), parts), PIECE, piece, parts)

    def dealt_late(data: bytes) -> pa.RecordBatch:
        late = joined([data], LATES)
        return dealt(part_of(mix(late[0].view(np.uint64)), parts), LATE, late, parts)

    return gathered(docs.select("doc", "text").mapInArrow(send, SCHEMA), parts, meet, SCHEMA)
