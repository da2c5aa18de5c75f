"""Substring removal with suffix arrays (operator 3), built blockwise with a difference cover.

Text that documents share (see :mod:`.repeats`) is sorted by suffixes, families at a time.  Suffix
positions whose residue modulo ``PERIOD`` lies in ``COVER`` are ranked first, among themselves.  Then
suffixes are taken one bucket (a range of first words) at a time: a bucket is sorted by its first
``PERIOD`` words only; what still ties is resolved without reading on, since for any two positions a
shift under PERIOD brings both into the cover, where their ranks are known.  Working memory beside the
text and the cover's ranks is that of one bucket.  In the finished order, neighbours that agree in
``LENGTH`` words form groups; all occurrences of a group but those in its first document are marked, and unions of
marked runs are the spans that are removed.

Families of more than ``TASK_WORDS`` words are compared by their windows instead (:func:`.repeats.split`), so no task holds more than that and a block.

Results and defined cases (nulls, short and empty texts, repeated rows, ids with several texts, extra
columns) are those of :mod:`.automaton`; the two are tested against each other and against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import repeats
from . import text as tx
from .repeats import LENGTH, Family
from .scratch import written

PERIOD, COVER = 13, (0, 1, 3, 9)
BUCKET_WORDS = 1 << 16
BLOCK_WORDS = 1 << 18
TASK_WORDS = 1 << 21
#: SHIFT[a, b]: the least d with (a + d) and (b + d) in the cover modulo PERIOD.
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def refine(text: np.ndarray, at: np.ndarray, depth: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort positions by their first ``depth`` words: their order, and for each the number of its class of equal prefixes.

    ``text`` is padded with PERIOD zeros; its words are under ``base``.  Only classes of several go on.
    """
    pack = max(1, min(3, int(40 / max(1, np.log2(base)))))
    order, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    todo = np.arange(len(at))
    for d in range(0, depth, pack):
        if not len(todo):
            break
        key = group[todo]
        for j in range(d, min(d + pack, depth)):
            key = key * base + text[at[order[todo]] + j]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[todo] = order[todo[by]]  # todo is ascending and classes are runs: sorted by class first, each stays in its place
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        group[todo] = todo[np.flatnonzero(new)][np.cumsum(new) - 1]  # a class is named by its first place
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        todo = todo[np.repeat(size > 1, size)]
    return order, group


def cover_ranks(text: np.ndarray, n: int, base: int) -> np.ndarray:
    """Rank of the suffix at every cover position (others -1), by doubling over steps of PERIOD."""
    at = np.flatnonzero(np.isin(np.arange(n + PERIOD) % PERIOD, COVER))
    at = at[at < n]
    rank = np.full(n + 2 * PERIOD, -1, dtype=np.int64)
    order, group = refine(text, at, PERIOD, base)
    rank[at[order]] = group
    step, count = PERIOD, len(at)
    while True:
        key = (rank[at] + 1) * (count + 2) + np.where(at + step < n, rank[np.minimum(at + step, n)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(count, dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[at[order]] = np.flatnonzero(new)[np.cumsum(new) - 1]
        if new.all() or step >= n:
            return rank
        step *= 2


def buckets(text: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Positions by ranges of their first word, in order, of about BUCKET_WORDS each (a single word may have more)."""
    counts = np.cumsum(np.bincount(text[:n]))
    low = 0
    while low < len(counts):
        before = counts[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(counts, before + BUCKET_WORDS, side="right")))
        at = np.flatnonzero((text[:n] >= low) & (text[:n] < high))
        if len(at):
            yield at
        low = high


def settle(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of positions of classes that tie on PERIOD words: the place of each in its class is the number of members with a smaller suffix."""
    below = np.zeros(len(at), dtype=np.int64)
    residue = at % PERIOD
    top = np.int64(len(rank) + 1)
    members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    for a in range(PERIOD):
        for b in range(PERIOD):
            x, y = members[a], members[b]
            if len(x) and len(y):
                d = SHIFT[a, b]
                keys = np.sort(group[y] * top + rank[at[y] + d] + 1)
                mine = group[x] * top
                below[x] += np.searchsorted(keys, mine + rank[at[x] + d] + 1) - np.searchsorted(keys, mine)
    return np.lexsort((below, group))


def sorted_buckets(text: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The suffix array of text[:n], a bucket at a time.  ``text``: words numbered from 1, then PERIOD zeros."""
    base = int(text[:n].max()) + 1
    rank = cover_ranks(text, n, base)
    for at in buckets(text, n):
        order, group = refine(text, at, PERIOD, base)
        at = at[order]
        same = np.zeros(len(at), dtype=bool)
        if len(at) > 1:
            same[1:] = group[1:] == group[:-1]
            same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if len(tied):
            at[tied] = at[tied][settle(at[tied], group[tied], rank)]
        yield at


def suffix_array(words: np.ndarray) -> np.ndarray:
    """All suffixes of one text in order (for tests)."""
    text = np.concatenate([dense(words) + 1, np.zeros(2 * PERIOD, dtype=np.int64)])
    return np.concatenate([*sorted_buckets(text, len(words)), np.zeros(0, np.int64)]) if len(words) else np.zeros(0, np.int64)


def marks(words: np.ndarray, owner: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions of windows of ``length`` words whose text an earlier document of the same family has.

    ``words``: the block, with separators that occur once.  ``owner``: family, ``doc``: document number of each position.
    """
    n = len(words)
    text = np.concatenate([dense(words) + 1, np.zeros(2 * PERIOD + length, dtype=np.int64)])
    out = []
    last = np.zeros(0, dtype=np.int64)
    for at in sorted_buckets(text, n):
        same = np.ones(len(at) - 1, dtype=bool)
        live = np.arange(len(at) - 1)
        for d in range(length):  # the common prefix of neighbours, as far as needed
            live = live[text[at[live] + d] == text[at[live + 1] + d]]
        same[:] = False
        same[live] = True
        group = np.concatenate([[0], np.cumsum(~same)])
        key = group * (np.int64(owner.max()) + 1) + owner[at]
        first = np.full(len(at), np.iinfo(np.int64).max)
        number = dense(key)
        np.minimum.at(first, number, doc[at])
        out.append(at[doc[at] > first[number]])
    return np.sort(np.concatenate([last, *out]))


def block_spans(families: list[Family]) -> list[list[tuple[int, int, int]]]:
    """Spans (document, start, stop) of each family; the families' texts are one block."""
    parts, owner, doc, place, width = [], [], [], [], 0
    for f, family in enumerate(families):
        for run in family.slices:
            parts.append(run.words)
            owner.append(np.full(len(run.words) + 1, f))
            doc.append(np.full(len(run.words) + 1, run.doc))
            place.append(np.arange(run.begin, run.begin + len(run.words) + 1))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in families]
    if not parts:
        return spans
    distinct, number = np.unique(np.concatenate(parts), return_inverse=True)
    block, at = [], 0
    for i, part in enumerate(parts):
        block.append(number[at : at + len(part)])
        block.append(np.array([len(distinct) + i]))
        at += len(part)
    joined, owners, docs, places = (np.concatenate(x) for x in (block, owner, doc, place))
    found = marks(joined, owners, docs)
    if len(found):
        new = np.ones(len(found), dtype=bool)
        new[1:] = (owners[found[1:]] != owners[found[:-1]]) | (docs[found[1:]] != docs[found[:-1]]) | (places[found[1:]] > places[found[:-1]] + LENGTH) | (places[found[1:]] < places[found[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(found)) - 1
        for a, b in zip(found[first], found[last], strict=True):
            spans[owners[a]].append((int(docs[a]), int(places[a]), int(places[b]) + LENGTH))
    return spans


def _sort(families: Iterator[Family]) -> Iterator[tuple[Family, list[tuple[int, int, int]]]]:
    block: list[Family] = []
    size = 0
    for family in families:
        block.append(family)
        size += sum(len(s.words) for s in family.slices)
        if size >= BLOCK_WORDS:
            yield from zip(block, block_spans(block), strict=True)
            block, size = [], 0
    yield from zip(block, block_spans(block), strict=True)


def spans(docs: DataFrame) -> DataFrame:
    cold, hot = repeats.split(written(repeats.families(docs, repeats.repeated_anchors(docs)), "families"), TASK_WORDS)
    placed = cold.repartition("family").sortWithinPartitions("family", "doc_id", "text_hash")
    found = tx.map_batches(placed, repeats.matcher(_sort), repeats.SPANS)
    return repeats.merged(found.union(hot) if hot is not None else found)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of every maximal span that repeats an earlier document."""
    return repeats.result(spans(docs))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without those spans."""
    return repeats.remove(docs, spans(docs))
