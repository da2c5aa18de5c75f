"""Substring removal with suffix automata (operator 2).

The reference is what documents share (see :mod:`.repeats`), in shards: each shard is a suffix
automaton over words of at most ``SHARD_WORDS`` words where one text allows it.  A document is streamed through the automata of the
shards its anchors point to: the matching statistic at a word is the length of the longest run that
ends there and occurs in an earlier document.  Where it reaches ``LENGTH`` words the run is marked;
unions of marked runs are the maximal spans that are removed, so the first occurrence stays.

A corpus is its own reference, so broadcasting all automata to all documents would read every document once for every shard.  They are broadcast where
the whole reference has at most ``BROADCAST_WORDS`` words (counted first), and the documents are streamed through them without being moved.  Beyond that
the documents' slices travel to the shard of their family, where the automaton grows document by document; families of more than ``TASK_WORDS`` words are compared
by their windows (:func:`.repeats.split`).  All give the same spans.

Defined cases: texts of fewer than ``LENGTH`` words, nulls in doc_id or text and empty tables have no
spans; repeats inside one document alone are not removed; equal rows are one document and get the same
spans; rows with the same doc_id but other texts are other documents; extra columns are kept by
:func:`remove_repeats` and ignored by :func:`repeated_spans`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from . import text as tx
from .repeats import LENGTH, Family, Slice
from .scratch import written

SHARD_WORDS = 100_000
BROADCAST_WORDS = TASK_WORDS = 200_000


class SuffixAutomaton:
    """Suffix automaton over integer words; each state knows the first document that holds its strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [-1]
        self.last, self.words = 0, 0

    def add(self, words: list[int], doc: int) -> None:
        """Add one run; documents are added in ascending order.  Runs don't touch each other."""
        nxt, link, length, owner = self.next, self.link, self.length, self.doc
        last = 0
        for w in words:
            known = nxt[last].get(w)
            if known is not None:  # a generalised automaton: the string is there already, perhaps in a longer state
                if length[known] == length[last] + 1:
                    last = known
                else:
                    last = self._split(last, w, known)
                continue
            state = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            owner.append(doc)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = state
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = state
        self.words += len(words)

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.doc.append(self.doc[q])
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def windows(self, words: list[int], doc: int) -> list[tuple[int, int]]:
        """Runs (first, last) of the windows of LENGTH words that a document before ``doc`` holds, by their first words.

        A window is held if the matching statistic at its last word reaches LENGTH.
        """
        nxt, link, length, owner = self.next, self.link, self.length, self.doc
        state, n = 0, 0
        found: list[tuple[int, int]] = []
        first, last = 0, -2
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            if to is None:
                while state != -1 and w not in nxt[state]:
                    state = link[state]
                if state == -1:
                    state, n = 0, 0
                    continue
                n = length[state] + 1
                to = nxt[state][w]
            else:
                n += 1
            state = to
            if n >= LENGTH:
                at, m = state, n
                while owner[at] >= doc and m >= LENGTH:  # only in later documents: a shorter suffix may be older
                    at = link[at]
                    m = length[at]
                if m >= LENGTH:
                    window = i + 1 - LENGTH
                    if window != last + 1:
                        if last >= 0:
                            found.append((first, last))
                        first = window
                    last = window
        if last >= 0:
            found.append((first, last))
        return found


def union(runs: list[tuple[int, int]], touch: int = 1) -> list[tuple[int, int]]:
    """Runs (first, last) joined where they overlap or the next begins at most ``touch`` after the end."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + touch:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, stop) of words that runs of windows cover."""
    return [(a, b + LENGTH) for a, b in union(windows, LENGTH)]


def novel(words: np.ndarray, held: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """The text of the windows that aren't in ``held`` (runs of windows, joined)."""
    at, n = 0, len(words) - LENGTH + 1
    for a, b in [*held, (n, n)]:
        if a > at:
            yield words[at : a + LENGTH - 1]
        at = b + 1


def stream(family: Family) -> list[tuple[int, int, int]]:
    """Spans (document, start, stop) of a family: its documents in order, each against the automata of those before."""
    shards: list[SuffixAutomaton] = []
    spans, doc_runs = [], defaultdict(list)
    for run in family.slices:
        doc_runs[run.doc].append(run)
    for doc in sorted(doc_runs):
        fresh = []
        for run in doc_runs[doc]:
            words = run.words.tolist()
            held = union([s for shard in shards for s in shard.windows(words, doc)])
            spans += [(doc, run.begin + a, run.begin + b) for a, b in spans_of(held)]
            fresh += novel(run.words, held)
        for part in fresh:
            if not shards or shards[-1].words + len(part) > SHARD_WORDS:
                shards.append(SuffixAutomaton())
            shards[-1].add(part.tolist(), doc)
    return spans


def _stream(families: Iterator[Family]) -> Iterator[tuple[Family, list[tuple[int, int, int]]]]:
    for family in families:
        yield family, stream(family)


def _by_broadcast(docs: DataFrame, cut: DataFrame) -> DataFrame:
    parts = [(r.doc_id, r.text_hash, part.tobytes()) for r in cut.select("doc_id", "text_hash", "size", "words").collect() for part in np.split(np.frombuffer(r.words, np.uint64), np.cumsum(r.size)[:-1])]
    rows = sorted(set(parts))
    order = {key: i for i, key in enumerate(sorted({r[:2] for r in rows}))}
    shards: list[SuffixAutomaton] = []
    for doc_id, text_hash, words in rows:
        if not shards or shards[-1].words + len(words) // 8 > SHARD_WORDS:
            shards.append(SuffixAutomaton())
        shards[-1].add(np.frombuffer(words, np.uint64).tolist(), order[doc_id, text_hash])
    sent = docs.sparkSession.sparkContext.broadcast((order, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, shards = sent.value
        for batch in tx.batches_of(batches, 2):
            words = tx.Words(batch.column(2))
            hashes = words.hashes()
            out = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key in order:
                    text = hashes[words.first[i] : words.first[i + 1]].tolist()
                    out += [(*key, a, b) for a, b in spans_of([s for shard in shards for s in shard.windows(text, order[key])])]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "text_hash", "start", "stop"])

    return tx.map_batches(repeats.keyed(docs), run, repeats.SPANS).distinct()


def spans(docs: DataFrame) -> DataFrame:
    """Maximal repeated spans (doc_id, text_hash, start, stop), in words."""
    cut = written(repeats.families(docs, repeats.repeated_anchors(docs)), "families")
    size = cut.agg(F.coalesce(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda n, x: n + x)), F.lit(0)).alias("n")).first().n
    if size <= BROADCAST_WORDS:
        return _by_broadcast(docs, cut)
    cold, hot = repeats.split(cut, TASK_WORDS)
    placed = cold.repartition("family").sortWithinPartitions("family", "doc_id", "text_hash")
    found = tx.map_batches(placed, repeats.matcher(_stream), repeats.SPANS)
    return repeats.merged(found.union(hot) if hot is not None else found)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of every maximal span that repeats an earlier document."""
    return repeats.result(spans(docs))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without those spans."""
    return repeats.remove(docs, spans(docs))
