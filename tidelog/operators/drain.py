"""Template mining: a fixed-depth parse tree over message tokens (the Drain algorithm).

Mining is sequential by nature: what a line matches depends on the lines before it.  Two modes:

* :func:`mine` reads every line of a source in order and gives each the template as it stood at that
  line.  The first level of the tree is the number of tokens, so no cluster ever crosses it: sources and, inside them, messages of each
  length are mined in parallel, and clusters are numbered afterwards in the order of their first lines, as one pass would have numbered them.
* :func:`mine_distinct` reads each distinct message once, in the order of first lines, and joins the
  final templates back.  It moves far less through Python; repeated messages can't change clusters
  and templates aren't snapshots, so results may differ from :func:`mine` where clusters merged late.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import written

WILD = "<*>"
#: What Python's str.split takes for white space.
BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


#: Line numbers whose repeated messages are one row for the miner.
CHUNK = 1 << 12
#: Stands for a null line number, which comes first.
FIRST = -(1 << 63)


@dataclass(frozen=True)
class DrainParams:
    depth: int = 4
    similarity: float = 0.4
    max_children: int = 100


#: Leaves of more clusters than this find candidates by their tokens instead of comparing all.
FEW = 8


class Cluster:
    __slots__ = ("number", "tokens", "size", "wild", "text")

    def __init__(self, number: int, tokens: list[str], size: int = 0):
        self.number, self.size = number, size
        self.take(tokens)

    def take(self, tokens: list[str]) -> None:
        self.tokens, self.wild, self.text = tokens, tokens.count(WILD), " ".join(tokens)


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    clusters: list[Cluster] = field(default_factory=list)
    #: by place, the clusters (their places in ``clusters``) that have a token there; filled where there are more than FEW
    places: list[dict[str, list[int]]] = field(default_factory=list)

    def put(self, cluster: Cluster) -> None:
        self.clusters.append(cluster)
        if self.places:
            self._post(len(self.clusters) - 1)
        elif len(self.clusters) > FEW:
            self.places = [{} for _ in cluster.tokens]
            for i in range(len(self.clusters)):
                self._post(i)

    def _post(self, i: int) -> None:
        for place, token in zip(self.places, self.clusters[i].tokens, strict=True):
            if token != WILD:
                place.setdefault(token, []).append(i)

    def widen(self, cluster: Cluster, tokens: list[str]) -> None:
        """The cluster's tokens become ``tokens``, some of them wild now."""
        if self.places:
            i = self.clusters.index(cluster)
            for place, old, new in zip(self.places, cluster.tokens, tokens, strict=True):
                if old != new:
                    place[old].remove(i)
                    if not place[old]:
                        del place[old]
        cluster.take(tokens)

    def candidates(self, tokens: list[str], least: int) -> list[Cluster]:
        """In their order, all clusters that have ``least`` tokens in common with the message, and some others.

        Such a cluster misses at most n - least of the n tokens, so it has one of any n - least + 1; those that the fewest clusters have are looked up.
        """
        if not self.places or least < 1:
            return self.clusters
        having = sorted([place.get(token, ()) for place, token in zip(self.places, tokens, strict=True)], key=len)
        return [self.clusters[i] for i in sorted(set().union(*having[: len(tokens) - least + 1]))]


class Miner:
    """Clusters of token lists; the prefix tree is keyed by length and the first tokens, numbers being wild."""

    def __init__(self, params: DrainParams = DrainParams(), clusters: list[tuple[int, list[str], int]] | None = None):
        self.params, self.root, self.clusters = params, {}, []
        self.least: dict[int, int] = {}
        self.changes = 0  # of clusters and of the tree; while there is none, a message has the cluster that it had
        for number, tokens, size in sorted(clusters or []):
            cluster = Cluster(number, list(tokens), size)
            self.clusters.append(cluster)
            self._leaf(cluster.tokens, create=True).put(cluster)

    def _leaf(self, tokens: list[str], create: bool) -> Node | None:
        node = self.root.get(len(tokens))
        if node is None:
            if not create:
                return None
            node = self.root[len(tokens)] = Node()
        for token in tokens[: max(self.params.depth - 2, 0)]:
            child = node.children.get(token)
            if child is None and not create:
                child = node.children.get(WILD)
            elif child is None:
                child = self._grow(node, token)
            if child is None:
                return None
            node = child
        return node

    def _grow(self, node: Node, token: str) -> Node:
        room = self.params.max_children - len(node.children) - (WILD not in node.children)
        name = WILD if any(c.isdigit() for c in token) or room <= 0 else token
        return node.children.setdefault(name, Node())

    def _least(self, n: int) -> int:
        """How many of n tokens make a message similar."""
        if n not in self.least:
            self.least[n] = next((i for i in range(n + 1) if i / n >= self.params.similarity), n + 1) if n else 0
        return self.least[n]

    def add(self, message: str) -> Cluster:
        """The cluster of the message, after it has taken the message in."""
        tokens = message.split()
        leaf = self._leaf(tokens, create=False)
        own = [None if t == WILD else t for t in tokens] if WILD in tokens else tokens  # a wild token equals none
        best, score, least = None, (-1, -1), self._least(len(tokens))
        for cluster in leaf.candidates(own, least) if leaf else ():
            rank = (sum(map(operator.eq, cluster.tokens, own)), cluster.wild)
            if rank > score:
                best, score = cluster, rank
        if best is None or (score[0] < least if tokens else self.params.similarity > 1):
            best = Cluster(self.clusters[-1].number + 1 if self.clusters else 1, tokens)
            self.clusters.append(best)
            self._leaf(tokens, create=True).put(best)
            self.changes += 1
        elif score[0] + best.wild < len(tokens):
            leaf.widen(best, [a if a == b else WILD for a, b in zip(best.tokens, own, strict=True)])
            self.changes += 1
        best.size += 1
        return best


def mine(log: DataFrame, params: DrainParams = DrainParams(), state: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """Adds ``template_id`` and ``template`` to (line_no, masked, ...); a null message has neither.

    ``state``: clusters (cluster_id, tokens, size) to start from, one row per template.
    """
    known = [(r.cluster_id, list(r.tokens), r.size) for r in state.collect()] if state is not None else []  # a row per template
    base = max((k[0] for k in known), default=0)
    plain = log.drop("template_id", "template")
    chunk = F.coalesce(F.floor(F.col("line_no") / CHUNK), F.lit(-(1 << 62)))
    # a null source is a source of its own; it keeps apart from an empty one
    named = plain.withColumns({"__source": F.col(source).cast("string") if source else F.lit(""), "__chunk": chunk})
    rows = written(named, "lines")
    line = F.coalesce("line_no", F.lit(FIRST)).cast("long")
    lists = rows.where("masked is not null").groupBy("__source", "__chunk", "masked").agg(F.sort_array(F.collect_list(line)).alias("__lines"))
    once = lists.withColumns({"__n": F.size(F.array_remove(F.split("masked", BLANK), "")), "__at": F.col("__lines")[0]})
    schema = "__source string, __n int, __chunk long, masked string, __from array<long>, __own array<long>, __template array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, miner, pending = None, Miner(params, known), []
        out: list[tuple] = []

        def flushed() -> Iterator[pd.DataFrame]:
            yield pd.DataFrame(out, columns=["__source", "__n", "__chunk", "masked", "__from", "__own", "__template"])
            out.clear()

        for batch in batches:
            for s, n, c, text, lines in zip(batch["__source"], batch["__n"], batch["__chunk"], batch["masked"], batch["__lines"], strict=True):
                if (s, n, c) != current:
                    out += [(*current, *found) for found in mined_chunk(miner, pending)] if pending else []
                    if current is None or (s, n) != current[:2]:
                        miner = Miner(params, known)
                    current, pending = (s, n, c), []
                    if len(out) > 2000:
                        yield from flushed()
                pending.append((text, lines))
        out += [(*current, *found) for found in mined_chunk(miner, pending)] if pending else []
        yield from flushed()

    placed = once.repartition("__source", "__n").sortWithinPartitions("__source", "__n", "__chunk", "__at", "masked")
    runs = written(placed.select("__source", "__n", "__chunk", "masked", "__lines").mapInPandas(run, schema), "mined")
    each = runs.select("__source", "__n", F.explode(F.arrays_zip(F.col("__from").alias("f"), F.col("__own").alias("o"))).alias("r"))
    key = ["__source", "__n", "__own"]
    fresh = each.select("__source", "__n", F.col("r.o").alias("__own"), F.col("r.f").alias("__f")).where(F.col("__own") > base).groupBy(*key).agg(F.min("__f").alias("__first"))
    number = F.row_number().over(W.partitionBy("__source").orderBy("__first", "__n", "__own")) + base
    numbers = fresh.select(*key, number.cast("long").alias("__number"))
    text = [F.col("__source").alias("__s"), F.col("__chunk").alias("__c"), F.col("masked").alias("__m")]
    at = F.greatest(F.size(F.filter("__from", lambda f: f <= line)), F.lit(1)) - 1
    same = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__chunk") == F.col("__c")) & (F.col("masked") == F.col("__m"))
    mined = rows.join(runs.select(*text, "__n", "__from", "__own", "__template"), same, "left")
    mined = mined.withColumns({"template": F.col("__template")[at], "__own": F.col("__own")[at]}).drop("__from", "__template", "__s", "__c", "__m")
    again = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]
    named = mined.join(numbers.select(*[F.col(c).alias(f"{c}_") for c in key], "__number"), again, "left")
    return named.select(*plain.columns, F.coalesce("__number", "__own").cast("string").alias("template_id"), "template")


def mined_chunk(miner: Miner, messages: list[tuple[str, np.ndarray]]) -> Iterator[tuple[str, list[int], list[int], list[str]]]:
    """(message, from, cluster, template): of each message of a chunk (with its line numbers), the clusters that it had and the lines from which it had them.

    As if all lines were read in order.  While neither a cluster nor the tree changes, a message has the cluster that it had, so it is only looked at again after a change.
    """
    found: list[tuple[list[int], list[int], list[str]]] = [([], [], []) for _ in messages]

    def note(i: int, line: int, cluster: Cluster) -> None:
        start, own, text = found[i]
        if not own or own[-1] != cluster.number or text[-1] != cluster.text:
            start.append(int(line))
            own.append(cluster.number)
            text.append(cluster.text)

    changes, rest = miner.changes, None
    for i, (message, lines) in enumerate(messages):  # in the order of first lines
        note(i, lines[0], miner.add(message))
        if miner.changes != changes and any(len(m[1]) > 1 for m in messages):
            rest = i  # what follows the change is read line by line
            break
    if rest is not None:
        numbers = np.repeat(np.arange(len(messages)), [len(m[1]) for m in messages])
        lines = np.concatenate([m[1] for m in messages])
        order = np.lexsort((numbers, lines))
        last = int(np.flatnonzero((numbers[order] == rest))[0])
        seen = [-1] * len(messages)
        for j in order[last + 1 :].tolist():
            i = int(numbers[j])
            if seen[i] != miner.changes:
                changes = miner.changes
                note(i, lines[j], miner.add(messages[i][0]))
                seen[i] = changes  # out of date if this message made a change
    return ((m[0], *f) for m, f in zip(messages, found, strict=True))


def clusters(mined: DataFrame) -> DataFrame:
    """(cluster_id, tokens, size) from mined lines: the last template of each id."""
    last = mined.where("template_id is not null").groupBy(F.col("template_id").cast("long").alias("cluster_id"))
    return last.agg(F.split(F.max_by("template", "line_no"), " ").alias("tokens"), F.count("*").alias("size"))


def mine_distinct(log: DataFrame, params: DrainParams = DrainParams()) -> DataFrame:
    """Adds ``template_id`` and the final ``template``, mined over distinct messages in the order of their first lines."""
    once = log.where("masked is not null").groupBy("masked").agg(F.min("line_no").alias("line_no"))
    mined = mine(once, params)
    final = mined.groupBy("template_id").agg(F.max_by("template", "line_no").alias("template"))
    lookup = mined.select(F.col("masked").alias("__m"), "template_id").join(final, "template_id")
    return log.drop("template_id", "template").join(lookup, F.col("masked") == F.col("__m"), "left").drop("__m")


def without_miner(log: DataFrame) -> DataFrame:
    """The columns of mined lines, all null: what a parse without template mining gives."""
    return log.withColumns({"template_id": F.lit(None).cast("string"), "template": F.lit(None).cast("string")})


def export(mined: DataFrame) -> DataFrame:
    """(template_id, template): the first template of each id."""
    return mined.where("template_id is not null").groupBy("template_id").agg(F.min_by("template", "line_no").alias("template"))
