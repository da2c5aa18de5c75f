"""Mixing sources to target weights (operator 5).

A source's share of tokens p becomes its weight p**a / sum(p**a).  The exponent a is bisected on
[0, 1]: the largest one whose weights reach ``ENTROPY`` of the greatest possible entropy, raised, if
some source were read more than ``REPEAT_LIMIT`` times, to the smallest that keeps within it.  With a
budget of ``BUDGET_RATIO`` times all tokens, each source gets floor(weight x budget) tokens: whole
epochs, then part of one.  An epoch is a permutation of the source's blocks (documents grouped by a hash, about
``BLOCK_TOKENS`` each); the last epoch takes blocks in its order while they fit.  Of the next block, documents that are longer than
what is left are passed over, and the others are taken by hash up to the first that doesn't fit any more.  So a source falls short of its budget by
less than the longest of those documents.

Tokens are words (runs of bytes that aren't ASCII white space).  All counts are over all rows; only
a row per source reaches the driver.  Defined cases: a null source is a source of its own; rows
without any word (null or empty text) are drawn by no epoch; a null doc_id hashes as one id; repeated rows
are drawn each; a text of any length is one document of that many words; an empty table mixes to an empty result; :func:`mixed` keeps all columns, whatever
their names: where one is called ``epoch``, ``block`` or ``block_order``, the number of that name that it adds gets ``mixing_`` in front.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

ENTROPY, REPEAT_LIMIT, BUDGET_RATIO, BLOCK_TOKENS, ROUNDS = 0.95, 4.0, 1.0, 1 << 16, 50
#: Block rows that are broadcast at most; beyond, documents and blocks are joined by shuffling.
BROADCAST_BLOCKS = 200_000
PLAN = T.StructType([T.StructField("__key", T.StringType()), T.StructField("__blocks", T.LongType()), T.StructField("__epochs", T.LongType()), T.StructField("__rest", T.LongType()), T.StructField("__total", T.LongType())])


def n_tokens(text: Column | str = "text") -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x09-\\x0d ]+"), "")).cast("long"), F.lit(0).cast("long"))


def weights(shares: list[float], a: float) -> list[float]:
    powers = [p**a for p in shares]
    return [x / sum(powers) for x in powers]


def exponent(tokens: list[int], budget: float, entropy: float = ENTROPY, limit: float = REPEAT_LIMIT) -> float:
    """The exponent for sources of ``tokens`` tokens each (see the module)."""
    total = sum(tokens)
    shares = [t / total for t in tokens]
    least = entropy * math.log(len(tokens))

    def spread(a: float) -> bool:
        return -sum(w * math.log(w) for w in weights(shares, a)) >= least

    def within(a: float) -> bool:
        return max(w * budget / t for w, t in zip(weights(shares, a), tokens, strict=True)) <= limit

    low, high = 0.0, 1.0
    if not spread(1.0):
        for _ in range(ROUNDS):
            mid = (low + high) / 2
            low, high = (mid, high) if spread(mid) else (low, mid)
        a = low
    else:
        a = 1.0
    if not within(a):
        low, high = a, 1.0
        for _ in range(ROUNDS):
            mid = (low + high) / 2
            low, high = (low, mid) if within(mid) else (mid, high)
        a = high
    return a


def plan(tokens: dict[str, int], budget_ratio: float = BUDGET_RATIO) -> list[tuple[str, int, int, int, int]]:
    """(source, blocks, whole epochs, tokens of the last epoch, tokens) of each source."""
    names = sorted(tokens)
    if not names:
        return []
    counts = [tokens[n] for n in names]
    budget = budget_ratio * sum(counts)
    share = [c / sum(counts) for c in counts]
    out = []
    for name, count, w in zip(names, counts, weights(share, exponent(counts, budget)), strict=True):
        own = math.floor(w * budget)
        out.append((name, -(-count // BLOCK_TOKENS), own // count, own % count, count))
    return out


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """(__key, __id, __source, __n) of each row: its source, its id as text, and its words."""
    key = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))
    return docs.select(key.alias("__key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"), n_tokens().alias("__n"), F.col("doc_id").cast("long").alias("doc_id"), "source")


def drawn(rows: DataFrame, counts: DataFrame, n: Column, kept: list[str], budget_ratio: float) -> DataFrame:
    """``kept`` columns of ``rows`` (__key, __id, __full, ...) as often as they are drawn, with epoch, block and block_order.

    ``counts`` (__key, __id, __n) is the same table by its numbers of words; ``n`` gives that number for a row, and is only
    evaluated in the blocks that are drawn in part.
    """
    spark = rows.sparkSession
    totals = {r["__key"]: r["n"] for r in counts.where("__n > 0").groupBy("__key").agg(F.sum("__n").alias("n")).collect()}
    table = plan(totals, budget_ratio)
    sources = spark.createDataFrame(table, PLAN)
    sources = F.broadcast(sources) if len(table) <= BROADCAST_BLOCKS else sources
    block = _number(F.concat(F.lit("block:"), "__id")) % F.col("__blocks")
    sizes = counts.where("__n > 0").join(sources, "__key").withColumn("block", block).groupBy("__key", "block", "__epochs", "__rest", "__total").agg(F.sum("__n").alias("__size"))
    every = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "__epochs")))
    by = W.partitionBy("__key", "epoch").orderBy(F.md5(F.concat_ws(":", F.lit("epoch"), "epoch", "__key", "block")), "block")
    ordered = every.select(
        "__key",
        "block",
        "epoch",
        F.row_number().over(by).cast("long").alias("block_order"),
        (F.when(F.col("epoch") < F.col("__epochs"), F.col("__total")).otherwise(F.col("__rest")) - F.sum("__size").over(by) + F.col("__size")).alias("__left"),
        "__size",
    ).where("__left > 0")
    few = sum(r[1] * (r[2] + 1) for r in table) <= BROADCAST_BLOCKS
    placed = rows.where("__full").join(sources.select("__key", "__blocks"), "__key").withColumn("block", block)
    got = placed.join(F.broadcast(ordered) if few else ordered, ["__key", "block"])
    columns = [*kept, "epoch", "block", "block_order"]
    whole = got.where("__size <= __left").select(*columns)
    inside = W.partitionBy("__key", "epoch", "block").orderBy(F.md5(F.concat_ws(":", F.lit("doc"), "epoch", "__id")), "__id", "__n")
    part = got.where("__size > __left").withColumn("__n", n).where("__n <= __left").withColumn("__sum", F.sum("__n").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return whole.unionByName(part.where("__sum <= __left").select(*columns))


def mixed(docs: DataFrame, budget_ratio: float = BUDGET_RATIO) -> DataFrame:
    """Rows of ``docs`` as often as they are drawn, with ``epoch``, ``block`` and ``block_order``.  Words are counted once; texts are not moved."""
    counts = written(counted(docs).select("__key", "__id", "__n"), "counts")
    key = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))
    full = F.coalesce(F.col("text").rlike("[^\\x09-\\x0d ]"), F.lit(False))
    rows = docs.select(F.struct("*").alias("__row"), key.alias("__key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"), full.alias("__full"))
    got = drawn(rows, counts, n_tokens("__row.text"), ["__row"], budget_ratio)
    return got.select("__row.*", *[F.col(c).alias(name) for c, name in free_names(docs.columns).items()])


def free_names(columns: list[str]) -> dict[str, str]:
    """Names for the numbers that mixing adds, none of them among ``columns``."""
    taken, names = {c.lower() for c in columns}, {}
    for c in ("epoch", "block", "block_order"):
        names[c] = c
        while names[c] in taken:
            names[c] = f"mixing_{names[c]}"
    return names


def draws(docs: DataFrame, budget_ratio: float = BUDGET_RATIO) -> DataFrame:
    """(doc_id, source, epoch, block, block_order, n_tokens) of every draw."""
    counts = written(counted(docs), "counts")
    rows = counts.select("*", F.col("__n").alias("n_tokens"), (F.col("__n") > 0).alias("__full")).drop("__n")
    return drawn(rows, counts, F.col("n_tokens"), ["doc_id", "source", "n_tokens"], budget_ratio).select("doc_id", "source", "epoch", "block", "block_order", "n_tokens")


ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, coalesce('s:' || source, 'null') AS k, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id,
         len(list_filter(string_split_regex(text, '[\\x09-\\x0d ]+'), lambda x: x <> '')) AS n
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT k, CAST(sum(n) AS BIGINT) AS total FROM t WHERE n > 0 GROUP BY k),
l AS (SELECT list(total ORDER BY k) AS tokens, list(total / (SELECT sum(total) FROM s) ORDER BY k) AS shares,
             {BUDGET_RATIO} * sum(total) AS budget FROM s),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM l
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, low, high, list_sum(list_transform(shares, lambda p: -(p ** ((low + high) / 2)) / z * ln((p ** ((low + high) / 2)) / z))) >= {ENTROPY} * ln(len(shares)) AS ok
        FROM (SELECT i, low, high, shares, list_sum(list_transform(shares, lambda p: p ** ((low + high) / 2))) AS z FROM bisect, l)) WHERE i < {ROUNDS}),
a AS (SELECT CASE WHEN list_sum(list_transform(shares, lambda p: -p * ln(p))) >= {ENTROPY} * ln(len(shares)) THEN 1.0 ELSE low END AS a FROM bisect, l WHERE i = {ROUNDS}),
limited AS (
  SELECT 0 AS i, a AS low, 1.0::DOUBLE AS high FROM a
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (SELECT i, low, high, list_max(list_transform(list_zip(shares, tokens), lambda x: (x[1] ** ((low + high) / 2)) / z * budget / x[2])) <= {REPEAT_LIMIT} AS ok
        FROM (SELECT i, low, high, shares, tokens, budget, list_sum(list_transform(shares, lambda p: p ** ((low + high) / 2))) AS z FROM limited, l)) WHERE i < {ROUNDS}),
e AS (SELECT CASE WHEN list_max(list_transform(list_zip(shares, tokens), lambda x: (x[1] ** a) / z * budget / x[2])) <= {REPEAT_LIMIT} THEN a ELSE high END AS a
      FROM (SELECT a, high, shares, tokens, budget, list_sum(list_transform(shares, lambda p: p ** a)) AS z FROM a, l, limited WHERE i = {ROUNDS})),
w AS (SELECT k, total, CAST(floor((total / (SELECT sum(total) FROM s)) ** a / (SELECT sum((total / (SELECT sum(total) FROM s)) ** a) FROM s) * budget) AS BIGINT) AS own FROM s, e, l),
p AS (SELECT k, total, CAST(ceil(total / {BLOCK_TOKENS}) AS BIGINT) AS blocks, own // total AS epochs, own % total AS rest FROM w),
d AS (SELECT t.*, p.epochs, p.rest, p.total, CAST('0x' || substr(md5('block:' || id), 1, 8) AS BIGINT) % blocks AS block FROM t JOIN p USING (k) WHERE n > 0),
b AS (SELECT k, block, epochs, rest, total, CAST(sum(n) AS BIGINT) AS size FROM d GROUP BY ALL),
o AS (SELECT k, block, epoch, size, row_number() OVER q AS block_order,
             CASE WHEN epoch < epochs THEN total ELSE rest END - sum(size) OVER q + size AS remaining
      FROM (SELECT b.*, unnest(range(0, epochs + 1)) AS epoch FROM b)
      WINDOW q AS (PARTITION BY k, epoch ORDER BY md5('epoch:' || epoch || ':' || k || ':' || block), block)),
r AS (SELECT d.doc_id, d.source, o.epoch, d.block, o.block_order, d.n, o.size, o.remaining,
             sum(CASE WHEN d.n <= o.remaining THEN d.n END) OVER (PARTITION BY d.k, o.epoch, d.block ORDER BY md5('doc:' || o.epoch || ':' || d.id), d.id, d.n ROWS UNBOUNDED PRECEDING) AS run
      FROM d JOIN o ON d.k = o.k AND d.block = o.block WHERE o.remaining > 0)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, block, block_order, CAST(n AS BIGINT) AS n_tokens FROM r WHERE size <= remaining OR (n <= remaining AND run <= remaining)
"""
