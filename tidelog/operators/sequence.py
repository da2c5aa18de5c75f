"""Sequence model: next-template scorer, verdicts, sessions, K-of-N and alerts with cooldown.

The scorer is a back-off model: counts of what followed the last two templates or, where these were never seen together in training, the last one,
or none.  It stands in for a trained recurrent network where a deterministic, distributed model is
wanted; :mod:`.lstm` has the network itself.  Everything after the scores is the same for both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import windows as win
from .tables import written


@dataclass(frozen=True)
class AlertConfig:
    """Verdicts and alerts; ``top_p`` replaces ``top_k`` where it is set."""

    top_k: int = 3
    top_p: float | None = None
    k: int = 7
    n: int = 10
    cooldown_sequence: float = 60.0
    cooldown_novelty: float = 60.0
    session_timeout: float = 300.0
    entity: str = "host"


def session_id(entity: Column, number: Column) -> Column:
    """Eight hex digits that depend on the entity and the number of its session only."""
    return F.substring(F.md5(F.concat(entity, F.lit(":"), number.cast("string"))), 1, 8)


def train(pairs: DataFrame) -> DataFrame:
    """(order, c1, c2, next, cnt, prob, rank): every successor of every context of order 2, 1 and 0, the most frequent first.

    ``pairs`` as from ``windows.contexts``.  Ties go to the lower index.  prob is the share among all successors of the context.
    """
    last = F.element_at("context", -1)
    before = F.when(F.size("context") > 1, F.element_at("context", -2))
    rows = pairs.select(before.alias("c2"), last.alias("c1"), F.col("target").alias("next"))
    none = F.lit(None).cast("long")
    two = rows.where("c2 is not null").groupBy("c2", "c1", "next").agg(F.count("*").alias("cnt"))
    one = two.groupBy(none.alias("c2"), "c1", "next").agg(F.sum("cnt").alias("cnt"))
    zero = one.groupBy(none.alias("c2"), none.alias("c1"), "next").agg(F.sum("cnt").alias("cnt"))
    orders = [df.select(F.lit(o).alias("order"), "c2", "c1", "next", "cnt") for o, df in ((2, two), (1, one), (0, zero))]
    every = orders[0].unionByName(orders[1]).unionByName(orders[2])
    by = W.partitionBy("order", "c2", "c1")
    return every.withColumn("prob", F.col("cnt") / F.sum("cnt").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("cnt"), "next")))


def predictions(model: DataFrame, k: int) -> DataFrame:
    """(c2, c1, predicted): for every context of order 2 that was trained, its k best successors: those of the
    longest context first, filled from shorter ones."""
    own = model.where("order = 2").select("c2", "c1", "next", F.lit(0).alias("level"), "rank")
    contexts = own.select("c2", "c1").distinct()
    one = contexts.join(model.where(f"order = 1 and rank <= {2 * k}").select("c1", "next", F.lit(1).alias("level"), "rank"), "c1").select("c2", "c1", "next", "level", "rank")
    zero = contexts.crossJoin(F.broadcast(model.where(f"order = 0 and rank <= {3 * k}").select("next", F.lit(2).alias("level"), "rank")))
    return _best(own.where(f"rank <= {k}").unionByName(one).unionByName(zero), k, "c2", "c1")


def _best(every: DataFrame, k: int, *context: str) -> DataFrame:
    """The k best successors of each context, by level and rank."""
    best = every.groupBy(*context, "next").agg(F.min(F.struct("level", "rank")).alias("s"))
    lists = best.groupBy(*context).agg(F.sort_array(F.collect_list(F.struct("s", "next"))).alias("l"))
    return lists.select(*context, F.transform(F.slice("l", 1, k), lambda x: x["next"]).alias("predicted"))


def shorter_predictions(model: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(c1, predicted) of every template that was trained, for pairs that weren't, and the one row (predicted) for templates that weren't either."""
    own = model.where(f"order = 1 and rank <= {k}").select("c1", "next", F.lit(0).alias("level"), "rank")
    top = model.where(f"order = 0 and rank <= {2 * k}").select("next", F.lit(1).alias("level"), "rank")
    one = _best(own.unionByName(own.select("c1").distinct().crossJoin(F.broadcast(top))), k, "c1")
    return one, _best(top.where(f"rank <= {k}"), k)


def infer_top_k(pairs: DataFrame, model: DataFrame, k: int = 3) -> DataFrame:
    """(idx, line_no, timestamp, host, target, in_topk, predicted): predicted by the longest context that was trained, of order 2, 1 or 0.

    A model that was trained on nothing predicts nothing, and every row fails.
    """
    one, none = shorter_predictions(model, k)
    rows = pairs.withColumns({"c1": F.element_at("context", -1), "c2": F.try_element_at("context", F.lit(-2))})
    known = rows.join(predictions(model, k).withColumnRenamed("predicted", "p2"), ["c2", "c1"], "left")
    known = known.join(one.withColumnRenamed("predicted", "p1"), "c1", "left").crossJoin(F.broadcast(none.withColumnRenamed("predicted", "p0")))
    filled = F.coalesce("p2", "p1", "p0", F.array().cast("array<bigint>"))
    padded = F.slice(F.concat(filled, F.array_repeat(F.lit(-1).cast("long"), k)), 1, k)
    return known.select("idx", "line_no", "timestamp", "host", "target", F.array_contains(filled, F.col("target")).alias("in_topk"), padded.alias("predicted"))


def infer_top_p(pairs: DataFrame, model: DataFrame, p: float) -> DataFrame:
    """(idx, ..., in_topk): ok if the probability of everything ranked before the target is under p; the first rank always is.

    Ranks and probabilities are those of the longest context that was trained, of order 2, 1 or 0; a target that never followed it fails.
    """
    by = W.partitionBy("order", "c2", "c1").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    every = model.select("order", "c2", "c1", F.col("next").alias("target"), F.coalesce(F.sum("prob").over(by), F.lit(0.0)).alias("b"))
    two, one, zero = (every.where(f"order = {o}").select(*on, "target", F.col("b").alias(f"b{o}")) for o, on in ((2, ["c2", "c1"]), (1, ["c1"]), (0, [])))
    rows = pairs.withColumns({"c1": F.element_at("context", -1), "c2": F.try_element_at("context", F.lit(-2))})
    rows = rows.join(model.where("order = 2").select("c2", "c1").distinct().withColumn("has2", F.lit(True)), ["c2", "c1"], "left")
    rows = rows.join(model.where("order = 1").select("c1").distinct().withColumn("has1", F.lit(True)), "c1", "left")
    rows = rows.join(two, ["c2", "c1", "target"], "left").join(one, ["c1", "target"], "left").join(zero, "target", "left")
    before = F.when(F.col("has2"), F.col("b2")).when(F.col("has1"), F.col("b1")).otherwise(F.col("b0"))
    return rows.select("idx", "line_no", "timestamp", "host", "target", F.coalesce(before < p, F.lit(False)).alias("in_topk"))


def with_sessions(rows: DataFrame, timeout: float = 300.0, entity: str = "host") -> DataFrame:
    """Adds ``session_no`` (from 0 per entity) and ``session_id``: a session ends when an entity is silent for more than ``timeout`` seconds.

    A null timestamp makes no gap.  Gaps are found and counted in blocks of an entity's positions, and shifted by those of the blocks before.
    """
    key = (entity,)
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    near = win.neighbourhood("__pos", key)
    blocks = win.with_blocks(win.with_position(written(rows, "verdicts"), "__pos", key), "__pos", 1, 0)
    gap = F.coalesce(((t - F.lag(t).over(near)) / 1e6 > timeout).cast("int"), F.lit(0))
    own = blocks.withColumn("__gap", gap).where("__core").withColumn("__inside", F.sum("__gap").over(near.rowsBetween(W.unboundedPreceding, 0)))
    own = written(own.select(*rows.columns, "__block", "__gap", "__inside"), "gaps")
    before = W.partitionBy("__e").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    totals = own.groupBy(F.col(entity).alias("__e"), F.col("__block").alias("__at")).agg(F.sum("__gap").alias("__n"))
    offsets = totals.select("__e", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    numbered = own.join(offsets, F.col(entity).eqNullSafe(F.col("__e")) & (F.col("__block") == F.col("__at"))).withColumn("session_no", (F.col("__o") + F.col("__inside")).cast("long"))
    return numbered.select(*rows.columns, "session_no").withColumn("session_id", session_id(F.col(entity), F.col("session_no")))


def k_of_n(verdicts: DataFrame, k: int = 7, n: int = 10, entity: str = "host") -> DataFrame:
    """Adds ``k_of_n_triggered``: the row fails, and so do at least k of the session's last n rows, once it has n.

    Like sessions, in blocks of an entity's positions: no task holds a whole entity or session.
    """
    key = (entity, "session_no")
    failed = F.when(F.col("prediction_ok"), 0).otherwise(1)
    recent = win.neighbourhood("__pos", key).rowsBetween(-(n - 1), 0)
    blocks = win.with_blocks(win.with_position(verdicts, "__pos", key), "__pos", n - 1, 0)
    found = blocks.withColumns(
        {
            "k_of_n_triggered": (F.sum(failed).over(recent) >= k) & (F.col("__pos") >= n - 1) & ~F.col("prediction_ok"),
            "recent_failures": F.collect_list(~F.col("prediction_ok")).over(recent),
        }
    )
    return found.where("__core").drop("__pos", "__block", "__core")


def cooled(candidates: DataFrame, cooldown: Column) -> DataFrame:
    """The candidates that become alerts: per signature, in time order, one at least ``cooldown`` seconds after the last alert.

    Each alert depends on the one before it, so a signature is read in order; partitions are streamed with one
    number of state, however many candidates a signature has.  Rows without a timestamp follow the last alert at no distance.
    """
    rows = candidates.withColumn("__cool", cooldown.cast("double"))
    schema = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signature, last = None, None
        for batch in batches:
            keep = []
            times = batch["timestamp"].astype("datetime64[ns]").astype("int64") / 1e9
            for s, t, null, wait in zip(batch["signature"], times, batch["timestamp"].isna(), batch["__cool"], strict=True):
                if s != signature:
                    signature, last, fresh = s, None, True
                else:
                    fresh = last is None or (not null and t - last >= wait - 1e-9)
                keep.append(fresh)
                if fresh and not null:
                    last = t
            yield batch[pd.Series(keep, index=batch.index, dtype=bool)]

    ordered = rows.repartition("signature").sortWithinPartitions("signature", F.col("timestamp").asc_nulls_first(), "line_no")
    return ordered.mapInPandas(run, schema).drop("__cool")


def alerts(verdicts: DataFrame, config: AlertConfig = AlertConfig()) -> tuple[DataFrame, DataFrame]:
    """(detail, alerts) from verdicts (line_no, timestamp, entity column, target, template, is_novel, prediction_ok).

    Detail carries sessions and K-of-N per row; alerts those that survive their cooldown.
    """
    e = config.entity
    detail = written(k_of_n(with_sessions(verdicts, config.session_timeout, e), config.k, config.n, e), "detail")
    common = ["line_no", "timestamp", F.col(e).alias("entity"), "session_id", "recent_failures"]
    fails = detail.where("k_of_n_triggered").select(*common, F.lit("SEQ_FAIL").alias("alert_type"), F.lit(None).cast("string").alias("template_id"), "target", "is_novel")
    novel = detail.where("is_novel").select(*common, F.lit("NOVELTY").alias("alert_type"), F.col("template").alias("template_id"), "target", "is_novel")
    candidates = fails.unionByName(novel).withColumn("signature", F.concat_ws(":", "entity", "alert_type", "template_id"))
    wait = F.when(F.col("alert_type") == "SEQ_FAIL", config.cooldown_sequence).otherwise(config.cooldown_novelty)
    kept = cooled(candidates, wait)
    failures = F.when(F.col("alert_type") == "SEQ_FAIL", F.size(F.filter("recent_failures", lambda x: x)))
    first = F.row_number().over(W.partitionBy("signature").orderBy("timestamp", "line_no")) == 1
    details = F.struct(F.col("target").alias("target_template_idx"), "is_novel", "recent_failures", first.alias("first_occurrence"))
    out = kept.select(F.md5(F.concat_ws(":", "signature", "line_no")).alias("alert_id"), "timestamp", "line_no", "entity", "alert_type", "template_id", "session_id", failures.alias("k_of_n_failures"), details.alias("details"))
    return detail, out


def novelty_aggregation(found: DataFrame) -> DataFrame:
    """(template_id, count, first, last) of the novelty alerts."""
    return found.where("alert_type = 'NOVELTY'").groupBy("template_id").agg(F.count("*").alias("count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def summary(detail: DataFrame, found: DataFrame) -> DataFrame:
    """One row of totals, with a map of alerts by type."""
    types = found.groupBy("alert_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("alert_type", "n")))).alias("alerts_by_type"))
    totals = detail.agg(
        F.count("*").alias("total_sequences"), F.count_if(~F.col("prediction_ok")).alias("failures"), F.count_if("is_novel").alias("novel"),
        F.count_if("k_of_n_triggered").alias("k_of_n"), F.count_distinct("session_id").alias("sessions"),
    )
    return totals.crossJoin(F.broadcast(types))


def infer_enhanced(log: DataFrame, words: DataFrame, model: DataFrame, config: AlertConfig = AlertConfig(), length: int = 50, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detail, alerts, summary) of a log: verdicts of known templates, novelty of unknown ones, sessions, K-of-N, cooldown.

    Templates outside ``words`` are novel; with ``compat`` they are ignored, and nothing ever is.
    """
    coded = win.encode(log, words)
    pairs = win.contexts(coded, length, keep=2)
    got = infer_top_p(pairs, model, config.top_p) if config.top_p is not None else infer_top_k(pairs, model, config.top_k)
    verdicts = got.select("line_no", "timestamp", "host", "target", F.lit(None).cast("string").alias("template"), F.lit(False).alias("is_novel"), F.col("in_topk").alias("prediction_ok"))
    if not compat:
        unknown = log.join(words.select(F.col("template").alias("__w")), F.col("template") == F.col("__w"), "left_anti").where("template is not null")
        novel = unknown.select("line_no", "timestamp", "host", F.lit(None).cast("long").alias("target"), "template", F.lit(True).alias("is_novel"), F.lit(True).alias("prediction_ok"))
        verdicts = verdicts.unionByName(novel)
    detail, found = alerts(verdicts, config)
    return detail, found, summary(detail, found)
