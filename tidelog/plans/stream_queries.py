"""Template mining, generators and the streaming scorer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drain, synth, tables
from ..operators import sequence as seq
from ..operators import windows as win
from ..functions import masking
from ..sources.adapters import document_lines, events_log, probe_lines, table
from ..streaming import scorer
from .registry import query
from .sequence_queries import PAIRS, pairs, trained

_STREAM = PAIRS + """,
known AS (SELECT pos, line_no, host, code, row_number() OVER (PARTITION BY host ORDER BY pos) - 1 AS seen, lag(code) OVER (PARTITION BY host ORDER BY pos) AS c1, lag(code, 2) OVER (PARTITION BY host ORDER BY pos) AS c2 FROM coded WHERE code % 7 <> 3),
cand AS (SELECT c2, c1, next, 0 AS level, rank FROM r2 WHERE rank <= 3 UNION ALL SELECT c2, c1, next, 1, rank FROM (SELECT DISTINCT c2, c1 FROM n2) JOIN r1 USING (c1) WHERE rank <= 6 UNION ALL SELECT c2, c1, next, 2, rank FROM (SELECT DISTINCT c2, c1 FROM n2), r0 WHERE rank <= 9),
best AS (SELECT c2, c1, next, min(level * 1000 + rank) AS s FROM cand GROUP BY ALL),
pred AS (SELECT c2, c1, list(next ORDER BY s)[1:3] AS predicted FROM best GROUP BY ALL),
out AS (SELECT line_no, host AS key, 'unknown_template' AS reason FROM coded WHERE code % 7 = 3
  UNION ALL SELECT line_no, host, CASE WHEN seen < 50 THEN 'warm_up' WHEN list_contains(predicted, code) THEN 'predicted' ELSE 'not_predicted' END FROM known LEFT JOIN pred USING (c2, c1))
SELECT line_no, key, reason, reason IN ('unknown_template', 'not_predicted') AS is_anomaly, CASE reason WHEN 'unknown_template' THEN 0.8::DOUBLE WHEN 'not_predicted' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS confidence FROM out"""


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    return seq.predictions(trained(p), 3)


def _coded(log: DataFrame, words: DataFrame) -> DataFrame:
    known = F.broadcast(words.where("index % 7 <> 3").select(F.col("template").alias("__t"), F.col("index").alias("template_index")))
    joined = log.join(known, F.col("template") == F.col("__t"), "left")
    return joined.select(F.col("host").alias("key"), "line_no", F.col("timestamp").cast("timestamp").alias("timestamp"), "template_index")


@query("z1_z4_batch_scorer", f"WITH {_STREAM}")
def z_batch(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    found = scorer.verdicts(scorer.batch_contexts(_coded(log, win.vocabulary(log))), _predictions(spark, sf))
    return found.select("line_no", "key", "reason", "is_anomaly", "confidence")


@query("z1_z4_stream_scorer", f"WITH {_STREAM}")
def z_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events file as a stream, scored in one available-now run; verdicts are the stream's own, read from its sink."""
    folder = f"{tables.folder(spark)}/stream-{uuid.uuid4().hex}"
    log = events_log(spark, sf)
    words, predictions = tables.written(win.vocabulary(log), "words"), tables.written(_predictions(spark, sf), "predictions")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("long")
    lines = stream.select(F.col("event_id").alias("line_no"), F.col("ts").alias("timestamp"), F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("host"), F.concat_ws("_", "event_type", (k % 4).cast("string")).alias("template"))
    found = scorer.verdicts(scorer.contexts(_coded(lines, words)), predictions)
    query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out").select("line_no", "key", "reason", "is_anomaly", "confidence")


@query("t1_drain_exact")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    lines = probe_lines(spark, sf).withColumn("masked", masking.mask("raw"))
    return drain.mine(lines.select("line_no", "masked")).select("line_no", "template_id", "template")


@query("t1_drain_by_source")
def t1_sources(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf).select((F.col("doc_id") * 100_000 + F.col("line")).alias("line_no"), "host", masking.mask("raw").alias("masked"))
    return drain.mine(lines, source="host").select("line_no", "host", "template_id", "template")


@query("t1_drain_distinct")
def t1_distinct(spark: SparkSession, sf: str) -> DataFrame:
    lines = events_log(spark, sf).select("line_no", masking.mask("raw").alias("masked"))
    return drain.mine_distinct(lines).select("line_no", "template_id", "template")


@query("t2_drain_state")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    lines = events_log(spark, sf).select("line_no", masking.mask("raw").alias("masked"))
    first = drain.clusters(drain.mine(lines.where("line_no % 2 = 0")))
    return drain.clusters(drain.mine(lines.where("line_no % 2 = 1"), state=first))


@query("t3_without_miner", "SELECT event_id AS line_no, NULL::VARCHAR AS template_id, NULL::VARCHAR AS template FROM events")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return drain.without_miner(events_log(spark, sf).select("line_no"))


@query("y1_synthetic_log", synth.oracle(5000))
def y1(spark: SparkSession, sf: str) -> DataFrame:
    return synth.generate(spark, 5000)


@query("y2_training_log", synth.oracle(10_000, 0.0))
def y2(spark: SparkSession, sf: str) -> DataFrame:
    return synth.training(spark, 10_000)


@query("y3_anomaly_log", synth.oracle(1_500, 0.15, 44, kinds=tuple(synth.KINDS), bursts=True))
def y3(spark: SparkSession, sf: str) -> DataFrame:
    return synth.inference_anomaly(spark)
