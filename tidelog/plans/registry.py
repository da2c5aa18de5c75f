"""Registration of queries and of the DuckDB statements they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


#: common table expressions over the driver's tables
LOGS = """logs AS (
  SELECT event_id AS line_no, ts AS timestamp, 'h' || (user_id % 8) AS host, event_type AS process,
         event_type || ' user=' || user_id || ' k=' || k AS raw, event_type || '_' || (k % 4) AS template_id, k, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
POS = LOGS + """,
pos AS (SELECT *, row_number() OVER (ORDER BY timestamp NULLS FIRST, line_no) - 1 AS pos FROM logs)"""
WINDOWED = POS + """,
codes AS (SELECT template_id, row_number() OVER (ORDER BY template_id) - 1 AS code FROM (SELECT DISTINCT template_id FROM logs)),
coded AS (SELECT pos.*, code FROM pos JOIN codes USING (template_id)),
win AS (SELECT *, unnest(range(greatest(0, (pos - 25) // 25), pos // 25 + 1)) AS window_idx FROM coded),
counts AS (SELECT window_idx, code, count(*) AS cnt FROM win GROUP BY ALL),
starts AS (SELECT window_idx, arg_min(line_no, pos) AS start_index FROM win GROUP BY ALL)"""
EWM = WINDOWED + """,
numbered AS (SELECT code, window_idx AS w, cnt::DOUBLE AS x, row_number() OVER (PARTITION BY code ORDER BY window_idx) AS r FROM counts),
fold AS (
  SELECT code, w, r, x, x AS mean, 0.0::DOUBLE AS b, 1.0::DOUBLE AS s2 FROM numbered WHERE r = 1
  UNION ALL
  SELECT code, w, r, x, mu, (ow * (b + (mean - mu) ** 2) + 0.3 * (x - mu) ** 2) / (ow + 0.3), (ow * ow * s2 + 0.09) / ((ow + 0.3) * (ow + 0.3))
  FROM (SELECT o.code, o.w, o.r, o.x, f.mean, f.b, f.s2, 0.7 ** (o.w - f.w) AS ow, (0.7 ** (o.w - f.w) * f.mean + 0.3 * o.x) / (0.7 ** (o.w - f.w) + 0.3) AS mu
        FROM fold f JOIN numbered o ON o.code = f.code AND o.r = f.r + 1)),
ewm AS (SELECT w AS window_idx, code, CAST(x AS BIGINT) AS cnt, mean, CASE WHEN s2 < 1 THEN b / (1 - s2) END AS variance,
               CASE WHEN s2 < 1 THEN greatest(0.0, (x - mean) / sqrt(greatest(b / (1 - s2), 1e-9))) ELSE 0.0 END AS z FROM fold)"""
FEATURES = EWM + """,
fresh AS (SELECT window_idx, sum(CASE WHEN window_idx = f THEN 1 ELSE 0 END) / greatest(1, count(*)) AS unseen_rate
          FROM (SELECT window_idx, min(window_idx) OVER (PARTITION BY code) AS f FROM counts) GROUP BY window_idx),
features AS (SELECT window_idx, max(z) AS freq_z, any_value(unseen_rate) AS unseen_rate, any_value(start_index) AS window_start_line
             FROM ewm JOIN fresh USING (window_idx) JOIN starts USING (window_idx) GROUP BY window_idx)"""
SCORES = FEATURES + """,
capped AS (SELECT *, least(greatest(freq_z, 0), cap) / cap AS freq_norm, least(greatest(unseen_rate, 0), 1) AS unseen_norm
           FROM features, (SELECT greatest(1e-9, quantile_cont(freq_z, 0.95)) AS cap FROM features)),
scored AS (SELECT *, round(0.6 * freq_norm + 0.4 * unseen_norm, 9) AS score FROM capped),
scores AS (SELECT window_start_line, unseen_rate, freq_z, freq_norm, unseen_norm, score, score >= (SELECT quantile_cont(score, 0.95) FROM scored) AS is_anomaly FROM scored)"""
